"""Queries over single tables: filters with defaults, shapes of records, pages, routes and roll-ups."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions import lexicons as L
from loamworks.functions.keys import text_key, upper_key
from loamworks.functions.text import filing_form
from loamworks.operators.changes import upsert
from loamworks.operators.latest import latest_per_key
from loamworks.plans.relational import _EVIDENCE, d, evidence, stamp
from loamworks.plans.signals import _LEADERS, _MAPPED, _dimensions, _leaders
from loamworks.sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT company_id, count(*) AS n FROM (SELECT DISTINCT id, company_id, is_current_employee FROM glassdoor_reviews) WHERE is_current_employee = TRUE OR is_current_employee IS NULL GROUP BY company_id""")
def current_or_unknown(s, p):
    """Reviews of employees who are current, or of whom that is not known."""
    t = table(s, p, "glassdoor_reviews").where(F.coalesce("is_current_employee", F.lit(True))).select("id", "company_id").distinct()
    return t.groupBy("company_id").agg(F.count("*").alias("n"))


@query(f"""SELECT ticker, count(CASE WHEN contains(lower(source_type), 'sec') THEN 1 END) AS filings, count(CASE WHEN NOT contains(lower(source_type), 'sec') THEN 1 END) AS others FROM ({_EVIDENCE}) GROUP BY ticker""")
def evidence_split(s, p):
    """Evidence from filings and from elsewhere, by ticker."""
    filed = F.contains(F.lower("source_type"), F.lit("sec"))
    return evidence(s, p).groupBy("ticker").agg(F.count_if(filed).alias("filings"), F.count_if(~filed).alias("others"))


@query("""SELECT DISTINCT id, name FROM board_members WHERE contains(lower(name), 'capital')""")
def names_containing(s, p):
    return table(s, p, "board_members").where(F.contains(F.lower("name"), F.lit("capital"))).select("id", "name").distinct()


_SECTORS = {"AUTOMOBILE": "manufacturing", "MACHINERY": "manufacturing", "BUILDING": "business_services", "HOUSEHOLD": "retail", "FURNITURE": "retail"}


@query(f"""SELECT sector, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM (SELECT CASE c_mktsegment {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SECTORS.items() if a != "MACHINERY")} ELSE 'technology' END AS sector, c_acctbal FROM customer WHERE c_acctbal >= 1000) WHERE sector IN ('retail', 'technology') GROUP BY sector""")
def companies_filtered(s, p):
    """Customers of a least balance by the sector that their segment maps to, technology where it maps to none; two sectors asked for."""
    known = F.create_map(*[F.lit(x) for a, b in _SECTORS.items() if a != "MACHINERY" for x in (a, b)])
    t = table(s, p, "customer").where("c_acctbal >= 1000").select(F.coalesce(F.try_element_at(known, F.col("c_mktsegment")), F.lit("technology")).alias("sector"), "c_acctbal")
    return t.where(F.col("sector").isin("retail", "technology")).groupBy("sector").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


_CATEGORY = {"filing": "governance_signals", "ic_memo": "leadership_signals", "job_post": "technology_hiring", "press_release": "innovation_activity", "review_digest": "culture_signals"}


@query(f"""SELECT doc_id, coalesce(nullif(trim(source), ''), 'unknown') AS source, CASE doc_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CATEGORY.items())} ELSE 'digital_presence' END AS category, coalesce(upper(trim(ticker)), '') AS ticker, coalesce(try_cast(strftime(created_at, '%Y') AS INT), 0) AS fiscal_year, 0.8::double AS confidence FROM documents""")
def evidence_defaults(s, p):
    """The corpus in the shape of evidence, with a source, a category from the type of document, a year and a confidence for all."""
    category = F.create_map(*[F.lit(x) for pair in _CATEGORY.items() for x in pair])
    return table(s, p, "documents").select(
        "doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("source"), F.coalesce(F.try_element_at(category, F.coalesce("doc_type", F.lit(""))), F.lit("digital_presence")).alias("category"),
        F.coalesce(F.upper(F.trim("ticker")), F.lit("")).alias("ticker"), F.coalesce(F.year("created_at"), F.lit(0)).alias("fiscal_year"), F.lit(0.8).alias("confidence"),
    )


@query("""SELECT DISTINCT id, to_json({'id': id, 'type': assessment_type, 'day': strftime(assessment_date, '%Y-%m-%d'), 'scores': {'has_score': v_r_score IS NOT NULL, 'has_interval': confidence_lower IS NOT NULL AND confidence_upper IS NOT NULL}})::varchar AS document FROM assessments WHERE assessment_type IS NOT NULL AND assessment_date IS NOT NULL""")
def assessment_documents(s, p):
    """Each assessment as a nested JSON document."""
    t = table(s, p, "assessments").where("assessment_type is not null and assessment_date is not null")
    scores = F.struct(F.col("v_r_score").isNotNull().alias("has_score"), (F.col("confidence_lower").isNotNull() & F.col("confidence_upper").isNotNull()).alias("has_interval"))
    return t.select("id", F.to_json(F.struct("id", F.col("assessment_type").alias("type"), F.date_format("assessment_date", "yyyy-MM-dd").alias("day"), scores.alias("scores"))).alias("document")).distinct()


@query("""SELECT DISTINCT id, round(confidence_upper::double - confidence_lower::double, 4) AS width, round(v_r_score::double / 100 * 100, 2) AS percent, concat(upper(assessment_type[1]), replace(assessment_type[2:], '_', ' ')) AS label FROM assessments WHERE assessment_type IS NOT NULL""")
def interval_widths(s, p):
    """The width of each assessment's interval and a label of its type."""
    label = F.concat(F.upper(F.substring("assessment_type", 1, 1)), F.translate(F.substring("assessment_type", 2, 1000), "_", " "))
    t = table(s, p, "assessments").where("assessment_type is not null")
    return t.select("id", F.round(d("confidence_upper") - d("confidence_lower"), 4).alias("width"), F.round(d("v_r_score") / 100 * 100, 2).alias("percent"), label.alias("label")).distinct()


_HEADINGS = (("item\\s*1a", "Risk Factors"), ("item\\s*7a", "Market Risk"), ("item\\s*7\\b", "Management Discussion"), ("item\\s*1\\b", "Business"), ("item\\s*2\\b", "Management Discussion"), ("compensation|cd&a", "Compensation"), ("item\\s*\\d+\\.\\d+", "Event"))


@query(f"""SELECT heading, count(*) AS n FROM (SELECT DISTINCT id, CASE {" ".join(f"WHEN regexp_matches(section, '(?i){x}') THEN '{name}'" for x, name in _HEADINGS)} ELSE 'Other' END AS heading FROM document_chunks_sec) GROUP BY heading""")
def section_headings(s, p):
    """Chunks by the name of their section, the first pattern that fits; Other without one."""
    name = F.lit("Other")
    for x, h in reversed(_HEADINGS):
        name = F.when(F.col("section").rlike(f"(?i){x}"), h).otherwise(name)
    return table(s, p, "document_chunks_sec").select("id", name.alias("heading")).distinct().groupBy("heading").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT id, concat_ws('; ', CASE WHEN innovation_score >= 70 THEN 'strong innovation' WHEN innovation_score < 40 THEN 'weak innovation' END, CASE WHEN data_driven_score >= 70 THEN 'driven by data' END, CASE WHEN ai_awareness_score < 40 THEN 'little awareness of AI' END,
CASE WHEN review_count < 10 THEN 'few reviews' END) AS rationale FROM culture_signals""")
def culture_rationale(s, p):
    """What the scores of a culture snapshot say, in words."""
    c = F.col
    parts = [
        F.when(c("innovation_score") >= 70, "strong innovation").when(c("innovation_score") < 40, "weak innovation"), F.when(c("data_driven_score") >= 70, "driven by data"),
        F.when(c("ai_awareness_score") < 40, "little awareness of AI"), F.when(c("review_count") < 10, "few reviews"),
    ]
    return table(s, p, "culture_signals").select("id", F.concat_ws("; ", *parts).alias("rationale")).distinct()


@query(f"""WITH old AS (SELECT company_id, avg(governance_score::double) AS score, count(*) AS n FROM (SELECT DISTINCT id, company_id, governance_score FROM board_governance_signals) WHERE governance_score IS NOT NULL GROUP BY 1), fresh AS (SELECT company_id, round(score * 100, 6) AS score FROM ({_LEADERS}))
SELECT f.company_id, round(CASE WHEN o.n >= 5 AND o.score >= f.score THEN o.score ELSE f.score END, 6) AS score, coalesce(o.n >= 5 AND o.score >= f.score, false) AS kept FROM fresh f LEFT JOIN old o USING (company_id)""")
def leadership_protected(s, p):
    """Fresh leadership scores, but where at least five older ones have a mean that is not below, the mean."""
    t = table(s, p, "board_governance_signals").where("governance_score is not null").select("id", "company_id", d("governance_score").alias("x")).distinct()
    old = t.groupBy("company_id").agg(F.avg("x").alias("old"), F.count("*").alias("n"))
    j = _leaders(s, p).select("company_id", F.round(F.col("score") * 100, 6).alias("score")).join(old, "company_id", "left")
    kept = F.coalesce((F.col("n") >= 5) & (F.col("old") >= F.col("score")), F.lit(False))
    return j.select("company_id", F.round(F.when(kept, F.col("old")).otherwise(F.col("score")), 6).alias("score"), kept.alias("kept"))


@query("""SELECT ticker, round_even(governance_score::double, 0)::bigint AS score, confidence::double AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC NULLS LAST, id) AS r FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, governance_score, confidence, created_at FROM board_governance_signals WHERE trim(ticker) <> '')) WHERE r = 1""")
def board_leadership(s, p):
    """The newest governance score of each ticker as a leadership signal, rounded half to even."""
    t = table(s, p, "board_governance_signals").where("trim(ticker) <> ''").select("id", upper_key("ticker").alias("ticker"), "governance_score", "confidence", "created_at").distinct()
    newest = latest_per_key(t, ["ticker"], [F.desc_nulls_last("created_at"), F.col("id")])
    return newest.select("ticker", F.bround(d("governance_score")).cast("bigint").alias("score"), d("confidence").alias("confidence"))


@query("""SELECT DISTINCT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM assessments WHERE created_at > (SELECT max(created_at) - INTERVAL 30 DAY FROM assessments)""")
def assessments_since(s, p):
    """What was written in the thirty days before the newest record."""
    t = table(s, p, "assessments")
    mark = t.agg((F.max("created_at") - F.expr("interval 30 days")).alias("mark"))
    return t.join(F.broadcast(mark), F.col("created_at") > F.col("mark")).select("id", stamp("created_at").alias("at")).distinct()  # one row


@query("""WITH k AS (SELECT DISTINCT id, string_split(positive_keywords_found, ',') AS a, string_split(negative_keywords_found, ',') AS b FROM culture_signals WHERE positive_keywords_found IS NOT NULL AND negative_keywords_found IS NOT NULL)
SELECT id, place::bigint AS place, trim(a[place]) AS liked, trim(b[place]) AS disliked FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS place FROM k)""")
def keyword_pairs(s, p):
    """Two lists side by side, one row a place; the shorter list ends in nulls."""
    t = table(s, p, "culture_signals").where("positive_keywords_found is not null and negative_keywords_found is not null")
    t = t.select("id", F.split("positive_keywords_found", ",").alias("a"), F.split("negative_keywords_found", ",").alias("b")).distinct()
    return t.select("id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("id", (F.col("i") + 1).cast("bigint").alias("place"), F.trim("z.a").alias("liked"), F.trim("z.b").alias("disliked"))


@query("""SELECT id, status FROM (SELECT DISTINCT id, status, created_at FROM documents_sec WHERE status = 'parsed' AND created_at IS NOT NULL) ORDER BY created_at, id LIMIT 50""")
def next_to_clean(s, p):
    """The fifty oldest filings that wait for their next stage."""
    return table(s, p, "documents_sec").where("status = 'parsed' and created_at is not null").select("id", "status", "created_at").distinct().orderBy("created_at", "id").limit(50).select("id", "status")


@query("""SELECT id, upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) AS form FROM (SELECT DISTINCT id, filing_type FROM documents_sec WHERE id > '8' AND upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) LIKE '10%' AND filing_date >= DATE '2020-01-01') ORDER BY id LIMIT 100""")
def keyset_page(s, p):
    """The hundred filings after a key, in the order of their keys."""
    t = table(s, p, "documents_sec").where((F.col("id") > "8") & filing_form(F.col("filing_type")).startswith("10") & (F.col("filing_date") >= F.lit("2020-01-01").cast("date")))
    return t.select("id", filing_form(F.col("filing_type")).alias("form")).distinct().orderBy("id").limit(100)


@query("""SELECT ticker, arg_min(id, (-epoch(filing_date), id)) AS proxy FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, filing_date FROM documents_sec WHERE trim(ticker) <> '' AND upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) = 'DEF14A' AND filing_date IS NOT NULL) GROUP BY ticker""")
def newest_proxy(s, p):
    """The newest proxy statement of each ticker, of equal days the one with the least id."""
    t = table(s, p, "documents_sec").where((filing_form(F.col("filing_type")) == "DEF14A") & F.col("filing_date").isNotNull() & (F.trim("ticker") != ""))
    return t.groupBy(upper_key("ticker").alias("ticker")).agg(F.min_by("id", F.struct(-F.unix_date("filing_date"), "id")).alias("proxy"))


@query("""SELECT v.vec_id, CASE WHEN d.doc_id IS NOT NULL THEN -1 ELSE v.label END AS label, len(v.embedding)::bigint AS width FROM embeddings v LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'de') d ON d.doc_id = v.vec_id""")
def vector_upsert(s, p):
    """The table of vectors after those of the documents in German were written again with another label."""
    v = table(s, p, "embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("width"))
    german = table(s, p, "documents").where("lang = 'de'").select(F.col("doc_id").alias("vec_id")).distinct()
    return upsert(v, v.join(german, "vec_id").select("vec_id", F.lit(-1).alias("label"), "width"), ["vec_id"])


_DIM_LIST = ", ".join(f"'{x}'" for x in L.DIMENSIONS)


@query(f"""SELECT k.id AS assessment_id, dims.dimension, dims.place, coalesce(avg(s.score::double), 50) AS score FROM (SELECT DISTINCT lower(trim(id)) AS id FROM assessments) k CROSS JOIN (SELECT unnest([{_DIM_LIST}]) AS dimension, unnest(range(1, 8))::bigint AS place) dims
LEFT JOIN (SELECT DISTINCT id, lower(trim(assessment_id)) AS a, lower(dimension) AS dimension, score FROM dimension_scores) s ON s.a = k.id AND s.dimension = dims.dimension GROUP BY ALL""")
def assessment_rows(s, p):
    """Seven rows of every assessment, one a dimension, 50 where it was not scored; no two are scored together."""
    a = table(s, p, "assessments").select(text_key("id").alias("assessment_id")).distinct()
    rows = a.select("assessment_id", F.posexplode(F.array(*[F.lit(x) for x in L.DIMENSIONS])).alias("i", "dimension"))
    x = table(s, p, "dimension_scores").select("id", text_key("assessment_id").alias("assessment_id"), F.lower("dimension").alias("dimension"), d("score").alias("x")).distinct()
    means = x.groupBy("assessment_id", "dimension").agg(F.avg("x").alias("x"))
    return rows.join(means, ["assessment_id", "dimension"], "left").select("assessment_id", "dimension", (F.col("i") + 1).cast("bigint").alias("place"), F.coalesce("x", F.lit(50.0)).alias("score"))


@query(f"""WITH g AS (SELECT ticker, dimension, least(greatest(floor(score / 20) + 1, 1), 5)::bigint AS level, round((80 - score)::decimal(38, 9), 1)::double AS gap FROM ({_MAPPED})), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY gap DESC, dimension) AS place FROM g)
SELECT ticker, string_agg(CASE WHEN place <= 3 THEN dimension END, ',' ORDER BY place) AS gaps, count(CASE WHEN gap > 20 THEN 1 END) AS high, count(CASE WHEN level >= 4 THEN 1 END) AS strengths, round(avg(gap), 4) AS mean_gap FROM r GROUP BY ticker""")
def gap_plan(s, p):
    """The three dimensions of a ticker furthest below 80, how many are far below, and how many are strengths."""
    gap = F.round(F.round(80 - F.col("score"), 9), 1)
    level = F.least(F.greatest(F.floor(F.col("score") / 20) + 1, F.lit(1)), F.lit(5))
    g = _dimensions(s, p).select("ticker", "dimension", level.alias("level"), gap.alias("gap"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("gap"), "dimension"))  # seven rows a ticker
    first = F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "dimension")))), lambda x: x["dimension"])
    return g.withColumn("place", place).groupBy("ticker").agg(F.array_join(first, ",").alias("gaps"), F.count_if(F.col("gap") > 20).alias("high"), F.count_if(F.col("level") >= 4).alias("strengths"), F.round(F.avg("gap"), 4).alias("mean_gap"))
