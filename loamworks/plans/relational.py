"""Joins, aggregates, windows, sorts, set operations and changes over the evidence tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions.keys import text_key, upper_key
from loamworks.functions.numeric import level, noisy_or
from loamworks.functions.text import filing_form, shortened
from loamworks.operators.changes import delete_keys, insert_absent, patch, soft_delete, upsert, with_defaults
from loamworks.operators.latest import latest_batch, latest_per_key, once, repeats, trend
from loamworks.operators.ranking import position_in_group, running_budget, top_mean
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


def d(c):
    return F.col(c).cast("double")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("SELECT id, filing_type, strftime(filing_date, '%Y-%m-%d') AS filing_date, status FROM (SELECT DISTINCT * FROM documents_sec) WHERE id = (SELECT min(id) FROM documents_sec)")
def point_lookup(s, p):
    t = table(s, p, "documents_sec")
    return once(t.join(F.broadcast(t.agg(F.min("id").alias("id"))), "id", "left_semi")).select("id", "filing_type", day("filing_date").alias("filing_date"), "status")


@query("""SELECT id, upper(trim(ticker)) AS ticker, strftime(filing_date, '%Y-%m-%d') AS filing_date FROM (SELECT DISTINCT * FROM documents_sec)
WHERE upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) IN ('10K', '10Q') AND word_count >= 500 ORDER BY filing_date DESC NULLS LAST, id LIMIT 20 OFFSET 10""")
def filing_page(s, p):
    t = table(s, p, "documents_sec").where(filing_form(F.col("filing_type")).isin("10K", "10Q") & (F.col("word_count") >= 500)).select("id", upper_key("ticker").alias("ticker"), "filing_date").distinct()
    return t.orderBy(F.desc_nulls_last("filing_date"), "id").offset(10).limit(20).select("id", "ticker", day("filing_date").alias("filing_date"))


@query("SELECT section, count(*) AS n FROM (SELECT DISTINCT id, section FROM document_chunks_sec) WHERE section IS NOT NULL AND section NOT IN ('Unknown', 'Intro') GROUP BY section")
def section_counts(s, p):
    return table(s, p, "document_chunks_sec").select("id", "section").distinct().where("section is not null and section not in ('Unknown', 'Intro')").groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, local_path FROM documents_sec WHERE (s3_key IS NULL OR s3_key = '') AND local_path IS NOT NULL")
def not_uploaded(s, p):
    return table(s, p, "documents_sec").where("(s3_key is null or s3_key = '') and local_path is not null").select("id", "local_path").distinct()


@query("""SELECT status, count(*) AS n, count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS n_errors, count(CASE WHEN lower(status) IN ('chunked', 'indexed') THEN 1 END) AS n_done
FROM (SELECT DISTINCT id, status, error_message FROM documents_sec) GROUP BY status""")
def status_counts(s, p):
    t = table(s, p, "documents_sec").select("id", "status", "error_message").distinct()
    return t.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("error_message").isNotNull()).alias("n_errors"), F.count_if(F.lower("status").isin("chunked", "indexed")).alias("n_done"))


@query("""SELECT user_id, event_type, round(avg(least(value, 100)), 6) AS avg_score, count(*) AS n, CASE WHEN count(*) >= 10 THEN 0.88 ELSE 0.8 END::double AS confidence
FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type""")
def signal_category_avg(s, p):
    t = table(s, p, "events").where("event_type <> 'error'")
    return t.groupBy("user_id", "event_type").agg(F.round(F.avg(F.least("value", F.lit(100.0))), 6).alias("avg_score"), F.count("*").alias("n")).withColumn("confidence", F.when(F.col("n") >= 10, 0.88).otherwise(0.8))


@query("""SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0), 6) AS click, round(coalesce(avg(CASE WHEN event_type = 'purchase' THEN value END), 0), 6) AS purchase,
round(coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0), 6) AS view FROM events GROUP BY user_id""")
def signal_pivot(s, p):
    t = table(s, p, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.avg("value"))
    return t.select("user_id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("click", "purchase", "view")])


@query("""SELECT company_id, count(*) AS n_reviews, round(avg(rating::double), 6) AS avg_rating, max(rating)::double AS best, count(CASE WHEN is_current_employee THEN 1 END) AS n_current
FROM (SELECT DISTINCT id, company_id, rating, is_current_employee FROM glassdoor_reviews) GROUP BY company_id""")
def review_report(s, p):
    t = table(s, p, "glassdoor_reviews").select("id", "company_id", "rating", "is_current_employee").distinct()
    return t.groupBy("company_id").agg(F.count("*").alias("n_reviews"), F.round(F.avg(d("rating")), 6).alias("avg_rating"), F.max(d("rating")).alias("best"), F.count_if("is_current_employee").alias("n_current"))


@query("""WITH r AS (SELECT DISTINCT id, lower(trim(culture_signal_id)) AS k, rating FROM glassdoor_reviews), c AS (SELECT DISTINCT lower(trim(id)) AS k, upper(trim(ticker)) AS ticker FROM culture_signals)
SELECT ticker, count(*) AS n, round(avg(rating::double), 6) AS avg_rating FROM r LEFT JOIN c ON r.k = c.k GROUP BY ticker""")
def reviews_by_signal(s, p):
    r = table(s, p, "glassdoor_reviews").select("id", F.lower(F.trim("culture_signal_id")).alias("k"), "rating").distinct()
    c = table(s, p, "culture_signals").select(F.lower(F.trim("id")).alias("k"), F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return r.join(c, "k", "left").groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg(d("rating")), 6).alias("avg_rating"))


@query("""SELECT id FROM (SELECT DISTINCT lower(trim(id)) AS id FROM documents_sec) WHERE id NOT IN (SELECT lower(trim(document_id)) FROM document_chunks_sec WHERE document_id IS NOT NULL AND section = 'Item 1A')""")
def filings_without_risks(s, p):
    t, c = table(s, p, "documents_sec"), table(s, p, "document_chunks_sec")
    return t.select(F.lower(F.trim("id")).alias("id")).distinct().join(c.where("section = 'Item 1A'").select(F.lower(F.trim("document_id")).alias("id")), "id", "left_anti")


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT lower(trim(id)) AS id FROM documents_sec) WHERE id IN (SELECT lower(trim(document_id)) FROM document_chunks_sec)""")
def filings_with_chunks(s, p):
    t, c = table(s, p, "documents_sec"), table(s, p, "document_chunks_sec")
    return t.select(F.lower(F.trim("id")).alias("id")).distinct().join(c.select(F.lower(F.trim("document_id")).alias("id")), "id", "left_semi").agg(F.count("*").alias("n"))


_EVIDENCE = """
SELECT DISTINCT c.id AS evidence_id, 'sec_filing' AS source_type, upper(trim(f.ticker)) AS ticker, CASE WHEN length(c.content) > 200 THEN left(c.content, 200) || '…' ELSE c.content END AS content, 0.85::double AS confidence,
  year(f.filing_date)::varchar AS fiscal_year, f.source_url AS source_url, 1 AS source_ord
FROM document_chunks_sec c JOIN (SELECT DISTINCT lower(trim(id)) AS id, ticker, filing_date, source_url FROM documents_sec) f ON lower(trim(c.document_id)) = f.id WHERE c.section IS NOT NULL
UNION ALL
SELECT DISTINCT r.id, 'employee_review', upper(trim(s.ticker)), CASE WHEN length(concat_ws(' ', r.title, r.pros, r.cons)) > 200 THEN left(concat_ws(' ', r.title, r.pros, r.cons), 200) || '…' ELSE concat_ws(' ', r.title, r.pros, r.cons) END,
  s.confidence::double, year(r.review_date)::varchar, NULL, 2
FROM glassdoor_reviews r JOIN (SELECT DISTINCT lower(trim(id)) AS id, ticker, confidence FROM culture_signals) s ON lower(trim(r.culture_signal_id)) = s.id WHERE s.confidence >= 0.5
UNION ALL
SELECT DISTINCT b.id, 'board_composition', upper(trim(b.ticker)), CASE WHEN length(b.evidence) > 200 THEN left(b.evidence, 200) || '…' ELSE b.evidence END, b.confidence::double, year(b.created_at)::varchar, NULL, 3
FROM board_governance_signals b WHERE b.confidence >= 0.5
"""


def evidence(s, p):
    """Filings, reviews and board signals in one shape of evidence."""
    key = lambda c: F.lower(F.trim(c))
    c = table(s, p, "document_chunks_sec").where("section is not null").select(F.col("id").alias("evidence_id"), key("document_id").alias("k"), shortened(F.col("content"), 200).alias("content"))
    f = table(s, p, "documents_sec").select(key("id").alias("k"), "ticker", "filing_date", "source_url").distinct()
    filings = c.join(f, "k").select("evidence_id", F.lit("sec_filing").alias("source_type"), F.upper(F.trim("ticker")).alias("ticker"), "content", F.lit(0.85).alias("confidence"), F.year("filing_date").cast("string").alias("fiscal_year"), "source_url", F.lit(1).alias("source_ord"))
    r = table(s, p, "glassdoor_reviews").select(F.col("id").alias("evidence_id"), key("culture_signal_id").alias("k"), shortened(F.concat_ws(" ", "title", "pros", "cons"), 200).alias("content"), "review_date")
    g = table(s, p, "culture_signals").select(key("id").alias("k"), "ticker", "confidence").distinct().where("confidence >= 0.5")
    nothing = F.lit(None).cast("string").alias("source_url")
    reviews = r.join(g, "k").select("evidence_id", F.lit("employee_review").alias("source_type"), F.upper(F.trim("ticker")).alias("ticker"), "content", d("confidence").alias("confidence"), F.year("review_date").cast("string").alias("fiscal_year"), nothing, F.lit(2).alias("source_ord"))
    boards = table(s, p, "board_governance_signals").where("confidence >= 0.5").select(F.col("id").alias("evidence_id"), F.lit("board_composition").alias("source_type"), F.upper(F.trim("ticker")).alias("ticker"), shortened(F.col("evidence"), 200).alias("content"), d("confidence").alias("confidence"), F.year("created_at").cast("string").alias("fiscal_year"), nothing, F.lit(3).alias("source_ord"))
    return filings.distinct().unionByName(reviews.distinct()).unionByName(boards.distinct())


@query(_EVIDENCE)
def evidence_union(s, p):
    return evidence(s, p)


@query(f"SELECT source_type, fiscal_year, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM ({_EVIDENCE}) GROUP BY ROLLUP (source_type, fiscal_year)")
def evidence_rollup(s, p):
    return evidence(s, p).rollup("source_type", "fiscal_year").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query("""SELECT ticker, id, overall_score::double AS overall_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC NULLS LAST, id) AS r
FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, overall_score, created_at FROM culture_signals WHERE trim(ticker) <> '')) WHERE r = 1""")
def latest_culture(s, p):
    t = table(s, p, "culture_signals").where("trim(ticker) <> ''").select("id", upper_key("ticker").alias("ticker"), "overall_score", "created_at").distinct()
    return latest_per_key(t, ["ticker"], [F.desc_nulls_last("created_at"), F.col("id")]).select("ticker", "id", d("overall_score").alias("overall_score"))


@query("""WITH n AS (SELECT *, max(ts::date) OVER (PARTITION BY user_id, event_type) AS newest FROM events), l AS (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS last FROM n WHERE ts::date = newest)
SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM l WHERE epoch_us(last) - epoch_us(ts) <= 2700000000""")
def newest_batch(s, p):
    t = latest_batch(table(s, p, "events"), ["user_id", "event_type"], F.to_date("ts"), "ts", 45)
    return t.select("user_id", "event_type", "event_id", stamp("ts").alias("at"))


_DATED = "(SELECT company_id, assessment_date, avg(v_r_score::double) AS score FROM (SELECT DISTINCT id, company_id, assessment_date, v_r_score FROM assessments) WHERE v_r_score IS NOT NULL AND assessment_date <= DATE '2025-01-01' GROUP BY ALL)"


@query(f"""WITH g AS (SELECT company_id, count(*) AS snapshots, arg_min(score, assessment_date) AS entry_score, arg_max(score, assessment_date) AS current_score,
  arg_max(score, assessment_date) FILTER (WHERE date_diff('day', assessment_date, DATE '2025-01-01') >= 30) AS s30, arg_max(score, assessment_date) FILTER (WHERE date_diff('day', assessment_date, DATE '2025-01-01') >= 90) AS s90 FROM {_DATED} GROUP BY company_id)
SELECT company_id, snapshots, round(entry_score, 6) AS entry_score, round(current_score, 6) AS current_score, round(current_score - entry_score, 6) AS delta, round(current_score - s30, 6) AS delta_30d, round(current_score - s90, 6) AS delta_90d,
  CASE WHEN current_score - entry_score > 5 THEN 'improving' WHEN current_score - entry_score < -5 THEN 'declining' ELSE 'stable' END AS direction FROM g""")
def assessment_trend(s, p):
    t = table(s, p, "assessments").select("id", "company_id", "assessment_date", "v_r_score").distinct().where("v_r_score is not null")
    dated = t.groupBy("company_id", "assessment_date").agg(F.avg(d("v_r_score")).alias("score"))
    out = trend(dated, "company_id", "assessment_date", "score", F.lit("2025-01-01").cast("date"))
    return out.select("company_id", "snapshots", *[F.round(c, 6).alias(c) for c in ("entry_score", "current_score", "delta", "delta_30d", "delta_90d")], "direction")


@query("""SELECT c_custkey, r_name AS sector, round(row_number() OVER (PARTITION BY r_name ORDER BY c_acctbal, c_custkey) / count(*) OVER (PARTITION BY r_name), 6) AS pct
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def sector_percentile(s, p):
    n, r = table(s, p, "nation"), table(s, p, "region")
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("sector"))  # one row a nation
    c = table(s, p, "customer")
    return position_in_group(c.join(F.broadcast(places), c.c_nationkey == places.n_nationkey), "sector", "c_acctbal", "c_custkey").select("c_custkey", "sector", F.round("pct", 6).alias("pct"))


@query("""WITH l AS (SELECT upper(trim(ticker)) AS ticker, max(governance_score)::double AS governance FROM board_governance_signals WHERE trim(ticker) <> '' GROUP BY 1), c AS (SELECT upper(trim(ticker)) AS ticker, max(overall_score)::double AS culture FROM culture_signals WHERE trim(ticker) <> '' GROUP BY 1)
SELECT row_number() OVER (ORDER BY governance DESC NULLS LAST, l.ticker) AS place, l.ticker, governance, culture FROM l LEFT JOIN c USING (ticker) ORDER BY 1 LIMIT 100""")
def leaderboard(s, p):
    named = lambda t, c, to: table(s, p, t).where("trim(ticker) <> ''").groupBy(upper_key("ticker").alias("ticker")).agg(F.max(d(c)).alias(to))
    t = named("board_governance_signals", "governance_score", "governance").join(named("culture_signals", "overall_score", "culture"), "ticker", "left")
    order = [F.desc_nulls_last("governance"), F.col("ticker")]
    return t.orderBy(*order).limit(100).select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"), "ticker", "governance", "culture")  # at most 100 rows


@query("""SELECT id, ticker, form FROM (SELECT id, ticker, form, row_number() OVER (PARTITION BY ticker, form, content_hash ORDER BY created_at NULLS LAST, id) AS r
FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) AS form, content_hash, created_at FROM documents_sec WHERE content_hash IS NOT NULL AND trim(ticker) <> '' AND filing_type IS NOT NULL)) WHERE r > 1""")
def filings_filed_again(s, p):
    t = table(s, p, "documents_sec").where("content_hash is not null").select("id", upper_key("ticker").alias("ticker"), filing_form(F.col("filing_type")).alias("form"), "content_hash", "created_at").distinct()
    return repeats(t.where("ticker is not null and form is not null"), ["ticker", "form", "content_hash"], ["created_at", "id"]).select("id", "ticker", "form")


@query("""SELECT c_custkey, coalesce(n.n_nationkey, (SELECT min(n_nationkey) FROM nation))::int AS nation FROM customer LEFT JOIN nation n ON c_nationkey = n.n_nationkey AND n.n_regionkey <> 0""")
def nation_or_first(s, p):
    n, c = table(s, p, "nation"), table(s, p, "customer")
    joined = c.join(F.broadcast(n.where("n_regionkey <> 0")), c.c_nationkey == n.n_nationkey, "left").join(F.broadcast(n.agg(F.min("n_nationkey").alias("first"))))
    return joined.select("c_custkey", F.coalesce("n_nationkey", "first").alias("nation"))


_BASE = "(SELECT company_id, count(*) AS n, max(rating)::double AS best FROM (SELECT DISTINCT id, company_id, rating, review_date FROM glassdoor_reviews) WHERE review_date < DATE '2023-01-01' GROUP BY company_id)"
_NEW = "(SELECT company_id, count(*) AS n, max(rating)::double AS best FROM (SELECT DISTINCT id, company_id, rating, review_date FROM glassdoor_reviews) WHERE review_date >= DATE '2024-06-01' GROUP BY company_id)"


def _summaries(s, p):
    t = table(s, p, "glassdoor_reviews").select("id", "company_id", "rating", "review_date").distinct()
    agg = lambda x: x.groupBy("company_id").agg(F.count("*").alias("n"), F.max(d("rating")).alias("best"))
    return agg(t.where("review_date < date'2023-01-01'")), agg(t.where("review_date >= date'2024-06-01'"))


@query(f"SELECT * FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM {_NEW} u WHERE u.company_id = b.company_id) UNION ALL SELECT * FROM {_NEW}")
def summary_upsert(s, p):
    return upsert(*_summaries(s, p), ["company_id"])


@query(f"SELECT b.company_id, coalesce(u.n, b.n) AS n, b.best FROM {_BASE} b LEFT JOIN {_NEW} u ON u.company_id = b.company_id")
def summary_patch(s, p):
    return patch(*_summaries(s, p), "company_id", ["n"])


@query(f"SELECT coalesce(b.company_id, u.company_id) AS company_id, coalesce(b.n, 0) + coalesce(u.n, 0) AS n, greatest(b.best, u.best) AS best FROM {_BASE} b FULL OUTER JOIN {_NEW} u ON u.company_id = b.company_id")
def summary_merge_counts(s, p):
    b, u = _summaries(s, p)
    j = b.join(u.withColumnsRenamed({"n": "m", "best": "top"}), "company_id", "full_outer")
    return j.select("company_id", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("best", "top").alias("best"))


@query("""SELECT DISTINCT id, status, (lower(status) IN ('failed', 'error')) IS TRUE AS is_deleted FROM documents_sec""")
def soft_deleted_filings(s, p):
    return soft_delete(table(s, p, "documents_sec").select("id", "status").distinct(), F.lower("status").isin("failed", "error"))


@query("""SELECT a.id, a.v_r_score::double AS score FROM (SELECT DISTINCT id, v_r_score FROM assessments) a WHERE lower(trim(a.id)) NOT IN (SELECT lower(trim(record_id)) FROM deleted_records WHERE table_name = 'assessments' AND record_id IS NOT NULL)""")
def assessments_kept(s, p):
    t = table(s, p, "assessments").select("id", text_key("id").alias("k"), d("v_r_score").alias("score")).distinct()
    gone = table(s, p, "deleted_records").where("table_name = 'assessments'").select(text_key("record_id").alias("k")).where("k is not null")
    return delete_keys(t, gone, ["k"]).select("id", "score")


@query("""WITH b AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, company_id FROM culture_signals WHERE trim(ticker) <> ''), n AS (SELECT upper(trim(ticker)) AS ticker, min(company_id) AS company_id FROM documents_sec WHERE trim(ticker) <> '' GROUP BY 1)
SELECT ticker, company_id FROM b UNION ALL SELECT ticker, company_id FROM n WHERE ticker NOT IN (SELECT ticker FROM b)""")
def companies_known(s, p):
    of = lambda t: table(s, p, t).where("trim(ticker) <> ''").select(upper_key("ticker").alias("ticker"), "company_id").distinct()
    return insert_absent(of("culture_signals"), of("documents_sec"), ["ticker"])


@query("""SELECT DISTINCT id, coalesce(score::double, 0.0) AS score, coalesce(confidence::double, 0.8) AS confidence, coalesce(evidence_count, 0)::bigint AS evidence_count FROM dimension_scores""")
def scores_with_defaults(s, p):
    t = table(s, p, "dimension_scores").select("id", d("score").alias("score"), d("confidence").alias("confidence"), F.col("evidence_count").cast("bigint").alias("evidence_count")).distinct()
    return with_defaults(t, {"score": 0.0, "confidence": 0.8, "evidence_count": 0})


@query("""SELECT company_id, round(avg(r), 6) AS top_mean, count(*) AS n FROM (SELECT company_id, rating::double AS r, row_number() OVER (PARTITION BY company_id ORDER BY rating DESC) AS k FROM (SELECT DISTINCT id, company_id, rating FROM glassdoor_reviews) WHERE rating IS NOT NULL) WHERE k <= 3 GROUP BY company_id""")
def top3_rating(s, p):
    t = table(s, p, "glassdoor_reviews").select("id", "company_id", d("rating").alias("r")).distinct()
    return top_mean(t, ["company_id"], "r").withColumn("top_mean", F.round("top_mean", 6))


@query("""SELECT lower(dimension) AS dimension, count(*) AS n, round(sum(score::double * weight::double) / sum(CASE WHEN score IS NOT NULL THEN weight::double END), 6) AS weighted, round(avg(confidence::double), 6) AS confidence, count(DISTINCT assessment_id) AS assessments
FROM (SELECT DISTINCT * FROM dimension_scores) GROUP BY 1""")
def dimension_rollup(s, p):
    t = table(s, p, "dimension_scores").select("id", "dimension", "assessment_id", "confidence", d("score").alias("sc"), d("weight").alias("w")).distinct()
    weight = F.sum(F.when(F.col("sc").isNotNull(), F.col("w")))
    return t.groupBy(F.lower("dimension").alias("dimension")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("sc") * F.col("w")) / weight, 6).alias("weighted"), F.round(F.avg(d("confidence")), 6).alias("confidence"), F.countDistinct("assessment_id").alias("assessments"))


@query("""SELECT lower(trim(assessment_id)) AS assessment, round(1 - product(1 - 0.2 * confidence::double), 9) AS noisy_or, string_agg(DISTINCT lower(dimension), ',' ORDER BY lower(dimension)) AS dimensions
FROM (SELECT DISTINCT id, assessment_id, confidence, dimension FROM dimension_scores) WHERE trim(assessment_id) <> '' AND confidence IS NOT NULL AND dimension IS NOT NULL GROUP BY 1""")
def assessment_confidence(s, p):
    t = table(s, p, "dimension_scores").select("id", "assessment_id", "confidence", "dimension").distinct().where("trim(assessment_id) <> '' and confidence is not null and dimension is not null")
    return t.groupBy(F.lower(F.trim("assessment_id")).alias("assessment")).agg(F.round(noisy_or(0.2 * d("confidence")), 9).alias("noisy_or"), F.array_join(F.sort_array(F.collect_set(F.lower("dimension"))), ",").alias("dimensions"))


@query("""SELECT a.id, least(greatest(floor(v / 20) + 1, 1), 5)::bigint AS level, CASE WHEN v >= 75 THEN 1 WHEN v >= 65 THEN 2 WHEN v >= 55 THEN 3 ELSE 4 END::bigint AS quartile FROM (SELECT DISTINCT id, v_r_score::double AS v FROM assessments WHERE v_r_score IS NOT NULL) a""")
def score_bands(s, p):
    v = F.col("v")
    quartile = F.when(v >= 75, 1).when(v >= 65, 2).when(v >= 55, 3).otherwise(4).cast("bigint")
    return table(s, p, "assessments").where("v_r_score is not null").select("id", d("v_r_score").alias("v")).distinct().select("id", level(v).alias("level"), quartile.alias("quartile"))


_SECTOR = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH e AS (SELECT r_name AS fund, n_name AS sector, sum(l_extendedprice) AS ev {_SECTOR} GROUP BY ALL), t AS (SELECT *, sum(ev) OVER (PARTITION BY fund) AS total FROM e)
SELECT fund, round(sum((ev / total) * (ev / total)), 6) AS hhi, count(*) AS sectors, round(max(ev / total), 6) AS largest FROM t GROUP BY fund""")
def fund_concentration(s, p):
    li, su, n, r = (table(s, p, t) for t in ("lineitem", "supplier", "nation", "region"))
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("fund"), F.col("n_name").alias("sector"))
    by_supplier = li.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("ev"))
    e = by_supplier.join(su, by_supplier.l_suppkey == su.s_suppkey).join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("fund", "sector").agg(F.sum("ev").alias("ev"))
    share = F.col("ev") / F.sum("ev").over(Window.partitionBy("fund"))
    return e.withColumn("x", share).groupBy("fund").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("hhi"), F.count("*").alias("sectors"), F.round(F.max("x"), 6).alias("largest"))


@query(f"""SELECT r_name AS fund, round(sum(s_acctbal * ev) / sum(ev), 4) AS weighted_score, round(avg(s_acctbal), 4) AS simple_score, count(CASE WHEN s_acctbal >= 7000 THEN 1 END) AS leaders, count(CASE WHEN s_acctbal < 1000 THEN 1 END) AS laggards
FROM (SELECT l_suppkey, sum(l_extendedprice) AS ev FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def fund_score(s, p):
    li, su, n, r = (table(s, p, t) for t in ("lineitem", "supplier", "nation", "region"))
    ev = li.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("ev"))
    t = ev.join(su, ev.l_suppkey == su.s_suppkey).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.groupBy(F.col("r_name").alias("fund")).agg(F.round(F.sum(F.col("s_acctbal") * F.col("ev")) / F.sum("ev"), 4).alias("weighted_score"), F.round(F.avg("s_acctbal"), 4).alias("simple_score"), F.count_if(F.col("s_acctbal") >= 7000).alias("leaders"), F.count_if(F.col("s_acctbal") < 1000).alias("laggards"))


@query("""SELECT r_name AS sector, count(*) AS n, round(avg(c_acctbal), 4) AS avg_score, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def sector_rollup(s, p):
    c, n, r = (table(s, p, t) for t in ("customer", "nation", "region"))
    t = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return t.groupBy(F.col("r_name").alias("sector")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_score"), F.max("c_acctbal").alias("best"))


@query("""SELECT event_id, round(spent, 4) AS spent, round(spent, 4) <= 100 AS within FROM (SELECT event_id, sum(value) OVER (PARTITION BY ts::date, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events WHERE event_type = 'purchase')""")
def daily_spending(s, p):
    t = table(s, p, "events").where("event_type = 'purchase'")
    return running_budget(t, F.concat_ws("|", F.to_date("ts"), "user_id"), ["ts", "event_id"], "value", 100.0).select("event_id", F.round("spent", 4).alias("spent"), (F.round("spent", 4) <= 100).alias("within"))


@query("""SELECT event_type, count(*) AS n, approx FROM (SELECT event_type, user_id, (SELECT count(DISTINCT event_type) FROM events) AS approx FROM events) GROUP BY event_type, approx HAVING count(*) > 10""")
def busy_types(s, p):
    t = table(s, p, "events")
    return t.groupBy("event_type").agg(F.count("*").alias("n")).where("n > 10").join(F.broadcast(t.agg(F.approx_count_distinct("event_type").alias("approx"))))  # one row


@query("SELECT name, n FROM (SELECT trim(name) AS name, count(DISTINCT id) AS n FROM board_members WHERE trim(name) <> '' GROUP BY 1) ORDER BY n DESC, name LIMIT 10")
def commonest_names(s, p):
    return table(s, p, "board_members").where("trim(name) <> ''").groupBy(F.trim("name").alias("name")).agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("""SELECT source, count(CASE WHEN doc_type = 'filing' THEN 1 END) AS filing, count(CASE WHEN doc_type = 'ic_memo' THEN 1 END) AS ic_memo, count(CASE WHEN doc_type = 'job_post' THEN 1 END) AS job_post, count(DISTINCT doc_type) AS types FROM documents GROUP BY source""")
def source_matrix(s, p):
    of = lambda x: F.count_if(F.col("doc_type") == x).alias(x)
    return table(s, p, "documents").groupBy("source").agg(of("filing"), of("ic_memo"), of("job_post"), F.countDistinct("doc_type").alias("types"))


@query("""WITH c AS (SELECT DISTINCT upper(trim(f.ticker)) AS ticker, c.section FROM document_chunks_sec c JOIN documents_sec f ON lower(trim(c.document_id)) = lower(trim(f.id)) WHERE trim(f.ticker) <> '' AND c.section IS NOT NULL),
r AS (SELECT unnest(['Item 1', 'Item 1A', 'Item 7', 'Item 7A', 'CD&A']) AS section) SELECT t.ticker, r.section AS missing FROM (SELECT DISTINCT ticker FROM c) t, r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ticker = t.ticker AND c.section = r.section)""")
def missing_sections(s, p):
    c = table(s, p, "document_chunks_sec").where("section is not null").select(text_key("document_id").alias("k"), "section").distinct()
    f = table(s, p, "documents_sec").where("trim(ticker) <> ''").select(text_key("id").alias("k"), upper_key("ticker").alias("ticker")).distinct()
    have = c.join(f, "k").groupBy("ticker").agg(F.collect_set("section").alias("have"))  # a bounded vocabulary
    required = F.array(*[F.lit(x) for x in ("Item 1", "Item 1A", "Item 7", "Item 7A", "CD&A")])
    return have.select("ticker", F.explode(F.array_except(required, F.col("have"))).alias("missing"))
