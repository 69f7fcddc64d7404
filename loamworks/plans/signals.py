"""Queries over signals that evidence becomes: postings, pages, patents, leadership, their composite and the eleven sources of the score."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions import lexicons as L
from loamworks.functions import signal_words as S
from loamworks.functions.keys import text_key, upper_key
from loamworks.functions.text import committees, form_like
from loamworks.operators import signals as sig
from loamworks.operators.evidence import concentration, to_dimensions
from loamworks.operators.latest import latest_per_key
from loamworks.operators.ranking import position_in_group
from loamworks.operators.scoring import chain, dimension_name
from loamworks.plans.relational import d
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


def _n(text: str, words) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))
    return f"len(list_filter([{words}], lambda w: contains({text}, w)))"


def _families(text: str, families, weights) -> str:
    return " + ".join(["0.0::double"] + [f"least({_n(text, families[f])}, {n}) * {w}::double" for f, (n, w) in weights.items()])


_ALL = lambda families: [w for words in families.values() for w in words]
_TITLED = "SELECT doc_id, upper(trim(ticker)) AS ticker, lower(trim(split_part(text, chr(10), 1))) AS title, lower(text) AS t FROM documents WHERE text IS NOT NULL"
_JOBS = f"""SELECT doc_id, ticker, generic, skills, round(CASE WHEN generic THEN least(skills / 10, 1.0::double) * 0.25::double ELSE least(base + boost, 1.0::double) END, 3) AS relevance FROM (SELECT *, CASE WHEN hw THEN greatest(b, 0.30::double) ELSE b END AS boost FROM (
SELECT doc_id, ticker, {_n("title", S.GENERIC_TITLES)} > 0 AND {_n("title", S.AI_TITLES)} = 0 AS generic, {_n("t", _ALL(S.SKILLS))}::bigint AS skills, {_families("t", S.SKILLS, S.SKILL_WEIGHTS)} AS base, {_n("title", S.HARDWARE_TITLES)} > 0 AS hw,
(CASE WHEN {_n("title", S.AI_TITLES)} >= 2 THEN 0.40 WHEN {_n("title", S.AI_TITLES)} = 1 THEN 0.25 ELSE 0.0 END)::double AS b FROM ({_TITLED} AND doc_type = 'job_post')))"""
_SCORE = "least(100, greatest(1, round_even(relevance * 100, 0)))::bigint"


def _documents(s, p, doc_type):
    t = table(s, p, "documents").where((F.col("doc_type") == doc_type) & F.col("text").isNotNull())
    return t.select("doc_id", upper_key("ticker").alias("ticker"), F.lower(F.trim(F.substring_index("text", "\n", 1))).alias("title"), F.lower("text").alias("t"))


def _jobs(s, p):
    title, t = F.col("title"), F.col("t")
    return _documents(s, p, "job_post").select("doc_id", "ticker", sig.generic_title(title).alias("generic"), sig.skill_count(t).cast("bigint").alias("skills"), sig.job_relevance(title, t).alias("relevance"))


@query(f"SELECT doc_id, generic, skills, relevance, {_SCORE} AS score FROM ({_JOBS})")
def job_relevance(s, p):
    return _jobs(s, p).select("doc_id", "generic", "skills", "relevance", sig.signal_score(F.col("relevance")).alias("score"))


_PAGES = f"""SELECT doc_id, ticker, {_n("t", _ALL(S.TECHNOLOGIES))}::bigint AS mentions, CASE WHEN {_n("t", _ALL(S.TECHNOLOGIES))} = 0 THEN 0.0::double
ELSE least({_families("t", S.TECHNOLOGIES, S.TECHNOLOGY_WEIGHTS)} + (CASE WHEN {_n("title", S.TECHNOLOGY_TITLES)} > 0 THEN 0.10 ELSE 0.0 END)::double, 1.0::double) END AS adoption FROM ({_TITLED} AND doc_type = 'press_release')"""


def _pages(s, p):
    return _documents(s, p, "press_release").select("doc_id", "ticker", sig.tech_mentions(F.col("t")).cast("bigint").alias("mentions"), sig.tech_adoption(F.col("title"), F.col("t")).alias("adoption"))


@query(f"SELECT doc_id, mentions, round(adoption, 6) AS adoption FROM ({_PAGES})")
def tech_adoption(s, p):
    return _pages(s, p).select("doc_id", "mentions", F.round("adoption", 6).alias("adoption"))


_FLAGS = ", ".join(f"{_n('t', words)} > 0 AS {c}" for c, words in S.PATENT_CATEGORIES.items())
_NONE = " AND ".join(f"NOT {c}" for c in S.PATENT_CATEGORIES)
_PATENTS = f"""SELECT ticker, n, recent, categories, (least(n * 5, 50) + least(recent * 2, 20) + least(categories * 10, 30))::bigint AS score FROM (SELECT ticker, count(*) AS n, count(CASE WHEN created_at::date >= DATE '2024-06-30' THEN 1 END) AS recent,
(bool_or(ml_core OR ({_NONE}))::int + {" + ".join(f"bool_or({c})::int" for c in S.PATENT_CATEGORIES if c != "ml_core")})::bigint AS categories FROM (SELECT upper(trim(ticker)) AS ticker, created_at, {_FLAGS} FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents WHERE doc_type = 'ic_memo' AND trim(ticker) <> '')) GROUP BY ticker)"""


def _patents(s, p):
    t = table(s, p, "documents").where("doc_type = 'ic_memo' and trim(ticker) <> ''").select(upper_key("ticker").alias("ticker"), "text", F.to_date("created_at").alias("filed"))
    return sig.patent_activity(t, ["ticker"], F.lit("2025-06-30").cast("date"))


@query(f"SELECT *, CASE WHEN score >= 80 THEN 'AI Innovator' WHEN score >= 60 THEN 'AI Developer' WHEN score >= 30 THEN 'AI Experimenter' ELSE 'Limited AI Innovation' END AS maturity FROM ({_PATENTS})")
def patent_activity(s, p):
    return _patents(s, p)


_TITLE_CASE = " ".join(f"WHEN regexp_matches(title, '(?i){x}') THEN {S.INDICATORS[k]}" for x, k in S.TITLE_PATTERNS)
_BIO_MAX = ", ".join(f"CASE WHEN regexp_matches(bio, '(?i){x}') THEN {S.INDICATORS[k]} ELSE 0 END" for x, k in S.BIO_PATTERNS)
_LEADERS = f"""SELECT company_id, count(*) AS n, least(sum(w * s) / sum(w), 1.0::double) AS score FROM (SELECT company_id, greatest(CASE {_TITLE_CASE} ELSE 0 END, {_BIO_MAX})::double AS s,
(CASE WHEN contains(lower(title), 'chief ai officer') OR contains(lower(title), 'cai') THEN 1.0 WHEN contains(lower(title), 'ceo') OR contains(lower(title), 'chief executive') OR contains(lower(title), 'founder') THEN 1.0 WHEN starts_with(lower(title), 'cto') OR contains(lower(title), 'chief technology') THEN 0.9
WHEN starts_with(lower(title), 'cdo') OR contains(lower(title), 'chief data') THEN 0.85 WHEN starts_with(lower(title), 'vp') OR contains(lower(title), 'vice president') THEN 0.7 ELSE 0.5 END)::double AS w
FROM (SELECT DISTINCT id, company_id, coalesce(title, '') AS title, coalesce(bio, '') AS bio FROM board_members)) GROUP BY company_id"""


def _leaders(s, p):
    return sig.leadership(table(s, p, "board_members"), ["company_id"])


@query(f"SELECT company_id, n, round(score, 6) AS score FROM ({_LEADERS})")
def leadership_scores(s, p):
    return _leaders(s, p).select("company_id", "n", F.round("score", 6).alias("score"))


_SIGNALS = f"""WITH company AS (SELECT company_id, min(upper(trim(ticker))) AS ticker FROM culture_signals WHERE trim(ticker) <> '' AND company_id IS NOT NULL GROUP BY 1), raw AS (
SELECT ticker, 'technology_hiring' AS category, count(*) AS n, round_even(round(avg({_SCORE}), 9), 0)::bigint AS score, sum(skills)::bigint AS hits, concat(count(*), ' postings') AS raw_value FROM ({_JOBS}) WHERE trim(ticker) <> '' GROUP BY ticker
UNION ALL SELECT ticker, 'innovation_activity', n, score, n, concat(n, ' AI patents') FROM ({_PATENTS})
UNION ALL SELECT ticker, 'digital_presence', count(*), round_even(round(avg(adoption) * 100, 9), 0)::bigint, sum(mentions)::bigint, CASE WHEN sum(mentions) = 0 THEN 'no pages accessible' ELSE concat(count(*), ' pages') END FROM ({_PAGES}) WHERE trim(ticker) <> '' GROUP BY ticker
UNION ALL SELECT ticker, 'leadership_signals', n, round_even(round(score * 100, 9), 0)::bigint, n, concat(n, ' leaders') FROM ({_LEADERS}) JOIN company USING (company_id))
SELECT ticker, category, n, score, raw_value, to_json({{'hits': hits, 'n': n}})::varchar AS metadata FROM raw WHERE NOT (score <= 0 AND CASE category WHEN 'innovation_activity' THEN hits = 0 OR starts_with(lower(raw_value), '0 ai patents') WHEN 'digital_presence' THEN hits = 0 OR contains(raw_value, 'scan failed') OR contains(raw_value, 'no pages accessible')
WHEN 'technology_hiring' THEN hits = 0 AND trim(raw_value) = '' WHEN 'leadership_signals' THEN hits = 0 ELSE false END)"""


def signals(s, p):
    """(ticker, category, n, score, raw_value, metadata): the four categories of signals of each ticker, without those that only state that nothing was found."""
    whole = lambda c: F.bround(F.round(c, 9)).cast("bigint")
    jobs = _jobs(s, p).where("ticker is not null").groupBy("ticker").agg(F.count("*").alias("n"), whole(F.avg(sig.signal_score(F.col("relevance")))).alias("score"), F.sum("skills").alias("hits"))
    pages = _pages(s, p).where("ticker is not null").groupBy("ticker").agg(F.count("*").alias("n"), whole(F.avg("adoption") * 100).alias("score"), F.sum("mentions").alias("hits"))
    company = table(s, p, "culture_signals").where("trim(ticker) <> '' and company_id is not null").groupBy("company_id").agg(F.min(upper_key("ticker")).alias("ticker"))
    leaders = _leaders(s, p).join(company, "company_id").select("ticker", "n", whole(F.col("score") * 100).alias("score"), F.col("n").alias("hits"))
    named = lambda t, c, raw: t.select("ticker", F.lit(c).alias("category"), "n", "score", "hits", raw.alias("raw_value"))
    told = lambda word: F.concat(F.col("n").cast("string"), F.lit(word))
    parts = [
        named(jobs, "technology_hiring", told(" postings")), named(_patents(s, p).withColumn("hits", F.col("n")), "innovation_activity", told(" AI patents")),
        named(pages, "digital_presence", F.when(F.col("hits") == 0, "no pages accessible").otherwise(told(" pages"))), named(leaders, "leadership_signals", told(" leaders")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    kept = both.where(~sig.placeholder(F.col("category"), F.col("score"), F.col("raw_value"), F.col("hits")))
    return kept.select("ticker", "category", "n", "score", "raw_value", F.to_json(F.struct("hits", "n")).alias("metadata"))


@query(_SIGNALS)
def company_signals(s, p):
    return signals(s, p)


_OF = lambda c: f"coalesce(max(CASE WHEN category = '{c}' THEN score END), 0)"
_COMPOSITE = " + ".join(f"{w}::double * {_OF(c)}" for c, w in S.COMPOSITE.items())


@query(f"""SELECT ticker, {", ".join(f"{_OF(c)} AS {c}" for c in S.COMPOSITE)}, round_even(round({_COMPOSITE}, 9), 0)::bigint AS composite, count(*) AS signal_count FROM ({_SIGNALS}) GROUP BY ticker""")
def signal_composites(s, p):
    """The four scores of each ticker and their weighted composite, rounded half to even."""
    g = signals(s, p).groupBy("ticker").agg(*[F.coalesce(F.max(F.when(F.col("category") == c, F.col("score"))), F.lit(0).cast("bigint")).alias(c) for c in S.COMPOSITE], F.count("*").alias("signal_count"))
    parts = [F.lit(w) * F.col(c) for c, w in S.COMPOSITE.items()]
    return g.withColumn("composite", F.bround(F.round(parts[0] + parts[1] + parts[2] + parts[3], 9)).cast("bigint"))


@query(f"""SELECT ticker, abs({_OF("innovation_activity")} - {_OF("technology_hiring")}) AS gap FROM ({_SIGNALS}) GROUP BY ticker ORDER BY gap DESC, ticker LIMIT 8""")
def say_do_gaps(s, p):
    """The eight tickers whose patents and postings differ most."""
    return signal_composites(s, p).select("ticker", F.abs(F.col("innovation_activity") - F.col("technology_hiring")).alias("gap")).orderBy(F.desc("gap"), "ticker").limit(8)


_BROAD = lambda k: f"CASE WHEN {k} >= 20 THEN least(95.0::double, 70 + ({k} - 20) * 1.5::double) WHEN {k} >= 10 THEN 55 + ({k} - 10) * 1.5::double WHEN {k} >= 5 THEN 40 + ({k} - 5) * 3.0::double ELSE 20 + {k} * 4.0::double END"


@query(f"SELECT doc_id, {_BROAD('k')} AS score FROM (SELECT doc_id, {_n('lower(text)', S.BROAD_TERMS)} AS k FROM documents WHERE text IS NOT NULL)")
def broad_scores(s, p):
    return table(s, p, "documents").where("text is not null").select("doc_id", sig.broad_score(F.lower("text")).alias("score"))


_ITEMS = {"Item 1": "sec_item_1", "Item 1A": "sec_item_1a", "Item 7": "sec_item_7", "Item 2": "sec_item_2", "Item 8.01": "sec_item_8_01"}
_ITEM_CASE = "CASE section " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ITEMS.items()) + " END"
_SOURCES = f"""SELECT ticker, category AS source, score::double AS score, least(0.5::double + 0.05::double * 1, 0.95::double) AS confidence FROM ({_SIGNALS})
UNION ALL SELECT ticker, source, avg(x), least(0.6::double + 0.05::double * count(*), 0.95::double) FROM (SELECT DISTINCT c.id, f.ticker, {_ITEM_CASE} AS source, {_BROAD("c.k")} AS x FROM (SELECT id, document_id, section, {_n("lower(content)", S.BROAD_TERMS)} AS k FROM document_chunks_sec WHERE content IS NOT NULL) c
  JOIN (SELECT DISTINCT lower(trim(id)) AS k, upper(trim(ticker)) AS ticker FROM documents_sec WHERE trim(ticker) <> '') f ON lower(trim(c.document_id)) = f.k) WHERE source IS NOT NULL GROUP BY ticker, source
UNION ALL SELECT ticker, 'glassdoor_reviews', coalesce(overall_score, 50)::double * 0.5::double + coalesce(avg_rating, 3)::double / 5 * 100 * 0.5::double, confidence::double FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, id) AS r FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, overall_score, avg_rating, confidence
  FROM culture_signals WHERE trim(ticker) <> '' AND confidence >= 0.3 AND review_count > 0)) WHERE r = 1
UNION ALL SELECT ticker, 'board_composition', governance_score::double, confidence::double FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC NULLS LAST, id) AS r FROM (SELECT DISTINCT id, upper(trim(ticker)) AS ticker, governance_score, confidence, created_at FROM board_governance_signals WHERE trim(ticker) <> '')) WHERE r = 1"""


def source_scores(s, p):
    """(ticker, source, score, confidence) of the eleven sources: signals, filing items, reviews and boards."""
    of_signals = signals(s, p).select("ticker", F.col("category").alias("source"), d("score").alias("score"), F.lit(0.55).alias("confidence"))
    item = F.create_map(*[F.lit(x) for pair in _ITEMS.items() for x in pair])
    c = table(s, p, "document_chunks_sec").where(F.col("content").isNotNull() & F.col("section").isin(*_ITEMS))
    c = c.select("id", text_key("document_id").alias("k"), item[F.col("section")].alias("source"), sig.broad_score(F.lower("content")).alias("x"))
    f = table(s, p, "documents_sec").where("trim(ticker) <> ''").select(text_key("id").alias("k"), upper_key("ticker").alias("ticker")).distinct()
    filings = c.join(f, "k").select("id", "ticker", "source", "x").distinct().groupBy("ticker", "source").agg(F.avg("x").alias("score"), F.least(0.6 + 0.05 * F.count("*"), F.lit(0.95)).alias("confidence"))
    r = table(s, p, "culture_signals").where("trim(ticker) <> '' and confidence >= 0.3 and review_count > 0").select("id", upper_key("ticker").alias("ticker"), "overall_score", "avg_rating", "confidence").distinct()
    blended = F.coalesce(d("overall_score"), F.lit(50.0)) * 0.5 + F.coalesce(d("avg_rating"), F.lit(3.0)) / 5 * 100 * 0.5
    reviews = latest_per_key(r, ["ticker"], [F.desc("confidence"), F.col("id")]).select("ticker", F.lit("glassdoor_reviews").alias("source"), blended.alias("score"), d("confidence").alias("confidence"))
    b = table(s, p, "board_governance_signals").where("trim(ticker) <> ''").select("id", upper_key("ticker").alias("ticker"), "governance_score", "confidence", "created_at").distinct()
    boards = latest_per_key(b, ["ticker"], [F.desc_nulls_last("created_at"), F.col("id")]).select("ticker", F.lit("board_composition").alias("source"), d("governance_score").alias("score"), d("confidence").alias("confidence"))
    return of_signals.unionByName(filings).unionByName(reviews).unionByName(boards)


def _dimensions(s, p):
    w = s.createDataFrame([(src, dim, x, rel) for src, (ws, rel) in S.EVIDENCE_WEIGHTS.items() for dim, x in ws.items()], "source string, dimension string, weight double, reliability double")
    return to_dimensions(source_scores(s, p), w, ["ticker"], list(L.DIMENSIONS))


_WEIGHT_ROWS = ", ".join(f"('{src}', '{dim}', {w}::double, {rel}::double)" for src, (ws, rel) in S.EVIDENCE_WEIGHTS.items() for dim, w in ws.items())
_DIM_ROWS = ", ".join(f"('{x}')" for x in L.DIMENSIONS)
_MAPPED = f"""WITH e AS ({_SOURCES}), w(source, dimension, weight, reliability) AS (VALUES {_WEIGHT_ROWS}), dims(dimension) AS (VALUES {_DIM_ROWS}),
g AS (SELECT ticker, dimension, sum(least(100, greatest(0, score)) * weight) / sum(weight) AS score, 1 - product(1 - coalesce(confidence, 0) * reliability) AS confidence, sum(weight) AS total_weight, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e JOIN w USING (source) WHERE score IS NOT NULL GROUP BY ALL)
SELECT t.ticker, d.dimension, coalesce(g.score, 50) AS score, coalesce(g.confidence, 0) AS confidence, coalesce(g.total_weight, 0) AS total_weight, coalesce(g.sources, '') AS sources FROM (SELECT DISTINCT ticker FROM e) t CROSS JOIN dims d LEFT JOIN g ON g.ticker = t.ticker AND g.dimension = d.dimension"""


@query(f"SELECT ticker, dimension, round(score, 6) AS score, round(confidence, 6) AS confidence, round(total_weight, 6) AS total_weight, sources FROM ({_MAPPED})")
def source_dimensions(s, p):
    """The evidence of all eleven sources on the seven dimensions."""
    return _dimensions(s, p).select("ticker", "dimension", *[F.round(c, 6).alias(c) for c in ("score", "confidence", "total_weight")], "sources")


@query(f"SELECT ticker, dimension, round(score - score * (1 - confidence) * 0.5::double, 4) AS lower, round(score + score * (1 - confidence) * 0.5::double, 4) AS upper, greatest(1, round_even(round(total_weight * 10, 6), 0))::bigint AS evidence_count, least(greatest(floor(score / 20) + 1, 1), 5)::bigint AS level FROM ({_MAPPED})")
def dimension_intervals(s, p):
    """The interval of each dimension by its confidence, a count of evidence from its weight, and its level."""
    margin = F.col("score") * (1 - F.col("confidence")) * 0.5
    level = F.least(F.greatest(F.floor(F.col("score") / 20) + 1, F.lit(1)), F.lit(5)).cast("bigint")
    count = F.greatest(F.lit(1), F.bround(F.round(F.col("total_weight") * 10, 6))).cast("bigint")
    return _dimensions(s, p).select("ticker", "dimension", F.round(F.col("score") - margin, 4).alias("lower"), F.round(F.col("score") + margin, 4).alias("upper"), count.alias("evidence_count"), level.alias("level"))


@query(f"SELECT ticker, count(CASE WHEN sources <> '' THEN 1 END) AS covered, round(100.0::double * count(CASE WHEN sources <> '' THEN 1 END) / count(*), 4) AS percent, string_agg(CASE WHEN sources = '' THEN dimension END, ',' ORDER BY dimension) AS uncovered, round(avg(confidence), 6) AS mean_confidence FROM ({_MAPPED}) GROUP BY ticker")
def evidence_coverage(s, p):
    """How many dimensions of a ticker have evidence, and which have none."""
    have = F.col("sources") != ""
    names = F.array_join(F.sort_array(F.collect_list(F.when(~have, F.col("dimension")))), ",")
    return _dimensions(s, p).groupBy("ticker").agg(F.count_if(have).alias("covered"), F.round(100.0 * F.count_if(have) / F.count("*"), 4).alias("percent"), F.nullif(names, F.lit("")).alias("uncovered"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"SELECT ticker, source, count(*) AS dimensions, round(100.0::double * count(*) / 7, 4) AS percent FROM (SELECT ticker, unnest(string_split(sources, ',')) AS source FROM ({_MAPPED}) WHERE sources <> '') GROUP BY ALL")
def source_usage(s, p):
    """How many of the seven dimensions each source of a ticker contributes to."""
    t = _dimensions(s, p).where("sources <> ''").select("ticker", F.explode(F.split("sources", ",")).alias("source"))
    return t.groupBy("ticker", "source").agg(F.count("*").alias("dimensions"), F.round(100.0 * F.count("*") / 7, 4).alias("percent"))


# There is no table of companies: an assessment's type stands for the sector of its company.
_SECTOR_OF = {"screening": "technology", "due_diligence": "financial_services", "quarterly": "manufacturing", "exit_prep": "retail"}
_SECTOR_CASE = "CASE assessment_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SECTOR_OF.items()) + " ELSE 'other' END"
_Q = lambda x: f"round(({x})::decimal(38, 9), 4)::double"
_DIMS = ", ".join(_Q(f"coalesce(avg(CASE WHEN dim = '{x}' THEN score END), 50.0)") + f" AS {x}" for x in L.DIMENSIONS)
_MEAN = " + ".join(f"{w}::double * {x}" for x, w in L.DIMENSIONS.items())
_VAR = " + ".join(f"{w}::double * ({x} - m) * ({x} - m)" for x, w in L.DIMENSIONS.items())
_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.DIMENSION_ALIASES.items())
_BY_SECTOR = lambda k, default: "CASE sector " + " ".join(f"WHEN '{x}' THEN {v[k]}" for x, v in L.SECTORS.items()) + f" ELSE {default} END::double"
_LEVEL = f"CASE WHEN {_n('t', S.SENIOR_POSTS)} > 0 THEN 'senior' WHEN {_n('t', S.MID_POSTS)} > 0 THEN 'mid' WHEN {_n('t', S.ENTRY_POSTS)} > 0 THEN 'entry' ELSE 'mid' END"
_MENTION = r"\b[A-Z][a-z]+(?:'s|\s+is|\s+was|\s+has|\s+does)\b"
_TALENT = f"""SELECT company_id, round(least(1, greatest(0, 0.4::double * senior / n + 0.3::double * least(1, 1 / (sqrt(n) + 0.1::double)) + 0.2::double * greatest(0, 1 - skills / 15) + 0.1::double * least(1, mentions / n)))::decimal(38, 9), 4)::double AS tc FROM (
SELECT company_id, count(*) AS n, count(CASE WHEN level = 'senior' THEN 1 END) AS senior, count(DISTINCT title) AS skills, sum(mentions) AS mentions FROM (SELECT company_id, job_title AS title, {_LEVEL.replace("'t'", "t")} AS level, mentions
FROM (SELECT DISTINCT id, company_id, job_title, lower(job_title) AS t, len(regexp_extract_all(concat_ws(' ', title, pros, cons, advice_to_management), '{_MENTION.replace("'", "''")}')) AS mentions FROM glassdoor_reviews WHERE job_title IS NOT NULL)) GROUP BY company_id)"""


def _talent(s, p):
    text = F.concat_ws(" ", "title", "pros", "cons", "advice_to_management")
    t = table(s, p, "glassdoor_reviews").where("job_title is not null").select("id", "company_id", F.col("job_title").alias("title"), sig.posting_level(F.col("job_title")).alias("level"), F.regexp_count(text, F.lit(_MENTION)).alias("mentions")).distinct()
    return concentration(t, "company_id", mentions="mentions").select("company_id", F.round(F.round("concentration", 9), 4).alias("tc"))


@query(_TALENT)
def talent_with_mentions(s, p):
    """Talent concentration with posting levels and how often reviews name single persons."""
    return _talent(s, p)


@query(f"""WITH a AS (SELECT DISTINCT lower(trim(id)) AS assessment, company_id, {_SECTOR_CASE} AS sector FROM assessments), tc AS ({_TALENT}), r AS (SELECT DISTINCT id, lower(trim(assessment_id)) AS assessment, CASE lower(trim(dimension)) {_ALIAS} ELSE lower(trim(dimension)) END AS dim, score::double AS score, evidence_count FROM dimension_scores WHERE trim(assessment_id) <> ''),
w AS (SELECT assessment, {_DIMS}, greatest(coalesce(sum(evidence_count), 1), 1)::double AS n FROM r GROUP BY assessment), m AS (SELECT *, {_Q(_MEAN)} AS m FROM w), v AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE {_Q(_Q(f"sqrt({_VAR})") + " / m")} END AS cv FROM m),
j AS (SELECT v.*, a.sector, coalesce(tc.tc, 0.5) AS tc FROM v JOIN a USING (assessment) LEFT JOIN tc USING (company_id)), vr AS (SELECT *, m * greatest(0, least(1, 1 - 0.25::double * cv)) * greatest(0, least(1, 1 - 0.15::double * greatest(0, tc - 0.25::double))) AS vr FROM j),
pc AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY round(vr, 6), assessment) / count(*) OVER (PARTITION BY sector) AS pct FROM vr),
po AS (SELECT *, greatest(-1, least(1, 0.6::double * greatest(-1, least(1, ({_Q('vr')} - {_BY_SECTOR(0, 50.0)}) / 50)) + 0.4::double * greatest(-1, least(1, ({_Q('pct')} - 0.5::double) * 2)))) AS position FROM pc),
hr AS (SELECT *, least(100, greatest(0, {_BY_SECTOR(1, 75.0)} * (1 + 0.15::double * {_Q('position')}))) AS hr FROM po), sy AS (SELECT *, least(100, greatest(0, {_Q('vr')} * {_Q('hr')} / 100 * {_BY_SECTOR(2, 1.0)} * least(1.2::double, greatest(0.8::double, {_BY_SECTOR(3, 1.0)})))) AS synergy FROM hr),
f AS (SELECT *, 0.88::double * (0.6::double * {_Q('vr')} + 0.4::double * {_Q('hr')}) + 0.12::double * {_Q('synergy')} AS final FROM sy)
SELECT assessment, sector, round(tc, 4) AS tc, round(vr, 6) AS vr, round(position, 6) AS position, round(hr, 6) AS hr, round(synergy, 6) AS synergy, round(final, 6) AS final FROM f""")
def score_chain_sectors(s, p):
    """The chain of scores with each assessment's own sector, talent concentration and place within the sector, at four places a stage."""
    sector = F.create_map(*[F.lit(x) for pair in _SECTOR_OF.items() for x in pair])
    a = table(s, p, "assessments").select(text_key("id").alias("assessment"), "company_id", F.coalesce(F.try_element_at(sector, F.coalesce("assessment_type", F.lit(""))), F.lit("other")).alias("sector")).distinct()
    t = table(s, p, "dimension_scores").select("id", text_key("assessment_id").alias("assessment"), dimension_name(F.col("dimension")).alias("dim"), d("score").alias("x"), "evidence_count").where("assessment is not null").dropDuplicates(["id"])
    wide = t.groupBy("assessment").agg(*[F.coalesce(F.avg(F.when(F.col("dim") == x, F.col("x"))), F.lit(50.0)).alias(x) for x in L.DIMENSIONS], F.sum("evidence_count").cast("bigint").alias("evidence_count"))
    known = wide.join(a, "assessment").join(_talent(s, p), "company_id", "left").withColumn("talent_concentration", F.coalesce("tc", F.lit(0.5)))
    first = chain(known.withColumn("percentile", F.lit(0.5)), 4).select(*known.columns, F.round("vr", 6).alias("_vr"))
    placed = position_in_group(first, "sector", "_vr", "assessment").withColumn("percentile", F.col("pct"))
    out = chain(placed.drop("pct", "_vr"), 4)
    return out.select("assessment", "sector", F.round("talent_concentration", 4).alias("tc"), *[F.round(c, 6).alias(c) for c in ("vr", "position", "hr", "synergy", "final")])


_LINE = S.OPENING_PATTERN


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE doc_type = 'job_post' AND text IS NOT NULL) SELECT doc_id, lower(line) AS opening, count(*) AS n FROM l WHERE line <> '' AND length(line) <= 120 AND regexp_matches(line, '(?i){_LINE}') GROUP BY ALL""")
def leadership_openings(s, p):
    """The lines of postings that name a leading role in AI, once a posting."""
    t = table(s, p, "documents").where("doc_type = 'job_post' and text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return t.where((F.col("line") != "") & (F.length("line") <= 120) & F.col("line").rlike(f"(?i){_LINE}")).groupBy("doc_id", F.lower("line").alias("opening")).agg(F.count("*").alias("n"))


_KEPT = f"""SELECT doc_id::varchar AS evidence_id, 'leadership_signals' AS category, trim(split_part(text, chr(10), 1)) AS content, 0.8::double AS confidence, created_at FROM documents WHERE doc_type IN ('job_post', 'board_bio') AND text IS NOT NULL
UNION ALL SELECT DISTINCT id, 'governance_signals', evidence, confidence::double, created_at FROM board_governance_signals WHERE evidence IS NOT NULL
UNION ALL SELECT DISTINCT id, 'culture_signals', positive_keywords_found, confidence::double, created_at FROM culture_signals WHERE positive_keywords_found IS NOT NULL"""


@query(f"""SELECT evidence_id, category, length(content)::bigint AS n FROM ({_KEPT}) WHERE category IN ('leadership_signals', 'board_composition', 'governance_signals') AND confidence >= 0.4 AND created_at >= TIMESTAMP '2022-01-01'
AND NOT (category = 'leadership_signals' AND length(content) >= 10 AND NOT contains(content, ' — ') AND NOT contains(content, ' – ') AND {_n("lower(trim(content))", S.JOB_WORDS)} > 0)""")
def leadership_evidence(s, p):
    """Evidence of the categories asked for, board composition with its other name, from a time and a confidence on, without titles of jobs."""
    docs = table(s, p, "documents").where("doc_type in ('job_post', 'board_bio') and text is not null").select(F.col("doc_id").cast("string").alias("evidence_id"), F.lit("leadership_signals").alias("category"), F.trim(F.substring_index("text", "\n", 1)).alias("content"), F.lit(0.8).alias("confidence"), "created_at")
    of = lambda t, c, col: table(s, p, t).where(F.col(col).isNotNull()).select(F.col("id").alias("evidence_id"), F.lit(c).alias("category"), F.col(col).alias("content"), d("confidence").alias("confidence"), "created_at").distinct()
    rows = docs.unionByName(of("board_governance_signals", "governance_signals", "evidence")).unionByName(of("culture_signals", "culture_signals", "positive_keywords_found"))
    asked = {"leadership_signals", "board_composition"}
    allowed = sorted(asked | ({"governance_signals"} if "board_composition" in asked else set()))
    rows = rows.where(F.col("category").isin(*allowed) & (F.col("confidence") >= 0.4) & (F.col("created_at") >= F.expr("timestamp_ntz'2022-01-01'")))
    return rows.where(~((F.col("category") == "leadership_signals") & sig.looks_like_job(F.col("content")))).select("evidence_id", "category", F.length("content").cast("bigint").alias("n"))


@query(f"""SELECT DISTINCT id, (length(trim(content)) < 50 OR length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) < 0.4 * length(content) OR {_n("left(lower(content), 200)", S.FORM_HEADINGS)} > 0) AS garbage FROM document_chunks_sec WHERE content IS NOT NULL""")
def form_chunks(s, p):
    """Chunks of no use: too short, too few letters, or a form's heading at the start."""
    return table(s, p, "document_chunks_sec").where("content is not null").select("id", form_like(F.col("content"), S.FORM_HEADINGS).alias("garbage")).distinct()


_COMMITTEES = "list_concat(" + ", ".join(f"regexp_extract_all(lower(text), '{x}')" for x in S.COMMITTEE_PATTERNS[:2]) + ")"
for _x in S.COMMITTEE_PATTERNS[2:]:
    _COMMITTEES = f"list_concat({_COMMITTEES}, regexp_extract_all(lower(text), '{_x}'))"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform({_COMMITTEES}, lambda x: array_to_string(list_transform(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ')))), '|') AS committees FROM documents WHERE regexp_matches(lower(text), 'committee')""")
def committee_names(s, p):
    """The committees that a text names, in title case, once each."""
    t = table(s, p, "documents").where(F.contains(F.lower("text"), F.lit("committee")))
    return t.select("doc_id", F.array_join(F.sort_array(committees(F.col("text"), S.COMMITTEE_PATTERNS)), "|").alias("committees"))


@query(f"SELECT level, count(*) AS n FROM (SELECT DISTINCT id, {_LEVEL} AS level FROM (SELECT id, lower(coalesce(job_title, '')) AS t FROM glassdoor_reviews)) GROUP BY level")
def posting_levels(s, p):
    return table(s, p, "glassdoor_reviews").select("id", sig.posting_level(F.col("job_title")).alias("level")).distinct().groupBy("level").agg(F.count("*").alias("n"))


@query("""SELECT signal, count(*) AS members, round(avg((length(coalesce(bio, '')) >= 50)::int), 6) AS with_bio FROM (SELECT DISTINCT id, lower(trim(governance_signal_id)) AS signal, bio FROM board_members WHERE trim(governance_signal_id) <> '') GROUP BY signal HAVING count(*) >= 5 AND avg((length(coalesce(bio, '')) >= 50)::int) >= 0.5""")
def well_described_boards(s, p):
    """Boards of at least five members of whom half have a biography."""
    t = table(s, p, "board_members").select("id", text_key("governance_signal_id").alias("signal"), (F.length(F.coalesce("bio", F.lit(""))) >= 50).cast("int").alias("told")).distinct().where("signal is not null")
    return t.groupBy("signal").agg(F.count("*").alias("members"), F.avg("told").alias("with_bio")).where("members >= 5 and with_bio >= 0.5").withColumn("with_bio", F.round("with_bio", 6))


@query("""WITH m AS (SELECT DISTINCT id, lower(trim(governance_signal_id)) AS k, is_independent FROM board_members), g AS (SELECT DISTINCT lower(trim(id)) AS k, upper(trim(ticker)) AS ticker, governance_score FROM board_governance_signals)
SELECT ticker, count(*) AS seats, count(CASE WHEN is_independent THEN 1 END) AS independent, round(avg(governance_score::double), 6) AS governance FROM m JOIN g USING (k) GROUP BY ticker""")
def seats_by_ticker(s, p):
    m = table(s, p, "board_members").select("id", text_key("governance_signal_id").alias("k"), "is_independent").distinct()
    g = table(s, p, "board_governance_signals").select(text_key("id").alias("k"), upper_key("ticker").alias("ticker"), d("governance_score").alias("x")).distinct()
    return m.join(g, "k").groupBy("ticker").agg(F.count("*").alias("seats"), F.count_if("is_independent").alias("independent"), F.round(F.avg("x"), 6).alias("governance"))


_EMPLOYER = "Former [a-z ]+ of ([A-Z][A-Za-z]+ [A-Z][a-z]+)"


@query(f"""WITH e AS (SELECT DISTINCT id, regexp_extract(bio, '{_EMPLOYER}', 1) AS employer FROM board_members WHERE bio IS NOT NULL), a AS (SELECT alias, lower(alias) AS low, trim(regexp_replace(regexp_replace(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g'), '(^| )(inc|incorporated|corp|corporation|llc|ltd|limited|plc|co|company|gmbh|lp)( |$)', ' ', 'g'), ' +', ' ', 'g')) AS norm,
regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS squished FROM (SELECT unnest([employer, split_part(employer, ' ', 1), left(employer, 3), replace(employer, ' ', '-') || ', Inc.']) AS alias FROM (SELECT employer FROM e WHERE employer <> '' GROUP BY employer ORDER BY count(*) DESC, employer LIMIT 20))),
k AS (SELECT id, employer, lower(employer) AS low, trim(regexp_replace(regexp_replace(regexp_replace(lower(employer), '[^a-z0-9]+', ' ', 'g'), '(^| )(inc|incorporated|corp|corporation|llc|ltd|limited|plc|co|company|gmbh|lp)( |$)', ' ', 'g'), ' +', ' ', 'g')) AS norm, regexp_replace(lower(employer), '[^a-z0-9]+', '', 'g') AS squished FROM e WHERE employer <> '')
SELECT id, employer, count(DISTINCT a.alias) AS aliases FROM k JOIN a ON (CASE WHEN length(a.low) <= 3 THEN regexp_matches(k.low, '(^|[^a-z0-9_])' || a.low || '([^a-z0-9_]|$)') WHEN NOT contains(a.low, ' ') THEN contains(k.low, a.low) ELSE false END) OR (a.norm <> '' AND a.norm = k.norm) OR (a.squished <> '' AND a.squished = k.squished) GROUP BY ALL""")
def employer_aliases(s, p):
    """Seats whose former employer matches an alias of one of the twenty commonest employers: as a word, within it, normalised or squished."""
    from loamworks.functions.text import company_name, squished

    e = table(s, p, "board_members").where("bio is not null").select("id", F.regexp_extract("bio", _EMPLOYER, 1).alias("employer")).distinct().where("employer <> ''")
    top = e.groupBy("employer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "employer").limit(20)
    spelt = F.explode(F.array("employer", F.split_part("employer", F.lit(" "), F.lit(1)), F.left("employer", F.lit(3)), F.concat(F.translate("employer", " ", "-"), F.lit(", Inc.")))).alias("alias")
    a = top.select(spelt).select("alias", F.lower("alias").alias("a_low"), company_name(F.col("alias")).alias("a_norm"), squished(F.col("alias")).alias("a_sq"))
    k = e.select("id", "employer", F.lower("employer").alias("low"), company_name(F.col("employer")).alias("norm"), squished(F.col("employer")).alias("sq"))
    word = F.expr("low rlike concat('(^|[^a-z0-9_])', a_low, '([^a-z0-9_]|$)')")
    within = F.when(F.length("a_low") <= 3, word).when(~F.contains("a_low", F.lit(" ")), F.expr("contains(low, a_low)")).otherwise(F.lit(False))
    same = (F.col("a_norm") != "") & (F.col("a_norm") == F.col("norm")) | (F.col("a_sq") != "") & (F.col("a_sq") == F.col("sq"))
    return k.join(F.broadcast(a), within | same).groupBy("id", "employer").agg(F.countDistinct("alias").alias("aliases"))  # at most 80 aliases


_QUARTILES = {"technology": (75, 65, 55), "healthcare": (70, 58, 48), "financial_services": (72, 60, 50), "manufacturing": (68, 55, 45), "retail": (65, 52, 42)}
_BAND = lambda k: "CASE sector " + " ".join(f"WHEN '{x}' THEN {v[k]}" for x, v in _QUARTILES.items()) + f" ELSE {_QUARTILES['technology'][k]} END"


@query(f"""WITH a AS (SELECT DISTINCT id, {_SECTOR_CASE} AS sector, v_r_score::double AS v FROM assessments WHERE v_r_score IS NOT NULL), q AS (SELECT *, CASE WHEN v >= {_BAND(0)} THEN 1 WHEN v >= {_BAND(1)} THEN 2 WHEN v >= {_BAND(2)} THEN 3 ELSE 4 END AS q FROM a)
SELECT sector, count(CASE WHEN q = 1 THEN 1 END) AS q1, count(CASE WHEN q = 2 THEN 1 END) AS q2, count(CASE WHEN q = 3 THEN 1 END) AS q3, count(CASE WHEN q = 4 THEN 1 END) AS q4, count(CASE WHEN v >= 70 THEN 1 END) AS leaders, count(CASE WHEN v < 50 THEN 1 END) AS laggards, round(avg(v), 6) AS mean FROM q GROUP BY sector""")
def sector_quartiles(s, p):
    """How many assessments of a sector stand in each of its own quartile bands, and the leaders and laggards."""
    of = F.create_map(*[F.lit(x) for pair in _SECTOR_OF.items() for x in pair])
    bands = F.create_map(*[x for n, v in _QUARTILES.items() for x in (F.lit(n), F.array(*[F.lit(y) for y in v]))])
    sector = F.coalesce(F.try_element_at(of, F.coalesce("assessment_type", F.lit(""))), F.lit("other"))
    t = table(s, p, "assessments").where("v_r_score is not null").select("id", sector.alias("sector"), d("v_r_score").alias("v")).distinct()
    b = F.coalesce(F.try_element_at(bands, F.col("sector")), bands["technology"])
    q = F.when(F.col("v") >= b[0], 1).when(F.col("v") >= b[1], 2).when(F.col("v") >= b[2], 3).otherwise(4)
    t = t.withColumn("q", q)
    return t.groupBy("sector").agg(*[F.count_if(F.col("q") == k).alias(f"q{k}") for k in (1, 2, 3, 4)], F.count_if(F.col("v") >= 70).alias("leaders"), F.count_if(F.col("v") < 50).alias("laggards"), F.round(F.avg("v"), 6).alias("mean"))


@query("""SELECT company_id, strftime(assessment_date, '%Y-%m-%d') AS day, id, row_number() OVER (PARTITION BY company_id ORDER BY assessment_date, id) AS place FROM (SELECT DISTINCT id, company_id, assessment_date FROM assessments WHERE assessment_date > DATE '2025-01-01' - 365 AND assessment_date <= DATE '2025-01-01')""")
def history_range(s, p):
    """The assessments of the year before a day, in order."""
    t = table(s, p, "assessments").where("assessment_date > date'2025-01-01' - interval 365 days and assessment_date <= date'2025-01-01'").select("id", "company_id", "assessment_date").distinct()
    w = Window.partitionBy("company_id").orderBy("assessment_date", "id")
    return t.select("company_id", F.date_format("assessment_date", "yyyy-MM-dd").alias("day"), "id", F.row_number().over(w).cast("bigint").alias("place"))


@query("""SELECT DISTINCT id, len(coalesce(from_json(CASE WHEN json_valid(evidence) THEN evidence END, '["VARCHAR"]'), []))::bigint AS n, coalesce(from_json(CASE WHEN json_valid(evidence) THEN evidence END, '["VARCHAR"]')[1], '') AS first, CASE WHEN evidence IS NULL OR trim(evidence) = '' THEN '{}' WHEN json_valid(evidence) THEN 'json' ELSE 'raw' END AS form FROM board_governance_signals""")
def evidence_lists(s, p):
    """Lists that are stored as JSON text: their length and first value; text that is no JSON is kept as raw, none as {}."""
    items = F.coalesce(F.from_json("evidence", "array<string>"), F.array().cast("array<string>"))
    form = F.when(F.col("evidence").isNull() | (F.trim("evidence") == ""), "{}").when(F.expr("try_parse_json(evidence) is not null"), "json").otherwise("raw")
    return table(s, p, "board_governance_signals").select("id", F.size(items).cast("bigint").alias("n"), F.coalesce(F.try_element_at(items, F.lit(1)), F.lit("")).alias("first"), form.alias("form")).distinct()
