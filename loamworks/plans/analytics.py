"""Queries over text, scores, retrieval and the document pipeline."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions import lexicons as L
from loamworks.functions.keys import text_key, upper_key
from loamworks.functions.signal_words import BROAD_TERMS
from loamworks.functions.text import company_name, domain, filing_form, garbage, hit_count, tidy, tokens, whole_word_hits, word_count
from loamworks.operators.documents import chunked, clean_lines, primary_document, section_bounds, visible_text, within_budget
from loamworks.operators.evidence import concentration, justification, merged_members, rubric_confidence, rubric_level, to_dimensions
from loamworks.operators.ranking import reciprocal_rank_fusion
from loamworks.operators.retrieval import bm25_top, cosine_top
from loamworks.operators.signals import broad_score
from loamworks.operators.scoring import chain, culture_scores, dimension_name, governance
from loamworks.plans.relational import _EVIDENCE, d, day, evidence
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


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


@query(f"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::bigint AS words, sha256(text) AS hash, {_hits("lower(text)", L.FILING_TERMS)}::bigint AS terms,
len(list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> ''))::bigint AS tokens FROM documents WHERE text IS NOT NULL""")
def text_statistics(s, p):
    t = table(s, p, "documents").where("text is not null").select("doc_id", "text", F.lower("text").alias("low"))
    return t.select("doc_id", word_count(F.col("text")).alias("words"), F.sha2("text", 256).alias("hash"), hit_count(F.col("low"), L.FILING_TERMS).cast("bigint").alias("terms"), F.size(tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query("""SELECT doc_id, array_to_string(list_filter(['cloud', 'pilot', 'risk', 'automation', 'analytics'], lambda w: regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '([^a-z0-9_]|$)')), ',') AS words FROM documents WHERE text IS NOT NULL""")
def whole_words(s, p):
    return table(s, p, "documents").where("text is not null").select("doc_id", F.array_join(whole_word_hits(F.col("text"), ("cloud", "pilot", "risk", "automation", "analytics")), ",").alias("words"))


@query("""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10) || chr(10), 'g').trim(' ' || chr(10)))::bigint AS tidy_chars, n_chars IS DISTINCT FROM length(text) AS stale
FROM documents WHERE text IS NOT NULL""")
def tidy_texts(s, p):
    t = table(s, p, "documents").where("text is not null")
    return t.select("doc_id", F.length(tidy(F.col("text"))).cast("bigint").alias("tidy_chars"), (~F.col("n_chars").eqNullSafe(F.length("text"))).alias("stale"))


@query("""SELECT id, lower(regexp_replace(split_part(regexp_replace(source_url, '^[A-Za-z]+://', ''), '/', 1), '^www\\.', '')) AS host, strftime(filing_date, '%Y') AS year, upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) AS form,
date_diff('day', filing_date, created_at::date)::bigint AS days_late FROM (SELECT DISTINCT * FROM documents_sec)""")
def filing_fields(s, p):
    t = table(s, p, "documents_sec")
    return t.select("id", domain(F.col("source_url")).alias("host"), F.date_format("filing_date", "yyyy").alias("year"), filing_form(F.col("filing_type")).alias("form"), F.datediff(F.to_date("created_at"), "filing_date").cast("bigint").alias("days_late")).distinct()


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), '(^| )(inc|incorporated|corp|corporation|llc|ltd|limited|plc|co|company|gmbh|lp)( |$)', ' ', 'g'), ' +', ' ', 'g')) AS name FROM supplier""")
def supplier_names(s, p):
    return table(s, p, "supplier").select("s_suppkey", company_name(F.col("s_name")).alias("name"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, json_valid(props) AS valid FROM events""")
def event_properties(s, p):
    t = table(s, p, "events")
    return t.select("event_id", F.coalesce(F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')"), F.lit(0).cast("bigint")).alias("k"), F.expr("try_parse_json(props) is not null").alias("valid"))


@query("""SELECT DISTINCT id, CASE WHEN lower(title) LIKE '%intern%' THEN 'intern' WHEN regexp_matches(lower(title), 'manager|head|director|vp|chief') THEN 'manager' WHEN regexp_matches(lower(title), 'senior|sr|lead|principal|staff') THEN 'senior' ELSE 'mid' END AS level FROM board_members""")
def title_levels(s, p):
    low = F.lower("title")
    level = F.when(low.contains("intern"), "intern").when(low.rlike("manager|head|director|vp|chief"), "manager").when(low.rlike("senior|sr|lead|principal|staff"), "senior").otherwise("mid")
    return table(s, p, "board_members").select("id", level.alias("level")).distinct()


@query("""SELECT DISTINCT id, (length(content) < 50 OR length(regexp_replace(content, '[^\\p{L}]', '', 'g')) < 0.4 * length(content)) AS garbage FROM document_chunks_sec WHERE content IS NOT NULL""")
def garbage_chunks(s, p):
    return table(s, p, "document_chunks_sec").where("content is not null").select("id", garbage(F.col("content")).alias("garbage")).distinct()


@query("""SELECT id, len(regexp_extract_all(lower(content), 'automat[a-z]*'))::bigint AS automation, (contains(lower(content), 'risk') AND contains(lower(content), 'model')) AS model_risk
FROM (SELECT DISTINCT id, content FROM document_chunks_sec WHERE content IS NOT NULL)""")
def filing_mentions(s, p):
    t = table(s, p, "document_chunks_sec").where("content is not null").select("id", F.lower("content").alias("c"))
    return t.select("id", F.regexp_count("c", F.lit("automat[a-z]*")).cast("bigint").alias("automation"), (F.contains("c", F.lit("risk")) & F.contains("c", F.lit("model"))).alias("model_risk")).distinct()


_REVIEW = "lower(concat_ws(' ', title, pros, cons, job_title, advice_to_management))"
_WEIGHT = "(CASE WHEN date_diff('day', review_date, DATE '2025-06-30') < 730 THEN 1.0 ELSE 0.5 END * CASE WHEN is_current_employee THEN 1.2 ELSE 1.0 END)::double"


@query(f"""WITH r AS (SELECT company_id, {_WEIGHT} AS w, {_REVIEW} AS t, rating::double AS rating FROM (SELECT DISTINCT * FROM glassdoor_reviews)),
g AS (SELECT company_id, count(*) AS review_count, least(100, greatest(0, sum(w * ({_hits("t", L.INNOVATION_POSITIVE)} - {_hits("t", L.INNOVATION_NEGATIVE)})) / count(*) * 50 + 50)) AS innovation,
least(100, greatest(0, sum(w * {_hits("t", L.DATA_DRIVEN)}) / count(*) * 100)) AS data_driven, least(100, greatest(0, sum(w * {_hits("t", L.AI_AWARENESS)}) / count(*) * 100)) AS ai_awareness,
least(100, greatest(0, sum(w * ({_hits("t", L.CHANGE_POSITIVE)} - {_hits("t", L.CHANGE_NEGATIVE)})) / count(*) * 50 + 50)) AS change_readiness FROM r GROUP BY company_id)
SELECT company_id, review_count, round(innovation, 6) AS innovation, round(data_driven, 6) AS data_driven, round(ai_awareness, 6) AS ai_awareness, round(change_readiness, 6) AS change_readiness,
round(0.30::double * innovation + 0.25::double * data_driven + 0.25::double * ai_awareness + 0.20::double * change_readiness, 6) AS overall FROM g""")
def culture(s, p):
    t = culture_scores(table(s, p, "glassdoor_reviews"), ["company_id"], F.lit("2025-06-30").cast("date"))
    return t.select("company_id", "review_count", *[F.round(c, 6).alias(c) for c in ("innovation", "data_driven", "ai_awareness", "change_readiness", "overall")])


@query(f"""WITH m AS (SELECT lower(trim(governance_signal_id)) AS signal, {_hits("lower(coalesce(committees, ''))", L.TECH_COMMITTEES)} > 0 AS tech, {_hits("lower(coalesce(bio, ''))", L.BOARD_EXPERTISE)} > 0 AS expert,
{_hits("lower(coalesce(title, ''))", L.DATA_OFFICERS)} > 0 OR list_has_any(regexp_split_to_array(lower(coalesce(title, '')), '\\s+'), ['caio', 'cdo', 'cto', 'cio']) AS office, coalesce(is_independent, false) AS ind,
contains(lower(coalesce(committees, '')), 'risk') AS risk, {_hits("lower(coalesce(bio, ''))", L.TECH_MENTIONS)} > 0 AS mention FROM (SELECT DISTINCT * FROM board_members) WHERE trim(governance_signal_id) <> '')
SELECT signal, count(*) AS members, (20 + 15 * bool_or(tech)::int + 20 * bool_or(expert)::int + 15 * bool_or(office)::int + 10 * (avg(ind::int) > 0.5)::int + 10 * (bool_or(risk) AND bool_or(mention))::int)::bigint AS governance FROM m GROUP BY signal""")
def board_governance(s, p):
    t = table(s, p, "board_members").withColumn("signal", text_key("governance_signal_id")).where("signal is not null")
    return governance(t, ["signal"]).select("signal", "members", "governance")


@query(f"""WITH m AS (SELECT lower(trim(governance_signal_id)) AS signal, {_hits("lower(coalesce(committees, ''))", L.TECH_COMMITTEES)} > 0 AS tech, {_hits("lower(coalesce(bio, ''))", L.BOARD_EXPERTISE)} > 0 AS expert,
{_hits("lower(coalesce(title, ''))", L.DATA_OFFICERS)} > 0 OR list_has_any(regexp_split_to_array(lower(coalesce(title, '')), '\\s+'), ['caio', 'cdo', 'cto', 'cio']) AS office, coalesce(is_independent, false) AS ind,
contains(lower(coalesce(committees, '')), 'risk') AS risk, {_hits("lower(coalesce(bio, ''))", L.TECH_MENTIONS)} > 0 AS mention FROM (SELECT DISTINCT * FROM board_members) WHERE trim(governance_signal_id) <> ''),
s AS (SELECT lower(trim(id)) AS signal, bool_or({_hits("lower(evidence)", L.STRATEGY_WORDS)} > 0) AS plan, bool_or({_hits("lower(evidence)", (*L.TECH_MENTIONS, "data"))} > 0) AS told FROM board_governance_signals WHERE evidence IS NOT NULL GROUP BY 1)
SELECT signal, count(*) AS members, (20 + 15 * bool_or(tech)::int + 20 * bool_or(expert)::int + 15 * bool_or(office)::int + 10 * (avg(ind::int) > 0.5)::int + 10 * (bool_or(risk) AND (bool_or(mention) OR coalesce(bool_or(told), false)))::int + 10 * coalesce(bool_or(plan), false)::int)::bigint AS governance,
coalesce(bool_or(plan), false) AS has_ai_strategy FROM m LEFT JOIN s USING (signal) GROUP BY signal""")
def board_governance_strategy(s, p):
    """Governance with what the board's evidence says of its strategy."""
    t = table(s, p, "board_members").withColumn("signal", text_key("governance_signal_id")).where("signal is not null")
    told = table(s, p, "board_governance_signals").select(text_key("id").alias("signal"), F.col("evidence").alias("text"))
    return governance(t, ["signal"], strategy=told).select("signal", "members", "governance", "has_ai_strategy")


_DIMS = ", ".join(f"coalesce(avg(CASE WHEN dim = '{x}' THEN score END), 50.0) AS {x}" for x in L.DIMENSIONS)
_MEAN = " + ".join(f"{w}::double * {x}" for x, w in L.DIMENSIONS.items())
_VAR = " + ".join(f"{w}::double * ({x} - m) * ({x} - m)" for x, w in L.DIMENSIONS.items())
_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.DIMENSION_ALIASES.items())


def _scored(s, p, places=None):
    t = table(s, p, "dimension_scores").select("id", text_key("assessment_id").alias("assessment"), dimension_name(F.col("dimension")).alias("dim"), d("score").alias("x"), "evidence_count").where("assessment is not null").dropDuplicates(["id"])
    wide = t.groupBy("assessment").agg(*[F.coalesce(F.avg(F.when(F.col("dim") == x, F.col("x"))), F.lit(50.0)).alias(x) for x in L.DIMENSIONS], F.sum("evidence_count").cast("bigint").alias("evidence_count"))
    return chain(wide.withColumns({"talent_concentration": F.lit(0.3), "percentile": F.lit(0.5), "sector": F.lit("technology")}), places)


@query(f"""WITH r AS (SELECT lower(trim(assessment_id)) AS assessment, CASE lower(trim(dimension)) {_ALIAS} ELSE lower(trim(dimension)) END AS dim, score::double AS score, evidence_count FROM (SELECT DISTINCT * FROM dimension_scores) WHERE trim(assessment_id) <> ''),
w AS (SELECT assessment, {_DIMS}, greatest(coalesce(sum(evidence_count), 1), 1)::double AS n FROM r GROUP BY assessment), m AS (SELECT *, {_MEAN} AS m FROM w), v AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE sqrt({_VAR}) / m END AS cv FROM m),
vr AS (SELECT *, m * greatest(0, least(1, 1 - 0.25::double * cv)) * (1 - 0.15::double * (0.3::double - 0.25::double)) AS vr FROM v),
hr AS (SELECT *, 75 * (1 + 0.15::double * (0.6::double * greatest(-1, least(1, (vr - 65) / 50)))) AS hr FROM vr), f AS (SELECT *, 0.88::double * (0.6::double * vr + 0.4::double * hr) + 0.12::double * least(100, vr * hr / 100 * 1.1::double * 1.15::double) AS final,
1.96::double * 14 * sqrt(1 - least(n * 0.32::double / (1 + (n - 1) * 0.32::double), 0.99::double)) AS half FROM hr)
SELECT assessment, round(vr, 6) AS vr, round(hr, 6) AS hr, round(final, 6) AS final, round(greatest(0, final - half), 6) AS ci_lower, round(least(100, final + half), 6) AS ci_upper FROM f""")
def score_chain(s, p):
    return _scored(s, p).select("assessment", *[F.round(c, 6).alias(c) for c in ("vr", "hr", "final", "ci_lower", "ci_upper")])


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.embedding::double[]) AS score FROM q JOIN embeddings v ON v.vec_id <> query_id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def cosine_top10(s, p):
    t = table(s, p, "embeddings")
    return cosine_top(t, t.where("vec_id % 50 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_BM25 = """WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '')) AS term FROM eval_items WHERE item_id % 50 = 0),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
s AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN i USING (term) JOIN q USING (term), st GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"""


def _bm25(s, p, k):
    q = table(s, p, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return bm25_top(table(s, p, "documents"), q, k)


@query(_BM25 + " SELECT query_id, doc_id, round(score, 4) AS score, rank FROM b WHERE rank <= 10")
def bm25_top10(s, p):
    return _bm25(s, p, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_BM25 + """, r AS (SELECT query_id, doc_id, rank FROM b WHERE rank <= 20), n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM r)
SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank, 0.6::double AS w FROM r UNION ALL SELECT query_id, doc_id, rank, 0.4::double FROM n) GROUP BY ALL""")
def fused_ranks(s, p):
    """The BM25 ranks fused with the order of newest ids among them."""
    r = _bm25(s, p, 20).select("query_id", "doc_id", "rank")
    newest = r.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_id"))).alias("rank"))
    return reciprocal_rank_fusion([(r, 0.6), (newest, 0.4)], ["query_id", "doc_id"]).withColumn("score", F.round("score", 9))


@query("""SELECT doc, id FROM (SELECT lower(trim(document_id)) AS doc, id, sum(length(content)) OVER (PARTITION BY lower(trim(document_id)) ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS total
FROM (SELECT DISTINCT id, document_id, chunk_index, content FROM document_chunks_sec) WHERE trim(document_id) <> '') WHERE total <= 3000""")
def leading_chunks(s, p):
    t = table(s, p, "document_chunks_sec").select("id", text_key("document_id").alias("doc"), "chunk_index", F.length("content").alias("chars")).distinct().where("doc is not null")
    return within_budget(t, "doc", ["chunk_index", "id"], "chars", 3000).select("doc", "id")


@query("""SELECT DISTINCT id, array_to_string(list_filter(regexp_split_to_array(content, '\\r?\\n'), lambda x: trim(x) = '' OR length(regexp_replace(x, '[^\\p{L}]', '', 'g')) / greatest(length(regexp_replace(x, '\\s', '', 'g')), 1) >= 0.2), chr(10)) AS content FROM document_chunks_sec WHERE content IS NOT NULL""")
def cleaned_chunks(s, p):
    return table(s, p, "document_chunks_sec").where("content is not null").select("id", clean_lines(F.col("content")).alias("content")).dropDuplicates(["id"])


@query("""SELECT DISTINCT id, trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS content FROM document_chunks_sec WHERE contains(content, '<div')""")
def page_texts(s, p):
    return table(s, p, "document_chunks_sec").where("contains(content, '<div')").select("id", visible_text(primary_document(F.col("content"))).alias("content")).distinct()


@query()
def document_chunks(s, p):
    return chunked(table(s, p, "documents"), 120, 15)


@query()
def memo_sections(s, p):
    return section_bounds(table(s, p, "documents"), r"^(?:recommendation|analyst|operator|chief [a-z ]+):", 100)


@query("""SELECT upper(trim(ticker)) AS ticker, count(DISTINCT id) AS n, strftime(max(filing_date), '%Y-%m-%d') AS newest, round(avg(word_count), 4) AS words FROM documents_sec WHERE trim(ticker) <> '' GROUP BY 1""")
def filings_by_ticker(s, p):
    return table(s, p, "documents_sec").where("trim(ticker) <> ''").groupBy(upper_key("ticker").alias("ticker")).agg(F.countDistinct("id").alias("n"), day(F.max("filing_date")).alias("newest"), F.round(F.avg("word_count"), 4).alias("words"))


_TERMS = _hits("lower(content)", BROAD_TERMS)
_BROAD = f"CASE WHEN {_TERMS} >= 20 THEN least(95.0::double, 70 + ({_TERMS} - 20) * 1.5::double) WHEN {_TERMS} >= 10 THEN 55 + ({_TERMS} - 10) * 1.5::double WHEN {_TERMS} >= 5 THEN 40 + ({_TERMS} - 5) * 3.0::double ELSE 20 + {_TERMS} * 4.0::double END"
_WEIGHT_ROWS = ", ".join(f"('{src}', '{dim}', {w}::double, {rel}::double)" for src, (ws, rel) in L.SOURCE_WEIGHTS.items() for dim, w in ws.items())
_DIM_ROWS = ", ".join(f"('{x}')" for x in L.DIMENSIONS)


@query(f"""WITH e AS (SELECT ticker, source_type AS source, {_BROAD} AS score, confidence FROM ({_EVIDENCE})), w(source, dimension, weight, reliability) AS (VALUES {_WEIGHT_ROWS}), dims(dimension) AS (VALUES {_DIM_ROWS}),
g AS (SELECT ticker, dimension, sum(score * weight) / sum(weight) AS score, 1 - product(1 - coalesce(confidence, 0) * reliability) AS confidence, sum(weight) AS total_weight, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e JOIN w USING (source) WHERE score IS NOT NULL GROUP BY ALL)
SELECT t.ticker, d.dimension, round(coalesce(g.score, 50), 6) AS score, round(coalesce(g.confidence, 0), 6) AS confidence, round(coalesce(g.total_weight, 0), 4) AS total_weight, coalesce(g.sources, '') AS sources FROM (SELECT DISTINCT ticker FROM e WHERE ticker <> '') t, dims d LEFT JOIN g ON g.ticker = t.ticker AND g.dimension = d.dimension""")
def evidence_dimensions(s, p):
    """The passages of three sources on the seven dimensions; a passage's score comes from its broad terms."""
    e = evidence(s, p).where("ticker <> ''").select("ticker", F.col("source_type").alias("source"), F.when(F.col("content").isNotNull(), broad_score(F.lower("content"))).alias("score"), "confidence")
    w = s.createDataFrame([(src, dim, x, rel) for src, (ws, rel) in L.SOURCE_WEIGHTS.items() for dim, x in ws.items()], "source string, dimension string, weight double, reliability double")
    t = to_dimensions(e, w, ["ticker"], list(L.DIMENSIONS))
    return t.select("ticker", "dimension", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.round("total_weight", 4).alias("total_weight"), "sources")


def _rubric(n: int) -> str:
    return " + ".join(f"regexp_matches(t, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')::int" for w in L.RUBRIC[n])


@query(f"""WITH c AS (SELECT DISTINCT id, lower(content) AS t, length(content) AS n FROM document_chunks_sec WHERE content IS NOT NULL), k AS (SELECT id, n, {_rubric(5)} AS k5, {_rubric(4)} AS k4, {_rubric(3)} AS k3, {_rubric(2)} AS k2 FROM c),
l AS (SELECT id, n, CASE WHEN k5 >= 2 THEN 5 WHEN k4 >= 2 THEN 4 WHEN k3 >= 1 THEN 3 WHEN k2 >= 1 THEN 2 ELSE 1 END::bigint AS level, CASE WHEN k5 >= 2 THEN k5 WHEN k4 >= 2 THEN k4 WHEN k3 >= 1 THEN k3 WHEN k2 >= 1 THEN k2 ELSE 0 END::bigint AS found FROM k)
SELECT id, level, found, round(least(1, greatest(0.3, CASE WHEN found >= 5 THEN 0.9 WHEN found >= 3 THEN 0.75 WHEN found >= 2 THEN 0.65 ELSE 0.5 END::double * CASE WHEN n > 10000 THEN 1.1 WHEN n < 1000 THEN 0.9 ELSE 1.0 END::double)), 6) AS confidence FROM l""")
def rubric_levels(s, p):
    t = table(s, p, "document_chunks_sec").where("content is not null")
    level, found = rubric_level(F.col("content"), L.RUBRIC, L.RUBRIC_LEAST)
    return t.select("id", level.alias("level"), found.alias("found"), F.length("content").alias("n")).distinct().select("id", "level", "found", F.round(rubric_confidence(F.col("found"), F.col("n")), 6).alias("confidence"))


@query("""SELECT company_id, lower(trim(name)) AS person, count(*) AS n_rows, arg_max(coalesce(bio, ''), (length(coalesce(bio, '')), coalesce(bio, ''))) AS bio, coalesce(bool_or(is_independent), false) AS is_independent, max(tenure_years)::double AS tenure_years,
array_to_string(list_sort(list(DISTINCT trim(committees, ' ')) FILTER (WHERE committees IS NOT NULL)), '##') AS committees FROM (SELECT DISTINCT * FROM board_members) WHERE trim(name) <> '' GROUP BY 1, 2""")
def merged_directors(s, p):
    t = table(s, p, "board_members").distinct().where("trim(name) <> ''").withColumn("person", F.lower(F.trim("name")))
    m = merged_members(t, ["company_id", "person"])
    committees = F.when(F.size("committees") > 0, F.array_join("committees", "##"))
    return m.select("company_id", "person", "n_rows", "bio", "is_independent", "tenure_years", committees.alias("committees"))


@query("""WITH j AS (SELECT company_id, job_title AS title, CASE WHEN regexp_matches(lower(job_title), 'senior|lead|head|manager|director') THEN 'senior' ELSE 'other' END AS level FROM (SELECT DISTINCT * FROM glassdoor_reviews) WHERE job_title IS NOT NULL),
g AS (SELECT company_id, count(*) AS n, count(CASE WHEN level = 'senior' THEN 1 END) AS senior, count(DISTINCT title) AS skills FROM j GROUP BY 1)
SELECT company_id, n, round(least(1, greatest(0, 0.4::double * senior / n + 0.3::double * least(1, 1 / (sqrt(n) + 0.1::double)) + 0.2::double * greatest(0, 1 - skills / 15))), 6) AS concentration FROM g""")
def talent_concentration(s, p):
    t = table(s, p, "glassdoor_reviews").where("job_title is not null").select("id", "company_id", F.col("job_title").alias("title"), F.when(F.lower("job_title").rlike("senior|lead|head|manager|director"), "senior").otherwise("other").alias("level")).distinct()
    return concentration(t, "company_id").select("company_id", "n", F.round("concentration", 6).alias("concentration"))


_CASE_WORDS = ("feature store", "cloud data", "cybersecurity", "vendor models", "annual budget", "blockchain")


@query(f"""WITH c AS (SELECT DISTINCT c.id, upper(trim(f.ticker)) AS ticker, c.content FROM document_chunks_sec c JOIN documents_sec f ON lower(trim(c.document_id)) = lower(trim(f.id)) WHERE trim(f.ticker) <> '' AND c.section = 'Item 1A'),
h AS (SELECT ticker, list_filter({_list(_CASE_WORDS)}, lambda w: contains(lower(content), w)) AS held FROM c), g AS (SELECT ticker, count(CASE WHEN len(held) > 0 THEN 1 END) AS matching, flatten(list(held)) AS found FROM h GROUP BY ticker)
SELECT ticker, matching, array_to_string(list_filter({_list(_CASE_WORDS)}, lambda w: NOT list_contains(found, w)), ',') AS gaps, CASE WHEN matching >= 2 THEN 'strong' ELSE 'moderate' END AS strength FROM g""")
def risk_justification(s, p):
    c = table(s, p, "document_chunks_sec").where("section = 'Item 1A'").select("id", text_key("document_id").alias("k"), "content")
    f = table(s, p, "documents_sec").where("trim(ticker) <> ''").select(text_key("id").alias("k"), upper_key("ticker").alias("ticker")).distinct()
    passages = c.join(f, "k").select("id", "ticker", "content").distinct().withColumn("confidence", F.lit(0.85))
    return justification(passages, ["ticker"], _CASE_WORDS)


@query("""SELECT least(floor(word_count / 250) * 250, 2000)::bigint AS bucket, count(*) AS n FROM (SELECT DISTINCT id, word_count FROM documents_sec) WHERE word_count IS NOT NULL GROUP BY 1""")
def filing_lengths(s, p):
    t = table(s, p, "documents_sec").where("word_count is not null").select("id", "word_count").distinct()
    return t.groupBy(F.least(F.floor(F.col("word_count") / 250) * 250, F.lit(2000)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT dimension, round(avg(least(75 + 5, 100) - score::double), 6) AS gap, count(CASE WHEN 80 - score > 20 THEN 1 END) AS high, count(CASE WHEN 80 - score > 10 AND 80 - score <= 20 THEN 1 END) AS medium FROM (SELECT DISTINCT id, lower(dimension) AS dimension, score FROM dimension_scores) WHERE score IS NOT NULL GROUP BY 1""")
def dimension_gaps(s, p):
    t = table(s, p, "dimension_scores").where("score is not null").select("id", F.lower("dimension").alias("dimension"), (80 - d("score")).alias("gap")).distinct()
    return t.groupBy("dimension").agg(F.round(F.avg("gap"), 6).alias("gap"), F.count_if(F.col("gap") > 20).alias("high"), F.count_if((F.col("gap") > 10) & (F.col("gap") <= 20)).alias("medium"))
