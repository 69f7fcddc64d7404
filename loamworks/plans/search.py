"""Queries over retrieval: both ranked lists fused, citations, rubric scores and the routes of evidence."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions import lexicons as L
from loamworks.functions import signal_words as S
from loamworks.functions.keys import text_key, upper_key
from loamworks.functions.text import filing_form
from loamworks.operators.evidence import BANDS, cited, rubric_scored
from loamworks.operators.ranking import reciprocal_rank_fusion
from loamworks.operators.retrieval import bm25_top, cosine_top
from loamworks.plans.analytics import _BM25
from loamworks.plans.relational import _EVIDENCE, evidence
from loamworks.plans.signals import _BROAD, _n
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


# The embedding of a document, or of an item that is searched for, is the one whose number is its id.
_DENSE = """v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), dd AS (SELECT d.doc_id, v.e FROM documents d JOIN v ON v.vec_id = d.doc_id WHERE d.lang = 'en'), dq AS (SELECT item_id AS query_id, v.e FROM eval_items JOIN v ON v.vec_id = item_id WHERE item_id % 50 = 0),
ds AS (SELECT query_id, doc_id, list_cosine_similarity(dq.e, dd.e) AS score FROM dq JOIN dd ON doc_id <> query_id), dr AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM ds) WHERE rank <= 20)"""


@query(_BM25 + f""", {_DENSE}, sr AS (SELECT query_id, doc_id, rank FROM b JOIN documents USING (doc_id) WHERE rank <= 20 AND lang = 'en'), u AS (SELECT query_id, doc_id, 0.6::double / (60 + rank) AS x FROM dr UNION ALL SELECT query_id, doc_id, 0.4::double / (60 + rank) FROM sr)
SELECT query_id, doc_id, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS place FROM (SELECT query_id, doc_id, sum(x) AS score FROM u GROUP BY ALL)) WHERE place <= 10""")
def hybrid_top10(s, p):
    """The ten best documents in English of each searched item: the dense list, filtered before it is ranked, and the BM25 list, filtered after, fused by their ranks."""
    docs, items, v = table(s, p, "documents"), table(s, p, "eval_items").where("item_id % 50 = 0"), table(s, p, "embeddings")
    english = docs.where("lang = 'en'").select("doc_id")
    of_docs = v.join(english, v.vec_id == english.doc_id).select("vec_id", "embedding")
    of_items = v.join(items, v.vec_id == items.item_id).select("vec_id", "embedding")
    dense = cosine_top(of_docs, of_items, 20).select("query_id", F.col("id").alias("doc_id"), "rank")
    sparse = bm25_top(docs, items.select(F.col("item_id").alias("query_id"), "text"), 20).join(english, "doc_id").select("query_id", "doc_id", "rank")
    fused = reciprocal_rank_fusion([(dense, 0.6), (sparse, 0.4)], ["query_id", "doc_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
    return fused.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 10").withColumn("score", F.round("score", 9))


_KEYWORDS = ("data platform", "machine learning pilots", "cloud infrastructure", "governance policy", "feature store", "model risk")
_MATCHED = " + ".join(f"({_n('lower(content)', w.split())} > 0)::int" for w in _KEYWORDS)
_CITED = f"""WITH c AS (SELECT DISTINCT c.id, f.ticker, left(c.content, 200) AS start, ({_MATCHED})::bigint AS n FROM document_chunks_sec c JOIN (SELECT DISTINCT lower(trim(id)) AS k, upper(trim(ticker)) AS ticker FROM documents_sec WHERE trim(ticker) <> '') f ON lower(trim(c.document_id)) = f.k WHERE c.content IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker, start ORDER BY n DESC, id) AS r FROM c WHERE n > 0), k AS (SELECT ticker, id, n AS n_matched, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, id) AS place FROM o WHERE r = 1)"""


def _cited(s, p):
    c = table(s, p, "document_chunks_sec").where("content is not null").select("id", text_key("document_id").alias("k"), "content")
    f = table(s, p, "documents_sec").where("trim(ticker) <> ''").select(text_key("id").alias("k"), upper_key("ticker").alias("ticker")).distinct()
    return cited(c.join(f, "k"), ["ticker"], _KEYWORDS, "id")


@query(_CITED + " SELECT ticker, id, n_matched, place FROM k WHERE place <= 5")
def cited_passages(s, p):
    """The five passages of each ticker that match most keywords, texts that start alike once."""
    return _cited(s, p)


@query(_CITED + """, g AS (SELECT ticker, avg(n_matched) AS m FROM k WHERE place <= 5 GROUP BY ticker), s AS (SELECT CASE WHEN m >= 2 THEN 3 ELSE 2 END AS x FROM g)
SELECT count(*) AS tickers, count(CASE WHEN x = 3 THEN 1 END) AS strong, CASE WHEN avg(x) >= 2.5 THEN 'strong' WHEN avg(x) >= 1.5 THEN 'moderate' ELSE 'weak' END AS strength FROM s""")
def cited_strength(s, p):
    """How strong the cases of all tickers are: strong where the cited passages, of confidence 0.85, match two keywords on average."""
    g = _cited(s, p).groupBy("ticker").agg(F.avg("n_matched").alias("m")).select(F.when(F.col("m") >= 2, 3).otherwise(2).alias("x"))
    label = F.when(F.avg("x") >= 2.5, "strong").when(F.avg("x") >= 1.5, "moderate").otherwise("weak")
    return g.agg(F.count("*").alias("tickers"), F.count_if(F.col("x") == 3).alias("strong"), label.alias("strength"))


_HITS = {n: " + ".join(f"regexp_matches(t, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')::int" for w in words) for n, words in L.RUBRIC.items()}
_IN_BAND = " ".join(
    f"WHEN k{n} >= {L.RUBRIC_LEAST[n]} THEN least({BANDS[n][1]}, greatest({BANDS[n][0]}, {BANDS[n][0]} + {BANDS[n][1] - BANDS[n][0]} * " + (f"(k{n} - {L.RUBRIC_LEAST[n]})::double / {len(L.RUBRIC[n]) - L.RUBRIC_LEAST[n]}" if len(L.RUBRIC[n]) > L.RUBRIC_LEAST[n] else "0.5::double") + "))"
    for n in sorted(L.RUBRIC, reverse=True)
)
_LEVELS = lambda of, other: "CASE " + " ".join(f"WHEN k{n} >= {L.RUBRIC_LEAST[n]} THEN {of(n)}" for n in sorted(L.RUBRIC, reverse=True)) + f" ELSE {other} END"


@query(f"""WITH c AS (SELECT DISTINCT id, lower(content) AS t, length(content) AS n FROM document_chunks_sec WHERE content IS NOT NULL), h AS (SELECT id, n, {_n("t", S.BROAD_TERMS)} AS b, {", ".join(f"{x} AS k{n}" for n, x in _HITS.items())} FROM c), k AS (SELECT *, {_BROAD("b")} AS broad, {_LEVELS(lambda n: f"k{n}", 0)} AS found, {_LEVELS(lambda n: n, 0)} AS fit FROM h)
SELECT id, (CASE WHEN fit > 0 THEN fit WHEN broad >= 40 THEN 3 ELSE 1 END)::bigint AS level, round((CASE {_IN_BAND} WHEN broad >= 40 THEN broad ELSE 15 END)::double, 6) AS score, found::bigint AS found,
round(CASE WHEN fit > 0 THEN least(1, greatest(0.3, CASE WHEN found >= 5 THEN 0.9 WHEN found >= 3 THEN 0.75 WHEN found >= 2 THEN 0.65 ELSE 0.5 END::double * CASE WHEN n > 10000 THEN 1.1 WHEN n < 1000 THEN 0.9 ELSE 1.0 END::double)) WHEN broad >= 40 THEN 0.5 ELSE 0.3 END::double, 6) AS confidence FROM k""")
def rubric_scores(s, p):
    """Each chunk's level, score within the level, keywords found and confidence; where no level fits, the score of its broad terms."""
    t = rubric_scored(table(s, p, "document_chunks_sec").where("content is not null").select("id", "content"), "content", L.RUBRIC, L.RUBRIC_LEAST)
    return t.select("id", "level", F.round("score", 6).alias("score"), "found", F.round("confidence", 6).alias("confidence")).distinct()


_ROUTES = {"sec_filing": "digital_presence", "employee_review": "glassdoor_reviews", "board_composition": "board_composition"}
_ROUTE_CASE = "CASE source_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ROUTES.items()) + " END"
_ROUTE_ROWS = ", ".join(f"('{c}', '{x}', {w}::double)" for c in _ROUTES.values() for x, w in S.EVIDENCE_WEIGHTS[c][0].items())


@query(f"""WITH w(category, dimension, weight) AS (VALUES {_ROUTE_ROWS}), e AS (SELECT ticker, {_ROUTE_CASE} AS category, count(*) AS n FROM ({_EVIDENCE}) GROUP BY ALL), r AS (SELECT ticker, dimension, sum(n * weight) AS weight FROM e JOIN w USING (category) WHERE ticker <> '' GROUP BY ALL)
SELECT ticker, dimension, round(weight, 6) AS weight, row_number() OVER (PARTITION BY ticker ORDER BY round(weight, 6) DESC, dimension) AS place FROM r""")
def evidence_routes(s, p):
    """The dimensions that the evidence of a ticker speaks for, by category, the heaviest first."""
    route = F.create_map(*[F.lit(x) for pair in _ROUTES.items() for x in pair])
    w = s.createDataFrame([(c, x, v) for c in _ROUTES.values() for x, v in S.EVIDENCE_WEIGHTS[c][0].items()], "category string, dimension string, weight double")
    e = evidence(s, p).where("ticker <> ''").groupBy("ticker", route[F.col("source_type")].alias("category")).agg(F.count("*").alias("n"))
    r = e.join(F.broadcast(w), "category").groupBy("ticker", "dimension").agg(F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("weight"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("weight"), "dimension")).cast("bigint"))


@query("""WITH f AS (SELECT DISTINCT id, upper(regexp_replace(filing_type, '[\\s-]+', '', 'g')) AS form FROM documents_sec WHERE filing_type IS NOT NULL) SELECT form, count(*) AS total, ceil(count(*) / 20)::bigint AS pages FROM f GROUP BY form""")
def filing_pages(s, p):
    """How many filings of each form there are, and how many pages of 20 they fill."""
    t = table(s, p, "documents_sec").where("filing_type is not null").select("id", filing_form(F.col("filing_type")).alias("form")).distinct()
    return t.groupBy("form").agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / 20).cast("bigint"))


@query("""WITH a AS (SELECT DISTINCT id, company_id, assessment_date, v_r_score::double AS v FROM assessments WHERE v_r_score IS NOT NULL AND assessment_date IS NOT NULL), c AS (SELECT company_id, min(upper(trim(ticker))) AS ticker FROM culture_signals WHERE trim(ticker) <> '' GROUP BY 1),
e AS (SELECT ticker, count(*) AS n FROM (SELECT * FROM (""" + _EVIDENCE + """)) GROUP BY ticker), f AS (SELECT upper(trim(ticker)) AS ticker, count(DISTINCT id) AS n FROM documents_sec WHERE trim(ticker) <> '' GROUP BY 1), g AS (SELECT company_id, count(*) AS n, arg_min(v, (assessment_date, id)) AS entry, arg_max(v, (assessment_date, id)) AS current FROM a GROUP BY company_id)
SELECT c.ticker, g.n AS assessments, g.entry AS entry_score, g.current AS current_score, round(g.current - g.entry, 6) AS delta, coalesce(e.n, 0) AS evidence, coalesce(f.n, 0) AS filings FROM g JOIN c USING (company_id) LEFT JOIN e ON e.ticker = c.ticker LEFT JOIN f ON f.ticker = c.ticker""")
def portfolio_view(s, p):
    """Of each company its first and newest score, and how much evidence and how many filings it has."""
    a = table(s, p, "assessments").where("v_r_score is not null and assessment_date is not null").select("id", "company_id", "assessment_date", F.col("v_r_score").cast("double").alias("v")).distinct()
    at = F.struct("assessment_date", "id")
    g = a.groupBy("company_id").agg(F.count("*").alias("assessments"), F.min_by("v", at).alias("entry_score"), F.max_by("v", at).alias("current_score"))
    c = table(s, p, "culture_signals").where("trim(ticker) <> ''").groupBy("company_id").agg(F.min(upper_key("ticker")).alias("ticker"))
    e = evidence(s, p).groupBy("ticker").agg(F.count("*").alias("evidence"))
    f = table(s, p, "documents_sec").where("trim(ticker) <> ''").groupBy(upper_key("ticker").alias("ticker")).agg(F.countDistinct("id").alias("filings"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return g.join(c, "company_id").join(e, "ticker", "left").join(f, "ticker", "left").select("ticker", "assessments", "entry_score", "current_score", F.round(F.col("current_score") - F.col("entry_score"), 6).alias("delta"), zero("evidence"), zero("filings"))


@query("""SELECT company_id, initcap_name AS dimension, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT DISTINCT s.id, a.company_id, array_to_string(list_transform(string_split(lower(s.dimension), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS initcap_name, s.score::double AS x FROM dimension_scores s
JOIN (SELECT DISTINCT lower(trim(id)) AS k, company_id FROM assessments) a ON lower(trim(s.assessment_id)) = a.k WHERE s.score IS NOT NULL AND s.dimension IS NOT NULL) GROUP BY ALL""")
def dimension_heatmap(s, p):
    """The mean score of each company and dimension, by the dimension's title."""
    r = table(s, p, "dimension_scores").where("score is not null and dimension is not null").select("id", text_key("assessment_id").alias("k"), F.initcap(F.translate("dimension", "_", " ")).alias("dimension"), F.col("score").cast("double").alias("x")).distinct()
    a = table(s, p, "assessments").select(text_key("id").alias("k"), "company_id").distinct()
    return r.join(a, "k").groupBy("company_id", "dimension").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT 'assessments' AS source, DISTINCT_id AS id, 'v_r_score' AS field, v::double AS value FROM (SELECT DISTINCT id AS DISTINCT_id, v_r_score AS v FROM assessments) WHERE v NOT BETWEEN 45 AND 80
UNION ALL SELECT 'dimension_scores', id, 'weight', w::double FROM (SELECT DISTINCT id, weight AS w FROM dimension_scores) WHERE w NOT BETWEEN 0.1 AND 0.2 UNION ALL SELECT 'culture_signals', id, 'review_count', n::double FROM (SELECT DISTINCT id, review_count AS n FROM culture_signals) WHERE n < 1) SELECT source, field, count(*) AS n, min(value) AS least, max(value) AS most FROM r GROUP BY ALL""")
def range_violations(s, p):
    """How many values of each checked field lie out of its range, and the extremes; nulls do not count."""
    checks = [("assessments", "v_r_score", 45, 80), ("dimension_scores", "weight", 0.1, 0.2), ("culture_signals", "review_count", 1, None)]
    out = None
    for t, c, low, high in checks:
        x = F.col(c).cast("double")
        bad = (x < low) if high is None else (x < low) | (x > high)
        part = table(s, p, t).where(bad).select("id", x.alias("x")).distinct().groupBy(F.lit(t).alias("source"), F.lit(c).alias("field")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        out = part if out is None else out.unionByName(part)
    return out


_DROP = "(?i)^(?:" + "|".join(L.LINE_STARTS) + ")|" + "|".join(x.replace(".", "\\.") for x in L.LINE_MARKS) + "|taxonomy.*extension"
_COUNT = lambda x: f"(length(x) - length(regexp_replace(x, '{x}', '', 'g')))"
_UNBLOCKED = r"regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '(?msi)^[ \t]*begin\s+\d{3}\s+[^\n]+\n.*?(?:^[ \t]*end[ \t]*$|\z)', '', 'g')"


@query(f"""SELECT DISTINCT id, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split({_UNBLOCKED}, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x = '' OR NOT (regexp_matches(x, '{_DROP}') OR (length(x) >= 10 AND {_COUNT(chr(92) + "p{L}")} < 0.20::double * length(x) AND NOT regexp_matches(x, '^(http|www|//)'))
OR (length(x) >= 60 AND {_COUNT("[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "s]")} > 0.35::double * length(x)) OR (length(x) >= 20 AND {_COUNT("[()]")} > 0.3::double * length(x)) OR regexp_matches(x, '^M[\x20-\x7E]{{55,}}$'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS content FROM document_chunks_sec WHERE content IS NOT NULL""")
def narrative_chunks(s, p):
    """The chunks without the lines that are no narrative."""
    from loamworks.operators.documents import narrative_lines

    return table(s, p, "document_chunks_sec").where("content is not null").select("id", narrative_lines(F.col("content")).alias("content")).dropDuplicates(["id"])


@query()
def section_chunks(s, p):
    """The chunks of the corpus's filings by section; which form a text is of stands in no table, so all are read as 10-K."""
    from loamworks.operators.documents import filing_chunks

    return filing_chunks(table(s, p, "documents").where("doc_type = 'filing'").withColumn("form", F.lit("10K")), 120, 240, 15)
