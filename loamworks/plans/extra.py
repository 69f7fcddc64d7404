"""Further queries: as-of joins, grouping sets, set operations, extraction and overlap."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions.keys import text_key
from loamworks.operators.asof import as_of
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


@query("""WITH r AS (SELECT DISTINCT id, company_id, created_at FROM glassdoor_reviews WHERE company_id IS NOT NULL AND created_at IS NOT NULL), c AS (SELECT company_id, created_at, max(overall_score)::double AS overall_score FROM culture_signals WHERE created_at IS NOT NULL GROUP BY ALL)
SELECT r.id, c.overall_score FROM r ASOF LEFT JOIN c ON r.company_id = c.company_id AND r.created_at >= c.created_at""")
def culture_at_review(s, p):
    r = table(s, p, "glassdoor_reviews").where("company_id is not null and created_at is not null").select("id", "company_id", "created_at").distinct()
    c = table(s, p, "culture_signals").where("created_at is not null").groupBy("company_id", "created_at").agg(F.max(d("overall_score")).alias("overall_score"))
    return as_of(r, c, "company_id", "created_at", ["overall_score"]).select("id", "overall_score")


@query("""SELECT company_id, current, count(*) AS n FROM (SELECT DISTINCT id, company_id, is_current_employee::varchar AS current FROM glassdoor_reviews) GROUP BY CUBE (company_id, current)""")
def review_cube(s, p):
    t = table(s, p, "glassdoor_reviews").select("id", "company_id", F.col("is_current_employee").cast("string").alias("current")).distinct()
    return t.cube("company_id", "current").agg(F.count("*").alias("n"))


@query("""SELECT company_id, round(quantile_cont(rating::double, 0.5), 6) AS median, round(quantile_cont(rating::double, 0.9), 6) AS p90, round(stddev_pop(rating::double), 6) AS spread FROM (SELECT DISTINCT id, company_id, rating FROM glassdoor_reviews) WHERE rating IS NOT NULL GROUP BY 1""")
def rating_quantiles(s, p):
    t = table(s, p, "glassdoor_reviews").where("rating is not null").select("id", "company_id", d("rating").alias("r")).distinct()
    return t.groupBy("company_id").agg(F.round(F.percentile("r", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("r", F.lit(0.9)), 6).alias("p90"), F.round(F.stddev_pop("r"), 6).alias("spread"))


@query("""(SELECT DISTINCT company_id FROM assessments INTERSECT SELECT DISTINCT company_id FROM culture_signals) EXCEPT SELECT company_id FROM board_governance_signals WHERE governance_score < 50""")
def well_governed_companies(s, p):
    of = lambda t: table(s, p, t).select("company_id")
    return of("assessments").intersect(of("culture_signals")).subtract(table(s, p, "board_governance_signals").where("governance_score < 50").select("company_id"))


@query("""SELECT id, regexp_replace(replace(local_path, 'data/raw', 'data/parsed'), '\\.txt$', '.json') AS parsed_path, sha256(concat_ws('|', coalesce(upper(trim(ticker)), ''), coalesce(content_hash, ''))) AS key FROM (SELECT DISTINCT id, local_path, ticker, content_hash FROM documents_sec)""")
def parsed_paths(s, p):
    t = table(s, p, "documents_sec").select("id", "local_path", "ticker", "content_hash").distinct()
    path = F.regexp_replace(F.replace("local_path", F.lit("data/raw"), F.lit("data/parsed")), r"\.txt$", ".json")
    return t.select("id", path.alias("parsed_path"), F.sha2(F.concat_ws("|", F.coalesce(F.upper(F.trim("ticker")), F.lit("")), F.coalesce("content_hash", F.lit(""))), 256).alias("key"))


@query("""WITH s AS (SELECT DISTINCT id, list_slice(list_filter(list_transform(regexp_split_to_array(content, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 20 AND length(x) < 500 AND (contains(lower(x), 'roadmap') OR contains(lower(x), 'governance policy'))), 1, 10) AS l
FROM document_chunks_sec WHERE content IS NOT NULL) SELECT id, len(l)::bigint AS n, array_to_string(l, '. ') AS sentences FROM s WHERE len(l) > 0""")
def strategy_sentences(s, p):
    t = table(s, p, "document_chunks_sec").where("content is not null")
    parts = F.transform(F.split("content", "[.!?]+"), lambda x: F.trim(x))
    fits = lambda x: (F.length(x) > 20) & (F.length(x) < 500) & (F.contains(F.lower(x), F.lit("roadmap")) | F.contains(F.lower(x), F.lit("governance policy")))
    return t.select("id", F.slice(F.filter(parts, fits), 1, 10).alias("l")).where("size(l) > 0").select("id", F.size("l").cast("bigint").alias("n"), F.array_join("l", ". ").alias("sentences")).distinct()


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ (?:Chief|Lead|committee|Committee)'))), '|') AS mentions FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[A-Z][a-z]+ (?:Chief|Lead|committee|Committee)')""")
def committee_mentions(s, p):
    t = table(s, p, "documents").where(F.col("text").rlike("[A-Z][a-z]+ (?:Chief|Lead|committee|Committee)"))
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ (?:Chief|Lead|committee|Committee)"), F.lit(0))
    return t.select("doc_id", F.array_join(F.sort_array(F.array_distinct(found)), "|").alias("mentions"))


@query("""WITH c AS (SELECT DISTINCT id, lower(trim(document_id)) AS doc, chunk_index, content FROM document_chunks_sec WHERE trim(document_id) <> ''), l AS (SELECT id, lag(content) OVER (PARTITION BY doc ORDER BY chunk_index, id) AS prev, lead(id) OVER (PARTITION BY doc ORDER BY chunk_index, id) AS next FROM c)
SELECT id, next, array_to_string(list_slice(w, greatest(len(w) - 9, 1), len(w)), ' ') AS overlap FROM (SELECT id, next, list_filter(regexp_split_to_array(prev, '\\s+'), lambda x: x <> '') AS w FROM l)""")
def chunk_overlaps(s, p):
    """Of each chunk, the last ten words of the one before, which its text would start with, and the chunk after it."""
    t = table(s, p, "document_chunks_sec").select("id", text_key("document_id").alias("doc"), "chunk_index", "content").where("doc is not null")
    words = F.filter(F.split("content", r"\s+"), lambda x: x != "")
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - 9, F.lit(1)), F.lit(10)), " ")
    t = t.select("id", "doc", "chunk_index", tail.alias("tail")).distinct()
    w = Window.partitionBy("doc").orderBy("chunk_index", "id")
    return t.select("id", F.lead("id").over(w).alias("next"), F.lag("tail").over(w).alias("overlap"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-06-01') SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers
FROM orders JOIN o ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1""")
def recent_orders(s, p):
    li = table(s, p, "lineitem").where("l_shipdate > timestamp_ntz'1996-06-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(s, p, "orders").where("o_orderstatus <> 'F'").join(li, "o_orderkey", "left_semi")
    c = table(s, p, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return o.join(c, "o_custkey").groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("customers"))
