"""Queries of the training-text problems."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import furniture, language, leaks, mixing, names, pii, quality
from loamworks.sources import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.repeated_lines(table(spark, sf_dir, "document_chunks_sec"), table(spark, sf_dir, "documents_sec"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "document_chunks_sec")
    return furniture.without_lines(chunks, furniture.repeated_lines(chunks, table(spark, sf_dir, "documents_sec")))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.line_clusters(table(spark, sf_dir, "document_chunks_sec"), table(spark, sf_dir, "documents_sec"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(table(spark, sf_dir, "board_members"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seat and its entity."""
    return names.entities(table(spark, sf_dir, "board_members")).select("member_id", "entity")


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity, its seats and spellings."""
    seats = names.entities(table(spark, sf_dir, "board_members"))
    return seats.groupBy("entity").agg(F.count("*").alias("n_seats"), F.countDistinct("name").alias("n_spellings"))


FREE_TEXT = ("pros", "cons", "advice_to_management")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.learn_and_find(table(spark, sf_dir, "glassdoor_reviews"), FREE_TEXT)


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "glassdoor_reviews")
    return pii.redact(reviews, pii.fit(reviews, FREE_TEXT), FREE_TEXT)


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "document_chunks_sec")
    return quality.text_statistics(chunks, furniture.repeated_lines(chunks, table(spark, sf_dir, "documents_sec")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings(_statistics(spark, sf_dir))


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts among the statistics, which need no furniture."""
    return quality.text_statistics(table(spark, sf_dir, "document_chunks_sec")).select("chunk_id", F.coalesce(F.col("stored_word_count").cast("string"), F.lit("")).alias("stored_word_count"), "n_chars", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"))


def p5_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each chunk, the share of them that end in punctuation, and the share of signs among its characters."""
    stats = quality.text_statistics(table(spark, sf_dir, "document_chunks_sec"))
    return stats.select("chunk_id", "n_lines", F.round("punctuated_line_share", 6).alias("punctuated_line_share"), F.round("symbol_ratio", 6).alias("symbol_ratio"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, the documents it leaked into and its longest passage."""
    spans = leaks.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


def tokenizer(spark: SparkSession) -> str:
    """The file of the public tokenizer: spark.loamworks.tokenizer of the session, else where this project's machines keep it."""
    return spark.conf.get("spark.loamworks.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), tokenizer(spark))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_targets")
    return mixing.mixture_shares(mixing.mixture(table(spark, sf_dir, "documents"), targets, tokenizer(spark)), targets)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.language_passages(documents, language.fit(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_faults(_passages(spark, sf_dir))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).drop("label")


_LINES = r"""
WITH d AS (SELECT DISTINCT lower(trim(id)) AS doc, upper(trim(ticker)) AS site FROM documents_sec WHERE trim(ticker) <> ''),
c AS (SELECT DISTINCT id, lower(trim(document_id)) AS doc, content FROM document_chunks_sec WHERE content IS NOT NULL),
s AS (SELECT c.id, d.doc, d.site, string_split(c.content, chr(10)) AS lines FROM c JOIN d ON c.doc = d.doc),
l AS (SELECT id, doc, site, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM s),
k AS (SELECT id, doc, site, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM l),
h AS (SELECT site, k FROM k WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT doc) >= 4)
"""

QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_members": p2_members, "p2_entities": p2_entities, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_statistics": p5_statistics, "p5_counts": p5_counts, "p5_ratios": p5_ratios, "p7_found": p7_found, "p7_items": p7_items, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_passages": p9_passages}
SQL = {
    "p1_found": _LINES + "SELECT DISTINCT id AS chunk_id, line_no FROM k JOIN h USING (site, k)",
    "p1_clean": _LINES + """, g AS (SELECT DISTINCT id, line_no FROM k JOIN h USING (site, k)), a AS (SELECT DISTINCT id, string_split(content, chr(10)) AS lines FROM document_chunks_sec),
u AS (SELECT id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM a), m AS (SELECT u.id, string_agg(line, chr(10) ORDER BY u.line_no) FILTER (WHERE g.id IS NULL) AS content, count(g.id) AS n FROM u LEFT JOIN g ON u.id = g.id AND u.line_no = g.line_no GROUP BY u.id)
SELECT a.id AS chunk_id, CASE WHEN a.lines IS NOT NULL THEN coalesce(m.content, '') END AS content, coalesce(m.n, 0) AS n_removed FROM a LEFT JOIN m ON m.id = a.id""",
    "p5_counts": r"""
WITH c AS (SELECT DISTINCT id, coalesce(content, '') AS t, word_count FROM document_chunks_sec), w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda x: x <> '') AS w FROM c)
SELECT id AS chunk_id, coalesce(word_count::varchar, '') AS stored_word_count, length(t)::bigint AS n_chars, len(w)::bigint AS n_words, round(length(array_to_string(w, '')) / nullif(len(w), 0), 6) AS mean_word_length FROM w""",
    "p5_ratios": r"""
WITH c AS (SELECT DISTINCT id, coalesce(content, '') AS t FROM document_chunks_sec), l AS (SELECT id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+', '', 'g')), lambda x: x <> '') AS l FROM c)
SELECT id AS chunk_id, len(l)::bigint AS n_lines, round(len(list_filter(l, lambda x: x[-1] IN ('.', '!', '?', ';', ':'))) / nullif(len(l), 0), 6) AS punctuated_line_share, round((length(array_to_string(l, '')) - length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g'))) / nullif(length(array_to_string(l, '')), 0), 6) AS symbol_ratio FROM l""",
    "p7_items": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)), ig AS (SELECT item_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
m AS (SELECT DISTINCT doc_id, item_id, dg.k - ig.k AS diagonal, ig.k AS k FROM dg JOIN ig USING (g)), r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS island FROM m), s AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM r GROUP BY doc_id, item_id, diagonal, island)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n) AS longest FROM s GROUP BY item_id""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)), ig AS (SELECT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
