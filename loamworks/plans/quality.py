"""Queries of the general data-quality problems: references (3) and packed fields (6)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.operators.packed import PackedField, segment_dictionary, unpack
from loamworks.operators.references import Reference, orphan_report, orphans
from loamworks.sources import table

LINKS = [
    ("dimension_scores", "assessment_id", "assessments"),
    ("board_members", "governance_signal_id", "board_governance_signals"),
    ("glassdoor_reviews", "culture_signal_id", "culture_signals"),
    ("document_chunks_sec", "document_id", "documents_sec"),
]
PACKED = [
    PackedField("board_members", "committees"),
    PackedField("culture_signals", "positive_keywords_found"),
    PackedField("culture_signals", "negative_keywords_found"),
    PackedField("board_governance_signals", "ai_experts", names=True),
]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return orphans([Reference(child, t(child), ref, parent, t(parent)) for child, ref, parent in LINKS], t("deleted_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id", "reason")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {f.table_name: table(spark, sf_dir, f.table_name) for f in PACKED}
    return unpack(fields, PACKED).where("n_items >= 2").select("table_name", "row_id", "field_name", F.col("pos").cast("bigint").alias("pos"), "item")


def p6_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {f.table_name: table(spark, sf_dir, f.table_name) for f in PACKED}
    return segment_dictionary(fields, PACKED)


_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
_CHILD = " UNION ALL ".join(f"SELECT '{c}' AS table_name, id AS row_id, created_at, '{p}' AS parent_table, {_KEY.format(r)} AS k FROM {c}" for c, r, p in LINKS)
_PARENT = " UNION ALL ".join(f"SELECT '{p}' AS parent_table, {_KEY.format('id')} AS k, min(created_at) AS born FROM {p} GROUP BY ALL" for _, _, p in LINKS)
_ORPHANS = f"""
WITH c AS ({_CHILD}), p AS ({_PARENT}), d AS (SELECT DISTINCT lower(trim(table_name)) AS parent_table, {_KEY.format('record_id')} AS k FROM deleted_records),
f AS (
  SELECT DISTINCT c.table_name, c.row_id, c.created_at, CASE WHEN p.k IS NULL AND d.k IS NULL THEN 'missing' WHEN p.k IS NULL THEN 'deleted' WHEN p.born > c.created_at THEN 'late' END AS reason
  FROM c LEFT JOIN p ON p.parent_table = c.parent_table AND p.k = c.k LEFT JOIN d ON d.parent_table = c.parent_table AND d.k = c.k
  WHERE c.k IS NOT NULL)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p6_found": p6_found, "p6_dictionary": p6_dictionary}
SQL = {
    "p3_found": _ORPHANS + "SELECT table_name, row_id, reason FROM f WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_report": _ORPHANS + "SELECT table_name, strftime(created_at, '%Y-%m') AS month, reason, count(*) AS n_rows FROM f WHERE reason IS NOT NULL GROUP BY ALL",
}
