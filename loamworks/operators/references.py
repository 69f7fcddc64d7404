"""References to records that do not exist.

Children and parents are co-partitioned and sorted by (parent table, key) and merged in one pass: a sort-merge
join against the validity interval of each parent key, [born, died), which tells missing, deleted and late.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions.keys import text_key


@dataclass(frozen=True)
class Reference:
    """The column ``ref_col`` of ``child`` (rows ``id_col``, written at ``time_col``) names an id of ``parent``."""

    child_name: str
    child: DataFrame
    ref_col: str
    parent_name: str
    parent: DataFrame
    id_col: str = "id"
    time_col: str = "created_at"


def validity(references: Sequence[Reference], deleted: DataFrame) -> DataFrame:
    """One row per (parent_table, key): present, born (earliest created_at) and died (latest logged deletion)."""
    parents = {r.parent_name: r for r in references}
    sides = [
        r.parent.select(F.lit(name).alias("parent_table"), text_key(r.id_col).alias("key"), F.col(r.time_col).alias("born"), F.lit(None).cast("timestamp_ntz").alias("died"), F.lit(True).alias("present"))
        for name, r in parents.items()
    ]
    sides.append(deleted.select(F.lower(F.trim("table_name")).alias("parent_table"), text_key("record_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("born"), F.col("deleted_at").alias("died"), F.lit(False).alias("present")))
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    return both.where("key is not null").groupBy("parent_table", "key").agg(F.max("present").alias("present"), F.min("born").alias("born"), F.max("died").alias("died"))


def orphans(references: Sequence[Reference], deleted: DataFrame) -> DataFrame:
    """(table_name, row_id, reason, created_at) of each child row whose parent is ``missing``, ``deleted`` or ``late``.

    Keys are compared without regard to letter case and surrounding white space. Null and blank keys are no case;
    a restored parent (logged as deleted, but present) counts as present; a row or parent without a time is never
    late; rows that stand several times come out once. An empty parent table makes every reference missing.
    A hot key is split by the skew handling of the sort-merge join, as the parent side has one row a key.
    """
    rows = None
    for r in references:
        part = r.child.select(
            F.lit(r.child_name).alias("table_name"), F.col(r.id_col).cast("string").alias("row_id"), F.col(r.time_col).alias("created_at"), F.lit(r.parent_name).alias("parent_table"), text_key(r.ref_col).alias("key")
        ).where("key is not null")
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.join(validity(references, deleted).hint("merge"), ["parent_table", "key"], "left")
    reason = (
        F.when(F.coalesce("present", F.lit(False)), F.when(F.col("born") > F.col("created_at"), F.lit("late")))
        .when(F.col("died").isNotNull() | F.col("present").isNotNull(), F.lit("deleted"))
        .otherwise(F.lit("missing"))
    )
    return merged.select("table_name", "row_id", reason.alias("reason"), "created_at").where("reason is not null").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per child table, month of the row (null where it has no time) and reason."""
    return found.groupBy("table_name", F.date_format("created_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_rows"))
