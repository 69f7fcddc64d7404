"""Newest rows and batches per key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; end it with a unique column, so that ties have one outcome."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def once(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Each id once: rows that stand twice hold the same content."""
    return df.dropDuplicates([id_col])


def latest_batch(df: DataFrame, keys: Sequence[str], day: Column, stamp: str, minutes: int) -> DataFrame:
    """Of each key, the rows of its newest day that lie within ``minutes`` of its newest stamp there; rows without one only if no row has one.

    One row a key, with its newest day and stamp, is joined back, so that a hot key is not one task's. Null keys do not come out.
    """
    keyed = df.withColumn("_day", day)
    newest = keyed.groupBy(*keys).agg(F.max(F.struct("_day", F.col(stamp).alias("_last"))).alias("_new")).select(*keys, F.col("_new._day").alias("_newest"), F.col("_new._last").alias("_last"))
    near = F.unix_micros(F.to_timestamp(F.col("_last"))) - F.unix_micros(F.to_timestamp(F.col(stamp))) <= minutes * 60_000_000
    return keyed.join(newest, list(keys)).where(F.col("_day") == F.col("_newest")).where(F.col("_last").isNull() | near).select(*df.columns)


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of ``df`` that are not the first of their keys by ``order``, which ends with a unique column; nulls in ``order`` come last."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])).alias("_first")).select(*keys, F.col(f"_first.{order[-1]}").alias("_first"))
    return df.join(first, list(keys)).where(F.col(order[-1]) != F.col("_first")).select(*df.columns)


def trend(df: DataFrame, key: str, day: str, score: str, as_of: Column, band: float = 5.0) -> DataFrame:
    """Per key: first and last score, their difference and direction, and the change since the newest snapshot at least 30 and 90 days old."""
    age = F.datediff(as_of, F.col(day))
    old = lambda n: F.max_by(score, F.when(age >= n, F.col(day)))
    g = df.where(F.col(score).isNotNull() & (F.col(day) <= as_of)).groupBy(key).agg(F.count("*").alias("snapshots"), F.min_by(score, day).alias("entry_score"), F.max_by(score, day).alias("current_score"), old(30).alias("s30"), old(90).alias("s90"))
    delta = F.col("current_score") - F.col("entry_score")
    return g.select(
        key, "snapshots", "entry_score", "current_score", delta.alias("delta"), (F.col("current_score") - F.col("s30")).alias("delta_30d"), (F.col("current_score") - F.col("s90")).alias("delta_90d"),
        F.when(delta > band, "improving").when(delta < -band, "declining").otherwise("stable").alias("direction"),
    )
