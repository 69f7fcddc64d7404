"""Ranks, tops, running budgets and fusion of ranked lists."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def position_in_group(df: DataFrame, group: str, score: str, tie: str, parts: int = 100) -> DataFrame:
    """``df`` with ``pct``: the 1-based place after an ascending sort within the group, over the group's size; null scores come first.

    A group is cut into about ``parts`` ranges of scores at its approximate quantiles, each sorted by itself; a place is the
    count of the ranges before it and the place within. Null groups do not come out.
    """
    points = df.groupBy(group).agg(F.percentile_approx(score, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts).alias("_points"))
    placed = df.join(points, group).withColumn("_part", F.size(F.filter(F.coalesce("_points", F.array().cast("array<double>")), lambda x: x < F.col(score))))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    before = counts.select(group, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    inside = placed.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(score, tie)))
    return inside.join(before, [group, "_part"]).select(*df.columns, ((F.col("_before") + F.col("_place")) / F.col("_all")).alias("pct"))


def top_mean(df: DataFrame, keys: Sequence[str], score: str, n: int = 3) -> DataFrame:
    """The mean of the ``n`` largest scores per key. Only ``n`` values a task are kept: partial results are cut before they are merged."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    return df.where(F.col(score).isNotNull()).select(*keys, score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*keys).agg(F.avg(score).alias("top_mean"), F.count("*").alias("n"))


def running_budget(df: DataFrame, day: Column, order: Sequence[str], amount: str, limit: float) -> DataFrame:
    """``df`` with the amount spent so far on its day and whether the row is within the limit."""
    w = Window.partitionBy("_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = df.withColumn("_day", day).withColumn("spent", F.sum(amount).over(w))
    return spent.withColumn("within", F.col("spent") <= limit).drop("_day")


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, float]], keys: Sequence[str], k: int = 60) -> DataFrame:
    """(keys, score) of ranked lists (keys, rank), each with its weight: the sum of weight / (k + rank)."""
    both = None
    for df, weight in lists:
        part = df.select(*keys, (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(*keys).agg(F.sum("part").alias("score"))
