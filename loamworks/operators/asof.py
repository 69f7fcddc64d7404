"""As-of join: to each row, the newest row of another table at or before its time."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], bucket: str = "month") -> DataFrame:
    """``left`` with the ``values`` of the newest row of ``right`` with the same key at or before its time; null where there is none.

    Both have the columns ``key`` and ``time``; of rows of ``right`` at the same time the greatest values count. The
    merge runs within (key, bucket of time), so that a hot key is many tasks; what holds at the start of a bucket is carried
    over from the key's earlier buckets, of which there is a row each. Rows of ``left`` without a key or time keep nulls.
    """
    held = F.struct(F.col(time).alias("_t"), *values).alias("_held")
    ups = right.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, time, held)
    none = F.lit(None).cast(ups.schema["_held"].dataType)
    at = F.date_trunc(bucket, F.col(time)).alias("_bucket")
    asks = left.withColumn("_held", none).withColumn("_ask", F.struct(*[F.col(c) for c in left.columns])).select(key, time, at, "_held", "_ask")
    ask_type = asks.schema["_ask"].dataType
    both = asks.unionByName(ups.select(key, time, at, "_held", F.lit(None).cast(ask_type).alias("_ask")))
    w = Window.partitionBy(key, "_bucket").orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.max("_held").over(w)).where("_ask is not null")
    last = both.groupBy(key, "_bucket").agg(F.max("_held").alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_bucket", F.max("_last").over(before).alias("_carried")).withColumnsRenamed({key: "_k", "_bucket": "_b"})
    joined = inside.join(carried, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left").withColumn("_held", F.coalesce("_in", "_carried"))
    return joined.select("_ask.*", *[F.when(F.col(f"_ask.{key}").isNotNull() & F.col(f"_ask.{time}").isNotNull(), F.col(f"_held.{v}")).alias(v) for v in values])
