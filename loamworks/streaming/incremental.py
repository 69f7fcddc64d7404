"""Evidence that arrives over time: idempotent ingest, windows and an index that grows by what it lacks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter


def new_records(stream: DataFrame, time_col: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The stream without records whose keys came before within ``delay`` of event time."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_signals(stream: DataFrame, time_col: str, key: str, value: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and means per key and window; records later than ``delay`` are left out."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "45 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key: records no further apart than ``gap``."""
    return stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


#: Parts of an index by the hash of its keys.
PARTS = 256


def grow_index(stream: DataFrame, path: str, key: str, parts: int = PARTS) -> DataStreamWriter:
    """A writer that appends to the table at ``path`` the records of each batch whose keys it lacks; a repeated batch adds nothing.

    The table is partitioned by the hash of the key (column ``part``), and a batch reads the keys of its own parts only.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(there):
            touched = [r["part"] for r in once.select("part").distinct().collect()]  # at most so many parts
            once = once.join(spark.read.parquet(path).where(F.col("part").isin(touched)).select("part", key), ["part", key], "left_anti")
        once.write.mode("append").partitionBy("part").parquet(path)

    return stream.writeStream.foreachBatch(add)
