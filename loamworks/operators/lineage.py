"""Cutting lineage, and joins whose broadcast side is checked first."""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read from there.

    The folder is spark.checkpoint.dir of the session. Where that is unset, a session on one machine, as in tests, uses a
    temporary folder; on a cluster that is an error, as executors do not share one.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loamworks-checkpoint-"))
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else unchanged (the join then shuffles).

    The rows are counted by a job of their own, so pass only cheap plans: scans, or what ``cut`` returned.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it comes in far fewer partitions, as a small file does; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
