"""Parquet tables of one data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``; filters and columns are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
