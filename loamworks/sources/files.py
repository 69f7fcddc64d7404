"""Landed files: texts, JSON and result documents, plain or compressed."""

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files; .gz files are unpacked by their suffix."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON files, one document each, with a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def largest_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, path, length): the largest file of each folder, the first by path among equals; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    keyed = files.withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    return keyed.groupBy("folder").agg(F.min(F.struct((-F.col("length")).alias("n"), "path")).alias("m")).select("folder", F.col("m.path").alias("path"), (-F.col("m.n")).alias("length"))


def write_json(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df`` as compressed JSON, one folder per value of ``by``."""
    df.write.mode("overwrite").option("compression", "gzip").partitionBy(by).json(path)


def any_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of text files, unpacked where they start with the mark of gzip whatever they are called; bytes that are no UTF-8 are left out.

    An empty file gives no row, as in all file scans of Spark.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [gzip.decompress(x) if bytes(x[:2]) == b"\x1f\x8b" else bytes(x) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "content": [x.decode("utf-8", "ignore") for x in raw]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(read, "path string, content string")


def newest_files(spark: SparkSession, path: str, n: int, main: str = "full-submission.txt") -> DataFrame:
    """(folder, path): of each of the ``n`` folders that changed last, the file called ``main``, or else the largest; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    keyed = files.withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    rank = F.struct((~F.col("path").endswith(f"/{main}")).cast("int").alias("m"), (-F.col("length")).alias("n"), "path")
    folders = keyed.groupBy("folder").agg(F.max("modificationTime").alias("at"), F.min(rank)["path"].alias("path"))
    return folders.orderBy(F.desc("at"), "folder").limit(n).select("folder", "path")


def result_documents(spark: SparkSession, path: str, schema: StructType | str, score: str, glob: str = "*_result.json") -> DataFrame:
    """The JSON documents of a folder whose names fit ``glob``, the highest ``score`` first."""
    return spark.read.schema(schema).option("pathGlobFilter", glob).json(path, multiLine=True).orderBy(F.desc_nulls_last(score))


def cached_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(review_id, rating, title, pros, cons, review_date) of reviews kept as JSON arrays; dates in ISO form, null where they are not."""
    schema = "review_id string, rating double, title string, pros string, cons string, review_date string"
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("review_date", F.try_to_timestamp("review_date"))
