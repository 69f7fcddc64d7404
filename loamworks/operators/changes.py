"""Changes to tables without a table format: each returns the table as it is after the change."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``updates`` in place of those of the same keys, and added where there are none."""
    return base.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def patch(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with the values of ``updates`` that are not null in the given columns."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(u, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def soft_delete(base: DataFrame, gone: Column, flag: str = "is_deleted") -> DataFrame:
    """``base`` with ``flag`` set where ``gone`` holds."""
    return base.withColumn(flag, F.coalesce(gone, F.lit(False)))


def delete_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` without the rows whose keys are in ``gone``."""
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def insert_absent(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and the rows of ``new`` whose keys it lacks, the first of each key by all columns."""
    fresh = new.join(base.select(*keys), list(keys), "left_anti").groupBy(*keys).agg(F.min(F.struct(*new.columns)).alias("row")).select("row.*")
    return base.unionByName(fresh.select(*base.columns))


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes ``df``, overwriting only the partitions it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """``df`` with defaults for nulls, as an insert fills them."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
