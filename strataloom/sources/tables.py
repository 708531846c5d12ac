"""Readers of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``knowledge`` with one row per record: repeated deliveries are unchanged rows, so any of them serves.

    ``columns`` prunes the scan; ``id`` is always there, spelled as a lower-case UUID. Rows whose id is
    no UUID name no record and are left out.
    """
    k = table(spark, sf_dir, "knowledge")
    keep = [c for c in (columns or k.columns) if c != "id"]
    return one_per_id(k.select(uuid_of("id").alias("id"), *keep))


def one_per_id(rows: DataFrame) -> DataFrame:
    """First row per ``id``, as an aggregate (combined before the shuffle), null ids dropped."""
    rest = [c for c in rows.columns if c != "id"]
    rows = rows.filter(F.col("id").isNotNull())
    if not rest:
        return rows.distinct()
    return rows.groupBy("id").agg(*[F.first(F.struct(*rest)).alias("_r")]).select("id", "_r.*")
