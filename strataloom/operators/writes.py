"""Writes as snapshot rewrites: each operator takes the table as it is and gives the table as it will be.

Plain parquet has no updates. The result is written to a new place and swapped in; the table being read is
never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, arrived: DataFrame, key: str, keep_if_null: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Rows of ``arrived`` replace rows of the same key; columns of ``keep_if_null`` keep the old value where the new is null.

    ``arrived`` has one row per key. Adds ``change``: ``inserted``, ``updated`` or ``kept``.
    """
    columns = [c for c in target.columns if c != key]
    new = arrived.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(new, key, "full")
    value = lambda c: F.coalesce(f"_n_{c}", c) if c in keep_if_null else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new"), "updated").otherwise("kept")
    return both.select(key, *[value(c).alias(c) for c in columns], change.alias("change"))


def insert_absent(target: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``arrived`` that an insert would add: keys the target lacks, one row per key (the first by all columns)."""
    rest = [c for c in arrived.columns if c not in keys]
    one = arrived.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else arrived.distinct()
    return one.join(target.select(*keys).distinct(), keys, "left_anti")


def count_seen(target: DataFrame, seen: DataFrame) -> DataFrame:
    """Counter upsert on ``key, n, first_s, last_s, raw``: counts add up, the bounds widen, the latest spelling stays."""
    both = target.unionByName(seen)
    return both.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.max_by("raw", F.struct("last_s", "raw")).alias("raw"))


def replace_children(target: DataFrame, arrived: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that ``arrived`` touches go, its rows come."""
    return target.join(arrived.select(parent).distinct(), parent, "left_anti").unionByName(arrived)


def mark(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Sets ``column`` where ``key`` is among ``keys``."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def unmarked(rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be delivered: rows whose keys no earlier delivery marked."""
    return rows.join(marks.select(*keys).distinct(), keys, "left_anti")


def unexpired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows whose time to live isn't over; a null never ends."""
    return rows.filter(F.col(expires).isNull() | (F.col(expires) > now))


def retained(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Flagged rows for ever, the others for ``days``."""
    return rows.filter(F.coalesce("flagged", F.lit(False)) | (F.unix_seconds(at) >= F.unix_seconds(now) - days * 86400))
