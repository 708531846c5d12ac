"""References to records that do not exist, were removed or came later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.ids import row_key, utc_month, uuid_of
from strataloom.operators.skew import hot_key_join
from strataloom.session import written

#: table, field, the column with the referring row's own time
FIELDS = (("knowledge", "supersedes_id", "created_at"), ("knowledge", "document_id", "created_at"), ("retirement_requests", "target_id", "requested_at"))


def references(tables: dict[str, DataFrame], fields=FIELDS) -> DataFrame:
    """One row per reference: ``table_name, field_name, row_id, ref, own_time``.

    A value that is no UUID is no reference. A row that was delivered several times refers once; should its
    deliveries differ in time, the earliest counts.
    """
    parts = [
        tables[t].select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), row_key("id").alias("row_id"), uuid_of(f).alias("ref"), F.col(at).alias("own_time"))
        for t, f, at in fields
    ]
    every = reduce(DataFrame.unionByName, parts).filter(F.col("ref").isNotNull())
    return every.groupBy("table_name", "field_name", "row_id", "ref").agg(F.min("own_time").alias("own_time"))


def broken_references(knowledge: DataFrame, requests: DataFrame) -> DataFrame:
    """References without a record (``missing``, ``deleted``) or older than their record (``late``).

    Distinct keys are compared with the records by a left anti join, and what is left is joined back to the
    references. One target may hold a third of all references: distinct keys are formed before the shuffle,
    and the joins back salt hot keys. Adds ``kind`` and ``period`` (month of the own time, null where that is null).
    """
    refs = written(references({"knowledge": knowledge, "retirement_requests": requests}), "references")  # read four times
    record = knowledge.select(uuid_of("id").alias("ref"), "created_at").filter(F.col("ref").isNotNull())
    record = record.groupBy("ref").agg(F.min("created_at").alias("came_at"))
    removed = (
        requests.filter((F.lower(F.trim("method")) == "delete") & (F.lower(F.trim("status")) == "executed"))
        .select(uuid_of("target_id").alias("ref"))
        .filter(F.col("ref").isNotNull())
        .distinct()
        .withColumn("kind", F.lit("deleted"))
    )
    orphans = refs.select("ref").distinct().join(record.select("ref"), "ref", "left_anti")
    orphans = orphans.join(removed, "ref", "left").withColumn("kind", F.coalesce("kind", F.lit("missing")))
    absent = orphans.withColumn("came_at", F.lit(None).cast("timestamp"))
    present = record.withColumn("kind", F.lit("late"))
    found = hot_key_join(refs, absent.unionByName(present), "ref", F.col("row_id"))
    found = found.filter((F.col("kind") != "late") | (F.col("came_at") > F.col("own_time")))
    return found.select("table_name", "field_name", "row_id", "ref", "kind", utc_month(F.col("own_time")).alias("period"))


def broken_reference_report(knowledge: DataFrame, requests: DataFrame) -> DataFrame:
    """Counts per table, field, month and kind, with the number of distinct targets."""
    return (
        broken_references(knowledge, requests)
        .groupBy("table_name", "field_name", "period", "kind")
        .agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref").alias("n_targets"))
    )
