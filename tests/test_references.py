"""Broken references: made cases, odd rows, a hot target."""

from datetime import datetime

from pyspark.sql import functions as F

from strataloom.operators import references as R
from strataloom.operators.skew import hot_key_join, sketch_semi


def uid(n):
    return f"0000000a-0000-4000-8000-{n:012d}"


K = "id string, supersedes_id string, document_id string, created_at timestamp, ref string, kind int, came_at string"
Q = "id string, target_id string, method string, status string, requested_at timestamp, period string"


def t(month, day=1):
    return datetime(2025, month, day)


def test_cases(spark):
    k = [
        (uid(1), None, None, t(3)), (uid(2), uid(1).upper(), "n/a", t(4)), (uid(3), f"{{{uid(9)}}}", uid(4), t(5)), (uid(3).upper(), f"{{{uid(9)}}}", uid(4), t(5)), (uid(4), "urn:uuid:" + uid(8), None, t(6)),
        (uid(5), uid(7), uid(5), None), (uid(6), " ", "", t(7)), (None, uid(7), None, t(8)),
    ]
    q = [
        (uid(101), uid(8), "delete", "executed", t(2)), (uid(102), uid(9), "delete", "approved", t(2)), (uid(103), uid(1), "retire", "executed", t(2)), (uid(103), uid(1), "retire", "executed", t(2)),
        (uid(104), None, "delete", "executed", t(2)), (uid(105), uid(5), "retire", "pending", t(2)), (uid(106), uid(4), "retire", "pending", None),
    ]
    knowledge = spark.createDataFrame([(*r, "clash", 1, "x") for r in k], K)
    requests = spark.createDataFrame([(*r, "clash") for r in q], Q)
    got = {(r["table_name"], r["field_name"], r["row_id"], r["kind"], r["period"]) for r in R.broken_references(knowledge, requests).collect()}
    s, d, m = "supersedes_id", "document_id", "retirement_requests"
    assert got == {
        ("knowledge", s, uid(3), "missing", "2025-05"), ("knowledge", d, uid(3), "late", "2025-05"), ("knowledge", s, uid(4), "deleted", "2025-06"), ("knowledge", s, uid(5), "missing", None),
        ("knowledge", s, None, "missing", "2025-08"), (m, "target_id", uid(101), "deleted", "2025-02"), (m, "target_id", uid(102), "missing", "2025-02"), (m, "target_id", uid(103), "late", "2025-02"),
    }
    report = {(r["table_name"], r["field_name"], r["period"], r["kind"]): r["n_refs"] for r in R.broken_reference_report(knowledge, requests).collect()}
    assert sum(report.values()) == len(got)
    assert R.broken_references(knowledge.limit(0), requests.limit(0)).count() == 0


def test_hot_key_join_and_sketch(spark):
    big = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 500).alias("k"))
    small = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        a, b = hot_key_join(big, small, "k", F.col("id"), how).select("id", "k", "v"), big.join(small, "k", how).select("id", "k", "v")
        assert a.count() == b.count() and a.exceptAll(b).count() == 0
    keys = spark.range(0, 500, 7).select(F.col("id").alias("k"))
    kept = sketch_semi(big, keys, "k")
    assert kept.join(keys, "k").count() == big.join(keys, "k").count() and kept.count() < big.count() / 2
    assert sketch_semi(big, keys, "k", rows=1).join(keys, "k").count() == big.join(keys, "k").count()
    assert sketch_semi(big, keys.limit(0), "k").count() == 0
