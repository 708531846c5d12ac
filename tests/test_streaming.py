"""Streaming results equal the batch ones."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import sessions as S
from strataloom.operators.lifecycle import first_events
from strataloom.streaming import events as E

FOLDER = "/root/testdata/sf0.001"


def run(spark, tmp_path, name, build, table="query_log", mode="append", parts=4):
    """Feed a table in several files, in time order, and collect what comes out."""
    batch = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    at = "created_at" if table == "query_log" else "occurred_at"
    rows = batch.filter(F.col(at).isNotNull()).orderBy(at)
    n = rows.count()
    ordered = rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(rows.schema.add("_i", "long"))
    for k in range(parts):
        ordered.filter(F.col("_i").between(k * n // parts, (k + 1) * n // parts - 1)).drop("_i").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows, spark.table(name)


def test_sessions(spark, tmp_path):
    rows, out = run(spark, tmp_path, "s1", lambda s: E.sessions(s, lateness="400 days"), mode="complete")
    got = {tuple(r) for r in out.collect()}
    want = S.session_summary(S.sessionize(rows)).select("owner", "session_start_s", "session_end_s", "n")
    assert got == {tuple(r) for r in want.collect()}


def test_replays(spark, tmp_path):
    rows, out = run(spark, tmp_path, "s2", lambda s: E.replay_counts(s, ["owner", "mode"]), mode="complete")
    want = S.collapse_replays(rows, ["owner", "mode"], "created_at")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


def test_insert_once(spark, tmp_path):
    rows, out = run(spark, tmp_path, "s3", lambda s: E.insert_once(s, ["id"], lateness="400 days").select("id"))
    assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in rows.select("id").distinct().collect())


def test_hourly_rate(spark, tmp_path):
    rows, out = run(spark, tmp_path, "s4", E.hourly_rate, mode="complete")
    want = rows.filter("owner is not null").groupBy("owner", F.window("created_at", "1 hour", "10 minutes").alias("w")).count().select("owner", F.unix_seconds("w.end"), "count")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


def test_first_retirements(spark, tmp_path):
    rows, out = run(spark, tmp_path, "s5", E.first_retirements, table="supersession_events", mode="append")
    got = {r["superseded_id"]: r["status"] for r in out.collect()}
    first = {r["superseded_id"]: ("historical" if r["superseding_id"] is None else "superseded", r["event_id"]) for r in first_events(rows).collect()}
    assert out.count() == len(got) and {r["superseded_id"]: (r["status"], r["event_id"]) for r in out.collect()} == first


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int")
    add = E.append_new(f"{tmp_path}/t", ["id"])
    for _ in range(2):
        add(rows, 0)
    add(spark.createDataFrame([("c", 3), ("b", 9)], "id string, n int"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [("a", 1), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("text,seconds", [("30 minutes", 1800), ("3 hours", 10800), ("1 second", 1)])
def test_seconds(text, seconds):
    assert E._seconds(text) == seconds


def test_append_new_reads_the_days_of_a_batch(spark, tmp_path):
    def rows(*listed):
        return spark.createDataFrame(listed, "id string, s bigint").selectExpr("id", "timestamp_seconds(s) as created_at")

    add = E.append_new(f"{tmp_path}/t", ["id"], at="created_at")
    first = rows(("a", 10), ("b", 90_000), ("n", None))
    for _ in range(2):
        add(first, 0)
    add(rows(("c", 20), ("a", 10), ("n", None), ("m", None)), 1)
    add(rows().limit(0), 2)
    held = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(r["id"] for r in held.collect()) == ["a", "b", "c", "m", "n"] and held.select("_day").distinct().count() == 3


def test_delivery_comes_before_the_mark(spark, tmp_path):
    got, fail = [], [True]

    def deliver(rows):
        if fail[0]:
            raise RuntimeError("not reached")
        got.extend(r["id"] for r in rows.collect())

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int")
    run = E.deliver_then_mark(deliver, f"{tmp_path}/marks", ["id"])
    with pytest.raises(RuntimeError):
        run(rows, 0)
    fail[0] = False
    run(rows, 0)
    run(rows, 0)
    run(spark.createDataFrame([("b", 2), ("c", 3)], "id string, n int"), 1)
    run(rows.limit(0), 2)
    assert sorted(got) == ["a", "b", "c"]
