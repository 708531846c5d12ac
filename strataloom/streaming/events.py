"""Structured Streaming forms of the time-driven operators.

Each takes a streaming DataFrame (and works on a batch one alike). Late rows are tolerated for a watermark of three
hours, as the nightly batch looks back; state is dropped beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.operators.writes import unmarked
from strataloom.session import written

LATENESS = "3 hours"


def sessions(log: DataFrame, owner: str = "owner", at: str = "created_at", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """``owner, session_start_s, session_end_s, n``: a gap of exactly ``gap`` still merges, as in the batch form."""
    rows = log.filter(F.col(owner).isNotNull() & F.col(at).isNotNull()).withWatermark(at, lateness)
    # a session window ends a gap after its last row; times are whole seconds, so a second more lets equal gaps merge
    width = f"{_seconds(gap) + 1} seconds"
    grouped = rows.groupBy(owner, F.session_window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_seconds(at)).alias("session_end_s"))
    return grouped.select(owner, F.unix_seconds("w.start").alias("session_start_s"), "session_end_s", "n")


def _seconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def replay_counts(log: DataFrame, keys: list[str], at: str = "created_at", bucket: str = "10 minutes", lateness: str = LATENESS) -> DataFrame:
    """Rows per keys and tumbling bucket: ``keys, bucket_s, n, first_s``."""
    rows = log.filter(F.col(at).isNotNull()).withWatermark(at, lateness)
    grouped = rows.groupBy(*keys, F.window(at, bucket).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_seconds(at)).alias("first_s"))
    return grouped.select(*keys, F.unix_seconds("w.start").alias("bucket_s"), "n", "first_s")


def insert_once(rows: DataFrame, keys: list[str], at: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """Each key once within the watermark, whatever is delivered again."""
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def hourly_rate(log: DataFrame, owner: str = "owner", at: str = "created_at", slide: str = "10 minutes", lateness: str = LATENESS) -> DataFrame:
    """Rows per owner in a sliding hour: ``owner, window_end_s, n``."""
    rows = log.filter(F.col(owner).isNotNull()).withWatermark(at, lateness)
    grouped = rows.groupBy(owner, F.window(at, "1 hour", slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(owner, F.unix_seconds("w.end").alias("window_end_s"), "n")


def first_retirements(events: DataFrame) -> DataFrame:
    """Status per retired record from the event log: the earliest event of the first batch that has one holds, later ones change nothing.

    One row per record, when its first event comes: ``superseded_id, status, event_id``. Events of a record that retires itself count for
    nothing, as in lifecycle.first_events. A record's mark is kept for good, as it may be retired again at any time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for rows in batches:  # a group may come in several
            rows = rows if best is None else pd.concat([best, rows])
            best = rows.sort_values(["occurred_at", "id"], na_position="last").head(1)
        if state.exists or best is None or best.empty:
            return
        best = best.iloc[0]
        state.update((best["id"],))
        status = "historical" if pd.isna(best["superseding_id"]) else "superseded"
        yield pd.DataFrame({"superseded_id": [key[0]], "status": [status], "event_id": [best["id"]]})

    slim = events.filter(F.col("superseded_id").isNotNull() & ~F.col("superseded_id").eqNullSafe(F.col("superseding_id"))).select("superseded_id", "superseding_id", "occurred_at", "id")
    return slim.groupBy("superseded_id").applyInPandasWithState(update, "superseded_id string, status string, event_id string", "event_id string", "append", GroupStateTimeout.NoTimeout)


def _day(at: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(at) / 86400).cast("int"))


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or nothing where none was written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(there)] if files.exists(there) else []
    return spark.read.parquet(path) if any("=" in n or n[0] not in "._" for n in names) else None


def append_new(target_path: str, keys: list[str], at: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose keys the table at ``target_path`` lacks, so that a batch that is run
    again adds nothing.

    With ``at``, a row's own time, which doesn't change when it is delivered again, the table lies in a folder per day (``_day``; rows
    without a time in one of their own), and only the days that a batch has are read. Without, all keys of the table are.
    """

    def run(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        held = _kept(batch.sparkSession, target_path)
        if at:
            new = new.withColumn("_day", _day(at))
        if at and held is not None:
            days = [r[0] for r in new.select("_day").distinct().collect()]  # of one batch
            known = F.col("_day").isin([d for d in days if d is not None])
            held = held.filter(known | F.col("_day").isNull() if None in days else known)
        if held is not None:
            new = new.join(held.select(*keys), keys, "left_anti")
        write = new.write.mode("append")
        (write.partitionBy("_day") if at else write).parquet(target_path)

    return run


def deliver_then_mark(deliver: Callable[[DataFrame], None], marks_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands the rows that aren't marked yet to ``deliver`` and marks them when it has returned.

    Where it fails, or the batch ends before the marks are written, the rows come again: at least once, never lost. A batch
    without such rows delivers nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        marks = _kept(batch.sparkSession, marks_path)
        new = new if marks is None else unmarked(new, marks, keys)
        new = written(new, "delivery")  # what is marked is what was delivered
        if not new.isEmpty():
            deliver(new)
            new.select(*keys).write.mode("append").parquet(marks_path)

    return run
