"""State of records derived from an append-only retirement log, points in time, and checks of what is stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.vectors import usable
from strataloom.operators.skew import hot_key_join, sketch_semi


def first_events(events: DataFrame) -> DataFrame:
    """One event per retired record, the earliest (``superseded_id, superseding_id, occurred_at, fact_valid_until, event_id``).

    Repeated rows and later events change nothing; events without a target, or of a record that retires itself, count for nothing.
    """
    e = events.filter(F.col("superseded_id").isNotNull() & ~F.col("superseded_id").eqNullSafe(F.col("superseding_id")))
    fields = F.struct("superseding_id", "occurred_at", "fact_valid_until", F.col("id").alias("event_id"))
    return e.groupBy("superseded_id").agg(F.min_by(fields, F.struct(F.coalesce("occurred_at", F.timestamp_seconds(F.lit(253402300799))), "id")).alias("_e")).select("superseded_id", "_e.*")


def expected_status(event: Column) -> Column:
    """``superseded`` with a successor, ``historical`` without."""
    return F.when(event.isNotNull(), F.lit("superseded")).otherwise(F.lit("historical"))


def project(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``rows`` with status and ``valid_until`` as the log has them: only current rows change.

    The end of a retired record is when the fact ended, else when the event occurred.
    """
    e = first_events(events).withColumnRenamed("superseded_id", "id").withColumn("_hit", F.lit(True))
    joined = rows.join(e, "id", "left")
    changes = F.coalesce(F.col("_hit") & (F.col("status") == "current"), F.lit(False))
    return joined.select(
        *[c for c in rows.columns if c not in ("status", "valid_until")],
        F.when(changes, expected_status(F.col("superseding_id"))).otherwise(F.col("status")).alias("status"),
        F.when(changes, F.coalesce("fact_valid_until", "occurred_at")).otherwise(F.col("valid_until")).alias("valid_until"),
    )


def status_drift(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``id, stored, expected, drift``: records whose stored status isn't what the log says."""
    e = first_events(events).withColumnRenamed("superseded_id", "id").select("id", expected_status(F.col("superseding_id")).alias("expected"))
    mismatch = rows.select("id", F.col("status").alias("stored")).join(e, "id").filter(~F.col("stored").eqNullSafe(F.col("expected")))
    silent = rows.filter("status = 'superseded'").select("id", F.col("status").alias("stored")).join(e.select("id"), "id", "left_anti").withColumn("expected", F.lit("current"))
    return mismatch.withColumn("drift", F.lit("event_present_status_mismatch")).unionByName(silent.withColumn("drift", F.lit("superseded_without_event")))


#: Fields that scoped() may filter by, and the status it takes where none is asked for.
FACETS, DEFAULT_STATUS = ("domain", "environment", "system"), "current"


def scoped(rows: DataFrame, filters: dict | None = None, owner: str | None = None) -> DataFrame:
    """Rows of a status, of an owner (``created_by``) and of equal facets.

    The status is ``current`` unless ``filters`` names one, any if it names None; facets without a value and names that
    aren't facets filter nothing. Each predicate is a plain equality that reaches the scan.
    """
    asked = {"status": DEFAULT_STATUS} | (filters or {})
    wanted = {"created_by": owner or None, "status": asked["status"], **{c: asked.get(c) or None for c in FACETS}}
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows


def newest(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest rows by ``valid_from`` (unknown ones first, ties by id): each task keeps its own first."""
    return rows.orderBy(F.desc_nulls_first("valid_from"), "id").limit(limit)


def left_over(shown: DataFrame, named: DataFrame) -> DataFrame:
    """``qid, n_shown, n_missing, least_missing``: what was shown to each asker (pairs ``qid, id``) and isn't among what it
    named (``qid, id``). ``n_missing`` is 0 where the named ones are a superset."""
    met = shown.select("qid", "id").distinct().join(named.select("qid", "id").distinct().withColumn("_hit", F.lit(True)), ["qid", "id"], "left")
    missing = F.col("_hit").isNull()
    return met.groupBy("qid").agg(F.count(F.lit(1)).alias("n_shown"), F.count_if(missing).alias("n_missing"), F.min(F.when(missing, F.col("id"))).alias("least_missing"))


def other_side(lo: Column, hi: Column, one: Column) -> Column:
    """The member of a pair that isn't ``one``; null where ``one`` is none of the two."""
    return F.when(one == lo, hi).when(one == hi, lo)


def as_of(rows: DataFrame, at: Column) -> DataFrame:
    """Rows valid at ``at``: from ``valid_from`` on, until before ``valid_until`` (null: still)."""
    return rows.filter((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def as_of_each(rows: DataFrame, times: DataFrame, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """``at_s, id`` of the rows valid at each of many times (``at_s``, in seconds).

    A range join, made an equality by time buckets: a period goes to the buckets of the times that it
    covers, of which there are as many as ``times`` spans, and the bounds are checked within a bucket. Open ends reach
    to the last time asked for.
    """
    spell = rows.filter(F.col("valid_from").isNotNull()).select("id", F.unix_seconds("valid_from").alias("a"), F.unix_seconds("valid_until").alias("b"))
    span = times.agg(F.min("at_s").alias("t0"), F.max("at_s").alias("t1"))  # one row
    spell = spell.crossJoin(F.broadcast(span)).filter((F.col("a") <= F.col("t1")) & (F.col("b").isNull() | (F.col("b") > F.col("t0"))))
    first, last = F.greatest("a", "t0"), F.least(F.coalesce("b", "t1"), "t1")
    spell = spell.withColumn("bucket", F.explode(F.sequence(F.floor(first / bucket_seconds), F.floor(last / bucket_seconds))))
    asked = times.select("at_s", F.floor(F.col("at_s") / bucket_seconds).alias("bucket")).distinct()
    return asked.join(spell, "bucket").filter((F.col("a") <= F.col("at_s")) & (F.col("b").isNull() | (F.col("b") > F.col("at_s")))).select("at_s", "id")


#: Levels of halves of time that counts_at tells apart, from one second up: 2^40 seconds in all.
LEVELS = 40


def counts_at(rows: DataFrame, times: DataFrame) -> DataFrame:
    """``at_s, n_valid, least_id``: how many rows are valid at each of many times (``at_s``, in seconds) and the least id
    of them; times at which none is are left out.

    A period is the sum of at most 80 aligned stretches of 2^k seconds. Rows are counted per stretch, so what is joined
    is one row a stretch, and a time sums up the 40 stretches that it lies in: no time meets a row.
    """
    name = lambda k, n: F.call_function("shiftleft", k.cast("bigint"), F.lit(LEVELS + 1)) + n
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    half = lambda n, k: F.call_function("shiftright", n, k)
    odd = lambda n: n.bitwiseAND(F.lit(1).cast("bigint")) == 1

    times = times.select("at_s").filter("at_s is not null").distinct()
    span = times.agg(F.min("at_s").alias("t0"), F.max("at_s").alias("t1"))  # one row
    asked = times.crossJoin(F.broadcast(span)).select("at_s", F.explode(F.transform(levels, lambda k: name(k, half(F.col("at_s") - F.col("t0"), k)))).alias("_part"))

    spell = rows.filter(F.col("valid_from").isNotNull()).select("id", F.unix_seconds("valid_from").alias("a"), F.unix_seconds("valid_until").alias("b"))
    spell = spell.crossJoin(F.broadcast(span)).filter("t0 is not null")
    end = F.col("t1") + 1
    spell = spell.select("id", (F.greatest("a", "t0") - F.col("t0")).alias("a"), (F.least(F.coalesce("b", end), end) - F.col("t0")).alias("b")).filter("a < b")

    def parts(k: Column) -> Column:
        low, high = half(F.col("a") + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k), half(F.col("b"), k)
        return F.array(F.when((low < high) & odd(low), name(k, low)), F.when((low < high) & odd(high), name(k, high - 1)))

    every = spell.select("id", F.explode(F.array_compact(F.flatten(F.transform(levels, parts)))).alias("_part"))
    held = sketch_semi(every, asked, "_part").groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    met = hot_key_join(asked, held, "_part", F.col("at_s"))
    return met.groupBy("at_s").agg(F.sum("n").alias("n_valid"), F.min("least").alias("least_id"))


def lifespans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``id, starts, ends`` per chain: each ends when the next of the same keys begins."""
    w = Window.partitionBy(*keys).orderBy("valid_from", "id")
    return rows.filter(F.col("valid_from").isNotNull()).select(*keys, "id", F.unix_seconds("valid_from").alias("start_s"), F.unix_seconds(F.lead("valid_from").over(w)).alias("end_s"), F.lead("id").over(w).alias("successor_id"))


def evidence(targets: DataFrame, rows: DataFrame, events: DataFrame, sections: str = "document_id") -> DataFrame:
    """Per target (``id``) how many sections, successors and events refer to it, and whether none does (deletable).

    Each count is an aggregate that is left-joined, not a query per row.
    """
    counts = {
        "n_sections": rows.filter(F.col(sections).isNotNull()).groupBy(F.col(sections).alias("id")),
        "n_successors": rows.filter(F.col("supersedes_id").isNotNull()).groupBy(F.col("supersedes_id").alias("id")),
        "n_retired_by": events.filter(F.col("superseded_id").isNotNull()).groupBy(F.col("superseded_id").alias("id")),
        "n_retires": events.filter(F.col("superseding_id").isNotNull()).groupBy(F.col("superseding_id").alias("id")),
    }
    out = targets.select("id").distinct()
    for name, grouped in counts.items():
        out = out.join(grouped.agg(F.count(F.lit(1)).alias(name)), "id", "left")
    out = out.na.fill(0, list(counts))
    return out.withColumn("deletable", sum((F.col(c) for c in counts), F.lit(0)) == 0)


def uncovered(parents: DataFrame, sections: DataFrame, parent: str) -> DataFrame:
    """Parents without a section."""
    return parents.join(sections.select(F.col(parent).alias("id")).filter("id is not null").distinct(), "id", "left_anti")


def _pairs_in_block(threshold: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block = rows.column("block").to_numpy()
        ids = np.array(rows.column("id").to_pylist(), dtype=object)
        v = np.array(rows.column("embedding").to_pylist(), dtype=np.float64)
        v /= np.sqrt((v * v).sum(1))[:, None]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        lo, hi, sims = [], [], []
        for at in range(0, len(left), 1024):
            part = left[at : at + 1024]
            sim = v[part] @ v[right].T
            for a, b in zip(*np.nonzero(sim >= threshold - 1e-12)):
                x, y = ids[part[a]], ids[right[b]]
                if i != j or x < y:
                    lo.append(min(x, y))
                    hi.append(max(x, y))
                    sims.append(float(sim[a, b]))
        return pa.table({"system": pa.array([key[0].as_py()] * len(lo), pa.string()), "id_lo": pa.array(lo, pa.string()), "id_hi": pa.array(hi, pa.string()), "similarity": pa.array(sims, pa.float64())})

    return run


def contradiction_candidates(rows: DataFrame, threshold: float, dimensions: int = 64, block_rows: int = 4096, known: DataFrame | None = None) -> DataFrame:
    """Pairs of current records of one system whose vectors are at least ``threshold`` similar, each once.

    A system is cut into blocks of some ``block_rows`` records, and each pair of blocks is a task that multiplies two
    matrices and gives only the pairs that count; a large system takes as many tasks as it has pairs of
    blocks. Pairs of ``known`` (``id_lo, id_hi``, decided before) aren't given again. Null systems match nothing.
    """
    live = rows.filter((F.col("status") == "current") & F.col("system").isNotNull() & usable(F.col("embedding"), dimensions)).select("system", "id", "embedding")
    blocks = live.groupBy("system").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_blocks"))
    live = live.join(blocks, "system").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    tasks = live.withColumn("_o", other).select("system", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "id", "embedding")
    pairs = tasks.groupBy("system", "i", "j").applyInArrow(_pairs_in_block(threshold), "system string, id_lo string, id_hi string, similarity double")
    return pairs if known is None else pairs.join(known.select("id_lo", "id_hi"), ["id_lo", "id_hi"], "left_anti")


def still_current(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of which both records are current now."""
    now = rows.filter("status = 'current'").select("id")
    return pairs.join(now.withColumnRenamed("id", "id_lo"), "id_lo", "left_semi").join(now.withColumnRenamed("id", "id_hi"), "id_hi", "left_semi")
