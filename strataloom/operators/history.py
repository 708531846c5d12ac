"""History of changing entity attributes, kept in insert-only satellites.

The attributes are split by change rate into satellites. A satellite takes a new row only when the hash of
its attributes differs from the one before (its hash-diff), and nothing is ever updated: the end of a row's
period is the start of the next one, computed in a view. A load that brings late or corrected states of the past
appends the rows of its entities anew from the first such state on, under its own load number; the view leaves out what
earlier loads said from there on.

The states of one entity may be a large share of all rows. Rows of such an entity are therefore compared within
time buckets; what passes between buckets is one row per entity and bucket. With states told apart by whole
seconds, a bucket of 30 days holds at most 2,592,000 of them. Rows are brought together once per load, by entity and
bucket; all that follows keeps to that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.session import written

#: Attributes of a knowledge record by how often they change.
SATELLITES = {"status": ("status", "valid_until"), "lineage": ("valid_from", "supersedes_id")}
BUCKET_SECONDS = 30 * 86400
#: Entities with more than one in so many rows are cut into buckets: fewer than so many entities.
SHARES = 1000


def hash_diff(columns: Sequence[str]) -> Column:
    """128 bits over the attributes, as two numbers; null and empty differ."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def clean_states(snapshots: DataFrame) -> DataFrame:
    """``knowledge_id, snapshot_at, recorded, snapshot, state`` of each row that holds a state, values spelled alike.

    Rows with null ``status``, null ``snapshot_at`` or an id that is no UUID hold no state. ``status`` is
    trimmed and in lower case, ``valid_until`` in year 9999 is null, ``supersedes_id`` is a UUID or null. Other columns
    are ignored.
    """
    blank = r"^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$"
    until = F.col("valid_until")
    return snapshots.select(
        uuid_of("knowledge_id").alias("knowledge_id"),
        F.col("snapshot_at"),
        F.col("recorded_at").alias("recorded"),
        F.col("snapshot_id").alias("snapshot"),
        F.struct(
            F.lower(F.regexp_replace("status", blank, "")).alias("status"),
            F.col("valid_from"),
            F.when(until < F.timestamp_seconds(F.lit(253370764800)), until).alias("valid_until"),
            uuid_of("supersedes_id").alias("supersedes_id"),
        ).alias("state"),
    ).filter(F.col("knowledge_id").isNotNull() & F.col("snapshot_at").isNotNull() & F.col("state.status").isNotNull())


def _latest(rows: DataFrame, *also: str) -> DataFrame:
    """One state per record and ``snapshot_at`` of clean_states, by the latest ``recorded``, then the greatest ``snapshot``."""
    held = rows.groupBy("knowledge_id", *also, "snapshot_at").agg(F.max_by("state", F.struct("recorded", "snapshot")).alias("_state"))
    return held.select("knowledge_id", *also, "snapshot_at", "_state.*")


def latest_states(snapshots: DataFrame) -> DataFrame:
    """One state per record and ``snapshot_at``: the latest ``recorded_at``, then the greatest ``snapshot_id``.

    A null ``recorded_at`` counts as the earliest; see clean_states for what holds a state.
    """
    return _latest(clean_states(snapshots))


def hot_entities(rows: DataFrame, key: str, shares: int = SHARES) -> list:
    """The entities that hold more than one in ``shares`` of all rows: fewer than ``shares``."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[key] for r in per_key.filter(F.col("_n") * shares > rows.count()).select(key).collect()]


def placed(rows: DataFrame, key: str, at: str, hot: list, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``_bucket``, null but for entities in ``hot``, and brings the rows of an entity and bucket together."""
    bucket = F.when(F.col(key).isin(hot), F.floor(F.unix_seconds(at) / bucket_seconds))
    return rows.withColumn("_bucket", bucket.cast("bigint")).repartition(key, "_bucket")


def _from_buckets(rows: DataFrame, ends: DataFrame, key: str, value: str, backwards: bool = False) -> DataFrame:
    """Joins ``value`` of ``ends`` (one row per hot entity and bucket) from the nearest bucket before (or after) that has one."""
    near = Window.partitionBy(key).orderBy(F.desc("_bucket") if backwards else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn(f"_carried_{value}", F.last(value, ignorenulls=True).over(near)).select(key, F.col("_bucket").alias("_b"), f"_carried_{value}")
    joined = rows.join(carried.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.drop("_k", "_b")


def mark_changes(
    states: DataFrame, key: str, at: str, satellites: Mapping[str, Sequence[str]] = SATELLITES, bucket_seconds: int = BUCKET_SECONDS, hot: list | None = None
) -> DataFrame:
    """Adds ``changed_<satellite>``: whether the satellite takes a row for this state.

    ``states`` has one row per ``key`` and ``at``. The first state of an entity changes every satellite. With ``hot`` the
    rows are ``placed`` already.
    """
    rows = states if hot is not None else placed(states, key, at, hot_entities(states, key), bucket_seconds)
    hashes = [f"_h_{name}" for name in satellites]
    rows = rows.withColumn("_own", F.struct(*[hash_diff(columns).alias(h) for h, columns in zip(hashes, satellites.values())]))
    rows = rows.withColumn("_before", F.lag("_own").over(Window.partitionBy(key, "_bucket").orderBy(at)))
    ends = rows.filter(F.col("_bucket").isNotNull()).groupBy(key, "_bucket").agg(F.max_by("_own", at).alias("_end"))
    rows = _from_buckets(rows, ends, key, "_end")
    before = F.coalesce("_before", "_carried__end")
    marks = {f"changed_{name}": ~F.col(f"_own._h_{name}").eqNullSafe(before[f"_h_{name}"]) for name in satellites}
    return rows.withColumns(marks).drop("_before", "_carried__end", "_own")


def with_period_end(inserts: DataFrame, key: str, at: str, end: str = "valid_to", hot: list | None = None) -> DataFrame:
    """The lead-based view: ``end`` is the next row's ``at`` of the same key, null for the last. Needs rows that are ``placed``; where
    ``hot`` is empty no key lies in several buckets."""
    rows = inserts.withColumn("_next", F.lead(at).over(Window.partitionBy(key, "_bucket").orderBy(at)))
    if hot is not None and not hot:
        return rows.withColumnRenamed("_next", end)
    starts = inserts.filter(F.col("_bucket").isNotNull()).groupBy(key, "_bucket").agg(F.min(at).alias("_start"))
    rows = _from_buckets(rows, starts, key, "_start", backwards=True)
    return rows.withColumn(end, F.coalesce("_next", "_carried__start")).drop("_next", "_carried__start")


def satellite_inserts(marked: DataFrame, key: str, at: str, name: str, satellites: Mapping[str, Sequence[str]] = SATELLITES) -> DataFrame:
    """The rows that satellite ``name`` appends: key, load time, hash-diff and its own attributes."""
    columns = list(satellites[name])
    return marked.filter(F.col(f"changed_{name}")).select(key, at, "_bucket", hash_diff(columns).alias("hash_diff"), *columns)


def satellite_view(inserts: DataFrame, key: str, at: str) -> DataFrame:
    """A satellite with the period of each row; ``valid_to`` is null while the row holds."""
    return with_period_end(inserts, key, at).drop("_bucket")


def new_satellite_rows(existing: DataFrame, arrived: DataFrame, key: str, at: str) -> DataFrame:
    """What a later load appends to a satellite: ``arrived`` (an insert set) without what is held already.

    Only an entity's first new row can repeat what is held: it goes if its hash-diff is that of the latest stored row
    before it. Stored rows at or after it, which a late or corrected state makes void, don't count.
    """
    first = arrived.groupBy(key).agg(F.min(at).alias("_first"))
    held = existing.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.col("hash_diff").alias("_h"))
    newest = first.join(held, F.col(key) == F.col("_k")).filter(F.col("_at") < F.col("_first")).groupBy(key).agg(F.max_by("_h", "_at").alias("_held"))
    is_first = arrived.join(first.select(key, F.col("_first").alias(at), F.lit(True).alias("_is_first")), [key, at], "left")
    others = is_first.filter(F.col("_is_first").isNull()).drop("_is_first")
    firsts = is_first.filter("_is_first").drop("_is_first").join(newest, key, "left")
    return others.unionByName(firsts.filter(~F.col("hash_diff").eqNullSafe(F.col("_held"))).drop("_held"))


class Satellites:
    """Insert-only satellites of the records in ``knowledge_snapshots``, filled load by load.

    ``load`` appends what rows recorded up to a time add to each satellite; ``rows`` and ``view`` read them. Each load writes new
    files, a folder per satellite, and changes none; ``restarts`` (record, load, from when on the load tells the record's
    states anew) is appended to as well.
    """

    def __init__(self, snapshots: DataFrame, satellites: Mapping[str, Sequence[str]] = SATELLITES, bucket_seconds: int = BUCKET_SECONDS):
        self.raw = written(clean_states(snapshots), "history-states")
        self.hot = hot_entities(self.raw, "knowledge_id")
        self.satellites, self.bucket_seconds = dict(satellites), bucket_seconds
        self.inserts: list[DataFrame] = []
        self.restarts: list[DataFrame] = []
        self.loaded_to = None

    def _placed(self, rows: DataFrame) -> DataFrame:
        return placed(rows, "knowledge_id", "snapshot_at", self.hot, self.bucket_seconds)

    def load(self, recorded_to=None) -> None:
        """Takes the rows recorded after the last load up to ``recorded_to``, all of them where it is None. A row without a time counts as the
        earliest."""
        until = F.lit(True) if recorded_to is None else F.coalesce(F.col("recorded") <= F.lit(recorded_to), F.lit(True))
        rows, load = self.raw.filter(until), len(self.inserts) + 1
        own = F.struct(*[hash_diff(c).alias(name) for name, c in self.satellites.items()]).alias("own")
        if load > 1:
            touched = rows.filter(F.col("recorded") > F.lit(self.loaded_to)).groupBy("knowledge_id").agg(F.min("snapshot_at").alias("restated_from"))
            touched = written(touched, "history-restarts")
            rows = rows.join(touched, "knowledge_id").filter(F.col("snapshot_at") >= F.col("restated_from"))
        states = _latest(self._placed(rows.select("knowledge_id", "snapshot_at", "recorded", "snapshot", "state")), "_bucket")
        states = states.select("*", own, F.lit(False).alias("held"))
        if load > 1:
            # what held before, as a row just before the first state that is told anew
            before = self.rows().join(touched, "knowledge_id").filter(F.col("snapshot_at") < F.col("restated_from")).groupBy("knowledge_id", "restated_from")
            latest = [F.max_by(F.when(F.col("satellite") == n, F.col("hash_diff")), F.when(F.col("satellite") == n, F.col("snapshot_at"))).alias(n) for n in self.satellites]
            at = F.timestamp_micros(F.unix_micros("restated_from") - 1).alias("snapshot_at")
            seeds = self._placed(before.agg(*latest).select("knowledge_id", at, F.struct(*self.satellites).alias("own"), F.lit(True).alias("held")))
            states = states.unionByName(seeds, allowMissingColumns=True).repartition("knowledge_id", "_bucket")
        states = states.withColumn("before", F.lag("own").over(Window.partitionBy("knowledge_id", "_bucket").orderBy("snapshot_at")))
        if self.hot:
            ends = states.filter(F.col("_bucket").isNotNull()).groupBy("knowledge_id", "_bucket").agg(F.max_by("own", "snapshot_at").alias("end"))
            states = _from_buckets(states, ends, "knowledge_id", "end").withColumn("before", F.coalesce("before", "_carried_end"))
        changed = F.array_compact(F.array(*[F.when(~F.col(f"own.{n}").eqNullSafe(F.col(f"before.{n}")), F.struct(F.lit(n).alias("satellite"), F.col(f"own.{n}").alias("hash_diff"))) for n in self.satellites]))
        new = states.filter(~F.col("held")).select("*", F.explode(changed).alias("row")).select(
            "knowledge_id", "snapshot_at", "row.*", *[F.when(F.col("row.satellite") == n, F.col(c)).alias(c) for n, cs in self.satellites.items() for c in cs], F.lit(load).alias("load")
        )
        self.inserts.append(written(new, "history-satellites", by="satellite"))
        if load > 1:
            self.restarts.append(touched.withColumn("load", F.lit(load)))
        self.loaded_to = recorded_to

    def rows(self) -> DataFrame:
        """The valid rows of all satellites: those that no later load told anew."""
        every = reduce(DataFrame.unionByName, self.inserts)
        if not self.restarts:
            return every
        # as many restarts per record as loads
        again = reduce(DataFrame.unionByName, self.restarts).groupBy("knowledge_id").agg(F.collect_list(F.struct("load", "restated_from")).alias("_again"))
        void = F.exists("_again", lambda r: (r["load"] > F.col("load")) & (r["restated_from"] <= F.col("snapshot_at")))
        return every.join(again, "knowledge_id", "left").filter(~F.coalesce(void, F.lit(False))).drop("_again")

    def view(self, name: str) -> DataFrame:
        """A satellite with the period of each row; ``valid_to`` is null while the row holds."""
        rows = self.rows().filter(F.col("satellite") == name).select("knowledge_id", "snapshot_at", "hash_diff", *self.satellites[name])
        return with_period_end(self._placed(rows), "knowledge_id", "snapshot_at", hot=self.hot).drop("_bucket")


def filled(snapshots: DataFrame, loads: int = 2) -> Satellites:
    """The satellites after ``loads`` loads, cut at equal distances of ``recorded_at``."""
    s = Satellites(snapshots)
    span = s.raw.agg(F.min(F.unix_micros("recorded")).alias("a"), F.max(F.unix_micros("recorded")).alias("b")).first()
    if span["a"] is not None:
        for k in range(1, loads):
            s.load(datetime.fromtimestamp((span["a"] + (span["b"] - span["a"]) * k // loads) / 1e6, timezone.utc))
    s.load()
    return s


def versions(snapshots: DataFrame, loads: int = 2) -> DataFrame:
    """Every version of a record with the period in which it held, read from the satellites.

    Columns ``knowledge_id, status, valid_from, valid_until, supersedes_id, held_from, held_to``; the
    periods of a record leave no gap, ``held_to`` is null for the version that holds now. An empty table
    gives no versions; see latest_states for nulls and repeated rows. The number of ``loads`` changes nothing.
    """
    s = filled(snapshots, loads)
    row = {n: F.max(F.when(F.col("satellite") == n, F.struct(*c))).alias(n) for n, c in s.satellites.items()}
    rows = s._placed(s.rows()).groupBy("knowledge_id", "_bucket", "snapshot_at").agg(*row.values())
    so_far = Window.partitionBy("knowledge_id", "_bucket").orderBy("snapshot_at").rowsBetween(Window.unboundedPreceding, 0)
    # each satellite's row that holds at the time, also where only the other one changed
    full = rows.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in row})
    for n in row if s.hot else ():
        ends = rows.filter(F.col("_bucket").isNotNull()).groupBy("knowledge_id", "_bucket").agg(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("snapshot_at"))).alias(n))
        full = _from_buckets(full, ends, "knowledge_id", n).withColumn(n, F.coalesce(n, f"_carried_{n}")).drop(f"_carried_{n}")
    view = with_period_end(full, "knowledge_id", "snapshot_at", "held_to", s.hot)
    return view.select("knowledge_id", *[f"{n}.{c}" for n, cs in s.satellites.items() for c in cs], F.col("snapshot_at").alias("held_from"), "held_to")
