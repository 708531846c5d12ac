"""Long exact spans shared between texts, found with a log-structured index of window hashes.

Of every run of ``LENGTH`` characters the k-gram with the least hash is its anchor, so equal runs have equal
anchors. The anchors of a batch of texts are written as one immutable run of the index: a table bucketed and sorted
by hash that has the least and the greatest text of each hash. Each new batch is merge-joined with the runs of earlier
batches, bucket by bucket and without a shuffle; runs are compacted into one as they become many. Around the anchors
that occur in two texts the characters themselves are compared, and only what is equal character by character counts.

Nothing is compared pair by pair: texts meet as least and greatest id per hash, per context of an anchor and
per window of it, and all of these are combined before they are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.skew import hot_key_join, sketch_semi
from strataloom.session import removed, shared_dir, written

LENGTH = 200
GRAM = 80
REACH = LENGTH - GRAM  # how far a run may begin before its anchor
#: Characters that are hashed at once; a longer text is cut into overlapping segments.
SEGMENT = 1 << 20
#: Contexts of one anchor that a task compares; those of a more frequent anchor are grouped by Spark.
FREQUENT = 20_000
#: Batches that a corpus comes in.
BATCHES = 6
#: Contexts per task.
TASK_CONTEXTS = 20_000

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` code points."""
    n = len(points)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each run of ``width`` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def anchors_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of several texts that stand one after the other."""
    grams = window_hashes(points, GRAM)
    width = REACH + 1
    if len(grams) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding(grams, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int32)  # runs that lie within one text
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    reached = _sliding(padded, width, np.maximum)
    at = np.flatnonzero((reached == grams) & (grams > 0))
    return at, grams[at]


def _segments(ids: list, texts: list) -> Iterator[tuple[list, list, list]]:
    """Texts and segments of long texts, some SEGMENT characters at a time: ids, texts, offsets."""
    held, size = ([], [], []), 0
    for i, text in zip(ids, texts):
        for base in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            part = text[base : base + SEGMENT + LENGTH - 1]
            for x, v in zip(held, (i, part, base)):
                x.append(v)
            size += len(part)
            if size >= SEGMENT:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, bases in _segments(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - [len(t) for t in texts]
            at, hashes = anchors_of(code_points("".join(texts)), starts, ends)
            own = np.searchsorted(ends, at, side="right")
            pos = at - starts[own] + np.array(bases, dtype=np.int64)[own]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.array(ids, dtype=np.int64)[own]), pa.array(pos.astype(np.int32))], names=["hash", "doc", "pos"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``hash, doc, pos``: the anchors of each text, from ``doc, text``."""
    return docs.filter(F.length("text") >= LENGTH).select("doc", "text").mapInArrow(_fingerprint, "hash bigint, doc bigint, pos int")


class SpanIndex:
    """Immutable runs in the shared folder, each bucketed and sorted by hash: ``hash, lo, hi`` (least and greatest text).

    ``arrive`` takes a batch: its anchors become a new run, which is merge-joined with each earlier run; what both have is
    the outcome. Where there are more than ``most_runs`` then, ``compact`` merges the two least into one, so the work of all
    compactions grows as the corpus times the logarithm of the batches. A run is never changed; a compaction writes a new
    one and then removes the old ones. Runs have equal buckets, so neither join nor compaction shuffles. A passage that
    a third of all texts have is one row of a run: anchors are combined before they are shuffled.
    """

    def __init__(self, spark: SparkSession, most_runs: int = 4, buckets: int | None = None):
        self.spark, self.most_runs = spark, most_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.batches: dict[str, int] = {}
        self.compactions = 0

    def _write(self, run: DataFrame) -> str:
        name = f"span_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    @staticmethod
    def _grouped(postings: DataFrame) -> DataFrame:
        return postings.groupBy("hash").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))

    def _kept(self, name: str) -> None:
        self.runs.append(name)
        self.batches[name] = 1
        if len(self.runs) > self.most_runs:
            self.compact()

    def add(self, postings: DataFrame) -> None:
        """``postings``: ``hash, doc`` of the batch."""
        self._kept(self._write(self._grouped(postings)))

    def _met(self, new: DataFrame) -> list[DataFrame]:
        """What a run has in common with each earlier run, texts that came again aside."""
        earlier = [self.spark.table(r).select("hash", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")) for r in self.runs]
        return [new.join(old.hint("merge"), "hash").filter(F.least("lo", "lo2") < F.greatest("hi", "hi2")).select("hash") for old in earlier]

    def known(self, postings: DataFrame) -> DataFrame:
        """The hashes of a new batch that texts of earlier batches have."""
        none = self.spark.createDataFrame([], "hash bigint")
        return reduce(DataFrame.unionByName, self._met(self._grouped(postings)), none).distinct()

    def arrive(self, postings: DataFrame) -> DataFrame:
        """Adds a batch; gives the hashes that two of its texts share, or one of its texts and one of an earlier batch."""
        name = self._write(self._grouped(postings))
        new = self.spark.table(name)
        met = written(reduce(DataFrame.unionByName, self._met(new), new.filter("lo < hi").select("hash")), "spans-met")
        self._kept(name)
        return met

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.select("hash", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")).hint("merge"), "hash", "full")
        return both.select("hash", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))

    def merged(self) -> DataFrame:
        """All runs as one: ``hash, lo, hi``. Two runs are merged where their buckets lie; with more, what is merged moves on."""
        return reduce(self._merge, map(self.spark.table, self.runs))

    def compact(self) -> None:
        """Merges the two runs of the fewest batches into a new one."""
        by_age = sorted(self.runs, key=lambda r: self.batches[r])
        old, self.runs = by_age[:2], by_age[2:]
        name = self._write(self._merge(*map(self.spark.table, old)))
        self.runs.append(name)
        self.batches[name] = sum(self.batches.pop(r) for r in old)
        self.compactions += 1
        for r in old:
            self.spark.sql(f"drop table {r}")
            removed(self.spark, f"{self.folder}/{r}")

    def shared(self) -> DataFrame:
        """Hashes that occur in two texts at least, whether of one run or of two."""
        return self.merged().filter("lo < hi").select("hash")

    def close(self) -> None:
        for name in self.runs:
            self.spark.sql(f"drop table if exists {name}")
        removed(self.spark, self.folder)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py()
            found = batch.column(2)[row].values
            pos = found.field("pos").to_numpy()
            lefts = np.minimum(pos, REACH)
            yield pa.RecordBatch.from_arrays(
                [
                    found.field("hash"), pa.array(np.full(len(pos), batch.column(0)[row].as_py(), dtype=np.int64)), found.field("pos"), pa.array(lefts.astype(np.int32)),
                    pa.array([text[p - a : p + LENGTH] for p, a in zip(pos.tolist(), lefts.tolist())], pa.string()),
                ],
                names=["hash", "doc", "pos", "lead", "context"],
            )


def _equal_windows(points: np.ndarray, valid: np.ndarray, hashes: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context and offset a context of the same anchor, from another text, with an equal window; -1 if none.

    ``rows, docs``: the least and the greatest text of each context, in order of the text.
    """
    n, offsets = valid.shape
    partner = np.full((n, offsets), -1, dtype=np.int32)
    up, down = _tables(points.shape[1])
    window = np.empty((n, offsets), np.uint64)
    for at in range(0, n, 2048):
        part = _mix(points[at : at + 2048].astype(np.uint64) + np.uint64(1)) * up[: points.shape[1]]
        sums = np.concatenate([np.zeros((len(part), 1), np.uint64), np.cumsum(part, axis=1)], axis=1)
        begin = REACH - np.arange(offsets)
        window[at : at + 2048] = (sums[:, begin + LENGTH] - sums[:, begin]) * down[begin]
    for o in range(offsets):
        live = valid[rows, o]
        r, d = rows[live], docs[live]
        key = _mix(window[r, o] ^ hashes[r])
        order = np.argsort(key, kind="stable")
        r, d, key = r[order], d[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        size = np.diff(np.append(first, len(key)))
        low, high = np.repeat(first, size), np.repeat(first + size - 1, size)
        other = np.where(d != d[low], low, high)
        hit = d[other] != d
        partner[r[hit], o] = r[other[hit]]
    return partner


def _verified(points: np.ndarray, partner: np.ndarray, hashes: np.ndarray, valid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of offsets (row, first, last) at which a context and its partner are equal character by character."""
    n, offsets = partner.shape
    edge = np.concatenate([np.ones((n, 1), bool), partner[:, 1:] != partner[:, :-1]], axis=1)
    at = np.flatnonzero(edge.ravel())
    last = np.append(at[1:], n * offsets) - 1
    keep = partner.ravel()[at] >= 0
    at, last = at[keep], last[keep]
    row, first, stop = at // offsets, at % offsets, last % offsets
    other = partner[row, first]
    good = np.empty(len(row), bool)
    for k in range(0, len(row), 8192):
        cut = slice(k, k + 8192)
        differ = np.cumsum(points[row[cut]] != points[other[cut]], axis=1, dtype=np.int32)
        differ = np.concatenate([np.zeros((len(differ), 1), np.int32), differ], axis=1)
        i = np.arange(len(differ))
        good[cut] = differ[i, REACH - first[cut] + LENGTH] == differ[i, REACH - stop[cut]]
    extra = []
    for r, a, b in zip(row[~good], first[~good], stop[~good]):  # hashes collided: look through the anchor's contexts
        peers = np.flatnonzero((hashes == hashes[r]) & ((lo != lo[r]) | (hi != hi[r]) | (lo != hi)))
        for o in range(a, b + 1):
            c = slice(REACH - o, REACH - o + LENGTH)
            if any(valid[p, o] and p != r and (points[p, c] == points[r, c]).all() for p in peers):
                extra.append((r, o, o))
    more = np.array(extra, dtype=np.int64).reshape(-1, 3)
    return np.concatenate([row[good], more[:, 0]]), np.concatenate([first[good], more[:, 1]]), np.concatenate([stop[good], more[:, 2]])


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    contexts, lead = table.column("context").to_pylist(), table.column("lead").to_numpy()
    width = REACH + LENGTH
    points = code_points("".join(("\0" * (REACH - a) + c).ljust(width, "\0") for a, c in zip(lead.tolist(), contexts))).reshape(len(contexts), width)
    ends = REACH - lead + np.array([len(c) for c in contexts])
    o = np.arange(REACH + 1)
    valid = (o <= lead[:, None]) & (width - o <= ends[:, None])
    hashes = table.column("hash").to_numpy().view(np.uint64)
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    rows, docs = np.tile(np.arange(len(lo)), 2), np.concatenate([lo, hi])
    order = np.argsort(docs, kind="stable")
    partner = _equal_windows(points, valid, hashes, rows[order], docs[order])
    row, first, last = _verified(points, partner, hashes, valid, lo, hi)
    keys = table.select(["hash", "k1", "k2", "lead"]).take(pa.array(row))
    return keys.append_column("first", pa.array(first.astype(np.int32))).append_column("last", pa.array(last.astype(np.int32)))


_KEYS = ["hash", "k1", "k2", "lead"]


def _window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each context its offsets and a hash of the window at each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            texts, lead = part.column("context").to_pylist(), part.column("lead").to_numpy()
            ends = np.cumsum([len(x) for x in texts])
            starts = ends - [len(x) for x in texts]
            hashes = window_hashes(code_points("".join(texts)), LENGTH)
            places = [np.arange(s, e - LENGTH + 1) for s, e in zip(starts, ends)]
            row = np.repeat(np.arange(len(texts)), [len(x) for x in places])
            place = np.concatenate(places) if places else np.empty(0, np.int64)
            arrays = [part.column(c).take(pa.array(row)) for c in ("hash", "k1", "k2", "lead", "lo", "hi")]
            offset = (lead[row] - (place - starts[row])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(offset), pa.array(hashes[place].view(np.int64))], names=["hash", "k1", "k2", "lead", "lo", "hi", "o", "name"])


def _frequent_ranges(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts, grouped by Spark: windows meet by hash, one row per distinct
    hash and task; only windows that two texts have by hash are then told apart by their characters, again combined before
    they are shuffled."""
    slim = contexts.select("hash", "k1", "k2", "lead", "lo", "hi", "context").filter(F.length("context") >= LENGTH)
    windows = written(slim.mapInArrow(_window_names, "hash bigint, k1 bigint, k2 bigint, lead int, lo bigint, hi bigint, o int, name bigint"), "spans-windows")
    equal = windows.groupBy("hash", "name").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b").select(F.xxhash64("hash", "name").alias("w"))
    equal = written(equal.distinct(), "spans-equal")
    keyed = hot_key_join(sketch_semi(windows.withColumn("w", F.xxhash64("hash", "name")), equal, "w"), equal, "w", F.col("k1"))
    texts = contexts.select(*_KEYS, "context")
    per_context = keyed.groupBy(*_KEYS).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("o").alias("os"))  # REACH + 1 at most
    shown = per_context.join(texts, _KEYS).withColumn("o", F.explode("os"))
    shown = shown.withColumn("window", F.substring(F.col("context"), F.col("lead") - F.col("o") + 1, F.lit(LENGTH))).drop("context", "os")
    name = F.struct(F.xxhash64(F.lit(3), "window"), F.xxhash64(F.lit(4), "window"), "hash").alias("w")
    named = written(shown.select(*_KEYS, "o", "lo", "hi", "window", F.to_json(name).alias("w")), "spans-named")
    alike = named.groupBy("w").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.min("window").alias("x"), F.max("window").alias("y")).filter("a < b")
    alike = written(alike, "spans-alike")
    if alike.filter("x <> y").limit(1).count():
        raise RuntimeError("two windows agree in 128 bits of hash")
    hit = hot_key_join(named.drop("window", "lo", "hi"), alike.select("w"), "w", F.col("k1"))
    return hit.select(*_KEYS, F.col("o").alias("first"), F.col("o").alias("last"))


def shared_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batches: int = BATCHES, frequent: int = FREQUENT) -> DataFrame:
    """The longest stretches whose every character lies in a run of 200 characters that another text has too.

    Columns ``doc_id, span_start, span_len``, in Unicode characters from 0; touching stretches are one. Texts
    are told apart by id: rows that repeat an id are the same text and share nothing with each other. Null,
    empty and short texts have no span; null ids are left out; other columns are ignored, whatever their names.
    An empty table gives no spans. The corpus goes through the index in ``batches``, as it would arrive: each is joined
    with the runs of those before it, and the runs are compacted on the way.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.col(text_column).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= LENGTH))
    every = written(fingerprints(texts).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "spans-postings", by="batch")
    index = SpanIndex(spark)
    try:
        met = [index.arrive(every.filter(F.col("batch") == b)) for b in range(batches)]
    finally:
        index.close()
    shared = written(reduce(DataFrame.unionByName, met).distinct(), "spans-shared")
    anchors = written(hot_key_join(sketch_semi(every.drop("batch"), shared, "hash"), shared, "hash", F.col("doc")), "spans-anchors")
    places = anchors.groupBy("doc").agg(F.array_distinct(F.collect_list(F.struct("pos", "hash"))).alias("found"))  # as many as the text has
    kept = sketch_semi(texts, anchors.select("doc"), "doc").join(places, "doc").select("doc", "text", "found")
    around = kept.mapInArrow(_contexts, "hash bigint, doc bigint, pos int, lead int, context string")
    around = written(around.withColumns({"k1": F.xxhash64(F.lit(1), "context"), "k2": F.xxhash64(F.lit(2), "context")}), "spans-around")
    alike = around.groupBy(*_KEYS).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("context").alias("context"), F.max("context").alias("context2"))
    alike = written(alike, "spans-contexts")
    if alike.filter("context <> context2").limit(1).count():
        raise RuntimeError("two contexts agree in 128 bits of hash")
    alike = alike.drop("context2")
    n = alike.count()
    hot = alike.groupBy("hash").count().filter(F.col("count") > frequent).select("hash")
    any_hot = bool(hot.limit(1).count())
    common = alike.join(hot, "hash", "left_anti") if any_hot else alike
    tasks = max(1, -(-n // TASK_CONTEXTS))
    ranges = common.groupBy(F.pmod("hash", F.lit(tasks)).alias("task")).applyInArrow(_compare, "hash bigint, k1 bigint, k2 bigint, lead int, first int, last int")
    if any_hot:
        ranges = ranges.unionByName(_frequent_ranges(alike.join(hot, "hash", "left_semi")))
    of_context = ranges.groupBy(*_KEYS).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # REACH + 1 at most
    name = F.concat_ws(":", *_KEYS).alias("name")
    placed = hot_key_join(around.select("doc", "pos", name), of_context.select(name, "ranges"), "name", F.col("doc"))
    spans = placed.select("doc", "pos", F.explode("ranges").alias("r"))
    spans = spans.select("doc", (F.col("pos") - F.col("r.last")).alias("start"), (F.col("pos") - F.col("r.first") + LENGTH).alias("stop"))
    by_start = Window.partitionBy("doc").orderBy("start", "stop")  # as many rows as the text has anchors
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("span", F.sum("new").over(by_start))
    merged = spans.groupBy("doc", "span").agg(F.min("start").alias("span_start"), F.max("stop").alias("stop"))
    return merged.select(F.col("doc").alias("doc_id"), "span_start", (F.col("stop") - F.col("span_start")).alias("span_len"))


def shared_share(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """For each text how many of its characters stand in shared spans, and their share (0 for null and empty texts)."""
    total = spans.groupBy("doc_id").agg(F.sum("span_len").alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    size = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    out = size.join(total, "doc_id", "left").na.fill(0, ["shared_chars", "n_spans"])
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
