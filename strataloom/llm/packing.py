"""Filling containers of a fixed capacity with texts, sizes in tokens.

Groups of texts are packed by best-fit decreasing, each in its own task. Dual feasible functions give a lower
bound for the containers of each group: a group that meets its bound is certified and stays. Groups with a gap
exchange the texts of their containers that aren't full: these are put into new groups and packed again, and
that is repeated as long as it takes fewer containers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import written

CAPACITY = 2048
#: Texts per group: what one task packs at once.
GROUP_ITEMS = 20_000
_ITEM = "struct<doc_id:bigint,part:int,first_token:int,tokens:int>"
_BINS = f"round int, grp bigint, bin int, tokens bigint, n_items int, bound int, bins int, items array<{_ITEM}>"


def lower_bound(counts: np.ndarray) -> int:
    """Least number of containers for ``counts[s]`` items of each size s up to the capacity, by dual feasible functions."""
    capacity = len(counts) - 1
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return int(counts.sum() > 0)
    n = counts[sizes].astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    # items above capacity - e count whole, those below e not at all, the rest as they are
    for e in np.unique(np.concatenate([sizes[2 * sizes <= capacity], [1]])):
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * n).sum()) // capacity))
    # sizes rounded to multiples of 1/k, but for those that are whole multiples of 1/(k+1)
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: largest items first, each into the fullest container that has room."""
    bins = np.empty(len(sizes), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by their free room
    rooms, opened = 0, 0  # bit r is set while a container has room r
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, opened
            opened += 1
        bins[i] = b
        waiting[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def _packer(round_no: int, capacity: int):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "part"], kind="stable")
        sizes = items["tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1))
        rows = list(zip(items["doc_id"], items["part"], items["first_token"], items["tokens"]))
        order = np.argsort(bins, kind="stable")
        edges = np.flatnonzero(np.diff(bins[order], prepend=-1))
        held = [[rows[i] for i in part] for part in np.split(order, edges[1:])]
        return pd.DataFrame(
            {
                "round": round_no, "grp": key[0], "bin": np.arange(len(held)), "tokens": [sum(x[3] for x in h) for h in held],
                "n_items": [len(h) for h in held], "bound": bound, "bins": len(held),
                "items": [[dict(zip(("doc_id", "part", "first_token", "tokens"), map(int, x))) for x in h] for h in held],
            }
        )

    return pack


def _packed(items: DataFrame, n: int, round_no: int, capacity: int, group_items: int) -> DataFrame:
    groups = max(1, -(-n // group_items))
    keyed = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "part", F.lit(round_no)), F.lit(groups)))
    return keyed.groupBy("grp").applyInPandas(_packer(round_no, capacity), _BINS)


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int | None = None) -> DataFrame:
    """Containers for the texts of ``sizes`` (``doc_id, n_tokens``), one row per container.

    Columns ``container_id, tokens, n_texts, certified, texts array<struct<doc_id, part, first_token, tokens>>``. A text
    stays whole (part 0) unless it alone is longer than ``capacity``: then its parts fill whole containers
    and the rest is packed like any other text. Texts without tokens (null, empty) take no room and are listed
    in some container; a null size counts as 0. ``certified`` tells that the container's group met its lower
    bound. Repeated rows are packed as often as they come. An empty table gives no container.
    """
    size = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0))
    parts = F.greatest(F.ceil(size / capacity), F.lit(1)).cast("int")
    items = written(
        sizes.select("doc_id", size.alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(
            "doc_id", "part", (F.col("part") * capacity).cast("int").alias("first_token"), F.least(F.col("_n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("tokens"), F.monotonically_increasing_id().alias("item")
        ),
        "packing-items",
    )
    whole = items.filter(F.col("tokens") == capacity).select(
        F.lit(-1).alias("round"), F.col("item").alias("grp"), F.lit(0).alias("bin"), F.col("tokens").cast("bigint").alias("tokens"), F.lit(1).alias("n_items"),
        F.lit(1).alias("bound"), F.lit(1).alias("bins"), F.array(F.struct("doc_id", "part", "first_token", "tokens")).alias("items"),
    )
    rest = items.filter(F.col("tokens") < capacity)
    state = written(_packed(rest.drop("item"), rest.count(), 0, capacity, group_items), "packing-bins")
    for k in count(1) if rounds is None else range(1, rounds + 1):  # each round but the last saves a container
        loose = (F.col("bins") > F.col("bound")) & (F.col("tokens") < capacity)
        pool = state.filter(loose)
        before = pool.agg(F.count(F.lit(1)).alias("bins"), F.sum("n_items").alias("items"), F.ceil(F.sum("tokens") / capacity).alias("least")).first()
        if before["bins"] < 2 or before["bins"] <= before["least"]:
            break
        exchanged = pool.select(F.explode("items").alias("i")).select("i.*")
        again = written(_packed(exchanged, before["items"], k, capacity, group_items), "packing-bins")
        if again.count() >= before["bins"]:
            break
        state = written(state.filter(~loose).unionByName(again), "packing-bins")
    every = state.unionByName(whole)
    return every.select(
        F.xxhash64("round", "grp", "bin").alias("container_id"), "tokens", F.col("n_items").alias("n_texts"), (F.col("bins") == F.col("bound")).alias("certified"), F.col("items").alias("texts"),
    )


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill, and the lower bound for the whole corpus."""
    spark = containers.sparkSession
    sizes = containers.select(F.explode("texts.tokens").alias("s")).groupBy("s").count().collect()  # at most one row per size
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes:
        counts[r["s"]] = r["count"]
    total = containers.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
    return total.select("n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"), F.lit(lower_bound(counts)).alias("lower_bound"))
