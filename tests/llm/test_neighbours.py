"""Neighbours: recall and exact similarities against brute force, copies, and the odd cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import neighbours as N
from strataloom.llm.queries import p1_found, p1_neighbours


def brute(ids, x, k):
    x = x.astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    by_id = np.argsort(np.argsort(ids))
    order = np.lexsort((np.broadcast_to(by_id, sim.shape), -np.round(sim, 9)), axis=1)[:, :k]
    return {ids[i]: [(ids[j], sim[i, j]) for j in order[i]] for i in range(len(ids))}


def test_recall_on_table(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["id"]: [(x["id"], x["similarity"]) for x in r["neighbours"]] for r in p1_neighbours(spark, folder).collect()}
    rows = {}
    for r in spark.read.parquet(f"{folder}/knowledge.parquet").select(F.lower("id").alias("id"), "embedding").collect():
        e = r["embedding"]
        if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e) and any(e):
            rows[r["id"]] = e
    ids = sorted(rows)
    want = brute(ids, np.array([rows[i] for i in ids], dtype=np.float32), 10)
    assert set(got) == set(want)
    hit = np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in ids])
    assert hit >= 0.95
    exact = {(i, a): s for i in ids for a, s in want[i]}
    assert all(abs(exact[i, a] - s) < 1e-6 for i in ids for a, s in got[i] if (i, a) in exact)
    pairs = {(min(i, a), max(i, a)) for i in ids for a, s in want[i] if s >= 0.9}
    found = {tuple(r) for r in p1_found(spark, folder).collect()}
    assert len(pairs) > 20 and len(found & pairs) >= 0.99 * len(pairs) and not found - pairs


@pytest.mark.parametrize("change", [{}, {"group_rows": 100, "slice_rows": 300, "task_rows": 100}, {"most_cells": 4, "fine_probes": 200, "group_rows": 100}])
def test_slices_and_copies(spark, change):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[0]  # a third are copies
    x[600:620] = 3 * x[5]
    ids = [f"r{i:04d}" for i in range(900)]
    df = spark.createDataFrame([(i, v.tolist(), "clash", 1) for i, v in zip(ids, x)], "id string, embedding array<float>, vec string, cell int")
    df = df.unionByName(df.limit(50))
    s = N.Settings(dimensions=8, codebooks=6, coarse_books=3, codewords=64, probes=40, shortlist=60, **change)
    got = {r["id"]: [x["id"] for x in r["neighbours"]] for r in N.most_similar(df, settings=s).collect()}
    want = brute(ids, x, 10)
    assert set(got) == set(ids) and all(len(v) == 10 and i not in v for i, v in got.items())
    assert got["r0450"] == ["r0000", *[f"r{i:04d}" for i in range(300, 309)]]
    assert got["r0301"] == ["r0000", "r0300", *[f"r{i:04d}" for i in range(302, 310)]]
    assert np.mean([len(set(got[i]) & {a for a, _ in want[i]}) / 10 for i in ids]) > 0.93


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", None), ("h", [1.0]), ("i", []), (None, [1.0, 1.0]), ("j", [None, 1.0]), ("a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    s = N.Settings(dimensions=2, codebooks=2, codewords=4)
    got = {r["id"]: [(x["id"], round(x["similarity"], 6)) for x in r["neighbours"]] for r in N.most_similar(df, settings=s).collect()}
    assert got == {"a": [("b", 1.0), ("c", 0.0)], "b": [("a", 1.0), ("c", 0.0)], "c": [("a", 0.0), ("b", 0.0)]}
    one = {r["id"]: r["neighbours"] for r in N.most_similar(df.filter("id = 'c'"), settings=s).collect()}
    assert one == {"c": []}
    assert N.most_similar(df.limit(0), settings=s).count() == 0


def test_cells_grow_with_the_vectors():
    s = N.Settings()
    for n in (10**4, 10**6, 10**7, 10**8, 10**9):
        coarse, finest = N.wanted_cells(n, s)
        assert coarse <= s.most_cells and finest <= 256 * coarse
    assert s.fine_probes / N.wanted_cells(10**8, s)[1] * 10**8 < 100_000
    # groups take cells, so what surrounds them isn't sent to each cell
    rng = np.random.default_rng(0)
    cells = rng.normal(size=(4096, 16)).astype(np.float32)
    group, seekers = N.plan_groups(cells, np.full(4096, 24_000), s)
    assert 6 <= np.bincount(group).min() and np.bincount(group).max() <= s.group_cells
    assert np.mean([len(x) for x in seekers]) < s.probes


def test_cut_cells(spark):
    """Few cells, each cut into many: most codes aren't looked at, recall holds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 16))
    x = (centres[rng.integers(0, 150, 6000)] + 0.35 * rng.normal(size=(6000, 16))).astype(np.float32)
    s = N.Settings(dimensions=16, codebooks=8, coarse_books=4, codewords=64, most_cells=16, probes=8, fine_probes=60, shortlist=48)
    finest = N.wanted_cells(6000, s)[1]
    books = N.fit(x / np.sqrt((x * x).sum(1))[:, None], 10**6, s)
    assert len(books.cells) == 16 and len(books.cuts) == 256 and finest > 16
    ids = [f"r{i:04d}" for i in range(6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, embedding array<float>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in N.most_similar(df, settings=s).collect()}
    want = brute(ids, x, 10)
    assert np.mean([len(set(got[i]) & {a for a, _ in want[i]}) / 10 for i in ids]) > 0.9
