"""Packing: every text once, no container too full, bounds sound."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from strataloom.llm import packing as P


def optimum(sizes, capacity):
    for k in itertools.count(1):
        def place(i, room):
            if i == len(sizes):
                return True
            seen = set()
            for b in range(k):
                if room[b] >= sizes[i] and room[b] not in seen:
                    seen.add(room[b])
                    room[b] -= sizes[i]
                    if place(i + 1, room):
                        return True
                    room[b] += sizes[i]
            return False

        if place(0, [capacity] * k):
            return k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = P.best_fit_decreasing(np.array(sizes), 20)
    fills = np.bincount(bins, weights=sizes)
    assert fills.max() <= 20 and fills.min() > 0
    assert P.lower_bound(np.bincount(sizes, minlength=21)) <= optimum(sizes, 20) <= len(fills)


def test_bound_beats_volume():
    assert P.lower_bound(np.bincount([11] * 7, minlength=21)) == 7
    assert P.lower_bound(np.bincount([7] * 6, minlength=21)) == 3


def check(spark, sizes, **kw):
    df = spark.createDataFrame([Row(doc_id=i, n_tokens=s, tokens="clash", part=1, grp=2) for i, s in sizes], "doc_id bigint, n_tokens int, tokens string, part int, grp int")
    rows = P.pack(df, **kw).collect()
    capacity = kw.get("capacity", P.CAPACITY)
    got = {}
    for r in rows:
        assert r["tokens"] == sum(x["tokens"] for x in r["texts"]) <= capacity and r["n_texts"] == len(r["texts"]) > 0
        for x in r["texts"]:
            got.setdefault(x["doc_id"], []).append((x["first_token"], x["tokens"]))
    want = {}
    for i, s in sizes:
        s = max(0, s or 0)
        want.setdefault(i, []).extend((k, min(capacity, s - k)) for k in range(0, max(s, 1), capacity))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r["container_id"] for r in rows}) == len(rows)
    return rows


def test_pack(spark):
    rng = np.random.default_rng(5)
    sizes = [(i, int(s)) for i, s in enumerate(rng.integers(0, 1500, 400))] + [(1000, None), (1001, 0), (1002, 5000), (1003, 2048), (1004, -3), (1002, 5000)]
    one = check(spark, sizes)
    many = check(spark, sizes, group_items=40)
    assert len(many) <= 1.05 * len(one)
    assert P.fill_report(P.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens int"))).first()["lower_bound"] == 1


def test_empty_and_blank(spark):
    check(spark, [])
    assert len(check(spark, [(1, 0), (2, None)])) == 1
