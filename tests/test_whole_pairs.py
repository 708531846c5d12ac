"""Pairs of records come out whole, also on keys that hold many of them."""

from itertools import combinations

import pytest

from strataloom.plans.more import listed_for
from strataloom.plans.search import component_pairs


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_all_pairs_of_a_component(spark, block_rows):
    rows = [(f"r{i:02d}", "hot", [float(i % 5 + 1), 1.0], None if i % 9 == 0 else f"2026-01-{30 - i % 20:02d} 00:00:00") for i in range(40)]
    rows += [("a", "pair", [1.0, 0.0], "2026-02-02 00:00:00"), ("b", "pair", [0.0, 1.0], "2026-02-01 00:00:00"), ("c", "alone", [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id string, component_key string, embedding array<float>, at string").selectExpr("id", "component_key", "embedding", "cast(at as timestamp) as created_at")
    got = [tuple(r) for r in component_pairs(df, block_rows).collect()]
    order = sorted((r[3] is not None, r[3] or "", r[0], r[1], r[2]) for r in rows)
    want = {}
    for (*_, prior, key, x), (*_, later, other, y) in combinations(order, 2):
        if key == other:
            want[later, prior] = sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    assert len(got) == len(want) == 40 * 39 // 2 + 1
    assert {(i, p): s for _, i, p, s in got} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_candidates_for_every_keyed_record(spark, block_rows):
    rows = [(f"r{i:02x}", "s", "hot" if i % 3 else "cool", "current" if i % 2 else "draft") for i in range(1, 50)] + [("x", "t", "hot", "current"), ("y", "u", "one", "current")]
    got = [tuple(r) for r in listed_for(spark.createDataFrame(rows, "id string, system string, component_key string, status string"), block_rows).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1:3] == b[1:3] and a[0] != b[0] and b[3] == "current"}
    assert len(got) == len(want) > 500 and set(got) == want
