"""Splitting: against a slow reading of the rules, and the odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from strataloom.llm import splitting as S


def test_sparse_table_against_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 101):
        v = rng.integers(0, 4, n)
        t = S.StrongestCut(v)
        for _ in range(100):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a, n))
            assert t.query(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


def text_of(rng, n):
    return "".join(f"w{rng.randrange(50)}" + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "\n\n# ", "! ", "　"]) for _ in range(n))


@pytest.mark.parametrize("limit,overlap", [(20, 4), (400, 40), (7, 0)])
def test_pieces_cover_and_overlap(limit, overlap):
    rng = random.Random(3)
    for n in (limit, limit + 1, 5 * limit, 900):
        text = text_of(rng, n)
        words = text.split()
        out = S.split_text(text, limit, overlap)
        if len(words) <= limit:
            assert out == []
            continue
        at = 0
        for k, first, size, piece, _, _ in out:
            assert piece.split() == words[first : first + size] and size <= limit and piece in text
            assert first == (at - overlap if k else 0)
            at = first + size
        assert at == len(words) and [p[0] for p in out] == list(range(len(out)))


def test_cut_is_strongest_then_rightmost():
    words = ["w"] * 900
    text = " ".join(words[:250]) + ".\n\n" + " ".join(words[:100]) + ". " + " ".join(words[:500])
    out = S.split_text(text)
    assert out[0][2] == 250 and out[0][4] == "paragraph"
    text = " ".join("w." if i in (220, 390) else "w" for i in range(900))
    assert S.split_text(text)[0][2] == 391 and S.split_text(text)[0][4:] == ("sentence", "forced")


def test_rows(spark):
    rows = [
        Row(id="a", content=None, piece="x", cut=1), Row(id="b", content="", piece="x", cut=1), Row(id="c", content=" \n" * 900, piece="x", cut=1),
        Row(id="d", content="w " * 401, piece="x", cut=1), Row(id="e", content="w. " * 401, piece="x", cut=1), Row(id="f", content="w. " * 400, piece="x", cut=1),
        Row(id="g", content="w" * 100_000, piece="x", cut=1), Row(id="e", content="w. " * 401, piece="x", cut=1), Row(id=None, content="a b. " * 30_000, piece="x", cut=1),
    ]
    df = spark.createDataFrame(rows)
    got = {}
    for r in S.split_oversized(df).collect():
        got.setdefault(r["id"], []).append(r)
    assert {k: {x["cut"] for x in v} for k, v in got.items()} == {"d": {"forced"}, "e": {"natural"}, None: {"natural"}}
    assert len(got["e"]) == 4 and max(r["n_words"] for r in got[None]) <= 400
    assert S.split_oversized(df.limit(0)).count() == 0


def test_forced_by_the_index(monkeypatch):
    """Whether a text is forced is what the range-maximum index says of its windows."""
    import random

    import numpy as np

    from strataloom.llm import splitting as S

    rng = random.Random(2)
    for _ in range(300):
        n, width = rng.randrange(1, 60), rng.choice([2, 3, 7, 20])
        strengths = np.array([0] + [rng.choice([0] * rng.choice([1, 3, 12]) + [1, 2, 4]) for _ in range(n - 1)], np.int8)
        marks = np.concatenate([[0], np.flatnonzero(strengths), [n]])
        assert S.without_boundary(S.StrongestCut(strengths), width) == bool(np.diff(marks).max() > width)
    text = "one two. " * 400
    assert S.split_text(text)[0][-1] == "natural"
    monkeypatch.setattr(S.StrongestCut, "query", lambda self, first, last: 0)
    assert S.split_text(text)[0][-1] == "forced"
