"""Shared spans against a plain search over all windows."""

import random

import pytest

from strataloom.llm import spans as S


def brute(texts, length=S.LENGTH):
    where = {}
    for i, t in texts.items():
        for p in range(len(t or "") - length + 1):
            where.setdefault(t[p : p + length], set()).add(i)
    out = []
    for i, t in texts.items():
        covered = bytearray(len(t or ""))
        for p in range(len(t or "") - length + 1):
            if len(where[t[p : p + length]]) > 1:
                covered[p : p + length] = b"\1" * length
        p = 0
        while p < len(covered):
            q = p
            while q < len(covered) and covered[q]:
                q += 1
            if q > p:
                out.append((i, p, q - p))
            p = q + 1
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh .\n" + "é\U0001f600日"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.choice([199, 200, 201, 230, 330, 700])) for _ in range(12)]
    texts = {}
    for i in range(120):
        parts = [word(rng.randrange(0, 300))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, word(rng.choice([0, 0, 1, 50, 250]))]
        texts[i] = "".join(parts)
    texts |= {200: None, 201: "", 202: " " * 199, 203: " " * 200, 204: " " * 900, 205: "a" * 500, 206: "b" * 250 + "a" * 300 + "c" * 250, 207: texts[3], 208: texts[3], 209: "ab" * 400, 210: "x" + "ab" * 150}
    return texts


@pytest.mark.parametrize("seed,frequent,batches", [(1, S.FREQUENT, 2), (2, 3, 3), (3, 10, 6)])
def test_against_all_windows(spark, seed, frequent, batches):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()] + [(4, texts[4], "clash", 1), (None, texts[3], "x", 1)], "doc_id bigint, text string, doc string, hash int")
    out = S.shared_spans(df, batches=batches, frequent=frequent)
    want = brute(texts)
    assert len(want) > 40 and sorted(map(tuple, out.collect())) == want
    share = {r["doc_id"]: r for r in S.shared_share(df.filter("doc_id is not null"), out).collect()}
    assert share[207]["share"] == 1.0 and share[200]["share"] == 0.0 and len(share) == len(texts)


def test_segments_and_empty(spark, monkeypatch):
    texts = corpus(5)
    got = {}
    for size in (S.SEGMENT, 300):
        monkeypatch.setattr(S, "SEGMENT", size)
        rows = []
        for ids, parts, bases in S._segments(list(texts), [t or "" for t in texts.values()]):
            import numpy as np

            ends = np.cumsum([len(t) for t in parts])
            starts = ends - [len(t) for t in parts]
            at, h = S.anchors_of(S.code_points("".join(parts)), starts, ends)
            own = np.searchsorted(ends, at, side="right")
            rows += [(ids[o], int(a - starts[o] + bases[o]), int(x)) for o, a, x in zip(own, at, h)]
        got[size] = set(rows)
    assert got[S.SEGMENT] == got[1 << 20]
    assert S.shared_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_index_batches_and_compaction(spark):
    """Runs merge to the same index however the corpus arrives, and a new batch finds what earlier ones have."""
    texts = {i: t for i, t in corpus(7).items() if t}
    df = spark.createDataFrame(list(texts.items()), "doc bigint, text string")
    parts = [S.fingerprints(df.filter(f"doc % 5 = {b}")) for b in range(5)]
    whole, single = S.SpanIndex(spark, most_runs=9), S.SpanIndex(spark, most_runs=1)
    for p in parts[:4]:
        whole.add(p)
        single.add(p)
    assert len(whole.runs) == 4 and len(single.runs) == 1
    rows = lambda i: sorted(map(tuple, i.merged().collect()))
    assert rows(whole) == rows(single)
    old = {r["hash"] for p in parts[:4] for r in p.collect()}
    assert {r[0] for r in single.known(parts[4]).collect()} == old & {r["hash"] for r in parts[4].collect()}
    whole.add(parts[4])
    seen = {}
    for r in S.fingerprints(df).collect():
        seen.setdefault(r["hash"], set()).add(r["doc"])
    assert {r[0] for r in whole.shared().collect()} == {h for h, d in seen.items() if len(d) > 1}
    two = S.SpanIndex(spark, most_runs=9)
    two.add(parts[0])
    two.add(parts[1])
    plan = two.shared()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hash" not in plan
    two.close()
    whole.close()
    single.close()


def test_arrival_by_batches(spark, monkeypatch):
    """Batch after batch the index tells what is shared with all that came before; runs are compacted on the way and removed."""
    import os

    texts = {i: t for i, t in corpus(8).items() if t}
    postings = S.fingerprints(spark.createDataFrame(list(texts.items()), "doc bigint, text string")).cache()
    index, seen, told = S.SpanIndex(spark, most_runs=2), {}, set()
    for b in range(7):
        batch = postings.filter(f"doc % 7 = {b}")
        rows = batch.collect()
        for r in rows:
            seen.setdefault(r["hash"], set()).add(r["doc"])
        got = {r[0] for r in index.arrive(batch).collect()}
        assert got == {r["hash"] for r in rows if len(seen[r["hash"]]) > 1}
        told |= got
    assert index.compactions == 5 and len(index.runs) == 2
    assert told == {h for h, d in seen.items() if len(d) > 1}
    index.close()
    assert not os.path.exists(index.folder)
    postings.unpersist()
    compactions = []
    compact = S.SpanIndex.compact
    monkeypatch.setattr(S.SpanIndex, "compact", lambda self: (compactions.append(1), compact(self)))
    S.shared_spans(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert compactions  # the query's own batches reach it


def test_passage_of_a_third_of_all_texts(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(260)
    texts = {i: word(150) + (passage + word(60) if i % 3 == 0 else word(200)) for i in range(9000)}
    got = {tuple(r) for r in S.shared_spans(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), frequent=1000).collect()}
    at = {i: texts[i].index(passage) for i in texts if i % 3 == 0}
    # texts may agree in a character or two beyond the passage by chance
    assert {g[0] for g in got} == set(at) and all(p <= at[i] and p + n >= at[i] + 260 and n < 275 for i, p, n in got)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghijklmnop qrst\n", k=S.SEGMENT + 60_000))
    cut = long[S.SEGMENT - 300 : S.SEGMENT + 300]
    texts = {1: long, 2: "#" * 500 + cut + "#" * 10, 3: "#" * 10 + long[1000:1199], 4: "z" * 50 + long[-250:]}
    got = sorted(map(tuple, S.shared_spans(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()))
    assert got == [(1, S.SEGMENT - 300, 600), (1, len(long) - 250, 250), (2, 500, 600), (4, 50, 250)]
