"""Near duplicates against all pairs, on the small table and on made cases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import neardup as D
from strataloom.llm.queries import p2_found

WORD = re.compile(r"[^\W_]+")


def gram_set(text, width):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(texts, width, t):
    sets = {i: s for i, x in texts.items() if x and (s := gram_set(x, width))}
    ids = sorted(sets)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if o and Fraction(o, len(sets[a]) + len(sets[b]) - o) >= t:
                out.add((a, b))
    return out


def joined(sets, t, cell=D.CELL_SETS, part=None):
    """Pairs that the tries let meet often enough, by way of the operator's own stages."""
    count = Counter(x for s in sets.values() for x in s)
    order = lambda x: (int(D.count_code(count[x])), x)
    h, rec, n, pos = [], [], [], []
    for name, s in sets.items():
        for place, x in enumerate(sorted(s, key=order)[: len(s) - D.least_of_one(len(s), t) + 1]):
            h.append(int(x) << 8), rec.append(name), n.append(len(s)), pos.append(place)
    h, rec, n, pos = np.array(h, np.uint64), np.array(rec, np.int64), np.array(n, np.uint32), np.array(pos, np.uint32)
    code = D.count_code(np.array([count[int(x) >> 8] for x in h]))
    part = part or D.PART_POSTINGS
    pieces = [(rec[at], code[at].astype(np.uint32) << 24 | (name >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.uint32), size, pos[at]) for at, name, size in D.in_parts(h, rec, n, code, part)]
    rec, token, n, pos = (np.concatenate(c) for c in zip(*pieces))
    met, times = {}, {}
    for a, b, na, nb, m in D.PrefixTrie(*D.owned(rec, token, n, pos, t, cell, part)).pairs(t):
        assert (a < b).all()
        for x in zip(a.tolist(), b.tolist(), na.tolist(), nb.tolist(), m.tolist()):
            met[x[:4]] = met.get(x[:4], 0) + x[4]
            times[x[:4]] = times.get(x[:4], 0) + 1
    return met, times


def enough(na, nb, met, t):
    need = D.needed(na + nb, t)
    return met >= min(D.MEETINGS, need - D.least_of_one(max(na, nb), t) + 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(1, 30), min_size=1), min_size=1, max_size=14), st.sampled_from(["0.6", "0.8", "1/3", "1"]), st.sampled_from([2, 3, 4096]), st.sampled_from([None, 2, 4]))
def test_tries_lose_no_pair(sets, t, cell, part):
    t = Fraction(t)
    named = {k: s for k, s in enumerate(map(frozenset, sets))}
    met, _ = joined(named, t, cell, part)
    for a in named:
        for b in range(a + 1, len(named)):
            o = len(named[a] & named[b])
            if o and Fraction(o, len(named[a] | named[b])) >= t:
                na, nb = len(named[a]), len(named[b])
                assert enough(na, nb, met.get((a, b, na, nb), 0), t)
    count = Counter(x for s in named.values() for x in s)
    prefix = {k: set(sorted(s, key=lambda x: (int(D.count_code(count[x])), x))[: len(s) - D.least_of_one(len(s), t) + 1]) for k, s in named.items()}
    for (a, b, _, _), m in met.items():
        assert 0 < m <= len(prefix[a] & prefix[b])  # each common n-gram counts once, whatever it was cut into


def test_paths_are_shared():
    """Equal paths are one probe, equal beginnings one node; a far set is left early."""
    base = list(range(100, 140))
    sets = {k: frozenset(base + [1000 + k]) for k in range(50)} | {99: frozenset(range(500, 900))}
    token, rec, n, pos = [], [], [], []
    for k, s in sets.items():
        for place, x in enumerate(sorted(s)[:20]):
            token.append(x), rec.append(k), n.append(len(s)), pos.append(place)
    trie = D.PrefixTrie(np.zeros(len(rec), np.int64), *(np.array(c, k) for c, k in zip((rec, token, n, pos), D._POSTING)))
    assert len(trie.probes) == 2 and len(trie.parent) == 1 + 20 + 20
    met = [tuple(map(int, x)) for p, q, o, _ in trie.meet(Fraction("0.6")) for x in zip(p, q, o)]
    assert met == [(0, 0, 14), (1, 1, 20)]  # sizes 41 and 400: as far as there is room for 31 - 3 and 300 - 3
    assert sum(len(a) for a, *_ in trie.pairs(Fraction("0.6"))) == 50 * 49 // 2


def test_count_codes():
    n = np.concatenate([np.arange(2000), np.array([10**6, 10**9])])
    back = D.code_count(D.count_code(n))
    assert (back <= n).all() and (back[:16] == n[:16]).all() and (back >= n * 0.9 - 1).all()
    assert (np.diff(D.count_code(n).astype(int)) >= 0).all()


def test_small_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["id"].lower(): r["content"] for r in spark.read.parquet(f"{folder}/knowledge.parquet").select("id", "content").collect()}
    want = brute(texts, 3, Fraction("0.6"))
    got = [tuple(r) for r in p2_found(spark, folder).collect()]
    assert len(want) > 30 and len(got) == len(set(got)) and set(got) == want


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = {}
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 10, 40, 90]))] for _ in range(25)]
    for i in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.insert(k, rng.choice(vocabulary)), lambda: w.pop(k) if len(w) > 3 else None, lambda: w.__setitem__(k, rng.choice(vocabulary))])()
        texts[f"r{i:04d}"] = rng.choice([" ", "-", ", ", "\n"]).join(w).replace("w1", "W1")
    return texts | {"s1": None, "s2": "", "s3": "two words", "s4": " \n ", "s5": "é b c d e f", "s6": "É-b c_d e f"}


@pytest.mark.parametrize("seed,width,t,cell", [(1, 3, "0.6", None), (2, 5, "0.8", None), (3, 2, "0.5", 8), (4, 3, "0.6", 5)])
def test_made(spark, monkeypatch, seed, width, t, cell):
    if cell:
        monkeypatch.setattr(D, "CELL_SETS", cell)
        monkeypatch.setattr(D, "PART_POSTINGS", 3 * cell)
    texts = made(seed)
    rows = [(i, x, "clash", 1) for i, x in texts.items()]
    df = spark.createDataFrame(rows + rows[:20] + [(None, texts["r0001"], "x", 2)], "id string, content string, words string, n int")
    membership, links = D.similar_classes(df, width=width, threshold=t)
    got = [tuple(r) for r in D.similar_pairs(membership, links).collect()]
    want = brute(texts, width, Fraction(t))
    assert len(want) > 100 and set(got) == want and len(got) == len(want)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in want:
        parent[find(a)] = find(b)
    together = {}
    for r in D.groups(membership, links).collect():
        together.setdefault(r["group_id"], set()).add(r["id"])
    expected = {}
    for i in {x for x, v in texts.items() if v and gram_set(v, width)}:
        expected.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, expected.values()))


def test_many_copies_and_empty(spark):
    rows = [(f"c{i:04d}", "one two three four five six seven") for i in range(300)] + [("d", "one two three four five six eight"), ("e", "one two three four five six seven nine")]
    df = spark.createDataFrame(rows, "id string, content string")
    membership, links = D.similar_classes(df, width=3, threshold="0.6")
    assert {tuple(r)[:2] for r in links.collect()} == {("c0000", "d"), ("c0000", "e")}
    assert D.similar_pairs(membership, links).count() == 299 + 2
    membership, links = D.similar_classes(df.limit(0))
    assert membership.count() == 0 and links.count() == 0


def test_frequent_grams_meet_once():
    """Sets of an n-gram that very many have are spread over parts and blocks; each two still meet, once."""
    rng = np.random.default_rng(0)
    sets = {int(k): frozenset([7, *(10_000 + 50 * i + np.arange(rng.integers(1, 3)))]) for i, k in enumerate(rng.integers(1, 1 << 60, 300))}
    for cell, part in ((4096, None), (32, None), (4096, 50), (32, 100)):
        met, times = joined(sets, Fraction("1/3"), cell, part)
        pairs = [k for k, m in met.items() if m]
        fit = sum(Fraction(min(len(a), len(b)), max(len(a), len(b))) >= Fraction("1/3") for k, a in enumerate(sets.values()) for b in list(sets.values())[k + 1 :])
        assert len(pairs) == fit and set(met.values()) == {1} and set(times.values()) == {1}


def test_one_gram_in_half_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL_SETS", 16)
    monkeypatch.setattr(D, "PART_POSTINGS", 60)
    rng = random.Random(6)
    texts = {}
    for i in range(500):
        own = " ".join(f"u{rng.randrange(10**6)}" for _ in range(5))
        texts[f"r{i:03d}"] = "for internal use only " + own if i % 2 else own
    for i in range(0, 60, 3):
        texts[f"x{i:03d}"] = texts[f"r{i:03d}"] + " end"
    df = spark.createDataFrame(list(texts.items()), "id string, content string")
    got = [tuple(r) for r in D.similar_pairs(*D.similar_classes(df, width=3, threshold="0.6")).collect()]
    want = brute(texts, 3, Fraction("0.6"))
    assert len(want) >= 20 and set(got) == want and len(got) == len(want)


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    other = [w if rng.random() > 0.02 else "changed" for w in words]
    rows = [("a", " ".join(words)), ("b", " ".join(other)), ("c", "x" * 1_000_000), ("d", "x" * 1_000_000 + " y z"), ("e", "x" * 1_000_000 + " y z")]
    membership, links = D.similar_classes(spark.createDataFrame(rows, "id string, content string"), width=3, threshold="0.6")
    assert {tuple(r) for r in D.similar_pairs(membership, links).collect()} == {("a", "b"), ("d", "e")}
