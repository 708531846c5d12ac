"""Pairs of different texts come out whole, however many records share a set of n-grams."""

from strataloom.llm import neardup as D


def test_large_class_of_different_texts(spark):
    words = "one two three four five six seven".split()
    texts = {f"c{i:04d}": " ".join(w.upper() if i >> k & 1 else w for k, w in enumerate(words)) + "." * (i // 128) for i in range(230)}  # one set, 230 texts
    texts |= {f"s{i:04d}": "one two three four five six seven!" for i in range(210)}  # the same set, one text
    texts |= {"d": "one two three four five six eight"}
    membership, links = D.similar_classes(spark.createDataFrame(list(texts.items()), "id string, content string"), width=3, threshold="0.6")
    got = [tuple(r) for r in D.similar_pairs(membership, links).collect()]
    shown = sorted([i for i in texts if i[0] == "c"] + ["s0000", "d"])
    want = {(a, b) for a in shown for b in shown if a < b} | {("s0000", f"s{i:04d}") for i in range(1, 210)}
    assert len(got) == len(want) and set(got) == want
    of = {r["id"]: (r["class_id"], r["copy_id"]) for r in membership.collect()}  # what is folded comes back
    assert of == {i: ("d" if i == "d" else "c0000", "s0000" if i[0] == "s" else i) for i in texts}
