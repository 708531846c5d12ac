"""Tokenizing: against the public library, round trip, and the odd cases."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import tokenizing as T
from strataloom.llm.queries import BYTE_BPE

TEXTS = [
    None, "", " ", "\n\n\t", "hello world", "  two  spaces  ", "it's 12345 o'clock, I'll", "<|endoftext|> stays text", "a" * 3000, "=" * 1001 + "!?" * 77,
    "日本語" * 400, "café naïve   nbsp　wide", "\u0000\u0001 control\u0085next", "\U0001f600\U0001f468‍\U0001f469", "x" + " " * 500 + "y", "aaab" * 333, "line\r\nline\rline",
]


def test_against_library(spark):
    lib = Tokenizer.from_file(BYTE_BPE)
    lib.encode_special_tokens = True
    df = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", words=1) for i, t in enumerate(TEXTS + TEXTS)])
    got = {r["doc_id"]: r["ids"] for r in T.encode(df, BYTE_BPE).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in T.encode(df, BYTE_BPE, counts_only=True).collect()}
    assert len(got) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS + TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == want, repr(t)[:60]
        assert counts[i] == len(want)
        assert lib.decode(got[i], skip_special_tokens=False) == (t or "")


def test_one_very_long_text_and_empty_table(spark):
    df = spark.range(1).select(F.lit(7).cast("bigint").alias("doc_id"), F.expr("repeat('the quick brown fox ', 50000)").alias("text"))
    r = T.encode(df, BYTE_BPE).first()
    assert len(r["ids"]) == 200_001
    assert T.encode(df.filter("doc_id < 0"), BYTE_BPE).count() == 0


def test_fixture_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(BYTE_BPE)
    lib.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in T.encode(docs, BYTE_BPE).collect()}
    assert got == {k: lib.encode(v or "", add_special_tokens=False).ids for k, v in texts.items()}


def test_words_beyond_one_query():
    e = T.WordEncoder(T.MergeTable(BYTE_BPE))
    e.learn(["b" * 700_000, "c" * 700_000, "ab"])
    assert all(len(e.kept[w]) for w in ("b" * 700_000, "ab")) and e.kept["ab"].dtype == np.int32


def test_long_runs_in_the_pattern(spark):
    lib = Tokenizer.from_file(BYTE_BPE)
    lib.encode_special_tokens = True
    texts = ["x" * 200_000, " " * 200_000 + "y", "1" * 50_000, "日本" * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in T.encode(df, BYTE_BPE).collect()}
    assert [got[i] for i in range(4)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_and_close_words():
    """Words without end, runs, and words of few letters, where contractions stand side by side, against the public library."""
    import random
    import time

    import tokenizers

    encoder, public = T.WordEncoder(T.MergeTable(BYTE_BPE)), tokenizers.Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))]
    words += ["x" * 9000, "ab" * 3000 + "aaab" * 50 + "a" * 77, "the" * 5000, "-" * 3000 + "=" * 500 + "--==" * 100, "\u00e9\u65e5\u672c" * 3000]
    words += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for letters in ("ab", "aab", "thein", "abcdefghijklmnop\u00e9\u65e5", "0123456789", "-=*#", "tTsSeE") for _ in range(300)]
    words = [w for w in dict.fromkeys(words) if len(public.pre_tokenizer.pre_tokenize_str(w)) == 1]
    start = time.time()
    encoder.learn(words[:1])
    took = time.time() - start
    encoder.learn(words[1:])
    assert len(words) > 1500 and [w for w in words if encoder.kept[w].tolist() != public.encode(w, add_special_tokens=False).ids] == []
    assert took < 20  # it took 41 s while the rows of all rounds were kept
