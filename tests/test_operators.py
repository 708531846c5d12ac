"""Small cases of the core operators."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.functions.tags import shape_of
from strataloom.functions.text import snippet, title, word_count
from strataloom.operators import chunking as C
from strataloom.operators import lifecycle as L
from strataloom.operators import search as S
from strataloom.operators import sessions as SE
from strataloom.operators import taxonomy as T
from strataloom.operators import writes as W
from strataloom.sources import files


@pytest.mark.parametrize(
    "similarity,score,second,words,agree,chunked,label",
    [
        (0.72, 0.033, 0.0325, 150, False, False, "high"), (0.50, 0.033, 0.0325, 150, False, False, "medium"), (0.20, 0.033, None, 150, False, False, "low"), (0.9, 0.033, None, 5, False, False, "low"),
        (None, 0.033, 0.020, 150, False, False, "high"), (None, 0.010, None, 150, False, False, "low"), (0.6222, 0.033, 0.032, 74, False, False, "medium"), (0.6222, 0.033, 0.032, 74, True, False, "high"),
        (0.50, 0.033, 0.032, 74, True, False, "medium"), (0.6459, 0.03, 0.03, 23, False, False, "low"), (0.6459, 0.03, 0.03, 23, False, True, "medium"), (0.30, 0.03, 0.03, 23, False, True, "low"),
    ],
)
def test_confidence(spark, similarity, score, second, words, agree, chunked, label):
    df = spark.createDataFrame([(similarity, score, second, words, agree, chunked)], "a double, b double, c double, d int, e boolean, f boolean")
    assert df.select(S.confidence(*[F.col(c) for c in "abcdef"])).first()[0] == label


def test_modifiers(spark):
    now, old = F.lit(datetime(2026, 6, 1)).cast("timestamp"), F.lit(datetime(2025, 6, 1)).cast("timestamp")
    none, tags = F.lit(False), F.array(F.lit("durable"))
    no_tags = F.array().cast("array<string>")
    row = spark.range(1).select(
        S.length_penalty(F.lit(27), F.lit(False)), S.length_penalty(F.lit(27), F.lit(True)), S.recency_decay(old, F.lit("K8s"), no_tags, none, now, 90.0), S.recency_decay(old, F.lit("K8s"), tags, none, now, 90.0),
        S.recency_decay(old, F.lit("Study"), no_tags, none, now, 90.0), S.recency_decay(now, F.lit("K8s"), no_tags, none, old, 90.0), S.component_boost(F.lit("current"), F.lit(True), 2.0), S.component_boost(F.lit("draft"), F.lit(True), 2.0),
    ).first()
    assert list(row) == [0.9, 1.0, 0.25, 1.0, 1.0, 1.0, 2.0, 1.0]


def test_collapse(spark):
    hits = spark.createDataFrame([(1, "a1", "A", 2), (1, "a2", "A", 0), (1, "b1", "B", 1), (1, "c", None, 3)], "qid int, id string, document_id string, place int")
    got = [(r["id"], r["siblings"]) for r in S.collapse(hits, 5).orderBy("final_place").collect()]
    assert got == [("a2", ["a1"]), ("b1", []), ("c", [])]


def test_vector_top_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(60)], "id int, embedding array<float>")
    q = rows.filter("id % 10 = 0").withColumnRenamed("id", "qid")
    whole = {tuple(r) for r in S.vector_top(q, rows, 4, True).select("qid", "id", "vector_rank").collect()}
    monkeypatch.setattr(S, "QUESTION_BLOCK", 2)
    assert whole == {tuple(r) for r in S.vector_top(q, rows, 4, True).select("qid", "id", "vector_rank").collect()} and len(whole) == 24
    assert S.vector_top(q.limit(0), rows, 4).count() == 0


def para(n, word="w"):
    return " ".join([word] * n)


def chunker(spark):
    def chunks(text, **limits):
        df = spark.createDataFrame([(1, text)], "id int, content string")
        return [tuple(r)[1:] for r in C.chunk_documents(df, "id", "content", **limits).orderBy("chunk_index").collect()]

    return chunks


def test_chunking(spark):
    chunk_text = chunker(spark)
    text = f"# Title here\n\n## One\n{para(45)}\n\n## Two\n{para(45)}\n\n## Tiny\nx"
    chunks = chunk_text(text)
    assert [c[0] for c in chunks] == list(range(len(chunks))) and all("Title here" in c[3] for c in chunks) and "Tiny" in chunks[-1][2]
    assert chunk_text(f"{para(50)}\n# H\n{para(50)}")[0][1] is None
    assert chunk_text("") == [] and chunk_text(" \n ") == [] and chunk_text(None) == []
    assert all(len(c[2].split()) <= 260 for c in chunk_text("# H\n" + "\n\n".join([para(62)] * 20), most=200))
    assert len(chunk_text("\n\n".join([para(83)] * 6), headless_most=200)) > 1
    assert all(len(c[2].split()) <= 200 for c in chunk_text(" ".join(["Some words in a sentence here."] * 120), headless_most=150))
    assert [len(c[2].split()) for c in chunk_text(para(500), headless_most=200)] == [500]
    assert len(chunk_text(f"## A\n{para(300)}\n## B\n{para(300)}")) == 2


def test_chunking_of_long_paragraphs(spark):
    """A paragraph that is too long is packed by sentences, apart from the paragraphs around it."""
    chunk_text = chunker(spark)
    long = " ".join([para(99) + " w."] * 9)
    got = chunk_text(f"# H\n\n{para(30)}\n\n{long}\n\n{para(50)}")
    assert [len(c[2].split()) for c in got] == [32, 800, 100, 50] and {c[1] for c in got} == {"H"}
    got = chunk_text(f"   # not yet\n{para(50)}\n    # no heading\nmore\n\u2028## B\nend")
    assert [c[1] for c in got] == ["not yet"] and "# no heading" in got[0][2] and got[0][2].endswith("## B\nend")
    assert chunk_text("just a line\nand more")[0][3] == "just a line\nand more"
    assert chunk_text(f"{para(45)}\n\n# X\nshort")[0][1] is None


def test_legacy_sections(spark):
    df = spark.createDataFrame([(1, f"intro\n# A\n{para(601)}\n#b\n"), (2, ""), (3, None)], "id int, t string")
    got = [(r["section_no"], r["slice_no"], r["heading"], len(r["section"].split())) for r in C.legacy_sections(df, "id", "t").collect()]
    assert got == [(0, 0, "root", 1), (1, 0, "# A", 600), (1, 1, "# A", 3), (2, 0, "#b", 1)]


def test_text_and_ids(spark):
    df = spark.createDataFrame([("## Head\nbody one　two",), (None,), ("",), ("a b c",)], "t string")
    assert [tuple(r) for r in df.select(title("t"), word_count("t"), snippet("t", 2)).collect()] == [("Head", 5, "## Head…"), (None, 0, None), ("", 0, ""), ("a b c", 3, "a b…")]
    u = "0000000a-0000-4000-8000-000000000001"
    forms = [u, u.upper(), f" {u}\n", f"{{{u}}}", f"urn:uuid:{u}", f"URN:UUID:{u}", "", "n/a", None, u[:-1], u + "0"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in forms], "t string").select(uuid_of("t")).collect()]
    assert got == [u] * 6 + [None] * 5


def test_taxonomy(spark):
    rows = spark.createDataFrame([("a", ["k8s", "brand-new", "shape:note", "K8s "]), ("b", None), ("c", []), ("d", [None, " ", "old"])], "id string, tags array<string>")
    vocabulary = spark.createDataFrame([("K8s",), ("DNS",)], "tag string")
    aliases = spark.createDataFrame([("old", None)], "alias_key string, target string")
    got = {r["id"]: (r["canonical_tags"], r["unknown_tags"]) for r in T.normalize_tags(rows, vocabulary, aliases).collect()}
    assert got == {"a": (["K8s", "shape:note"], ["brand-new"]), "b": ([], []), "c": ([], []), "d": ([], [])}
    near = {tuple(r) for r in T.near_misses(spark.createDataFrame([("k8",), ("dns",), ("dnss",), ("dna",), ("xx",), ("",)], "tag string"), vocabulary).collect()}
    assert near == {("k8", "K8s"), ("dnss", "DNS"), ("dna", "DNS")}
    shapes = spark.createDataFrame([("obsidian",), ("slack",), (None,), ("weird",)], "s string").select(shape_of(F.col("s")), shape_of(F.col("s"), F.lit("event"))).collect()
    assert [tuple(r) for r in shapes] == [("document", "event"), ("note", "event"), ("note", "event"), ("note", "event")]


def test_lifecycle(spark):
    rows = spark.createDataFrame([("a", "current", None), ("b", "current", None), ("c", "draft", None), ("d", "superseded", None)], "id string, status string, valid_until timestamp")
    events = spark.createDataFrame(
        [("e1", "a", "b", datetime(2026, 8, 1, 12), datetime(2026, 7, 15)), ("e2", "b", None, datetime(2026, 8, 1, 9), None), ("e3", "a", None, datetime(2026, 9, 1), None), ("e4", "c", "c", None, None), ("e5", "c", "a", None, None)],
        "id string, superseded_id string, superseding_id string, occurred_at timestamp, fact_valid_until timestamp",
    )
    got = {r["id"]: (r["status"], r["valid_until"]) for r in L.project(rows, events).collect()}
    assert got == {"a": ("superseded", datetime(2026, 7, 15)), "b": ("historical", datetime(2026, 8, 1, 9)), "c": ("draft", None), "d": ("superseded", None)}
    drift = {r["id"]: r["drift"] for r in L.status_drift(rows, events).collect()}
    assert drift["d"] == "superseded_without_event" and drift["a"] == "event_present_status_mismatch"


def test_contradictions_in_blocks(spark):
    data = [(f"r{i:03d}", "current", "s1" if i % 3 else "s2", [float(i % 4 + 1), 1.0]) for i in range(60)] + [("x", "draft", "s1", [1.0, 1.0]), ("y", "current", None, [1.0, 1.0]), ("z", "current", "s1", [0.0, 0.0])]
    df = spark.createDataFrame(data, "id string, status string, system string, embedding array<float>")
    whole = {tuple(r)[:3] for r in L.contradiction_candidates(df, 0.999, 2).collect()}
    cut = [tuple(r)[:3] for r in L.contradiction_candidates(df, 0.999, 2, block_rows=7).collect()]
    assert set(cut) == whole and len(cut) == len(whole) and len(whole) > 100
    known = spark.createDataFrame([w[1:] for w in whole], "id_lo string, id_hi string")
    assert L.contradiction_candidates(df, 0.999, 2, known=known).count() == 0


def test_sessions(spark):
    base = 1_759_356_000
    log = spark.createDataFrame([("o", base + s, f"item {k}") for k, s in enumerate((0, 120, 1920, 3721, 90_000, 86_399 * 3))] + [(None, base, "x"), ("o", None, "x")], "owner string, s bigint, query_text string")
    log = log.withColumn("created_at", F.timestamp_seconds("s"))
    got = sorted(r["session_start_s"] - base for r in SE.sessionize(log).collect())
    assert got == [0, 0, 0, 3721, 90_000, 86_399 * 3]
    rules = [SE.Rule("items", r"\bitem\s+(\d+)", 3, "items")]
    assert [(r["n"], r["items"]) for r in SE.apply_rules(SE.sessionize(log), rules).collect()] == [(3, "0, 1, 2")]
    with pytest.raises(ValueError):
        SE.Rule("bad", "", 1)
    n = {r["s"] - base: r["n_trailing"] for r in SE.trailing_count(log, "owner", "created_at").withColumn("s", F.unix_seconds("created_at")).collect()}
    assert n == {0: 1, 120: 2, 1920: 3, 3721: 2 - 1 + 1, 90_000: 1, 86_399 * 3: 1}


def test_writes(spark):
    old = spark.createDataFrame([Row(id="a", v=1, embedding=[1.0]), Row(id="b", v=2, embedding=[2.0])])
    new = spark.createDataFrame([("b", 3, None), ("c", 4, [4.0])], "id string, v int, embedding array<double>")
    got = {r["id"]: (r["v"], r["embedding"], r["change"]) for r in W.upsert(old, new, "id").collect()}
    assert got == {"a": (1, [1.0], "kept"), "b": (3, [2.0], "updated"), "c": (4, [4.0], "inserted")}
    assert [r["id"] for r in W.insert_absent(old, new.unionByName(new), ["id"]).collect()] == ["c"]


def test_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.md").write_text("# One\ntext")
    (tmp_path / "y.md").write_text("two")
    (tmp_path / "z.md").write_text("  ")
    (tmp_path / "p.html").write_text("<html><head><title>no</title></head><body><p>Fish &amp; chips</p><script>x()</script><div> b </div></body></html>")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Caf</w:t></w:r><w:r><w:t>é</w:t></w:r></w:p><w:p/>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    docs = files.documents(spark, [{"kind": k, "root": str(tmp_path), "owner": "o"} for k in ("markdown", "html", "docx")])
    got = {(r["kind"], r["section"]): r["text"] for r in docs.collect()}
    assert got == {("markdown", "a/b"): "# One\ntext", ("markdown", "root"): "two", ("html", "root"): "Fish & chips\nb", ("docx", "root"): "## Head\n\nCafé"}
    pages = spark.createDataFrame([("f", "x" * 300), ("f", None), ("g", "x" * 10), ("h", "x" * 250)], "f string, text string")
    assert {r["f"]: r["kind"] for r in files.page_kinds(pages, "f").collect()} == {"f": "mixed", "g": "image", "h": "text"}


def test_stems(spark):
    from strataloom.functions.analyzer import stem, stems

    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "node7": "node7",
    }
    assert {w: stem(w) for w in pairs} == pairs
    rows = spark.createDataFrame([("a", "Routers were routing the hopping packets"), ("b", None), ("c", "")], "id string, t string")
    assert {r["id"]: r["s"] for r in rows.select("id", stems("t").alias("s")).collect()} == {"a": ["router", "rout", "hop", "packet"], "b": None, "c": []}
    questions = spark.createDataFrame([("q", "router packet")], "qid string, question string")
    found = S.lexical_top(questions, rows.withColumnRenamed("t", "content"), analyze=stems).collect()
    assert [r["id"] for r in found] == ["a"]


def test_rules_are_refused_when_malformed():
    from strataloom.operators.sessions import rules_from

    good = '[{"name": "a", "pattern": "x([0-9])", "threshold": 1, "kind": "items"}]'
    assert rules_from(good)[0].threshold == 1
    for bad in ("", "{}", "[]", "[1]", '[{"name": "a"}]', good.replace("([0-9])", "[0-9]"), good.replace("x([0-9])", "("), good.replace(": 1", ": 0"), good.replace(": 1", ": true"), good.replace("items", "rounds"), f"[{good[1:-1]}, {good[1:-1]}]"):
        with pytest.raises(ValueError):
            rules_from(bad)


def test_events_show_twelve_items_and_an_ellipsis(spark):
    from strataloom.operators import sessions as S

    text = lambda n: " ".join(str(i) for i in range(1, n + 1))
    log = spark.createDataFrame([("1", "a", 0, text(12)), ("2", "b", 0, text(13)), ("3", "c", 0, None), (None, "b", 0, "7"), ("4", "d", 0, "")], "id string, owner string, session_start_s bigint, query_text string")
    rules = [S.Rule("n", "([0-9]+)", 2, "items"), S.Rule("two", "7", 2)]
    got = {(r["owner"], r["rule"]): (r["n"], r["items"], r["event_key"]) for r in S.apply_rules(log, rules).collect()}
    first = ", ".join(str(i) for i in range(1, 13))
    assert {k: v[:2] for k, v in got.items()} == {("a", "n"): (12, first), ("b", "n"): (13, first + "…"), ("b", "two"): (2, "")}
    evidence = {(r["event_key"], r["id"]) for r in S.rule_evidence(log, rules).collect()}
    assert evidence == {(got["a", "n"][2], "1"), (got["b", "n"][2], "2"), (got["b", "two"][2], "2")}
    assert S.rule_evidence(log.limit(0), rules).count() == 0


def test_counts_at_against_brute_force(spark):
    import random

    from strataloom.operators.lifecycle import counts_at

    rng = random.Random(3)
    base = 1_700_000_000
    spells = [(f"r{i:03}", base + rng.randrange(-50, 5000), None if i % 7 == 0 else base + rng.randrange(-50, 9000)) for i in range(300)] + [("none", None, base), ("back", base + 9, base + 3)]
    rows = spark.createDataFrame(spells, "id string, a bigint, b bigint").selectExpr("id", "timestamp_seconds(a) as valid_from", "timestamp_seconds(b) as valid_until")
    at = sorted({base + rng.randrange(-100, 9000) for _ in range(200)})
    want = {}
    for t in at:
        live = [i for i, a, b in spells if a is not None and a <= t and (b is None or b > t)]
        if live:
            want[t] = (len(live), min(live))
    times = spark.createDataFrame([(t,) for t in at + at[:5] + [None]], "at_s bigint")
    assert {r["at_s"]: (r["n_valid"], r["least_id"]) for r in counts_at(rows, times).collect()} == want
    assert counts_at(rows, times.limit(0)).count() == 0 and counts_at(rows.limit(0), times).count() == 0
    one = spark.createDataFrame([(at[50],)], "at_s bigint")
    assert {r["at_s"]: (r["n_valid"], r["least_id"]) for r in counts_at(rows, one).collect()} == {at[50]: want[at[50]]}


def test_scopes(spark):
    from strataloom.operators.lifecycle import left_over, newest, scoped

    rows = spark.createDataFrame(
        [("a", "current", "N", "o", 1), ("b", "draft", "N", "o", 3), ("c", "current", None, "p", None), ("d", None, "N", "o", 2)], "id string, status string, domain string, created_by string, s bigint"
    ).selectExpr("*", "timestamp_seconds(s) as valid_from", "cast(null as string) environment", "cast(null as string) system")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(scoped(rows)) == {"a", "c"} and ids(scoped(rows, {"status": None})) == {"a", "b", "c", "d"}
    assert ids(scoped(rows, {"domain": "N", "colour": "red", "system": ""})) == {"a"} and ids(scoped(rows, {"status": "draft"}, owner="o")) == {"b"}
    assert [r["id"] for r in newest(rows, 3).collect()] == ["c", "b", "d"]
    shown = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("r", "a")], "qid string, id string")
    got = {r["qid"]: tuple(r)[1:] for r in left_over(shown, spark.createDataFrame([("q", "a"), ("r", "a"), ("r", "z")], "qid string, id string")).collect()}
    assert got == {"q": (2, 1, "b"), "r": (1, 0, None)}


@pytest.mark.parametrize("block, piece", [(32_768, 65_536), (7, 11)])
def test_lexical_top_against_brute_force(spark, monkeypatch, block, piece):
    import random
    from collections import Counter

    monkeypatch.setattr(S, "QUESTION_BLOCK", block)
    monkeypatch.setattr(S, "SLICE_ROWS", piece)
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "the", "x", "omega1", "zeta", "eta"])
    texts = {i: " ".join(word() for _ in range(rng.randrange(0, 14))) for i in range(60)} | {60: None, 61: "", 62: "the and", 63: "alpha " * 3000, 64: "common", 65: "common"}
    rows = spark.createDataFrame(list(texts.items()), "id int, content string")
    questions = [(0, "alpha beta beta"), (1, texts[1]), (2, None), (3, "the"), (64, "common"), (99, "nothing here"), (100, "the " * 16 + "alpha"), (101, "gamma zeta eta")]
    asked = spark.createDataFrame(questions, "qid int, question string")

    def terms(text):
        return [w for w in (text or "").lower().split() if len(w) > 1]

    def best(q, text, k):
        wanted = {w for w in terms(text)[:16] if w not in ("the", "and", "here")}
        found = []
        for i, t in texts.items():
            tf = Counter(terms(t))
            score = round(sum(tf[w] / (tf[w] + 1.2) for w in wanted if tf[w]), 9)
            if score and i != q:
                found.append((-score, i))
        return [i for _, i in sorted(found)[:k]]

    got = {}
    for r in S.lexical_top(asked, rows, 9, exclude_self=True).collect():
        got.setdefault(r["qid"], {})[r["lexical_rank"]] = r["id"]
    assert {q: [x[i] for i in range(len(x))] for q, x in got.items()} == {q: w for q, t in questions if (w := best(q, t, 9))}
    assert got[64] == {0: 65}
    assert S.lexical_top(asked.limit(0), rows).count() == 0 and S.lexical_top(asked, rows.limit(0)).count() == 0


def test_readable_html(spark):
    from strataloom.functions.markup import escaped, readable

    cases = {
        None: None, "": "", "plain": "plain", "<p>a<br>b</p>": "a\nb", "a &amp;lt; b &#233;&#xE9; &#X1F600; &bogus; & &;": "a &lt; b éé 😀 &bogus; & &;", "&#0;&#xD800;&#9999999;": "�" * 3,
        "x<script>if (a<b) {}</script>y<!-- c -->z<style>q": "x\ny\nz", "<HEAD><title>t</title></HEAD>B": "B", "1 < 2 <b>c</b>": "1 < 2\nc", "&nbsp;<p>  k \t</p>": "k", "<headline>h</headline>": "h",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", readable("t").alias("r"), escaped("t").alias("e")).collect()
    assert {r["t"]: r["r"] for r in rows} == cases
    assert {r["t"]: r["e"] for r in rows}["1 < 2 <b>c</b>"] == "1 &lt; 2 &lt;b&gt;c&lt;/b&gt;"
    assert spark.createDataFrame([("\"'&",)], "t string").select(escaped("t")).first()[0] == "&quot;&#x27;&amp;"
    long = "<i>" * 20_000 + "&gt;" * 20_000
    assert spark.createDataFrame([(long,)], "t string").select(readable("t")).first()[0] == ">" * 20_000
