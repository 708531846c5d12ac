"""Registered queries on training data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.llm import neardup, neighbours, packing, spans, splitting, tokenizing
from strataloom.sources.tables import one_per_id, table

#: Folder of the public tokenizers; a parameter, never copied.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


def p1_neighbours(spark, d):
    rows = table(spark, d, "knowledge").select(uuid_of("id").alias("id"), "embedding")
    return neighbours.most_similar(rows)


def p1_found(spark, d):
    pairs = p1_neighbours(spark, d).select("id", F.explode("neighbours").alias("o")).filter(F.col("o.similarity") >= 0.9)
    return pairs.select(F.least("id", "o.id").alias("id_lo"), F.greatest("id", "o.id").alias("id_hi")).distinct()


def _similar(spark, d):
    rows = table(spark, d, "knowledge").select(uuid_of("id").alias("id"), "content")
    return neardup.similar_classes(rows, width=3, threshold="0.6")


def p2_found(spark, d):
    return neardup.similar_pairs(*_similar(spark, d))


def p2_members(spark, d):
    """Class and smallest id of the same text per record: with p2_links all that p2_found folds."""
    return _similar(spark, d)[0]


def p2_links(spark, d):
    return _similar(spark, d)[1]


def p2_groups(spark, d):
    return neardup.groups(*_similar(spark, d))


def p3_pieces(spark, d):
    # deliveries of one record are alike: their rows are folded before the texts are split
    long = table(spark, d, "knowledge").select(uuid_of("id").alias("id"), "content").filter(F.length("content") > 2 * splitting.MAX_WORDS)
    return splitting.split_oversized(one_per_id(long))


def p3_found(spark, d):
    return p3_pieces(spark, d).filter("piece_no = 0").select("id", "cut")


def p6_ids(spark, d):
    return tokenizing.encode(table(spark, d, "documents"), BYTE_BPE)


def p7_containers(spark, d):
    return packing.pack(tokenizing.encode(table(spark, d, "documents"), BYTE_BPE, counts_only=True))


def p8_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


def p8_shares(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spans.shared_share(docs, spans.shared_spans(docs))


_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_P3 = rf"""
with texts as (select lower(id) as id, any_value(content) as content from knowledge where length(content) > 800 group by 1),
long as (select * from texts where len(regexp_extract_all(content, '[^{_SPACE}]+')) > 400),
stretches as (
  select id, unnest(string_split_regex(regexp_replace(content, '([.!?])[{_SPACE}]', E'\\1\n', 'g'), '[\n\r\x{{0B}}\x{{0C}}\x{{85}}\x{{2028}}\x{{2029}}]')) as stretch from long)
select id, case when max(len(regexp_extract_all(stretch, '[^{_SPACE}]+'))) > 400 then 'forced' else 'natural' end as cut from stretches group by id
"""

QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_groups": p2_groups, "p2_members": p2_members, "p2_links": p2_links, "p3_found": p3_found, "p3_pieces": p3_pieces, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found, "p8_shares": p8_shares}
_P1 = """
with k as (select lower(id) as id, any_value(embedding)::double[] as v from knowledge
  where len(embedding) = 64 and list_count(list_filter(embedding, lambda x: isfinite(x))) = 64 and list_count(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
s as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as sim from k a join k b on a.id <> b.id),
t as (select a, b, sim from s qualify row_number() over (partition by a order by round(sim, 9) desc, b) <= 10)
select distinct least(a, b) as id_lo, greatest(a, b) as id_hi from t where sim >= 0.9
"""
_P2 = r"""
with w as (select lower(id) as id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}]+') as w from knowledge where content is not null group by 1),
g as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from w where len(w) >= 3),
n as (select id, count(*) as n from g group by 1),
o as (select a.id as id_lo, b.id as id_hi, count(*) as o from g a join g b using (gram) where a.id < b.id group by 1, 2)
select id_lo, id_hi from o join n x on x.id = id_lo join n y on y.id = id_hi where 8 * o >= 3 * (x.n + y.n)
"""
_P8 = """
with w as (select doc_id, i, substring(text, (i + 1)::bigint, 200) as s from documents, unnest(generate_series(0, length(text) - 200)) as t(i) where length(text) >= 200),
g as (select s from w group by s having min(doc_id) <> max(doc_id)),
c as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as new from w semi join g using (s)),
m as (select doc_id, i, sum(new) over (partition by doc_id order by i) as span from c)
select doc_id, min(i)::int as span_start, (max(i) + 200 - min(i))::int as span_len from m group by doc_id, span
"""
_P8_SHARES = f"""
with s as ({_P8}), t as (select doc_id, sum(span_len) as shared_chars, count(*) as n_spans from s group by 1),
d as (select doc_id, max(coalesce(length(text), 0)) as n_chars from documents group by 1)
select doc_id, n_chars, coalesce(shared_chars, 0) as shared_chars, coalesce(n_spans, 0) as n_spans, case when n_chars > 0 then coalesce(shared_chars, 0) / n_chars::double else 0.0::double end as share from d left join t using (doc_id)
"""
_P2_GROUPS = r"""
with recursive w as (select lower(id) as id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}]+') as w from knowledge where content is not null group by 1),
g as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from w where len(w) >= 3),
k as (select id, count(*) as n, string_agg(gram, '|' order by gram) as grams from g group by 1),
c as (select id, n, min(id) over (partition by grams) as class_id from k),
o as (select a.id as x, b.id as y, count(*) as o from g a join g b using (gram) where a.id <> b.id and a.id in (select class_id from c) and b.id in (select class_id from c) group by 1, 2),
l as (select x, y from o join c a on a.id = x join c b on b.id = y where 8 * o >= 3 * (a.n + b.n)),
r as (select distinct class_id as x, class_id as y from c union select r.x, l.y from r join l on l.x = r.y),
m as (select x, min(y) as group_id from r group by 1), d as (select x, count(*) as n_links from l group by 1)
select id, class_id, group_id, coalesce(n_links, 0) as n_links from c join m on m.x = class_id left join d on d.x = class_id
"""
ORACLES = {"p1_found": _P1, "p2_found": _P2, "p2_groups": _P2_GROUPS, "p3_found": _P3, "p8_found": _P8, "p8_shares": _P8_SHARES}
