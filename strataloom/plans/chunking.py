"""Registered queries on sections, windows and text, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.functions.text import title, word_count, words_sql
from strataloom.functions.markup import escaped, escaped_sql, readable, readable_sql
from strataloom.operators import chunking as C
from strataloom.plans.reports import one, ref
from strataloom.sources.tables import records, table


_MARKUP = "<[a-zA-Z/!]|&[a-z#0-9]+;"
TEMPLATES = ("{}", "please {}", "tell me: {}", "{} in the lab")


def token_windows(spark, d):
    w = C.token_windows(table(spark, d, "documents"), "doc_id", "text")
    return w.select("doc_id", "window_no", "n_words", F.md5("window").alias("window_hash"))


def slices_1500(spark, d):
    return C.long_slices(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "slice_no", "n_words", F.md5("slice").alias("slice_hash"))


def heading_sections(spark, d):
    s = C.heading_sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", "section_no", "heading", "n_lines", F.md5("section").alias("section_hash"))


def chunk_documents(spark, d):
    """Chunks of whole documents, with their ids."""
    c = C.chunk_documents(records(spark, d, "content"), "id", "content")
    return c.select("id", "chunk_index", "heading", "section", "embed_text", C.chunk_id(F.lit("family"), F.lit("owner"), F.col("id"), F.col("chunk_index"), F.col("section")).alias("chunk_id"))


def legacy_sections(spark, d):
    s = C.legacy_sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", "section_no", "slice_no", "heading", word_count("section").alias("n_words"), F.md5("section").alias("section_hash"))


def chunk_ingest_ids(spark, d):
    """Ingest ids of the sections of the store."""
    k = records(spark, d, "document_id", "chunk_index", "ingest_id").filter(uuid_of("document_id").isNotNull())
    return k.select("id", C.chunk_ingest_id(F.col("ingest_id"), F.col("chunk_index")).alias("chunk_ingest_id"))


def chunk_ids(spark, d):
    k = records(spark, d, "document_id", "chunk_index", "content", "created_by").withColumn("document_id", uuid_of("document_id")).filter("document_id is not null")
    return k.select("id", C.chunk_id(F.lit("family"), F.coalesce("created_by", F.lit("")), F.col("document_id"), F.coalesce("chunk_index", F.lit(-1)), F.coalesce("content", F.lit(""))).alias("chunk_id"))


def ingest_ids(spark, d):
    k = records(spark, d, "content", "created_by", "domain", "environment", "system").filter("content is not null")
    return k.select("id", C.ingest_id(F.col("created_by"), F.col("domain"), F.col("environment"), F.col("system"), content=F.col("content")).alias("ingest_id"))


def titles(spark, d):
    return records(spark, d, "content").select("id", title("content").alias("title"))


def min_length(spark, d):
    """Texts long enough to be kept, per source type."""
    keep = F.coalesce(F.length(F.trim("text")) >= 80, F.lit(False))
    return table(spark, d, "documents").groupBy("source_type").agg(F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_dropped"))


def word_counts(spark, d):
    return records(spark, d, "content").select("id", word_count("content").alias("n_words"))


def html_text(spark, d):
    """Texts that hold markup or entities, as readable text."""
    t = table(spark, d, "documents").filter(F.col("text").rlike(_MARKUP)).select("doc_id", readable("text").alias("text"))
    return t.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


def html_escaped(spark, d):
    """Texts made safe for markup."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(escaped("text")).alias("text_hash"))


def injection_flags(spark, d):
    """The first phrase of each text that reads like an instruction to a reader's machine."""
    pattern = r"(?i)\b(ignore (?:all|the|any) |disregard |system prompt|you must now )"
    hit = F.regexp_extract("text", pattern, 1)
    return table(spark, d, "documents").select("doc_id", F.lower(hit).alias("phrase")).filter("phrase <> ''")


def misfiled(spark, d):
    """Records filed under two domains that speak of networks by word or tag, newest first."""
    k = records(spark, d, "domain", "status", "content", "tags", "created_at")
    speaks = F.col("content").rlike(r"(?i)\b(switch|router|vlan|trunk port)") | F.coalesce(F.arrays_overlap("tags", F.array(F.lit("Switch"), F.lit("VLAN"))), F.lit(False))
    return k.filter(F.col("domain").isin("Personal", "Study") & (F.col("status") == "current") & speaks).select("id", F.substring("content", 1, 140).alias("preview"), F.unix_seconds("created_at").alias("at_s")).orderBy(F.desc_nulls_last("at_s"), "id")


def prefix_purge(spark, d):
    """What a purge by prefixes would leave, per domain."""
    c = F.coalesce("content", F.lit(""))
    gone = c.startswith("Question:") | c.startswith("Still open:") | c.startswith("My summary:") | c.startswith("- ")
    return records(spark, d, "content", "domain").filter(~gone).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def unique_needles(spark, d):
    """System names that occur in exactly one record's text."""
    needles = table(spark, d, "system_vocabulary").select("system").distinct()
    # names are single words: texts are met by word, not by every name
    words = records(spark, d, "content").select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9-]+"), F.lit(0)))).alias("system"))
    hits = words.join(needles, "system").groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return needles.join(hits, "system", "left").select("system", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("id")).alias("only_id"))


def documents_union(spark, d):
    """Documents and records as one table of texts, counted per kind and domain."""
    a = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text", "domain", "owner")
    b = records(spark, d, "content", "domain", "system").select(F.lit("record").alias("kind"), "id", F.col("content").alias("text"), "domain", "system")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("kind", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"), F.count("system").alias("n_systems"), F.count("owner").alias("n_owners"))


def query_variants(spark, d):
    """Templates times the distinct questions of flagged queries."""
    base = table(spark, d, "query_log").filter("flagged and query_text is not null").select(F.lower(F.trim("query_text")).alias("base")).filter("base <> ''").distinct()
    every = base.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("template_no"), F.lit(x).alias("template")) for i, x in enumerate(TEMPLATES)])))
    return every.select(F.replace(F.col("t.template"), F.lit("{}"), F.col("base")).alias("variant"), "t.template_no").groupBy("variant").agg(F.min("template_no").alias("template_no"))


QUERIES = {
    f.__name__: f
    for f in (
        token_windows, slices_1500, heading_sections, chunk_documents, legacy_sections, chunk_ingest_ids, chunk_ids, ingest_ids, titles, min_length, word_counts, html_text, html_escaped, injection_flags, misfiled, prefix_purge, unique_needles, documents_union, query_variants,
    )
}

_WX = r"\t\f\r \x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS = r"\n" + _WX
_LINES = r"\r\n|[\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_CHUNKS = rf"""
with recursive t as (select id, {_strip(f"regexp_replace(content, '{_LINES}', E'\\n', 'g')")} as t from {one('content')} where content is not null),
d as (select *, coalesce(nullif({_strip(f"regexp_extract(t, '(?m)^#{{1,6}}[{_WX}]+([^{_WS}][^\n]*)', 1)")}, ''), left({_strip("split_part(t, E'\\n', 1)")}, 120)) as title from t where t <> ''),
p as (select id, unnest(a) as p, generate_subscripts(a, 1) as i from (select id, string_split(regexp_replace(t, '\n(#{{1,6}}[{_WX}]+[^{_WS}])', chr(1) || '\1', 'g'), chr(1)) as a from d)),
s as (select id, row_number() over (partition by id order by i) as i, {_strip('p')} as text, nullif({_strip(f"regexp_extract(p, '^#{{1,6}}[{_WX}]+([^{_WS}][^\n]*)', 1)")}, '') as heading from p where {_strip('p')} <> ''),
n as (select *, len({words_sql('text')}) as n from s),
m as (select id, i, 0 as g, n as w from n where i = 1
  union all select m.id, n.i, m.g + (m.w >= 40)::int, case when m.w >= 40 then n.n else m.w + n.n end from m join n on n.id = m.id and n.i = m.i + 1),
e as (select id, max(g) as g, arg_max(w, i) as w from m group by id),
k as (select m.id, m.i, m.g, case when m.g = e.g and e.w < 40 and e.g > 0 then e.g - 1 else m.g end as sec from m join e using (id)),
x as (select k.id, k.sec, string_agg(n.text, E'\n\n' order by k.i) as text, first(n.heading order by k.i) filter (where n.heading is not null and k.g = k.sec) as heading from k join n using (id, i) group by 1, 2),
l as (select *, case when heading is null then 400 else 800 end as lim, len({words_sql('text')}) as n from x),
pp as (select id, sec, lim, unnest(a) as p, generate_subscripts(a, 1) as pi from (select *, regexp_split_to_array(text, '\n[{_WS}]*\n') as a from l where n > lim)),
u0 as (select id, sec, lim, pi, 0 as si, p as text, false as long from pp where len({words_sql('p')}) <= lim
  union all select id, sec, lim, pi, generate_subscripts(a, 1), {_strip('unnest(a)')}, true from (select *, string_split(regexp_replace(p, '([.!?])[{_WS}]+', '\1' || chr(1), 'g'), chr(1)) as a from pp where len({words_sql('p')}) > lim)),
u as (select *, row_number() over (partition by id, sec order by pi, si) as i, len({words_sql('text')}) as n from u0 where {_strip('text')} <> ''),
r as (select id, sec, i, 0 as g, n as w, pi, long from u where i = 1
  union all select r.id, r.sec, u.i, r.g + (((u.long or r.long) and u.pi <> r.pi) or r.w + u.n > u.lim)::int, case when ((u.long or r.long) and u.pi <> r.pi) or r.w + u.n > u.lim then u.n else r.w + u.n end, u.pi, u.long
  from r join u on u.id = r.id and u.sec = r.sec and u.i = r.i + 1),
c as (select r.id, r.sec, r.g, case when bool_or(u.long) then string_agg(u.text, ' ' order by u.i) else string_agg(u.text, E'\n\n' order by u.i) end as text from r join u using (id, sec, i) group by 1, 2, 3),
f as (select id, sec, 0 as g, text from l where n <= lim union all select id, sec, g, {_strip('text')} from c),
o as (select f.id, row_number() over (partition by f.id order by sec, g) - 1 as chunk_index, heading, f.text as section, title from f join l using (id, sec) join d on d.id = f.id)
select id, chunk_index, heading, section, case when starts_with(lower(regexp_replace(section, '^[{_WS}]*#*[{_WS}]*', '')), lower(title)) then section else title || E'\n\n' || section end as embed_text,
  md5('family:owner:' || id || ':' || chunk_index || ':family:' || left(sha256(section), 12)) as chunk_id from o
"""

_W = f"w as (select doc_id, {words_sql('text')} as w from documents where len({words_sql('text')}) > 0)"
ORACLES = {
    "token_windows": f"""with {_W}, x as (select doc_id, w, unnest(generate_series(0, greatest(ceil((len(w) - 500) / 400.0), 0)::int)) as window_no from w)
        select doc_id, window_no, len(w[window_no * 400 + 1 : window_no * 400 + 500]) as n_words, md5(array_to_string(w[window_no * 400 + 1 : window_no * 400 + 500], ' ')) as window_hash from x""",
    "slices_1500": f"""with {_W}, e as (select *, case when len(w) > 6000 then 1500 else len(w) end as k from w), x as (select *, unnest(generate_series(0, (ceil(len(w) / k::double) - 1)::int)) as slice_no from e)
        select doc_id, slice_no, len(w[slice_no * k + 1 : slice_no * k + k]) as n_words, md5(array_to_string(w[slice_no * k + 1 : slice_no * k + k], ' ')) as slice_hash from x""",
    "heading_sections": r"""with l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as n from (select doc_id, regexp_split_to_array(text, '\r\n|\n|\r') as a from documents where text is not null)),
        h as (select *, nullif(regexp_extract(line, '^#{1,6}[\s\x{0B}]+([^\s\x{0B}].*)$', 1), '') as head from l), m as (select *, count(head) over (partition by doc_id order by n) as section_no from h),
        s as (select doc_id, section_no, arg_min(head, n) filter (where head is not null) as heading, count(*) as n_lines, string_agg(line, E'\n' order by n) as section from m group by 1, 2)
        select doc_id, section_no, heading, n_lines, md5(section) as section_hash from s
        where regexp_replace(section, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') <> ''""",
    "chunk_documents": _CHUNKS,
    "legacy_sections": rf"""with p as (select doc_id, unnest(a) as part, generate_subscripts(a, 1) - 1 as section_no from (select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{_LINES}', E'\n', 'g'), '\n$', ''), '\n#', chr(1) || '#', 'g'), chr(1)) as a from documents where length(text) > 0)),
        w as (select *, {words_sql('part')} as w, case when starts_with(part, '#') then {_strip("split_part(part, E'\\n', 1)")} else 'root' end as heading from p),
        x as (select *, unnest(generate_series(0, case when len(w) > 600 then (ceil(len(w) / 600.0) - 1)::int else 0 end)) as slice_no from w),
        y as (select doc_id, section_no, slice_no, heading, case when len(w) > 600 then array_to_string(w[slice_no * 600 + 1 : slice_no * 600 + 600], ' ') else part end as section from x)
        select doc_id, section_no, slice_no, heading, len({words_sql('section')}) as n_words, md5(section) as section_hash from y""",
    "chunk_ingest_ids": f"select id, ingest_id || ':c' || chunk_index as chunk_ingest_id from {one('document_id', 'chunk_index', 'ingest_id')} where {ref('document_id')} is not null",
    "chunk_ids": rf"""with k as (select *, nullif(regexp_extract(lower(document_id), '^\s*\{{?(?:urn:uuid:)?([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})\}}?\s*$', 1), '') as doc from {one('document_id', 'chunk_index', 'content', 'created_by')})
        select id, md5('family:' || coalesce(created_by, '') || ':' || doc || ':' || coalesce(chunk_index, -1)::varchar || ':family:' || left(sha256(coalesce(content, '')), 12)) as chunk_id from k where doc is not null""",
    "ingest_ids": f"select id, md5(coalesce(created_by, '') || '|' || coalesce(domain, '') || '|' || coalesce(environment, '') || '|' || coalesce(system, '') || '|' || sha256(content)) as ingest_id from {one('content', 'created_by', 'domain', 'environment', 'system')} where content is not null",
    "titles": f"select id, split_part(regexp_replace(content, '^#+\\s*', ''), E'\\n', 1) as title from {one('content')}",
    "min_length": "select source_type, count(*) filter (where coalesce(length(trim(text)) >= 80, false)) as n_kept, count(*) filter (where not coalesce(length(trim(text)) >= 80, false)) as n_dropped from documents group by 1",
    "word_counts": f"select id, coalesce(len({words_sql('content')}), 0) as n_words from {one('content')}",
    "injection_flags": r"select doc_id, lower(regexp_extract(text, '(?i)\b(ignore (?:all|the|any) |disregard |system prompt|you must now )', 1)) as phrase from documents where regexp_extract(text, '(?i)\b(ignore (?:all|the|any) |disregard |system prompt|you must now )', 1) <> ''",
    "html_text": f"""with t as (select doc_id, {readable_sql('text')} as text from documents where regexp_matches(text, '{_MARKUP}')) select doc_id, length(text) as n_chars, md5(text) as text_hash from t""",
    "html_escaped": f"select doc_id, md5({escaped_sql('text')}) as text_hash from documents where text is not null",
    "misfiled": rf"""select id, left(content, 140) as preview, epoch_us(created_at) // 1000000 as at_s from {one('domain', 'status', 'content', 'tags', 'created_at')} where domain in ('Personal', 'Study') and status = 'current'
        and (coalesce(regexp_matches(content, '(?i)\b(switch|router|vlan|trunk port)'), false) or coalesce(list_has_any(tags, ['Switch', 'VLAN']), false))""",
    "prefix_purge": f"select domain, count(*) as n from {one('content', 'domain')} where not (starts_with(coalesce(content, ''), 'Question:') or starts_with(coalesce(content, ''), 'Still open:') or starts_with(coalesce(content, ''), 'My summary:') or starts_with(coalesce(content, ''), '- ')) group by 1",
    "unique_needles": f"""with w as (select distinct id, unnest(regexp_extract_all(content, '[A-Za-z0-9-]+')) as system from {one('content')}), h as (select system, count(*) as n, min(id) as id from w join (select distinct system from system_vocabulary) using (system) group by 1)
        select system, coalesce(n, 0) as n, case when n = 1 then id end as only_id from (select distinct system from system_vocabulary) left join h using (system)""",
    "documents_union": f"""with u as (select 'document' as kind, text, domain, null::varchar as system, owner from documents union all select 'record', content, domain, system, null from {one('content', 'domain', 'system')})
        select kind, domain, count(*) as n, sum(coalesce(length(text), 0))::bigint as n_chars, count(system) as n_systems, count(owner) as n_owners from u group by 1, 2""",
    "query_variants": """with b as (select distinct lower(trim(query_text)) as base from query_log where flagged and query_text is not null and lower(trim(query_text)) <> ''),
        t(template_no, template) as (values (0, '{}'), (1, 'please {}'), (2, 'tell me: {}'), (3, '{} in the lab'))
        select replace(template, '{}', base) as variant, min(template_no) as template_no from b, t group by 1""",
}
