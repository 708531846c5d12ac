"""Registered retrieval queries, with their oracles.

The questions are all records whose id, read as a number, is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.analyzer import stems
from strataloom.functions.ids import uuid_of
from strataloom.functions.text import content_terms_sql, snippet, terms_sql, title, word_count, words_sql
from strataloom.functions.vectors import cosine, usable, usable_sql
from strataloom.operators import search as S
from strataloom.operators.skew import BLOCK_ROWS, pairs_join
from strataloom.plans.reports import one, ref
from strataloom.session import written
from strataloom.sources.tables import records, table

NOW = "2026-06-01 00:00:00"
_COLUMNS = ("content", "embedding", "status", "domain", "environment", "system", "tags", "component_key", "created_at", "document_id", "heading", "chunk_index", "created_by")


def _corpus(spark, d, asks=None):
    """One row per record, written once: each use reads the columns it needs. ``asks`` tells which records are questions."""
    k = records(spark, d, *_COLUMNS).withColumn("document_id", uuid_of("document_id"))
    return written(k.withColumns({"word_count": word_count("content"), "asks": (asks or by_100)(F.col("id"))}), "corpus")


def by_100(id):
    """Whether a UUID, read as a number, is divisible by 100: its digits in four parts, folded from the left."""
    rest, digits = F.lit(0).cast("bigint"), F.replace(id, F.lit("-"), F.lit(""))
    for at in range(1, 33, 8):
        rest = (rest * (16**8 % 100) + F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")) % 100
    return rest == 0


def _questions(k):
    return k.filter("asks").select(F.col("id").alias("qid"), F.col("content").alias("question"), "embedding", "created_by")


def _vector(corpus, **kw):
    good = usable(F.col("embedding"), 64)
    return S.vector_top(_questions(corpus).filter(good), corpus.filter(good), exclude_self=True, **kw)


def _lexical(corpus, **kw):
    return S.lexical_top(_questions(corpus), corpus.select("id", "content"), exclude_self=True, **kw)


def _ranked(k, **kw):
    return S.rank(S.fuse(_vector(k), _lexical(k)), k.drop("content", "embedding"), F.to_timestamp(F.lit(NOW)), **kw)


def vector_topk(spark, d, asks=None):
    return _vector(_corpus(spark, d, asks), k=10).select("qid", "id", F.round("similarity", 6).alias("similarity"), "vector_rank")


def vector_topk_embeddings(spark, d):
    """Every embedding whose vec_id is divisible by 100 against all embeddings."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter("id % 100 = 0").withColumnRenamed("id", "qid")
    return S.vector_top(q, e, 10, exclude_self=True).select("qid", "id", F.round("similarity", 6).alias("similarity"), "vector_rank")


def lexical_topk(spark, d, asks=None):
    return _lexical(_corpus(spark, d, asks), k=10).select("qid", "id", F.round("lexical_score", 6).alias("lexical_score"), "lexical_rank")


def lexical_topk_stemmed(spark, d, asks=None):
    return _lexical(_corpus(spark, d, asks), k=10, analyze=stems).select("qid", "id", F.round("lexical_score", 6).alias("lexical_score"), "lexical_rank")


def hybrid_topk(spark, d, asks=None):
    """Fusion, length penalty, the first five with their signals."""
    r = _ranked(_corpus(spark, d, asks)).filter("place < 5")
    return r.select("qid", "id", "place", "vector_rank", "lexical_rank", "retrievers_hit", "word_count", F.round("length_penalty", 6).alias("length_penalty"), F.round("final_score", 9).alias("final_score"), "confidence")


def hybrid_modified(spark, d, asks=None):
    """Boosted components, decayed ages, dissimilar hits suppressed, one hit per document with its siblings."""
    r = S.collapse(_ranked(_corpus(spark, d, asks), boost=1.5, half_life_days=90.0, floor=0.1), 5)
    return r.select("qid", "id", "final_place", F.round("final_score", 9).alias("final_score"), "confidence", F.size("siblings").alias("n_siblings"), F.array_join("siblings", ",").alias("siblings"))


def hybrid_dispatch(spark, d, asks=None):
    """Current records first; a question whose best hit is of low confidence is asked of all statuses instead."""
    k = _corpus(spark, d, asks)
    asked = S.fuse(_vector(k), _lexical(k))
    current = k.filter(F.coalesce(F.lower(F.trim("status")) == "current", F.lit(False)))
    of_current = S.fuse(S.vector_top(_questions(k).filter(usable(F.col("embedding"), 64)), current.filter(usable(F.col("embedding"), 64)), exclude_self=True), S.lexical_top(_questions(k), current.select("id", "content"), exclude_self=True))
    now = F.to_timestamp(F.lit(NOW))
    first = S.rank(of_current, k.drop("content", "embedding"), now).select("qid", "id", "place", "confidence", F.lit("current").alias("scope"))
    every = S.rank(asked, k.drop("content", "embedding"), now).select("qid", "id", "place", "confidence", F.lit("all").alias("scope"))
    trusted = first.filter("place = 0 and confidence <> 'low'").select("qid")
    return first.join(trusted, "qid", "left_semi").unionByName(every.join(trusted, "qid", "left_anti")).filter("place < 5")


def question_confidence(spark, d, asks=None):
    """Per question the confidence of its first two hits: the first that isn't low, else low."""
    r = _ranked(_corpus(spark, d, asks)).filter("place < 2")
    good = F.min_by("confidence", F.when(F.col("confidence") != "low", F.col("place")))
    return r.groupBy("qid").agg(F.coalesce(F.when(good != "low", good), F.lit("low")).alias("confidence"), F.count(F.lit(1)).alias("n_hits"))


def retrieval_quality(spark, d, asks=None):
    """Over all questions: how often a hit of the same document or system is among the first two, and the confidences."""
    k = _corpus(spark, d, asks)
    r = _ranked(k).filter("place < 2").select("qid", "id", "place", "confidence")
    system = k.select("id", F.coalesce("system", F.lit("?")).alias("s"), F.coalesce("domain", F.lit("?")).alias("dom"))
    r = r.join(system, "id").join(system.select(F.col("id").alias("qid"), F.col("s").alias("qs"), F.col("dom").alias("qdom")), "qid")
    per = r.groupBy("qid").agg(F.max(F.col("s") == F.col("qs")).alias("same_system"), F.max(F.col("dom") == F.col("qdom")).alias("same_domain"), F.min_by("confidence", "place").alias("confidence"))
    return per.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("same_system").alias("n_same_system"), F.count_if("same_domain").alias("n_same_domain"))


def separation_margin(spark, d, asks=None):
    """Least best similarity of questions with a near copy against the greatest best similarity of the others."""
    best = _vector(_corpus(spark, d, asks), k=1).select("qid", "similarity")
    near = F.col("similarity") >= 0.9
    return best.agg(F.round(F.min(F.when(near, F.col("similarity"))), 6).alias("least_near"), F.round(F.max(F.when(~near, F.col("similarity"))), 6).alias("greatest_far"), F.count(F.lit(1)).alias("n"))


def rank_gaps(spark, d, asks=None):
    """Per question the similarity lost from the first to the fifth hit and the mean of the five."""
    v = _vector(_corpus(spark, d, asks), k=5)
    at = lambda r: F.max(F.when(F.col("vector_rank") == r, F.col("similarity")))
    return v.groupBy("qid").agg(F.round(at(0) - at(4), 6).alias("gap"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def skim(spark, d):
    """The slim form of every record: snippet, title, provenance, whether it is a section."""
    k = _corpus(spark, d)
    provenance = F.coalesce(F.nullif(F.concat_ws("/", "domain", "system"), F.lit("")), F.lit("knowledge"))
    head = F.when(F.col("heading").isNull() & F.col("document_id").isNull(), title("content")).otherwise(F.col("heading"))
    return k.select("id", snippet("content").alias("snippet"), head.alias("heading"), provenance.alias("provenance"), F.col("document_id").isNotNull().alias("chunked"))


def fetch_by_ids(spark, d, asks=None):
    """For every question's owner: the question's record and its sections, in order."""
    k = _corpus(spark, d, asks)
    want = _questions(k).select("qid", F.col("created_by").alias("owner"))
    own = k.select("id", "document_id", "chunk_index", "created_by").withColumn("of", F.array_distinct(F.array(F.col("id"), F.coalesce("document_id", "id"))))
    hits = own.withColumn("qid", F.explode("of")).join(want, "qid").filter(F.col("created_by") == F.col("owner"))
    return hits.select("qid", "id", "document_id", "chunk_index").distinct()


def component_pairs(rows, block_rows=BLOCK_ROWS):
    """Cosine similarity of each record (``id, component_key, embedding, created_at``) with all before it of the same component key."""
    k = rows.withColumn("_o", F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(-(2**63))).alias("at"), "id"))
    later = k.select("component_key", "id", "_o", "embedding")
    prior = k.select("component_key", F.col("id").alias("prior_id"), F.col("_o").alias("_p"), F.col("embedding").alias("prior"))
    pairs = pairs_join(later, prior, "component_key", F.col("id"), F.col("prior_id"), block_rows).filter("_p < _o")
    return pairs.select("component_key", "id", "prior_id", F.round(cosine(F.col("embedding"), F.col("prior")), 6).alias("similarity"))


def same_component_pairs(spark, d):
    """Cosine similarity of all records that share a component key, each pair once: ``prior_id`` is the earlier one."""
    k = records(spark, d, "component_key", "embedding", "created_at").filter(F.col("component_key").isNotNull() & usable(F.col("embedding"), 64))
    return component_pairs(written(k, "component-records"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_embeddings, lexical_topk, lexical_topk_stemmed, hybrid_topk, hybrid_modified, hybrid_dispatch, question_confidence, retrieval_quality, separation_margin, rank_gaps, skim, fetch_by_ids, same_component_pairs,
    )
}

_COS = "list_cosine_similarity({0}::double[], {1}::double[])"
_BASE = f"""
k as materialized (select *, {ref('document_id_raw')} as document_id, coalesce(len({words_sql('content')}), 0) as word_count, {usable_sql('embedding', 64)} as ok from
  (select lower(id) as id, {', '.join(f'first({c}) as {c}{"_raw" if c == "document_id" else ""}' for c in _COLUMNS)} from knowledge group by lower(id))),
q as (select id as qid, content as question, embedding, created_by, ok from k where {{asks}}),
{{scope}}
v as (select qid, id, similarity, row_number() over (partition by qid order by round(similarity, 12) desc, id) - 1 as vector_rank
  from (select q.qid, k.id, {_COS.format('q.embedding', 'k.embedding')} as similarity from q join kk as k on q.qid <> k.id where q.ok and k.ok) qualify vector_rank < {{k}}),
qt as (select distinct qid, term from (select qid, unnest({content_terms_sql(f"list_slice({terms_sql('question')}, 1, 16)")}) as term from q)),
p as (select id, term, count(*) as tf from (select id, unnest({terms_sql('content', True)}) as term from kk) group by 1, 2),
l as (select qid, id, lexical_score, row_number() over (partition by qid order by lexical_score desc, id) - 1 as lexical_rank
  from (select qid, id, round(sum(tf / (tf + 1.2)), 9) as lexical_score from p join qt using (term) where qid <> id group by 1, 2) qualify lexical_rank < {{k}}),
f as (select coalesce(v.qid, l.qid) as qid, coalesce(v.id, l.id) as id, vector_rank, similarity, lexical_rank, lexical_score,
    round(coalesce(1.0::double / (61 + vector_rank), 0) + coalesce(1.0::double / (61 + lexical_rank), 0), 12) as rrf_score, (vector_rank is not null)::int + (lexical_rank is not null)::int as retrievers_hit
  from v full join l on v.qid = l.qid and v.id = l.id),
m as (select f.*, k.word_count, k.document_id,
    case when k.document_id is null and k.word_count < 30 then k.word_count / 30.0::double else 1.0::double end as length_penalty,
    (component_key is not null or coalesce(list_count(list_filter(tags, lambda t: starts_with(t, 'component:'))) > 0, false)) as component, status, domain, tags, created_at
  from f join k using (id)),
s as (select *, round(rrf_score * length_penalty * {{boost}} * {{decay}}, 12) as final_score from m where {{floor}}),
o as (select *, row_number() over (partition by qid order by final_score desc, lexical_rank nulls last, vector_rank nulls last, id) - 1 as place from s qualify place < 50),
r0 as (select *, case when place <= 1 then lead(final_score) over (partition by qid order by place) end as neighbour, coalesce(lexical_rank = 0 and vector_rank = 0, false) as agree from o),
r as (select *, case when document_id is null and word_count < 30 then 'low'
    when similarity is null then case when word_count < 30 or final_score < 0.012 then 'low' when final_score >= 0.020 and coalesce(final_score - neighbour, final_score) >= 0.004 and word_count >= 100 then 'high' else 'medium' end
    when similarity >= 0.62 and (word_count >= 100 or agree) then 'high' when similarity >= 0.45 then 'medium' else 'low' end as confidence from r0)
"""
#: The 32 digits of a UUID as a number.
_BY_100 = "('0x' || replace(id, '-', ''))::uhugeint % 100 = 0"
_PLAIN = {"asks": _BY_100, "k": 50, "boost": "1.0::double", "decay": "1.0::double", "floor": "true", "scope": "kk as (select * from k),"}
_BOOST = "case when status = 'current' and component then 1.5::double else 1.0::double end"
_DECAY = f"""case when component or coalesce(list_contains(tags, 'durable'), false) or created_at is null or not coalesce(domain in ('K8s', 'Network', 'Security'), false) then 1.0::double
  else greatest(0.25::double, pow(0.5::double, greatest((epoch_us(timestamptz '{NOW}+00') // 1000000 - epoch_us(created_at) // 1000000) / 86400.0::double, 0) / 90.0::double)) end"""


def _sql(tail: str, **change) -> str:
    text = _BASE
    for name, value in (_PLAIN | change).items():
        text = text.replace("{" + name + "}", str(value))
    return "with " + text + tail


ORACLES = {
    "vector_topk": _sql("select qid, id, round(similarity, 6) as similarity, vector_rank from v", k=10),
    "vector_topk_embeddings": f"""select qid, id, round(similarity, 6) as similarity, row_number() over (partition by qid order by round(similarity, 12) desc, id) - 1 as vector_rank
        from (select q.vec_id as qid, e.vec_id as id, {_COS.format('q.embedding', 'e.embedding')} as similarity from embeddings q join embeddings e on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id) qualify vector_rank < 10""",
    "lexical_topk": _sql("select qid, id, round(lexical_score, 6) as lexical_score, lexical_rank from l", k=10),
    "hybrid_topk": _sql("select qid, id, place, vector_rank, lexical_rank, retrievers_hit, word_count, round(length_penalty, 6) as length_penalty, round(final_score, 9) as final_score, confidence from r where place < 5"),
    "hybrid_modified": _sql(
        """, c as (select *, row_number() over (partition by qid, coalesce(document_id, id) order by place) as at_doc, list(id order by place) over (partition by qid, coalesce(document_id, id)) as family from r)
        select qid, id, row_number() over (partition by qid order by place) - 1 as final_place, round(final_score, 9) as final_score, confidence, len(family) - 1 as n_siblings, array_to_string(list_filter(family, lambda x: x <> id), ',') as siblings
        from c where at_doc = 1 qualify final_place < 5""",
        boost=_BOOST, decay=_DECAY, floor="similarity is null or similarity >= 0.1",
    ),
    "question_confidence": _sql("select qid, coalesce(arg_min(confidence, place) filter (where confidence <> 'low'), 'low') as confidence, count(*) as n_hits from r where place < 2 group by qid"),
    "retrieval_quality": _sql(
        """, x as (select r.qid, place, confidence, coalesce(a.system, '?') = coalesce(b.system, '?') as same_system, coalesce(a.domain, '?') = coalesce(b.domain, '?') as same_domain from r join k a on a.id = r.id join k b on b.id = r.qid where place < 2),
        y as (select qid, bool_or(same_system) as s, bool_or(same_domain) as d, arg_min(confidence, place) as confidence from x group by qid)
        select confidence, count(*) as n, count(*) filter (where s) as n_same_system, count(*) filter (where d) as n_same_domain from y group by confidence"""
    ),
    "separation_margin": _sql("select round(min(similarity) filter (where similarity >= 0.9), 6) as least_near, round(max(similarity) filter (where similarity < 0.9), 6) as greatest_far, count(*) as n from v", k=1),
    "rank_gaps": _sql("select qid, round(max(similarity) filter (where vector_rank = 0) - max(similarity) filter (where vector_rank = 4), 6) as gap, round(avg(similarity), 6) as mean_similarity from v group by qid", k=5),
    "skim": f"""with k as (select *, {ref('document_id')} as doc, {words_sql('content')} as w from {one('content', 'heading', 'domain', 'system', 'document_id')})
        select id, case when len(w) > 40 then array_to_string(w[1:40], ' ') || '…' else array_to_string(w, ' ') end as snippet,
          case when heading is null and doc is null then split_part(regexp_replace(content, '^#+\\s*', ''), E'\\n', 1) else heading end as heading,
          coalesce(nullif(concat_ws('/', domain, system), ''), 'knowledge') as provenance, doc is not null as chunked from k""",
    "fetch_by_ids": f"""with k as (select *, {ref('document_id')} as doc from {one('document_id', 'chunk_index', 'created_by')}), q as (select id as qid, created_by from k where {_BY_100})
        select distinct qid, k.id, k.doc as document_id, k.chunk_index from q join k on (k.id = q.qid or k.doc = q.qid) and k.created_by = q.created_by""",
    "same_component_pairs": f"""with k as (select *, coalesce(epoch_us(created_at), -9223372036854775808) as at from {one('component_key', 'embedding', 'created_at')} where component_key is not null and {usable_sql('embedding', 64)})
        select a.component_key, a.id, b.id as prior_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) as similarity from k a join k b on a.component_key = b.component_key and (b.at, b.id) < (a.at, a.id)""",
}
_FIRST = _sql("select qid, id, place, confidence, 'current' as scope from r", scope="kk as (select * from k where coalesce(lower(trim(status)) = 'current', false)),")
_EVERY = _sql("select qid, id, place, confidence, 'all' as scope from r")
ORACLES["hybrid_dispatch"] = f"""with first_ as ({_FIRST}), every_ as ({_EVERY}), trusted as (select qid from first_ where place = 0 and confidence <> 'low')
select * from first_ where place < 5 and qid in (select qid from trusted) union all select * from every_ where place < 5 and qid not in (select qid from trusted)"""

