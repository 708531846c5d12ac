"""Further registered queries over retrieval lists and snapshot writes, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.functions.vectors import usable
from strataloom.operators import search as S
from strataloom.operators import writes as W
from strataloom.operators.skew import BLOCK_ROWS, pairs_join
from strataloom.plans.lifecycle import _EV, _events
from strataloom.plans.reports import one, ref
from strataloom.plans.search import _BOOST, _DECAY, _corpus, _lexical, _questions, _ranked, _sql, _vector
from strataloom.session import written
from strataloom.sources.tables import records, table


def facet_filter(spark, d):
    """Current records of one domain and environment, or of one owner."""
    k = records(spark, d, "status", "domain", "environment", "created_by")
    facets = (F.col("domain") == "Network") & (F.col("environment") == "Lab") | (F.col("created_by") == "owner_0001")
    return k.filter((F.col("status") == "current") & facets).select("id", "domain", "environment", "created_by")


def retriever_overlap(spark, d, asks=None):
    """Per question how many of the ten best by vectors are among the ten best by terms."""
    k = _corpus(spark, d, asks)
    v, t = _vector(k, k=10).select("qid", "id", F.lit(1).alias("v")), _lexical(k, k=10).select("qid", "id", F.lit(1).alias("t"))
    both = v.join(t, ["qid", "id"], "full")
    return both.groupBy("qid").agg(F.count("v").alias("n_vector"), F.count("t").alias("n_lexical"), F.count(F.col("v") + F.col("t")).alias("n_both"))


def capture_compare(spark, d, asks=None):
    """Two captures compared place by place: plain fusion against boosted and decayed."""
    k = _corpus(spark, d, asks)
    a = _ranked(k).filter("place < 5").select("qid", "place", F.col("id").alias("plain_id"))
    b = _ranked(k, boost=1.5, half_life_days=90.0).filter("place < 5").select("qid", "place", F.col("id").alias("modified_id"))
    return a.join(b, ["qid", "place"], "full").withColumn("same", F.col("plain_id").eqNullSafe(F.col("modified_id")))


def similar_documents(spark, d, asks=None):
    """The three most similar current records of each question, then those of them above the floor."""
    k = _corpus(spark, d, asks)
    good = usable(F.col("embedding"), 64)
    v = S.vector_top(_questions(k).filter(good), k.filter(good & (F.col("status") == "current")), 3, exclude_self=True)
    return v.filter("similarity >= 0.5").select("qid", "id", F.round("similarity", 6).alias("similarity"))


def listed_for(rows, block_rows=BLOCK_ROWS):
    """``qid, id``: for every record (``id, system, component_key, status``) the other current ones of its system and component."""
    keyed = rows.select("id", F.struct("system", "component_key").alias("key"), "status")
    asked, live = keyed.select("key", F.col("id").alias("qid")), keyed.filter("status = 'current'").select("key", "id")
    return pairs_join(asked, live, "key", F.col("qid"), F.col("id"), block_rows).filter("id <> qid").select("qid", "id")


def plan_candidates(spark, d, asks=None):
    """What exists already: for every record with a component the current ones of its system with it, for each question similar ones."""
    k = _corpus(spark, d, asks)
    keyed = k.filter("system is not null and component_key is not null").select("id", "system", "component_key", "status")
    return listed_for(written(keyed, "plan-records")).unionByName(similar_documents(spark, d, asks).select("qid", "id")).distinct()


def document_fusion(spark, d, asks=None):
    """Fusion by document: several sections of one document add up."""
    k = _corpus(spark, d, asks)
    f = S.fuse(_vector(k), _lexical(k)).join(k.select("id", "document_id"), "id")
    score = f.groupBy("qid", F.coalesce("document_id", "id").alias("doc")).agg(F.round(F.sum("rrf_score"), 9).alias("score"), F.count(F.lit(1)).alias("n_sections"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return score.withColumn("place", F.row_number().over(w) - 1).filter("place < 5")


def context_pack(spark, d, asks=None):
    """The first four hits of each question, 400 characters of each, as one text."""
    k = _corpus(spark, d, asks)
    r = _ranked(k).filter("place < 4").select("qid", "id", "place").join(k.select("id", F.substring(F.coalesce("content", F.lit("")), 1, 400).alias("part")), "id")
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n---\n")
    return r.groupBy("qid").agg(F.md5(packed).alias("pack_hash"), F.count(F.lit(1)).alias("n"))


def existing_for_source(spark, d):
    """Documents per source, counted by owner or source field alike."""
    t = table(spark, d, "documents")
    listed = t.select("doc_id", F.explode(F.array_distinct(F.array_compact(F.array("source", "source_type")))).alias("name"))
    return listed.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def log_tail(spark, d):
    """The twenty latest flagged queries."""
    return table(spark, d, "query_log").filter("flagged").select("id", "flag_reason", F.unix_seconds("created_at").alias("at_s")).distinct().orderBy(F.desc_nulls_last("at_s"), "id").limit(20)


def resolve_ids(spark, d):
    """Referenced ids as section or as document, with the document they lead to."""
    k = records(spark, d, "document_id", "heading").withColumn("document_id", uuid_of("document_id"))
    want = records(spark, d, "supersedes_id").select(uuid_of("supersedes_id").alias("ref")).filter("ref is not null").distinct()
    hit = want.join(k.withColumnRenamed("id", "ref"), "ref", "left")
    parents = k.select(F.col("id").alias("document_id"), F.lit(True).alias("has_parent"))
    out = hit.join(parents, "document_id", "left")
    kind = F.when(F.col("has_parent"), "section").when(F.col("document_id").isNotNull(), "lost section")
    present = records(spark, d).select(F.col("id").alias("ref"), F.lit(True).alias("present"))
    return out.join(present, "ref", "left").select("ref", F.coalesce(kind, F.when(F.col("present"), "document"), F.lit("nothing")).alias("kind"), F.coalesce("document_id", F.when(F.col("present"), F.col("ref"))).alias("leads_to"))


def bulk_reclassify(spark, d):
    """Records named by requests move to the archive; a missing system becomes the first of the vocabulary."""
    k = records(spark, d, "environment", "system")
    named = table(spark, d, "retirement_requests").select(uuid_of("target_id").alias("id")).filter("id is not null").distinct()
    first = table(spark, d, "system_vocabulary").agg(F.min("system").alias("least"))  # one row
    moved = k.join(named.withColumn("hit", F.lit(True)), "id", "left").crossJoin(F.broadcast(first))
    return moved.select("id", F.when(F.col("hit"), "Archive").otherwise(F.col("environment")).alias("environment"), F.when(F.col("hit"), F.coalesce("system", "least")).otherwise(F.col("system")).alias("system"))


def mark_stale(spark, d):
    """Which (domain, system) pages are stale: something of theirs was retired, null systems equal to each other."""
    k = records(spark, d, "domain", "system")
    pages = k.select("domain", "system").distinct()
    retired = k.join(_events(spark, d).select(F.col("superseded_id").alias("id")).distinct(), "id").select("domain", "system").distinct().withColumn("hit", F.lit(True))
    a, b = pages.alias("a"), retired.alias("b")
    out = a.join(b, F.col("a.domain").eqNullSafe(F.col("b.domain")) & F.col("a.system").eqNullSafe(F.col("b.system")), "left")
    return out.select("a.domain", "a.system", F.coalesce("hit", F.lit(False)).alias("is_stale"))


def removed_records(spark, d):
    """The table after executed deletions: a removed document goes with its sections."""
    k = records(spark, d, "document_id").withColumn("document_id", uuid_of("document_id"))
    gone = table(spark, d, "retirement_requests").filter("method = 'delete' and status in ('approved', 'executed')").select(uuid_of("target_id").alias("id")).filter("id is not null").distinct()
    left = k.join(gone, "id", "left_anti")
    return left.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select("id", "document_id")


def promote_counts(spark, d):
    """Historical records without a system become current: per owner how many."""
    k = records(spark, d, "status", "system", "created_by").filter("status = 'historical' and system is null")
    return k.groupBy("created_by").agg(F.count(F.lit(1)).alias("n"))


def newest_prior(spark, d):
    """For each keyed record the newest earlier one of the same system and component: what a keyed write would retire."""
    k = records(spark, d, "system", "component_key", "valid_from").filter("component_key is not null and valid_from is not null")
    w = Window.partitionBy("system", "component_key").orderBy("valid_from", "id")
    return k.withColumn("prior_id", F.lag("id").over(w)).filter("prior_id is not null").select("id", "prior_id")


def replayed_inserts(spark, d):
    """Deliveries of the log that repeat a row: what an insert-once would refuse."""
    log = table(spark, d, "query_log").select("id", "owner", "mode")
    return log.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(W.insert_absent(log.limit(0), log, ["id"]), "id").select("id", "owner", "n")


QUERIES = {
    f.__name__: f
    for f in (
        facet_filter, retriever_overlap, capture_compare, similar_documents, plan_candidates, document_fusion, context_pack, existing_for_source, log_tail, resolve_ids, bulk_reclassify, mark_stale, removed_records, promote_counts, newest_prior, replayed_inserts,
    )
}

_SIM = _sql("select qid, id, round(similarity, 6) as similarity from v where similarity >= 0.5", k=3, scope="kk as (select * from k where status = 'current'),")
ORACLES = {
    "facet_filter": f"select id, domain, environment, created_by from {one('status', 'domain', 'environment', 'created_by')} where status = 'current' and (domain = 'Network' and environment = 'Lab' or created_by = 'owner_0001')",
    "retriever_overlap": _sql("select coalesce(v.qid, l.qid) as qid, count(v.id) as n_vector, count(l.id) as n_lexical, count(v.id || l.id) as n_both from v full join l on v.qid = l.qid and v.id = l.id group by 1", k=10),
    "capture_compare": f"""with a as ({_sql('select qid, place, id from r where place < 5')}), b as ({_sql('select qid, place, id from r where place < 5', boost=_BOOST, decay=_DECAY)})
        select coalesce(a.qid, b.qid) as qid, coalesce(a.place, b.place) as place, a.id as plain_id, b.id as modified_id, a.id is not distinct from b.id as same from a full join b on a.qid = b.qid and a.place = b.place""",
    "similar_documents": _SIM,
    "plan_candidates": f"""with s as ({_SIM}), k0 as {one('status', 'system', 'component_key')}
        select q.id as qid, x.id from k0 q join k0 x on q.system = x.system and q.component_key = x.component_key and q.id <> x.id where x.status = 'current' union select qid, id from s""",
    "document_fusion": _sql(""", g as (select qid, coalesce(k.document_id, f.id) as doc, round(sum(rrf_score), 9) as score, count(*) as n_sections from f join k using (id) group by 1, 2)
        select *, row_number() over (partition by qid order by score desc, doc) - 1 as place from g qualify place < 5"""),
    "context_pack": _sql(" select qid, md5(string_agg(left(coalesce(k.content, ''), 400), E'\\n---\\n' order by place)) as pack_hash, count(*) as n from r join k on k.id = r.id where place < 4 group by qid"),
    "existing_for_source": "select name, count(*) as n from (select doc_id, source as name from documents where source is not null union select doc_id, source_type from documents where source_type is not null) group by name",
    "log_tail": "select distinct id, flag_reason, epoch_us(created_at) // 1000000 as at_s from query_log where flagged order by at_s desc nulls last, id limit 20",
    "resolve_ids": f"""with k as (select id, {ref('document_id')} as doc, {ref('supersedes_id')} as sup from {one('document_id', 'supersedes_id')}), w as (select distinct sup as ref from k where sup is not null)
        select ref, case when p.id is not null then 'section' when k.doc is not null then 'lost section' when k.id is not null then 'document' else 'nothing' end as kind, coalesce(k.doc, k.id) as leads_to
        from w left join k on k.id = w.ref left join k p on p.id = k.doc""",
    "bulk_reclassify": f"""with t as (select distinct {ref('target_id')} as id from retirement_requests) select k.id, case when t.id is not null then 'Archive' else environment end as environment,
        case when t.id is not null then coalesce(system, (select min(system) from system_vocabulary)) else system end as system from {one('environment', 'system')} k left join t on t.id = k.id""",
    "mark_stale": f"""with k as {one('domain', 'system')}, {_EV}, s as (select distinct domain, system from k where id in (select superseded_id from e0 where superseded_id is not null))
        select distinct k.domain, k.system, exists (select 1 from s where s.domain is not distinct from k.domain and s.system is not distinct from k.system) as is_stale from k""",
    "removed_records": f"""with g as (select distinct {ref('target_id')} as id from retirement_requests where method = 'delete' and status in ('approved', 'executed') and {ref('target_id')} is not null)
        select id, {ref('document_id')} as document_id from {one('document_id')} where id not in (select id from g) and ({ref('document_id')} is null or {ref('document_id')} not in (select id from g))""",
    "promote_counts": f"select created_by, count(*) as n from {one('status', 'system', 'created_by')} where status = 'historical' and system is null group by 1",
    "newest_prior": f"""select id, prior_id from (select id, lag(id) over (partition by system, component_key order by valid_from, id) as prior_id from {one('system', 'component_key', 'valid_from')}
        where component_key is not null and valid_from is not null) where prior_id is not null""",
    "replayed_inserts": "select id, any_value(owner) as owner, count(*) as n from query_log group by id having count(*) > 1",
}
