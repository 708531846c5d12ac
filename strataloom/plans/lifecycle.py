"""Registered queries on derived state and its checks, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.functions.vectors import usable_sql
from strataloom.operators import lifecycle as L
from strataloom.plans.reports import one, ref
from strataloom.sources.tables import records, table

AS_OF = "2025-12-15 00:00:00"


def _records(spark, d, *columns):
    k = records(spark, d, *columns)
    return k.withColumns({c: uuid_of(c) for c in ("supersedes_id", "document_id") if c in columns})


def _events(spark, d):
    e = table(spark, d, "supersession_events")
    return e.withColumns({c: uuid_of(c) for c in ("id", "superseded_id", "superseding_id")})


def event_projection(spark, d):
    p = L.project(_records(spark, d, "status", "valid_until"), _events(spark, d))
    return p.select("id", "status", F.unix_seconds("valid_until").alias("until_s"))


def reconcile_drift(spark, d):
    return L.status_drift(_records(spark, d, "status"), _events(spark, d))


def drift_counts(spark, d):
    return reconcile_drift(spark, d).groupBy("drift").agg(F.count(F.lit(1)).alias("n"))


def asof_valid_time(spark, d):
    k = _records(spark, d, "valid_from", "valid_until", "system", "domain")
    return L.as_of(k, F.to_timestamp(F.lit(AS_OF))).select("id", "system", "domain")


def asof_each_event(spark, d):
    """How many records were valid when each retirement occurred."""
    times = table(spark, d, "supersession_events").filter("occurred_at is not null").select(F.unix_seconds("occurred_at").alias("at_s")).distinct()
    return L.counts_at(_records(spark, d, "valid_from", "valid_until"), times)


def lifespan_chain(spark, d):
    return L.lifespans(_records(spark, d, "system", "component_key", "valid_from").filter("component_key is not null"), ["system", "component_key"])


def evidence_counts(spark, d):
    targets = table(spark, d, "retirement_requests").select(uuid_of("target_id").alias("id")).filter("id is not null")
    return L.evidence(targets, _records(spark, d, "document_id", "supersedes_id"), _events(spark, d).dropDuplicates(["id"]))


def predecessor_backfill(spark, d):
    """Each record that names a predecessor, with what is known of it."""
    k = _records(spark, d, "supersedes_id", "created_at", "status")
    p = k.select(F.col("id").alias("supersedes_id"), F.col("status").alias("old_status"), F.unix_seconds("created_at").alias("old_created_s"))
    return k.filter("supersedes_id is not null").join(p, "supersedes_id").select("id", "supersedes_id", "old_status", "old_created_s")


def section_parents(spark, d):
    """Sections with the metadata of their document."""
    k = _records(spark, d, "document_id", "chunk_index", "domain", "system", "status")
    parent = k.select(F.col("id").alias("document_id"), F.col("domain").alias("parent_domain"), F.col("system").alias("parent_system"), F.col("status").alias("parent_status"))
    return k.filter("document_id is not null").join(parent, "document_id").select("id", "document_id", "chunk_index", "parent_domain", "parent_system", "parent_status")


def orphan_antijoin(spark, d):
    """Current whole documents without a section."""
    k = _records(spark, d, "document_id", "status")
    return L.uncovered(k.filter("document_id is null and status = 'current'").select("id"), k, "document_id")


def gap_notin(spark, d):
    """Texts of documents that no record holds."""
    texts = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", F.md5("text").alias("h"))
    held = records(spark, d, "content").filter("content is not null").select(F.md5("content").alias("h")).distinct()
    return texts.join(held, "h", "left_anti").select("doc_id")


def request_targets(spark, d):
    """Requests with their target's state, whether or not it still exists."""
    r = table(spark, d, "retirement_requests").select(F.lower("id").alias("id"), uuid_of("target_id").alias("target_id"), "method", F.col("status").alias("request_status")).distinct()
    k = records(spark, d, "status", "domain").select(F.col("id").alias("target_id"), F.col("status").alias("target_status"), "domain")
    return r.join(k, "target_id", "left")


def contradiction_pairs(spark, d):
    k = records(spark, d, "status", "system", "embedding")
    c = L.contradiction_candidates(k, 0.9)
    return c.select("system", "id_lo", "id_hi", F.round("similarity", 6).alias("similarity"))


def undecided_pairs(spark, d):
    """Candidates of which neither side has been retired since: both still current by the log."""
    now = L.project(records(spark, d, "status", "valid_until"), _events(spark, d))
    c = L.contradiction_candidates(records(spark, d, "status", "system", "embedding"), 0.9)
    return L.still_current(c, now).groupBy("system").agg(F.count(F.lit(1)).alias("n"))


def invalid_spans(spark, d):
    """Records whose period ends before it begins, or whose status or environment is none of the list."""
    k = records(spark, d, "valid_from", "valid_until", "status", "environment")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("valid_until") < F.col("valid_from"), "span"), F.when(~F.coalesce(F.lower(F.trim("status")), F.lit("")).isin("current", "superseded", "historical", "draft"), "status"),
            F.when(~F.coalesce("environment", F.lit("")).isin("Production", "Lab", "Study", "Archive"), "environment"),
        )
    )
    return k.select("id", F.array_join(reasons, "|").alias("reasons")).filter("reasons <> ''")


def request_evidence_json(spark, d):
    """Fields of the evidence text."""
    r = table(spark, d, "retirement_requests").dropDuplicates(["id"])
    return r.select(F.lower("id").alias("id"), F.get_json_object("evidence", "$.refs").cast("int").alias("refs"), F.get_json_object("evidence", "$.owner").alias("owner"), F.get_json_object("evidence", "$.title").alias("title"))


def reason_methods(spark, d):
    """Events per reason and method with subtotals."""
    return _events(spark, d).dropDuplicates(["id"]).cube("reason_code", "method").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        event_projection, reconcile_drift, drift_counts, asof_valid_time, asof_each_event, lifespan_chain, evidence_counts, predecessor_backfill, section_parents, orphan_antijoin, gap_notin, request_targets,
        contradiction_pairs, undecided_pairs, invalid_spans, request_evidence_json, reason_methods,
    )
}

_EV = f"""e0 as (select distinct {ref('id')} as id, {ref('superseded_id')} as superseded_id, {ref('superseding_id')} as superseding_id, occurred_at, fact_valid_until from supersession_events),
e as (select * from e0 where superseded_id is not null and superseded_id is distinct from superseding_id qualify row_number() over (partition by superseded_id order by occurred_at nulls last, id) = 1)"""
_PROJ = f"""k as {one('status', 'valid_until')}, {_EV},
p as (select k.id, case when k.status = 'current' and e.id is not null then case when superseding_id is not null then 'superseded' else 'historical' end else k.status end as status,
  case when k.status = 'current' and e.id is not null then coalesce(fact_valid_until, occurred_at) else k.valid_until end as valid_until from k left join e on e.superseded_id = k.id)"""
_DRIFT = f"""with k as {one('status')}, {_EV}, x as (select superseded_id as id, case when superseding_id is not null then 'superseded' else 'historical' end as expected from e),
dr as (select id, status as stored, expected, 'event_present_status_mismatch' as drift from k join x using (id) where status is distinct from expected
  union all select id, status, 'current', 'superseded_without_event' from k where status = 'superseded' and id not in (select id from x))"""
_PAIRS = f"""c as materialized (select system, a.id as id_lo, b.id as id_hi, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity
  from w a join w b using (system) where a.id < b.id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.9)"""
_W = f"w as materialized (select * from {one('status', 'system', 'embedding')} where status = 'current' and system is not null and {usable_sql('embedding', 64)})"
ORACLES = {
    "event_projection": f"with {_PROJ} select id, status, epoch_us(valid_until) // 1000000 as until_s from p",
    "reconcile_drift": _DRIFT + " select * from dr",
    "drift_counts": _DRIFT + " select drift, count(*) as n from dr group by drift",
    "asof_valid_time": f"select id, system, domain from {one('valid_from', 'valid_until', 'system', 'domain')} where valid_from <= timestamptz '{AS_OF}+00' and (valid_until is null or valid_until > timestamptz '{AS_OF}+00')",
    "asof_each_event": f"""with k as {one('valid_from', 'valid_until')}, t as (select distinct occurred_at from supersession_events where occurred_at is not null)
        select epoch_us(occurred_at) // 1000000 as at_s, count(*) as n_valid, min(id) as least_id from t join k on valid_from <= occurred_at and (valid_until is null or valid_until > occurred_at) group by 1""",
    "lifespan_chain": f"""select system, component_key, id, epoch_us(valid_from) // 1000000 as start_s, epoch_us(lead(valid_from) over w) // 1000000 as end_s, lead(id) over w as successor_id
        from {one('system', 'component_key', 'valid_from')} where component_key is not null and valid_from is not null window w as (partition by system, component_key order by valid_from, id)""",
    "evidence_counts": f"""with t as (select distinct {ref('target_id')} as id from retirement_requests where {ref('target_id')} is not null), k as (select {ref('document_id')} as doc, {ref('supersedes_id')} as sup from {one('document_id', 'supersedes_id')}), {_EV},
        x as (select id, (select count(*) from k where doc = t.id) as n_sections, (select count(*) from k where sup = t.id) as n_successors, (select count(*) from e0 where superseded_id = t.id) as n_retired_by, (select count(*) from e0 where superseding_id = t.id) as n_retires from t)
        select *, n_sections + n_successors + n_retired_by + n_retires = 0 as deletable from x""",
    "predecessor_backfill": f"""with k as (select id, {ref('supersedes_id')} as sup, status, created_at from {one('supersedes_id', 'created_at', 'status')})
        select k.id, k.sup as supersedes_id, p.status as old_status, epoch_us(p.created_at) // 1000000 as old_created_s from k join k p on p.id = k.sup""",
    "section_parents": f"""with k as (select id, {ref('document_id')} as doc, chunk_index, domain, system, status from {one('document_id', 'chunk_index', 'domain', 'system', 'status')})
        select k.id, k.doc as document_id, k.chunk_index, p.domain as parent_domain, p.system as parent_system, p.status as parent_status from k join k p on p.id = k.doc""",
    "orphan_antijoin": f"""with k as (select id, {ref('document_id')} as doc, status from {one('document_id', 'status')})
        select id from k where doc is null and status = 'current' and not exists (select 1 from k s where s.doc = k.id)""",
    "gap_notin": "select doc_id from documents where length(text) > 0 and text not in (select content from knowledge where content is not null)",
    "request_targets": f"""select distinct lower(r.id) as id, {ref('r.target_id')} as target_id, r.method, r.status as request_status, k.status as target_status, k.domain
        from retirement_requests r left join {one('status', 'domain')} k on k.id = {ref('r.target_id')}""",
    "contradiction_pairs": f"with {_W}, {_PAIRS} select system, id_lo, id_hi, round(similarity, 6) as similarity from c",
    "undecided_pairs": f"with {_W}, {_PAIRS}, {_PROJ}, now_ as (select id from p where status = 'current') select system, count(*) as n from c where id_lo in (select id from now_) and id_hi in (select id from now_) group by system",
    "invalid_spans": f"""with k as {one('valid_from', 'valid_until', 'status', 'environment')}, x as (select id, concat_ws('|', case when valid_until < valid_from then 'span' end,
        case when coalesce(lower(trim(status)), '') not in ('current', 'superseded', 'historical', 'draft') then 'status' end, case when coalesce(environment, '') not in ('Production', 'Lab', 'Study', 'Archive') then 'environment' end) as reasons from k)
        select * from x where reasons <> ''""",
    "request_evidence_json": "select distinct lower(id) as id, (evidence::json ->> '$.refs')::int as refs, evidence::json ->> '$.owner' as owner, evidence::json ->> '$.title' as title from retirement_requests",
    "reason_methods": "select reason_code, method, count(*) as n from (select distinct * from supersession_events) group by cube (reason_code, method)",
}
