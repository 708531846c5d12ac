"""Registered queries on scopes of state, decided pairs, pages, deliveries and local times, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.functions.times import local_time
from strataloom.operators import lifecycle as L
from strataloom.operators import reports as R
from strataloom.operators import sessions as S
from strataloom.operators import taxonomy as T
from strataloom.operators import writes as W
from strataloom.plans.lifecycle import _EV, _PAIRS, _W, _events
from strataloom.plans.more import ORACLES as _MORE
from strataloom.plans.more import plan_candidates
from strataloom.plans.reports import one, ref
from strataloom.plans.search import _BOOST, _corpus, _ranked, _sql
from strataloom.plans.sessions import _LOG, _log, pages
from strataloom.plans.taxonomy import _ALIAS_ROWS, _NO_ALIAS, _aliases, _normalized, proposals, tag_key_sql
from strataloom.plans.taxonomy import ORACLES as _TAGS
from strataloom.sources.tables import records, table

#: When a first run of the incremental queries took place.
CUT, ZONE = "2026-03-01 00:00:00", "America/Los_Angeles"
DAY, MARKERS = "2026-02-01", ["backup", "restore"]
SCOPES = {"default": {}, "any": {"status": None}, "facets": {"domain": "Network", "environment": "Lab", "colour": "red"}, "blank": {"status": "superseded", "system": ""}}


def _cut():
    return F.coalesce(F.unix_seconds("created_at") < F.unix_seconds(F.to_timestamp(F.lit(CUT))), F.lit(False))


def current_state(spark, d):
    """The ten newest records of an owner in the default scope."""
    k = records(spark, d, "status", "domain", "environment", "system", "created_by", "valid_from")
    return L.newest(L.scoped(k, owner="owner_0001")).select("id", "domain", F.unix_seconds("valid_from").alias("from_s"))


def scope_counts(spark, d):
    """How many records each of several scopes holds, per status."""
    k = records(spark, d, "status", "domain", "environment", "system", "created_by")
    parts = [L.scoped(k, f).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit(name)) for name, f in SCOPES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def undeclared_candidates(spark, d, asks=None):
    """Of what plan_candidates shows to each record, what it names neither as its predecessor nor by a retirement."""
    refs = records(spark, d, "supersedes_id").select(F.col("id").alias("qid"), uuid_of("supersedes_id").alias("id"))
    retired = _events(spark, d).select(F.col("superseding_id").alias("qid"), F.col("superseded_id").alias("id"))
    return L.left_over(plan_candidates(spark, d, asks), refs.unionByName(retired).na.drop())


def pair_survivors(spark, d):
    """Per contradicting pair the record that is retired if the earlier one goes, and the one that stays."""
    c = L.contradiction_candidates(records(spark, d, "status", "system", "embedding"), 0.9)
    at = records(spark, d, "valid_from").withColumn("s", F.coalesce(F.unix_seconds("valid_from"), F.lit(0))).select("id", "s")
    c = c.join(at.select(F.col("id").alias("id_lo"), F.col("s").alias("lo_s")), "id_lo").join(at.select(F.col("id").alias("id_hi"), F.col("s").alias("hi_s")), "id_hi")
    c = c.withColumn("loser_id", F.when(F.col("hi_s") < F.col("lo_s"), F.col("id_hi")).otherwise(F.col("id_lo")))
    return c.select("id_lo", "id_hi", "loser_id", L.other_side(F.col("id_lo"), F.col("id_hi"), F.col("loser_id")).alias("winner_id"))


def new_contradictions(spark, d):
    """Pairs of a second run; those that a first run (over the records there were then) recorded aren't given again."""
    k = records(spark, d, "status", "system", "embedding", "created_at")
    known = L.contradiction_candidates(k.filter(_cut()), 0.9)
    return L.contradiction_candidates(k, 0.9, known=known).select("system", "id_lo", "id_hi")


def page_upsert(spark, d):
    """Pages of a first run, and those compiled anew of which a record was retired since: these are no longer stale."""
    k = records(spark, d, "domain", "status", "content", "valid_from", "created_at")
    retired = k.join(_events(spark, d).select(F.col("superseded_id").alias("id")).distinct(), "id").select("domain").distinct()
    old = pages(k.filter(_cut())).join(retired.withColumn("hit", F.lit(True)), "domain", "left").select("domain", "page", "n", F.coalesce("hit", F.lit(False)).alias("is_stale"))
    new = pages(k).join(retired, "domain", "left_semi").withColumn("is_stale", F.lit(False))
    return W.upsert(old, new, "domain", keep_if_null=()).select("domain", F.md5("page").alias("page_hash"), "n", "is_stale", "change")


def promoted_records(spark, d):
    """The table after historical records without a system became current."""
    k = records(spark, d, "status", "system")
    promoted = F.coalesce((F.col("status") == "historical") & F.col("system").isNull(), F.lit(False))
    return k.select("id", "system", F.when(promoted, "current").otherwise(F.col("status")).alias("status"), promoted.alias("promoted"))


def inserted_ids(spark, d):
    """Ids that a delivery of the whole log adds to a table that has its first part."""
    log = table(spark, d, "query_log").select("id", "owner", "mode", "created_at")
    return W.insert_absent(log.filter(_cut()), log, ["id"]).select("id", "owner")


def component_ranks(spark, d, asks=None):
    """Per question the place (from 1) of the first current component record among its ten best, and hits of both retrievers."""
    r = _ranked(_corpus(spark, d, asks), boost=1.5).filter("place < 10")
    component = F.col("component_key").isNotNull() | F.coalesce(F.exists("tags", lambda t: t.startswith("component:")), F.lit(False))
    return r.groupBy("qid").agg(F.min(F.when(component & (F.col("status") == "current"), F.col("place") + 1)).alias("component_rank"), F.count_if(F.col("retrievers_hit") == 2).alias("n_both"))


def section_totals(spark, d):
    k = records(spark, d, "document_id").withColumn("document_id", uuid_of("document_id"))
    return R.fan_out_totals(k.filter("document_id is null"), k, "document_id")


def tag_review_queue(spark, d):
    """Proposed tags, the most frequent first, of equals the one seen last."""
    p = proposals(records(spark, d, "tags", "created_at"), table(spark, d, "tag_vocabulary"))
    return p.orderBy(F.desc("n"), F.desc_nulls_last("last_s"), "key")


def event_times(spark, d):
    """When records were retired, as read in a time zone."""
    e = table(spark, d, "supersession_events").select("id", "occurred_at").distinct()
    return e.select("id", local_time(F.col("occurred_at"), ZONE).alias("shown"))


def undelivered_flags(spark, d):
    """Flagged queries that no earlier delivery marked."""
    log = _log(spark, d).filter("flagged").select("id", "owner", "created_at")
    return W.unmarked(log, log.filter(_cut()).select("id"), ["id"]).select("id", "owner")


def owner_names(spark, d):
    """Documents per owner, blanks trimmed; no owner or a blank one is that of the source, else unknown."""
    name = lambda c: F.nullif(F.trim(c), F.lit(""))
    t = table(spark, d, "documents").select(F.lower(F.coalesce(name("owner"), name("source"), F.lit("unknown"))).alias("owner_name"))
    return t.groupBy("owner_name").agg(F.count(F.lit(1)).alias("n"))


def day_scan(spark, d):
    """The queries of one day; repeated rows are unchanged, so the day is cut out first."""
    return S.lookback(table(spark, d, "query_log"), "created_at", F.to_date(F.lit(DAY)), hours=0).dropDuplicates(["id"]).select("id", "owner", "mode")


def owned_requests(spark, d):
    """Requests of an owner: who asked, who decided, else the owner that the evidence names."""
    r = table(spark, d, "retirement_requests").select("id", "requested_by", "decided_by", "evidence").distinct()
    named = F.coalesce(F.nullif(F.trim("decided_by"), F.lit("")), F.nullif(F.trim("requested_by"), F.lit("")))
    return r.filter((named == "owner_0001") | (F.get_json_object("evidence", "$.owner") == "owner_0001")).select(F.lower("id").alias("id"), named.alias("named"))


def tag_audit(spark, d):
    """Tags by class, aliases and dropped ones told apart."""
    c = T.classify_tags(records(spark, d, "tags"), table(spark, d, "tag_vocabulary"), _aliases(spark))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n_tags"), F.sum("n").alias("n_uses"), F.countDistinct("canonical").alias("n_canonical"))


def marker_tags(spark, d):
    """Records whose text names backups get a tag more."""
    k = records(spark, d, "tags", "content").select("id", T.cross_tagged(F.col("tags"), F.col("content"), MARKERS, "Backup").alias("t"))
    return k.select("id", F.array_join("t", "|").alias("tags"))


def pass_rate(spark, d, asks=None):
    """How many questions find their own system's name in one of their first two hits, without regard to case, per confidence of the first."""
    k = _corpus(spark, d, asks)
    r = _ranked(k).filter("place < 2").select("qid", "id", "place", "confidence")
    r = r.join(k.select("id", F.lower("content").alias("text")), "id").join(k.filter("asks").select(F.col("id").alias("qid"), F.lower("system").alias("wanted")), "qid")
    per = r.groupBy("qid").agg(F.max(F.coalesce(F.contains("text", "wanted"), F.lit(False))).alias("passed"), F.min_by("confidence", "place").alias("confidence"))
    return per.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        current_state, scope_counts, undeclared_candidates, pair_survivors, new_contradictions, page_upsert, promoted_records, inserted_ids, component_ranks, section_totals, tag_review_queue, event_times, undelivered_flags, owner_names,
        day_scan, owned_requests, tag_audit, marker_tags, pass_rate,
    )
}

_BEFORE = f"coalesce(created_at < timestamptz '{CUT}+00', false)"
_SCOPED = {"default": "status = 'current'", "any": "true", "facets": "status = 'current' and domain = 'Network' and environment = 'Lab'", "blank": "status = 'superseded'"}


def _page(where: str) -> str:
    return f"""(select domain, string_agg(line, E'\\n' order by r) as page, count(*) as n from (select domain, row_number() over (partition by domain order by valid_from desc, id) as r, left(split_part(content, E'\\n', 1), 80) as line
        from k where status = 'current' and content is not null and valid_from is not null and {where} qualify r <= 5) group by domain)"""


ORACLES = {
    "current_state": f"""select id, domain, epoch_us(valid_from) // 1000000 as from_s from {one('status', 'domain', 'created_by', 'valid_from')} where status = 'current' and created_by = 'owner_0001'
        order by valid_from desc nulls first, id limit 10""",
    "scope_counts": " union all ".join(f"select '{name}' as scope, status, count(*) as n from {one('status', 'domain', 'environment')} where {w} group by status" for name, w in _SCOPED.items()),
    "undeclared_candidates": f"""with shown as ({_MORE['plan_candidates']}), {_EV},
        named as (select id as qid, {ref('supersedes_id')} as id from {one('supersedes_id')} union select superseding_id, superseded_id from e0)
        select qid, count(*) as n_shown, count(*) filter (where named.id is null) as n_missing, min(shown.id) filter (where named.id is null) as least_missing from shown left join named using (qid, id) group by qid""",
    "pair_survivors": f"""with {_W}, {_PAIRS}, t as (select id, coalesce(epoch_us(valid_from) // 1000000, 0) as s from {one('valid_from')})
        select id_lo, id_hi, case when b.s < a.s then id_hi else id_lo end as loser_id, case when b.s < a.s then id_lo else id_hi end as winner_id from c join t a on a.id = id_lo join t b on b.id = id_hi""",
    "new_contradictions": f"""with {_W}, {_PAIRS}, old as (select id from {one('created_at')} where {_BEFORE})
        select system, id_lo, id_hi from c where not (id_lo in (select id from old) and id_hi in (select id from old))""",
    "page_upsert": f"""with k as {one('domain', 'status', 'content', 'valid_from', 'created_at')}, {_EV}, s as (select distinct domain from k where id in (select superseded_id from e0 where superseded_id is not null) and domain is not null),
        o as (select p.*, domain in (select domain from s) as is_stale from {_page(_BEFORE)} p where true), a as (select * from {_page('true')} where domain in (select domain from s))
        select coalesce(a.domain, o.domain) as domain, md5(coalesce(a.page, o.page)) as page_hash, coalesce(a.n, o.n) as n, case when a.domain is null then o.is_stale else false end as is_stale,
          case when o.domain is null then 'inserted' when a.domain is not null then 'updated' else 'kept' end as change from o full join a on a.domain = o.domain""",
    "promoted_records": f"""select id, system, case when status = 'historical' and system is null then 'current' else status end as status, coalesce(status = 'historical' and system is null, false) as promoted from {one('status', 'system')}""",
    "inserted_ids": f"select id, any_value(owner) as owner from query_log where id not in (select id from query_log where {_BEFORE}) group by id",
    "component_ranks": _sql("select qid, min(place + 1) filter (where component and status = 'current') as component_rank, count(*) filter (where retrievers_hit = 2) as n_both from r where place < 10 group by qid", boost=_BOOST),
    "section_totals": f"""with k as (select id, {ref('document_id')} as doc from {one('document_id')}), c as (select doc, count(*) as k from k where doc is not null group by 1), n as (select coalesce(c.k, 1) as k from k left join c on c.doc = k.id where k.doc is null)
        select count(*) as n_documents, sum(k)::bigint as n_pieces, avg(k) as mean_pieces, median(k) as median_pieces, max(k) as most_pieces, avg((k > 1)::int) as multi_share from n""",
    "tag_review_queue": f"""with {_normalized(_NO_ALIAS)}, seen as (select id, epoch_us(created_at) // 1000000 as s from {one('created_at')})
        select {tag_key_sql('tag')} as key, count(*) as n, min(tag) as spelling, min(id) as sample_id, max(s) as last_s from u join seen using (id) group by 1 order by n desc, last_s desc nulls last, key""",
    "event_times": f"select distinct id, strftime(occurred_at at time zone '{ZONE}', '%a %b %d, %-I:%M %p') as shown from supersession_events",
    "undelivered_flags": f"with {_LOG} select id, owner from lg where flagged and not {_BEFORE}",
    "day_scan": f"with {_LOG} select id, owner, mode from lg where (created_at at time zone 'UTC')::date = date '{DAY}'",
    "owned_requests": """with r as (select distinct lower(id) as id, coalesce(nullif(trim(decided_by), ''), nullif(trim(requested_by), '')) as named, evidence from retirement_requests)
        select id, named from r where coalesce(named = 'owner_0001', false) or coalesce(evidence::json ->> '$.owner' = 'owner_0001', false)""",
    "tag_audit": f"""with al(alias_key, target) as (values {_ALIAS_ROWS}), c as ({_TAGS['tag_classes']}), x as (select n, case when kind in ('empty', 'namespaced') or alias_key is null then kind when target is null then 'dropped' else 'aliased' end as kind,
          case when kind in ('empty', 'namespaced') or alias_key is null then canonical else target end as canonical from c left join al on alias_key = {tag_key_sql('tag')})
        select kind, count(*) as n_tags, sum(n)::bigint as n_uses, count(distinct canonical) as n_canonical from x group by kind""",
    "marker_tags": f"""select id, array_to_string(case when {' or '.join(f"coalesce(contains(lower(content), '{m}'), false)" for m in MARKERS)} then list_transform(list_filter(list_zip(t || ['Backup'], range(len(t) + 1)), lambda x: list_position(t || ['Backup'], x[1]) = x[2] + 1), lambda x: x[1]) else t end, '|') as tags
        from (select id, content, coalesce(tags, []) as t from {one('tags', 'content')})""",
    "pass_rate": _sql(""", x as (select r.qid, bool_or(coalesce(contains(lower(a.content), lower(b.system)), false)) as passed, arg_min(confidence, place) as confidence from r join k a on a.id = r.id join k b on b.id = r.qid where place < 2 group by r.qid)
        select confidence, count(*) as n, count(*) filter (where passed) as n_passed, round(avg(passed::int), 6) as share from x group by confidence"""),
    "owner_names": "select lower(coalesce(nullif(trim(owner), ''), nullif(trim(source), ''), 'unknown')) as owner_name, count(*) as n from documents group by 1",
}
