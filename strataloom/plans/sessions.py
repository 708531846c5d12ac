"""Registered queries on the query log and on writes, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_of
from strataloom.operators import sessions as S
from strataloom.operators import writes as W
from strataloom.plans.reports import one
from strataloom.sources.tables import records, table

NOW = "2026-09-01 00:00:00"
#: Rules of the registered queries.
RULES = S.rules_from(
    r"""[{"name": "numbers", "pattern": "\\b([0-9]+)\\b", "threshold": 2, "kind": "items"}, {"name": "how_to", "pattern": "\\bhow do i\\b", "threshold": 2},
    {"name": "why", "pattern": "\\bwhy\\b", "threshold": 1}]"""
)


def _log(spark, d):
    return table(spark, d, "query_log").dropDuplicates(["id"])


def session_counts(spark, d):
    return S.session_summary(S.sessionize(_log(spark, d)))


def session_rules(spark, d):
    return S.apply_rules(S.sessionize(_log(spark, d)), RULES).select("owner", "session_start_s", "rule", "n", "items", "event_key")


def session_rule_evidence(spark, d):
    """The queries that each event of session_rules rests on."""
    return S.rule_evidence(S.sessionize(_log(spark, d)), RULES)


def event_sessions(spark, d):
    """Sessions of the event stream, per user."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("flagged", F.col("event_type") == "error")
    return S.session_summary(S.sessionize(e, "user_id", "ts", 6 * 3600), "user_id", "ts")


def tumbling_dedupe(spark, d):
    return S.collapse_replays(_log(spark, d), ["owner", "mode"], "created_at")


def trailing_hour_rate(spark, d):
    return S.trailing_count(_log(spark, d), "owner", "created_at").select("id", "owner", "n_trailing")


def lookback_scan(spark, d):
    return S.lookback(table(spark, d, "query_log"), "created_at", F.to_date(F.lit("2026-02-01"))).dropDuplicates(["id"]).select("id", F.unix_seconds("created_at").alias("at_s"))


def range_scan(spark, d):
    """One owner's queries of a quarter, in order."""
    at = F.col("created_at")
    a, b = (F.to_timestamp(F.lit(x)) for x in ("2026-01-01 00:00:00", "2026-04-01 00:00:00"))
    t = table(spark, d, "query_log").filter((F.col("owner") == "owner_0001") & (at >= a) & (at < b)).select("id", F.unix_seconds("created_at").alias("at_s"), "mode").distinct()
    return t.orderBy("at_s", "id")


def tenant_scan(spark, d):
    """Queries per tenant; no tenant means the default one."""
    return _log(spark, d).groupBy(F.coalesce("tenant_id", F.lit("family")).alias("tenant")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("result_count", F.lit(0))).alias("n_results"))


def ttl_filter(spark, d):
    events = table(spark, d, "supersession_events").dropDuplicates(["id"]).withColumn("expires_at", F.col("created_at") + F.expr("interval 30 days"))
    return W.unexpired(events, "expires_at", F.to_timestamp(F.lit("2026-02-01 00:00:00"))).select("id")


def retention(spark, d):
    return W.retained(_log(spark, d), "created_at", F.to_timestamp(F.lit("2026-05-01 00:00:00")), 60).select("id", "flagged")


def mark_reported(spark, d):
    """Queries flagged or longest in text are marked."""
    log = _log(spark, d).select("id", "owner", "flagged", "mode")
    marked = W.mark(log, log.filter("flagged"), "id", "mode", F.lit("reported"))
    return marked.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def _split(k):
    """The table as it was and what arrives: records by the half of their id, overlapping in a quarter."""
    first = F.substring("id", 1, 1)
    return k.filter(first < "c"), k.filter(first >= "8")


def upsert_coalesce(spark, d):
    k = records(spark, d, "domain", "source", "embedding")
    old, new = _split(k)
    new = new.withColumn("source", F.concat(F.coalesce("source", F.lit("?")), F.lit("+"))).withColumn("embedding", F.when(F.col("id") < "a", F.col("embedding")))
    u = W.upsert(old, new, "id")
    return u.select("id", "domain", "source", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), "change")


def insert_if_absent(spark, d):
    old, new = _split(records(spark, d, "domain", "source"))
    return W.insert_absent(old, new, ["id"]).select("id", "domain")


def counter_upsert(spark, d):
    def counts(t):
        one = t.filter("query_text is not null").select(F.lower(F.trim("query_text")).alias("key"), F.unix_seconds("created_at").alias("s"), F.col("query_text").alias("raw")).filter("key <> '' and s is not null")
        return one.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.max_by("raw", F.struct("s", "raw")).alias("raw"))

    log = _log(spark, d)
    early = F.unix_seconds("created_at") < F.unix_seconds(F.to_timestamp(F.lit("2026-03-01 00:00:00")))
    return W.count_seen(counts(log.filter(early)), counts(log.filter(~early)))


def rechunk(spark, d):
    """Sections of documents that come again replace all there are of them."""
    k = records(spark, d, "document_id", "chunk_index").withColumn("document_id", uuid_of("document_id")).filter("document_id is not null")
    again = k.filter(F.substring("document_id", 1, 1) >= "8").select("document_id", (F.col("chunk_index") + 100).alias("chunk_index"), "id").filter("chunk_index is not null")
    return W.replace_children(k.select("document_id", "chunk_index", "id"), again, "document_id")


def pages(k):
    """Per domain the five latest current records' first lines on one page, newest first."""
    k = k.filter("status = 'current' and content is not null and valid_from is not null")
    w = Window.partitionBy("domain").orderBy(F.desc("valid_from"), "id")
    top = k.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("domain", "r", F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 80).alias("line"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return top.groupBy("domain").agg(page.alias("page"), F.count(F.lit(1)).alias("n"))


def compiled_page(spark, d):
    return pages(records(spark, d, "domain", "status", "content", "valid_from"))


QUERIES = {
    f.__name__: f
    for f in (
        session_counts, session_rules, session_rule_evidence, event_sessions, tumbling_dedupe, trailing_hour_rate, lookback_scan, range_scan, tenant_scan, ttl_filter, retention, mark_reported, upsert_coalesce, insert_if_absent, counter_upsert, rechunk, compiled_page,
    )
}

_LOG = "lg as (select *, epoch_us(created_at) // 1000000 as s from (select distinct * from query_log))"


def _sessions(source: str, owner: str, gap: int) -> str:
    return f"""
a as (select *, case when lag(s) over (partition by {owner} order by s) is null or s - lag(s) over (partition by {owner} order by s) > {gap} then s end as st from {source} where {owner} is not null and s is not null),
ss as (select *, max(st) over (partition by {owner} order by s rows between unbounded preceding and current row) as session_start_s from a)"""


_RULED = f"""{_LOG}, {_sessions('lg', 'owner', 1800)},
        i as (select owner, session_start_s, unnest(regexp_extract_all(lower(query_text), '\\b([0-9]+)\\b', 1)) as item from ss),
        x as (select owner, session_start_s, 'numbers' as rule, count(distinct item) as n, array_to_string(list_slice(list_sort(list(distinct {{'l': length(item), 'item': item}})), 1, 12).list_transform(lambda z: z.item), ', ')
            || case when count(distinct item) > 12 then '\u2026' else '' end as items from i group by 1, 2 having count(distinct item) >= 2
          union all select owner, session_start_s, 'how_to', count(*), '' from ss where regexp_matches(lower(query_text), '\\bhow do i\\b') group by 1, 2 having count(*) >= 2
          union all select owner, session_start_s, 'why', count(*), '' from ss where regexp_matches(lower(query_text), '\\bwhy\\b') group by 1, 2)"""
_SUM = "select {0}, session_start_s, count(*) as n, max(s) as session_end_s, count(*) filter (where coalesce(flagged, false)) as n_flagged from ss group by 1, 2"
ORACLES = {
    "session_counts": f"with {_LOG}, {_sessions('lg', 'owner', 1800)} " + _SUM.format("owner"),
    "event_sessions": f"with lg as (select user_id, event_type = 'error' as flagged, epoch_us(ts) // 1000000 as s from events), {_sessions('lg', 'user_id', 21600)} " + _SUM.format("user_id"),
    "session_rules": f"with {_RULED} select *, sha256(concat_ws('|', owner, rule, session_start_s::varchar)) as event_key from x",
    "session_rule_evidence": f"""with {_RULED}, m as (select id, owner, session_start_s, 'numbers' as rule from ss where regexp_matches(lower(query_text), '\\b([0-9]+)\\b')
          union all select id, owner, session_start_s, 'how_to' from ss where regexp_matches(lower(query_text), '\\bhow do i\\b') union all select id, owner, session_start_s, 'why' from ss where regexp_matches(lower(query_text), '\\bwhy\\b'))
        select sha256(concat_ws('|', owner, rule, session_start_s::varchar)) as event_key, id from m semi join x using (owner, session_start_s, rule) where id is not null""",
    "tumbling_dedupe": f"with {_LOG} select owner, mode, s // 600 * 600 as bucket_s, count(*) as n, min(s) as first_s from lg where s is not null group by 1, 2, 3",
    "trailing_hour_rate": f"with {_LOG} select id, owner, count(*) over (partition by owner order by s range between 3599 preceding and current row) as n_trailing from lg where owner is not null and s is not null",
    "lookback_scan": f"with {_LOG} select id, s as at_s from lg where created_at >= timestamptz '2026-01-31 21:00:00+00' and created_at < timestamptz '2026-02-02 00:00:00+00'",
    "range_scan": f"with {_LOG} select id, s as at_s, mode from lg where owner = 'owner_0001' and created_at >= timestamptz '2026-01-01 00:00:00+00' and created_at < timestamptz '2026-04-01 00:00:00+00'",
    "tenant_scan": f"with {_LOG} select coalesce(tenant_id, 'family') as tenant, count(*) as n, sum(coalesce(result_count, 0))::bigint as n_results from lg group by 1",
    "ttl_filter": "select distinct id from supersession_events where created_at is null or created_at + interval 30 days > timestamptz '2026-02-01 00:00:00+00'",
    "retention": f"with {_LOG} select id, flagged from lg where coalesce(flagged, false) or created_at >= timestamptz '2026-05-01 00:00:00+00' - interval 60 days",
    "mark_reported": f"with {_LOG} select case when flagged then 'reported' else mode end as mode, count(*) as n from lg group by 1",
    "upsert_coalesce": f"""with k as {one('domain', 'source', 'embedding')}, o as (select * from k where left(id, 1) < 'c'), n as (select id, domain, coalesce(source, '?') || '+' as source, case when id < 'a' then embedding end as embedding from k where left(id, 1) >= '8')
        select coalesce(o.id, n.id) as id, case when n.id is not null then n.domain else o.domain end as domain, case when n.id is not null then n.source else o.source end as source,
          coalesce(len(coalesce(n.embedding, o.embedding)), -1) as dim, case when o.id is null then 'inserted' when n.id is not null then 'updated' else 'kept' end as change from o full join n on o.id = n.id""",
    "insert_if_absent": f"select id, domain from {one('domain', 'source')} where left(id, 1) >= 'c'",
    "counter_upsert": f"""with {_LOG}, x as (select lower(trim(query_text)) as key, s, query_text as raw from lg where query_text is not null and s is not null)
        select key, count(*) as n, min(s) as first_s, max(s) as last_s, arg_max(raw, {{'s': s, 'raw': raw}}) as raw from x where key <> '' group by key""",
    "rechunk": r"""with k as (select nullif(regexp_extract(lower(document_id), '^\s*\{?(?:urn:uuid:)?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\}?\s*$', 1), '') as document_id, chunk_index, id from """ + one("document_id", "chunk_index") + r""")
        select document_id, chunk_index, id from k x where document_id is not null and (left(document_id, 1) < '8' or not exists (select 1 from k y where y.document_id = x.document_id and y.chunk_index is not null))
        union all select document_id, chunk_index + 100, id from k where left(document_id, 1) >= '8' and chunk_index is not null""",
    "compiled_page": f"""with t as (select domain, row_number() over (partition by domain order by valid_from desc, id) as r, left(split_part(content, E'\\n', 1), 80) as line
          from {one('domain', 'status', 'content', 'valid_from')} where status = 'current' and content is not null and valid_from is not null qualify r <= 5)
        select domain, string_agg(line, E'\\n' order by r) as page, count(*) as n from t group by domain""",
}
