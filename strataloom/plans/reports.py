"""Registered reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import utc_day, uuid_of
from strataloom.functions.text import word_count, words_sql
from strataloom.operators import reports as R
from strataloom.sources.tables import records, table


def one(*columns: str) -> str:
    """SQL for the records of ``knowledge``, one row each."""
    return "(select lower(id) as id, " + ", ".join(f"first({c}) as {c}" for c in columns) + " from knowledge group by lower(id))"


def owner_activity(spark, d):
    return R.activity(table(spark, d, "query_log"), "owner", "created_at")


def owner_daily(spark, d):
    return R.daily(table(spark, d, "query_log"), "owner", "created_at")


def day_spine(spark, d):
    return R.daily_with_gaps(table(spark, d, "supersession_events"), "occurred_at")


def field_distributions(spark, d):
    return R.distributions(table(spark, d, "knowledge"), ["domain", "environment", "system", "status", "source"])


def domain_environment_counts(spark, d):
    return records(spark, d, "domain", "environment").groupBy("domain", "environment").agg(F.count(F.lit(1)).alias("n"))


def subject_inventory(spark, d):
    """Pairs of owner and source type of documents, where either is known, and the rows with neither."""
    t = table(spark, d, "documents")
    return t.groupBy("owner", "source_type").agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("created_at")).alias("first_s"), F.unix_seconds(F.max("created_at")).alias("last_s"))


def tag_frequency(spark, d):
    return R.tag_frequency(records(spark, d, "tags"))


def drift_accounting(spark, d):
    """Against the tag vocabulary and the domains that documents have, the personal one apart."""
    domains = table(spark, d, "documents").select("domain").filter("domain <> 'Personal'")
    return R.drift(records(spark, d, "tags", "domain"), table(spark, d, "tag_vocabulary"), domains)


def duplicate_keys(spark, d):
    current = records(spark, d, "status", "system", "component_key").filter("status = 'current' and component_key is not null")
    return R.duplicate_keys(current, "system", "component_key")


def capability_usage(spark, d):
    organic = ~F.col("valid_from").eqNullSafe(F.col("created_at")) & ~F.coalesce(F.col("source").startswith("legacy-migration"), F.lit(False))
    checks = {"organic_valid_from": organic, "component_key": F.col("component_key").isNotNull(), "supersedes": uuid_of("supersedes_id").isNotNull(), "tags": F.size("tags") > 0}
    return R.usage(records(spark, d, "valid_from", "created_at", "source", "component_key", "supersedes_id", "tags"), checks)


def word_count_spread(spark, d):
    return R.size_spread(records(spark, d, "content").select(word_count("content").alias("wc")), "wc")


def section_fan_out(spark, d):
    return R.fan_out(records(spark, d, "document_id").withColumn("document_id", uuid_of("document_id")), "document_id")


def latest_per_owner(spark, d):
    t = table(spark, d, "query_log").select("owner", "id", "created_at", "query_text").distinct()
    return R.latest(t, "owner", ["created_at", "id"], ["id", "query_text"]).drop("place")


def top3_per_owner(spark, d):
    t = table(spark, d, "query_log").select("owner", "id", "created_at", "query_text").distinct()
    return R.latest(t, "owner", ["created_at", "id"], ["id"], 3)


def latest_per_domain(spark, d):
    t = table(spark, d, "documents").select("domain", "doc_id", "created_at", F.substring("text", 1, 300).alias("preview"))
    return R.latest(t, "domain", ["created_at", "doc_id"], ["doc_id", "preview"]).drop("place")


def day_report(spark, d):
    """Per day and mode: queries, flagged ones, owners."""
    t = table(spark, d, "query_log").dropDuplicates(["id"]).filter("created_at is not null")
    return t.groupBy(utc_day(F.col("created_at")).cast("string").alias("day"), F.coalesce("mode", F.lit(R.NONE)).alias("mode")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("n_flagged"), F.countDistinct("owner").alias("n_owners")
    )


def status_pivot(spark, d):
    """Per domain how many records have each status."""
    counts = records(spark, d, "domain", "status")
    status = F.lower(F.trim("status"))
    columns = [F.count_if(status == s).alias(f"n_{s}") for s in ("current", "draft", "historical", "superseded")]
    return counts.groupBy("domain").agg(*columns)


def hourly_revenue(spark, d):
    """Events per type and hour with sum and mean, the tumbling window of the event stream."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        owner_activity, owner_daily, day_spine, field_distributions, domain_environment_counts, subject_inventory, tag_frequency, drift_accounting, duplicate_keys,
        capability_usage, word_count_spread, section_fan_out, latest_per_owner, top3_per_owner, latest_per_domain, day_report, status_pivot, hourly_revenue,
    )
}

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_REF = rf"nullif(regexp_extract(lower({{0}}), '^\s*\{{{{?(?:urn:uuid:)?({_UUID.replace('{', '{{').replace('}', '}}')})\}}}}?\s*$', 1), '')"


def ref(e: str) -> str:
    return _REF.format(e)


def _counts(field: str) -> str:
    return f"select '{field}' as field, coalesce({field}, '<null>') as value, count(*) as n from knowledge group by 2"


ORACLES = {
    "owner_activity": "select owner, count(*) as n, epoch_us(min(created_at)) // 1000000 as first_s, epoch_us(max(created_at)) // 1000000 as last_s from (select coalesce(owner, '<null>') as owner, created_at from query_log) group by rollup (owner)",
    "owner_daily": "select coalesce(owner, '<null>') as owner, strftime(created_at at time zone 'UTC', '%Y-%m-%d') as day, count(*) as n from query_log where created_at is not null group by 1, 2",
    "day_spine": """with days as (select (occurred_at at time zone 'UTC')::date as d, count(*) as n from supersession_events where occurred_at is not null group by 1),
        spine as (select unnest(generate_series((select min(d) from days), (select max(d) from days), interval 1 day))::date as d)
        select strftime(s.d, '%Y-%m-%d') as day, coalesce(n, 0) as n from spine s left join days using (d)""",
    "field_distributions": " union all ".join(map(_counts, ("domain", "environment", "system", "status", "source"))),
    "domain_environment_counts": f"select domain, environment, count(*) as n from {one('domain', 'environment')} group by 1, 2",
    "subject_inventory": "select owner, source_type, count(*) as n, epoch_us(min(created_at)) // 1000000 as first_s, epoch_us(max(created_at)) // 1000000 as last_s from documents group by 1, 2",
    "tag_frequency": f"select tag, count(*) as n, min(id) as sample_id from (select id, unnest(tags) as tag from {one('tags')}) group by tag",
    "drift_accounting": rf"""with k as {one('tags', 'domain')},
        b as (select distinct id from (select id, unnest(tags) as t from k) where t is not null and not regexp_matches(lower(trim(t)), '^(shape|component):') and t not in (select tag from tag_vocabulary)),
        x as (select id, id in (select id from b) as bad_tag, coalesce(domain not in (select domain from documents where domain <> 'Personal'), false) as bad_domain from k)
        select count(*) as n, count(*) filter (where bad_tag) as n_bad_tag, count(*) filter (where bad_domain) as n_bad_domain, count(*) filter (where bad_tag or bad_domain) as n_drifted, count(*) filter (where not (bad_tag or bad_domain)) as n_clean,
          case when count(*) = 0 then 'INCOMPLETE' when count(*) filter (where bad_tag or bad_domain) = 0 then 'CLEAN' else 'DRIFT' end as verdict from x""",
    "duplicate_keys": f"select system, component_key, count(*) as n from {one('status', 'system', 'component_key')} where status = 'current' and component_key is not null group by 1, 2 having count(*) > 1",
    "capability_usage": f"""with k as {one('valid_from', 'created_at', 'source', 'component_key', 'supersedes_id', 'tags')},
        x as (select 'organic_valid_from' as capability, avg((valid_from is distinct from created_at and not coalesce(starts_with(source, 'legacy-migration'), false))::int) as share from k
          union all select 'component_key', avg((component_key is not null)::int) from k union all select 'supersedes', avg(({ref('supersedes_id')} is not null)::int) from k
          union all select 'tags', avg(coalesce(len(tags) > 0, false)::int) from k)
        select *, case when share < 0.03 then 'fail' when share < 0.2 then 'warn' else 'ok' end as verdict from x""",
    "word_count_spread": f"""with w as (select coalesce(len({words_sql('content')}), 0) as v from {one('content')}), o as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from w)
        select count(*) as n, min(v) as least, median(v) as median, max(case when i = floor(n * 0.9) then v end) as p90, max(v) as greatest, count(*) filter (where v < 30) as n_small from o""",
    "section_fan_out": f"""with k as (select {ref('document_id')} as p, count(*) as k from {one('document_id')} where {ref('document_id')} is not null group by 1)
        select case when k = 1 then '1' when k <= 3 then '2-3' when k <= 6 then '4-6' else '7+' end as bucket, count(*) as n_parents, avg(k) as mean_sections, max(k) as most_sections from k group by 1""",
    "latest_per_owner": "select owner, id, query_text from query_log qualify row_number() over (partition by owner order by created_at desc nulls last, id desc) = 1",
    "top3_per_owner": "select owner, id, row_number() over (partition by owner order by created_at desc nulls last, id desc) as place from (select distinct owner, id, created_at, query_text from query_log) qualify place <= 3",
    "latest_per_domain": "select domain, doc_id, left(text, 300) as preview from documents qualify row_number() over (partition by domain order by created_at desc nulls last, doc_id desc) = 1",
    "day_report": """select strftime(created_at at time zone 'UTC', '%Y-%m-%d') as day, coalesce(mode, '<null>') as mode, count(*) as n, count(*) filter (where coalesce(flagged, false)) as n_flagged, count(distinct owner) as n_owners
        from (select distinct * from query_log) where created_at is not null group by 1, 2""",
    "status_pivot": "select domain, " + ", ".join(f"count(*) filter (where coalesce(lower(trim(status)) = '{s}', false)) as n_{s}" for s in ("current", "draft", "historical", "superseded")) + f" from {one('domain', 'status')} group by domain",
    "hourly_revenue": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
