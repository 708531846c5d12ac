"""Registered queries on record history and references, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.ids import uuid_sql
from strataloom.operators import history, references
from strataloom.sources.tables import table


def p4_found(spark, d):
    v = history.versions(table(spark, d, "knowledge_snapshots"))
    return v.select("knowledge_id", "status", F.unix_seconds("held_from").alias("start_s"), F.coalesce(F.unix_seconds("held_to"), F.lit(0)).alias("end_s"))


def p4_satellite_periods(spark, d):
    """Both satellites as views: the period of each row that they took."""
    filled = history.filled(table(spark, d, "knowledge_snapshots"))
    views = [
        filled.view(name).select(F.lit(name).alias("satellite"), "knowledge_id", F.unix_seconds("snapshot_at").alias("start_s"), F.unix_seconds("valid_to").alias("end_s"))
        for name in history.SATELLITES
    ]
    return views[0].unionByName(views[1])


def p5_found(spark, d):
    f = references.broken_references(table(spark, d, "knowledge"), table(spark, d, "retirement_requests"))
    return f.select("table_name", "field_name", "row_id", "kind", "period")


def p5_report(spark, d):
    return references.broken_reference_report(table(spark, d, "knowledge"), table(spark, d, "retirement_requests"))


_STATES = f"""
states as (
  select knowledge_id, snapshot_at, status, valid_from, valid_until, supersedes_id from (
    select {uuid_sql('knowledge_id')} as knowledge_id, snapshot_at, recorded_at, snapshot_id, lower(trim(status)) as status, valid_from,
      case when year(valid_until at time zone 'UTC') >= 9999 then null else valid_until end as valid_until, {uuid_sql('supersedes_id')} as supersedes_id
    from knowledge_snapshots where status is not null and snapshot_at is not null)
  where knowledge_id is not null
  qualify row_number() over (partition by knowledge_id, snapshot_at order by recorded_at desc nulls last, snapshot_id desc) = 1)
"""

_P4 = f"""
with {_STATES},
marked as (
  select *, lag(true) over w is null or status is distinct from lag(status) over w or valid_from is distinct from lag(valid_from) over w
    or valid_until is distinct from lag(valid_until) over w or supersedes_id is distinct from lag(supersedes_id) over w as changed
  from states window w as (partition by knowledge_id order by snapshot_at))
select knowledge_id, status, epoch_us(snapshot_at) // 1000000 as start_s,
  coalesce(epoch_us(lead(snapshot_at) over (partition by knowledge_id order by snapshot_at)) // 1000000, 0) as end_s
from marked where changed
"""

_P4_SAT = f"""
with {_STATES},
marked as (
  select *, lag(true) over w is null or status is distinct from lag(status) over w or valid_until is distinct from lag(valid_until) over w as c1,
    lag(true) over w is null or valid_from is distinct from lag(valid_from) over w or supersedes_id is distinct from lag(supersedes_id) over w as c2
  from states window w as (partition by knowledge_id order by snapshot_at)),
inserts as (select 'status' as satellite, knowledge_id, snapshot_at from marked where c1 union all select 'lineage', knowledge_id, snapshot_at from marked where c2)
select satellite, knowledge_id, epoch_us(snapshot_at) // 1000000 as start_s,
  epoch_us(lead(snapshot_at) over (partition by satellite, knowledge_id order by snapshot_at)) // 1000000 as end_s from inserts
"""

_P5 = f"""
with refs as (
  select distinct 'knowledge' as table_name, 'supersedes_id' as field_name, {uuid_sql('id')} as row_id, {uuid_sql('supersedes_id')} as ref, created_at as own_time from knowledge
  union select distinct 'knowledge', 'document_id', {uuid_sql('id')}, {uuid_sql('document_id')}, created_at from knowledge
  union select distinct 'retirement_requests', 'target_id', {uuid_sql('id')}, {uuid_sql('target_id')}, requested_at from retirement_requests),
records as (select {uuid_sql('id')} as id, min(created_at) as came_at from knowledge group by 1),
removed as (select distinct {uuid_sql('target_id')} as id from retirement_requests where method = 'delete' and status = 'executed'),
found as (
  select r.*, case when k.id is null and d.id is not null then 'deleted' when k.id is null then 'missing' when k.came_at > r.own_time then 'late' end as kind,
    strftime(own_time at time zone 'UTC', '%Y-%m') as period
  from refs r left join records k on k.id = r.ref left join removed d on d.id = r.ref where r.ref is not null)
"""

QUERIES = {"p4_found": p4_found, "p4_satellite_periods": p4_satellite_periods, "p5_found": p5_found, "p5_report": p5_report}
ORACLES = {
    "p4_found": _P4,
    "p4_satellite_periods": _P4_SAT,
    "p5_found": _P5 + "select table_name, field_name, row_id, kind, period from found where kind is not null",
    "p5_report": _P5 + "select table_name, field_name, period, kind, count(*) as n_refs, count(distinct ref) as n_targets from found where kind is not null group by all",
}
