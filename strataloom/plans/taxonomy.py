"""Registered queries on tags and vocabularies, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.tags import component_of, shape_of, tag_key_sql
from strataloom.operators import taxonomy as T
from strataloom.plans.reports import one
from strataloom.sources.tables import records, table

#: Aliases used by the registered queries: variant key, canonical tag; null drops the tag.
ALIASES = [("ingres", "Ingress"), ("backu", "Backup"), ("brionda", None)]


def _aliases(spark):
    return spark.createDataFrame(ALIASES, "alias_key string, target string")


def tag_normalize(spark, d):
    n = T.normalize_tags(records(spark, d, "tags"), table(spark, d, "tag_vocabulary"), _aliases(spark))
    return n.select("id", F.array_join("canonical_tags", "|").alias("canonical_tags"), F.array_join("unknown_tags", "|").alias("unknown_tags"))


def tag_classes(spark, d):
    return T.classify_tags(records(spark, d, "tags"), table(spark, d, "tag_vocabulary"))


def vocab_violations(spark, d):
    return T.violations(records(spark, d, "tags"), table(spark, d, "tag_vocabulary"))


def system_violations(spark, d):
    """Records whose system is no vocabulary word."""
    k = records(spark, d, "system").filter("system is not null")
    return k.join(table(spark, d, "system_vocabulary").select("system").distinct(), "system", "left_anti").select("id", "system")


def edit_distance1(spark, d):
    tags = records(spark, d, "tags").select(F.explode("tags").alias("tag")).filter(~F.col("tag").contains(":"))
    return T.near_misses(tags, table(spark, d, "tag_vocabulary"))


def symmetric_vocab_diff(spark, d):
    used = records(spark, d, "tags").select(F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull() & ~F.col("tag").contains(":"))
    return T.both_ways(used, table(spark, d, "tag_vocabulary"), "tag")


def retag_plan(spark, d):
    """Records whose tags change when folded, with old and new."""
    k = records(spark, d, "tags")
    n = k.join(T.normalize_tags(k, table(spark, d, "tag_vocabulary")), "id")
    return n.filter(~F.coalesce("tags", F.array().cast("array<string>")).eqNullSafe(F.col("canonical_tags"))).select("id", F.array_join("tags", "|").alias("old"), F.array_join("canonical_tags", "|").alias("new"))


def proposals(k, vocabulary):
    """Unknown tags by key: ``key, n, spelling, sample_id, last_s`` of records (``id, tags, created_at``)."""
    u = T.normalize_tags(k, vocabulary).select("id", F.explode("unknown_tags").alias("tag")).withColumn("key", F.translate(F.lower(F.trim("tag")), " _", "--"))
    u = u.join(k.select("id", F.unix_seconds("created_at").alias("s")), "id")
    return u.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("spelling"), F.min("id").alias("sample_id"), F.max("s").alias("last_s"))


def tag_proposals(spark, d):
    """Unknown tags by key: how often, which spelling first, from which record first."""
    return proposals(records(spark, d, "tags", "created_at"), table(spark, d, "tag_vocabulary")).drop("last_s")


def component_keys(spark, d):
    """Component named by the tags against the stored component key."""
    k = records(spark, d, "tags", "component_key").select("id", "component_key", component_of(F.col("tags")).alias("tagged"))
    return k.filter(F.col("component_key").isNotNull() | F.col("tagged").isNotNull()).withColumn("agree", F.col("component_key").eqNullSafe(F.col("tagged")))


def tag_rewrites(spark, d):
    """One tag renamed and two wanted tags put first, namespaced tags kept."""
    wanted = F.array(F.lit("Session"), F.lit("shape:note"))
    k = records(spark, d, "tags").filter("tags is not null")
    return k.select("id", F.array_join(T.rewrite_tag(F.col("tags"), "Switch", "Router"), "|").alias("renamed"), F.array_join(T.enrich(F.col("tags"), wanted), "|").alias("enriched"))


def derived_shapes(spark, d):
    return table(spark, d, "documents").groupBy("source_type", shape_of(F.col("source_type")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def source_rules(spark, d):
    """First matching prefix rule of each document's source."""
    rules = spark.createDataFrame([("share-0", "share, low", 1), ("share-", "share", 2), ("vault-nightly", "vault, night", 3), ("vault", "vault", 4), ("chat", "chat", 5)], "prefix string, target string, priority int")
    r = T.first_rule(table(spark, d, "documents").select("doc_id", "source"), rules, "doc_id", "source")
    return r.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))


def array_predicates(spark, d):
    """Contains, overlaps, has a component: counts over the records."""
    t = F.col("tags")
    k = records(spark, d, "tags", "domain")
    no = F.lit(False)
    return k.groupBy("domain").agg(
        F.count_if(F.coalesce(F.array_contains(t, "Switch"), no)).alias("n_contains"), F.count_if(F.coalesce(F.arrays_overlap(t, F.array(F.lit("DNS"), F.lit("VLAN"))), no)).alias("n_overlaps"),
        F.count_if(F.coalesce(F.exists(t, lambda x: x.startswith("component:")), no)).alias("n_component"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        tag_normalize, tag_classes, vocab_violations, system_violations, edit_distance1, symmetric_vocab_diff, retag_plan, tag_proposals, component_keys, tag_rewrites, derived_shapes, source_rules, array_predicates,
    )
}

_NS = "regexp_matches(lower(trim({0})), '^(shape|component):')"
_VOCAB = f"v as (select {tag_key_sql('tag')} as key, min(tag) as canonical from tag_vocabulary group by 1)"
_ALIAS_ROWS = ", ".join(f"('{k}', {'null' if v is None else repr(v)})" for k, v in ALIASES)
_SHAPES = "case lower(trim(source_type)) when 'obsidian' then 'document' when 'pdf' then 'document' when 'docx' then 'document' when 'url' then 'document' when 'project_docs' then 'document' else 'note' end"


def _normalized(alias_rows: str) -> str:
    return f"""
k as {one('tags')}, {_VOCAB}, al(alias_key, target) as (values {alias_rows}),
t as (select id, trim(tag) as tag, n, {tag_key_sql('tag')} as key from (select id, unnest(tags) as tag, generate_subscripts(tags, 1) as n from k)),
j as (select t.id, t.n, t.tag, alias_key is not null and target is null as dropped, case when {_NS.format('t.tag')} then t.tag when alias_key is not null then target else canonical end as kept
  from t left join v using (key) left join al on al.alias_key = t.key where t.tag <> ''),
c as (select id, kept as tag, min(n) as n from j where kept is not null group by 1, 2),
u as (select id, tag, min(n) as n from j where kept is null and not dropped group by 1, 2)"""


_NO_ALIAS = "(null::varchar, null::varchar)"
ORACLES = {
    "tag_normalize": f"""with {_normalized(_ALIAS_ROWS)}
        select k.id, coalesce((select string_agg(tag, '|' order by n) from c where c.id = k.id), '') as canonical_tags, coalesce((select string_agg(tag, '|' order by n) from u where u.id = k.id), '') as unknown_tags from k""",
    "tag_classes": f"""with {_VOCAB}, t as (select tag, count(*) as n from (select unnest(tags) as tag from {one('tags')}) group by 1)
        select tag, n, case when tag is null or trim(tag) = '' then 'empty' when {_NS.format('tag')} then 'namespaced' when canonical = tag then 'canonical' when canonical is not null then 'variant' else 'unknown' end as kind, canonical
        from t left join v on v.key = {tag_key_sql('t.tag')}""",
    "vocab_violations": f"select distinct id, tag from (select id, unnest(tags) as tag from {one('tags')}) where tag is not null and not {_NS.format('tag')} and tag not in (select tag from tag_vocabulary)",
    "system_violations": f"select id, system from {one('system')} where system is not null and system not in (select system from system_vocabulary)",
    "edit_distance1": f"""with {_VOCAB}, t as (select distinct tag, {tag_key_sql('tag')} as k from (select unnest(tags) as tag from {one('tags')}) where not contains(tag, ':'))
        select distinct tag, canonical from t, v where k <> '' and levenshtein(k, v.key) = 1""",
    "symmetric_vocab_diff": f"""with t as (select distinct tag from (select unnest(tags) as tag from {one('tags')}) where not contains(tag, ':'))
        select tag, 'first' as side from t where tag not in (select tag from tag_vocabulary) union all select distinct tag, 'second' from tag_vocabulary where tag not in (select tag from t)""",
    "retag_plan": f"""with {_normalized(_NO_ALIAS)}, n as (select k.id, k.tags, coalesce((select list(tag order by n) from c where c.id = k.id), []) as new from k)
        select id, array_to_string(tags, '|') as old, array_to_string(new, '|') as new from n where coalesce(tags, []) <> new""",
    "tag_proposals": f"with {_normalized(_NO_ALIAS)} select {tag_key_sql('tag')} as key, count(*) as n, min(tag) as spelling, min(id) as sample_id from u group by 1",
    "component_keys": f"""with k as (select id, component_key, substring(list_filter(tags, lambda t: starts_with(t, 'component:'))[1], 11) as tagged from {one('tags', 'component_key')})
        select *, component_key is not distinct from tagged as agree from k where component_key is not null or tagged is not null""",
    "tag_rewrites": f"""select id, array_to_string(list_transform(tags, lambda t: case when t = 'Switch' then 'Router' else t end), '|') as renamed,
        concat_ws('|', 'Session', 'shape:note', nullif(array_to_string(list_transform(list_filter(list_distinct_ordered, lambda t: t <> 'shape:note'), lambda t: t), '|'), '')) as enriched
        from (select id, tags, list_filter(list_transform(generate_series(1, len(tags)), lambda i: case when contains(tags[i], ':') and list_position(tags, tags[i]) = i then tags[i] end), lambda t: t is not null) as list_distinct_ordered
          from {one('tags')} where tags is not null)""",
    "derived_shapes": f"select source_type, {_SHAPES} as shape, count(*) as n from documents group by 1, 2",
    "source_rules": """select case when starts_with(source, 'share-0') then 'share, low' when starts_with(source, 'share-') then 'share' when starts_with(source, 'vault-nightly') then 'vault, night' when starts_with(source, 'vault') then 'vault'
        when starts_with(source, 'chat') then 'chat' end as target, count(*) as n, count(distinct source) as n_sources from documents group by 1""",
    "array_predicates": f"""select domain, count(*) filter (where coalesce(list_contains(tags, 'Switch'), false)) as n_contains, count(*) filter (where coalesce(list_has_any(tags, ['DNS', 'VLAN']), false)) as n_overlaps,
        count(*) filter (where coalesce(list_count(list_filter(tags, lambda t: starts_with(t, 'component:'))) > 0, false)) as n_component from {one('tags', 'domain')} group by domain""",
}
