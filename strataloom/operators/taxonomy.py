"""Controlled vocabularies: folding, classification, violations, fuzzy matches, first-match rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.tags import namespaced, tag_key


def folded(vocabulary: DataFrame, word: str) -> DataFrame:
    """``key, canonical``: one canonical spelling (the smallest) per key of the vocabulary."""
    return vocabulary.filter(F.col(word).isNotNull()).groupBy(tag_key(F.col(word)).alias("key")).agg(F.min(word).alias("canonical"))


def normalize_tags(rows: DataFrame, vocabulary: DataFrame, aliases: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``<key>, canonical_tags, unknown_tags`` of ``<key>, tags``: order kept, repeats folded.

    Namespaced tags pass as they are (trimmed). An alias (``alias_key, target``) comes before the vocabulary; a null target
    drops the tag. Blank tags are dropped, tags that match nothing are unknown. Null tags give empty lists.
    The vocabularies are joined, so Spark broadcasts them only while they are small.
    """
    tags = rows.select(key, F.posexplode_outer("tags").alias("at", "tag")).withColumn("tag", F.trim("tag")).withColumn("key", tag_key(F.col("tag")))
    tags = tags.join(folded(vocabulary, vocabulary.columns[0]), "key", "left")
    if aliases is not None:
        tags = tags.join(aliases.select(F.col("alias_key").alias("key"), "target", F.lit(True).alias("aliased")), "key", "left")
        canonical = F.when(F.col("aliased"), F.col("target")).otherwise(F.col("canonical"))
        dropped = F.coalesce(F.col("aliased") & F.col("target").isNull(), F.lit(False))
    else:
        canonical, dropped = F.col("canonical"), F.lit(False)
    present = F.col("tag").isNotNull() & (F.col("tag") != "")
    kept = F.when(present, F.when(namespaced(F.col("tag")), F.col("tag")).otherwise(canonical))
    unknown = F.when(present & kept.isNull() & ~dropped, F.col("tag"))
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("at", c.alias("t"))))), lambda x: x["t"]))
    return tags.groupBy(key).agg(in_order(kept).alias("canonical_tags"), in_order(unknown).alias("unknown_tags"))


def classify_tags(rows: DataFrame, vocabulary: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Each distinct tag with its class: ``empty``, ``namespaced``, ``canonical`` (as written), ``variant`` or ``unknown``.

    With ``aliases`` (``alias_key, target``) also ``aliased`` and, for a null target, ``dropped``; these come before the vocabulary.
    """
    tags = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    joined = tags.withColumn("key", tag_key(F.col("tag"))).join(folded(vocabulary, vocabulary.columns[0]), "key", "left")
    kind = (
        F.when(F.col("tag").isNull() | (F.trim("tag") == ""), "empty").when(namespaced(F.col("tag")), "namespaced").when(F.col("canonical") == F.col("tag"), "canonical")
        .when(F.col("canonical").isNotNull(), "variant").otherwise("unknown")
    )
    classes = joined.select("tag", "n", kind.alias("kind"), "canonical", "key")
    if aliases is None:
        return classes.drop("key")
    known = aliases.select(F.col("alias_key").alias("key"), "target", F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit") & ~F.col("kind").isin("empty", "namespaced"), F.lit(False))
    kind = F.when(hit & F.col("target").isNull(), "dropped").when(hit, "aliased").otherwise(F.col("kind"))
    return classes.join(known, "key", "left").select("tag", "n", kind.alias("kind"), F.when(hit, F.col("target")).otherwise(F.col("canonical")).alias("canonical"))


def cross_tagged(tags: Column, text: Column, markers: list[str], tag: str) -> Column:
    """``tags`` and, where ``text`` contains one of the markers (without regard to case), ``tag`` after them."""
    marked = F.coalesce(F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(F.lower(text), m)), F.lit(False))
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(marked, F.array_union(tags, F.array(F.lit(tag)))).otherwise(tags)


def violations(rows: DataFrame, vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """``<key>, tag`` of tags outside the vocabulary, as written: an anti join on exploded arrays."""
    tags = rows.select(key, F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull() & ~namespaced(F.col("tag")))
    return tags.join(vocabulary.select("tag").distinct(), "tag", "left_anti").select(key, "tag").distinct()


def near_misses(words: DataFrame, vocabulary: DataFrame, word: str = "tag") -> DataFrame:
    """``<word>, canonical``: words one edit (insertion, deletion, substitution) away from a vocabulary word, compared by key.

    Two words within one edit share one of their strings with at most one character deleted, so both sides are
    joined on those deletion variants and then verified: no word meets the whole vocabulary.
    """

    def variants(c: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))))

    a = words.select(word).distinct().withColumn("k", tag_key(F.col(word))).filter("k <> ''")
    b = folded(vocabulary, vocabulary.columns[0]).withColumnRenamed("key", "vk")
    met = a.withColumn("v", F.explode(variants(F.col("k")))).join(b.withColumn("v", F.explode(variants(F.col("vk")))), "v")
    return met.filter(F.levenshtein("k", "vk", 1) == 1).select(word, "canonical").distinct()


def both_ways(a: DataFrame, b: DataFrame, word: str) -> DataFrame:
    """Words that only one of two vocabularies has: ``<word>, side``."""
    a, b = a.select(word).distinct(), b.select(word).distinct()
    return a.join(b, word, "left_anti").withColumn("side", F.lit("first")).unionByName(b.join(a, word, "left_anti").withColumn("side", F.lit("second")))


def first_rule(rows: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``target`` of the first rule (least ``priority``) whose ``prefix`` begins ``text``; null if none does.

    Prefixes are joined by equality per length: a text is cut to the lengths that rules have.
    """
    lengths = rules.select(F.length("prefix").alias("len")).distinct()
    sizes = lengths.agg(F.array_sort(F.collect_list("len")).alias("lens"))  # distinct lengths of rules
    cut = rows.select(key, text).crossJoin(F.broadcast(sizes)).select(key, F.explode(F.transform("lens", lambda n: F.substring(F.col(text), F.lit(1), n))).alias("prefix")).distinct()
    best = cut.join(rules, "prefix").groupBy(key).agg(F.min_by("target", "priority").alias("target"))
    return rows.join(best, key, "left")


def rewrite_tag(tags: Column, old: str, new: str) -> Column:
    """``old`` becomes ``new`` wherever it stands."""
    return F.transform(tags, lambda t: F.when(t == old, new).otherwise(t))


def enrich(tags: Column, wanted: Column) -> Column:
    """The wanted tags, then the namespaced ones there are that aren't among them."""
    return F.array_union(wanted, F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.contains(":")))
