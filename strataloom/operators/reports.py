"""Activity, distribution and drift reports: grouped aggregates, all combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.ids import utc_day
from strataloom.functions.tags import namespaced

NONE = "<null>"


def activity(rows: DataFrame, by: str, at: str) -> DataFrame:
    """Rows per ``by`` with first and last time, and the grand total (``by`` null) in one pass."""
    rows = rows.select(F.coalesce(F.col(by), F.lit(NONE)).alias(by), F.col(at).alias("_at"))
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("_at")).alias("first_s"), F.unix_seconds(F.max("_at")).alias("last_s"))


def daily(rows: DataFrame, by: str, at: str) -> DataFrame:
    """Rows per ``by`` and UTC day; rows without a time are left out."""
    rows = rows.filter(F.col(at).isNotNull()).select(F.coalesce(F.col(by), F.lit(NONE)).alias(by), utc_day(F.col(at)).cast("string").alias("day"))
    return rows.groupBy(by, "day").agg(F.count(F.lit(1)).alias("n"))


def daily_with_gaps(rows: DataFrame, at: str) -> DataFrame:
    """Rows per UTC day from the first day to the last; a day without rows is a row of 0."""
    days = rows.filter(F.col(at).isNotNull()).groupBy(utc_day(F.col(at)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    spine = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("d"))
    return spine.join(days, "d", "left").select(F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of each column occurs, null as ``<null>``: one pass, one row per column and value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def tag_frequency(rows: DataFrame, tags: str = "tags", sample: str = "id") -> DataFrame:
    """Occurrences of each tag as written, with the smallest id that has it."""
    one = rows.select(F.col(sample).alias("_s"), F.explode(tags).alias("tag"))
    return one.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("sample_id"))


def drift(rows: DataFrame, vocabulary: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: records, those with an unknown tag, with a domain that ``domains`` lacks, with either, and a verdict.

    An unknown tag has no namespace and is no vocabulary word, compared as written.
    """
    tags = rows.select("id", F.explode_outer("tags").alias("tag"))
    known = vocabulary.select(F.col("tag"), F.lit(True).alias("known")).distinct()
    unknown = F.col("tag").isNotNull() & ~namespaced(F.col("tag")) & F.col("known").isNull()
    bad = tags.join(known, "tag", "left").groupBy("id").agg(F.max(unknown).alias("bad_tag"))
    listed = domains.select("domain").distinct().withColumn("listed", F.lit(True))
    stray = F.col("domain").isNotNull() & F.col("listed").isNull()
    out_of_list = rows.join(listed, "domain", "left").groupBy("id").agg(F.max(stray).alias("bad_domain"))
    both = bad.join(out_of_list, "id")
    either = F.col("bad_tag") | F.col("bad_domain")
    total = both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad_tag").alias("n_bad_tag"), F.count_if("bad_domain").alias("n_bad_domain"), F.count_if(either).alias("n_drifted"),
    )
    return total.withColumn("n_clean", F.col("n") - F.col("n_drifted")).withColumn("verdict", F.when(F.col("n") == 0, "INCOMPLETE").when(F.col("n_drifted") == 0, "CLEAN").otherwise("DRIFT"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Key combinations that more than one row has; nulls are equal to each other."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def usage(rows: DataFrame, checks: dict[str, Column], fail: float = 0.03, warn: float = 0.2) -> DataFrame:
    """Share of rows for which each check holds, and a verdict by thresholds."""
    shares = rows.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in checks.items()])
    listed = F.array(*[F.struct(F.lit(name).alias("capability"), F.col(name).alias("share")) for name in checks])
    one = shares.select(F.explode(listed).alias("x")).select("x.*")
    return one.withColumn("verdict", F.when(F.col("share") < fail, "fail").when(F.col("share") < warn, "warn").otherwise("ok"))


def size_spread(sizes: DataFrame, size: str, small: int = 30) -> DataFrame:
    """One row: count, least, median, the value at place floor(0.9 n) in order, greatest, how many are below ``small``.

    The value at a place is read off the cumulated histogram: one row per distinct size, not a sort of all rows.
    """
    counts = sizes.filter(F.col(size).isNotNull()).groupBy(F.col(size).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cumulated = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    half = lambda: (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2.0
    return cumulated.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("v").alias("least"), half().alias("median"), at(F.floor(F.col("all") * 0.9)).alias("p90"), F.max("v").alias("greatest"),
        F.coalesce(F.sum(F.when(F.col("v") < small, F.col("c"))), F.lit(0)).alias("n_small"),
    )


def fan_out(sections: DataFrame, parent: str) -> DataFrame:
    """How many parents have 1, 2-3, 4-6, 7 or more sections, with the mean and greatest number per bucket."""
    n = sections.filter(F.col(parent).isNotNull()).groupBy(parent).agg(F.count(F.lit(1)).alias("k"))
    bucket = F.when(F.col("k") == 1, "1").when(F.col("k") <= 3, "2-3").when(F.col("k") <= 6, "4-6").otherwise("7+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_parents"), F.avg("k").alias("mean_sections"), F.max("k").alias("most_sections"))


def fan_out_totals(documents: DataFrame, sections: DataFrame, parent: str) -> DataFrame:
    """One row: documents, their pieces, and mean, median, greatest number and share of more than one piece a document.

    ``documents`` has ``id``; a document without sections is one piece. The median is exact: counts of pieces are few different numbers.
    """
    k = sections.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("id")).agg(F.count(F.lit(1)).alias("k"))
    n = documents.select("id").join(k, "id", "left").select(F.coalesce("k", F.lit(1)).alias("k"))
    return n.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("k").alias("n_pieces"), F.avg("k").alias("mean_pieces"), F.median("k").alias("median_pieces"), F.max("k").alias("most_pieces"), F.avg((F.col("k") > 1).cast("int")).alias("multi_share"))


def latest(rows: DataFrame, by: str, order: list[str], keep: list[str], n: int = 1) -> DataFrame:
    """The ``n`` latest rows per ``by`` (the group limit is applied before the shuffle as well)."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(by, "place", *keep)


