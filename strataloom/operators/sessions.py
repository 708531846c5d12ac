"""Sessions of a query log, rules over sessions, and time buckets.

One owner may hold a large share of the log. Gaps are found within buckets of an owner's day, and what passes
between buckets is one row per owner and day (see history for the same idea).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.skew import hot_key_join

GAP_SECONDS = 30 * 60


@dataclass(frozen=True)
class Rule:
    """``pattern`` with a group captures items, of which ``threshold`` distinct ones make a match (``kind`` items);
    without, ``threshold`` matching rows do (``kind`` rows)."""

    name: str
    pattern: str
    threshold: int
    kind: str = "rows"

    def __post_init__(self):
        whole = isinstance(self.threshold, int) and not isinstance(self.threshold, bool)
        if not (isinstance(self.name, str) and self.name and isinstance(self.pattern, str) and self.pattern) or self.kind not in ("items", "rows") or not whole or self.threshold < 1:
            raise ValueError(f"not a rule: {self}")
        try:
            groups = re.compile(self.pattern).groups
        except re.error as e:
            raise ValueError(f"not a pattern: {self}") from e
        if self.kind == "items" and not groups:
            raise ValueError(f"items need a group: {self}")


def sessionize(log: DataFrame, owner: str = "owner", at: str = "created_at", gap: int = GAP_SECONDS) -> DataFrame:
    """Adds ``session_start_s``: a row belongs to the session before it if it comes at most ``gap`` seconds later.

    Rows without owner or time are left out. Sessions are named by owner and start, so they are the same whatever is
    run again.
    """
    rows = log.filter(F.col(owner).isNotNull() & F.col(at).isNotNull()).withColumn("_s", F.unix_seconds(at)).withColumn("_day", F.floor(F.col("_s") / 86400))
    within = Window.partitionBy(owner, "_day").orderBy("_s")
    ends = rows.groupBy(owner, "_day").agg(F.max("_s").alias("_last"))
    before = ends.withColumn("_prior", F.lag("_last").over(Window.partitionBy(owner).orderBy("_day"))).drop("_last")
    rows = rows.withColumn("_lag", F.lag("_s").over(within)).join(before, [owner, "_day"])
    last = F.coalesce("_lag", "_prior")
    rows = rows.withColumn("_start", F.when(last.isNull() | (F.col("_s") - last > gap), F.col("_s")))
    # the latest start so far: within the day, else carried from the days before
    so_far = F.max("_start").over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    opened = rows.groupBy(owner, "_day").agg(F.max("_start").alias("_opened"))
    carried = opened.withColumn("_open", F.max("_opened").over(Window.partitionBy(owner).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).drop("_opened")
    rows = rows.withColumn("_now", so_far).join(carried, [owner, "_day"])
    return rows.withColumn("session_start_s", F.coalesce("_now", "_open")).drop("_s", "_day", "_lag", "_prior", "_start", "_now", "_open")


def session_summary(sessions: DataFrame, owner: str = "owner", at: str = "created_at") -> DataFrame:
    return sessions.groupBy(owner, "session_start_s").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_seconds(at)).alias("session_end_s"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("n_flagged"))


#: Fixed value: items that an event shows.
SHOWN_ITEMS = 12


def _matches(sessions: DataFrame, rules: list[Rule], owner: str, text: str) -> DataFrame:
    """Rows of ``sessions`` that a rule finds something in, a row per rule: with ``found`` and the session's ``event_key``."""
    parts = []
    for r in rules:
        pattern = f"(?i){r.pattern}"
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if r.kind == "items" else F.when(F.col(text).rlike(pattern), F.array(F.lit("")))
        parts.append(F.struct(F.lit(r.name).alias("rule"), F.coalesce(found, F.array().cast("array<string>")).alias("found"), F.lit(r.threshold).alias("threshold"), F.lit(r.kind == "items").alias("distinct")))
    one = sessions.withColumn("_r", F.explode(F.array(*parts))).filter(F.size("_r.found") > 0)
    key = F.sha2(F.concat_ws("|", F.col(owner), F.col("_r.rule"), F.col("session_start_s").cast("string")), 256)
    return one.withColumn("event_key", key)


def apply_rules(sessions: DataFrame, rules: list[Rule], owner: str = "owner", text: str = "query_text") -> DataFrame:
    """``owner, session_start_s, rule, n, items, event_key``: sessions that reach a rule's threshold, without regard to case.

    ``items`` are the distinct captures, short ones first, then by text, the first twelve, with an ellipsis where there
    are more; the event key is a hash of owner, rule and session start, so running again gives the same event.
    """
    one = _matches(sessions, rules, owner, text).select(owner, "session_start_s", "event_key", "_r.rule", "_r.threshold", "_r.distinct", F.explode("_r.found").alias("item"))
    event = [owner, "session_start_s", "event_key", "rule", "threshold", "distinct"]
    counted = one.groupBy(*event, "item").agg(F.count(F.lit(1)).alias("c"))
    first = Window.partitionBy(*event).orderBy(F.length("item"), "item")
    shown = F.when(F.col("at") <= SHOWN_ITEMS, F.struct("at", "item"))  # no more are ever collected
    per = counted.withColumn("at", F.row_number().over(first)).groupBy(*event).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.array_sort(F.collect_list(shown)).alias("shown"))
    hits = per.withColumn("n", F.when(F.col("distinct"), F.col("k")).otherwise(F.col("c"))).filter(F.col("n") >= F.col("threshold"))
    items = F.concat(F.array_join(F.transform("shown", lambda x: x["item"]), ", "), F.when(F.col("k") > SHOWN_ITEMS, "\u2026").otherwise(""))
    return hits.select(owner, "session_start_s", "rule", "n", items.alias("items"), "event_key")


def rule_evidence(sessions: DataFrame, rules: list[Rule], owner: str = "owner", text: str = "query_text") -> DataFrame:
    """``event_key, id``: the rows that each event of apply_rules rests on.

    A relation, not an array per event: a session may be as long as its owner's log. A row without an id is no evidence.
    """
    rows = _matches(sessions, rules, owner, text).filter("id is not null").select("event_key", "id")
    return hot_key_join(rows, apply_rules(sessions, rules, owner, text).select("event_key"), "event_key", F.col("id"))


def rules_from(raw: str) -> list[Rule]:
    """Rules from JSON, a list of objects with the fields of Rule; ValueError where one is malformed or a name repeated."""
    try:
        listed = json.loads(raw)
        rules = [Rule(**r) for r in listed]
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a list of rules: {e}") from e
    if not rules or len({r.name for r in rules}) < len(rules):
        raise ValueError("no rules, or a name twice")
    return rules


def collapse_replays(rows: DataFrame, keys: list[str], at: str, seconds: int = 600) -> DataFrame:
    """One row per keys and tumbling bucket: ``keys, bucket_s, n, first_s``."""
    bucket = (F.floor(F.unix_seconds(at) / seconds) * seconds).alias("bucket_s")
    return rows.filter(F.col(at).isNotNull()).groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_seconds(at)).alias("first_s"))


def trailing_count(rows: DataFrame, owner: str, at: str, seconds: int = 3600) -> DataFrame:
    """Adds ``n_trailing``: rows of the owner in the ``seconds`` up to and with this one, the lower bound left out.

    A row goes to its own bucket of that length and to the next one, where it only counts: so no window is larger than two
    buckets, whatever an owner's share of the log.
    """
    rows = rows.filter(F.col(owner).isNotNull() & F.col(at).isNotNull()).withColumn("_s", F.unix_seconds(at))
    own = F.floor(F.col("_s") / seconds)
    both = rows.withColumn("_b", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(owner, "_b").orderBy("_s").rangeBetween(-(seconds - 1), 0)
    return both.withColumn("n_trailing", F.count(F.lit(1)).over(w)).filter(F.col("_b") == own).drop("_b", "_s")


def lookback(rows: DataFrame, at: str, day: Column, hours: int = 3) -> DataFrame:
    """Rows of a UTC day and of the ``hours`` before it (half open); for a constant day a range of times that reaches the scan."""
    start = F.unix_date(day).cast("bigint") * 86400
    return rows.filter((F.col(at) >= F.timestamp_seconds(start - hours * 3600)) & (F.col(at) < F.timestamp_seconds(start + 86400)))
