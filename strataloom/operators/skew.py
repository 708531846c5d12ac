"""Joins on keys of which a few hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_key_join(big: DataFrame, small: DataFrame, key: str, spread_by: Column, how: str = "inner", shares: int = 1000) -> DataFrame:
    """Join ``big`` (any number of rows per key) with ``small`` (one row per key), hot keys salted.

    A key is hot if it holds more than one in ``shares`` of ``big``'s rows, so there are fewer than
    ``shares`` hot keys: that bounds both the broadcast list and the copies of ``small``'s rows. Hot keys
    are cut into pieces of that size by ``spread_by`` (a column that differs between rows of one key).
    ``how`` is ``inner`` or ``left``. Null keys match nothing. No row is dropped or sampled.
    """
    per_key = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = big.count()
    most = max(1, total // shares)
    hot = per_key.filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_pieces"))
    if total <= 10 * shares:  # too little for a hot key to be a burden
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    left = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    right = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Rows of one key on either side of one task of pairs_join.
BLOCK_ROWS = 1024


def pairs_join(left: DataFrame, right: DataFrame, key: str, left_by: Column, right_by: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join on ``key``, of which both sides may hold many rows: every pair of rows comes out, once.

    A key with more than ``block_rows`` rows on a side is cut there into blocks by ``left_by`` or ``right_by`` (columns that
    differ between rows of one key), and each pair of blocks is joined on its own. The broadcast list of such keys
    has fewer rows than there are blocks. Other columns of the two sides must have different names.
    """
    count = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    hot = F.broadcast(count(left, "_m").join(count(right, "_n"), key).filter("_m > 1 or _n > 1"))
    block = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = left.join(hot, key, "left").withColumn("_i", block(left_by, F.col("_m"))).withColumn("_j", every(F.col("_n"))).drop("_m", "_n")
    b = right.join(hot, key, "left").withColumn("_j", block(right_by, F.col("_n"))).withColumn("_i", every(F.col("_m"))).drop("_m", "_n")
    return a.join(b, [key, "_i", "_j"]).drop("_i", "_j")


#: Rows of the sketch that sketch_semi broadcasts; each holds 63 bits.
SKETCH_ROWS = 1 << 17


def sketch_mark(big: DataFrame, keys: DataFrame, key: str, rows: int = SKETCH_ROWS) -> DataFrame:
    """Adds ``_maybe``: false where ``key`` isn't in ``keys`` for certain.

    The sketch is a bit set of fixed size (``rows`` rows at most), so it may be broadcast whatever the number of keys; with
    many more keys than bits it merely marks more rows.
    """
    h = F.xxhash64(key)
    row = F.pmod(h, F.lit(rows)).alias("_row")
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(F.xxhash64(key), 24), F.lit(63)).cast("int"))
    sketch = keys.filter(F.col(key).isNotNull()).select(row, bit().alias("_bit")).groupBy("_row").agg(F.bit_or("_bit").alias("_bits"))
    marked = big.withColumn("_row", row).join(F.broadcast(sketch), "_row", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit()) != 0, F.lit(False))).drop("_row", "_bits")


def sketch_semi(big: DataFrame, keys: DataFrame, key: str, rows: int = SKETCH_ROWS) -> DataFrame:
    """Most rows of ``big`` whose ``key`` isn't in ``keys`` go, no other row does: what a join that follows
    would drop needn't be shuffled (see sketch_mark)."""
    return sketch_mark(big, keys, key, rows).filter("_maybe").drop("_maybe")


def lookup(big: DataFrame, small: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """Left join of ``big`` with ``small`` (one row per key), for keys that few rows of ``big`` find: only rows whose key may
    be there are shuffled, hot keys salted (see hot_key_join), the others get nulls where they are."""
    marked = sketch_mark(big, small, key)
    met = hot_key_join(marked.filter("_maybe").drop("_maybe"), small, key, spread_by, "left")
    rest = marked.filter(~F.col("_maybe")).drop("_maybe")
    return met.unionByName(rest, allowMissingColumns=True)
