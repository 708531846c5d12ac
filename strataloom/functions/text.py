"""Text expressions: words, titles, snippets, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column | str) -> Column:
    """Words separated by Unicode white space; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Number of words, 0 for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), 0).otherwise(F.size(words(c)))


def title(c: Column | str) -> Column:
    """First line without leading ``#`` marks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split_part(F.regexp_replace(c, r"^#+\s*", ""), F.lit("\n"), F.lit(1))


def snippet(c: Column | str, n: int = 40) -> Column:
    """The first ``n`` words, with an ellipsis where there are more."""
    w = words(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("…"))).otherwise(F.array_join(w, " "))


def terms(c: Column | str) -> Column:
    """Lower-case terms of at least two letters, digits or underscores (ASCII), in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 2)


#: English function words that carry no topic.
STOP_WORDS = tuple(
    "about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each "
    "few for from further had has have having he her here hers him his how if in into is it its just me more most my no nor not now of off on once only or other "
    "our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your".split()
)


def content_terms(c: Column | str) -> Column:
    """terms() without stop words."""
    return F.filter(terms(c), lambda x: ~x.isin(*STOP_WORDS))


# -- the same in DuckDB's SQL --

WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '')"


def words_sql(e: str) -> str:
    return WORDS_SQL.format(e)


def terms_sql(e: str, without_stop_words: bool = False) -> str:
    found = f"list_filter(regexp_extract_all(lower({e}), '[a-z0-9_]+'), lambda x: length(x) >= 2)"
    return content_terms_sql(found) if without_stop_words else found


def content_terms_sql(found: str) -> str:
    return f"list_filter({found}, lambda x: x not in ({', '.join(repr(w) for w in STOP_WORDS)}))"
