"""HTML as columns: readable text of markup, and text made safe for markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without readable text.
SILENT = ("head", "noscript", "script", "style")
#: Named entities that are resolved.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
#: Characters that are escaped, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))

_UNREAD = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{e}\b.*?(?:</{e}\s*>|\z)" for e in SILENT)
_TAG = r"<[a-zA-Z/!?][^>]*>"
_ENTITY = r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-z]{2,4});"
_EDGE = r"[\t\n\x{0B}\x{0C}\r \x{A0}\x{2000}-\x{200A}\x{3000}]+"
_EDGES = f"^{_EDGE}|{_EDGE}$"


def _character(code: Column) -> Column:
    """The character of a code point, U+FFFD where it names none."""
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")


def unescaped(c: Column) -> Column:
    """Numeric entities and those of ENTITIES as the characters they stand for; all else stays as it is."""

    def resolved(piece: Column) -> Column:
        name = F.regexp_extract(piece, _ENTITY, 1)
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        code = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("bigint")
        text = F.when(name.startswith("#"), _character(code))
        for entity, character in ENTITIES.items():
            text = text.when(name == entity, F.lit(character))
        return F.coalesce(F.concat(text, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(c, "&")
    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), resolved), ""))


def readable(c: Column | str) -> Column:
    """The text between the tags, a line per stretch, without comments and SILENT elements; null for null.

    A comment or silent element that isn't closed reaches to the end. A tag ends at the next ``>``.
    """
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(F.regexp_replace(c, _UNREAD, "<br>"), _TAG), lambda x: F.regexp_replace(unescaped(x), _EDGES, ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def escaped(c: Column | str) -> Column:
    """Text that markup shows as it is."""
    c = F.col(c) if isinstance(c, str) else c
    for character, entity in ESCAPES:
        c = F.replace(c, F.lit(character), F.lit(entity))
    return c


# -- the same in DuckDB's SQL --


def readable_sql(e: str) -> str:
    name = f"regexp_extract(p, '{_ENTITY}', 1)"
    code = f"case when lower({name}) like '#x%' then ('0x' || substring({name}, 3))::bigint else substring({name}, 2)::bigint end"
    named = " ".join(f"when {name} = '{n}' then '{c.replace(chr(39), chr(39) * 2)}' || substring(p, length({name}) + 2)" for n, c in ENTITIES.items())
    sign = f"(case when ({code}) = 0 or ({code}) > 1114111 or ({code}) between 55296 and 57343 then chr(65533) else chr(({code})::int) end)"
    piece = f"case when {name} like '#%' then {sign} || substring(p, length({name}) + 2) {named} else '&' || p end"
    resolve = f"string_split(x, '&')[1] || array_to_string(list_transform(string_split(x, '&')[2:], lambda p: {piece}), '')"
    parts = f"string_split_regex(regexp_replace({e}, '{_UNREAD}', '<br>', 'g'), '{_TAG}')"
    return f"array_to_string(list_filter(list_transform({parts}, lambda x: regexp_replace({resolve}, '{_EDGES}', '', 'g')), lambda x: x <> ''), E'\\n')"


def escaped_sql(e: str) -> str:
    for character, entity in ESCAPES:
        e = f"replace({e}, '{character.replace(chr(39), chr(39) * 2)}', '{entity}')"
    return e
