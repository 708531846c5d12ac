"""Tag expressions. Tags with a namespace (``shape:``, ``component:``) bypass the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACES = ("shape:", "component:")

#: Default shape of a record by the kind of its source; others are notes.
SHAPE_BY_SOURCE_TYPE = {"docx": "document", "obsidian": "document", "pdf": "document", "project_docs": "document", "slack": "note", "text": "note", "url": "document"}
#: The shapes.
SHAPES = ("card", "document", "event", "note")


def tag_key(t: Column) -> Column:
    """Variants of a tag fold to one key: trimmed, lower case, blanks and underscores as hyphens."""
    return F.translate(F.lower(F.trim(t)), " _", "--")


def tag_key_sql(e: str) -> str:
    return f"translate(lower(trim({e})), ' _', '--')"


def namespaced(t: Column) -> Column:
    return F.lower(F.trim(t)).rlike("^(shape|component):")


def component_of(tags: Column) -> Column:
    """What follows ``component:`` in the first such tag, null if there is none."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith("component:")), F.lit(0)), 11, 1000)


def shape_of(source_type: Column, override: Column | None = None) -> Column:
    """A valid override, else the shape of the source type, else ``note``."""
    by_type = F.create_map(*[F.lit(x) for pair in SHAPE_BY_SOURCE_TYPE.items() for x in pair])
    derived = F.coalesce(by_type[F.lower(F.trim(source_type))], F.lit("note"))
    return derived if override is None else F.when(override.isin(*SHAPES), override).otherwise(derived)
