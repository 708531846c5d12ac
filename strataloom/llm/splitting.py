"""Splitting of oversized texts at natural boundaries, with an overlap.

Between any two words of a text there is a possible cut with a strength: heading, paragraph, line, sentence or
none. A sparse table over the strengths answers range-maximum queries in constant time; each piece ends at the
strongest cut of its permissible window, the last one among equals, and the next piece steps back by the
overlap. The work is per text and runs where the text is: nothing but the pieces leaves the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS, OVERLAP_WORDS = 400, 40
KINDS = ("forced", "sentence", "line", "paragraph", "heading")
_WORD = re.compile(r"\S+")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
SCHEMA = "piece_no int, first_word int, n_words int, piece string, ends_at string, cut string"


class StrongestCut:
    """Sparse table: position of the greatest value in any range, the rightmost among equals."""

    def __init__(self, strengths: np.ndarray):
        self.values = strengths
        self.levels = [np.arange(len(strengths))]
        half = 1
        while 2 * half <= len(strengths):
            low = self.levels[-1]
            left, right = low[:-half], low[half:]
            self.levels.append(np.where(strengths[right] >= strengths[left], right, left))
            half *= 2

    def query(self, first: int, last: int) -> int:
        """Of positions ``first`` to ``last``, both included."""
        k = (last - first + 1).bit_length() - 1
        left, right = self.levels[k][first], self.levels[k][last - (1 << k) + 1]
        return int(right if self.values[right] >= self.values[left] else left)


def cut_strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the cut before each word; the start of the text has none."""
    out = np.zeros(len(spans), dtype=np.int8)
    for k in range(1, len(spans)):
        end, start = spans[k - 1][1], spans[k][0]
        lines = 0
        if end + 1 < start or not text[end] == " ":
            lines = len(_LINE.findall(text, end, start))
        if lines:
            out[k] = 4 if text[start] == "#" else 3 if lines > 1 else 2
        elif text[end - 1] in ".!?":
            out[k] = 1
    return out


def without_boundary(table: StrongestCut, width: int) -> bool:
    """Whether ``width`` cuts in a row have no strength, the start of the text aside."""
    first, n = 1, len(table.values)
    while first + width <= n:
        cut = table.query(first, first + width - 1)
        if not table.values[cut]:
            return True
        first = cut + 1  # every range with that cut has a boundary
    return False


def piece_bounds(table: StrongestCut, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (first word, word after the last, kind of the cut at its end)."""
    n, start, done, out = len(table.values), 0, 0, []
    while n - start > limit:
        # at least half full, and beyond the piece before; if that holds no boundary, any place beyond it
        cut = table.query(max(start + limit // 2, done + 1), start + limit)
        if not table.values[cut]:
            cut = table.query(done + 1, start + limit)
        if not table.values[cut]:
            cut = start + limit
        out.append((start, cut, KINDS[table.values[cut]]))
        done, start = cut, cut - overlap
    return [*out, (start, n, "end")]


def split_text(text: str, limit: int = MAX_WORDS, overlap: int = OVERLAP_WORDS) -> list[tuple[int, int, int, str, str, str]]:
    """The pieces of one text; none if it has at most ``limit`` words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= limit:
        return []
    table = StrongestCut(cut_strengths(text, spans))
    cut = "forced" if without_boundary(table, limit) else "natural"
    return [
        (k, a, b - a, text[spans[a][0] : spans[b - 1][1]], kind, cut)
        for k, (a, b, kind) in enumerate(piece_bounds(table, limit, overlap))
    ]


def split_oversized(rows: DataFrame, id_column: str = "id", text_column: str = "content", limit: int = MAX_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Numbered pieces of every text of more than ``limit`` words (separated by white space).

    Each piece has at most ``limit`` words and, but for the first, begins with the last ``overlap`` words of the
    piece before; ``piece`` is the text as it stands from its first word to its last. ``ends_at`` names the
    cut at its end. ``cut`` tells for the whole text whether some stretch between two boundaries is longer
    than ``limit`` (``forced``) or none is (``natural``); where a stretch of a natural text is longer than
    ``limit - overlap``, the overlap leaves no boundary within reach and a single piece may still end ``forced``.

    Null, empty and blank texts and texts within the limit give no piece. One row of input is one text: rows
    that repeat an id give their pieces twice. Other columns are ignored, whatever their names.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    # more than `limit` words need as many characters, and a separator between each two of them
    long = rows.select(id_column, text_column).filter(F.length(text_column) > 2 * limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                pieces = split_text(text, limit, overlap)
                if pieces:
                    columns = list(zip(*pieces))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key.as_py()] * len(pieces), batch.column(0).type),
                            *(pa.array(c, pa.int32()) for c in columns[:3]),
                            *(pa.array(c, pa.string()) for c in columns[3:]),
                        ],
                        names=[id_column, "piece_no", "first_word", "n_words", "piece", "ends_at", "cut"],
                    )

    return long.mapInArrow(run, f"`{id_column}` {dict(rows.dtypes)[id_column]}, {SCHEMA}")
