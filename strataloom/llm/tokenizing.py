"""Encoding of a corpus with a public byte-level BPE tokenizer.

Words are cut in the JVM by the tokenizer's pattern. Each task then encodes the distinct words it meets in
DuckDB: token-position rows join the merge table, every word contracts its pairs of least rank in their surroundings, and a
recursive query repeats that until no word has a pair left; an ordered aggregation gives the ids of each word. Nothing
is shuffled, and a task holds one Arrow batch and a bounded store of words at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import shared_dir

#: Fixed value: the published word pattern of this family of tokenizers; white space is Unicode's.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of new words that go into one recursive query, and words that a worker keeps.
QUERY_BYTES, KEPT_WORDS = 1 << 18, 400_000
#: Characters of text that are worked on at once in a task (a longer single text goes alone).
STEP_WORDS = 2_000_000

#: One row per token of a word; tokens that were contracted into the one before them stay as -1. Only words that still
#: contract go into the next round. A pair is contracted if none of a smaller rank lies as near as a token of smaller rank
#: is long: nothing further away can reach it first. Of a run of equal tokens every other pair is, from the left.
_CONTRACT = """
with recursive t(w, pos, id, letters) using key (w, pos) as (
  select w, pos, id, letters from words
  union all
  select * from (
    with pairs as (
      select w, pos, id, letters, lead(id) over o as next_id, row_number() over o as n from t where id >= 0 window o as (partition by w order by pos)),
    ranked as (
      select p.w, p.n, p.pos, p.id = p.next_id as twin, m.rank, m.merged, case when letters then letters_reach else reach end as reach
      from pairs p join merges m on p.id = m.l and p.next_id = m.r),
    near as (
      select *, min(rank) over (partition by w order by pos range between reach preceding and 2 * reach following) as least,
        case when lag(n) over o = n - 1 then lag(rank) over o end as before, case when lead(n) over o = n + 1 then lead(rank) over o end as after
      from ranked window o as (partition by w order by n)),
    hits as (select *, rank = least and rank <= coalesce(before, rank) and rank <= coalesce(after, rank) as hit from near),
    runs as (select *, n - row_number() over (partition by w order by n) as run from hits where twin),
    chosen as (
      select w, n, merged from hits where hit and not twin
      union all select w, n, merged from (
        select *, bool_and(hit) over (partition by w, run) as whole, row_number() over (partition by w, run order by n) as k from runs) where whole and k % 2 = 1)
    select p.w, p.pos, case when gone.w is not null then -1 else coalesce(c.merged, p.id) end as id, p.letters
    from pairs p semi join chosen using (w) left join chosen c on c.w = p.w and c.n = p.n left join chosen gone on gone.w = p.w and gone.n = p.n - 1))
select w, list(id order by pos) as ids from t where id >= 0 group by w order by w
"""


class MergeTable:
    """Byte ids and merges of a tokenizer file: at most its vocabulary, so of bounded size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # bytes that print stand for themselves, the others are numbered upwards from 256
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in set(printable)]
        sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # how long tokens of smaller rank are, in bytes: all of them, and those that may stand in a word of letters or digits
        plain = {sign[b] for b in range(128) if not chr(b).isalnum()}
        lengths = np.array([[len(a + b), len(a + b) * any(c not in plain for c in a + b)] for a, b in pairs]).reshape(-1, 2)
        self.reach = np.maximum.accumulate(np.concatenate([np.ones((1, 2), np.int64), lengths]))[:-1].astype(np.int32)

    def arrow(self) -> pa.Table:
        rank = np.arange(len(self.left), dtype=np.int32)
        return pa.table({"l": self.left, "r": self.right, "rank": rank, "merged": self.merged, "reach": self.reach[:, 0], "letters_reach": self.reach[:, 1]})


class WordEncoder:
    """Ids of words, kept by word: one per Python worker."""

    def __init__(self, table: MergeTable, spill_to: str = ""):
        import duckdb

        self.table = table
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": spill_to})
        self.con.register("given", table.arrow())
        self.con.execute("create table merges as from given")
        self.con.unregister("given")
        self.kept: dict[str, np.ndarray] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't kept yet, QUERY_BYTES per query."""
        at = 0
        while at < len(words):
            raw, size = [], 0
            while at < len(words) and (not raw or size < QUERY_BYTES):
                raw.append(words[at].encode("utf-8"))
                size += len(raw[-1])
                at += 1
            lengths = np.array([len(b) for b in raw])
            starts = np.cumsum(lengths) - lengths
            ids = self.table.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            letters = np.repeat(np.array([any(c.isalnum() for c in word) for word in words[at - len(raw) : at]], bool), lengths)
            rows = pa.table({"w": np.repeat(np.arange(len(raw), dtype=np.int32), lengths), "pos": (np.arange(size) - np.repeat(starts, lengths)).astype(np.int32), "id": ids, "letters": letters})
            self.con.register("words", rows)
            found = self.con.sql(_CONTRACT).to_arrow_table()
            self.con.unregister("words")
            ids_of = found.column("ids").combine_chunks()
            values, ends = ids_of.values.to_numpy(), ids_of.offsets.to_numpy()
            for k, word in enumerate(words[at - len(raw) : at]):
                self.kept[word] = values[ends[k] : ends[k + 1]].astype(np.int32)

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and the ids of all texts, in order."""
        coded = words.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        distinct = coded.dictionary.to_pylist()
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        self.learn([w for w in distinct if w not in self.kept])
        lists = [self.kept[w] for w in distinct]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        values = np.concatenate(lists) if lists else np.empty(0, np.int32)
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        spread = np.repeat(first[index] - ends[:-1], counts) + np.arange(ends[-1])
        offsets = words.offsets.to_numpy()
        return ends[offsets - offsets[0]], values[spread]


_worker: dict[str, WordEncoder] = {}


def _encoder(shared, folder: str) -> WordEncoder:
    table = shared.value
    if _worker.get("of") is not table:
        _worker["of"], _worker["encoder"] = table, WordEncoder(table, f"{folder}/words-{uuid.uuid4().hex}" if folder else "")
    return _worker["encoder"]


def steps_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some STEP_WORDS words, a row at least."""
    ends = batch.column(1).offsets.to_numpy()
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + STEP_WORDS, side="right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def _words(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    cut = F.regexp_extract_all(F.col(text_column), F.lit(f"(?U){WORD_PATTERN}"), F.lit(0))
    return docs.select(F.col(id_column), F.coalesce(cut, F.array().cast("array<string>")).alias("words"))


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", counts_only: bool = False) -> DataFrame:
    """Ids of each text by the byte-level BPE in file ``tokenizer``, without special tokens.

    Columns ``<id_column>`` and ``ids array<int>``, or ``n_tokens int`` with ``counts_only``. Spellings of
    special tokens in a text are ordinary text. Null and empty texts give an empty list (0). One row per row
    of ``docs``, repeated rows included; other columns are ignored, whatever their names. White space and odd
    characters are encoded as they stand: decoding gives the text back.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(MergeTable(tokenizer))  # at most the vocabulary: some 50,000 merges

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    folder = folder if folder.startswith("/") else ""  # where a query may spill: shared files, or not at all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps_of(batch):
                encoder = _encoder(shared, folder)
                offsets, ids = encoder.encode(part.column(1))
                if counts_only:
                    out = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[id_column, "n_tokens" if counts_only else "ids"])

    kind = dict(docs.dtypes)[id_column]
    return _words(docs, id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, " + ("n_tokens int" if counts_only else "ids array<int>"))
