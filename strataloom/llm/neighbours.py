"""The most similar vectors of every vector, by additive quantisation and exact reranking.

Vectors are coded as a sum of full-dimensional codewords, found by beam search over residual codebooks; the
first codebook also names the cell a vector lies in. With more vectors than a bounded sample can fit cells for, a
second codebook, fitted on what the first leaves, cuts every cell into finer ones, so the finest cells grow in number with the vectors and
the codes that a query scans stay few. Codes and norms, some twenty bytes a vector, are all that
travels to the queries: a group of query cells gets the codes of the cells around it, scores them by lookup
tables and keeps the best few per query. Their true vectors are then fetched once per group and candidates are
reranked exactly.

Vectors of equal direction form a class, which is searched once: copies, however many, never meet as pairs.
The codebooks are fitted on a bounded sample; every vector is coded, searched for and found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.skew import hot_key_join
from strataloom.session import written


@dataclass(frozen=True)
class Settings:
    """Parameters of the search. ``sample`` bounds what the codebooks are fitted on, in rows."""

    dimensions: int = 64
    k: int = 10
    sample: int = 32_768
    codebooks: int = 24
    coarse_books: int = 8  # the codebooks that every candidate is scored by; the others score what is left
    codewords: int = 256
    beam: int = 2
    probes: int = 80  # cells searched for the queries of one cell
    left_over: int = 1024  # candidates that are scored by all codebooks
    shortlist: int = 48  # candidates that are reranked exactly
    fine_probes: int = 128  # where cells are cut: finest cells searched, of those within the probed cells
    group_rows: int = 4096  # queries of a group of cells
    group_cells: int = 12  # cells of a group, where they hold more: their surroundings are sent to the group as a whole
    task_rows: int = 65_536  # queries of one task
    slice_rows: int = 4_000_000  # codes that one task holds
    most_cells: int = 4096  # cells that the sample is good for; beyond, cells are cut
    direction_steps: int = 1 << 20  # resolution at which two directions are the same


@dataclass(frozen=True)
class Codebooks:
    cells: np.ndarray
    cuts: np.ndarray  # what the finest cells of a cell add to its centre; one of zeros where cells aren't cut
    levels: np.ndarray


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 8192) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(x[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step)])


def _means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return centres


def wanted_cells(n_rows: int, s: Settings) -> tuple[int, int]:
    """How many cells and finest cells so many vectors need: the finest ones grow as their number to the power 3/4."""
    n = max(1.0, n_rows)
    coarse = min(s.most_cells, 1 << max(0, round(np.log2(2 * n**0.5))))
    return coarse, coarse if coarse < s.most_cells else max(coarse, 1 << max(0, round(np.log2(n**0.75 / 8))))


def fit(sample: np.ndarray, n_rows: int, s: Settings) -> Codebooks:
    """Cells and residual codebooks from a sample of unit vectors."""
    rng = np.random.default_rng(7)
    coarse, finest = wanted_cells(n_rows, s)
    cells = _means(sample, int(min(coarse, max(1, len(sample) // 8))), 6, rng)
    rest = sample - cells[_nearest(sample, cells)]
    cuts = np.zeros((1, sample.shape[1]), np.float32)
    if finest > len(cells):
        cuts = _means(rest, min(256, -(-finest // len(cells))), 6, rng)
        rest = rest - cuts[_nearest(rest, cuts)]
    levels = []
    for _ in range(s.codebooks):
        book = _means(rest, s.codewords, 5, rng)
        rest = rest - book[_nearest(rest, book)]
        levels.append(book)
    return Codebooks(cells, cuts, np.stack(levels))


def beam_encode(x: np.ndarray, books: Codebooks, beam: int, coarse: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, codes (the first is the cut of the cell) and squared norms of unit vectors ``x``; the norms are those of the coded vector by the
    first ``coarse`` codebooks and by all of them."""
    n, d = x.shape
    cell = _nearest(x, books.cells)
    rest = x - books.cells[cell]
    cut = _nearest(rest, books.cuts)
    rest = (rest - books.cuts[cut])[:, None, :]
    codes = np.empty((n, 1, 0), dtype=np.uint8)
    rows = np.arange(n)[:, None]
    for book in books.levels:
        # |r - c|^2 for each kept beam and codeword
        width = rest.shape[1]
        left = (-2 * (rest.reshape(-1, d) @ book.T) + (book * book).sum(1)).reshape(n, width, -1)
        left += (rest * rest).sum(2)[:, :, None]
        left = left.reshape(n, -1)
        best = np.empty((n, min(beam, left.shape[1])), dtype=np.int64)
        for k in range(best.shape[1]):
            best[:, k] = left.argmin(1)
            left[rows[:, 0], best[:, k]] = np.inf
        parent, word = best // len(book), best % len(book)
        rest = rest[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    first = (rest * rest).sum(2).argmin(1)
    codes = codes[rows[:, 0], first]
    coded = books.cells[cell] + books.cuts[cut]
    norms = []
    for m, book in enumerate(books.levels):
        coded = coded + book[codes[:, m]]
        if m + 1 in (min(coarse, len(books.levels)), len(books.levels)):
            norms.append((coded * coded).sum(1))
    return cell, np.concatenate([cut[:, None].astype(np.uint8), codes], axis=1), np.stack([norms[0], norms[-1]], axis=1).astype(np.float32)


def score_by_tables(q: np.ndarray, books: Codebooks, cells: np.ndarray, codes: np.ndarray, norms: np.ndarray, coarse: int, left_over: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the positions of the ``shortlist`` nearest coded vectors and their scores.

    Scores are q.x - |x|^2 / 2 of the coded vector, summed from a table per codebook: by the coarse codebooks
    for all, by the finer ones for the ``left_over`` best of them.
    """
    n = len(codes)
    score = (q @ books.cells.T).take(cells, axis=1)
    if len(books.cuts) > 1:
        score += (q @ books.cuts.T).take(codes[:, 0], axis=1)
    codes = codes[:, 1:]
    for m in range(min(coarse, len(books.levels))):
        score += (q @ books.levels[m].T).take(codes[:, m], axis=1)
    rows = np.arange(len(q))[:, None]
    keep = min(left_over, n)
    pos = np.argpartition(norms[:, 0] * 0.5 - score, keep - 1, axis=1)[:, :keep] if keep < n else np.broadcast_to(np.arange(n), (len(q), n))
    fine = score[rows, pos] - 0.5 * norms[pos, 1]
    for m in range(coarse, len(books.levels)):
        table = q @ books.levels[m].T
        fine += table[rows, codes[:, m][pos]]
    keep = min(shortlist, n)
    best = np.argpartition(-fine, keep - 1, axis=1)[:, :keep]
    return pos[rows, best], fine[rows, best]


def _matrix(column, dtype, width: int) -> np.ndarray:
    """Rows of equal length from a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.empty((0, width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def usable(rows: DataFrame, id_column: str, vector_column: str, s: Settings) -> DataFrame:
    """``id, vec`` with one row per id: as many finite numbers as dimensions, not all zero."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).cast("array<float>").alias("vec")).filter(
        F.col("id").isNotNull() & (F.size("vec") == s.dimensions) & finite & F.exists("vec", lambda x: x != 0)
    )
    return good.groupBy("id").agg(F.first("vec").alias("vec"))


def with_direction(vectors: DataFrame, s: Settings) -> DataFrame:
    """``id, vec`` (packed) and ``k1, k2``: 128 bits that name the direction of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, s.dimensions)
            unit = raw.astype(np.float64)
            unit /= np.sqrt((unit * unit).sum(1))[:, None]
            steps = np.rint(unit * s.direction_steps).astype(np.int32)
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in steps), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["id", "vec", "k1", "k2"])

    return vectors.mapInArrow(run, "id string, vec binary, k1 bigint, k2 bigint")


def classes(keyed: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Every id with its class (``id, rep``), and one row per direction: ``rep, ids`` with the k + 1 smallest ids."""
    keyed = keyed.select("id", "k1", "k2")
    order = Window.partitionBy("k1", "k2").orderBy("id")
    firsts = keyed.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= s.k + 1)
    firsts = firsts.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    firsts = written(firsts.select(F.concat_ws(":", "k1", "k2").alias("k"), F.col("ids")[0].alias("rep"), "ids"), "neighbours-classes")
    members = hot_key_join(keyed.select("id", F.concat_ws(":", "k1", "k2").alias("k")), firsts.select("k", "rep"), "k", F.col("id"))
    return members.select("id", "rep"), firsts.select("rep", "ids")


def _coder(shared, s: Settings):
    def run(batches):
        books = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _matrix(part.column("vec"), np.float32, s.dimensions).astype(np.float64)
                unit = (unit / np.sqrt((unit * unit).sum(1))[:, None]).astype(np.float32)
                cell, codes, norms = beam_encode(unit, books, s.beam, s.coarse_books)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("ids"), part.column("vec"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in norms], pa.binary())],
                    names=["rep", "ids", "vec", "cell", "codes", "norms"],
                )

    return run


def plan_groups(cells: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, list[list[int]]]:
    """Group of each cell (by halving along the widest axis) and, for each cell, the groups that search it."""
    todo, groups = [np.flatnonzero(counts)], []
    while todo:
        part = todo.pop()
        if len(part) < 2 or counts[part].sum() <= s.group_rows or len(part) <= s.group_cells and s.group_rows < counts.sum() / len(cells) * s.group_cells:
            groups.append(part)
            continue
        axis = np.linalg.svd(cells[part] - cells[part].mean(0), full_matrices=False)[2][0]
        part = part[np.argsort(cells[part] @ axis, kind="stable")]
        half = np.searchsorted(np.cumsum(counts[part]), counts[part].sum() / 2)
        half = int(min(max(1, half), len(part) - 1))
        todo += [part[:half], part[half:]]
    group = np.full(len(cells), -1)
    seekers: list[set[int]] = [set() for _ in cells]
    for g, part in enumerate(groups):
        group[part] = g
        for c in np.unique(probed(cells, part, counts, s.probes)):
            seekers[c].add(g)
    return group, [sorted(x) for x in seekers]


def probed(cells: np.ndarray, queries: np.ndarray, counts: np.ndarray, probes: int) -> np.ndarray:
    """For each query cell the nearest cells that hold vectors."""
    held = np.flatnonzero(counts)
    near = cells[queries] @ cells[held].T - 0.5 * (cells[held] ** 2).sum(1)
    p = min(probes, len(held))
    return held[np.argpartition(-near, p - 1, axis=1)[:, :p]]


def finest_around(books: Codebooks, cell: int, cut: int, around: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For queries of one finest cell the nearest finest ones within the cells ``around``: cells and cuts."""
    centre = books.cells[cell] + books.cuts[cut]
    near, cut_part = books.cells[around] @ centre, books.cuts @ centre
    cross = books.cells[around] @ books.cuts.T
    norms = (books.cells[around] ** 2).sum(1)[:, None] + 2 * cross + (books.cuts**2).sum(1)
    score = (near[:, None] + cut_part - 0.5 * norms).ravel()
    best = np.argpartition(-score, min(probes, len(score)) - 1)[:probes]
    return around[best // len(books.cuts)], best % len(books.cuts)


def _scorer(shared, counts: np.ndarray, s: Settings):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        books: Codebooks = shared.value
        is_query = table.column("vec").is_valid().to_numpy(zero_copy_only=False).astype(bool)
        asked, held = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        n_cuts = len(books.cuts)
        codes = _matrix(held.column("codes"), np.uint8, s.codebooks + 1)
        held_cell = held.column("cell").to_numpy().astype(np.int64)
        held_fine = held_cell * n_cuts + codes[:, 0]
        order = np.argsort(held_fine, kind="stable")
        held_cell, held_fine, index, codes = held_cell[order], held_fine[order], held.column("idx").to_numpy()[order], codes[order]
        norms = _matrix(held.column("norms"), np.float32, 2)[order]
        q = _matrix(asked.column("vec"), np.float32, s.dimensions).astype(np.float64)
        q = (q / np.sqrt((q * q).sum(1))[:, None]).astype(np.float32)
        q_cell, q_index = asked.column("cell").to_numpy().astype(np.int64), asked.column("idx").to_numpy()
        q_fine = q_cell * n_cuts + (_nearest(q - books.cells[q_cell], books.cuts) if n_cuts > 1 else 0)
        out_q, out_c, out_s = [], [], []
        for fine in np.unique(q_fine):
            c, mine = fine // n_cuts, np.flatnonzero(q_fine == fine)
            around = probed(books.cells, np.array([c]), counts, s.probes)[0]
            if n_cuts > 1:
                around, cut = finest_around(books, c, fine % n_cuts, around, s.fine_probes)
                around = around * n_cuts + cut
            first, last = np.searchsorted(held_fine, around), np.searchsorted(held_fine, around, side="right")
            rows = np.concatenate([np.arange(x, y) for x, y in zip(first, last)])
            if not len(rows):
                continue
            its_codes, its_cells, its_norms = codes[rows], held_cell[rows], norms[rows]
            for at in range(0, len(mine), 128):
                part = mine[at : at + 128]
                pos, score = score_by_tables(q[part], books, its_cells, its_codes, its_norms, s.coarse_books, s.left_over, s.shortlist)
                out_q.append(np.repeat(q_index[part], pos.shape[1]))
                out_c.append(index[rows[pos]].ravel())
                out_s.append(score.ravel())
        cat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.empty(0, t)
        qs, cs = cat(out_q, np.int64), cat(out_c, np.int64)
        edges = np.flatnonzero(np.diff(qs, prepend=-1))
        offsets = np.append(edges, len(qs)).astype(np.int32)
        return pa.table(
            {
                "grp": pa.array(np.full(len(edges), key[0].as_py()), pa.int64()), "idx": pa.array(qs[edges], pa.int64()),
                "cands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(cs)), "scores": pa.ListArray.from_arrays(pa.array(offsets), pa.array(cat(out_s, np.float32))),
            }
        )

    return run


def _reranker(s: Settings):
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, fetched: pa.Table) -> pa.Table:
        index = fetched.column("idx").to_numpy()
        order = np.argsort(index, kind="stable")
        v = _matrix(fetched.column("vec"), np.float32, s.dimensions)[order].astype(np.float64)
        v /= np.sqrt((v * v).sum(1))[:, None]
        index = index[order]
        ids = fetched.column("ids").combine_chunks().take(pa.array(order))
        names, ends = ids.flatten(), ids.offsets.to_numpy()
        firsts = names.take(pa.array(ends[:-1]))
        by_id = np.empty(len(index), dtype=np.int64)
        by_id[np.argsort(firsts.to_numpy(zero_copy_only=False))] = np.arange(len(index))
        own = np.searchsorted(index, asked.column("idx").to_numpy())
        cands = asked.column("cands").combine_chunks()
        bounds = cands.offsets.to_numpy()
        flat = np.searchsorted(index, cands.flatten().to_numpy())
        bounds = bounds - bounds[0]
        picked, sims, sizes = [], [], []
        for at in range(0, len(own), 512):
            me, lo, hi = own[at : at + 512], bounds[:-1][at : at + 512], bounds[1:][at : at + 512]
            width = int((hi - lo).max())
            slot = lo[:, None] + np.arange(width)
            pos = np.where(slot < hi[:, None], flat[np.minimum(slot, len(flat) - 1)], me[:, None])
            sim = np.minimum(np.einsum("qcd,qd->qc", v[pos], v[me]), 1.0)
            sim = np.where(pos == me[:, None], -2.0, sim)
            best = np.lexsort((by_id[pos], -sim), axis=1)[:, : s.k]
            for row, own_pos in enumerate(me):
                found = list(range(ends[own_pos], ends[own_pos + 1]))
                near = [1.0] * len(found)
                for b in best[row]:
                    if sim[row, b] < -1.5 or len(found) > s.k:
                        break
                    p = pos[row, b]
                    found += range(ends[p], ends[p + 1])
                    near += [sim[row, b]] * (ends[p + 1] - ends[p])
                picked += found[: s.k + 1]
                sims += near[: s.k + 1]
                sizes.append(len(found[: s.k + 1]))
        items = pa.StructArray.from_arrays([names.take(pa.array(np.array(picked, dtype=np.int64))), pa.array(np.array(sims, dtype=np.float64))], names=["id", "similarity"])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.table({"rep": firsts.take(pa.array(own)), "near": pa.ListArray.from_arrays(pa.array(offsets), items)})

    return run


def most_similar(rows: DataFrame, id_column: str = "id", vector_column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """For every usable vector the ``k`` records with the most similar vectors, most similar first.

    Columns ``id, neighbours array<struct<id, similarity>>``; similarity is the cosine, computed in double
    precision. Equal directions (to one part in a million per number) have similarity 1, and ties go to the
    smaller id. A record is never its own neighbour; with fewer than ``k`` others, it has them all.
    Null ids, null, short, long or not finite vectors and vectors of zeros are left out; of an id's repeated rows
    one counts; other columns are ignored. An empty table gives no rows. The search is approximate: a true neighbour
    may be missed.
    """
    s = settings
    spark = rows.sparkSession
    vectors = written(with_direction(usable(rows, id_column, vector_column, s), s), "neighbours-vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "id string, neighbours array<struct<id:string,similarity:double>>")
    members, firsts = classes(vectors, s)
    base = vectors.select(F.col("id").alias("rep"), "vec").join(firsts, "rep")
    share = min(1 << 30, int((1 << 30) * s.sample / n) + 1)
    picked = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("id", "vec").limit(2 * s.sample).toArrow()
    if not picked.num_rows:
        picked = vectors.select("id", "vec").limit(1).toArrow()
    picked = picked.sort_by("id")  # the same codebooks whatever the order of the files
    sample = _matrix(picked.column("vec"), np.float32, s.dimensions).astype(np.float64)
    sample = (sample / np.sqrt((sample * sample).sum(1))[:, None]).astype(np.float32)
    books = fit(sample, n, s)
    shared = spark.sparkContext.broadcast(books)  # at most most_cells + (codebooks + 1) * codewords vectors

    coded = written(
        base.select("rep", "ids", "vec").mapInArrow(_coder(shared, s), "rep string, ids array<string>, vec binary, cell int, codes binary, norms binary").withColumn("idx", F.monotonically_increasing_id()),
        "neighbours-coded",
    )
    counts = np.zeros(len(books.cells), dtype=np.int64)
    for r in coded.groupBy("cell").count().collect():  # one row per cell
        counts[r["cell"]] = r["count"]
    group, seekers = plan_groups(books.cells, counts, s)
    sizes = np.bincount(group[counts > 0], weights=counts[counts > 0]).astype(np.int64)
    q_slices = np.maximum(1, -(-sizes // s.task_rows))
    halo = np.zeros(len(sizes), dtype=np.int64)
    for c, gs in enumerate(seekers):
        halo[gs] += counts[c]
    d_slices = np.maximum(1, -(-halo // s.slice_rows))
    base_key = np.concatenate([[0], np.cumsum(q_slices * d_slices)])
    # a task is (group, slice of its queries, slice of the codes it searches)
    plan = [
        (c, [(int(base_key[g]), int(q_slices[g]), int(d_slices[g])) for g in seekers[c]], (int(base_key[group[c]]), int(q_slices[group[c]]), int(d_slices[group[c]])))
        for c in np.flatnonzero(counts).tolist()
    ]
    task = "struct<first:int,qs:int,ds:int>"
    cells = F.broadcast(spark.createDataFrame(plan, f"cell int, seekers array<{task}>, own {task}"))  # one row per cell
    placed = coded.join(cells, "cell")
    d_slice = lambda t: F.pmod(F.col("idx"), t["ds"])
    held = placed.select("idx", "cell", "codes", "norms", F.explode("seekers").alias("t")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.col("t.qs") - 1), lambda x: F.col("t.first") + x * F.col("t.ds") + d_slice(F.col("t")))).alias("grp"),
        "idx", "cell", F.lit(None).cast("binary").alias("vec"), "codes", "norms",
    )
    asked = placed.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.col("own.ds") - 1), lambda x: F.col("own.first") + F.pmod(F.col("idx"), F.col("own.qs")) * F.col("own.ds") + x)).alias("grp"),
        "idx", "cell", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("norms"),
    )
    tasks = held.unionByName(asked).withColumn("grp", F.col("grp").cast("bigint"))
    short = tasks.groupBy("grp").applyInArrow(_scorer(shared, counts, s), "grp bigint, idx bigint, cands array<bigint>, scores array<float>")
    if d_slices.max() > 1:  # lists of several slices of codes: the best of them all, by query
        pairs = short.select("idx", "grp", F.explode(F.arrays_zip("cands", "scores")).alias("p"))
        best = Window.partitionBy("idx").orderBy(F.desc("p.scores"), "p.cands")
        pairs = pairs.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= s.shortlist)
        short = pairs.groupBy("idx").agg(F.min("grp").alias("grp"), F.collect_list("p.cands").alias("cands"))
    short = written(short.select("grp", "idx", "cands"), "neighbours-short")
    wanted = short.select(F.col("grp").alias("task"), F.explode(F.array_union("cands", F.array("idx"))).alias("idx")).distinct()
    fetched = wanted.join(coded.select("idx", "vec", "ids"), "idx")
    near = short.groupBy("grp").cogroup(fetched.groupBy("task")).applyInArrow(_reranker(s), "rep string, near array<struct<id:string,similarity:double>>")
    everyone = hot_key_join(members, near, "rep", F.col("id"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, s.k)
    return everyone.select("id", others.alias("neighbours"))
