"""Texts that differ by small edits: an exact join of n-gram sets by prefix trees.

The n-grams of all texts stand in one global order, rare ones first, by a count table over the whole corpus. Two sets
that are similar enough share n-grams among the first of each (their prefixes). The sets that hold an n-gram in
their prefixes are owned by one of them, and what an owner's sets have of its n-grams goes to the owner's
trie: a set is stored as the path of these n-grams in their global order, so likenesses share paths. All sets of a task
stand in one trie below its owners, and every path runs through it: the partial overlap with a node is computed
once for all sets below it, and a subtree is left when the sizes below it don't fit, when the lengths that remain on
either side can't give a meeting, or when they leave too little room for the overlap that is needed. How often
two sets must meet is known from their sizes; the pairs that do are checked exactly.

Texts with equal sets form a class and take part once. Counts and tries change only what is sent, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.tokenizing import steps_of
from strataloom.operators.skew import lookup, pairs_join, sketch_semi
from strataloom.session import written

#: Fixed: runs of letters and digits are words.
WORD = r"[\p{L}\p{N}]+"
#: Cells of the count table, by the size of the corpus within these bounds; it is broadcast, a byte a cell. With more
#: n-grams than cells an n-gram stands in the order by no more than the mean of a cell, which is never too early.
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 24
_BLOCK = 1 << 16
#: How many common prefix n-grams of a pair are looked for, where its sizes promise as many.
MEETINGS = 4
#: Postings per task of the joins.
TASK_POSTINGS = 400_000
#: Postings of one n-gram in one task: more are cut into parts, each two of which meet in a task.
PART_POSTINGS = 1 << 21
#: Sets of one n-gram below one owner: more are cut into blocks by size, each two of which have an owner of their own.
CELL_SETS = 4096
#: Prefix places of an owner that form one group.
OWNER_PLACES = 256
#: Sets that one set is checked with in a task.
CHECKED_SETS = 2000
#: Nodes visited, or pairs written out, at once.
STEP = 1 << 20
#: A posting's size holds two marks: its sets meet only those of the other side, and which side it is of.
CROSS, SIDE, SIZE = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Grams:
    """The n-gram sets of some texts: ``h`` sorted within each text, ``own`` its row, ``n`` the sizes."""

    def __init__(self, words: pa.ListArray, width: int):
        coded = words.flatten().dictionary_encode()
        names = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64)
        w = names[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        own = np.repeat(np.arange(len(words)), np.diff(ends))
        n = max(0, len(w) - width + 1)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
        inside = own[:n] == own[width - 1 :] if n else np.empty(0, bool)
        h, own = h[inside], own[:n][inside]
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.empty(0, bool)
        self.h, self.own = h[new], own[new]
        self.n = np.bincount(self.own, minlength=len(words))
        self.starts = np.cumsum(self.n) - self.n

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name the set of each text, as two numbers; 0 for empty sets."""
        out = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.h ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(_mix(sums[self.starts + self.n] - sums[self.starts]).view(np.int64))
        return out[0], out[1]


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h & np.uint64(cells - 1)).astype(np.int64)


def count_code(n: np.ndarray) -> np.ndarray:
    """A count as a byte: up to 15 as it is, beyond in steps of an eighth of a doubling, to some 10^10."""
    n = np.asarray(n, np.int64)
    return np.where(n < 16, n, np.minimum(255, 16 + np.floor(8 * (np.log2(np.maximum(n, 16)) - 4)))).astype(np.uint8)


def code_count(code: np.ndarray) -> np.ndarray:
    """The least count of a code."""
    code = np.asarray(code, np.int64)
    return np.where(code < 16, code, np.ceil(16 * 2.0 ** ((code - 16) / 8) - 1e-6)).astype(np.int64)


def _surveyor(width: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.uint16)
        names = ["id", "n", "k1", "k2", "copy", "block", "counts"]

        def block_row(b: int) -> pa.RecordBatch:
            code = count_code(table[b * _BLOCK : (b + 1) * _BLOCK])
            nulls = [pa.nulls(1, kind) for kind in (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nulls, pa.array([b], pa.int32()), pa.array([code.tobytes()], pa.binary())], names=names)

        for batch in batches:
            for part in steps_of(batch):
                g = Grams(part.column(1), width)
                at, times = np.unique(_cell(g.h, cells), return_counts=True)
                for b in np.unique(at[table[at] + times.astype(np.int64) > 60_000] // _BLOCK):  # before a cell is full
                    yield block_row(int(b))
                    table[b * _BLOCK : (b + 1) * _BLOCK] = 0
                table[at] += np.minimum(times, 60_000).astype(np.uint16)
                k1, k2 = g.keys()
                rows = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(g.n.astype(np.int32)), pa.array(k1), pa.array(k2), part.column(2), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names
                ).filter(pa.array(g.n > 0))
        for b in range(cells // _BLOCK):
            if table[b * _BLOCK : (b + 1) * _BLOCK].any():
                yield block_row(b)

    return run


def _add_counts(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, np.int64)
    for b in blocks.column("counts"):
        total += code_count(np.frombuffer(b.as_py(), np.uint8))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([count_code(total).tobytes()], pa.binary())})


def needed(total, t: Fraction):
    """Least overlap of two sets of ``total`` members that are at least ``t`` similar."""
    a, b = t.numerator, t.denominator
    return -(-(a * total) // (a + b))


def least_of_one(n, t: Fraction):
    """Least overlap that a set of ``n`` has with any similar set."""
    return -(-(t.numerator * n) // t.denominator)


def _packed(bucket: np.ndarray, buckets: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket: its postings, column after column, as bytes."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))
    filled = np.flatnonzero(np.diff(edges))
    columns = [x[order] for x in arrays]
    packed = [b"".join(x[edges[b] : edges[b + 1]].tobytes() for x in columns) for b in filled]
    return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "postings"])


def _unpacked(rows: pa.Table, kinds: tuple) -> list[np.ndarray]:
    parts = [[np.empty(0, kind)] for kind in kinds]
    width = sum(np.dtype(kind).itemsize for kind in kinds)
    for packed in rows.column("postings").to_pylist():
        m, at = len(packed) // width, 0
        for column, kind in zip(parts, kinds):
            column.append(np.frombuffer(packed, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in parts]


_POSTING = (np.int64, np.uint32, np.uint32, np.uint32)  # set, n-gram, size and marks, place in the set


def _tokens(g: Grams, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some texts as numbers in the global order, by count and then by hash, and their counts."""
    code = table[_cell(g.h, len(table))]
    return (code.astype(np.uint32) << np.uint32(24)) | ((g.h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.uint32), code


def in_parts(h: np.ndarray, rec: np.ndarray, n: np.ndarray, code: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Postings by what they meet in: index, hash of n-gram and parts, size with marks. An n-gram that more than ``most`` sets have
    is cut into parts by set, and a posting meets its own part and each other one."""
    parts = -(-code_count(code) // most)
    whole = np.flatnonzero(parts <= 1)
    yield whole, h[whole], n[whole]
    cut = np.flatnonzero(parts > 1)
    own = (_mix(rec[cut].view(np.uint64)) % parts[cut].astype(np.uint64)).astype(np.int64)
    for other in range(int(parts.max(initial=1)) if len(cut) else 0):
        live = parts[cut] > other
        at, low, high = cut[live], np.minimum(own[live], other), np.maximum(own[live], other)
        mark = np.where(low != high, CROSS, np.uint32(0)) | np.where((low != high) & (own[live] == high), SIDE, np.uint32(0))
        yield at, _mix(h[at] + (low * parts[at] + high + 1).astype(np.uint64)), n[at] | mark


def _poster(shared, width: int, t: Fraction, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in steps_of(batch):
                g = Grams(part.column(1), width)
                k1, _ = g.keys()
                single = np.zeros(len(k1), bool)
                single[np.unique(k1, return_index=True)[1]] = True  # copies within the batch post once
                token, code = _tokens(g, table)
                order = np.lexsort((g.h, token, g.own))
                own, h, code = g.own[order], g.h[order], code[order]
                pos = np.arange(len(own)) - g.starts[own]
                prefix = g.n - least_of_one(g.n, t) + 1
                keep = (code > 1) & (pos < prefix[own]) & single[own]
                own, h, code, pos = own[keep], h[keep], code[keep], pos[keep]
                rec, n = k1[own], g.n[own].astype(np.uint32)
                columns = []
                for at, name, size in in_parts(h, rec, n, code, most):
                    token = (code[at].astype(np.uint32) << np.uint32(24)) | ((name >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.uint32)
                    columns.append([_mix(name) >> np.uint64(40), rec[at], token, size, pos[at].astype(np.uint32)])
                bucket, *arrays = (np.concatenate(c) for c in zip(*columns))
                yield _packed(bucket % np.uint64(buckets), buckets, arrays)

    return run


def _fits(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` can be similar."""
    return t.denominator * np.minimum(a, b) >= t.numerator * np.maximum(a, b)


def owned(rec: np.ndarray, token: np.ndarray, n: np.ndarray, pos: np.ndarray, t: Fraction, most: int, part: int) -> tuple[np.ndarray, ...]:
    """Postings with their owner: for each n-gram the least set that has it, by stretches of the owner's places.

    Sets that fit no other one of their n-gram are left out. More than ``most`` sets of an n-gram are cut into blocks
    by size, and each two blocks that fit have an owner of their own; so have the parts of an n-gram that was cut
    (``part``, see in_parts), whose names don't keep the order.
    """
    size = (n & SIZE).astype(np.int64)
    order = np.lexsort((n & (CROSS | SIDE), rec, size, token))
    rec, token, n, pos, size = rec[order], token[order], n[order], pos[order], size[order]
    if len(rec):  # repeated rows
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (rec[1:] != rec[:-1]) | ((n[1:] ^ n[:-1]) >> np.uint32(30) > 0)])
        rec, token, n, pos, size = rec[new], token[new], n[new], pos[new], size[new]
        next_fits = (token[1:] == token[:-1]) & _fits(size[1:], size[:-1], t)
        keep = np.concatenate([[False], next_fits]) | np.concatenate([next_fits, [False]])
        rec, token, n, pos, size = rec[keep], token[keep], n[keep], pos[keep], size[keep]
    if not len(rec):
        return np.empty(0, np.int64), rec, token, n, pos
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(edges, len(token)))
    least = np.minimum.reduceat(rec, edges)
    place = np.maximum.reduceat(np.where(rec == np.repeat(least, length), pos, 0), edges)
    cut = code_count(token[edges] >> np.uint32(24)) > part
    stretch = np.where(cut, token[edges].astype(np.uint64) << np.uint64(32), place.astype(np.uint64) // np.uint64(OWNER_PLACES))
    owner = np.repeat(_mix(least.view(np.uint64) ^ _mix(stretch)).view(np.int64), length)
    small = np.repeat(length <= most, length)
    out = [[owner[small], rec[small], token[small], n[small], pos[small]]]
    for r in np.flatnonzero(length > most):
        rows = np.arange(edges[r], edges[r] + length[r])  # by size
        crossed = bool((n[rows] & CROSS).any())
        sides = [rows[(n[rows] & SIDE) == 0], rows[(n[rows] & SIDE) > 0]] if crossed else [rows, rows]
        left, right = ([x[k : k + most] for k in range(0, len(x), most)] for x in sides)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if not crossed and j < i or t.denominator * size[a[-1]] < t.numerator * size[b[0]] or t.denominator * size[b[-1]] < t.numerator * size[a[0]]:
                    continue
                name = _mix(_mix(_mix(rec[a[:1]].view(np.uint64)) ^ token[a[:1]]) + np.array([i * len(right) + j], np.uint64)).view(np.int64)
                alone = i == j and not crossed
                both = a if alone else np.concatenate([a, b])
                mark = np.zeros(len(a), np.uint32) if alone else np.concatenate([np.full(len(a), CROSS), np.full(len(b), CROSS | SIDE)])
                out.append([np.repeat(name, len(both)), rec[both], token[both], (n[both] & SIZE) | mark, pos[both]])
    return tuple(np.concatenate(x) for x in zip(*out))


def _owners(t: Fraction, tasks: int, most: int, part: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        owner, *posting = owned(*_unpacked(rows, _POSTING), t, most, part)
        return pa.Table.from_batches([_packed(_mix(owner.view(np.uint64)) % np.uint64(tasks), tasks, [owner, *posting])])

    return run


class PrefixTrie:
    """All sets of a task, each a path of n-grams in their global order below its owner; equal beginnings are shared.

    Nodes are numbered level by level, the children of a node side by side. A node knows the least and the greatest size of the sets
    below it, the longest path that follows and the most room that a set below it has from this n-gram on. ``ends`` are
    the sets whose path ends at a node: all sets with one path are one probe.
    """

    def __init__(self, owner: np.ndarray, rec: np.ndarray, token: np.ndarray, n: np.ndarray, pos: np.ndarray):
        order = np.lexsort((token, n >> np.uint32(30), rec, owner))
        owner, rec, token, n, pos = owner[order], rec[order], token[order], n[order], pos[order].astype(np.int64)
        change = (owner[1:] != owner[:-1]) | (rec[1:] != rec[:-1]) | ((n[1:] ^ n[:-1]) >> np.uint32(30) > 0)
        start = np.flatnonzero(np.concatenate([[True], change])) if len(rec) else np.empty(0, np.int64)
        length = np.diff(np.append(start, len(rec)))
        self.rec, self.size, self.mark = rec[start], (n[start] & SIZE).astype(np.int64), n[start] >> np.uint32(30)
        self.start, self.room_at = start, np.repeat(self.size, length) - pos
        room = self.room_at
        roots, root = np.unique(owner[start], return_inverse=True)
        self.n_roots, at = len(roots), root.astype(np.int64)
        held = lambda x: [np.full(len(roots), x, np.int64)]
        parent, label, low, high, longest, rooms = held(-1), held(-1), held(0), held(0), held(0), held(0)
        self.levels = [np.arange(len(roots))]
        live, depth, base = np.arange(len(start)), 0, len(roots)
        while len(live):
            tok = token[start[live] + depth]
            by = np.lexsort((tok, at[live]))
            seq, tok, above = live[by], tok[by], at[live[by]]
            first = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (above[1:] != above[:-1])]))
            at[seq] = base + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(seq))))
            parent.append(above[first])
            label.append(tok[first].astype(np.int64))
            low.append(np.minimum.reduceat(self.size[seq], first))
            high.append(np.maximum.reduceat(self.size[seq], first))
            longest.append(np.maximum.reduceat(length[seq] - depth - 1, first))
            rooms.append(np.maximum.reduceat(room[start[seq] + depth], first))
            self.levels.append(np.arange(base, base + len(first)))
            base += len(first)
            depth += 1
            live = live[length[live] > depth]
        self.parent, self.label, self.low, self.high, self.longest, self.room = map(np.concatenate, (parent, label, low, high, longest, rooms))
        self.first_child = np.searchsorted(self.parent, np.arange(base))
        self.children = np.searchsorted(self.parent, np.arange(base), side="right") - self.first_child
        self.by_end = np.argsort(at, kind="stable")
        self.probes, self.first_end, self.ends = np.unique(at[self.by_end], return_index=True, return_counts=True)
        self.probe_of = np.full(base, -1)
        self.probe_of[self.probes] = np.arange(len(self.probes))
        # the path of each probe, with the most room that one of its sets has at each n-gram
        one = self.by_end[self.first_end]
        self.root, steps = root[one], length[one]
        self.path_end = np.cumsum(steps)
        place = np.repeat(start[one] - self.path_end + steps, steps) + np.arange(steps.sum())
        self.path = (np.repeat(np.arange(len(one)), steps).astype(np.uint64) << np.uint64(32)) | token[place].astype(np.uint64)
        self.path_room = room[place]
        group = self.probe_of[at]
        slot = np.repeat((self.path_end - steps)[group] - start, length) + np.arange(len(rec))
        np.maximum.at(self.path_room, slot, room)
        sized = self.size[self.by_end]
        self.least = np.minimum.reduceat(sized, self.first_end) if len(sized) else sized
        self.most = np.maximum.reduceat(sized, self.first_end) if len(sized) else sized

    def meet(self, t: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs every probe through the trie: probe, probe it meets (not before it), how many n-grams they share and,
        of the first MEETINGS of these, the places on both paths."""
        root = np.arange(len(self.parent))
        for level in self.levels[1:]:
            root[level] = root[self.parent[level]]
        cost = np.cumsum(np.bincount(root, minlength=self.n_roots)[self.root])  # nodes that a probe may visit
        at = 0
        while at < len(self.probes):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + STEP, side="right")))
            yield from self._traverse(np.arange(at, stop), t)
            at = stop

    def _traverse(self, probe: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
        first_slot = np.append(0, self.path_end)
        node, overlap = self.root[probe].astype(np.int64), np.zeros(len(probe), np.int64)
        places = np.zeros((2, MEETINGS, len(probe)), np.int32)
        depth = 0
        while len(probe):
            n = self.children[node]
            probe, overlap, places = np.repeat(probe, n), np.repeat(overlap, n), np.repeat(places, n, axis=2)
            node = np.repeat(self.first_child[node] - np.cumsum(n) + n, n) + np.arange(len(probe))
            fits = (t.denominator * self.high[node] >= t.numerator * self.least[probe]) & (t.denominator * self.most[probe] >= t.numerator * self.low[node])
            probe, node, overlap, places = probe[fits], node[fits], overlap[fits], places[:, :, fits]
            key = (probe.astype(np.uint64) << np.uint64(32)) | self.label[node].astype(np.uint64)
            slot = np.minimum(np.searchsorted(self.path, key), len(self.path) - 1)
            same = self.path[slot] == key
            need = needed(self.least[probe] + self.low[node], t)
            room = np.minimum(self.path_room[slot], self.room[node]) >= need - MEETINGS + 1
            now = np.flatnonzero(same & room & (overlap < MEETINGS))
            places[0, overlap[now], now], places[1, overlap[now], now] = slot[now] - first_slot[probe[now]], depth
            overlap = overlap + (same & room)
            # what is left of either path can't give a meeting, or leaves no room for the overlap that is needed
            left = np.minimum(self.path_end[probe] - slot - same, self.longest[node])
            go = (overlap > 0) | ((left > 0) & (~same | room))
            probe, node, overlap, places = probe[go], node[go], overlap[go], places[:, :, go]
            other = self.probe_of[node]
            hit = (other >= probe) & (overlap > 0)
            if hit.any():
                yield probe[hit], other[hit], overlap[hit], places[:, :, hit]
            go = self.longest[node] > 0
            probe, node, overlap, places = probe[go], node[go], overlap[go], places[:, :, go]
            depth += 1

    def pairs(self, t: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
        """Sets that meet: two sets, their sizes, and at how many of the first MEETINGS n-grams that they share here
        both have room for the overlap that they need."""
        for probe, other, overlap, places in self.meet(t):
            times = self.ends[probe] * self.ends[other]
            edges = np.cumsum(times)
            at = 0
            while at < len(probe):
                done = edges[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(edges, done + STEP, side="right")))
                own = np.repeat(np.arange(at, stop), times[at:stop])
                k = np.arange(len(own)) - np.repeat(edges[at:stop] - times[at:stop] - done, times[at:stop])
                a = self.by_end[self.first_end[probe[own]] + k // self.ends[other[own]]]
                b = self.by_end[self.first_end[other[own]] + k % self.ends[other[own]]]
                good = _fits(self.size[a], self.size[b], t) & (self.rec[a] != self.rec[b]) & ((probe[own] != other[own]) | (a < b))
                good &= (self.mark[a] < 2) | (self.mark[a] != self.mark[b])  # of two sides, where there are sides
                a, b, own = a[good], b[good], own[good]
                need = needed(self.size[a] + self.size[b], t) - MEETINGS + 1
                met = np.zeros(len(a), np.int64)
                for m in range(MEETINGS):
                    room = np.minimum(self.room_at[self.start[a] + places[0, m, own]], self.room_at[self.start[b] + places[1, m, own]])
                    met += (overlap[own] > m) & (room >= need)
                good = met > 0
                a, b, met = a[good], b[good], met[good]
                swap = self.rec[a] > self.rec[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield self.rec[a], self.rec[b], self.size[a], self.size[b], met
                at = stop


def _joiner(t: Fraction):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = list(PrefixTrie(*_unpacked(rows, (np.int64, *_POSTING))).pairs(t)) if rows.num_rows else []
        a, b, na, nb, met = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 5
        order = np.lexsort((b, a))
        a, b, na, nb, met = a[order], b[order], na[order], nb[order], met[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, int)
        met = np.add.reduceat(met, first) if len(first) else met
        return pa.table({"a": pa.array(a[first]), "b": pa.array(b[first]), "na": pa.array(na[first]), "nb": pa.array(nb[first]), "met": pa.array(met)})

    return run


def _sets_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps_of(batch):
                g = Grams(part.column(1), width)
                k1, _ = g.keys()
                cut = np.split(g.h, np.cumsum(g.n)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array([x.tobytes() for x in cut], pa.binary())], names=["k1", "members"])

    return run


def _checker(t: Fraction):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sets: dict = {}
        for probe, k1, members in zip(*(rows.column(c).to_pylist() for c in ("probe", "k1", "members"))):
            sets.setdefault(probe, {})[k1] = np.frombuffer(members, np.uint64)
        out = []
        for probe, held in sets.items():
            own = held.pop(probe)
            for k1, members in held.items():
                small, large = (own, members) if len(own) <= len(members) else (members, own)
                overlap = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if overlap >= needed(len(own) + len(members), t):
                    out.append((probe, k1, overlap / (len(own) + len(members) - overlap)))
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return run


def _words(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    texts = rows.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    return texts.select("id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("copy"))


def similar_classes(rows: DataFrame, id_column: str = "id", text_column: str = "content", width: int = 5, threshold: str = "0.8") -> tuple[DataFrame, DataFrame]:
    """Membership ``id, class_id, copy_id`` and links ``class_lo, class_hi, similarity`` between classes.

    A class holds the records with the same set of n-grams (``width`` consecutive words, lower-cased runs of
    letters and digits) and is named by its smallest id; ``copy_id`` is the smallest id with the very same text. Classes are linked if their sets' Jaccard similarity is
    at least ``threshold``; every such link is found. Records with fewer than ``width`` words, null ids and null texts
    are in no class; of an id's repeated rows one counts; other columns are ignored, whatever their names.
    An empty table gives neither. Texts of any length are read whole.
    """
    t = Fraction(threshold)
    spark = rows.sparkSession
    words = _words(rows, id_column, text_column)
    # a tenth as many cells as the texts have characters, which is about as many as they have n-grams
    chars = rows.agg(F.coalesce(F.sum(F.length(text_column)), F.lit(0))).first()[0]
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (int(chars) // 10).bit_length()))
    survey = written(words.mapInArrow(_surveyor(width, cells), "id string, n int, k1 bigint, k2 bigint, copy binary, block int, counts binary"), "neardup-survey")
    words = words.drop("copy")
    table = np.zeros(cells, np.uint8)
    blocks = survey.filter("block is not null").groupBy("block").applyInArrow(_add_counts, "block int, counts binary")
    for r in blocks.toLocalIterator():  # as many bytes as cells
        table[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())
    records = written(survey.filter("id is not null").select("id", "n", "k1", "k2", "copy").distinct(), "neardup-records")
    classes = written(records.groupBy("k1", "k2", "n").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("several")), "neardup-classes")
    if classes.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise RuntimeError("two n-gram sets agree in 64 of 128 bits of their names")
    # most records are alone in their class and with their text: only the others are joined
    copies = records.groupBy("copy").agg(F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("several")).filter("several > 1").drop("several")
    named = lookup(records.select("id", "k1", "copy"), classes.filter("several > 1").select("k1", "class_id"), "k1", F.col("id"))
    named = lookup(written(named.select("id", "class_id", "copy"), "neardup-members"), copies, "copy", F.col("id"))
    membership = written(named.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id")), "neardup-members")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (1 - float(t))) // TASK_POSTINGS + 1)

    posted = words.mapInArrow(_poster(shared, width, t, buckets, PART_POSTINGS), "bucket int, postings binary")
    of_owners = posted.groupBy("bucket").applyInArrow(_owners(t, buckets, CELL_SETS, PART_POSTINGS), "bucket int, postings binary")
    met = of_owners.groupBy("bucket").applyInArrow(_joiner(t), "a bigint, b bigint, na bigint, nb bigint, met bigint")
    met = met.groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    a, b = t.numerator, t.denominator
    need = F.ceil(F.lit(a) * (F.col("na") + F.col("nb")) / F.lit(a + b))
    promised = need - F.ceil(F.lit(a) * F.greatest("na", "nb") / F.lit(b)) + 1
    pairs = written(met.filter(F.col("met") >= F.least(F.lit(MEETINGS), promised)).select("a", "b"), "neardup-pairs")

    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHECKED_SETS).alias("slices"))
    wanted = pairs.join(slices, "a").select(F.col("a").alias("probe"), F.pmod("b", "slices").alias("slice"), F.col("b").alias("k1"))
    probes = slices.select(F.col("a").alias("probe"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), F.col("a").alias("k1"))
    wanted = wanted.unionByName(probes)
    ids = wanted.select("k1").distinct().join(classes.select("k1", "class_id"), "k1").select(F.col("class_id").alias("id"))
    sets = sketch_semi(words, ids, "id").mapInArrow(_sets_of(width), "k1 bigint, members binary")
    held = wanted.join(sets, "k1").withColumn("task", F.pmod(F.xxhash64("probe", "slice"), F.lit(buckets)))
    links = held.groupBy("task").applyInArrow(_checker(t), "a bigint, b bigint, similarity double")
    name = lambda c: classes.select(F.col("k1").alias(c), F.col("class_id").alias(f"id_{c}"))
    links = links.distinct().join(name("a"), "a").join(name("b"), "b")
    return membership, written(links.select(F.least("id_a", "id_b").alias("class_lo"), F.greatest("id_a", "id_b").alias("class_hi"), "similarity"), "neardup-links")


#: Byte-identical texts: up to so many copies are written out as pairs of records; of more each copy is paired with the
#: smallest id among them, which stands for it in pairs with other texts (see similar_classes for all of them).
EXPAND = 200


def similar_pairs(membership: DataFrame, links: DataFrame, expand: int = EXPAND) -> DataFrame:
    """``id_lo, id_hi``: pairs of records, copies included, from the two tables of similar_classes.

    All pairs of different texts come out, whatever the size of their classes; only copies of one text are folded.
    """
    size = membership.groupBy("copy_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = written(lookup(membership, size, "copy_id", F.col("id")), "neardup-copies")
    many = F.coalesce(F.col("n") > expand, F.lit(False))
    shown = sized.filter(~many | (F.col("id") == F.col("copy_id"))).select("class_id", "id")
    lo, hi = shown.select(F.col("class_id").alias("class_lo"), F.col("id").alias("x")), shown.select(F.col("class_id").alias("class_hi"), F.col("id").alias("y"))
    between = pairs_join(links.select("class_lo", "class_hi"), sketch_semi(lo, links, "class_lo"), "class_lo", F.col("class_hi"), F.col("x"))
    between = pairs_join(between, sketch_semi(hi, links, "class_hi"), "class_hi", F.col("x"), F.col("y")).select(F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi"))
    # a class of several has a record that isn't the one that names it
    several = sketch_semi(shown, sized.filter("class_id <> id"), "class_id")
    within = pairs_join(several.select("class_id", F.col("id").alias("id_lo")), several.select("class_id", F.col("id").alias("id_hi")), "class_id", F.col("id_lo"), F.col("id_hi"))
    large = sized.filter(many & (F.col("id") != F.col("copy_id")))
    return between.unionByName(within.filter("id_lo < id_hi").select("id_lo", "id_hi")).unionByName(large.select(F.col("copy_id").alias("id_lo"), F.col("id").alias("id_hi")))


def groups(membership: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, class_id, group_id, n_links``: records that hang together, directly or by others.

    ``group_id`` is the smallest class of the group, ``n_links`` the number of other classes linked to the
    record's own. Labels shrink along links and along labels; each round is written to the shared folder.
    """
    both = links.select(F.col("class_lo").alias("u"), F.col("class_hi").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), "neardup-links")
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    label = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "neardup-labels")
    for _ in range(most_rounds):
        seen = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        step = label.join(seen, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after = written(step.join(jump, "l", "left").select("u", F.coalesce("ll", "l").alias("l"), "was"), "neardup-labels")
        label = after.select("u", "l")
        if not after.filter("l <> was").limit(1).count():
            break
    else:
        raise RuntimeError("groups not settled; raise most_rounds")
    of_class = label.withColumnRenamed("u", "class_id").withColumnRenamed("l", "group_id").join(degree.withColumnRenamed("u", "class_id"), "class_id")
    out = lookup(membership, of_class, "class_id", F.col("id"))
    return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
