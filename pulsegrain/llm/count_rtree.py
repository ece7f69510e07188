"""N-gram Jaccard join over a count-vector R-tree.

A document's set holds its distinct shingles.  Shingles are hashed into `GROUPS` groups; the counts
per group are a point.  Two sets share at most the sum of their coordinate minima, and points bounded
by boxes share at most the sum of the boxes' upper minima, so that an R-tree over the points discards
almost every pair that is too far apart; the pairs that survive are verified on the sets themselves.

Spread over a cluster without losing a pair:

1. Equal sets are one node.
2. Any two similar sets share a shingle among the first n - ceil(0.85 n) + 1 of each in one global
   order (prefix filter), so each node is dealt to the trees of those shingles only.  The order puts
   shingles that are frequent in a bounded sample last; it decides the cost, never the result.
3. In trees with more than `STAR` nodes, a few rounds try one pivot on one node of every other
   component and contract the verified links, so that a group of copies costs a few pairs per node.
4. What is still in different components meets in the trees.  A tree of more than `BLOCK` nodes is
   dealt by bands of size, as linked sets are of similar size, and a band of more than `BLOCK` nodes
   in blocks that are joined block by block.
5. Components are found by alternating large-star and small-star steps, each written out.

Defined results: null and empty texts, and texts without words, have an empty set, no links and
themselves as component; texts with fewer words than a shingle have one shingle; a null doc_id takes
part in links but is never a component's id while another is known; repeated rows and repeated ids
are linked as the texts they hold; other columns are not read.  keep_one() decides row by row: of
each component one row stays, the one with the smallest id (a null id comes last).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, prepare, release, text_bytes, trim, unused, written
from .textkit import LOWER, SPACE, blocks, gram_hashes, mix, span_hashes, spans

GROUPS, FINEST = 64, 1024
STAR, BLOCK, FANOUT, ROUNDS = 64, 4096, 8, 5
BITMAP = 1 << 23
LISTED = 32  #: keys of large trees that a row carries, to tell a pair once
PART_BYTES = 1 << 24  #: text whose shingles are counted together


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows and each row's first one."""
    lower = LOWER[data]
    starts, ends, firsts = spans(lower, offsets, SPACE)
    tokens = span_hashes(lower, starts, ends)
    length = np.diff(firsts)
    grams, at = gram_hashes(tokens, firsts, words)
    rows = np.searchsorted(firsts, at, "right") - 1
    few = np.flatnonzero((length > 0) & (length < words))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            on = length[few] > k
            short[on] = mix(short[on] + np.uint64(k + 11)) + tokens[firsts[few[on]] + k]
        grams = np.r_[grams, mix(short)]
        rows = np.r_[rows, few]
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    if len(grams):
        keep = np.r_[True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])]
        grams, rows = grams[keep], rows[keep]
    return grams, np.searchsorted(rows, np.arange(len(offsets)))


def points(grams: np.ndarray, cuts: np.ndarray, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Upper counts per group in steps of a scale per row, both as bytes: count <= step x scale."""
    n = len(cuts) - 1
    row = np.repeat(np.arange(n), np.diff(cuts))
    count = np.bincount(row * groups + (grams & np.uint64(groups - 1)).astype(np.int64), minlength=n * groups).reshape(n, groups)
    scale = np.maximum(1, -(-count.max(axis=1, initial=0) // 255))
    return (-(-count // scale[:, None])).astype(np.uint8), scale.astype(np.int64)


def fine_points(grams: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Finer points of larger sets: at least a quarter as many groups as shingles, up to FINEST."""
    size = np.diff(cuts)
    groups = GROUPS << np.clip(np.ceil(np.log2(np.maximum(size, 1) / (4 * GROUPS))), 0, int(np.log2(FINEST // GROUPS))).astype(int)
    out, scales = [b""] * len(size), np.ones(len(size), np.int64)
    for g in np.unique(groups).tolist():
        rows = np.flatnonzero(groups == g)
        part = grams[np.repeat(groups == g, size)]
        vec, scale = points(part, np.r_[0, np.cumsum(size[rows])], g)
        scales[rows] = scale
        for r, v in zip(rows.tolist(), vec, strict=True):
            out[r] = v.tobytes()
    return out, scales


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """Upper bound of the intersection of two points, the finer one folded onto the groups of the other."""
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)


def _most_shared(size_a, size_b, percent: int):
    """Smallest intersection of a linked pair of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def _dealt(values: np.ndarray, bits: int) -> pa.RecordBatch:
    """The distinct values with their counts, one packed row for each of 2 ** bits parts (map-side combine)."""
    values, counts = np.unique(values, return_counts=True)
    counts = counts.astype(np.uint32)
    edges = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
    full = np.flatnonzero(np.diff(edges))
    cut = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cut(values), cut(counts)], ["part", "h", "c"])


def _counted(least: int):
    """Sums a part's packed rows; keeps the values counted at least so often."""

    def merge(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("h")])
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("c")])
        order = np.argsort(h)
        h, c = h[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.add.reduceat(c, first)
        keep = total >= least
        return pa.table({"h": pa.array(h[first][keep].view(np.int64)), "c": pa.array(total[keep])})

    return merge


def _places(batch: pa.RecordBatch, names: list[str], bits: int) -> np.ndarray:
    total = np.zeros(batch.num_rows, np.uint64)
    for name in names:
        total = mix(total + _column(batch, name).view(np.uint64))
    return (total & np.uint64(bits - 1)).astype(np.int64)


class Bitmap:
    """A set of rows as a bit table of fixed size; more rows only mean more false answers of yes."""

    def __init__(self, rows: DataFrame, names: list[str], bits: int):
        self.names, self.bits, parts = names, bits, 64

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags, any_ = np.zeros(bits, bool), False
            for batch in batches:
                flags[_places(batch, names, bits)] = any_ = True
            if any_:
                packed = np.packbits(flags).reshape(parts, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([x.tobytes() for x in packed], pa.binary())], ["part", "bits"])

        def merge(table: pa.Table) -> pa.Table:
            joined = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([joined.tobytes()], pa.binary())})

        self.flags = np.zeros((parts, bits // 8 // parts), np.uint8)
        for r in rows.select(*names).mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
            self.flags[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.flags = self.flags.ravel()

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.flags[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


def _part_bits(size: int, least: int) -> int:
    """Bits of the number of parts that so many bytes of text are counted in."""
    return max(least, math.ceil(math.log2(max(1, size / PART_BYTES))))


def _frequent(docs: DataFrame, words: int, sample_docs: int, most: int, total: int, size: int, id_column: str, text_column: str) -> np.ndarray:
    """Hashes of the shingles that are most frequent in the sample, rarest first."""
    share = max(1, -(-total // sample_docs))
    bits = _part_bits(size // share, 6)
    sample = docs.where(F.pmod(F.xxhash64(id_column), F.lit(share)) == 0) if share > 1 else docs

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_sets(data, offsets, words)[0] for _, _, data, offsets in blocks(batch.column(0))]
        yield _dealt(np.concatenate(sets) if sets else np.zeros(0, np.uint64), bits)

    found = map_batches(sample, [text_column], "part int, h binary, c binary", count).groupBy("part").applyInArrow(_counted(3), "h long, c long")
    top = found.orderBy(F.desc("c"), "h").limit(most).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def _nodes(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    by_hash = np.argsort(frequent)
    sorted_hash = frequent[by_hash]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            grams, cuts = shingle_sets(data, offsets, words)
            size = np.diff(cuts)
            rows = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(grams), np.int64)
            if len(sorted_hash):
                at = np.minimum(np.searchsorted(sorted_hash, grams), len(sorted_hash) - 1)
                rank = np.where(sorted_hash[at] == grams, by_hash[at] + 1, 0)
            order = np.lexsort((grams, rank, rows))
            nth = np.arange(len(grams)) - np.repeat(cuts[:-1], size)
            first = order[nth < np.repeat(_prefix(size, percent), size)]
            key_cuts = np.r_[0, np.cumsum(_prefix(size, percent))]
            keys = grams[first]
            node = np.zeros(len(size), np.uint64)
            np.add.at(node, rows, mix(grams))
            fine, fine_scale = fine_points(grams, cuts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(2).slice(lo, hi - lo),
                    pa.array(size.astype(np.int64)),
                    pa.array(mix(node + size.astype(np.uint64)).view(np.int64)),
                    pa.array(fine, pa.binary()),
                    pa.array(fine_scale),
                    pa.array([keys[key_cuts[r] : key_cuts[r + 1]].tobytes() for r in range(len(size))], pa.binary()),
                    pa.array([grams[cuts[r] : cuts[r + 1]].tobytes() for r in range(len(size))], pa.binary()),
                ],
                [id_column, "version", "size", "node", "fine", "fine_scale", "keys", "grams"],
            )

    rows = docs.select(id_column, text_column, F.xxhash64(text_column).alias("version"))
    return map_batches(rows, [id_column, text_column, "version"], f"{id_column} {kind}, version long, size long, node long, fine binary, fine_scale long, keys binary, grams binary", run)


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


class Points:
    """The points of a batch: a matrix for each number of groups, and all of them folded onto GROUPS groups."""

    def __init__(self, batch: pa.RecordBatch):
        raw, scale = [x.as_buffer().to_pybytes() for x in batch.column("fine")], _column(batch, "fine_scale").astype(np.int32)
        self.groups = np.array([len(x) for x in raw], np.int64)
        self.coarse = np.zeros((len(raw), GROUPS), np.int32)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in np.unique(self.groups).tolist():
            rows = np.flatnonzero(self.groups == g)
            matrix = np.frombuffer(b"".join(raw[r] for r in rows.tolist()), np.uint8).reshape(-1, g).astype(np.int32) * scale[rows][:, None]
            self.parts[g] = rows, matrix
            self.coarse[rows] = self._folded(matrix, GROUPS)

    @staticmethod
    def _folded(matrix: np.ndarray, groups: int) -> np.ndarray:
        return matrix.reshape(len(matrix), matrix.shape[1] // groups, groups).sum(axis=1)

    def allowed(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which pairs the finest groups that both points have still allow."""
        out = np.ones(len(a), bool)
        shared = np.minimum(self.groups[a], self.groups[b])
        for g in np.unique(shared).tolist():
            if g == GROUPS:
                continue
            pick = np.flatnonzero(shared == g)
            place, folded = np.full(len(self.groups), -1), []
            need = np.zeros(len(self.groups), bool)
            need[a[pick]] = need[b[pick]] = True
            for size, (rows, matrix) in self.parts.items():
                if size >= g:
                    wanted = need[rows]
                    place[rows[wanted]] = np.arange(int(wanted.sum())) + sum(len(x) for x in folded)
                    folded.append(self._folded(matrix[wanted], g))
            whole, step = np.concatenate(folded), max(1, (1 << 21) // g)
            for k in range(0, len(pick), step):
                part = pick[k : k + step]
                out[part] = np.minimum(whole[place[a[part]]], whole[place[b[part]]]).sum(axis=1) >= least[part]
        return out


class Tree:
    """Bulk-loaded R-tree: levels of boxes over runs of FANOUT, each with upper counts, sizes and components."""

    def __init__(self, vec: np.ndarray, size: np.ndarray, comp: np.ndarray):
        order = np.arange(len(vec))
        runs = [order]
        while max(len(r) for r in runs) > FANOUT:
            cut = []
            for r in runs:
                if len(r) <= FANOUT:
                    cut.append(r)
                    continue
                spread = vec[r].max(axis=0) - vec[r].min(axis=0)
                by = size[r] if size[r].max() > 1.2 * size[r].min() else vec[r, int(spread.argmax())]
                r = r[np.argsort(by, kind="stable")]
                half = FANOUT * -(-len(r) // (2 * FANOUT))
                cut += [r[:half], r[half:]]
            runs = cut
        self.order = np.concatenate(runs)
        vec, size, comp = vec[self.order], size[self.order], comp[self.order]
        self.levels = [(vec, size, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            vec, size, low, high = self.levels[-1]
            at = np.arange(0, len(vec), FANOUT)
            self.levels.append((np.maximum.reduceat(vec, at), np.minimum.reduceat(size, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def join(self, other: Tree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points in different components whose bound allows a link."""
        a = b = np.zeros(1, np.int64)
        top = max(len(self.levels), len(other.levels))
        for level in range(top - 1, -1, -1):
            la, lb = min(level, len(self.levels) - 1), min(level, len(other.levels) - 1)
            if level < top - 1:
                if la < len(self.levels) - 1:
                    a, b = self._down(a, b, len(self.levels[la][0]))
                if lb < len(other.levels) - 1:
                    b, a = other._down(b, a, len(other.levels[lb][0]))
            if same:
                keep = a <= b if level else a < b
                a, b = a[keep], b[keep]
            kept = [self._allowed(other, la, lb, a[k : k + 65536], b[k : k + 65536], percent) for k in range(0, len(a), 65536)]
            keep = np.concatenate(kept) if kept else np.zeros(0, bool)
            a, b = a[keep], b[keep]
        return self.order[a], other.order[b]

    def _allowed(self, other: Tree, la: int, lb: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        va, sa, low_a, high_a = self.levels[la]
        vb, sb, low_b, high_b = other.levels[lb]
        apart = (low_a[a] != high_b[b]) | (high_a[a] != low_b[b])
        return apart & (np.minimum(va[a], vb[b]).sum(axis=1) >= _most_shared(sa[a], sb[b], percent))

    @staticmethod
    def _down(a: np.ndarray, b: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        child = (a[:, None] * FANOUT + np.arange(FANOUT)[None, :]).ravel()
        fits = child < below
        return child[fits], np.repeat(b, FANOUT)[fits]


def _least_common(large: pa.Array, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether to tell the pair under its key: not where both rows list a smaller key of a large tree.

    A row lists its LISTED smallest ones.  The least key that two lists share is the least that the rows
    share; lists that share none say nothing, and the pair is told under each of its keys.
    """
    out = np.ones(len(a), bool)
    held: dict[int, frozenset | None] = {}

    def keys(row: int) -> frozenset | None:
        if row not in held:
            value = large[row].as_py()
            held[row] = None if value is None else frozenset(value)
        return held[row]

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        one, two = keys(x), keys(y)
        if one is not None and two is not None:
            out[k] = min(one & two, default=key[x]) == key[x]
    return out


def _tree_join(percent: int):
    """Joins the rows of one tree key: batches come sorted by (key, block a, block b), trees may span batches."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for name in ("key", "i", "j"):
                v = _column(batch, name)
                change[1:] |= v[1:] != v[:-1]
            last = int(np.flatnonzero(change)[-1]) if change.any() else 0
            fresh = bool(held) and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("key", "i", "j"))
            if fresh:
                yield pa.Table.from_batches(held)
                held = []
            if last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            batch = table.combine_chunks().to_batches(max_chunksize=1 << 30)[0]
            key, i, j, block, told_key, guest = (_column(batch, c) for c in ("key", "i", "j", "block", "tree", "guest"))
            node, size, comp, fine = _column(batch, "node"), _column(batch, "size"), _column(batch, "comp"), Points(batch)
            vec = fine.coarse
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            count = np.diff(np.r_[start, len(key)])
            found_a, found_b = [], []
            small = np.repeat(count <= 2 * FANOUT, count)
            place = np.arange(len(key)) - np.repeat(start, count)
            whole = np.repeat(i[start] == j[start], count)
            rest = np.repeat(count, count) - place
            for d in range(1, 2 * FANOUT):  # small trees are a single box: their points are compared at once
                at = np.flatnonzero(small & whole & (rest > d))
                if not len(at):
                    break
                at = at[comp[at] != comp[at + d]]
                at = at[np.minimum(vec[at], vec[at + d]).sum(axis=1) >= _most_shared(size[at], size[at + d], percent)]
                found_a.append(at)
                found_b.append(at + d)
            for g in np.flatnonzero((count > 2 * FANOUT) | ~whole[start]):
                rows = np.arange(start[g], start[g] + count[g])
                if i[start[g]] == j[start[g]]:
                    tree = Tree(vec[rows], size[rows], comp[rows])
                    a, b = tree.join(tree, percent, True)
                    found_a.append(rows[a])
                    found_b.append(rows[b])
                else:
                    one, two = rows[block[rows] == i[start[g]]], rows[block[rows] == j[start[g]]]
                    if len(one) and len(two):
                        a, b = Tree(vec[one], size[one], comp[one]).join(Tree(vec[two], size[two], comp[two]), percent, False)
                        found_a.append(one[a])
                        found_b.append(two[b])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                fits = fine.allowed(a, b, _most_shared(size[a], size[b], percent))
                fits &= ~(guest[a] & guest[b])
                a, b = a[fits], b[fits]
                told = _least_common(batch.column("large"), told_key, a, b)
                a, b = node[a[told]], node[b[told]]
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                trim()
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, label: str, id_column: str) -> DataFrame:
    """The pairs (a < b) that are linked: bound first, then the sets themselves."""
    light = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("fine").alias(f"fine_{s}"), F.col("fine_scale").alias(f"scale_{s}"))
    near = pairs.join(light("a"), "a").join(light("b"), "b").where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)

    def bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = _most_shared(_column(batch, "size_a"), _column(batch, "size_b"), percent)
        point = lambda s: ((np.frombuffer(v.as_buffer(), np.uint8).astype(np.int32) * k) for v, k in zip(batch.column(f"fine_{s}"), _column(batch, f"scale_{s}").tolist(), strict=True))
        fits = [most_common(x, y) >= n for x, y, n in zip(point("a"), point("b"), least.tolist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = written(map_batches(near, ["a", "b", "size_a", "size_b", "fine_a", "fine_b", "scale_a", "scale_b"], "a long, b long", bounded), f"{label}-bounded")
    wanted = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node")))
    some = _only(sets, wanted.distinct().join(nodes.select("node", "rep"), "node").select("node", F.xxhash64("rep").alias("doc")), id_column)
    both = left.join(some.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a").join(some.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(map_batches(both, ["a", "b", "grams_a", "grams_b"], "a long, b long", exact), f"{label}-links")
    discard(left)
    return links


def _only(sets: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """The sets of the wanted (node, document), one per node: a bitmap of fixed size spares shuffling the others."""
    held = sets.sparkSession.sparkContext.broadcast(Bitmap(wanted, ["node", "doc"], BITMAP))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select(["node", "grams"]).filter(pa.array(held.value.has(_places(batch, ["node", "doc"], BITMAP))))

    return map_batches(_with_doc(sets, id_column), ["node", "grams", "doc"], "node long, grams binary", keep).dropDuplicates(["node"])


def _with_doc(sets: DataFrame, id_column: str) -> DataFrame:
    return sets.where("size > 0").withColumn("doc", F.xxhash64(id_column))


def _trees(sets: DataFrame, nodes: DataFrame, bits: int, id_column: str) -> DataFrame:
    """(key, node, n): the prefix shingles that several nodes share, and how many do.

    Bitmaps of fixed size stop the repeated texts and the shingles of one node before the shuffle; what
    slips through repeats a row or is dropped by the join.
    """
    context = sets.sparkSession.sparkContext
    reps = context.broadcast(Bitmap(nodes.select("node", F.xxhash64("rep").alias("doc")), ["node", "doc"], BITMAP))
    rows = _with_doc(sets, id_column)

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        batch = batch.filter(pa.array(reps.value.has(_places(batch, ["node", "doc"], BITMAP))))
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("keys")]
        return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.repeat(_column(batch, "node"), [len(k) for k in keys])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _dealt(keys_of(batch)[0], bits)

    counted = map_batches(rows, ["node", "doc", "keys"], "part int, h binary, c binary", count).groupBy("part").applyInArrow(_counted(2), "h long, c long")
    shared = written(counted.select(F.col("h").alias("key"), F.col("c").alias("n")), "rtree-keys")
    wanted = context.broadcast(Bitmap(shared, ["key"], 4 * BITMAP))

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, node = keys_of(batch)
        out = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node)], ["key", "node"])
        return out.filter(pa.array(wanted.value.has(_places(out, ["key"], 4 * BITMAP))))

    trees = written(map_batches(rows, ["node", "doc", "keys"], "key long, node long", unpack).join(shared, "key"), "rtree-trees")
    discard(shared)
    return trees


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, comp) of every linked node: comp is the smallest node reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{label}-edges")
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), f"{label}-components")
    discard(edges)
    return out


def _stars(trees: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, id_column: str, made: list[DataFrame]) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(tables of links, tried pairs, labels) of a few rounds in which each tree tries one pivot on one node of every other component.

    A round costs at most one pair per row.  The first pivot is the node with the most large trees, later
    ones are of the tree's largest component; nodes are drawn anew each round.
    """
    spark = nodes.sparkSession
    pair, label = "a long, b long", "node long, comp long"
    tried, labels = (spark.createDataFrame([], x) for x in (pair, label))
    links: list[DataFrame] = []
    degree = trees.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    for turn in range(ROUNDS):
        named = trees.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if turn:
            spots = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("weight"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
        else:
            spots = named.join(degree, "node")
        spots = written(spots.select("key", "comp", "node", "weight"), "rtree-spots")
        pivots = written(spots.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("weight", F.xxhash64("node"))).alias("p"), F.count(F.lit(1)).alias("spots")).where("spots > 1").select("key", "p"), "rtree-pivots")
        asked = spots.join(pivots, "key").where(F.col("comp") != F.col("p.comp")).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        asked = written(asked.join(tried, ["a", "b"], "left_anti"), "rtree-asked")
        links.append(_verified(asked, nodes, sets, percent, f"rtree-star{turn}", id_column))
        tried = tried.unionByName(asked)
        discard(spots)
        made += [pivots, asked]
        n = links[-1].count()
        if n:
            labels = components(_union(links), f"rtree-star{turn}")
            made.append(labels)
        if n < 50 and turn:
            break
        trees = trees.join(pivots.select("key"), "key", "left_semi")
    return links, tried, labels


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for part in tables[1:]:
        out = out.unionByName(part)
    return out


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of trees that are too large for one task: by bands of size, and those in blocks.

    Linked sets are in the same band or in neighbouring ones: each row is in its own band's group and
    a guest in the next one's, where guests do not meet guests.
    """
    band = F.floor(F.log(F.col("size")) / (math.log(100 / percent) * (1 + 1e-6))) if percent < 100 else F.col("size")
    dealt = rows.withColumn("band", band).withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("key", F.xxhash64("tree", F.col("band") + F.col("guest").cast("int")))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("guest")).alias("own")).where("own > 0 AND n > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    placed = dealt.join(sizes.select("key", parts.alias("parts")), "key").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "guest", *rows.columns)


def join(docs: DataFrame, words: int = 4, percent: int = 85, sample_docs: int = 20_000, frequent_shingles: int = 1 << 16, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): members (id, version of the text, size, node), classes (node, comp, component_id), spanning links (a, b) between nodes."""
    prepare(docs.sparkSession)
    total, size = text_bytes(docs, text_column)
    frequent = _frequent(docs, words, sample_docs, frequent_shingles, total, size, id_column, text_column)
    sets = written(_nodes(docs, words, percent, frequent, id_column, text_column), "rtree-sets")
    nodes = written(sets.where("size > 0").groupBy("node").agg(F.min(id_column).alias("rep"), F.first("size").alias("size"), F.first("fine").alias("fine"), F.first("fine_scale").alias("fine_scale")), "rtree-nodes")
    trees = _trees(sets, nodes, _part_bits(size, 9), id_column)
    release(docs.sparkSession)
    made: list[DataFrame] = []
    parts, tried, labels = _stars(trees.where(F.col("n") > STAR).select("key", "node"), nodes, sets, percent, id_column, made)
    known = written(nodes.select("node", "size", "fine", "fine_scale").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "rtree-labelled")
    # a tree with one component, or of two nodes whose sizes are too far apart, needs no join; told by a small aggregate
    bounds = trees.join(known.select("node", "comp", "size"), "node").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least"), F.max("size").alias("most"), F.first("n").alias("n"))
    open_ = written(bounds.where((F.col("lo") != F.col("hi")) & ((F.col("n") > 2) | (F.col("least") * 100 >= F.col("most") * percent))).select("key"), "rtree-open")
    placed = trees.join(open_, "key").join(known, "node").withColumnRenamed("key", "tree")
    # in a large tree a pair is told only under the least key of the large trees that both nodes are in
    # (a pair in different components finds all its common trees open; rows are dealt by node here already)
    many = F.col("n") > 2 * FANOUT
    own = Window.partitionBy("node")
    placed = placed.withColumn("nth", F.row_number().over(own.orderBy(~many, "tree"))).withColumn("large", F.when(many, F.collect_list(F.when(many & (F.col("nth") <= LISTED), F.col("tree"))).over(own)))
    columns = ["tree", "node", "size", "fine", "fine_scale", "comp", "large"]
    whole = placed.where(F.col("n") <= BLOCK).select(F.col("tree").alias("key"), *(F.lit(0).alias(c) for c in ("i", "j", "block")), F.lit(False).alias("guest"), *columns)
    met = whole.unionByName(_banded(placed.where(F.col("n") > BLOCK).select(*columns), percent))
    release(docs.sparkSession)
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_tree_join(percent), "a long, b long").distinct()
    met = written(met.join(tried, ["a", "b"], "left_anti"), "rtree-met")
    discard(trees, open_, known)
    release(docs.sparkSession)
    parts.append(_verified(met, nodes, sets, percent, "rtree-join", id_column))
    links = _union(parts)
    links.parts = parts
    found = components(links, "rtree-all")
    tagged = nodes.select("node", "rep").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = tagged.groupBy("comp").agg(F.min("rep").alias("component_id"))
    classes = written(tagged.join(least, "comp").select("node", "comp", "component_id"), "rtree-classes")
    members = written(sets.select(id_column, "version", "size", "node"), "rtree-members")
    discard(sets, nodes, met, found, *made)
    release(docs.sparkSession)
    return members, classes, links


def classify(docs: DataFrame, id_column: str = "doc_id", **options: int) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    members, classes, links = join(docs, id_column=id_column, **options)
    discard(*links.parts)
    alone = members.where("size = 0").select(id_column, F.lit(0).cast("long").alias("n_shingles"), F.col(id_column).alias("component_id"))
    return members.where("size > 0").join(classes, "node").select(id_column, F.col("size").alias("n_shingles"), "component_id").unionByName(alone)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """The rows, of each group of linked ones only the one with the smallest id; a tie is broken by the text's hash."""
    members, classes, links = join(docs, id_column=id_column, text_column=text_column, **options)
    discard(*links.parts)
    own, version = unused(docs, "_id"), unused(docs, "_version")
    rows = members.where("size > 0").join(classes, "node").select("comp", F.col(id_column).alias("id"), "version")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version"))
    held = rows.groupBy("comp").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = rows.join(held, "comp").groupBy("comp", "id", "version").agg(F.first("f").alias("f"), F.count(F.lit(1)).alias("times"))
    stays = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("version") == F.col("f.version"))
    judged = written(several.where(~stays | (F.col("times") > 1)).select(F.col("id").alias(own), F.col("version").alias(version), stays.alias("stays")), "rtree-judged")
    discard(members, classes)
    numbered = docs.withColumn(version, F.xxhash64(text_column))
    same = lambda part: numbered[id_column].eqNullSafe(part[own]) & (numbered[version] == part[version])
    # of rows that repeat both id and text of the one that stays, any stays
    repeated = judged.where("stays")
    kept = numbered.join(repeated, same(repeated), "left_semi").dropDuplicates([id_column, version])
    return numbered.join(judged, same(judged), "left_anti").unionByName(kept).drop(version)


#: All pairs that share a shingle, counted; components as the transitive closure of the links.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 3], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r < b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
z AS (SELECT r AS a, r AS b FROM d UNION SELECT z.a, e.b FROM z JOIN e ON e.a = z.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT z.a AS r, min(o.doc_id) AS c FROM z JOIN d o ON o.r = z.b GROUP BY z.a) m USING (r)
"""
