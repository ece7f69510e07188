"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: every Arrow batch packs its distinct uni- and bigram hashes with their counts into one
binary row per hash bucket (map-side combine), so the shuffle carries about nine bytes per n-gram
instead of a row.  Buckets are summed with numpy; their number follows the bytes of text
(`BUCKET_BYTES`), so that one fits a worker at every size.

Filter: an n-gram counted c times enters the filter once for each level 1..q with
q = 1 + floor(log2 c).  Its size follows the number of entries at every size of the corpus, so the rate
of false levels stays.  A bucket owns one slice of the bit array, so slices are built side by side.  Up
to `max_bytes`, the bound of what is broadcast, the whole filter goes to every worker; a larger one is
never gathered: the distinct n-grams of each chunk of texts are dealt to the slices by bucket, probed
there, and their levels brought back to the chunk.  Both ways probe the same bits.

Scoring: levels are probed until one is missing, which gives the count back within a factor of two.
P(w | v) = (c(v w) + strength P(w)) / (c(v) + strength): the bigram count, smoothed by the unigram
probability as if `strength` further tokens had followed v.  Beside it the exact add-one-tenth unigram
score: counts of the most frequent words (at most `head_words`, chosen by a count threshold, so that
no other word is frequent) are broadcast as sorted arrays, the rarer tokens are joined with their counts.

Defined results: a null or empty text is the end token alone; rows that repeat a doc_id are scored
and counted one by one; a null doc_id is never held out; with no training token every count is 0; an
untrained unigram score of a corpus without any token is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, discard, map_batches, prepare, release, text_bytes, written
from .textkit import LOWER, SPACE, blocks, mix, span_hashes, spans, stream

END = stream(9, 1)[0]  #: the hash that stands for the end token
UNI, BI = 0, 1
ALPHA = 0.1
PACK_ROWS = 5000  #: documents whose n-grams are combined before they are shuffled
CHUNK_BYTES = 1 << 21  #: text whose n-grams are probed together where the filter is not broadcast
PROBE_KEYS = 1 << 20  #: n-grams that a slice is asked for at once
BUCKET_BYTES = 1 << 22  #: text whose n-grams a bucket holds


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each row closed by the end token, and each row's first token."""
    lower = LOWER[data]
    starts, ends, firsts = spans(lower, offsets, SPACE)
    n = len(offsets) - 1
    out = np.insert(span_hashes(lower, starts, ends), firsts[1:], END)
    return out, firsts + np.arange(n + 1)


def bigrams(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One hash per token: the token with the one before it; the end token stands before a row's first."""
    before = np.r_[END, words[:-1]] if len(words) else words
    before[firsts[:-1]] = END
    return mix(mix(before) + words)



def count_ngrams(docs: DataFrame, buckets: int, text_column: str = "text") -> DataFrame:
    """(kind, bucket, h binary, c binary): per bucket the sorted distinct hashes and their counts, written once."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, PACK_ROWS):
            both: list[list[np.ndarray]] = [[], []]
            for _, _, data, offsets in blocks(batch.column(0).slice(at, PACK_ROWS)):
                words, firsts = tokens(data, offsets)
                both[UNI].append(words)
                both[BI].append(bigrams(words, firsts))
            for kind, parts in enumerate(both):
                values = np.concatenate(parts)
                parts.clear()
                yield _packed(kind, *np.unique(values, return_counts=True), buckets)

    packed = map_batches(docs, [text_column], "kind int, bucket int, h binary, c binary", pack)

    def total(key: tuple, table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("h")])
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("c")])
        values, where = np.unique(h, return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, where, c)
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), "n": [len(values)], "entries": [int(_levels(counts).sum())], "tokens": [int(counts.sum())], "h": pa.array([values.tobytes()], pa.binary()), "c": pa.array([counts.tobytes()], pa.binary())})

    return written(packed.groupBy("kind", "bucket").applyInArrow(total, "kind int, bucket int, n long, entries long, tokens long, h binary, c binary"), "ngram-counts")


def _packed(kind: int, values: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """values are sorted, so that a bucket, their leading bits, is a slice."""
    shift = np.uint64(64 - int(math.log2(buckets)))
    edges = np.searchsorted(values >> shift, np.arange(buckets + 1).astype(np.uint64)) if buckets > 1 else np.array([0, len(values)])
    full = np.flatnonzero(np.diff(edges))
    counts = counts.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(full), kind, np.int32)),
            pa.array(full.astype(np.int32)),
            pa.array([values[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
            pa.array([counts[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        ],
        ["kind", "bucket", "h", "c"],
    )


def _levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)"""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


class Filter:
    """Bits in slices; a key's leading bits choose the slice, so that a bucket of n-grams fills one slice."""

    HASHES = 2

    def __init__(self, slices: int, slice_bits: int, bits: np.ndarray | None = None):
        self.slices, self.slice_bits, self.bits = slices, slice_bits, bits

    def places(self, keys: np.ndarray, kind: int, level: int) -> Iterator[np.ndarray]:
        """Bit numbers within the slice."""
        seed = mix(np.array([kind * 64 + level], np.uint64))[0]
        x = mix(keys ^ seed)
        for k in range(self.HASHES):
            yield (((x >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)) * np.uint64(self.slice_bits)) >> np.uint64(32)

    def slice_of(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - int(math.log2(self.slices))) if self.slices > 1 else np.zeros(len(keys), np.uint64)

    def build(self, grams: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
        """The slice that holds these n-grams (kind, hashes, counts)."""
        flags = np.zeros(self.slice_bits, bool)
        for kind, keys, counts in grams:
            level, top = 1, _levels(counts)
            while len(keys):
                for at in self.places(keys, kind, level):
                    flags[at.astype(np.int64)] = True
                level += 1
                keys, top = keys[top >= level], top[top >= level]
        return np.packbits(flags, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The highest level without a gap below it, by repeated membership probes."""
        out = np.zeros(len(keys), np.int64)
        live, base = np.arange(len(keys)), self.slice_of(keys).astype(np.int64) * self.slice_bits
        for level in range(1, 64):
            inside = np.ones(len(live), bool)
            for at in self.places(keys[live], kind, level):
                bit = base[live] + at.astype(np.int64)
                inside &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            live = live[inside]
            if not len(live):
                break
            out[live] = level
        return out


def estimate(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts, 0 at level 0."""
    return np.where(levels > 0, 0.75 * np.exp2(levels) - 0.5 * (levels == 1), 0.0)


def shape_filter(counted: DataFrame, buckets: int, entry_bits: int = 8) -> Filter:
    """A filter without its bits, of `entry_bits` an entry; each bucket is a slice."""
    entries = counted.agg(F.sum("entries")).first()[0] or 0
    return Filter(buckets, max(64, -(-entries * entry_bits // buckets // 8) * 8))


def build_filter(counted: DataFrame, whole: Filter) -> Filter:
    """Slices are built per bucket on the executors; the driver only lays them side by side."""
    slices = whole.slices

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        grams = [(k.as_py(), np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)) for k, h, c in zip(table.column("kind"), table.column("h"), table.column("c"), strict=True)]
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([whole.build(grams)], pa.binary())})

    rows = counted.select(F.col("bucket").alias("slice"), "kind", "h", "c").groupBy("slice").applyInArrow(fill, "slice int, bits binary").toLocalIterator()
    width = whole.slice_bits // 8
    whole.bits = np.zeros(width * slices, np.uint8)
    for row in rows:
        whole.bits[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return whole


def ask_levels(docs: DataFrame, buckets: int, id_column: str, text_column: str) -> DataFrame:
    """Per chunk of texts its rows (_row, id, text) and the distinct n-grams to be probed (kind, bucket, h), written once."""
    kind = docs.schema[id_column].dataType.simpleString()

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, to, data, offsets in blocks(batch.column(2), CHUNK_BYTES):
            words, firsts = tokens(data, offsets)
            rows = batch.slice(at, to - at)
            chunk = rows.column(0)[0].as_py()
            blank = lambda n, *types: [pa.nulls(n, t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * rows.num_rows, pa.int64()), *rows.columns, *blank(rows.num_rows, pa.int32(), pa.int32(), pa.binary())], names)
            for gram, keys in ((UNI, words), (BI, bigrams(words, firsts))):
                keys = np.unique(keys)
                packed = _packed(gram, keys, np.zeros(len(keys)), buckets)
                n = packed.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), *blank(n, *(c.type for c in rows.columns)), packed.column(0), packed.column(1), packed.column(2)], names)

    names = ["chunk", "_row", id_column, text_column, "kind", "bucket", "h"]
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    return written(map_batches(numbered, ["_row", id_column, text_column], f"chunk long, _row long, {id_column} {kind}, {text_column} string, kind int, bucket int, h binary", ask), "lm-asked")


def probe_slice(table: pa.Table, whole: Filter) -> pa.Table:
    """The levels of a bucket's n-grams for each chunk that asks (c is null), from the bucket's counts (c is not).

    All chunks are probed together, at most PROBE_KEYS keys at once: a chunk has few n-grams in a bucket,
    and one call for each would cost more than its keys.
    """
    held, asks = table.filter(pc.is_valid(table.column("c"))), table.filter(pc.is_null(table.column("c")))
    grams = [(k.as_py(), np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)) for k, h, c in zip(held.column("kind"), held.column("h"), held.column("c"), strict=True)]
    part = Filter(1, whole.slice_bits, np.frombuffer(whole.build(grams), np.uint8))
    out = []
    for kind in (UNI, BI):
        own = asks.filter(pc.equal(asks.column("kind"), kind))
        keys = np.concatenate([_values(x) for x in own.column("h").chunks] or [np.zeros(0, np.uint64)])
        found = np.concatenate([part.levels(keys[at : at + PROBE_KEYS], kind).astype(np.uint8) for at in range(0, len(keys), PROBE_KEYS)] or [np.zeros(0, np.uint8)])
        ends = np.cumsum(np.r_[0, pc.binary_length(own.column("h")).to_numpy() // 8]).astype(np.int32)
        levels = pa.Array.from_buffers(pa.binary(), own.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(found)])
        out.append(own.select(["chunk", "kind", "bucket"]).append_column("levels", levels))
    return pa.concat_tables(out)


def _values(h: pa.BinaryArray) -> np.ndarray:
    """The hashes of all rows, one after the other."""
    if not len(h):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(h.buffers()[1], np.int32)[h.offset : h.offset + len(h) + 1]
    return np.frombuffer(h.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint64)


def join_levels(asked: DataFrame, counted: DataFrame, whole: Filter) -> DataFrame:
    """(chunk, kind, bucket, levels): a byte for each n-gram asked, from the slice that its bucket fills."""

    def probe(table: pa.Table) -> pa.Table:
        return probe_slice(table, whole)

    asks = asked.where(F.col("kind").isNotNull()).select("chunk", "kind", "bucket", "h", F.lit(None).cast("binary").alias("c"))
    sides = asks.unionByName(counted.select(F.lit(None).cast("long").alias("chunk"), "kind", "bucket", "h", "c"))
    return written(sides.groupBy("bucket").applyInArrow(probe, "chunk long, kind int, bucket int, levels binary"), "lm-levels")


class Scorer:
    """What a worker needs: the filter (None where levels are joined), corpus sizes and the counts of frequent words."""

    def __init__(self, grams: Filter | None, n: int, v: int, head: np.ndarray, head_counts: np.ndarray, strength: float):
        self.grams, self.n, self.v, self.head, self.head_counts, self.strength = grams, n, v, head, head_counts, strength

    def log_probability(self, words: np.ndarray, firsts: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 P of each token after the one before it; `levels` of the distinct uni- and bigrams in order, else probed."""
        single, where = np.unique(words, return_inverse=True)
        pairs, pair_at = np.unique(bigrams(words, firsts), return_inverse=True)
        uni, bi = levels or (self.grams.levels(single, UNI), self.grams.levels(pairs, BI))
        count, both = estimate(uni)[where], estimate(bi)[pair_at]
        before = np.r_[0.0, count[:-1]]
        before[firsts[:-1]] = count[firsts[1:] - 1]  # a row's last token is the end token
        unigram = (np.minimum(count, self.n) + ALPHA) / (self.n + ALPHA * (self.v + 1))
        return np.log10((np.minimum(both, before) + self.strength * unigram) / (before + self.strength))

    def frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of the tokens that are in the head, and which tokens are."""
        if not len(self.head):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        inside = self.head[at] == words
        return np.where(inside, self.head_counts[at], 0), inside


def _head(uni: DataFrame, head_words: int) -> tuple[np.ndarray, np.ndarray]:
    """All words counted at least so often that no more than head_words are; counts are compared by their leading 7 bits."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)] or [np.zeros(0, np.int64)])
        low = np.maximum(_levels(c) - 7, 0)
        value, n = np.unique(c >> low << low, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["value", "n"])

    total, least = 0, None
    for r in map_batches(uni, ["c"], "value long, n long", spread).groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("value")).collect():
        total += r["n"]
        if total > head_words:
            break
        least = r["value"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for h, c in zip(batch.column(0), batch.column(1), strict=True):
            h, c = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h[c >= least].tobytes()], pa.binary()), pa.array([c[c >= least].tobytes()], pa.binary())], ["h", "c"])

    found = [(np.frombuffer(bytes(r["h"]), np.uint64), np.frombuffer(bytes(r["c"]), np.int64)) for r in map_batches(uni, ["h", "c"], "h binary, c binary", pick).toLocalIterator()]
    h, c = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(h)
    return h[order], c[order]


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(crc32_text(id_column), F.lit(10)) == 0, F.lit(False))


def score(docs: DataFrame, max_bytes: int = 1 << 28, head_words: int = 1 << 19, strength: float = 20.0, entry_bits: int = 8, buckets: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Trains on the rows that are not held out and scores every row: the contract's columns."""
    spark = docs.sparkSession
    prepare(spark)
    if buckets is None:
        buckets = 1 << max(7, math.ceil(math.log2(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs, text_column)[1] / BUCKET_BYTES))))
    counted = count_ngrams(docs.where(~held_out(id_column)), buckets, text_column)
    uni = counted.where(F.col("kind") == UNI)
    size = uni.agg(F.sum("tokens"), F.sum("n")).first()
    n, v = size[0] or 0, size[1] or 0
    whole = shape_filter(counted, buckets, entry_bits)
    gathered = whole.slices * whole.slice_bits <= max_bytes * 8
    if gathered:
        grams = build_filter(counted, whole)
    else:
        grams, asked = None, ask_levels(docs, buckets, id_column, text_column)
        levels = join_levels(asked, counted, whole)
    uni = written(uni, "unigram-counts")
    discard(counted)
    release(spark)
    held = spark.sparkContext.broadcast(Scorer(grams, n, v, *_head(uni, head_words), strength))
    kind = docs.schema[id_column].dataType.simpleString()
    scale = math.log10(n + ALPHA * (v + 1))
    shift = 64 - int(math.log2(buckets))

    def run(batch: pa.RecordBatch | pa.Table, found: list[np.ndarray] | None = None) -> pa.RecordBatch:
        model = held.value
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("tokens", "known", "base", "score", "rare")}
        rare: list[bytes] = []
        for _, _, data, offsets in blocks(batch.column(1), *([1 << 62] if found else [])):
            words, firsts = tokens(data, offsets)
            count, inside = model.frequent(words)
            add = lambda x: np.add.reduceat(x, firsts[:-1])  # noqa: E731  no row is without its end token
            parts["tokens"].append(np.diff(firsts))
            parts["known"].append(add(inside.astype(np.int64)))
            parts["base"].append(add(np.where(inside, np.log10(count + ALPHA), 0.0)))
            parts["score"].append(add(model.log_probability(words, firsts, found)))
            at = np.flatnonzero(~inside)
            cut = np.searchsorted(at, firsts)
            rest = words[at]
            rare += [rest[cut[r] : cut[r + 1]].tobytes() for r in range(len(firsts) - 1)]
        whole = {k: np.concatenate(x) if x else np.zeros(0) for k, x in parts.items() if k != "rare"}
        return pa.RecordBatch.from_arrays(
            [batch.column(0).combine_chunks() if found else batch.column(0), pa.array(whole["tokens"].astype(np.int64)), pa.array(whole["known"].astype(np.int64)), pa.array(whole["base"].astype(float)), pa.array(whole["score"].astype(float)), pa.array(rare, pa.binary())],
            [id_column, "n_tokens", "known", "base", "score", "rare"],
        )

    def run_chunk(table: pa.Table) -> pa.Table:
        """The rows of a chunk with the levels that its slices gave, whose order is that of the buckets."""
        is_text = pc.is_valid(table.column("_row"))
        texts, given = table.filter(is_text), table.filter(pc.invert(is_text)).sort_by("bucket")
        found = [np.frombuffer(b"".join(x.as_py() for x in given.filter(pc.equal(given.column("kind"), k)).column("levels")), np.uint8).astype(np.int64) for k in (UNI, BI)]
        return pa.Table.from_batches([run(texts.select([id_column, text_column]), found)]).append_column("_row", texts.column("_row"))

    schema = f"{id_column} {kind}, n_tokens long, known long, base double, score double, rare binary"
    if gathered:
        scored = map_batches(docs, [id_column, text_column], schema, run)
        first = written(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    else:
        texts = asked.where(F.col("kind").isNull()).select("chunk", "_row", id_column, text_column)
        both = texts.unionByName(levels, allowMissingColumns=True)
        first = written(both.groupBy("chunk").applyInArrow(run_chunk, f"{schema}, _row long"), "lm-scores")
        discard(asked, levels)
        release(spark)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Per bucket the rare tokens of the batch with their rows."""
        lengths = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in batch.column(1)], np.int64)
        words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)] or [np.zeros(0, np.uint64)])
        rows = np.repeat(batch.column(0).to_numpy(), lengths)
        order = np.argsort(words)
        words, rows = words[order], rows[order]
        edges = np.searchsorted(words >> np.uint64(shift), np.arange(buckets + 1).astype(np.uint64))
        full = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([words[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()), pa.array([rows[edges[b] : edges[b + 1]].astype(np.int64).tobytes() for b in full], pa.binary())],
            ["bucket", "h", "r"],
        )

    asked = map_batches(first, ["_row", "rare"], "bucket int, h binary, r binary", deal)
    sides = asked.select("bucket", "h", "r", F.lit(None).cast("binary").alias("c")).unionByName(uni.select("bucket", "h", F.lit(None).cast("binary").alias("r"), "c"))

    def answer(table: pa.Table) -> pa.Table:
        known, counts, words, rows = (np.zeros(0, t) for t in (np.uint64, np.int64, np.uint64, np.int64))
        asks = []
        for h, r, c in zip(table.column("h"), table.column("r"), table.column("c"), strict=True):
            h = np.frombuffer(h.as_buffer(), np.uint64)
            if c.is_valid:
                known, counts = h, np.frombuffer(c.as_buffer(), np.int64)
            else:
                asks.append((h, np.frombuffer(r.as_buffer(), np.int64)))
        if asks:
            words, rows = np.concatenate([a[0] for a in asks]), np.concatenate([a[1] for a in asks])
        got = np.zeros(len(words), np.int64)
        if len(known) and len(words):
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            got = np.where(known[at] == words, counts[at], 0)
        each, where = np.unique(rows, return_inverse=True)
        return pa.table({"_row": pa.array(each), "more_known": pa.array(np.bincount(where, weights=got > 0, minlength=len(each)).astype(np.int64)), "more_base": pa.array(np.bincount(where, weights=np.log10(got + ALPHA), minlength=len(each)).astype(float))})

    answered = sides.groupBy("bucket").applyInArrow(answer, "_row long, more_known long, more_base double").groupBy("_row").agg(F.sum("more_known").alias("more_known"), F.sum("more_base").alias("more_base"))
    joined = first.drop("rare").join(answered, "_row", "left")
    return joined.select(
        id_column,
        held_out(id_column).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
