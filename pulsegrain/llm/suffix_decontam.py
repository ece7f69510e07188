"""Benchmark decontamination with suffix arrays over the training documents.

Documents are shards of about a megabyte.  Each shard gets a suffix array over its words; only suffixes
whose first two words begin some benchmark suffix are in it, as no other can hold a match.  Every
suffix of every benchmark item is binary-searched in it, word by word; the places that share at least
`window` words with it (or the whole of a shorter item) are followed to where the texts part, which
gives the longest verbatim matches with their places in document and item.  Document words inside a
match are hit, and affected documents are removed.

A window is `window` consecutive words of an item; an item with fewer words, but some, is one
window.  Words are runs of letters and digits after A-Z are lower-cased; bytes from 0x80 on belong
to words.  The benchmark is read in blocks of `block_chars`, so that what travels to the workers has a
proven bound; with k blocks the documents are searched k times.

Defined results: null and empty texts have no words, no matches and are clean; a document's words never
join with the next document's; repeated rows give repeated results, and every row is judged by its own
text whatever its id; a repeated item_id counts once per document; null item ids are left out of the
list of items but their matches count; other columns are not read, and stay as they are in
remove_contaminated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, unused, written
from .textkit import LOWER, NON_WORD, blocks, mix, row_of, span_hashes, spans

BLOCK_CHARS = 8 << 20  #: most benchmark text that is sent to the workers at once
PAIRS = 1 << 18  #: places of test suffixes that are looked at together
MATCHES = "array<struct<at:long,length:long,item:string,item_at:long>>"


class TestSuffixes:
    """A benchmark block: word hashes and, for each suffix that can hold a match, its item and the words it needs."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        words, length = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in blocks(pa.array([text for _, text in items], pa.large_string())):
            data = LOWER[data]
            starts, ends, firsts = spans(data, offsets, NON_WORD)
            words.append(span_hashes(data, starts, ends))
            length.append(np.diff(firsts))
        self.words, length = np.concatenate(words), np.concatenate(length)
        item = np.repeat(np.arange(len(length)), length)
        first = (np.cumsum(length) - length)[item]
        self.left = first + length[item] - np.arange(len(item))  # words to the end of the item
        need = np.minimum(length, window)[item]
        self.start = np.flatnonzero(self.left >= need)  # later suffixes are shorter than any window
        self.item, self.need, self.first = item[self.start], need[self.start], first[self.start]
        two = self.need >= 2
        self.head = np.zeros(len(self.start), np.uint64)  # first two words; 0 where one is all
        self.head[two] = mix(self.words[self.start[two]]) + self.words[self.start[two] + 1]
        self.pairs = np.unique(self.head[two])
        self.single = np.unique(self.words[self.start[self.need == 1]])


class Shard:
    """Words of some documents and their suffix array."""

    def __init__(self, tests: TestSuffixes, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, self.firsts = spans(data, offsets, NON_WORD)
        self.tests, self.words = tests, span_hashes(data, starts, ends)
        self.left = np.repeat(self.firsts[1:], np.diff(self.firsts)) - np.arange(len(self.words))  # words to the end of the row
        self.padded = np.r_[self.words, np.zeros(tests.window + 1, np.uint64)]
        keep = np.zeros(len(self.words), bool)
        if len(self.words):
            keep = np.r_[_among(mix(self.words[:-1]) + self.words[1:], tests.pairs), False] & (self.left >= 2)
            if len(tests.single):
                keep |= _among(self.words, tests.single)
        at = np.flatnonzero(keep)
        self.suffix = at[np.lexsort([self.word(at, d) for d in range(tests.window - 1, -1, -1)])]

    def word(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The depth-th word of suffixes; 0 past the end of the row, below every word."""
        out = self.padded[at + depth]
        out[self.left[at] <= depth] = 0
        return out

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per test suffix found: its number and the range of the suffix array that shares the words it needs."""
        tests = self.tests
        low, high = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), len(self.suffix))
        live = np.zeros(0, np.int64)
        if len(self.suffix):  # a test suffix whose first two words no suffix begins with is not searched further
            first = np.unique(mix(self.padded[self.suffix]) + self.padded[self.suffix + 1])
            live = np.flatnonzero((tests.need == 1) | _among(tests.head, first))
        high[np.setdiff1d(np.arange(len(high)), live, assume_unique=True)] = 0
        for depth in range(tests.window):
            live = live[(tests.need[live] > depth) & (high[live] > low[live])]
            if not len(live):
                break
            goal, column = tests.words[tests.start[live] + depth], self.word(self.suffix, depth)
            low[live] = _bisect(column, goal, low[live], high[live], False)
            high[live] = _bisect(column, goal, low[live], high[live], True)
        found = np.flatnonzero(high > low) if len(self.suffix) else live
        return found, low[found], high[found]

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches: (test suffix, place, words), none of which can be extended at either end."""
        tests = self.tests
        found, low, high = self.search()
        out = [(np.zeros(0, np.int64),) * 3]
        while len(found):
            take = max(1, int(np.searchsorted(np.cumsum(high - low), PAIRS, "right")))
            size = np.minimum(high[:take] - low[:take], PAIRS)  # a longer range is taken in several turns
            test = np.repeat(found[:take], size)
            place = self.suffix[np.repeat(low[:take] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            at = tests.start[test]
            # a match that also holds the words before is found from there
            begins = (at == tests.first[test]) | np.r_[True, self.left[:-1] == 1][place] | (tests.words[at - 1] != self.padded[place - 1])
            test, place = test[begins], place[begins]
            out.append((test, place, self._follow(test, place)))
            low = low.copy()
            low[:take] += size
            left = high > low
            found, low, high = found[left], low[left], high[left]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _follow(self, test: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many words the texts share from there on."""
        tests = self.tests
        length = tests.need[test].copy()
        most = np.minimum(self.left[place], tests.left[tests.start[test]])
        live = np.flatnonzero(most > length)
        while len(live):
            live = live[tests.words[tests.start[test[live]] + length[live]] == self.words[place[live] + length[live]]]
            length[live] += 1
            live = live[most[live] > length[live]]
        return length


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array; a bit table of fixed size spares most searches."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    bits = np.zeros(1 << 20, bool)
    bits[(ordered >> np.uint64(44)).astype(np.int64)] = True
    out = bits[(values >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    spot = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    out[at] = ordered[spot] == values[at]
    return out


def _bisect(column: np.ndarray, goal: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        up = column[mid] <= goal[open_] if after else column[mid] < goal[open_]
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]


def _benchmark_blocks(benchmark: DataFrame, item_column: str, text_column: str, block_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded text, each held by the driver alone; longer items are a block.  At least one."""
    rows, size = [], 0
    for row in benchmark.select(F.col(item_column).cast("string").alias("i"), F.col(text_column).alias("t")).toLocalIterator():
        text = row["t"] or ""
        if rows and size + len(text) > block_chars:
            yield rows
            rows, size = [], 0
        rows.append((row["i"], text))
        size += len(text)
    yield rows


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row: id, n_words and the longest matches (at, length, item, item_at; all in words).

    One block is searched after the other, the rows with their texts written in between, so that a worker
    holds one block at a time.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(MATCHES).alias("matches"))

    def search(rows: DataFrame, items: list[tuple[str | None, str]], last: bool) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))
        names = ["id", *([] if last else ["text"]), "n_words", "matches"]

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            tests = held.value
            item_names = pa.array(tests.names, pa.string())
            for lo, hi, data, offsets in blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                shard = Shard(tests, data, offsets)
                test, place, length = shard.matches()
                row = row_of(shard.firsts)[place] if len(place) else place
                order = np.lexsort((tests.start[test], place))
                test, place, length, row = test[order], place[order], length[order], row[order]
                found = pa.StructArray.from_arrays(
                    [pa.array(place - shard.firsts[row]), pa.array(length), item_names.take(pa.array(tests.item[test])), pa.array(tests.start[test] - tests.first[test])],
                    fields=list(part.schema.field("matches").type.value_type),
                )
                fresh = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)), found, type=part.schema.field("matches").type)
                yield pa.RecordBatch.from_arrays([part.column(0), *([] if last else [part.column(1)]), pa.array(np.diff(shard.firsts)), _joined(part.column(3), fresh)], names)

        text = "" if last else "text string, "
        return map_batches(rows, ["id", "text", "n_words", "matches"], f"id {kind}, {text}n_words long, matches {MATCHES}", run)

    scratch = None
    blocks_ahead = _benchmark_blocks(benchmark, item_column, item_text_column, block_chars)
    items = next(blocks_ahead)
    while (following := next(blocks_ahead, None)) is not None:
        before, scratch = scratch, written(search(rows, items, False), "decontam-rows")
        if before is not None:
            discard(before)
        rows, items = scratch, following
    return search(rows, items, True).select(F.col("id").alias(id_column), "n_words", "matches")


def _joined(old: pa.ListArray, fresh: pa.ListArray) -> pa.ListArray:
    """Row by row the elements of both lists."""
    if not len(old.values):
        return fresh
    counts = [np.diff(x.offsets.to_numpy()) for x in (old, fresh)]
    row = np.concatenate([np.repeat(np.arange(len(old)), c) for c in counts])
    values = pa.concat_arrays([x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for x in (old, fresh)])
    cuts = np.r_[0, np.cumsum(counts[0] + counts[1])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), values.take(pa.array(np.argsort(row, kind="stable"))), type=fresh.type)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns of find_matches(): document words inside matches, and the items matched."""
    ends = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["at"].alias("at"), (m["at"] + m["length"]).alias("to")))),
        ends,
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["to"] - F.greatest(x["at"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], x["to"]).alias("to")),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda x: x.isNotNull())))
    return found.select(
        id_column, "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in which no benchmark window occurs, with all their columns.

    A row's text alone decides, so that the workers give back the hashes of affected texts only, and the
    rows themselves never leave the engine.
    """
    one, two = unused(docs, "_h1"), unused(docs, "_h2")
    clean = docs.withColumns({one: F.xxhash64(text_column), two: F.xxhash64(F.lit(7), text_column)})
    texts = clean.select(F.col(text_column).alias("text"), F.col(one).alias("h1"), F.col(two).alias("h2"))
    for items in _benchmark_blocks(benchmark, item_column, item_text_column, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))

        def run(batch: pa.RecordBatch, held: Broadcast = held) -> pa.RecordBatch:
            bad = np.zeros(batch.num_rows, bool)
            for lo, _, data, offsets in blocks(batch.column(0)):
                shard = Shard(held.value, data, offsets)
                _, at, _ = shard.matches()
                if len(at):
                    bad[lo + np.unique(row_of(shard.firsts)[at])] = True
            return batch.select(["h1", "h2"]).filter(pa.array(bad))

        # written, so that the planner knows how few there are
        found = written(map_batches(texts, ["text", "h1", "h2"], "h1 long, h2 long", run).distinct(), "decontam-found")
        clean = clean.join(found.toDF(one, two), [one, two], "left_anti")
    return clean.select(*docs.columns)


#: Occurrences of windows by hashes of ten (or fewer) joined words; bytes from 0x80 on belong to words.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(generate_series(1, len(w))) AS s FROM d WHERE len(w) > 0),
m AS (SELECT p.r, p.s, g.n, g.item_id
      FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS words FROM p, (SELECT DISTINCT n FROM g) WHERE s + n - 1 <= len(w)) p JOIN g ON g.n = p.n AND g.words = p.words),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
