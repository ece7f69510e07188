"""Quality rules: line labels by Viterbi decoding of a linear-chain conditional random field.

Each line with a word gets binned features (length, symbols, capitals, digits, punctuation, repeats).
A two-state chain (boilerplate, content) is trained by gradient ascent on lines that take the quality
label of their document.  The weights decide every line of every document together with its
neighbours; a document stays if it passes the counted base rules and at least `min_share` of its
words are on lines marked content.

The chain is fitted on a bounded sample of labelled documents: `sample_docs` of each label in the order
of a hash of their ids, whole texts, as long as they add up to `sample_bytes` for each label.  Longer
documents are trained in pieces of `PIECE` lines, and pieces of similar length together, so that the
memory follows the lines of the sample.  Everything else covers all rows.

Defined results: a null or empty text has no words and fails the base rules; with no label of one of
the two kinds every line counts as content; repeated rows give repeated results; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, map_batches, prepare, trim
from .textkit import SPACE, _class, blocks, gram_hashes, mix, row_of, span_hashes, spans

NEWLINE = _class((10, 10))
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
CAPITAL, DIGIT = _class((65, 90)), _class((48, 57))
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "!?;:{}[]()=_/\\~^@\"'"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True
POINT = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

#: Bins of each line feature; the last one of a row is open.
BINS = {
    "words": [2, 4, 7, 12, 20, 40, 80],
    "word_length": [2.5, 3.5, 4.5, 5.5, 7, 10, 15],
    "symbols": [0.001, 0.05, 0.15, 0.3, 0.6, 1.0, 2.0],
    "capitals": [0.01, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9],
    "digits": [0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6],
    "marks": [0.001, 0.05, 0.15, 0.3, 0.6, 1.0, 2.0],
    "repeats": [0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.9],
    "shape": [1, 2, 3],
}
WIDTH = 8
PIECE = 256  #: lines of a document that are trained as one chain
CELLS = 1 << 16  #: lines of a group of pieces, with its padding


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:], dtype=np.int32)
    return (total[ends] - total[starts]).astype(np.int64)


def analyse(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts per row and, for each line with a word, its row, words and binned features."""
    n = len(offsets) - 1
    starts, ends, firsts = spans(data, offsets, SPACE)
    rows = row_of(firsts)
    lows, highs = offsets[:-1], offsets[1:]
    points = _sums(POINT[data] & ~SPACE[data], lows, highs)
    symbol_sum = np.zeros(len(data) + 1, np.int32)
    np.cumsum(SYMBOL[data], out=symbol_sum[1:], dtype=np.int32)
    # words in repeated three-word windows
    grams, at = gram_hashes(span_hashes(data, starts, ends), firsts, 3)
    repeated = np.zeros(len(starts) + 3, bool)
    if len(grams):
        key = mix(grams + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.r_[False, same] | np.r_[same, False]]]
        for k in range(3):
            repeated[twice + k] = True
    repeated = repeated[: len(starts)]
    # lines with a word
    l_starts, l_ends, l_firsts = spans(data, offsets, NEWLINE)
    low, high = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    has = high > low
    l_row = row_of(l_firsts)[has]
    l_starts, l_ends, low, high = l_starts[has], l_ends[has], low[has], high[has]
    line_key = mix(span_hashes(data, l_starts, l_ends) + l_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(line_key, kind="stable")
    later = np.zeros(len(order), bool)
    later[order[1:][line_key[order][1:] == line_key[order][:-1]]] = True
    n_words = np.diff(firsts)
    words = high - low
    size = l_ends - l_starts
    word_bytes = np.cumsum(np.r_[0, ends - starts])
    inked = word_bytes[high] - word_bytes[low]
    last = data[ends[high - 1] - 1] if len(high) else np.zeros(0, np.uint8)
    shape = STOP[last].astype(int) + 2 * later
    values = {
        "words": words,
        "word_length": inked / np.maximum(words, 1),
        "symbols": (symbol_sum[l_ends] - symbol_sum[l_starts]) / np.maximum(words, 1),
        "capitals": _sums(CAPITAL[data], l_starts, l_ends) / np.maximum(inked, 1),
        "digits": _sums(DIGIT[data], l_starts, l_ends) / np.maximum(inked, 1),
        "marks": _sums(MARKS[data], l_starts, l_ends) / np.maximum(words, 1),
        "repeats": _sums(repeated, low, high) / np.maximum(words, 1),
        "shape": shape,
    }
    assert len(size) == len(words)
    features = np.stack([np.searchsorted(BINS[k], v, "right") + WIDTH * i for i, (k, v) in enumerate(values.items())], axis=1).astype(np.int16)
    return {
        "n_words": n_words,
        "word_chars": points,
        "n_symbols": (symbol_sum[highs] - symbol_sum[lows]).astype(np.int64),
        "n_dup_lines": np.bincount(l_row[later], minlength=n),
        "n_repeat_words": np.bincount(rows[repeated], minlength=n),
        "line_row": l_row,
        "line_words": words,
        "features": features,
    }


class Chain:
    """Two states; emission score of content minus boilerplate per feature, and transition scores."""

    def __init__(self):
        self.emit, self.bias, self.step = np.zeros(WIDTH * len(BINS)), 1.0, np.zeros((2, 2))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1) + self.bias

    def fit(self, docs: list[tuple[int, np.ndarray]], prior: float = 0.5, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> Chain:
        """Maximum likelihood by forward-backward over all sample documents; prior: share of good documents."""
        docs = [(y, f) for y, f in docs if len(f)]
        labels = np.array([y for y, _ in docs])
        if len(set(labels.tolist())) < 2:
            return self
        of_label = {0: (1 - prior) / (labels == 0).sum(), 1: prior / (labels == 1).sum()}  # documents of a label weigh alike
        pieces = [(y, of_label[y] / len(f), f[k : k + PIECE]) for y, f in docs for k in range(0, len(f), PIECE)]
        groups = [Pieces(part) for part in grouped(pieces)]
        momentum = [np.zeros_like(self.emit), 0.0, np.zeros((2, 2))]
        for _ in range(rounds):
            grad, bias, move = np.zeros_like(self.emit), 0.0, np.zeros((2, 2))
            for group in groups:
                g, e, m = group.gradient(self)
                grad, bias, move = grad + g, bias + e, move + m
            for k, g in enumerate((grad - ridge * self.emit, bias, move - ridge * self.step)):
                momentum[k] = 0.9 * momentum[k] + g
            self.emit = self.emit + rate * 4 * momentum[0]
            self.bias += rate * momentum[1]
            self.step = np.clip(self.step + rate * momentum[2], -1.5, 1.5)
        return self

    def viterbi(self, scores: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The best state of each line; rows advance together, longest first."""
        length = np.diff(firsts)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        out = np.zeros(len(scores), np.int8)
        if not len(order):
            return out
        begin, size = firsts[:-1][order], length[order]
        alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # rows longer than t
        zero, one = np.zeros(len(order)), scores[begin].copy()
        from_zero, from_one = np.zeros(len(scores), np.int8), np.zeros(len(scores), np.int8)
        for t in range(1, int(size[0])):
            m = int(alive[t])
            a, b, at = zero[:m], one[:m], begin[:m] + t
            to0a, to0b, to1a, to1b = a + self.step[0, 0], b + self.step[1, 0], a + self.step[0, 1], b + self.step[1, 1]
            from_zero[at], from_one[at] = to0b > to0a, to1b >= to1a
            zero[:m], one[:m] = np.maximum(to0a, to0b), np.maximum(to1a, to1b) + scores[at]
        state = (one >= zero).astype(np.int8)
        for t in range(int(size[0]) - 1, -1, -1):
            m = int(alive[t])
            at = begin[:m] + t
            out[at] = state[:m]
            if t:
                state[:m] = np.where(state[:m] == 1, from_one[at], from_zero[at])
        return out


def grouped(pieces: list[tuple[int, float, np.ndarray]]) -> Iterator[list[tuple[int, float, np.ndarray]]]:
    """Pieces of similar length in groups: padded to the longest, a group has at most CELLS lines and twice its own."""
    pieces = sorted(pieces, key=lambda x: -len(x[2]))
    at = 0
    while at < len(pieces):
        longest = len(pieces[at][2])
        to = at + 1
        while to < len(pieces) and (to + 1 - at) * longest <= CELLS and 2 * len(pieces[to][2]) >= longest:
            to += 1
        yield pieces[at:to]
        at = to


class Pieces:
    """Pieces of labelled documents as one padded grid: forward-backward and the gradient of the likelihood."""

    def __init__(self, pieces: list[tuple[int, float, np.ndarray]]):
        self.length = np.array([len(f) for _, _, f in pieces])
        self.longest = int(self.length.max())
        self.flat = np.concatenate([f for _, _, f in pieces]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(pieces)), self.length)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.label = np.array([y for y, _, _ in pieces])
        self.share = np.array([w for _, w, _ in pieces])
        self.live = np.arange(self.longest)[None, :] < self.length[:, None]

    def gradient(self, chain: Chain) -> tuple[np.ndarray, float, np.ndarray]:
        """Of the emission scores, the bias and the transition scores."""
        n, step = len(self.length), chain.step
        grid = np.zeros((n, self.longest))
        grid[self.doc, self.place] = chain.scores(self.flat)
        score = np.stack([np.zeros_like(grid), grid], axis=2)
        ahead, behind = np.zeros((self.longest, n, 2)), np.zeros((self.longest, n, 2))
        ahead[0] = score[:, 0]
        for t in range(1, self.longest):
            new = np.logaddexp(ahead[t - 1][:, :1] + step[0], ahead[t - 1][:, 1:] + step[1]) + score[:, t]
            ahead[t] = np.where(self.live[:, t, None], new, ahead[t - 1])
        total = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
        move = np.zeros((2, 2))
        for t in range(self.longest - 2, -1, -1):
            tail = behind[t + 1] + score[:, t + 1]
            on = self.live[:, t + 1]
            behind[t] = np.where(on[:, None], np.logaddexp(step[:, 0] + tail[:, :1], step[:, 1] + tail[:, 1:]), 0.0)
            joint = np.exp(ahead[t][:, :, None] + step[None] + tail[:, None, :] - total[:, None, None])
            move -= (joint * (self.share * on)[:, None, None]).sum(axis=0)
        steps = self.share * (self.length - 1)
        move[1, 1] += steps[self.label == 1].sum()
        move[0, 0] += steps[self.label == 0].sum()
        content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[None])[self.place, self.doc]
        error = (self.label[self.doc] - content) * self.share[self.doc]
        grad = np.zeros_like(chain.emit)
        for k in range(self.flat.shape[1]):
            grad += np.bincount(self.flat[:, k], weights=error, minlength=len(grad))
        return grad, float(error.sum()), move


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 1500, sample_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text") -> Chain:
    """Fits the chain on at most 2 x sample_docs labelled documents, chosen by a hash of their id."""
    sample, seen = labelled_sample(docs, labels, "quality", sample_docs, sample_bytes, id_column, text_column)
    if sample is None:
        return Chain()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, _, data, offsets in blocks(batch.column(1)):
            found = analyse(data, offsets)
            at = np.searchsorted(found["line_row"], np.arange(len(offsets)))
            out += [found["features"][at[r] : at[r + 1]].tobytes() for r in range(len(offsets) - 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_y", "features"])

    got = map_batches(sample, ["_y", "_text"], "_y int, features binary", run).collect()
    return Chain().fit([(r["_y"], np.frombuffer(bytes(r["features"]), np.int16).reshape(-1, len(BINS))) for r in sorted(got, key=lambda r: (r["_y"], bytes(r["features"])))], seen[1] / (seen[0] + seen[1]))


def judge(docs: DataFrame, chain: Chain, min_words: int = 50, max_repeat_percent: int = 50, min_share: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, the base counts, base_failed, content_share and kept."""
    kind = docs.schema[id_column].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"{id_column} {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, content_share double, kept boolean"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: dict[str, list[np.ndarray]] = {c: [] for c in [*counts, "share"]}
        for _, _, data, offsets in blocks(batch.column(1)):
            found = analyse(data, offsets)
            n = len(offsets) - 1
            at = np.searchsorted(found["line_row"], np.arange(n + 1))
            state = chain.viterbi(chain.scores(found["features"]), at)
            good = np.bincount(found["line_row"], weights=found["line_words"] * state, minlength=n)
            parts["share"].append(good / np.maximum(found["n_words"], 1))
            for c in counts:
                parts[c].append(found[c])
        whole = {c: np.concatenate(v) if v else np.zeros(0) for c, v in parts.items()}
        n_words = whole["n_words"].astype(np.int64)
        failed = (n_words < min_words) | (100 * whole["n_repeat_words"].astype(np.int64) > max_repeat_percent * n_words)
        kept = ~failed & (whole["share"] >= min_share)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(whole[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(whole["share"].astype(float)), pa.array(kept)], [id_column, *counts, "base_failed", "content_share", "kept"])

    return map_batches(docs, [id_column, text_column], schema, run)


def keep(docs: DataFrame, chain: Chain, min_words: int = 50, max_repeat_percent: int = 50, min_share: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows that judge() keeps, with all their columns; decided row by row, so that ids may repeat."""

    def run(batches):
        for batch in batches:
            good = []
            for _, _, data, offsets in blocks(batch.column(batch.schema.get_field_index(text_column))):
                found = analyse(data, offsets)
                n = len(offsets) - 1
                state = chain.viterbi(chain.scores(found["features"]), np.searchsorted(found["line_row"], np.arange(n + 1)))
                share = np.bincount(found["line_row"], weights=found["line_words"] * state, minlength=n) / np.maximum(found["n_words"], 1)
                failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > max_repeat_percent * found["n_words"])
                good.append(~failed & (share >= min_share))
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))
            del batch
            trim()

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
