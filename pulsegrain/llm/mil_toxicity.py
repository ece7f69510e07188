"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences.  Each sentence has a logistic score over its distinct hashed words
and word beginnings, so that unseen forms of an offending word count as well, and a document is toxic
with probability 1 - prod(1 - p(sentence)).  The word weights are trained through the noisy-or from
document labels alone, so that the same weights then say which sentences offend (`sentence_scores`).

The weights are fitted on a bounded sample of labelled documents: `sample_docs` of each label in the
order of a hash of their ids, whole texts, as long as they add up to `sample_bytes` for each label.
Every document is scored over its whole text.

Defined results: null and empty texts have no sentence and score 0; with labels of one kind only
every score is the share of toxic labels (0 without labels); labels with a null id or a label other
than 0 and 1 are left out; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, labelled_sample, map_batches
from .textkit import LOWER, NON_WORD, blocks, mix, row_of, span_hashes, spans

BITS = 20  #: words are hashed to this many bits
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".!?\n"]] = True
PREFIXES = (4, 6)  #: bytes of word beginnings that are features too; shorter words have none
FOLD = 60  #: training rounds


def sentences(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Hashed words and beginnings, their rows, and the number of their sentence among all sentences with a word."""
    lower = LOWER[data]
    starts, ends, firsts = spans(lower, offsets, NON_WORD)
    shift = np.uint64(64 - BITS)
    bins = [(span_hashes(lower, starts, ends) >> shift).astype(np.int32)]
    owner = [np.arange(len(starts))]
    for size in PREFIXES:
        at = np.flatnonzero(ends - starts > size)
        bins.append((mix(span_hashes(lower, starts[at], starts[at] + size) + np.uint64(size)) >> shift).astype(np.int32))
        owner.append(at)
    rows = row_of(firsts)
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(BREAK[data], out=breaks[1:], dtype=np.int32)
    cut = np.ones(len(starts), bool)
    if len(starts) > 1:
        cut[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (rows[1:] != rows[:-1])
    sentence = np.cumsum(cut) - 1
    return {"bins": np.concatenate(bins), "sentence": sentence[np.concatenate(owner)], "rows": rows, "starts": starts, "ends": ends, "first": np.flatnonzero(cut)}


def _distinct(bins: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((sentence.astype(np.int64) << BITS) | bins)
    return (key & ((1 << BITS) - 1)).astype(np.int32), (key >> BITS).astype(np.int64)


class Model:
    """Word weights over hashed words, and the score of a sentence without any of them."""

    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights.astype(np.float32), bias, constant

    def logits(self, bins: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        b, s = _distinct(bins, sentence)
        return self.bias + np.bincount(s, weights=self.weights[b], minlength=n)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """Per row the noisy-or of its sentences; per sentence its row and probability."""
        n = len(offsets) - 1
        found = sentences(data, offsets)
        count = len(found["first"])
        row = found["rows"][found["first"]]
        if self.constant is not None or not count:
            return np.full(n, self.constant or 0.0), row, np.full(count, self.constant or 0.0), found
        logit = self.logits(found["bins"], found["sentence"], count)
        clean = -np.logaddexp(0, logit)  # log(1 - p)
        return 1 - np.exp(np.bincount(row, weights=clean, minlength=n)), row, 1 - np.exp(clean), found


def fit(bags: list[tuple[int, np.ndarray]], prior: float, rounds: int = FOLD, rate: float = 0.3, sparsity: float = 2e-4, min_docs: int = 3) -> Model:
    """bags: (label, hashed words with -1 before each sentence). Proximal Adam on the noisy-or likelihood."""
    labels = np.array([y for y, _ in bags])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, prior)
    held = np.zeros(1 << BITS, np.int32)  # documents with each feature
    for _, b in bags:
        held[np.unique(b[b >= 0])] += 1
    common = held >= min_docs
    names = np.flatnonzero(common)
    column_of = np.cumsum(common, dtype=np.int32) - 1
    columns, wheres, docs_of, count = [], [], [], 0
    for k, (_, b) in enumerate(bags):
        feature = b >= 0
        sentence = np.cumsum(~feature, dtype=np.int32) - 1 + count
        feature[feature] = common[b[feature]]
        columns.append(column_of[b[feature]])
        wheres.append(sentence[feature])
        docs_of.append(np.full(int((b < 0).sum()), k, np.int32))
        count += len(docs_of[-1])
    column, where, doc = np.concatenate(columns), np.concatenate(wheres), np.concatenate(docs_of)
    del columns, wheres, docs_of
    share = np.where(labels == 1, prior / (labels == 1).sum(), (1 - prior) / (labels == 0).sum())
    weights, bias = np.zeros(len(names)), -6.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for step in range(1, rounds + 1):
        logit = bias + np.bincount(where, weights=weights[column], minlength=count)
        p = 1 / (1 + np.exp(-logit))
        clean = np.minimum(np.bincount(doc, weights=-np.logaddexp(0, logit), minlength=len(bags)), -1e-9)
        toxic = -np.expm1(clean)
        pull = np.where(labels == 1, np.exp(clean) / toxic, -1.0) * share  # d log-likelihood / d(-clean)
        slope = p * pull[doc]
        gradient, gb = np.bincount(column, weights=slope[where], minlength=len(names)), float(slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        size = rate / (np.sqrt(v / b) + 1e-4)
        weights = weights + size * m / a
        weights = np.sign(weights) * np.maximum(np.abs(weights) - size * sparsity, 0)
        bias = min(-3.0, bias + 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-8))
    full = np.zeros(1 << BITS)
    full[names] = weights
    return Model(full, bias)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 2500, sample_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fits the model on at most 2 x sample_docs labelled documents, chosen by a hash of their id."""
    sample, seen = labelled_sample(docs, labels, "toxic", sample_docs, sample_bytes, id_column, text_column)
    prior = seen.get(1, 0) / max(1, sum(seen.values()))
    if sample is None:
        return Model(np.zeros(1 << BITS), 0.0, prior)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, _, data, offsets in blocks(batch.column(1)):
            found = sentences(data, offsets)
            b, where = _distinct(found["bins"], found["sentence"])
            first = np.searchsorted(where, np.arange(len(found["first"])))
            flat = np.insert(b, first, -1)
            done = np.searchsorted(found["rows"][found["first"]], np.arange(len(offsets)))  # sentences before each row
            cuts = np.r_[first, len(b)][done] + done
            out += [flat[cuts[r] : cuts[r + 1]].tobytes() for r in range(len(offsets) - 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_y", "bag"])

    bags = [(r["_y"], np.frombuffer(bytes(r["bag"]), np.int32)) for r in map_batches(sample, ["_y", "_text"], "_y int, bag binary", run).toLocalIterator() if r["bag"]]
    bags.sort(key=lambda x: (x[0], x[1].tobytes()))
    return fit(bags, prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, score, predicted, the sentences with a probability above one half and the highest one."""
    kind = docs.schema[id_column].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, bad, top = [], [], []
        for _, _, data, offsets in blocks(batch.column(1)):
            s, row, p, _ = held.value.score(data, offsets)
            scores.append(s)
            bad.append(np.bincount(row[p > 0.5], minlength=len(s)))
            best = np.zeros(len(s))
            np.maximum.at(best, row, p)
            top.append(best)
        s, b, t = (np.concatenate(x) if x else np.zeros(0) for x in (scores, bad, top))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(b.astype(np.int64)), pa.array(t)], [id_column, "score", "predicted", "n_offending", "worst_sentence"])

    return map_batches(docs, [id_column, text_column], f"{id_column} {kind}, score double, predicted int, n_offending long, worst_sentence double", run)


def sentence_scores(docs: DataFrame, model: Model, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The sentences that offend: id, position among the row's sentences, text from its first to its last word, probability."""
    kind = docs.schema[id_column].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, nths, texts, ps = [], [], [], []
        for lo, _, data, offsets in blocks(batch.column(1)):
            _, row, p, found = held.value.score(data, offsets)
            first = np.r_[found["first"], len(found["starts"])]
            base = np.searchsorted(row, row)
            for k in np.flatnonzero(p >= least).tolist():
                ids.append(batch.column(0)[lo + int(row[k])].as_py())
                nths.append(k - int(base[k]))
                texts.append(data[found["starts"][first[k]] : found["ends"][first[k + 1] - 1]].tobytes().decode("utf-8", "replace"))
                ps.append(float(p[k]))
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(nths, pa.int64()), pa.array(texts, pa.string()), pa.array(ps, pa.float64())], [id_column, "sentence", "text", "score"])

    return map_batches(docs, [id_column, text_column], f"{id_column} {kind}, sentence long, text string, score double", run)


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.pmod(crc32_text(id_column), F.lit(3)) == 1
