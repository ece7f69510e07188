"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut where no piece of the model can cross (before a run of word marks, around characters
that no piece contains), distinct parts are encoded once per batch, and their symbols live in flat
numpy arrays.  Each round takes every part's best pair by segmented minimum, merges all its leftmost
non-overlapping occurrences at once, compacts the arrays and drops the parts in which no pair is left.
Where a merged symbol opens a pair that would go before the remaining occurrences, only the leftmost
occurrence is merged in that round, so that the result is the library's own.

Defined results: a null text counts as empty; an empty text has the end id only; characters outside
the vocabulary become byte pieces; repeated rows give repeated results; other columns of the input
are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

MARK = "▁"
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left, right) symbol pair to merged symbol, open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, width: int):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 8))))
        self.width = width
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        key = left.astype(np.int64) * width + right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]] = key[placed]
            self.values[slot[placed]] = merged[placed]
            todo = np.setdiff1d(todo, placed)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbols, -1 where the pair is none; symbols below 0 are in no pair."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((seen != key) & (seen != -1) & (key >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


class Encoder:
    def __init__(self, model_bytes: bytes, cache_parts: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        size = model.get_piece_size()
        self.end = model.eos_id()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model must have byte fallback")
        normal = {pieces[i]: i for i in range(size) if not special[i]}
        if any(a != MARK and b == MARK for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces that cross a word mark are not supported")
        symbol = dict(normal)
        for ch in sorted({c for p in normal for c in p}):
            symbol.setdefault(ch, len(symbol) + size)  # characters that are in pieces without being one
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        splits = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, merged = (np.array(x, np.int64) for x in zip(*splits, strict=True)) if splits else (np.zeros(0, np.int64),) * 3
        self.pairs = PairTable(left, right, merged, size + len(symbol) + 1)
        score = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.piece_bytes = [b"" if model.is_control(i) else bytes([int(pieces[i][3:5], 16)]) if model.is_byte(i) else pieces[i].replace(MARK, " ").encode() for i in range(size)]
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        lone = "\n" if self.char[10] < 0 else ""
        self.parts = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + f"|{lone}" * bool(lone))
        self.cache, self.cache_parts = {}, cache_parts

    def _merge(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final symbols, the index of each symbol's first character, and the part of each."""
        sym = self.char[chars]
        part = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(chars))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        merged = self._pairs(sym, part)
        while len(sym):
            rank = np.where(merged >= 0, self.rank[merged], NONE)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            size = np.diff(np.r_[first, len(part)])
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best < NONE, size)
            if not live.all():
                done.append((sym[~live], at[~live], part[~live]))
                sym, at, part, merged, rank = sym[live], at[live], part[live], merged[live], rank[live]
                size, best = size[best < NONE], best[best < NONE]
                if not len(sym):
                    break
            goal = np.repeat(best, size)
            hit = self._leftmost(rank == goal)
            out = self._apply(sym, at, part, merged, hit)
            many = np.add.reduceat(hit, np.cumsum(size) - size) > 1
            if many.any():
                new_rank = np.where(out[3] >= 0, self.rank[out[3]], NONE)
                fresh = out[4] | np.r_[out[4][1:], False]  # pairs that a merged symbol is part of
                kept = np.flatnonzero(~np.r_[False, hit[:-1]])
                worse = np.zeros(len(best), bool)
                order = np.repeat(np.arange(len(best)), size)
                worse[order[kept[fresh & (new_rank <= goal[kept])]]] = True
                if (worse & many).any():
                    lead = np.zeros(len(hit), bool)
                    spot = np.flatnonzero(hit)
                    lead[spot[np.r_[True, order[spot][1:] != order[spot][:-1]]]] = True
                    hit &= lead | ~(worse & many)[order]
                    out = self._apply(sym, at, part, merged, hit)
            sym, at, part, merged = out[:4]
        sym, at, part = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (sym, at, part)
        order = np.argsort(at, kind="stable")
        return sym[order], at[order], part[order]

    def _pairs(self, sym: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(part[1:] == part[:-1])
        out[inner] = self.pairs.find(sym[inner], sym[inner + 1])
        return out

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of each run of adjacent hits every second one, from its first."""
        spot = np.flatnonzero(hit)
        start = np.r_[True, spot[1:] != spot[:-1] + 1]
        base = np.flatnonzero(start)
        nth = np.arange(len(spot)) - np.repeat(base, np.diff(np.r_[base, len(spot)]))
        out = np.zeros(len(hit), bool)
        out[spot[nth % 2 == 0]] = True
        return out

    def _apply(self, sym, at, part, merged, hit):
        """Symbols after merging at `hit`, their pairs, and which symbols are new."""
        new = np.where(hit, merged, sym)
        keep = ~np.r_[False, hit[:-1]]
        sym2, at2, part2, fresh = new[keep], at[keep], part[keep], hit[keep]
        pair = merged[keep]
        todo = np.flatnonzero(fresh | np.r_[fresh[1:], False])
        pair[todo] = -1
        inner = todo[todo + 1 < len(sym2)]
        inner = inner[part2[inner] == part2[inner + 1]]
        pair[inner] = self.pairs.find(sym2[inner], sym2[inner + 1])
        return sym2, at2, part2, pair, fresh

    def _encode_parts(self, parts: list[str]) -> None:
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in parts])
        sym, at, part = self._merge(chars, lengths)
        counts = np.bincount(part, minlength=len(parts))
        ids, lost, size = sym.tolist(), (sym < 0) | (sym >= len(self.rank)), len(self.rank)
        has_lost = np.bincount(part, weights=lost, minlength=len(parts)) > 0
        to = 0
        for p, n, odd in zip(parts, counts.tolist(), has_lost.tolist(), strict=True):
            got = ids[to : to + n]
            if odd:
                out = []
                for i, a in zip(got, at[to : to + n].tolist(), strict=True):
                    out += [i] if 0 <= i < size else [self.byte_id[b] for b in chr(chars[a]).encode()]
                got = out
            to += n
            self.cache[p] = (len(got), " ".join(map(str, got)))

    def encode(self, texts: list[str]) -> list[list[tuple[int, str]]]:
        """For each text the (number of ids, ids as text) of its parts."""
        cut = [self.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > self.cache_parts:
            self.cache.clear()
        new = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.cache]
        group, size = [], 0
        for p in new:
            group.append(p)
            size += len(p)
            if size > 1 << 19:
                self._encode_parts(group)
                group, size = [], 0
        if group:
            self._encode_parts(group)
        get = self.cache.__getitem__
        return [list(map(get, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of the ids: end ids are silent, one leading space goes, broken bytes become U+FFFD."""
        if not len(ids):
            return ""
        raw = [self.piece_bytes[i] for i in ids.tolist()]
        lead = next((k for k, i in enumerate(ids.tolist()) if self.piece_bytes[i] or self.is_byte[i]), None)
        if lead is not None and not self.is_byte[ids[lead]] and raw[lead].startswith(b" "):
            raw[lead] = raw[lead][1:]
        joined = b"".join(raw)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, raw)

    def _decode_broken(self, ids: np.ndarray, raw: list[bytes]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + n]).decode())
                        k += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            run.clear()

        for i, b in zip(ids.tolist(), raw, strict=True):
            if self.is_byte[i]:
                run += b
            else:
                flush()
                out.append(b.decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def _encoder(model_bytes: bytes) -> Encoder:
    return Encoder(model_bytes)


def model_file(path: str) -> bytes:
    """The model's bytes, read on the driver; they travel with the tasks (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_bytes: bytes, id_column: str = "doc_id", text_column: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids (space-joined decimal text) and the decoded text.

    With texts=False ids and decoded text are given as SHA-256 digests, so that results stay small.
    """
    kind = df.schema[id_column].dataType.simpleString()
    names = ["ids", "decoded"] if texts else ["ids_sha256", "decoded_sha256"]

    def run(batch: pa.RecordBatch):
        encoder = _encoder(model_bytes)
        step = 256
        for at in range(0, max(1, batch.num_rows), step):
            piece = batch.slice(at, step)
            rows = [t or "" for t in piece.column(1).to_pylist()]
            n_tokens, ids_out, text_out = [], [], []
            for parts in encoder.encode(rows):
                ids = " ".join([p[1] for p in parts] + [str(encoder.end)])
                n_tokens.append(sum(p[0] for p in parts) + 1)
                text = encoder.decode(np.array(ids.split(" "), dtype=np.int64) if len(ids) < 64 else np.fromstring(ids, dtype=np.int64, sep=" "))
                ids_out.append(ids if texts else hashlib.sha256(ids.encode()).hexdigest())
                text_out.append(text if texts else hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())], [id_column, "n_tokens", *names])

    return map_batches(df, [id_column, text_column], f"{id_column} {kind}, n_tokens long, {names[0]} string, {names[1]} string", run)
