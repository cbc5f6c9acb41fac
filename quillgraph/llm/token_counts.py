"""Token counts by rank-synchronous array merging.

A SentencePiece BPE model merges, again and again, the adjacent pair whose joined
piece has the best rank, leftmost first. Text is cut where no piece can reach across
(before a space that follows something else), the distinct cuts of a batch are held
as one ragged array, and each round applies the lowest-rank pair of every sequence at
once. What survives is counted; characters outside the vocabulary count as their UTF-8
bytes (byte fallback). The vocabulary comes from the public model file and is never trained.

Defined results: null or empty text has 0 bytes and 0 tokens; very long texts are
counted whole; repeated rows give repeated rows; an empty table gives no rows; only
``id_col`` and ``text_col`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank

SPACE = "▁"
#: A unit: spaces and what follows them up to the next space, or spaces at the end.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Merges within this many symbols of each other might meet; a piece has at most 16 characters.
REACH = 40
#: Distinct units whose counts a task remembers before it starts again.
REMEMBERED = 400_000
#: Symbols that are merged together at most, unless a single unit is longer.
BLOCK = 1_000_000
NONE = np.iinfo(np.int32).max


class Merger:
    """The merge table of a SentencePiece BPE model as sorted arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        pieces = {
            model.id_to_piece(i): i
            for i in range(size)
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
        }
        # scores fall with the rank; equal scores only among single characters, which no merge makes
        order = sorted(pieces.values(), key=lambda i: (-model.get_score(i), i))
        rank = np.full(size, NONE, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.size, self.rank = size, rank
        found = sorted(
            (pieces[p[:k]] * size + pieces[p[k:]], i)
            for p, i in pieces.items()
            for k in range(1, len(p))
            if p[:k] in pieces and p[k:] in pieces
        )
        self.keys = np.array([k for k, _ in found], np.int64)
        self.made = np.array([i for _, i in found], np.int64)
        left, right = self.keys // size, self.keys % size
        # a piece is calm if no pair that it enters outranks it: then all its occurrences can merge at once
        self.calm = np.ones(size, bool)
        self.calm[left[rank[self.made] < rank[left]]] = False
        self.calm[right[rank[self.made] < rank[right]]] = False
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece that each pair makes; NONE where it makes none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        made = np.where(hit, self.made[at], 0)
        return np.where(hit, self.rank[made], NONE).astype(np.int32), made.astype(np.int32)

    def lengths(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit (spaces already escaped)."""
        n = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[points]
        # outside the vocabulary: as many byte tokens as UTF-8 takes, and no merge
        more = np.where(sym < 0, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000) - 1, 0)
        seq = np.repeat(np.arange(len(units)), n)
        total = np.bincount(seq, more, len(units)).astype(np.int64)
        live_sym, live_seq = sym, seq
        while len(live_sym):
            same = live_seq[:-1] == live_seq[1:]
            rank, made = self._pairs(live_sym[:-1], live_sym[1:])
            rank[~same] = NONE
            best = np.full(len(units), NONE, np.int32)
            starts = np.flatnonzero(np.r_[True, live_seq[1:] != live_seq[:-1]])
            if len(rank):
                best[live_seq[starts]] = np.minimum.reduceat(np.r_[rank, NONE], starts)
            # sequences without a pair are done
            done = best[live_seq] == NONE
            total += np.bincount(live_seq[done], minlength=len(units))
            hit = np.flatnonzero((rank == best[live_seq[:-1]]) & (rank != NONE))
            if len(hit):
                hit = hit[self._chosen(hit, live_seq[hit], live_sym, made[hit])]
                live_sym = live_sym.copy()
                live_sym[hit] = made[hit]
                done[hit + 1] = True  # merged into the symbol before it
            live_sym, live_seq = live_sym[~done], live_seq[~done]
        return total

    def _chosen(self, hit: np.ndarray, seq: np.ndarray, sym: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the lowest-rank pairs, those that merging one by one, leftmost first, would also merge."""
        gap = np.r_[NONE, np.diff(hit)]
        new = np.r_[True, seq[1:] != seq[:-1]]
        # different splits of one piece share its rank; only equal neighbours overlap ("aaa": positions 0, 2, ...)
        run = np.flatnonzero(new | (gap > 1))
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
        return np.where(self.calm[made], place % 2 == 0, new | (gap > REACH))

    def units(self, text: str) -> list[str]:
        return UNIT.findall(self.model.normalize(text)) if text else []


class Counter:
    """Counts texts and remembers the units it has seen."""

    def __init__(self, model_file: str):
        self.merger, self.known = Merger(model_file), {}

    def count(self, texts: list[str]) -> list[int]:
        units = [self.merger.units(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = [u for u in set().union(*units) if u not in self.known]
        at = 0
        while at < len(fresh):
            end, held = at, 0
            while end < len(fresh) and (held == 0 or held + len(fresh[end]) <= BLOCK):
                held += len(fresh[end])
                end += 1
            self.known.update(zip(fresh[at:end], self.merger.lengths(fresh[at:end]).tolist(), strict=True))
            at = end
        get = self.known.__getitem__
        return [sum(map(get, u)) for u in units]


#: A Python worker keeps its vocabulary and counts over the tasks that it runs.
_COUNTERS: dict[str, Counter] = {}


def _counter(model_file: str) -> Counter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = Counter(model_file)
    return _COUNTERS[model_file]


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row; no shuffle, one pass."""
    rows = docs.select(F.col(id_col), blank(F.col(text_col)).alias("text")).select(
        id_col, F.octet_length("text").cast("long").alias("n_bytes"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = counter.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, rows.select(id_col, "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
