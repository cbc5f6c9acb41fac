"""Packing documents into training sequences along a space-filling curve.

A pass over the text tokenizes each document (and appends the end id), hashes its
ids into a vector, projects that to a few dimensions and takes its place on a Hilbert
curve through them. Whole blocks of a document's ids are sequences of their own; what
is left of each document is range-sorted by Hilbert key and laid end to end along the curve, cut
wherever a sequence is full. So similar documents share sequences and only the last sequence
can have padding. The one shuffle is that range sort; it carries the remaining ids (under one
sequence for each document). Prefix sums of the sorted parts turn places within a part
into places in the whole; only one row for each part is gathered for that.

Equal keys (groups of copies) are spread by a hash of the id, so no range grows with them.

Defined results: null or empty text is the end id alone; very long texts are cut into as many
sequences as they need; repeated rows are packed each; a null id is kept; ties on the curve
go by hash of the id, then id, then ids of the text; an empty table gives no rows; only
``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, store

#: Cuts of the byte-level pre-tokenizer for Latin text, where letters, digits and spaces are these.
LETTER, DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
CUT = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
LATIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
#: Cuts of one generation whose ids a worker remembers, about 200 bytes each; it keeps two generations.
REMEMBERED = 300_000
#: The letter that the byte-level pre-tokenizer writes for each byte: printable ones stay, the others follow from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in PRINTED} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


class Encoder:
    """Token ids as the tokenizer gives them; cuts of Latin text are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # little-endian 32-bit ids
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [LATIN.fullmatch(t) and not any(s in t for s in self.special) for t in texts]
        cuts = [CUT.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > REMEMBERED:
            # what is met again in this generation comes along, what is not goes with the next
            self.known, self.older = {}, self.known
        unseen = [w for w in set().union(*cuts) if w not in self.known]
        again = [w for w in unseen if w in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        fresh = [w for w in unseen if w not in self.known] if again else unseen
        self.known.update(zip(fresh, map(self.word, fresh), strict=True))
        return [
            np.frombuffer(self.joined(c), "<u4") if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            for t, c, p in zip(texts, cuts, plain, strict=True)
        ]

    def word(self, cut: str) -> bytes:
        """Ids of one cut: the pre-tokenizer would not cut it again, so it goes to the merges as it is."""
        ids = [t.id for t in self.model.tokenize(cut.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def joined(self, cuts: list[str]) -> bytes:
        return b"".join(itemgetter(*cuts)(self.known) if len(cuts) > 1 else map(self.known.__getitem__, cuts))


#: A Python worker keeps its tokenizer over the tasks that it runs.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits in each dimension (Skilling's transform)."""
    x = places.astype(np.int64).copy()
    n = x.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[:, n - 1] & q, q - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray], dims: int, bits: int, width: int = 256) -> np.ndarray:
    """Hilbert keys of documents: hashed ids, square roots of their counts at unit length, projected by a fixed Gaussian matrix."""
    v = np.stack([np.bincount((i * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=width) for i in ids])
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    y = v @ np.random.default_rng(42).standard_normal((width, dims))
    return hilbert_keys(np.clip((y + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def encode_documents(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, dims: int = 4, bits: int = 12, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, key, n`` (ids with the end id), ``crcs`` of its whole blocks, ``tail`` (the rest, little-endian 32-bit ids)."""
    rows = docs.select(F.col(id_col), blank(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.append(i, np.uint32(end_id)).astype("<u4") for i in encoder.encode(part.column(1).to_pylist())]
                whole = [len(i) // capacity for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(curve_keys(ids, dims, bits)),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([[zlib.crc32(i[j * capacity : (j + 1) * capacity]) for j in range(w)] for i, w in zip(ids, whole, strict=True)], pa.list_(pa.int64())),
                        pa.array([i[w * capacity :].tobytes() for i, w in zip(ids, whole, strict=True)], pa.binary()),
                    ],
                    names,
                )

    names = [id_col, "key", "n", "crcs", "tail"]
    zero = F.lit(0).cast("long")
    shape = rows.select(id_col, zero.alias("key"), zero.alias("n"), F.array(zero).alias("crcs"), F.lit(b"").alias("tail"))
    return rows.mapInArrow(run, shape.schema)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the sorted rows of a part: the part, and the tail ids and whole blocks that precede each row in it."""
    part, tail, whole = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        tails = np.array([len(t) // 4 for t in batch.column("tail").to_pylist()], np.int64)
        blocks = np.array([len(c) for c in batch.column("crcs").to_pylist()], np.int64)
        more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(tail + np.cumsum(tails) - tails), pa.array(whole + np.cumsum(blocks) - blocks)]
        tail, whole = tail + int(tails.sum()), whole + int(blocks.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "tail_before", "blocks_before"])


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, dims: int = 4, bits: int = 12, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    # stored, as the range sort reads its input twice: for the ranges, and to deal it out
    coded = store(encode_documents(docs, tokenizer, capacity, end_id, dims, bits, id_col, text_col), "packing-ids")
    salted = coded.withColumn("salt", F.xxhash64(id_col))
    placed = salted.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt", id_col, "n", "tail")
    zero = F.lit(0).cast("long")
    shape = placed.withColumns({"part": F.lit(0), "tail_before": zero, "blocks_before": zero})
    laid = store(placed.mapInArrow(_laid_out, shape.schema), "packing")

    n_tail = F.octet_length("tail").cast("long") / 4
    parts = laid.groupBy("part").agg(F.sum(n_tail.cast("long")).alias("tails"), F.sum(F.size("crcs").cast("long")).alias("blocks"))
    # one row for each part: small however many documents there are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "part",
        F.coalesce(F.sum("tails").over(before), zero).alias("tail_start"),
        F.coalesce(F.sum("blocks").over(before), zero).alias("block_start"),
        F.ceil(F.sum("tails").over(Window.partitionBy()) / capacity).cast("long").alias("shared"),
    )
    at = laid.join(starts, "part").withColumns(
        {
            "g": F.col("tail_start") + F.col("tail_before"),
            "rest": n_tail.cast("long"),
            "done": F.size("crcs").cast("long") * capacity,
            "block": F.col("shared") + F.col("block_start") + F.col("blocks_before"),
        }
    )
    at = at.withColumn("first", F.least("rest", capacity - F.col("g") % capacity))

    def piece(start, length, crc, sequence, offset):
        return F.struct(start.alias("start"), length.alias("length"), crc.alias("ids_crc32"), sequence.alias("sequence_id"), offset.alias("offset"))

    def ids(start, length):
        return F.crc32(F.substring("tail", (4 * start + 1).cast("int"), (4 * length).cast("int")))

    rest = F.col("rest") - F.col("first")
    pieces = F.concat(
        F.transform("crcs", lambda c, j: piece(j.cast("long") * capacity, F.lit(capacity).cast("long"), c, F.col("block") + j, zero)),
        F.array(
            piece(F.col("done"), F.col("first"), ids(zero, F.col("first")), F.floor(F.col("g") / capacity), F.col("g") % capacity),
            piece(F.col("done") + F.col("first"), rest, ids(F.col("first"), rest), F.floor((F.col("g") + F.col("first")) / capacity), zero),
        ),
    )
    return at.select(id_col, F.col("n").alias("doc_tokens"), F.explode(F.filter(pieces, lambda p: p["length"] > 0)).alias("p")).select(
        id_col, "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"
    )
