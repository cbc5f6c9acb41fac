"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters, lower-cased, and a space for each run of anything else give 1- to 3-grams, which
are hashed to a fixed number of buckets. A few passes over the labelled rows, each a
sum of vectors of fixed size over all of them: document frequencies; weights, by
follow-the-regularised-leader with elastic-net penalties, where every task learns online
from its rows and the leaders' states are averaged by their number of rows; and
the temperature with the least log loss on labelled rows that the weights have not seen.
No row is sampled or dropped, so the work grows with the input alone.

Which labelled rows serve for what is fixed by crc32(id as text) mod 5: 0 is held out, 1
sets the temperature, 2 to 4 the weights.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when there
was nothing to learn from; ties go to the language that sorts first; very long texts
are taken whole, in blocks; rows with a null language or id are not learned from; repeated rows
count each time; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, vector_rows, vector_sum

UNDETERMINED = "und"
#: Code points that are hashed at once.
BLOCK = 1 << 18
TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(20), 80))


@dataclass(frozen=True)
class Settings:
    bits: int = 13
    orders: int = 3
    #: FTRL: learning rate, its damping, and the elastic-net penalties.
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.01
    batch: int = 8
    #: Passes over the rows; each starts from the average that the one before gave.
    rounds: int = 2

    @property
    def buckets(self) -> int:
        return 1 << self.bits


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, points, np.uint32(32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str, settings: Settings) -> np.ndarray:
    """Counts of a text's hashed character n-grams."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    points = points[~(space & np.r_[False, space[:-1]])] if len(points) else points
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    out = np.zeros(settings.buckets, np.int64)
    shift = np.uint32(32 - settings.bits)
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK + settings.orders - 1]  # grams that start in this block
        h = np.full(len(part), 0x9E3779B1, np.uint32)
        for n in range(settings.orders):
            h = (h[: len(part) - n] ^ part[n:]) * np.uint32(0x85EBCA6B)
            h = h ^ (h >> np.uint32(13))
            out += np.bincount((h[:BLOCK] * np.uint32(0xC2B2AE35)) >> shift, minlength=settings.buckets)
            if len(h) < 2:
                break
            h = h[:-1]
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    settings: Settings

    def features(self, counts: np.ndarray) -> np.ndarray:
        return tf_idf(counts, self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        if at:
            logits = self.features(np.stack([gram_counts(texts[i], self.settings) for i in at])) @ self.weights
            p = softmax(logits / self.temperature)
            for i, best, row in zip(at, logits.argmax(1), p, strict=True):
                langs[i], scores[i] = self.languages[best], float(row[best])
        return langs, scores


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length, and a last column of ones for the bias."""
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.hstack([x, np.ones((len(x), 1))])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def leader(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of the state (z, n): zero where the gradients' sum is within the L1 penalty."""
    return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def follow(z: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, s: Settings) -> None:
    """One step of follow-the-regularised-leader, in place."""
    w = leader(z, n, s)
    p = softmax(x @ w)
    p[np.arange(len(y)), y] -= 1
    g = x.T @ p / len(y)
    n2 = n + g * g
    z += g - (np.sqrt(n2) - np.sqrt(n)) / s.alpha * w
    n[:] = n2


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def _batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list]]:
    for batch in it:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            keep = [(t, y) for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if has_letter(t)]
            if keep:
                yield [t for t, _ in keep], [y for _, y in keep]


def _learner(state: np.ndarray, place: dict[str, int], idf: np.ndarray, settings: Settings):
    """A task's share of a round: its leader's state after its rows, times their number."""

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (half.reshape(-1, len(place)).copy() for half in np.split(state, 2))
        seen = 0
        for texts, names in _batches(it, settings.batch):
            follow(z, n, tf_idf(np.stack([gram_counts(t, settings) for t in texts]), idf), np.array([place[x] for x in names]), settings)
            seen += len(texts)
        if seen:
            yield vector_rows(np.concatenate([z.ravel() * seen, n.ravel() * seen, [seen]]))

    return learn


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold(id_col).alias("fold")).where(
        "text is not null and lang is not null and fold <> 0"
    )
    languages = sorted(r.lang for r in rows.where("fold > 1").select("lang").distinct().collect())
    size, k = settings.buckets, len(languages)
    if not languages:
        return LanguageModel([], np.zeros(size), np.zeros((size + 1, 0)), 1.0, settings)
    place = {name: i for i, name in enumerate(languages)}

    def frequencies(it):
        total = np.zeros(size + 1)
        for texts, _ in _batches(it, 64):
            for t in texts:
                total[:-1] += gram_counts(t, settings) > 0
            total[-1] += len(texts)
        yield vector_rows(total)

    df = vector_sum(rows.select("text", "lang").mapInArrow(frequencies, VECTOR_SCHEMA), size + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    cells = (size + 1) * k
    state = np.zeros(2 * cells)
    learned = rows.where("fold > 1").select("text", "lang")
    for _ in range(settings.rounds):
        state = vector_sum(learned.mapInArrow(_learner(state, place, idf, settings), VECTOR_SCHEMA), 2 * cells + 1)
        state = state[:-1] / max(state[-1], 1)
    weights = leader(state[:cells].reshape(-1, k), state[cells:].reshape(-1, k), settings)

    def loss(it):
        total = np.zeros(len(TEMPERATURES))
        for texts, names in _batches(it, 64):
            known = [(t, place[x]) for t, x in zip(texts, names, strict=True) if x in place]
            if known:
                logits = tf_idf(np.stack([gram_counts(t, settings) for t, _ in known]), idf) @ weights
                y = np.array([i for _, i in known])
                for i, temperature in enumerate(TEMPERATURES):
                    total[i] -= np.log(np.maximum(softmax(logits / temperature)[np.arange(len(y)), y], 1e-300)).sum()
        yield vector_rows(total)

    losses = vector_sum(rows.where("fold = 1").select("text", "lang").mapInArrow(loss, VECTOR_SCHEMA), len(TEMPERATURES))
    return LanguageModel(languages, idf, weights, float(TEMPERATURES[losses.argmin()]) if losses.any() else 1.0, settings)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                langs, scores = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    names = [id_col, "held_out", "lang_pred", "score"]
    return rows.mapInArrow(run, rows.select(id_col, "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def language_id(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return identify(docs, train(docs, settings, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language with a score of ``least_score`` at least; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                langs, scores = shared.value.predict(part.column(part.schema.names.index(text_col)).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and score >= least_score for lang, score in zip(langs, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
