"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from a window on both sides: each place in the window has an
embedding table, their sum goes through tanh, and a two-level softmax gives the token's class
and the token within its class. A document's score is the sum of the logarithms of all its
tokens' conditional probabilities.

Tokens are lower-cased words. All words of all documents are counted into a stored table. The
most frequent are entries of the network, sorted by frequency into classes; the others share
hashed entries, whose probability is dealt among their words by their counts in the whole
corpus. The counts of ``listed`` words travel to the tasks, a list of bounded length; those of the others stay in the cluster and are joined
to the documents that hold these words, whose scores are put right by them. So each word's probability follows its own count,
at any size. Only a word that the corpus does not have at all counts as its entry's unlisted words do in the mean.

Texts are turned into numbers once, and stored. Training deals every document's blocks of places
to rounds (by a hash of row id, text and block), so that all rounds together learn from each place once.
In a round every task starts from the common weights and learns in numpy, with steps that adapt to
each weight; Spark then averages the tasks' weights, each row of a table by how often the task used
it, so that rare words keep what the few tasks that met them learned.

Defined results: a null text, or one without words, has no tokens, a score of 0 and a null mean;
very long texts are scored whole, in blocks; repeated rows get equal scores; an empty table
gives no rows; words that are equally frequent are taken in the order of their hash; only the named
columns are read. Weights are averages over tasks, so scores depend (a little) on how the
input is split; within one run they are those of one model.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, blank, store, vector_rows, vector_sum

#: Words whose ids a task remembers, about 100 bytes each.
REMEMBERED = 1_000_000
#: Places of a text that one round learns from together.
BLOCK = 4096
#: Rows of one class that are multiplied together.
CHUNK = 32


@dataclass(frozen=True)
class Settings:
    classes: int = 48
    per_class: int = 48
    hashed: int = 256
    listed: int = 200_000
    reach: int = 2
    width: int = 16
    rounds: int = 2
    rate: float = 0.2
    batch: int = 8192

    @property
    def size(self) -> int:
        """Entries of the network; below 2^16, as places are sorted by them in two bytes."""
        return self.classes * self.per_class

    @property
    def offsets(self) -> list[int]:
        return [d for d in range(-self.reach, self.reach + 1) if d]

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """size + 1 is what lies outside a text."""
        v, w = self.size, self.width
        return {"window": (2 * self.reach, v + 1, w), "out_class": (w, self.classes), "bias_class": (self.classes,), "out_word": (self.classes, w, self.per_class), "bias_word": (self.classes, self.per_class)}

    def use_shapes(self) -> dict[str, tuple[int, ...]]:
        """Of the counts by which weights are averaged; they spread over the weights' shapes."""
        return {"window": (2 * self.reach, self.size + 1, 1), "out_class": (1, 1), "bias_class": (1,), "out_word": (self.classes, 1, 1), "bias_word": (self.classes, 1)}


Weights = dict[str, np.ndarray]


def _flat(arrays: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in arrays.values()])


def _shaped(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Weights:
    out, at = {}, 0
    for k, shape in shapes.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def unpack_weights(flat: np.ndarray, s: Settings) -> Weights:
    return _shaped(flat.astype(np.float32), s.shapes())


def first_weights(counts: np.ndarray, s: Settings) -> Weights:
    """Small random embeddings; biases that give each token its share of the corpus."""
    rng = np.random.default_rng(11)
    out = {k: np.zeros(shape, np.float32) for k, shape in s.shapes().items()}
    for k in ("window", "out_class", "out_word"):
        out[k] = (rng.standard_normal(out[k].shape) * 0.1).astype(np.float32)
    by_class = (counts + 1.0).reshape(s.classes, s.per_class)
    out["bias_class"] = np.log(by_class.sum(1) / by_class.sum()).astype(np.float32)
    out["bias_word"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    return out


def words_of(text: str) -> list[str]:
    return text.lower().split()


def entry(word: str, s: Settings) -> int:
    """The hashed entry of a word that has none of its own."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % s.hashed


@dataclass(frozen=True)
class Lexicon:
    """Words by code: entries of the network first, then those listed with a count, then one code for all others of each hashed entry."""

    words: list[str]
    ids: np.ndarray
    shares: np.ndarray  # log of a word's part in its entry
    counts: np.ndarray  # tokens of each entry
    others: DataFrame | None = None  # word, more: of the words that are not listed, where there are some; stays in the cluster


class Coder(dict):
    """Codes of words; those that are not listed are remembered, up to a number."""

    def __init__(self, words: list[str], s: Settings):
        super().__init__((w, i) for i, w in enumerate(words))
        self.listed, self.settings = len(words), s

    def __missing__(self, word: str) -> int:
        code = self.listed + entry(word, self.settings)
        if len(self) < REMEMBERED:
            self[word] = code
        return code

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def windows(ids: np.ndarray, places: np.ndarray, s: Settings) -> np.ndarray:
    """Ids around each place; what lies outside is ``size``."""
    padded = np.concatenate([np.full(s.reach, s.size), ids, np.full(s.reach, s.size)])
    return np.stack([padded[places + s.reach + d] for d in s.offsets], axis=1)


def _exponentials(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """exp of the logits x of hidden values from -1 to 1, in place; moved by their last axis' maxima only where the weights could make them too large."""
    if x.size and (np.abs(weights).sum(axis=-2) + np.abs(bias)).max() > 60:
        x -= x.max(axis=-1, keepdims=True)
    return np.exp(x, out=x)


def _order(ids: np.ndarray) -> np.ndarray:
    """A stable order; short numbers are sorted by their digits, which takes one pass for each byte."""
    return np.argsort(ids.astype(np.uint16), kind="stable")


def _hidden(w: Weights, around: np.ndarray) -> np.ndarray:
    total = w["window"][0][around[:, 0]]
    for i in range(1, around.shape[1]):
        total += w["window"][i][around[:, i]]
    return np.tanh(total, out=total)


def _dealt(classes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows by class in chunks of CHUNK: each chunk's class, and each slot's row (the number of rows where a chunk is not full)."""
    sizes = np.bincount(classes, minlength=s.classes)
    chunks = -(-sizes // CHUNK)
    order = _order(classes)
    within = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slots = np.full(int(chunks.sum()) * CHUNK, len(classes))
    slots[((np.cumsum(chunks) - chunks) * CHUNK)[classes[order]] + within] = order
    return np.repeat(np.arange(s.classes), chunks), slots


def log_probabilities(w: Weights, around: np.ndarray, targets: np.ndarray, s: Settings) -> np.ndarray:
    """Of each target given what surrounds it."""
    n = len(targets)
    if not n:
        return np.zeros(0)
    h = _hidden(w, around)
    classes, inner = targets // s.per_class, targets % s.per_class

    e = _exponentials(h @ w["out_class"] + w["bias_class"], w["out_class"], w["bias_class"])
    out = np.log(e[np.arange(n), classes] / e.sum(axis=1)).astype(np.float64)
    chunk_class, slots = _dealt(classes, s)
    x = np.append(h, h[:1], axis=0)[slots].reshape(len(chunk_class), CHUNK, -1) @ w["out_word"][chunk_class]
    x += w["bias_word"][chunk_class][:, None]
    e = _exponentials(x, w["out_word"], w["bias_word"]).reshape(len(slots), -1)
    real = np.flatnonzero(slots < n)
    rows = slots[real]
    out[rows] += np.log(e[real, inner[rows]] / e.sum(axis=1)[real])
    return out


class Learner:
    """Weights of one task, with what each step needs to adapt, and how often each row was used."""

    def __init__(self, weights: Weights, s: Settings):
        self.w, self.s = weights, s
        self.squares = {k: np.ones_like(x) for k, x in weights.items()}
        self.uses = {k: np.zeros(shape) for k, shape in s.use_shapes().items()}

    def _step(self, name: str | tuple[str, int], rows, gradient: np.ndarray) -> None:
        w, squares = (x[name] if isinstance(name, str) else x[name[0]][name[1]] for x in (self.w, self.squares))
        total = squares[rows] + gradient * gradient
        squares[rows] = total
        w[rows] -= self.s.rate * gradient / np.sqrt(total)

    def learn(self, around: np.ndarray, targets: np.ndarray) -> None:
        """One step down the gradient of the summed loss."""
        w, s, n = self.w, self.s, len(targets)
        if not n:
            return
        h = _hidden(w, around)
        classes, inner = targets // s.per_class, targets % s.per_class
        g = _exponentials(h @ w["out_class"] + w["bias_class"], w["out_class"], w["bias_class"])
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(n), classes] -= 1

        chunk_class, slots = _dealt(classes, s)
        real = slots < n
        hc = np.append(h, np.zeros((1, s.width), np.float32), axis=0)[slots].reshape(len(chunk_class), CHUNK, -1)
        out = w["out_word"][chunk_class]
        x = hc @ out
        x += w["bias_word"][chunk_class][:, None]
        x = _exponentials(x, w["out_word"], w["bias_word"]).reshape(len(slots), -1)
        x *= (real / x.sum(axis=1)).astype(x.dtype)[:, None]
        place = np.empty(n, np.int64)
        place[slots[real]] = np.flatnonzero(real)
        x[place, inner] -= 1
        x = x.reshape(hc.shape[0], CHUNK, -1)
        gh = g @ w["out_class"].T
        gh += (x @ out.transpose(0, 2, 1)).reshape(len(slots), -1)[place]

        first = np.flatnonzero(np.r_[True, chunk_class[1:] != chunk_class[:-1]])
        seen = chunk_class[first]
        self._step("out_word", seen, np.add.reduceat(hc.transpose(0, 2, 1) @ x, first, axis=0))
        self._step("bias_word", seen, np.add.reduceat(x.sum(axis=1), first, axis=0))
        self._step("out_class", slice(None), h.T @ g)
        self._step("bias_class", slice(None), g.sum(axis=0))
        gh *= 1 - h * h
        for i in range(around.shape[1]):
            order = _order(around[:, i])
            ids = around[order, i]
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            self._step(("window", i), ids[start], np.add.reduceat(gh[order], start, axis=0))
            self.uses["window"][i, ids[start], 0] += np.diff(np.append(start, n))
        sizes = np.bincount(classes, minlength=s.classes)
        self.uses["out_word"][:, 0, 0] += sizes
        self.uses["bias_word"][:, 0] += sizes
        self.uses["out_class"] += n
        self.uses["bias_class"] += n

    def share(self) -> np.ndarray:
        """The weights times their uses, and the uses: what Spark adds up."""
        return np.concatenate([_flat({k: x * self.uses[k] for k, x in self.w.items()}), _flat(self.uses)])


def averaged(before: np.ndarray, total: np.ndarray, s: Settings) -> np.ndarray:
    """The tasks' mean weights by use; rows that no task used stay."""
    sums, uses = _shaped(total[: len(before)], s.shapes()), _shaped(total[len(before) :], s.use_shapes())
    old = _shaped(before, s.shapes())
    return _flat({k: np.where(uses[k] > 0, sums[k] / np.maximum(uses[k], 1), old[k]) for k in old}).astype(np.float32)


def places_of_round(n: int, key: int, round_: int, s: Settings) -> np.ndarray:
    """The places of a text that a round learns from: whole blocks, each in one round."""
    blocks = np.arange(-(-n // BLOCK), dtype=np.uint64)
    mixed = (blocks * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)) * np.uint64(0xC2B2AE3D27D4EB4F)
    chosen = np.flatnonzero((mixed >> np.uint64(33)) % np.uint64(s.rounds) == np.uint64(round_))
    return np.concatenate([np.arange(0), *[np.arange(b * BLOCK, min(n, (b + 1) * BLOCK)) for b in chosen.tolist()]])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of all texts, stored: it grows with the corpus and stays in the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > 500_000:
                    yield rows()
                    seen.clear()
        yield rows()

    parts = texts.mapInArrow(count, "word string, n long")
    return store(parts.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


#: Parts of a level that a hash tells apart.
STEPS = 1 << 20


def _most_frequent(counts: DataFrame, most: int) -> tuple[list, Column]:
    """Rows (word, n), and the condition on these, of about ``most`` most frequent words: whole levels of frequency, and of the next one what a hash cut leaves. No task or driver ranks more."""
    of = F.floor(F.log2(F.col("n")) * 64)  # 64 steps to an octave: few levels, whatever the corpus
    levels = counts.groupBy(of.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    left, wanted = most, F.lit(False)
    for level, words in sorted(levels, reverse=True):
        if words <= left:
            left, wanted = left - words, of >= level
            continue
        cut = F.pmod(F.xxhash64("word"), F.lit(STEPS)) < int(STEPS * left / words)
        wanted = wanted | ((of == level) & cut)
        break
    return counts.where(wanted).withColumn("h", F.xxhash64("word")).collect(), wanted


def lexicon(texts: DataFrame, s: Settings) -> Lexicon:
    counts = word_counts(texts)
    slot: Column = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(s.hashed)).cast("int")
    mass, words = np.zeros(s.hashed), np.zeros(s.hashed)
    for j, n, distinct in counts.groupBy(slot.alias("j")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        mass[j], words[j] = n, distinct
    frequent, is_listed = _most_frequent(counts, s.listed)
    top = sorted(frequent, key=lambda r: (-r.n, r.h, r.word))
    own, first = top[: s.size - s.hashed], s.size - s.hashed
    n, listed = np.array([r.n for r in top], float), [r.word for r in top]
    slots = np.array([entry(w, s) for w in listed], np.int64)
    k = len(own)
    mass -= np.bincount(slots[:k], n[:k], s.hashed)  # of hashed words alone
    rest = mass - np.bincount(slots[k:], n[k:], s.hashed)
    unlisted = words - np.bincount(slots, minlength=s.hashed)
    usual = rest / np.maximum(unlisted, 1)  # a new word counts as one more of these
    shares = np.concatenate([np.zeros(k), np.log(n[k:] / mass[slots[k:]]), np.log(np.maximum(usual, 1) / np.maximum(mass, 1))])
    ids = np.concatenate([np.arange(k), first + slots[k:], first + np.arange(s.hashed)]).astype(np.int32)
    by_entry = np.zeros(s.size)
    by_entry[:k], by_entry[first:] = n[:k], mass
    others = None
    if words.sum() > len(listed):
        # a word's own count instead of its entry's mean: what its share is more than that of its code
        known = np.minimum(shares[len(listed) :].astype(np.float32), 0).astype(float)
        table = F.from_json(F.lit(json.dumps([[max(m, 1.0), x] for m, x in zip(mass.tolist(), known.tolist(), strict=True)])), "array<array<double>>")
        of = F.element_at(table, slot + 1)
        others = counts.where(~is_listed).select("word", (F.least(F.log(F.col("n") / of[0]), F.lit(0.0)) - of[1]).alias("more"))
    return Lexicon(listed, ids, np.minimum(shares, 0).astype(np.float32), by_entry, others)


def coded_texts(docs: DataFrame, lex: Lexicon, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """``id_col, key, codes`` of every row, stored: texts are cut once for training and scoring. Where not all words are listed, ``rare`` (the others, in place) and ``uid`` too."""
    more = lex.others is not None
    shared = docs.sparkSession.sparkContext.broadcast(lex.words)  # ``listed`` words at most
    rows = docs.select(F.col(id_col), F.xxhash64(id_col).alias("key"), blank(F.col(text_col)).alias("text_"), F.monotonically_increasing_id().alias("uid"))
    kinds = {"codes": F.array(F.lit(0)), "rare": F.array(F.lit("")), "uid": F.col("uid")}
    schema = rows.select(id_col, "key", *[c.alias(k) for k, c in kinds.items() if more or k == "codes"]).schema

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, s)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [words_of(t.as_py()) for t in part.column(2)]
                codes = [coder(w) for w in cut]
                ends = np.cumsum([0, *map(len, codes)], dtype=np.int32)
                columns = [part.column(0), part.column(1), pa.ListArray.from_arrays(ends, np.concatenate(codes))]
                if more:
                    at_ = [np.flatnonzero(c >= coder.listed) for c in codes]
                    rare = [w[i] for w, places in zip(cut, at_, strict=True) for i in places.tolist()]
                    columns += [pa.ListArray.from_arrays(np.cumsum([0, *map(len, at_)], dtype=np.int32), pa.array(rare, pa.string())), part.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return store(rows.mapInArrow(run, schema), "lm-codes")


@dataclass(frozen=True)
class MaskedModel:
    lexicon: Lexicon
    weights: np.ndarray
    settings: Settings


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.flatten().to_numpy()
    return [values[a:b] for a, b in zip((offsets - offsets[0])[:-1], (offsets - offsets[0])[1:], strict=True)]


def train_coded(coded: DataFrame, lex: Lexicon, settings: Settings) -> MaskedModel:
    s = settings
    flat = _flat(first_weights(lex.counts, s))
    context = coded.sparkSession.sparkContext
    for round_ in range(s.rounds):
        shared = context.broadcast((lex.ids, flat))  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            ids_of, start = shared.value
            learner, held = Learner(unpack_weights(start, s), s), 0
            around, targets = [], []

            def flush() -> None:
                a, t = np.concatenate(around), np.concatenate(targets)
                for at in range(0, len(t), s.batch):
                    learner.learn(a[at : at + s.batch], t[at : at + s.batch])
                around.clear()
                targets.clear()

            for batch in batches:
                for codes, key in zip(_lists(batch.column(1)), batch.column(0).to_pylist(), strict=True):
                    places = places_of_round(len(codes), (int(codes[:8].sum()) + key) % (1 << 64), round_, s)
                    if not len(places):
                        continue
                    ids = ids_of[codes]
                    around.append(windows(ids, places, s))
                    targets.append(ids[places])
                    held += len(places)
                    if held >= 4 * s.batch:
                        flush()
                        held = 0
            if held:
                flush()
            yield vector_rows(learner.share())

        uses = sum(int(np.prod(x)) for x in s.use_shapes().values())
        flat = averaged(flat, vector_sum(coded.select("key", "codes").mapInArrow(run, VECTOR_SCHEMA), len(flat) + uses), s)
    return MaskedModel(lex, flat, s)


def score_coded(coded: DataFrame, model: MaskedModel, id_col: str) -> DataFrame:
    """``id_col, n_tokens, pseudo_log_likelihood, mean_log_probability`` of every row."""
    s = model.settings
    shared = coded.sparkSession.sparkContext.broadcast((model.lexicon.ids, model.lexicon.shares, model.weights))
    others = model.lexicon.others
    rows = coded.select(id_col, "codes", *["uid"] * (others is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shares, flat = shared.value
        w = unpack_weights(flat, s)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = _lists(part.column(1))
                n = np.array([len(c) for c in lists])
                codes = np.concatenate(lists)
                targets, owner = ids_of[codes], np.repeat(np.arange(len(lists)), n)
                sums = np.bincount(owner, shares[codes], len(lists))
                around = np.concatenate([windows(ids_of[c], np.arange(len(c)), s) for c in lists])
                for a in range(0, len(targets), 16_384):
                    b = a + 16_384
                    sums += np.bincount(owner[a:b], log_probabilities(w, around[a:b], targets[a:b], s), len(lists))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sums), *part.columns[2:]], names)

    made = rows.select(id_col, F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("pseudo_log_likelihood"), *rows.columns[2:]).schema
    names = made.names
    scored = rows.mapInArrow(run, made)
    if others is not None:
        # words of few tokens each: no key of this join is hot
        rare = coded.select("uid", F.explode("rare").alias("word")).join(others, "word").groupBy("uid").agg(F.sum("more").alias("more"))
        total = F.col("pseudo_log_likelihood") + F.coalesce("more", F.lit(0.0))
        scored = scored.join(rare, "uid", "left").select(id_col, "n_tokens", total.alias("pseudo_log_likelihood"))
    return scored.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))


def train(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id") -> MaskedModel:
    lex = lexicon(docs.select(blank(F.col(text_col)).alias("text")), settings)
    return train_coded(coded_texts(docs, lex, settings, id_col, text_col), lex, settings)


def score(docs: DataFrame, model: MaskedModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_coded(coded_texts(docs, model.lexicon, model.settings, id_col, text_col), model, id_col)


def lm_scores(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    lex = lexicon(docs.select(blank(F.col(text_col)).alias("text")), settings)
    coded = coded_texts(docs, lex, settings, id_col, text_col)
    return score_coded(coded, train_coded(coded, lex, settings), id_col)
