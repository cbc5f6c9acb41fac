import math
import zlib
from collections import Counter

import numpy as np

from quillgraph.llm.language_id import Settings, follow, gram_counts, language_id, leader, tf_idf, train

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"
WORDS = {"en": "the and of to in that is was for with", "de": "der die und das nicht ein ist mit für über", "fr": "le la les être été où déjà avec pour dans"}


def rows(n=240, words=WORDS):
    out = []
    for i in range(n):
        lang = sorted(words)[i % len(words)]
        w = words[lang].split()
        out.append((i, " ".join(w[(i * 7 + j * (i % 5 + 1)) % len(w)] for j in range(30)), lang, "clash", 1))
    return out


def plain_counts(text, settings):
    """Grams of the cleaned text, one at a time, hashed in Python integers."""
    cleaned, last = " ", " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            cleaned += c
        last = c
    cleaned += " "
    out, mask = Counter(), 0xFFFFFFFF
    for at in range(len(cleaned)):
        h = 0x9E3779B1
        for c in cleaned[at : at + settings.orders]:
            h = (h ^ ord(c)) * 0x85EBCA6B & mask
            h ^= h >> 13
            out[(h * 0xC2B2AE35 & mask) >> (32 - settings.bits)] += 1
    return [out[i] for i in range(settings.buckets)]


def test_grams_equal_a_plain_loop():
    s = Settings(bits=8)
    for text in ("", "a", "The  cat!!sat\n", "ÉTÉ straße 123 中文字", "x" * 700_000 + "yz"):
        assert gram_counts(text, s).tolist() == plain_counts(text, s)


def test_held_out_accuracy_and_calibration(spark):
    data = rows()
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(data, SCHEMA)).collect()}
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(0 < got[r[0]].score <= 1 for r in data)


def test_weights_are_sparse_and_labels_of_other_folds_do_not_count(spark):
    data = rows()
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else g, a, b) for i, t, g, a, b in data]
    a, b = (train(spark.createDataFrame(d, SCHEMA).coalesce(1)) for d in (data, changed))
    assert a.languages == b.languages == ["de", "en", "fr"]
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature
    assert 0 < (a.weights != 0).mean() < 0.5 and math.isfinite(a.temperature)


def test_texts_without_letters_nulls_and_no_rows(spark):
    odd = [(1000, None, "en", "", 0), (1001, "", "en", "", 0), (1002, "123 !? ...", "de", "", 0), (None, "the and of", "en", "", 0), (1003, "der die und", None, "", 0), (1004, "the of " * 100_000, "en", "", 0)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows() + odd + odd[:1], SCHEMA)).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "en" and not got[None].held_out and got[1003].lang_pred == "de" and got[1004].lang_pred == "en"
    assert language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [(r.lang_pred, r.score) for r in language_id(spark.createDataFrame([(1, "abc", None, "", 0)], SCHEMA)).collect()] == [("und", 0.0)]


def plain_leader(batches, k, s):
    """Follow-the-regularised-leader, one weight at a time, as in the published algorithm: batch gradients are means."""
    size = s.buckets + 1
    z, n = [[0.0] * k for _ in range(size)], [[0.0] * k for _ in range(size)]

    def weight(i, j):
        if abs(z[i][j]) <= s.l1:
            return 0.0
        return -(z[i][j] - math.copysign(s.l1, z[i][j])) / ((s.beta + math.sqrt(n[i][j])) / s.alpha + s.l2)

    for xs, ys in batches:
        w = [[weight(i, j) for j in range(k)] for i in range(size)]
        g = [[0.0] * k for _ in range(size)]
        for x, y in zip(xs, ys, strict=True):
            logits = [sum(x[i] * w[i][j] for i in range(size)) for j in range(k)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for i in range(size):
                for j in range(k):
                    g[i][j] += x[i] * (e[j] / sum(e) - (j == y)) / len(ys)
        for i in range(size):
            for j in range(k):
                sigma = (math.sqrt(n[i][j] + g[i][j] ** 2) - math.sqrt(n[i][j])) / s.alpha
                z[i][j] += g[i][j] - sigma * w[i][j]
                n[i][j] += g[i][j] ** 2
    return [[weight(i, j) for j in range(k)] for i in range(size)]


def test_follow_equals_a_plain_loop():
    s = Settings(bits=5, l1=0.02)
    data = rows(48)
    languages = sorted(WORDS)
    counts = np.stack([gram_counts(t, s) for _, t, *_ in data])
    x = tf_idf(counts, np.log(49 / (1 + (counts > 0).sum(0))) + 1)
    y = np.array([languages.index(r[2]) for r in data])
    z, n = np.zeros((s.buckets + 1, 3)), np.zeros((s.buckets + 1, 3))
    batches = [(x[i : i + 6], y[i : i + 6]) for i in range(0, 48, 6)]
    for a, b in batches:
        follow(z, n, a, b, s)
    want = np.array(plain_leader([(a.tolist(), b.tolist()) for a, b in batches], 3, s))
    got = leader(z, n, s)
    assert np.allclose(got, want, atol=1e-9) and 0 < (got == 0).sum() < got.size


def test_training_averages_states_and_picks_the_temperature(spark):
    """One split: the states of each round are those of a plain run over its rows; the temperature has the least log loss."""
    s = Settings(bits=6)
    data = rows(150)
    model = train(spark.createDataFrame(data, SCHEMA).coalesce(1), s)
    fold = lambda r: zlib.crc32(str(r[0]).encode()) % 5
    learned, tuned = [r for r in data if fold(r) > 1], [r for r in data if fold(r) == 1]
    counts = np.stack([gram_counts(r[1], s) for r in data if fold(r) != 0])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    assert np.allclose(model.idf, idf)
    features = lambda rs: tf_idf(np.stack([gram_counts(r[1], s) for r in rs]), idf)
    y = np.array([model.languages.index(r[2]) for r in learned])
    x, (z, n) = features(learned), (np.zeros((s.buckets + 1, 3)) for _ in range(2))
    for _ in range(s.rounds):
        for at in range(0, len(y), s.batch):
            follow(z, n, x[at : at + s.batch], y[at : at + s.batch], s)
    assert np.allclose(model.weights, leader(z, n, s), atol=1e-9)
    logits, y = features(tuned) @ model.weights, [model.languages.index(r[2]) for r in tuned]

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(1, keepdims=True))
        return -np.log((e / e.sum(1, keepdims=True))[np.arange(len(y)), y]).sum()

    from quillgraph.llm.language_id import TEMPERATURES

    assert loss(model.temperature) <= min(map(loss, TEMPERATURES)) + 1e-9
