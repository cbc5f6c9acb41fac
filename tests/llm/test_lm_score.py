import math
import random

import numpy as np

from quillgraph.llm import lm_score as module
from quillgraph.llm.lm_score import Coder, Learner, Settings, averaged, first_weights, lexicon, lm_scores, log_probabilities, places_of_round, score, train, unpack_weights, windows, words_of

SCHEMA = "doc_id long, text string, n_tokens string, pseudo_log_likelihood int"
SMALL = Settings(classes=6, per_class=6, hashed=4, width=5, batch=64)


def corpus(n=200):
    rng = random.Random(1)
    return [(i, " ".join(w for _ in range(rng.randint(5, 20)) for w in rng.choice(["the cat sat", "a dog ran", "on the mat"]).split()), "", 0) for i in range(n)]


def plain_score(text, model):
    """Every token by itself, every probability from a full sum."""
    s, w = model.settings, unpack_weights(model.weights, model.settings)
    codes = Coder(model.lexicon.words, s)(words_of(text))
    ids, total = model.lexicon.ids[codes], float(model.lexicon.shares[codes].sum())
    for i, target in enumerate(ids):
        h = np.zeros(s.width)
        for k, d in enumerate(s.offsets):
            h += w["window"][k][ids[i + d] if 0 <= i + d < len(ids) else s.size]
        h = np.tanh(h)
        e = [math.exp(x) for x in h @ w["out_class"] + w["bias_class"]]
        c, j = divmod(int(target), s.per_class)
        f = [math.exp(x) for x in h @ w["out_word"][c] + w["bias_word"][c]]
        total += math.log(e[c] / sum(e)) + math.log(f[j] / sum(f))
    return total


def test_scores_equal_a_plain_loop(spark):
    docs = spark.createDataFrame(corpus() + [(900, None, "", 0), (901, " \n", "", 0), (902, "unseen words here THE Cat", "", 0), (903, "the cat " * 30_000, "", 0), (903, "the cat " * 30_000, "", 0)], SCHEMA)
    model = train(docs, SMALL)
    got = {}
    for r in score(docs, model).collect():
        assert got.setdefault(r.doc_id, r) == r
    for i, text, _, _ in [*corpus(20), (902, "unseen words here THE Cat", 0, 0), (903, "the cat " * 30_000, 0, 0)]:
        assert got[i].n_tokens == len(text.split())
        assert abs(got[i].pseudo_log_likelihood - plain_score(text, model)) < 1e-3 * got[i].n_tokens
    assert [(got[i].n_tokens, got[i].pseudo_log_likelihood, got[i].mean_log_probability) for i in (900, 901)] == [(0, 0.0, None)] * 2


def test_training_beats_the_shares_and_orders_texts(spark):
    docs = spark.createDataFrame(corpus(800), SCHEMA)
    trained = train(docs, SMALL)
    untrained = train(docs, Settings(**(SMALL.__dict__ | {"rounds": 0})))
    mean = lambda m: score(docs, m).groupBy().avg("mean_log_probability").first()[0]
    assert mean(trained) > mean(untrained) + 0.2
    shuffled = spark.createDataFrame([(1, "the cat sat on the mat a dog ran", "", 0), (2, "cat the the on sat dog mat ran a", "", 0)], SCHEMA)
    good, bad = sorted(score(shuffled, trained).collect())
    assert good.pseudo_log_likelihood > bad.pseudo_log_likelihood


def test_gradient():
    """A step lowers the loss on its own batch, and all probabilities of a place sum to 1."""
    s = SMALL
    rng = np.random.default_rng(0)
    ids = rng.integers(0, s.size, 200)
    around = windows(ids, np.arange(200), s)
    learner = Learner(first_weights(np.ones(s.size), s), s)
    before = log_probabilities(learner.w, around, ids, s).mean()
    for _ in range(5):
        learner.learn(around, ids)
    assert log_probabilities(learner.w, around, ids, s).mean() > before
    total = sum(np.exp(log_probabilities(learner.w, around[:1], np.array([t]), s))[0] for t in range(s.size))
    assert abs(total - 1) < 1e-5


def test_training_steps_equal_plain_gradients():
    """One step of every weight against differences of the summed loss."""
    s = Settings(classes=3, per_class=3, hashed=2, width=4, batch=16)
    rng = np.random.default_rng(5)
    ids = rng.integers(0, s.size, 12)
    around = windows(ids, np.arange(12), s)
    start = {k: rng.standard_normal(v.shape) * 0.3 for k, v in first_weights(np.ones(s.size), s).items()}
    learner = Learner({k: v.copy() for k, v in start.items()}, s)
    learner.learn(around, ids)
    for name, x in start.items():
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(12)]:
            def loss(change, name=name, at=at):
                w = {k: v.copy() for k, v in start.items()}
                w[name][at] += change
                return -log_probabilities(w, around, ids, s).sum()

            g = (loss(1e-4) - loss(-1e-4)) / 2e-4
            assert abs(learner.w[name][at] - (x[at] - s.rate * g / math.sqrt(1 + g * g))) < 1e-4, (name, at)


def test_weights_are_averaged_by_use():
    s = Settings(classes=3, per_class=3, hashed=2, width=4, batch=16)
    start = first_weights(np.ones(s.size), s)
    one, two = (Learner({k: v.copy() for k, v in start.items()}, s) for _ in range(2))
    ids = [np.array([0, 1, 0, 1]), np.array([2, 2, 2])]
    for learner, x in zip((one, two), ids, strict=True):
        learner.learn(windows(x, np.arange(len(x)), s), x)
    flat = module._flat(start)
    got = unpack_weights(averaged(flat, one.share() + two.share(), s), s)
    assert np.allclose(got["window"][:, 1], one.w["window"][:, 1], atol=1e-6) and np.allclose(got["window"][:, 2], two.w["window"][:, 2], atol=1e-6)
    assert np.allclose(got["window"][:, 5], start["window"][:, 5]) and np.allclose(got["bias_class"], (4 * one.w["bias_class"] + 3 * two.w["bias_class"]) / 7, atol=1e-6)


def test_words_share_their_entry_by_their_counts(spark):
    rows = [("a " * 9 + "b " * 8 + "c c c c d d d e e f g h",)] * 2
    texts = spark.createDataFrame(rows, "text string")
    s = Settings(classes=2, per_class=2, hashed=2, listed=5, width=2)
    lex = lexicon(texts, s)
    assert lex.words[:2] == ["a", "b"] and set(lex.words) == set("abcde")
    n = dict(a=18, b=16, c=8, d=6, e=4, f=2, g=2, h=2)
    for w in "cde":
        mates = sum(n[x] for x in "cdefgh" if module.entry(x, s) == module.entry(w, s))
        assert abs(math.exp(lex.shares[lex.words.index(w)]) - n[w] / mates) < 1e-6
    coder = Coder(lex.words, s)
    for w in "fgh":  # each has the mean count of its entry's unlisted words
        mates = sum(n[x] for x in "cdefgh" if module.entry(x, s) == module.entry(w, s))
        assert abs(math.exp(lex.shares[coder[w]]) - 2 / mates) < 1e-6
    assert sum(lex.counts) == 58


def test_words_beyond_the_list_have_their_own_counts(spark):
    """Scores do not depend on how many words are listed."""
    from dataclasses import replace

    from quillgraph.llm.lm_score import MaskedModel, coded_texts, lexicon, score_coded, train_coded

    rows = [(1, "a " * 9 + "b " * 8 + "c c c d d e f g"), (2, "a h h i b c"), (3, None), (4, ""), (None, "i i j a b new"), (1, "a h h i b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    known = docs.where("text not like '%new%'").selectExpr("coalesce(text, '') as text")
    full = Settings(classes=2, per_class=2, hashed=2, listed=50, width=2)
    lex = lexicon(known, full)
    assert lex.others is None
    coded = coded_texts(docs, lex, full, "doc_id", "text")
    weights = train_coded(coded, lex, full).weights
    want = sorted(map(str, ((r.doc_id, r.n_tokens, round(r.pseudo_log_likelihood, 4)) for r in score_coded(coded, MaskedModel(lex, weights, full), "doc_id").where("doc_id is not null").collect())))
    for listed in (5, 3):
        s = replace(full, listed=listed)
        short = lexicon(known, s)
        assert short.others is not None and len(short.words) < len(lex.words)
        got = score_coded(coded_texts(docs, short, s, "doc_id", "text"), MaskedModel(short, weights, s), "doc_id")
        assert got.columns == ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"] and got.count() == len(rows)
        assert sorted(map(str, ((r.doc_id, r.n_tokens, round(r.pseudo_log_likelihood, 4)) for r in got.where("doc_id is not null").collect()))) == want


def test_no_rows(spark):
    assert lm_scores(spark.createDataFrame([], SCHEMA), SMALL).count() == 0


def test_rounds_learn_from_every_place_once_and_copies_differ(spark):
    s = Settings()
    n = 3 * module.BLOCK + 50
    assert s.rounds >= 2
    assert sorted(p for r in range(s.rounds) for p in places_of_round(n, 7, r, s).tolist()) == list(range(n))
    assert len({tuple(places_of_round(50, key, 0, s).tolist()) for key in range(40)}) == 2
