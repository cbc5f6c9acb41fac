import random

import numpy as np

from quillgraph.llm.mixing import Mixture, fit, fit_rates, mix, mixing_rates

DOCS, LABELS = "doc_id long, text string, rate string, n int", "doc_id long, quality int, toxic int, domain string"
MIXTURE = Mixture({"clean": 0.6, "low": 0.3, "toxic": 0.1}, "clean", growth=1.25, buckets=4096)


def corpus(n=900):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["clean"] * 6 + ["low"] * 3 + ["toxic"])
        text = rng.choices(words, k=rng.randint(20, 60))
        text = [w + "!!" for w in text] if kind == "low" else text
        text += ["idiot", "scum"] if kind == "toxic" else []
        docs.append((i, " ".join(text), "clash", 1))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic"), "clash"))
    return docs, labels


def targets(n, p, mixture):
    base = n @ p
    at = mixture.domains.index(mixture.anchor)
    w = np.array([mixture.weights[d] for d in mixture.domains])
    return mixture.growth * base[at] * w / w[at]


def loss(r, n, p, mixture):
    target = targets(n, p, mixture)
    return ((((r * n) @ p - target) / np.maximum(n @ p, target)) ** 2).sum()


def plain_rates(n, p, mixture):
    """Projected gradient with a diagonal metric in numpy, to its end."""
    base, target = n @ p, targets(n, p, mixture)
    r = np.ones(len(n))
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (((r * n) @ p - target) / np.maximum(base, target)))
    return r


def test_rates_meet_the_targets(spark):
    docs, labels = corpus()
    got = sorted(mixing_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), MIXTURE).collect())
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in got])
    assert n.tolist() == [len(t.split()) for _, t, _, _ in docs] and np.allclose(p.sum(1), 1)
    rates = np.array([r.rate for r in got])
    assert min(rates) >= 0 and np.allclose((rates * n) @ p, targets(n, p, MIXTURE), rtol=1.01 * MIXTURE.tolerance)
    truth = ["toxic" if "idiot" in t else "low" if "!!" in t else "clean" for _, t, _, _ in docs]
    assert np.mean([MIXTURE.domains[k] == t for k, t in zip(p.argmax(1), truth, strict=True)]) > 0.95


def test_overlapping_domains_meet_their_targets_in_few_rounds(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([8, 7, 6], 500)  # no document is of one domain
    n = rng.integers(1, 90, 500).astype(float)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    mixture = Mixture({"a": 0.42, "b": 0.33, "c": 0.25}, "a", growth=1.1)
    steps = fit_rates(members, mixture)
    r = np.ones(500)
    for s in steps:
        r = np.maximum(0, r - p @ np.array(s))
    assert len(steps) <= 10 and np.allclose((r * n) @ p, targets(n, p, mixture), rtol=1.01 * mixture.tolerance)


def test_projection_keeps_rates_nonnegative(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4] * 3, 200)
    n = rng.integers(1, 90, 200).astype(float)
    mixture = Mixture({"a": 0.97, "b": 0.02, "c": 0.01}, "a", growth=1.0)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    r = np.ones(200)
    for s in fit_rates(members, mixture):
        r = np.maximum(0, r - p @ np.array(s))
    # targets out of reach: as near as plain steps to the end
    assert (r == 0).any() and loss(r, n, p, mixture) < 2 * loss(plain_rates(n, p, mixture), n, p, mixture) + 1e-6


def test_posteriors_against_plain_loops(spark):
    import math

    import xxhash

    docs, labels = corpus(120)
    docs += [(900, "W1 w2\tW3!!\n", "", 0), (901, "", "", 0), (902, None, "", 0), (903, "ÀÉ été $$$ 12", "", 0)]
    fitted, members = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), MIXTURE)
    got = {r.doc_id: (r.n, list(r.p)) for r in members.collect()}
    for i, text, *_ in docs:
        text = text or ""
        words = [w for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
        hashed = {int.from_bytes(xxhash.xxh64_digest(w.encode(), 42), "big", signed=True) % MIXTURE.buckets for w in words}
        capitals = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text)
        symbols = sum(not (c.isalpha() or c.isdigit() or c.isspace() or c in ".,") for c in text)
        size = max(len(text), 1)
        buckets = [*hashed, MIXTURE.buckets + 10 * capitals // size, MIXTURE.buckets + 11 + 10 * symbols // size]
        logs = [prior + sum(likelihood[b] for b in buckets) for prior, *likelihood in fitted.model]
        raised = [math.exp(0.5 * (x - max(logs))) for x in logs]
        assert got[i][0] == len(words) and np.allclose(got[i][1], [x / sum(raised) for x in raised])


def test_mix_repeats_and_drops(spark):
    docs, labels = corpus()
    rows, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rate = {r.doc_id: r.rate for r in mixing_rates(rows, known, MIXTURE).collect()}
    mixed = mix(rows, known, MIXTURE)
    assert mixed.columns == rows.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for i, x in rate.items():
        assert int(x) <= copies.get(i, 0) <= int(x) + 1
    assert abs(sum(copies.values()) - sum(rate.values())) < 60


def test_nulls_repeats_long_texts_and_no_rows(spark):
    docs, labels = corpus(60)
    docs += [(None, None, "", 0), (700, "", "", 0), (701, "w1 " * 100_000, "", 0), (701, "w1 " * 100_000, "", 0)]
    labels += [(None, 1, 1, ""), (701, None, None, ""), (3, 0, 1, ""), (9999, 1, 0, "")]
    got = mixing_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), MIXTURE).collect()
    assert len(got) == len(docs) and all(r.rate >= 0 for r in got)
    assert len({r.rate for r in got if r.doc_id == 701}) == 1 and [r.n_tokens for r in got if r.doc_id in (None, 700)] == [0, 0]
    none = spark.createDataFrame([], LABELS)
    equal = mixing_rates(spark.createDataFrame(docs[:5], DOCS), none, MIXTURE).first()
    assert abs(equal.p_clean - 1 / 3) < 0.25
    assert mixing_rates(spark.createDataFrame([], DOCS), none, MIXTURE).count() == mix(spark.createDataFrame([], DOCS), none, MIXTURE).count() == 0
