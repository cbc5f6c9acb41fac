import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, low=80, high=100, step=10):
    """Over all pairs, with whole numbers."""
    valid = [(i, g, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for *_, v in valid]
    dim = min(set(lengths), key=lambda d: (-lengths.count(d), d), default=0)
    best = {}
    for i, g, v in valid:
        best[i] = min(best.get(i, (g, v)), (g, v))
    valid = [(i, g, v) for i, (g, v) in sorted(best.items()) if len(v) == dim]
    out = []
    for i, g, v in valid:
        if i % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, h) for j, h, w in valid if j != i)
        for p, j, _ in [s for s in scored if s[2] == g][:k]:
            ok = [(s, n) for s, n, h in scored if h != g and low * -p <= 100 * -s <= high * -p][:k]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(ok)]
    return sorted(out)


def got(spark, rows, step=10, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, hard.hard_negatives(df, F.col("id") % step == 0, F.col("label")).collect()))


def clustered(n, dim, seed, labels=4, noise=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    which = rng.integers(0, labels, n)
    v = centres[which] + noise * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in v[i] / np.linalg.norm(v[i])], int(which[i])) for i in range(n)]


def test_against_brute_force_in_blocks_and_shards(spark, monkeypatch):
    for dim, n in ((24, 400), (5, 150), (1, 60)):
        rows = clustered(n, dim, dim)
        want = brute(rows)
        assert want and got(spark, rows) == want
    rows = clustered(300, 20, 3, labels=2, noise=1.5)
    for name, value in (("ANCHOR_ROWS", 7), ("SHARD_ROWS", 50), ("LEAST_SHARD_ROWS", 30), ("STEP_ANCHORS", 4), ("STEP_ROWS", 16)):
        monkeypatch.setattr(hard, name, value)
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_lengths(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, 0.25]) for _ in range(4)], i % 3) for i in range(120)]  # many equal scores
    rows += rows[:30] + [(7, [0.5, 0.5, 0.5, 0.5], 2), (None, [0.5] * 4, 1), (500, None, 1), (510, [0.5] * 4, None)]
    rows += [(520, [0.5, None, 0.5, 0.5], 1), (530, [0.5, float("nan"), 0.5, 0.5], 1), (540, [float("inf"), 0.5, 0.5, 0.5], 0), (550, [0.5] * 3, 0), (560, [], 1)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(0, [1.0, 1.0], 1)]) == [] and got(spark, [(10, [1.0], 1), (20, [1.0], 1)]) == []
    assert got(spark, [(i, [-1.0 if i == 10 else 1.0], i % 2) for i in range(9, 15)]) == brute([(i, [-1.0 if i == 10 else 1.0], i % 2) for i in range(9, 15)])


def test_large_components_and_further_columns(spark):
    rows = [(i, [float(2**e) * (1 + i % 3) for e in (16, 18, 3)], i % 2) for i in range(40)]
    assert got(spark, rows) == brute(rows)
    wide = [(*r, "x", 1, 2.0) for r in clustered(60, 6, 1)]
    assert got(spark, wide, schema=f"{SCHEMA}, id string, q int, goals double") == brute([r[:3] for r in wide])


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(2)
    for dim in (1, 3, 16, 50):
        x = np.floor(256 * rng.normal(size=(30, dim)) + 40)
        mean, dev = hard.summary(x, hard.cuts(dim, 16))
        import pandas as pd

        side = hard.Side(pd.DataFrame({"id": range(30), "label": [0] * 30, "q": list(x), "mean": list(mean), "dev": list(dev)}), dim)
        true, last = x @ x.T, np.inf
        for m, d in side.levels:
            middle, reach = m @ m.T, d @ d.T
            assert np.all(middle - reach - 1e-3 <= true) and np.all(true <= middle + reach + 1e-3)
            assert reach.sum() <= last + 1e-3
            last = reach.sum()
    scored = []
    kept = hard.exact
    monkeypatch.setattr(hard, "exact", lambda a, b, i, j, *rest: scored.append(len(i)) or kept(a, b, i, j, *rest))
    # rows that differ in level, as those of topics do: most are never scored
    rows = np.floor(256 * (np.repeat(rng.normal(size=(4000, 4)) * 3, 8, axis=1) + 0.05 * rng.normal(size=(4000, 32))))
    mean, dev = hard.summary(rows, hard.cuts(32, 16))
    import pandas as pd

    side = hard.Side(pd.DataFrame({"id": range(4000), "label": 0, "q": list(rows), "mean": list(mean), "dev": list(dev)}), 32)
    few = hard.Side(pd.DataFrame({"id": range(40), "label": 0, "q": list(rows[:40]), "mean": list(mean[:40]), "dev": list(dev[:40])}), 32)
    hard.mine(few, side, np.full((40, 1), -np.inf), np.full((40, 1), np.inf), True, 5)
    assert sum(scored[1:]) < 0.1 * 40 * 4000
