import hashlib
import math
import random

import numpy as np
import pandas as pd

from quillgraph.operators import memory as m
from quillgraph.operators import models
from quillgraph.operators import retrieval as r

TEXTS = [(1, "Renal failure renal FAILURE"), (2, "renal\nfailure\tand more"), (3, ""), (4, None), (None, "renal"), (5, "quite other words"), (6, "w " * 20_000)]


def plain_vector(text):
    v = [0.0] * 256
    for w in (text or "").lower().split():
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:2], 16)] += 1 if int(h[2], 16) < 8 else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_hashed_vectors_against_plain_loops_and_search_on_them(spark):
    docs = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id int, text string, v string")
    rows = models.embed(docs, "doc_id", "text")
    got = {x.doc_id: x.v for x in rows.collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6}
    assert all(np.allclose(got[i], plain_vector(t)) for i, t in TEXTS if i)
    items = rows.withColumnRenamed("doc_id", "item_id")
    found = r.dense_search(items, items.where("item_id = 1").withColumnRenamed("item_id", "query_id"), 1, exclude_self=True).collect()
    assert [(x.query_id, x.item_id) for x in found] == [(1, 2)]
    ones = models.embed(docs, "doc_id", "text", lambda b: pd.DataFrame({"id": b["id"], "v": [[1.0]] * len(b)}))
    assert {tuple(x.v) for x in ones.collect()} == {(1.0,)} and models.embed(docs.limit(0), "doc_id", "text").count() == 0


def test_summaries_by_a_model_and_without(spark):
    members = spark.createDataFrame([("c", n) for n in range(1, 41)] + [("d", 7), ("d", 7), ("e", 99)], "community_id string, node int")
    entities = spark.createDataFrame([(n, f"L{n}") for n in range(1, 41)] + [(99, None)], "node int, label string")
    held = models.described(members, entities)
    rows = {x.community_id: x for x in held.collect()}
    assert (rows["c"].n, len(rows["c"].labels), rows["c"].labels[:2]) == (40, 30, ["L1", "L2"]) and (rows["e"].n, rows["e"].labels) == (1, [])
    plain = {x.community_id: x.summary for x in models.summarise(held).collect()}
    assert plain == {"c": "Community of 40 concepts: L1, L2, L3, L4, L5.", "d": "Community of 1 concepts: L7.", "e": "Community of 1 concepts: ."}
    model = lambda b: b[["community_id"]].assign(summary=[" ".join(x) if n > 1 else "  " for x, n in zip(b["labels"], b["n"], strict=True)])
    said = {x.community_id: x.summary for x in models.summarise(held, model).collect()}
    assert said["c"].startswith("L1 L2") and said["d"] == plain["d"] and said["e"] == plain["e"]


def test_dense_search_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6)).round(1)  # equal scores occur
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id int, v array<double>")
    asked = items.where("item_id % 3 = 0").withColumnRenamed("item_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 3):
        order = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if i != q)[:5]
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(order)}
    monkeypatch.setattr(r, "MULTIPLIED", 16)
    for block in (7, 2048):
        got = r.dense_search(items, asked, 5, block_rows=block, exclude_self=True).collect()
        assert {(x.query_id, x.item_id, x["rank"]) for x in got} == want


def test_concurrency_over_buckets_equals_one_scan(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 3, 40, 500])) for s in (rng.randrange(2000) for _ in range(400))] + [("c", None, 5), ("d", 5, 5)]
    want = {}
    for k in {x[0] for x in rows}:
        moments = sorted([(s, 1) for g, s, e in rows if g == k and s is not None] + [(e, -1) for g, s, e in rows if g == k and s is not None])
        now = peak = 0
        for _, d in sorted(moments):
            now += d
            peak = max(peak, now)
        want[k] = peak
    df = spark.createDataFrame(rows, "k string, start long, end long")
    for bucket in (1, 10, 333, 10**9):
        assert {x.k: x.peak for x in m.concurrency(df, "k", bucket).collect()} == want


def test_reuse_over_buckets_equals_one_scan(spark):
    import datetime as dt

    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=s)) for k in ("a", "b", None) for s in (rng.randrange(4000) for _ in range(250))] + [("a", base)] * 50 + [("none", None), ("late", base + dt.timedelta(days=400)), ("late", base)]
    want = {}
    for key in {k for k, _ in rows}:
        since, misses, n = None, 0, 0
        for t in sorted((t - base).total_seconds() for k, t in rows if k == key and t):
            n += 1
            if since is None or t - since > 60:
                since, misses = t, misses + 1
        want[key] = (n - misses, misses)
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    for buckets in (1, 2, 24):
        assert {r.k: (r.hits, r.misses) for r in m.query_reuse(df, "k", 60, buckets).collect()} == want


def test_a_batch_is_multiplied_in_parts(monkeypatch):
    """Scores of a whole batch and of all queries are never held at once, and a batch keeps few candidates of a query."""
    sizes, plain = [], r._block_scores
    monkeypatch.setattr(r, "MULTIPLIED", 16)
    monkeypatch.setattr(r, "_block_scores", lambda items, *rest: sizes.append(len(items[0])) or plain(items, *rest))
    draw = np.random.default_rng(5)
    x = draw.normal(size=(500, 4))
    items = pd.DataFrame({"item_id": np.arange(500), "v": list(x)})
    (got,) = r._parts_scores(items, r._by_length(np.arange(3), x[:3]), 2, True)
    assert max(sizes) == 16 and sum(sizes) == 500 and (got.groupby("query_id").size() == 12).all()
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[:3] / np.linalg.norm(x[:3], axis=1, keepdims=True)).T
    for q in range(3):
        cos[q, q] = -2
        assert set(got[got.query_id == q].item_id) == set(np.argsort(-cos[:, q])[:12].tolist())
    assert r._parts_scores(items[:0], {}, 2, True) == []
