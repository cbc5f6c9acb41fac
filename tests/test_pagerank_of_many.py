"""Best chunks of many queries: graphs that tasks hold, larger ones by lots, and what is stored."""

import random

import pytest

from quillgraph.operators import graph as g


def graph(seed):
    """Two components and a hub; some seeds are unknown, one is null."""
    draw = random.Random(seed)
    edges = {(draw.randrange(60), draw.randrange(50)) for _ in range(130)} | {(e, 99) for e in range(0, 60, 2)} | {(100 + draw.randrange(9), 200 + draw.randrange(9)) for _ in range(20)}
    seeds = [(q, draw.choice([draw.randrange(66), 100 + draw.randrange(9)])) for q in range(40) for _ in range(2)] + [(3, None), (77, 5000)]
    return sorted(edges), seeds


@pytest.mark.parametrize("k", [3, 70])
def test_both_ways_equal_best_chunks_and_store_little(spark, monkeypatch, k):
    edges, seeds = graph(k)
    e, s = spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame(seeds, "query_id long, entity long")
    want = sorted(map(tuple, g.best_chunks(e, s, k).collect()))
    stored, store = [], g.store
    monkeypatch.setattr(g, "store", lambda df, name: stored.append(name) or store(df, name))
    close = lambda rows: [(q, c, round(x, 7), n) for q, c, x, n in rows]
    assert close(sorted(map(tuple, g.best_chunks_of_many(e, s, k).collect()))) == close(want)
    assert "ppr-walk" not in stored
    monkeypatch.setattr(g, "HELD_EDGES", 10)
    monkeypatch.setattr(g, "ROUND_ROWS", 200)
    assert close(sorted(map(tuple, g.best_chunks_of_many(e, s, k, rounds=20).collect()))) == close(want)
    assert stored.count("ppr-best") > 0


def test_pairs_of_entities_are_not_stored(spark, monkeypatch):
    """A round goes through the chunks: what is stored beside the links are nodes of blocks."""
    stored, store = {}, g.store
    monkeypatch.setattr(g, "store", lambda df, name: stored.setdefault(name, df.columns) and store(df, name))
    edges, seeds = graph(1)
    g.best_chunks(spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame(seeds, "query_id long, entity long"), 3, rounds=4)
    assert "ppr-walk" in stored and not any({"entity", "to"} <= set(columns) for columns in stored.values())
