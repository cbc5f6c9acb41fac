"""PageRank against plain loops, and the rows that its rounds store."""

import random

import pytest

from quillgraph.operators import graph as g


def plain(edges, seeds, rounds, damping=0.85):
    """Scores of all queries by walking step by step."""
    links = {}
    for e, c in edges:
        links.setdefault(("e", e), []).append(("c", c))
        links.setdefault(("c", c), []).append(("e", e))
    out = {}
    for q in {q for q, _ in seeds}:
        walk = {("e", e): 1 - damping for x, e in seeds if x == q and ("e", e) in links}
        for step in range(rounds + 1):
            for n, w in walk.items():
                out[q, n] = out.get((q, n), 0) + w
            new = {}
            for n, w in walk.items() if step < rounds else ():
                for m in links[n]:
                    new[m] = new.get(m, 0) + damping * w / len(links[n])
            walk = new
    return {(q, f"{n[0]}{n[1]}"): w for (q, n), w in out.items()}


def graph(seed):
    draw = random.Random(seed)
    edges = {(draw.randrange(60), draw.randrange(50)) for _ in range(130)} | {(e, 99) for e in range(0, 60, 2)}  # one chunk is a hub
    seeds = [(q, draw.randrange(66)) for q in range(40) for _ in range(2)]
    return sorted(edges), seeds


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_against_plain_loops(spark, rounds):
    edges, seeds = graph(rounds)
    got = g.personalised_pagerank(spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame(seeds, "query_id long, entity long"), rounds=rounds)
    got, want = {(r.query_id, r.node): r.score for r in got.collect()}, plain(edges, seeds, rounds)
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


@pytest.mark.parametrize("k", [3, 70])
def test_best_chunks_are_the_first_of_all(spark, k):
    edges, seeds = graph(k)
    e, s = spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame(seeds, "query_id long, entity long")
    want = sorted(map(tuple, g.top_chunks(g.personalised_pagerank(e, s), k).collect()))
    assert sorted(map(tuple, g.best_chunks(e, s, k).collect())) == want and len(want) >= 38 * min(k, 2)


def test_queries_share_rows(spark, monkeypatch):
    """A round stores a row for a node and sixteen queries, not one for each."""
    stored, store = [], g.store
    monkeypatch.setattr(g, "store", lambda df, name: stored.append((name, store(df, name))) or stored[-1][1])
    edges, seeds = graph(4)
    g.best_chunks(spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame(seeds, "query_id long, entity long"), 3)
    walks = [df for name, df in stored if name == "ppr-walk"]
    assert len(walks) == 10 and max(df.count() for df in walks) <= 60 * 3
