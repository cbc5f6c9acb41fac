"""Second neighbours against plain loops, at limits that cut, and what they store."""

import random
from collections import Counter

from quillgraph.operators import graph as g


def test_against_plain_loops(spark, monkeypatch):
    stored, store = [], g.store
    monkeypatch.setattr(g, "store", lambda df, name: stored.append(store(df, name)) or stored[-1])
    draw = random.Random(2)
    edges = sorted({(draw.randrange(25), draw.randrange(30)) for _ in range(110)})
    shared = Counter((x, y) for x, c in edges for y, d in edges if c == d and x != y)
    frame = spark.createDataFrame(edges, "entity long, chunk long")
    starts = spark.createDataFrame([(n,) for n in (*range(0, 26, 2), 0)], "entity long")
    for limit in (1, 7, 1000):
        want = set()
        for s in range(0, 26, 2):
            found = [(-w, m, e) for (m, e), w in shared.items() if (s, m) in shared and e != s]
            want |= {(s, m, e, -w) for w, m, e in sorted(found)[:limit]}
        assert {tuple(r) for r in g.second_neighbours(frame, starts, limit).collect()} == want
    assert stored and all(set(df.columns) == {"start", "mid"} for df in stored)
