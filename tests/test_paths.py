"""Paths against a search by breadth, and what they store on a graph whose entities have one chunk each."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as g


def far(edges, a, most):
    seen = {a}
    for _ in range(most):
        chunks = {c for e, c in edges if e in seen}
        seen |= {e for e, c in edges if c in chunks}
    return seen


@pytest.mark.parametrize("hops", [0, 1, 2, 3, 4])
def test_against_breadth_first(spark, hops):
    draw = random.Random(hops)
    edges = sorted({(draw.randrange(40), draw.randrange(30)) for _ in range(55)})
    pairs = [(draw.randrange(42), draw.randrange(42)) for _ in range(120)] + [(41, 41), (None, 3)]
    got = g.paths(spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame(pairs, "a long, b long"), hops).collect()
    assert {(x.a, x.b): x.connected for x in got} == {(a, b): a is not None and b in far(edges, a, hops) for a, b in pairs}


def test_a_large_chunk_is_not_expanded(spark, monkeypatch):
    """Entities of one chunk are not listed for each other: 300 of them are 300 rows, not 90 000."""
    stored, store = [], g.store
    monkeypatch.setattr(g, "store", lambda df, name: stored.append(store(df, name)) or stored[-1])
    edges = spark.range(300).select(F.col("id").alias("entity"), F.lit(1).alias("chunk"))
    pairs = spark.range(300).select(F.col("id").alias("a"), ((F.col("id") + 1) % 301).alias("b"))
    assert g.paths(edges, pairs).where("connected").count() == 299
    assert max(x.count() for x in stored) <= 300
