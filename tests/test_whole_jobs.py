"""Queries whose job was cut: what the cuts left out is found."""

import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillgraph.operators import graph as g
from quillgraph.operators import retrieval as r
from quillgraph.plans import graph_queries as gq
from quillgraph.plans import retrieval_queries as rq


def test_parts_of_several_brands_are_linked(spark, tmp_path):
    """Parts 1 and 8 share type and size, but not the brand; 2 and 9 share the type alone."""
    rows = [(1, "T", 5, "x"), (8, "T", 5, "y"), (2, "T", 6, "x"), (9, "T", 7, "x")]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = gq.QUERIES["path_exists_sparse"](spark, str(tmp_path))
    assert {x.a for x in got.where("connected").collect()} == {1}


def test_a_hub_brings_all_its_neighbours(spark):
    """A chunk of 400 entities: the start's neighbours are all of them, and each second one leads to another."""
    edges = [(n, 0) for n in range(400)] + [(n, n + 1) for n in range(0, 400, 2)] + [(1000 + n, n + 1) for n in range(0, 400, 2)]
    frame, starts = spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame([(7,), (7,), (5000,)], "entity long")
    got = {hops: sorted(map(tuple, g.subgraph(frame, starts, hops).collect())) for hops in (0, 1, 2, 3)}
    assert got[0] == got[1] == [(7, n) for n in range(400)] + [(5000, 5000)]
    assert got[2] == got[3] == [(7, n) for n in range(400)] + [(7, 1000 + n) for n in range(0, 400, 2)] + [(5000, 5000)]


def test_subgraph_against_plain_loops(spark):
    draw = random.Random(10)
    edges = sorted({(draw.randrange(30), draw.randrange(25)) for _ in range(60)})
    near = lambda nodes: nodes | {y for x, c in edges if x in nodes for y, d in edges if c == d}
    frame, starts = spark.createDataFrame(edges, "entity long, chunk long"), spark.createDataFrame([(n,) for n in range(32)], "entity long")
    assert {tuple(r) for r in g.subgraph(frame, starts, 2).collect()} == {(s, e) for s in range(32) for e in near(near({s}))}


def test_small_communities_count_too(spark, tmp_path):
    """The 501st community by size is the only one that shares a word with the query: both queries over the lanes find it."""
    spark.createDataFrame([(n, f"filler{n} filler") for n in range(500)] + [(500, "find me")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(0, "compare across sources where to find it", "en", "s"), (1, "something else", "en", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("retrieval_paths", "routed_lanes"):
        got = rq.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(rq.SQL[name]).fetchall())
    assert rq.QUERIES["retrieval_paths"](spark, str(tmp_path)).first().lanes == "community|graph|vector"


def test_shared_words_against_plain_loops(spark, monkeypatch):
    """In blocks and parts of any size, ties too; ids of text."""
    monkeypatch.setattr(r, "MULTIPLIED_ITEMS", 5)
    monkeypatch.setattr(r, "COLUMNS", 3)
    draw = random.Random(8)
    text = lambda: " ".join(draw.choice("abcdefghijklm") for _ in range(draw.randrange(9)))
    communities, queries = [(f"c{n}", draw.randrange(5), text()) for n in range(80)], [(n, text()) for n in range(40)]
    frames = spark.createDataFrame(communities, "community_id string, size int, summary string"), spark.createDataFrame(queries, "query_id long, text string")
    want = set()
    for q, a in queries:
        a = set(a.split())
        found = sorted((-round(len(a & set(b.split())) / len(a | set(b.split())), 9), c) for c, _, b in communities if a & set(b.split()))
        want |= {(q, c, -s, n + 1) for n, (s, c) in enumerate(found[:4])}
    assert {tuple(x) for x in r.community_rank(*frames, 4, None).collect()} == want
    some = r._jaccard_search(frames[0].drop("size"), frames[1], 4, block_rows=7, words_at_once=60)
    assert {tuple(x) for x in some.select("query_id", "community_id", F.col("score"), "rank").collect()} == want


def test_equal_vectors_are_not_all_held():
    """A task sees 20 000 equal vectors and holds few of them; the smallest ids count."""
    draw = np.random.default_rng(6)
    asked = draw.normal(size=(50, 8))
    nearest, most = r._Nearest(r._by_length(np.arange(50), list(asked)), 5, False), 0
    for begin in range(0, 20_000, 1000):
        nearest.add(pd.DataFrame({"item_id": np.arange(begin, begin + 1000)[::-1], "v": [asked[0]] * 1000}))
        most = max(most, sum(len(x[0]) for x in nearest.held[8]))
    assert most <= 2_000_000
    got = pd.concat(nearest.found())
    assert got.groupby("query_id").item_id.apply(sorted).tolist() == [[0, 1, 2, 3, 4]] * 50


def test_far_items_are_not_held():
    """Of later items a task holds only those that reach a query's best so far."""
    asked = np.eye(4)
    nearest = r._Nearest(r._by_length(np.arange(4), list(asked)), 300, False)
    draw = np.random.default_rng(7)
    x = draw.normal(size=(40_000, 4))
    nearest.add(pd.DataFrame({"item_id": np.arange(len(x)), "v": list(x)}))
    cosine = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 9)
    got = pd.concat(nearest.found())
    for q in range(4):
        assert set(got[got.query_id == q].item_id) == set(np.lexsort((np.arange(len(x)), -cosine[:, q]))[:300].tolist())


def test_retrieval_by_ids_equals_retrieval_with_texts(spark, monkeypatch):
    """The lanes hold no texts, and none leaves the fusion, where before each lane carried them; ids of chunks and communities may be the same."""
    draw = random.Random(1)
    text = lambda: "  ".join(draw.choice(["compare", "sources", "across", "dose", "drug", "\n", "aspirin", "interaction"]) for _ in range(draw.randrange(1, 12)))
    queries = spark.createDataFrame([(n, text(), n % 2 == 0) for n in range(12)], "query_id long, text string, linked boolean")
    chunks = spark.createDataFrame([(n, None if n == 3 else text(), text() if n % 3 == 0 else "") for n in range(40)], "chunk_id long, text string, parent_text string")
    communities = spark.createDataFrame([(n, text()) for n in range(6)], "community_id long, summary string")
    some = lambda ids, n: [(q, i, round(draw.random(), 1)) for q in range(12) for i in draw.sample(range(ids), n)]
    graph, vector = (spark.createDataFrame(some(40, n), "query_id long, chunk_id long, score double") for n in (10, 20))
    found = spark.createDataFrame(some(6, 4), "query_id long, community_id long, score double")
    want = r.retrieve_routed(queries, graph.join(chunks, "chunk_id"), vector.join(chunks, "chunk_id"), found.join(communities, "community_id"))
    seen, drop = [], r.near_duplicate_drop
    monkeypatch.setattr(r, "near_duplicate_drop", lambda ranked: seen.append(ranked.columns) or drop(ranked))
    got = r.retrieve_ids(queries, graph, vector, found, chunks, communities)
    assert "text" not in got.columns and "text" not in seen[0] and sorted(got.columns) == sorted(set(want.columns) - {"text"})
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(map(tuple, want.select(sorted(got.columns)).collect()))


def test_products_have_few_columns(monkeypatch):
    """Matrices are never wider than ``COLUMNS``, however many words are shared; products are exact."""
    monkeypatch.setattr(r, "COLUMNS", 16)
    draw, wide, plain = np.random.default_rng(3), [], np.bincount
    dense = draw.integers(0, 3, (20, 200)) * draw.integers(0, 2, (20, 200))
    off, col = np.r_[0, np.cumsum((dense > 0).sum(1))], np.nonzero(dense)[1]
    w = dense[dense > 0].astype(float)
    monkeypatch.setattr(np, "bincount", lambda x, w, n: wide.append(n) or plain(x, w, n))
    got = r._products(off, np.arange(5), col, off, np.arange(5, 20), col, np.arange(201), w, w)
    assert (got == dense[:5] @ dense[5:].T).all() and max(wide) <= 16 * 15 and len(wide) == 26
