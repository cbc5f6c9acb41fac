import numpy as np
import pytest

from quillgraph.llm.ann import Tree, cell_of, chi_square_cdf, nearest, stopping_ratio, top_splits

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 0) for i, v in rows], SCHEMA)


def exact(rows, q_id, q, k):
    best = {}
    for i, v in rows:
        if i is not None and i != q_id:
            d = 0.0
            for a, b in zip(np.float32(v).astype(float), np.float32(q).astype(float), strict=True):
                d += (a - b) ** 2
            best[i] = min(best.get(i, 9e9), float(np.sqrt(d)))
    return sorted((d, i) for i, d in best.items())[:k]


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 60, "query_rows": 7, "fit_rows": 300}])
def test_recall_and_exact_scores(spark, settings):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 24))
    rows = [(i, centres[i % 6] + 0.4 * rng.standard_normal(24)) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(150)]  # copies
    data = frame(spark, rows)
    got = {}
    for r in nearest(data, data.where("vec_id % 20 = 0"), 10, **settings).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for q_id, v in rows:
        if q_id % 20 == 0:
            want = exact(rows, q_id, v, 10)
            have = [(d, i) for _, d, i in sorted(got[q_id])]
            assert have == sorted(have) and len(have) == 10 and [r for r, *_ in sorted(got[q_id])] == list(range(1, 11))
            hits += len(set(have) & set(want))
            total += 10
    assert hits / total >= 0.97


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0, 0]), (2, None), (3, [nan, 1]), (4, [inf, 1]), (5, [None, 1]), (6, [1, 2, 3]), (7, []), (None, [1, 1]), (8, [0, 1]), (9, [0, 1]), (9, [1, 0]), (0, [1, 0])]
    got = nearest(frame(spark, rows), frame(spark, rows).where("vec_id in (0, 1, 2, 6)"), 10).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 9, 0.0), (0, 2, 8, 2**0.5)]
    empty = frame(spark, [])
    assert nearest(empty, empty).count() == 0
    assert nearest(frame(spark, rows[:1]), frame(spark, rows[:1])).count() == 0


def test_chi_square_and_trees():
    assert abs(chi_square_cdf(15.507, 8) - 0.95) < 1e-4 and abs(stopping_ratio(0.95, 8) - 15.507) < 1e-2
    rng = np.random.default_rng(2)
    points = np.r_[rng.standard_normal((1000, 4)), np.ones((300, 4))]
    cells = cell_of(points, top_splits(points[:500], 3))
    assert set(cells) == set(range(8))
    tree = Tree(points)
    assert sorted(tree.order) == list(range(1300))
    q = points[3]
    d = tree.leaf_distances(q)
    for a, b, x in zip(tree.starts, tree.ends, d, strict=True):
        assert x <= ((points[tree.order[a:b]] - q) ** 2).sum(1).min() + 1e-12
