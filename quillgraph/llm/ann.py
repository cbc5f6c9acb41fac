"""Approximate nearest neighbours by stable projections and a kd-tree.

A fixed Gaussian matrix projects vectors to a few dimensions; the squared projected distance over
the squared true distance then follows a chi-square distribution. A kd-tree over projections
is held in two levels: its top splits rows into cells (fitted on a bounded sample of
``fit_rows`` rows; every row is indexed), and each cell, dealt by hash into shards of about
``shard_rows`` rows, gets its own tree where it is searched. A query first searches its home cell. Then it visits only
the cells whose projected distance fails the stopping test: that a neighbour nearer than the
k-th found would lie this far off in projection with a chance of 1 - ``confidence`` at most.
The same test stops each search among a tree's leaves, and spares points
in them. What is left is verified by the true distance in double precision.

Queries travel in blocks of about ``query_rows`` to the shards that they visit; no task
holds more than a shard and a block. The driver gets the sample's projections and one row for each cell.

Defined results: vectors that are null, empty, zero or hold null or non-finite values, rows
with a null id, and vectors whose length is not the most frequent one (the smaller, at a tie) take no
part. Rows with the query's id are not its neighbours; of several rows with one id the
nearest counts; of several query rows with one id the smallest vector counts. Ties
go to the smaller id. Fewer candidates than k: all of them. An empty table gives no rows.
Only the two named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

LEAF_ROWS = 64
#: Parts of all hashes that a sample can be cut at.
HASHES = 1 << 40


def chi_square_cdf(x: float, m: int) -> float:
    """Of an even number of degrees of freedom."""
    if x <= 0:
        return 0.0
    term = total = 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def stopping_ratio(confidence: float, m: int) -> float:
    """Projected over true squared distance at which the test holds."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < confidence else (low, mid)
    return high


def projection(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(6).standard_normal((dim, m))


def top_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete kd-tree's splits in heap order: the widest dimension at its median."""
    groups, splits = [points], []
    for _ in range(depth):
        halves = []
        for g in groups:
            d = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
            cut = float(np.median(g[:, d])) if len(g) else 0.0
            splits.append((d, cut))
            halves += [g[g[:, d] < cut], g[g[:, d] >= cut]]
        groups = halves
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    dims, cuts = np.array([d for d, _ in splits], int), np.array([c for _, c in splits])
    for _ in range((len(splits) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= cuts[at])
    return at - len(splits)


class Tree:
    """A shard's kd-tree over projections; leaves hold up to LEAF_ROWS rows, in a row in ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        todo, leaves = [(0, len(points))], []
        while todo:
            a, b = todo.pop()
            rows = self.order[a:b]
            p = points[rows]
            spread = p.max(0) - p.min(0)
            if b - a <= LEAF_ROWS or not spread.any():
                leaves.append((a, b, p.min(0), p.max(0)))
                continue
            mid = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(p[:, spread.argmax()], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.starts, self.ends = (np.array([x[i] for x in leaves]) for i in (0, 1))
        self.low, self.high = (np.stack([x[i] for x in leaves]) for i in (2, 3))

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from q to each leaf's box."""
        return (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(1)


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, in doubles, summed in order: equal vectors give equal bits."""
    return np.sqrt(np.cumsum((rows - q) ** 2, axis=1)[:, -1]) if len(rows) else np.zeros(0)


def search(tree: Tree, points: np.ndarray, rows: np.ndarray, ids: np.ndarray, q_id: int, q: np.ndarray, q_point: np.ndarray, k: int, bound: float, ratio: float):
    """The k nearest ids and distances of q in one shard; bound: the k-th distance known from elsewhere."""
    near = tree.leaf_distances(q_point)
    todo = np.argsort(near, kind="stable")
    found_id, found_d = np.zeros(0, np.int64), np.zeros(0)
    at, step = 0, 2
    while at < len(todo) and near[todo[at]] <= ratio * bound * bound:
        take = np.concatenate([tree.order[tree.starts[i] : tree.ends[i]] for i in todo[at : at + step]])
        at, step = at + step, step * 2
        take = take[(((points[take] - q_point) ** 2).sum(1) <= ratio * bound * bound) & (ids[take] != q_id)]
        found_id = np.r_[found_id, ids[take]]
        found_d = np.r_[found_d, distances(rows[take], q)]
        keep = np.lexsort((found_id, found_d))
        found_id, found_d = found_id[keep], found_d[keep]
        # of rows with one id, the nearest
        first = np.sort(np.unique(found_id, return_index=True)[1])[:k]
        found_id, found_d = found_id[first], found_d[first]
        if len(found_d) == k:
            bound = min(bound, found_d[-1])
    return found_id, found_d


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    dims: int = 8,
    confidence: float = 0.995,
    fit_rows: int = 20_000,
    shard_rows: int = 8192,
    query_rows: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, <id_col>, score`` of each query's k nearest rows of ``vectors``."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
            F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
        )

    rows, asked = usable(vectors), usable(queries)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    out = "query_id long, rank int, id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    dim, total = lengths[0]
    matrix, ratio = projection(dim, dims), stopping_ratio(confidence, dims)
    rows = rows.where(F.size("v") == dim)
    asked = asked.where(F.size("v") == dim).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))

    # a hash cut made from the count: each task gives its share, about fit_rows in all; the limit counts where equal rows are many
    share = F.pmod(F.xxhash64("id", "v"), F.lit(HASHES)) < math.ceil(HASHES * min(1.0, fit_rows / total))
    sample = rows.where(share).limit(2 * fit_rows).select("v").toPandas()
    depth = min(max(0, math.ceil(math.log2(max(1, total / shard_rows)))), int(math.log2(max(1, len(sample) // 16))) if len(sample) >= 16 else 0)
    splits = top_splits(np.stack(sample["v"]) @ matrix, depth)

    @F.pandas_udf("cell int, point array<double>")
    def placed(v: pd.Series) -> pd.DataFrame:
        points = np.stack(v) @ matrix if len(v) else np.zeros((0, dims))
        return pd.DataFrame({"cell": cell_of(points, splits).astype(np.int32), "point": list(points)})

    indexed = store(rows.withColumn("p", placed("v")).select("id", "v", "p.cell", "p.point"), "ann-index")
    asked = store(asked.withColumn("p", placed("v")).select("query_id", "v", "p.cell", "p.point"), "ann-queries")

    box = [f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    cells = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *box).orderBy("cell").toPandas()
    shards = dict(zip(cells["cell"].tolist(), np.ceil(cells["n"].to_numpy() / shard_rows).astype(int).tolist(), strict=True))
    lows, highs = (cells[[f"{n}{i}" for i in range(dims)]].to_numpy() for n in ("low", "high"))
    numbers = cells["cell"].to_numpy()

    def visit(targets: DataFrame) -> DataFrame:
        """Top k of each query in each shard of the cell that it is sent to. targets: query_id, v, point, cell, bound."""
        load = {r.cell: r.n for r in targets.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        spark = targets.sparkSession
        plan = spark.createDataFrame([(c, shards[c], max(1, math.ceil(load.get(c, 0) / query_rows))) for c in shards], "cell int, shards int, blocks int")
        plan = F.broadcast(plan)  # a row for each cell; the sample's size bounds them
        held = indexed.join(plan, "cell").select(
            "id", "v", "point", "cell", F.pmod(F.xxhash64("id", "v"), "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        )
        sent = targets.join(plan, "cell").select(
            "query_id", "v", "point", "bound", "cell", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
        )

        def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            got = []
            if len(left) and len(right):
                points, vectors_, ids = np.stack(left["point"]), np.stack(left["v"]), left["id"].to_numpy()
                tree = Tree(points)
                for q_id, v, point, bound in zip(right["query_id"], right["v"], right["point"], right["bound"], strict=True):
                    i, d = search(tree, points, vectors_, ids, q_id, v, point, k, bound, ratio)
                    got.append(pd.DataFrame({"query_id": q_id, "id": i, "score": d}))
            return pd.concat(got) if got else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})

        keys = ["cell", "shard", "block"]
        return held.groupBy(keys).cogroup(sent.groupBy(keys)).applyInPandas(find, "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
        return ranked.where(F.col("rank") <= k)

    home = store(best(visit(asked.where(F.col("cell").isin(*shards)).withColumn("bound", F.lit(float("inf"))))), "ann-home")
    bounds = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(float("inf")).alias("bound"))

    @F.pandas_udf("array<int>")
    def others(point: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        """The cells for which the stopping test does not hold."""
        out_ = []
        for p, c, b in zip(point, cell, bound, strict=True):
            gap = (np.maximum(np.maximum(lows - p, p - highs), 0) ** 2).sum(1)
            out_.append(numbers[(gap <= ratio * b * b) & (numbers != c)].astype(np.int32))
        return pd.Series(out_)

    left = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    onward = store(left.select("query_id", "v", "point", "bound", F.explode(others("point", "cell", "bound")).alias("cell")), "ann-onward")
    found = best(home.select("query_id", "id", "score").unionByName(visit(onward)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
