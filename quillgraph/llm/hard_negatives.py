"""Hard negatives of anchors in a table of labelled vectors, by bounds from segments' means and deviations.

A vector is cut into segments; for each the mean and the standard deviation are stored. As an inner
product is that of the means plus that of what deviates from them, within a segment of length L it lies in
``L * (mean * mean' -+ deviation * deviation')``. Summed over segments, that bounds a pair's score without its
components. Bounds are refined hierarchically: first one segment, then two, four, and so on to ``SEGMENTS``; each level only sees the pairs
that the one before has left, and only what is left of the last is scored exactly.

Two searches use this. Positives: an anchor's best rows of its own label. Negatives: for each
positive, the best rows of other labels between ``low`` and ``high`` percent of its score. A pair goes once its bounds
lie outside of all its anchor's windows, or below the k-th best that the task has found in each of them.

Anchors are a stated query set: they meet all rows in blocks of at most ``ANCHOR_ROWS`` by ``SHARD_ROWS``, and a task holds
one of each. What a block and a shard give is the best k of each anchor and window, so what is shuffled
grows with the number of shards, not of pairs; no label is a key of the shuffle, so a label with most of the rows is no hot group.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part, nor do those
whose vector's length is not the most frequent one (the smaller, at a tie); of several rows with one id the first by label and
components counts; equal scores go to the smaller id; where there are fewer rows than asked, all of them; an anchor without
a positive, or a positive without a negative in its window, gives no row; scores beyond a long are drawn to its ends; an
empty table gives no rows; only the three named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Segments of the finest level.
SEGMENTS = 16
#: Anchors and candidates that meet in one task, at most about.
ANCHOR_ROWS, SHARD_ROWS = 8192, 65_536
#: Candidates of one shard where there are few: a task has some work then.
LEAST_SHARD_ROWS = 1024
#: Shards that small tables are dealt to.
FEW_SHARDS = 48
#: Anchors and candidates that are bounded at once.
STEP_ANCHORS, STEP_ROWS = 256, 2048
#: Whole numbers below this are exact in double precision.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """``id, label, q``: rows that take part, their components scaled and rounded down, one row for each id."""
    rows = vectors.select(F.col(id_col).alias("id"), label.cast("long").alias("label"), F.transform(vec_col, lambda x: x.cast("double") * scale).alias("v"))
    given = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = rows.where(given & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Spark's floor of a double is a long; what does not fit is whole already
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    first = F.min(F.struct("label", whole.alias("q"))).alias("x")
    return rows.groupBy("id").agg(first).select("id", "x.label", "x.q")


def cuts(dim: int, segments: int) -> np.ndarray:
    """Where segments begin, and the end; halves of a segment are segments of the next level."""
    return np.unique(np.arange(segments + 1) * dim // segments)


def summary(vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's mean and standard deviation."""
    length = np.diff(starts)
    mean = np.add.reduceat(vectors, starts[:-1], axis=1) / length
    square = np.add.reduceat((vectors - np.repeat(mean, length, axis=1)) ** 2, starts[:-1], axis=1) / length
    return mean, np.sqrt(square)


def coarser(mean: np.ndarray, dev: np.ndarray, fine: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of segments from those of their parts."""
    length, at = np.diff(fine), np.searchsorted(fine, starts)
    whole = np.diff(starts)
    merged = np.add.reduceat(mean * length, at[:-1], axis=1) / whole
    off = mean - np.repeat(merged, np.diff(at), axis=1)
    return merged, np.sqrt(np.add.reduceat((dev**2 + off**2) * length, at[:-1], axis=1) / whole)


def stored(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``id, label, q, mean, dev`` of the vectors of the most frequent length, stored, and that length (0: no rows)."""
    kept = store(vectors, "hard-vectors")
    length = kept.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = length["d"] if length else 0
    rows = kept.where(F.size("q") == dim)
    starts = cuts(dim, SEGMENTS)

    def run(batches):
        for batch in batches:
            if dim:
                batch["mean"], batch["dev"] = (list(x) for x in summary(np.stack(batch["q"].to_numpy()), starts))
            else:
                batch["mean"] = batch["dev"] = batch["q"]
            yield batch

    return store(rows.mapInPandas(run, "id long, label long, q array<double>, mean array<double>, dev array<double>"), "hard-segments"), dim


class Side:
    """Rows of one side in a task: ids, labels, vectors and the summaries of every level, times the roots of the segments' lengths."""

    def __init__(self, rows: pd.DataFrame, dim: int):
        self.id, self.label = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.q = np.stack(rows["q"].to_numpy()) if dim else np.zeros((len(rows), 0))
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.levels, fine = [], cuts(dim, SEGMENTS)
        segments = 1
        while dim and segments <= SEGMENTS:
            starts = cuts(dim, segments)
            mean, dev = coarser(np.stack(rows["mean"].to_numpy()), np.stack(rows["dev"].to_numpy()), fine, starts)
            root = np.sqrt(np.diff(starts))
            self.levels.append((mean * root, dev * root))
            segments *= 2


def exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray, dense: bool, block: tuple[slice, slice]) -> np.ndarray:
    """Scores of pairs (i, j), which are places within ``block``."""
    x, y = a.q[block[0]], b.q[block[1]]
    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1]
    if most < EXACT:
        return (x @ y.T)[i, j] if dense else np.einsum("kd,kd->k", x[i], y[j])
    ends = (-(1 << 63), (1 << 63) - 1)
    return np.array([min(max(sum(int(p) * int(q) for p, q in zip(x[m], y[n], strict=True)), ends[0]), ends[1]) for m, n in zip(i.tolist(), j.tolist(), strict=True)], object)


def mine(a: Side, b: Side, bottom: np.ndarray, top: np.ndarray, same_label: bool, k: int) -> pd.DataFrame:
    """``row, window, id, score``: the best k of ``b`` for each window of each anchor, among its own label or the others.

    bottom, top: the least and greatest score of each window (anchors, windows); NaN where there is none.
    """
    n, windows = top.shape
    out = {name: np.zeros(0, np.int64) for name in ("slot", "id", "score")}
    least = np.full((n, windows), -np.inf)
    for r in range(0, n, STEP_ANCHORS):
        rows = slice(r, min(n, r + STEP_ANCHORS))
        found = {name: out[name][:0] for name in out}
        for c in range(0, len(b.id), STEP_ROWS):
            columns = slice(c, min(len(b.id), c + STEP_ROWS))
            match = (a.label[rows, None] == b.label[None, columns]) == same_label
            i, j = np.nonzero(match & (a.id[rows, None] != b.id[None, columns]))
            slack = 1e-7 * a.norm[rows].max(initial=0) * b.norm[columns].max(initial=0) + 1e-6
            floor = np.maximum(bottom[rows], least[rows])

            def useful(low_, up, i, rows=rows, floor=floor):
                keep = np.zeros(len(i), bool)
                for w in range(windows):
                    keep |= ((up >= floor[i, w]) & (low_ <= top[rows][i, w])).astype(bool)
                return keep

            for (am, ad), (bm, bd) in zip(a.levels, b.levels, strict=True):
                if not len(i):
                    break
                am, ad, bm, bd = am[rows], ad[rows], bm[columns], bd[columns]
                if len(i) * 4 > match.size:
                    middle, reach = (am @ bm.T)[i, j], (ad @ bd.T)[i, j]
                else:
                    middle, reach = np.einsum("kd,kd->k", am[i], bm[j]), np.einsum("kd,kd->k", ad[i], bd[j])
                keep = useful(middle - reach - slack, middle + reach + slack, i)
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            score = exact(a, b, i, j, len(i) * 4 > match.size, (rows, columns))
            parts = [found]
            for w in range(windows):
                inside = (score >= floor[i, w]) & (score <= top[rows][i, w])
                inside = inside.astype(bool)
                parts.append({"slot": i[inside] * windows + w, "id": b.id[columns][j[inside]], "score": score[inside].astype(np.int64)})
            found = {name: np.concatenate([p[name] for p in parts]) for name in out}
            order = np.lexsort((found["id"], ~found["score"], found["slot"]))  # ~x falls as x rises, without overflow
            found = {name: found[name][order] for name in out}
            slot = found["slot"]
            place = np.arange(len(slot)) - np.searchsorted(slot, slot)
            found = {name: found[name][place < k] for name in out}
            full = np.flatnonzero(place[place < k] == k - 1)
            least[rows].reshape(-1)[found["slot"][full]] = found["score"][full]
        found["slot"] = found["slot"] + r * windows
        out = {name: np.concatenate([out[name], found[name]]) for name in out}
    return pd.DataFrame({"row": out["slot"] // windows, "window": out["slot"] % windows, "id": out["id"], "score": out["score"]})


def searched(anchors: DataFrame, rows: DataFrame, dim: int, low: int, high: int, same_label: bool, k: int) -> DataFrame:
    """``anchor_id, goal_, id, score``: the best k of every window of every anchor. anchors: as rows, and ``goals``, an array of scores; null: one window that takes all."""
    n, asked = rows.count(), anchors.count()
    size = max(1, min(SHARD_ROWS, (1 << 22) // max(dim, 1)))
    shards = max(-(-n // size), min(FEW_SHARDS, -(-n // LEAST_SHARD_ROWS)), 1)
    blocks = max(1, -(-asked // ANCHOR_ROWS))
    own = lambda count: F.pmod(F.xxhash64("id", F.lit(11)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = anchors.withColumn("block", own(blocks)).withColumn("shard", every(shards))
    right = rows.withColumn("shard", own(shards)).withColumn("block", every(blocks)).toDF("id", "label", "q", "mean", "dev", "shard", "block")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor_id": [], "goal": [], "id": [], "score": []}).astype("int64")
        if not len(a) or not len(b):
            return none
        by = ["label", "id"]
        a, b = a.sort_values(by, ignore_index=True), b.sort_values(by, ignore_index=True)
        goals = [[None] if g is None else [int(x) for x in g] for g in a["goals"]]
        width = max(map(len, goals))
        large = any(abs(g) >= EXACT for windows in goals for g in windows if g is not None)
        ends = {side: np.full((len(a), width), np.nan, object if large else np.float64) for side in ("low", "high")}
        for i, windows in enumerate(goals):
            for w, g in enumerate(windows):
                ends["low"][i, w], ends["high"][i, w] = (-np.inf, np.inf) if g is None else (-(-low * g // 100), high * g // 100)
        got = mine(Side(a, dim), Side(b, dim), ends["low"], ends["high"], same_label, k)
        goal = [goals[i][w] or 0 for i, w in zip(got["row"], got["window"], strict=True)]
        return pd.DataFrame({"anchor_id": a["id"].to_numpy()[got["row"]], "goal": np.array(goal, np.int64), "id": got["id"], "score": got["score"]})

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(run, "anchor_id long, goal long, id long, score long")


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. is_anchor: a condition on ``id``."""
    rows, dim = stored(usable(vectors, id_col, vec_col, label, scale))
    anchors = rows.where(is_anchor)
    all_ = F.lit(None).cast("array<long>")
    near = searched(anchors.withColumn("goals", all_), rows, dim, low, high, True, positives)
    near = store(_best(near, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hard-positives")
    goals = near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("goals"))  # as many as positives, at most
    asked = anchors.join(goals, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    hard = _best(searched(asked, rows, dim, low, high, False, negatives), ["anchor_id", "goal"], negatives)
    hard = hard.select("anchor_id", F.col("goal").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: ``label`` of the rows that have a wrong one on purpose, and the anchors.
NOISY = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"

SQL = f"""
WITH v AS (
  SELECT vec_id AS id, {NOISY} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
