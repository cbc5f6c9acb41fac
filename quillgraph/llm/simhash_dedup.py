"""SimHash near-duplicates, linked through BK-trees.

Fingerprints: the words of a text (A-Z lower-cased, split at ASCII white space) give
shingles; each is hashed with XXH64 (seed 42), and a bit of the fingerprint is 1 if it is
set in over half of the hashes. Two fingerprints that differ in at most ``radius`` bits
are linked; a component is what links reach.

Only distinct fingerprints are linked. Each is dealt to one shard for each choice of
blocks that it may share with a neighbour: with four blocks of 16 bits, two fingerprints
within two bits agree in two blocks at least, so six shards by 32 bits find every link. A
shard of more than ``shard_rows`` fingerprints is dealt again by a third of its other bits
(one third at least is equal), and once more by a third of what is left; then 14 bits are
free, so no shard can hold more than 16,384 fingerprints. In each shard a BK-tree, whose
children are keyed by their Hamming distance to the parent, is built and searched
along the edges within the radius. A shard tree travels to its searches by Spark's
shuffle, not as a driver broadcast, as that would bring all fingerprints to the driver.
A shard returns a spanning forest of its links, never all pairs.

Defined results: null or empty text has no words, and so fingerprint zero, linked
like any other; very long texts are taken whole; repeated rows give repeated rows; a row
with a null id belongs to its text's component, whose id is the smallest id that is not
null; an empty table gives no rows; only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, store
from .components import connected_components

SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - width + 1)


def fingerprint(text: str, width: int) -> int:
    """Unsigned 64-bit SimHash."""
    return hashes_fingerprint(shingle_hashes(text, width))


def hashes_fingerprint(hashes: np.ndarray) -> int:
    """Hashes are counted in blocks, so that memory stays small for any number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` (the 64 bits as a signed long) of every row; no shuffle."""
    rows = docs.select(F.col(id_col), blank(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], [id_col, "fp"])

    return rows.mapInArrow(run, rows.select(id_col, F.lit(0).cast("long").alias("fp")).schema)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, point: int) -> None:
        if self.points:
            at = 0
            while (d := (self.points[at] ^ point).bit_count()) in self.children[at]:
                at = self.children[at][d]
            self.children[at][d] = len(self.points)
        self.points.append(point)
        self.children.append({})

    def within(self, point: int, radius: int) -> list[int]:
        """Places of the points at most ``radius`` away."""
        found, todo = [], [0] if self.points else []
        while todo:
            at = todo.pop()
            d = (self.points[at] ^ point).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                todo += [to for key, to in edges.items() if d - radius <= key <= d + radius]
            else:
                todo += [edges[key] for key in range(d - radius, d + radius + 1) if key in edges]
        return found


def shard_forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one shard's distinct fingerprints: each is searched in the tree of those before it."""
    tree, root = BKTree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, point in enumerate(points.tolist()):
        root.append(i)
        for j in tree.within(point, radius):
            if (a := top(i)) != (b := top(j)):
                root[a] = b
                links.append((point, tree.points[j]))
        tree.add(point)
    return links


def _pick(fp: Column, bits: tuple[int, ...]) -> Column:
    """The named bits of a fingerprint, the others zero."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _levels(radius: int) -> list[tuple[list[tuple[int, ...]], ...]]:
    """For each first choice of bits, its second and third choices."""
    parts = lambda bits, n: [tuple(bits[i * len(bits) // n : (i + 1) * len(bits) // n]) for i in range(n)]
    blocks = parts(range(64), radius + 2)
    out = []
    for pair in combinations(blocks, 2):
        first = tuple(sorted(pair[0] + pair[1]))
        rest = [b for b in range(64) if b not in first]
        second = parts(rest, radius + 1)
        third = [parts([b for b in rest if b not in s], radius + 1) for s in second]
        out.append((first, second, third))
    return out


def simhash_links(fps: DataFrame, radius: int = 2, shard_rows: int = 4096) -> DataFrame:
    """``a, b``: spanning links between the distinct fingerprints of column ``fp`` within ``radius`` bits."""
    levels = _levels(radius)
    fp = F.col("fp")

    def crowded(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Shards with a pair to compare, and those that are to be dealt again."""
        sizes = dealt.groupBy("way", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = dealt.join(sizes, ["way", "bits"])
        return sized.where(F.col("n") <= shard_rows).drop("n"), sized.where(F.col("n") > shard_rows).drop("n")

    def deal(rows: DataFrame, ways: list[tuple[str, str, tuple[int, ...]]]) -> DataFrame:
        """ways: (way so far, way, bits that are equal in it)."""
        made = [F.when(F.col("was") == was, F.struct(F.lit(way).alias("way"), _pick(fp, bits).alias("bits"))) for was, way, bits in ways]
        return rows.select("fp", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("fp", "x.way", "x.bits")

    first = [("", f"{i}", f) for i, (f, _, _) in enumerate(levels)]
    second = [(f"{i}", f"{i}.{j}", f + s) for i, (f, ss, _) in enumerate(levels) for j, s in enumerate(ss)]
    third = [(f"{i}.{j}", f"{i}.{j}.{k}", f + s + t) for i, (f, ss, ts) in enumerate(levels) for j, s in enumerate(ss) for k, t in enumerate(ts[j])]
    fine, hot = crowded(deal(fps.select("fp", F.lit("").alias("was")), first))
    hot = store(hot, "simhash-hot")
    if not hot.isEmpty():
        more, hotter = crowded(deal(hot.withColumnRenamed("way", "was"), second))
        last = deal(hotter.withColumnRenamed("way", "was"), third)
        fine = fine.unionByName(more).unionByName(last)

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        return pd.DataFrame(shard_forest(points, radius), columns=["a", "b"], dtype=np.uint64).astype(np.int64)

    return fine.groupBy("way", "bits").applyInPandas(link, "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 4096
) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits), ``component_id`` (smallest id of the component) of every row."""
    prints = store(fingerprints(docs, width, id_col, text_col), "simhash-fp")
    nodes = store(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-nodes")
    label = connected_components(store(simhash_links(nodes, radius, shard_rows), "simhash-links"))  # node, component
    joined = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
