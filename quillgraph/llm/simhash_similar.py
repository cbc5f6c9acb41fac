"""SimHash near-duplicates at a stated similarity: shingles of five words, Jaccard of 0.8 or more.

Words, shingle hashes and fingerprints are those of ``simhash_dedup``. Equal sets of
shingles are one node with one fingerprint. Shards that hold every pair of similarity 0.8 cannot be made of equal
fingerprint bits: such pairs differ in about ten bits, up to twenty, which leaves three equal ones. So a shard is
a shingle: in any fixed order of shingles, two sets with similarity s share one of their first
n - ceil(s n) + 1. The order is by how frequent the shingle's bucket is in the corpus, rare ones first; the buckets'
number is fixed, and as they only order the shingles, no pair is missed by them.

Each shard has a BK-tree of its fingerprints; a node is linked to the nearest one within ``RADIUS``
bits (a fifth of 64) that is not in its component yet. Shards of more than ``SHARD_ROWS`` nodes
are dealt to trees by hash, differently in each round; after the first, only shards that still hold two components are searched. A link counts only after both whole
sets were intersected. So groups are joined by a number of links in proportion to their size. What a
radius can miss is found exactly at the end: pairs that share a leading shingle, are
still in two components, and leave room for 0.8 by their places in the order and by bitmaps of their shingles are compared the same way.

Defined results: null or empty text has the empty set, equal to itself only; texts of up to
five words are one shingle; very long texts are taken whole; an empty table gives no rows; repeated rows are one
node; only the named columns are read, and ``keep`` is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, blank, discard, store, vector_rows, vector_sum
from .components import connected_components
from .simhash_dedup import SEED, BKTree, hashes_fingerprint, shingle_hashes

WIDTH = 5
#: Buckets of shingles, counted to order them.
BUCKET_BITS = 18
#: Bits of the filter that keeps sets without a candidate out of shuffles.
FILTER_BITS = 25
#: Rounds of trees before what is left is found exactly.
ROUNDS = 3
#: Bits in which linked fingerprints may differ: four fifths are equal.
RADIUS = 12
#: Fingerprints of one tree.
SHARD_ROWS = 4096
#: Places of a set's bitmap.
BITMAP = 512
#: Sets that a task remembers, to give each one once.
REMEMBERED = 500_000


def _hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """Each text's set of shingle hashes, sorted, and the set's hash."""
    for t in texts:
        hashes = np.unique(shingle_hashes(t.as_py(), WIDTH))
        yield hashes, xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays).astype(np.uint64).view(np.int64))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """Of all shingles, repeats too: the counts only order them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS)
        for batch in batches:
            held, n = [], 0
            for t in batch.column(0):
                held.append(_bucket(shingle_hashes(t.as_py(), WIDTH)))
                n += len(held[-1])
                if n > 1_000_000:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, n = [], 0
            if n:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
        yield vector_rows(counts)

    return vector_sum(texts.mapInArrow(run, VECTOR_SCHEMA), 1 << BUCKET_BITS)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which of ``BITMAP`` places a set's hashes fall on, as longs: sets differ in as many hashes, at least, as their bitmaps in bits."""
    places = np.zeros(BITMAP, bool)
    places[(hashes & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(places).view(np.uint64)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(blank(F.col(text_col)).alias("text_"))


def shingle_sets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, ``sig`` (hash of the set), ``fp`` (its SimHash), ``n`` (its size), ``bits`` (its bitmap), ``keys`` (its leading shingles) and ``th`` (hash of the text) of every row; no shuffle.

    The sets themselves are not stored, as they are larger than the texts: what is compared is hashed again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bucket_counts(_texts(docs, text_col)))  # of fixed size
    text = blank(F.col(text_col))
    rows = docs.select(*keep, F.xxhash64(text).alias("th"), text.alias("text_"))
    zero = F.lit(0).cast("long")
    names = [*keep, "th", "sig", "fp", "n", "bits", "keys"]
    schema = rows.select(*keep, "th", zero.alias("sig"), zero.alias("fp"), F.lit(0).alias("n"), F.array(zero).alias("bits"), F.array(zero).alias("keys")).schema

    def leading_of(hashes: np.ndarray) -> np.ndarray:
        first = len(hashes) + 1 + (-4 * len(hashes)) // 5 if len(hashes) else 0  # n - ceil(0.8 n) + 1
        return hashes[np.lexsort((hashes, shared.value[_bucket(hashes)]))[:first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets, sigs = zip(*_hashed(part.column(len(keep) + 1)), strict=True)
                made = [_signed(list(sigs)), _signed([hashes_fingerprint(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), _lists([_bitmap(s) for s in sets]), _lists([leading_of(s) for s in sets])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    return rows.mapInArrow(run, schema)


def leading(sets: DataFrame) -> DataFrame:
    """``key, sig, fp, n, at, most``: the shingles of which two similar sets share one, their places in the common order, and how many sets lead with each."""
    every = sets.select("sig", "fp", "n", F.posexplode("keys").alias("at", "key")).repartition("key").dropDuplicates(["key", "sig"])
    same = Window.partitionBy("key")
    return every.withColumn("most", F.count(F.lit(1)).over(same).cast("int")).where("most > 1").select("key", "sig", "fp", "n", "at", "most")


def _nodes(sets: DataFrame) -> DataFrame:
    """``sig, th, bits``: each set once, with one of its texts' hashes. Stored."""
    return store(sets.select("sig", "th", "bits").dropDuplicates(["sig"]), "near-nodes")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a Jaccard similarity of 0.8 or more, stored. Only texts that are in a pair are hashed, and only their sets leave the texts' tasks."""
    pairs = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(nodes.select("sig", "th"), "sig")
    slot = F.col("th").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.select(F.shiftright(slot, 5).cast("int").alias("word"), F.expr("shiftleft(1L, int(th & 31))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(1 << (FILTER_BITS - 5), np.int64)  # of fixed size
    mask[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sigs, sets, held = set(), [], [], 0
        for batch in batches:
            th = batch.column(0).to_numpy()
            place = th & ((1 << FILTER_BITS) - 1)
            for i in np.flatnonzero(shared.value[place >> 5] >> (place & 31) & 1).tolist():
                if th[i] in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(th[i])
                ((hashes, sig),) = _hashed(batch.column(1)[i : i + 1])
                sigs.append(sig)
                sets.append(hashes)
                held += len(hashes)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([_signed(sigs), _lists(sets)], ["sig", "shingles"])
                    sigs, sets, held = [], [], 0
        if sigs:
            yield pa.RecordBatch.from_arrays([_signed(sigs), _lists(sets)], ["sig", "shingles"])

    text = blank(F.col(text_col))
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text_"))
    wanted = store(texts.mapInArrow(run, "sig long, shingles array<long>").dropDuplicates(["sig"]), "near-sets")
    left, right = wanted.toDF("a", "sa"), wanted.toDF("b", "sb")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = store(both.where("9L * common >= 4L * (size(sa) + size(sb))").select("a", "b"), "near-links")
    discard(pairs, wanted)
    return links


def _tree_links(fp: list[int], n: list[int], at: list[int], c: list[int]) -> list[tuple[int, int]]:
    """Places of linked nodes in one shard: each is searched in the BK-tree of those before it, and linked to the nearest that may be as similar."""
    tree, links = BKTree(), []
    for i, point in enumerate(fp):
        near, best = RADIUS + 1, -1
        for j in tree.within(point, RADIUS):
            d = (fp[j] ^ point).bit_count()
            if d < near and c[j] != c[i] and 9 * min(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j]):
                near, best = d, j
        if best >= 0:
            links.append((i, best))
        tree.add(point)
    return links


def _by_group(rows: DataFrame, groups: list[str], pairs_of) -> DataFrame:
    """``a, b``: what ``pairs_of`` (columns of a group, as lists, sig first -> places of pairs) gives for each group with two components. rows: groups, sig, c, more."""
    width = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        last, held = None, None  # the group that the last batch ended in: it may go on in the next

        def link(columns: list[list]) -> None:
            sig, c = columns[:2]
            if len(sig) > 1 and c.count(c[0]) < len(c):
                for i, j in pairs_of(*columns):
                    left.append(sig[i])
                    right.append(sig[j])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([x.to_numpy().astype(np.int64) for x in batch.columns[:width]])
            columns = [x.to_pylist() for x in batch.columns[width:]]
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            if held and last != keys[:, 0].tolist():
                link(held)
                held = None
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                link([h + x[a:b] for h, x in zip(held, columns, strict=True)] if held else [x[a:b] for x in columns])
                held = None
            rest = [x[cuts[-2] :] for x in columns]
            held = [h + x for h, x in zip(held, rest, strict=True)] if held else rest
            last = keys[:, -1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
            left.clear()
            right.clear()
        if held:
            link(held)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.repartition(*groups).sortWithinPartitions(*groups, "sig").mapInArrow(run, "a long, b long")


def tree_links(named: DataFrame, round_: int) -> DataFrame:
    """``a, b``: proposed links of all shards. named: key, sig, fp, n, at, most, c."""
    shard = F.pmod(F.xxhash64("sig", F.lit(round_)), F.ceil(F.col("most") / SHARD_ROWS)).alias("shard")
    pairs = lambda sig, c, fp, n, at: _tree_links([x % (1 << 64) for x in fp], n, at, c)
    return _by_group(named.select("key", shard, "sig", "c", "fp", "n", "at"), ["key", "shard"], pairs)


def _room_pairs(sig: list[int], c: list[int], n: list[int], at: list[int], block: list[int], bits: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Pairs of one shard that are in two components (and blocks, if there are two) and may have a similarity of 0.8, by their places in the order and by their bitmaps."""
    m, split = len(sig), block.count(block[0]) < len(block)
    if m < 5:
        for i in range(m):
            for j in range(i):
                far = c[i] != c[j] and not (split and block[i] == block[j]) and 9 * min(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j])
                if far and 9 * sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(bits[i], bits[j], strict=True)) <= n[i] + n[j]:
                    yield i, j
        return
    c, n, at, block, bits = np.array(c), np.array(n), np.array(at), np.array(block), np.array(bits, np.int64)
    step = max(1, 1_000_000 // m)
    for a in range(0, m, step):
        rows = slice(a, a + step)
        both = n[rows, None] + n[None, :]
        fits = (c[rows, None] != c[None, :]) & (9 * np.minimum((n - at)[rows, None], (n - at)[None, :]) >= 4 * both)
        if split:
            fits &= block[rows, None] != block[None, :]
        i, j = np.nonzero(fits)
        i += a
        i, j = i[j < i], j[j < i]
        if len(i):
            differ = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it would count the absolute value's bits
            good = 9 * differ <= n[i] + n[j]
            yield from zip(i[good].tolist(), j[good].tolist(), strict=True)


def exact_pairs(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: all pairs of two components that share a leading shingle and may have a similarity of 0.8. Shards of more than ``SHARD_ROWS`` nodes meet block by block."""
    blocks = F.ceil(F.col("most") / SHARD_ROWS).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    dealt = named.join(nodes.select("sig", "bits"), "sig").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "sig", "c", "n", "at", "own", "bits")
    return _by_group(rows, ["key", "x", "y"], _room_pairs)


def _mixed(keys: DataFrame, links: DataFrame) -> DataFrame:
    """``keys`` with each set's component ``c``, of those shards that still hold two components. Stored: most shards are one component after the first round."""
    known = store(connected_components(links), "near-components").toDF("sig", "c")
    named = keys.join(known, "sig", "left").withColumn("c", F.coalesce("c", "sig"))
    same = Window.partitionBy("key")
    ends = named.withColumns({"low_": F.min("c").over(same), "high_": F.max("c").over(same)})
    return store(ends.where("low_ <> high_").drop("low_", "high_"), "near-mixed")


def similar_components(sets: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``sig, component`` of those ``sets`` (see ``shingle_sets``) of ``docs`` that are linked to another one."""
    keys, nodes = store(leading(sets), "near-keys"), _nodes(sets)
    links = _verified(tree_links(keys.withColumn("c", F.col("sig")), 0), docs, nodes, text_col)
    mixed = _mixed(keys, links)
    discard(keys)
    for round_ in range(1, ROUNDS):
        links = links.unionByName(_verified(tree_links(mixed, round_), docs, nodes, text_col))
        before, mixed = mixed, _mixed(mixed.drop("c"), links)
        discard(before)
    links = links.unionByName(_verified(exact_pairs(mixed, nodes), docs, nodes, text_col))
    discard(mixed, nodes)
    return connected_components(links).toDF("sig", "component")
