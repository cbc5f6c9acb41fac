"""Operators on the entity-chunk graph: mention edges are rows of (entity, chunk).

All take whole tables and every search takes a table of starting points, so one plan answers
all queries. Hot entities and chunks are left to Spark's skew joins; counts combine before they are shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scratch import discard, store


def mention_edges(rows: DataFrame, entity: str, chunk: str) -> DataFrame:
    """Distinct (entity, chunk), without nulls."""
    return rows.select(F.col(entity).alias("entity"), F.col(chunk).alias("chunk")).where("entity is not null and chunk is not null").distinct()


def mention_counts(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, mentions`` of the asked entities; 0 for those without an edge."""
    counts = edges.groupBy("entity").agg(F.count("chunk").alias("mentions"))
    return entities.select("entity").distinct().join(counts, "entity", "left").select("entity", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


def frontier(edges: DataFrame, entities: DataFrame, most_mentions: int = 2, limit: int = 8) -> DataFrame:
    """The least-mentioned of the asked entities, by count and id."""
    return mention_counts(edges, entities).where(F.col("mentions") <= most_mentions).orderBy("mentions", "entity").limit(limit)


#: Entities of one chunk whose pairs one join key holds; those of larger chunks meet tile by tile.
TILE = 2048
#: Pairs that a task counts at most, about: so the memory of a task does not grow with the graph.
TASK_PAIRS = 1_000_000


def _pair_tasks(sizes: DataFrame) -> int:
    """Tasks for the pairs of chunks (n_ entities each), as many as the session's shuffles have at least."""
    pairs = sizes.agg(F.sum(F.col("n_").cast("double") * (F.col("n_") - 1) / 2)).first()[0] or 0.0
    return max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))


def cooccurrence(edges: DataFrame) -> DataFrame:
    """``a, b, weight`` with a < b: the chunks that both are mentioned in. edges: as ``mention_edges`` gives them.

    A chunk of more than ``TILE`` entities is cut into tiles by hash, and each pair of tiles is a key of its own, so no task pairs a whole
    large chunk. Such chunks are found first and are few; without any the plan is a plain self-join.
    Joins and counts have as many tasks as the pairs ask for (``TASK_PAIRS``); a pair is moved once for each chunk that it shares.
    """
    sizes = store(edges.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_")), "chunk-sizes")
    tasks = _pair_tasks(sizes)
    large = store(sizes.where(F.col("n_") > TILE).select("chunk", F.ceil(F.col("n_") / TILE).cast("int").alias("tiles_")), "large-chunks")
    apart = not large.isEmpty()
    small = edges.join(large, "chunk", "left_anti") if apart else edges
    dealt = small.repartition(tasks, "chunk")
    left, right = dealt.select(F.col("entity").alias("a"), "chunk"), dealt.select(F.col("entity").alias("b"), "chunk")
    pairs = left.join(right, "chunk").where("a < b").select("a", "b")
    if apart:
        own = F.pmod(F.xxhash64("entity"), F.col("tiles_")).cast("int")
        tiled = edges.join(large, "chunk").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles_") - 1)))
        keys = ["chunk", "x", "y"]
        rows = tiled.select("chunk", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "entity")
        met = rows.withColumnsRenamed({"entity": "a", "own": "own_a"}).join(rows.withColumnsRenamed({"entity": "b", "own": "own_b"}), keys)
        # of two tiles, pairs across them; those within one meet under its own key
        pairs = pairs.unionByName(met.where("a < b and (x = y or own_a <> own_b)").select("a", "b"))
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def best(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes below the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def neighbours(edges: DataFrame, starts: DataFrame, limit: int = 300) -> DataFrame:
    """``start, entity, weight``: entities that share chunks with each start, most shared first."""
    here = starts.select(F.col("entity").alias("start")).distinct().join(edges.withColumnRenamed("entity", "start"), "start")
    shared = here.join(edges, "chunk").where("entity <> start").groupBy("start", "entity").agg(F.count("chunk").alias("weight"))
    return best(shared, ["start"], [F.desc("weight"), "entity"], limit).drop("rank")


def second_neighbours(edges: DataFrame, starts: DataFrame, limit: int = 300) -> DataFrame:
    """``start, mid, entity, weight``: edges from a start's neighbours onwards, weighted by distinct chunks."""
    here = starts.select(F.col("entity").alias("start")).distinct().join(edges.withColumnRenamed("entity", "start"), "start")
    mids = store(here.join(edges.withColumnRenamed("entity", "mid"), "chunk").where("mid <> start").select("start", "mid").distinct(), "mids")
    # what leaves a middle is the same for all starts, so it is counted once
    leaving = edges.withColumnRenamed("entity", "mid").join(mids.select("mid").distinct(), "mid", "left_semi").join(edges, "chunk").where("entity <> mid")
    weighted = leaving.groupBy("mid", "entity").agg(F.count("chunk").alias("weight"))
    # of one middle a start takes ``limit`` at most, and one may be the start itself
    first = best(weighted, ["mid"], [F.desc("weight"), "entity"], limit + 1).drop("rank")
    onward = mids.join(first, "mid").where("entity <> start").select("start", "mid", "entity", "weight")
    return best(onward, ["start"], [F.desc("weight"), "mid", "entity"], limit).drop("rank")


def subgraph(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """``start, entity``: all nodes within 1 or 2 hops (other numbers are drawn to these), each start included.

    Steps go to chunks and back, and each is freed of repeated rows; of entities on the way only those of several chunks lead on.
    """
    asked = starts.select("entity").distinct()
    here = asked.select(F.col("entity").alias("start")).join(edges.withColumnRenamed("entity", "start"), "start").select("start", "chunk")
    nodes = near = here.join(edges, "chunk").select("start", "entity").distinct()
    if max(1, min(hops, 2)) == 2:
        several = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("entity")
        onward = edges.join(several, "entity", "left_semi")
        far = near.join(onward, "entity").select("start", "chunk").distinct().join(edges, "chunk").select("start", "entity")
        nodes = near.unionByName(far)
    return nodes.unionByName(asked.select(F.col("entity").alias("start"), "entity")).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """``kind, n``: nodes by label and edges."""
    return edges.agg(F.count_distinct("entity").alias("entity"), F.count_distinct("chunk").alias("chunk"), F.count(F.lit(1)).alias("mentioned_in")).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("n")) for k in ("entity", "chunk", "mentioned_in")])).alias("x")
    ).select("x.kind", "x.n")


def graph_counts(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """``what`` (node or edge), ``kind, n``: rows of each node label and each edge type, 0 for empty ones, in one plan."""
    out = None
    for what, tables in (("node", nodes), ("edge", edges)):
        for kind, df in tables.items():
            row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit(kind).alias("kind"), "n")
            out = row if out is None else out.unionByName(row)
    return out


#: Queries whose scores travel in one row, a column each.
BLOCK = 16


def bipartite(edges: DataFrame) -> DataFrame:
    """``entity, chunk, out, back``: each edge with its parts of the rank that leaves its entity and its chunk."""
    of = lambda end, name: edges.groupBy(end).agg((1.0 / F.count(F.lit(1))).alias(name))
    return edges.join(of("entity", "out"), "entity").join(of("chunk", "back"), "chunk").select("entity", "chunk", "out", "back")


class Walks:
    """Walks from all queries' seeds over an entity-chunk graph (``bipartite``, stored), two steps (entity, chunk, entity) a round.

    Queries are dealt to blocks of ``BLOCK``, by their smallest seed as near ones meet the same nodes; a row has a node's scores for a block,
    so links meet blocks and not queries. Each round stores the sum of the walks so far: what the last sum leads to, and the seeds. Pairs of entities are never
    listed: a round goes through the chunks, whose scores are stored between, so that each half's shuffles are deleted before the next.
    Unless ``keep`` is set a round's sum is deleted when the next is stored.
    """

    def __init__(self, links: DataFrame, seeds: DataFrame, damping: float, keep: bool = True):
        self.damping, self.links, self.keep = damping, links, keep
        known = seeds.select("query_id", "entity").distinct().join(self.links.select("entity").distinct(), "entity", "left_semi")
        known = store(known.select("query_id", "entity"), "ppr-seeds")
        first = known.groupBy("query_id").agg(F.min("entity").alias("first"))
        n = first.count()
        placed = first.repartitionByRange(n // 4096 + 1, "first", "query_id").sortWithinPartitions("first", "query_id").withColumn("at", F.monotonically_increasing_id())
        # partitions' numbers begin at multiples of 2^33, so none shares a block
        self.places = store(placed.select("query_id", F.floor(F.col("at") / BLOCK).alias("block"), (F.col("at") % BLOCK).cast("int").alias("slot")), "ppr-places")
        self.names = [f"s{i}" for i in range(max(1, min(BLOCK, n)))]
        begin = [F.sum(F.when(F.col("slot") == i, 1.0 - damping).otherwise(0.0)).alias(s) for i, s in enumerate(self.names)]
        self.begin = self.walk = store(known.join(self.places, "query_id").groupBy("block", "entity").agg(*begin), "ppr-walk")
        self.stored = [known, self.places, self.begin]

    def _sums(self, rows: DataFrame, node: str) -> DataFrame:
        return rows.groupBy("block", node).agg(*[F.sum(F.col(s) * F.col("share")).alias(s) for s in self.names])

    def step(self) -> None:
        """Entity to chunk to entity."""
        through = store(self.chunks(), "ppr-through")
        back = self.links.select("entity", "chunk", (self.damping * F.col("back")).alias("share"))
        moved = through.join(back, "chunk").select("block", "entity", "share", *self.names)
        moved = moved.unionByName(self.begin.select("block", "entity", F.lit(1.0).alias("share"), *self.names))
        self.walk = store(self._sums(moved, "entity"), "ppr-walk")
        self.stored.append(self.walk)
        discard(through, *([self.stored.pop(-2)] if not self.keep and self.stored[-2] is not self.begin else []))

    def entities(self) -> DataFrame:
        """``block, entity``, and the sum of the walks so far."""
        return self.walk

    def chunks(self) -> DataFrame:
        """``block, chunk``, and the sum of the walks that are a step further."""
        return self._sums(self.walk.join(self.links.select("entity", "chunk", (self.damping * F.col("out")).alias("share")), "entity"), "chunk")

    def close(self) -> None:
        discard(*self.stored)

    def by_query(self, scores: DataFrame, node: str, least: DataFrame | None = None) -> DataFrame:
        """``query_id, node, score`` of scores by block, without zeros; those of ``least`` (block, slot, least) at least, if given, rounded as it is."""
        slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).alias("score")) for i, s in enumerate(self.names)])
        if least is not None:
            wide = least.groupBy("block").agg(*[F.max(F.when(F.col("slot") == i, F.col("least"))).alias(f"l{i}") for i in range(len(self.names))])
            scores = scores.join(wide, "block")
            reach = [F.when(F.round(s, 8) >= F.coalesce(F.col(f"l{i}"), F.lit(0.0)), F.struct(F.lit(i).alias("slot"), F.col(s).alias("score"))) for i, s in enumerate(self.names)]
            slots = F.array_compact(F.array(*reach))
        rows = scores.select("block", node, F.explode(slots).alias("x")).where("x.score > 0").select("block", "x.slot", node, "x.score")
        return rows.join(self.places, ["block", "slot"]).select("query_id", node, "score")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``query_id, node, score`` for a table of seeds (query_id, entity); unknown and repeated seeds do not count. Nodes are "e" or "c" and the id.

    A truncated power series: (1 - d) * sum over l <= rounds of d^l * walk_l. Walks go from entities to chunks and back (see ``Walks``);
    a chunk's sum is that of its entities' walks, a step further.
    """
    walks, chunks = Walks(store(bipartite(edges), "ppr-links"), seeds, damping), None
    for _ in range((rounds - 1) // 2):
        walks.step()
    if rounds > 0:
        chunks = walks.chunks()  # odd steps, up to rounds
    if rounds > 0 and rounds % 2 == 0:
        walks.step()
    named = lambda df, side: df.select("query_id", F.concat(F.lit(side[0]), F.col(side).cast("string")).alias("node"), "score")
    total = named(walks.by_query(walks.entities(), "entity"), "entity")
    return total.unionByName(named(walks.by_query(chunks, "chunk"), "chunk")) if chunks is not None else total


def best_chunks(edges: DataFrame, seeds: DataFrame, k: int, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``query_id, chunk, score, rank``: as ``top_chunks`` of ``personalised_pagerank``, which list no node of a query but what can be among its first k."""
    return _best_of(Walks(store(bipartite(edges), "ppr-links"), seeds, damping), k, rounds)


def _best_of(walks: Walks, k: int, rounds: int) -> DataFrame:
    """Chunks are dealt to k lots by hash: the least of the lots' greatest scores is one that k chunks reach."""
    for _ in range((rounds - 1) // 2):
        walks.step()
    scores = store(walks.chunks(), "ppr-chunks")
    walks.stored.append(scores)
    lots = scores.groupBy("block", F.pmod(F.xxhash64("chunk"), F.lit(k)).alias("lot")).agg(*[F.max(F.round(s, 8)).alias(s) for s in walks.names])
    full = lots.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *[F.min(s).alias(s) for s in walks.names])
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.when(F.col("n") == k, F.col(s)).otherwise(0.0).alias("least")) for i, s in enumerate(walks.names)])
    least = full.select("block", F.explode(slots).alias("x")).select("block", "x.slot", "x.least")
    found = walks.by_query(scores, "chunk", least).select("query_id", F.concat(F.lit("c"), F.col("chunk").cast("string")).alias("node"), "score")
    return top_chunks(found, k)


#: Edges of a graph that tasks hold as a whole (about 60 MB), each walking for its own queries.
HELD_EDGES = 4_000_000
#: Rows (a node's scores for a block of queries) that a round over a larger graph may have: more queries take turns.
ROUND_ROWS = 1_000_000


class Held:
    """A graph of bounded size in arrays: nodes and edges in the order of their components, so that a walk meets no others. edges: entity, chunk, distinct."""

    def __init__(self, edges: pa.Table):
        ids = [pc.unique(edges.column(x).combine_chunks()) for x in ("entity", "chunk")]
        e, c = (pc.index_in(edges.column(x), value_set=v).to_numpy().astype(np.int32) for x, v in zip(("entity", "chunk"), ids, strict=True))
        label = self._components(e, c, *map(len, ids))
        of_chunk = np.empty(len(ids[1]), np.int64)
        of_chunk[c] = label[e]
        orders = [np.argsort(label, kind="stable"), np.argsort(of_chunk, kind="stable")]
        self.ids = [v.take(pa.array(o)) for v, o in zip(ids, orders, strict=True)]
        e, c = (np.argsort(o).astype(np.int32)[x] for o, x in zip(orders, (e, c), strict=True))
        self.degrees = np.bincount(e, minlength=len(ids[0])), np.bincount(c, minlength=len(ids[1]))
        self.begins = [np.r_[0, np.cumsum(d)] for d in self.degrees]
        self.chunks_of, self.entities_of = c[np.argsort(e, kind="stable")], e[np.argsort(c, kind="stable")]
        # where components begin, among entities and chunks
        _, first, self.component = np.unique(label[orders[0]], return_index=True, return_inverse=True)
        self.firsts = np.r_[first, len(ids[0])], np.r_[np.unique(of_chunk[orders[1]], return_index=True)[1], len(ids[1])]

    @staticmethod
    def _components(e: np.ndarray, c: np.ndarray, entities: int, chunks: int) -> np.ndarray:
        """A number for each entity that is the same where paths lead."""
        label = np.arange(entities)
        while True:
            low, new = np.full(chunks, entities), label.copy()
            np.minimum.at(low, c, label[e])
            np.minimum.at(new, e, low[c])
            np.minimum.at(new, label, new.copy())  # the label's own node follows
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def walked(self, seeds: np.ndarray, damping: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that some entities (places) lead to, and their scores."""
        out = []
        for part in np.unique(self.component[seeds]):
            (e, e_end), (c, c_end) = (f[part : part + 2] for f in self.firsts)
            begin = np.zeros(e_end - e)
            begin[seeds[self.component[seeds] == part] - e] = 1.0 - damping
            at, through = self.begins[0][e : e_end + 1], self.begins[1][c : c_end + 1]
            chunks_of, entities_of = self.chunks_of[at[0] : at[-1]] - c, self.entities_of[through[0] : through[-1]] - e
            at, through, walk = at[:-1] - at[0], through[:-1] - through[0], begin
            for left in range((rounds - 1) // 2, -1, -1):
                there = damping * np.add.reduceat((walk / self.degrees[0][e:e_end])[entities_of], through)
                if left:
                    walk = begin + damping * np.add.reduceat((there / self.degrees[1][c:c_end])[chunks_of], at)
            out.append((np.arange(c, c_end), there))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_held(edges: DataFrame, seeds: DataFrame, k: int, damping: float, rounds: int) -> DataFrame:
    """``best_chunks`` over a graph of ``HELD_EDGES`` edges at most, which is sent to the tasks as a whole: nothing but each query's best is shuffled or stored."""
    graph = Held(edges.toArrow())
    shared = edges.sparkSession.sparkContext.broadcast(graph)
    asked = store(seeds.where("entity is not null").groupBy("query_id").agg(F.collect_set("entity").alias("entities")), "ppr-asked")
    kinds = dict(asked.dtypes)["query_id"], dict(edges.dtypes)["chunk"]
    schema = pa.schema([("query_id", to_arrow_type(asked.schema["query_id"].dataType)), ("chunk", graph.ids[1].type), ("score", pa.float64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for i, entities in enumerate(batch.column(1)):
                places = pc.drop_null(pc.index_in(entities.values, value_set=graph.ids[0])).to_numpy()
                if len(places):
                    chunks, scores = graph.walked(places, damping, rounds)
                    # the places of scores that are equal when rounded are settled by the chunks' names
                    least = np.partition(scores, -k)[-k] - 2e-8 if k < len(scores) else 0.0
                    kept = np.flatnonzero((scores > 0) & (scores >= least))
                    query = pa.repeat(batch.column(0)[i], len(kept))
                    yield pa.RecordBatch.from_arrays([query, graph.ids[1].take(pa.array(chunks[kept])), pa.array(scores[kept])], schema=schema)

    tasks = max(1, min(asked.count() // 4, 4 * asked.sparkSession.sparkContext.defaultParallelism))
    found = asked.repartition(tasks, "query_id").mapInArrow(walk, f"query_id {kinds[0]}, chunk {kinds[1]}, score double")
    return top_chunks(found.select("query_id", F.concat(F.lit("c"), F.col("chunk").cast("string")).alias("node"), "score"), k)


def best_chunks_of_many(edges: DataFrame, seeds: DataFrame, k: int, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """As ``best_chunks``, for many queries, whose walks reach a great part of the graph each: so their scores are never stored all at once.

    Tasks hold a graph of ``HELD_EDGES`` edges and walk query by query. Over a larger one, lots of queries take turns and leave only their best.
    """
    edges = store(edges.select("entity", "chunk"), "ppr-edges")
    if edges.count() <= HELD_EDGES:
        return _best_held(edges, seeds, k, damping, rounds)
    links = store(bipartite(edges), "ppr-links")
    nodes, queries = links.agg(F.greatest(F.count_distinct("entity"), F.count_distinct("chunk"))).first()[0], seeds.select("query_id").distinct().count()
    lots = max(1, -(-nodes * -(-queries // BLOCK) // ROUND_ROWS))
    # near queries meet the same nodes, so lots are ranges of them
    first = seeds.groupBy("query_id").agg(F.min("entity").alias("first"))
    ranged = store(first.repartitionByRange(lots, "first", "query_id").select("query_id", F.spark_partition_id().alias("lot")), "ppr-ranges")
    dealt = store(seeds.join(ranged, "query_id"), "ppr-lots")
    out = []
    for i in range(lots):
        walks = Walks(links, dealt.where(F.col("lot") == i), damping, keep=False)
        out.append(store(_best_of(walks, k, rounds), "ppr-best"))
        walks.close()
    return functools.reduce(DataFrame.unionByName, out)


def top_chunks(ranks: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk, score, rank``: the best chunks of each query; ties go to the smaller id."""
    chunks = ranks.where(F.startswith("node", F.lit("c"))).select("query_id", F.substring("node", 2, 100).alias("chunk"), F.round("score", 8).alias("score"))
    return best(chunks, ["query_id"], [F.desc("score"), F.length("chunk"), "chunk"], k)


def _chunks_around(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """``start, chunk``: the chunks of each start, and those that ``steps`` entities on the way lead to. An entity of one chunk leads nowhere, so only those of several are met."""
    several = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("entity")
    through = edges.join(several, "entity", "left_semi") if steps else edges
    seen = front = store(starts.distinct().join(edges.withColumnRenamed("entity", "start"), "start").select("start", "chunk"), "paths")
    for _ in range(steps):
        met = front.join(through, "chunk").select("start", "entity").distinct()
        reached = met.join(through, "entity").select("start", "chunk").distinct()
        front = store(reached.join(seen, ["start", "chunk"], "left_anti"), "paths")
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, pairs: DataFrame, most_hops: int = 3) -> DataFrame:
    """``a, b, connected``: whether a path of at most ``most_hops`` shared-chunk steps joins each pair. edges: as ``mention_edges`` gives them.

    A path of h steps is h chunks of which neighbours share an entity, so both ends' chunks are followed half the way and meet; entities are not listed at either end.
    """
    asked = pairs.select("a", "b").distinct()
    there = asked.where("a <> b") if most_hops > 0 else asked.limit(0)
    from_a = _chunks_around(edges, there.select(F.col("a").alias("start")), most_hops // 2).toDF("a", "chunk")
    from_b = _chunks_around(edges, there.select(F.col("b").alias("start")), max(0, (most_hops - 1) // 2)).toDF("b", "chunk")
    hit = there.join(from_b, "b").join(from_a, ["a", "chunk"], "left_semi").select("a", "b").distinct().withColumn("hit", F.lit(True))
    return asked.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.col("a") == F.col("b"), F.lit(False)).alias("connected"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) of links (a, b): every node takes its neighbourhood's smallest label, and its label's label."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store(both, "components-links")
    label = store(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "components")
    for _ in range(max_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("low"))
        joined = label.join(near, F.col("node") == F.col("n"), "left").select("node", "component", F.least("component", "low").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = joined.join(jump, "low", "left").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved"))
        new = store(new, "components")
        if new.where("moved").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def inner_links(links: DataFrame, membership: DataFrame) -> DataFrame:
    """``community_id, a, b, weight``: links with both ends in one community. membership: community_id, node."""
    of = lambda end: membership.select(F.col("node").alias(end), F.col("community_id").alias(f"{end}_c"))
    inside = links.join(of("a"), "a").join(of("b"), "b").where("a_c = b_c")
    return inside.select(F.col("a_c").alias("community_id"), "a", "b", "weight")


def _lines(ranked: DataFrame, line: Column) -> DataFrame:
    return ranked.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def community_lines(links: DataFrame, membership: DataFrame, limit: int = 30) -> DataFrame:
    """``community_id, lines``: the strongest links inside each community, as text."""
    top = best(inner_links(links, membership), ["community_id"], [F.desc("weight"), "a", "b"], limit)
    return _lines(top, F.concat_ws(" ", F.col("a").cast("string"), F.lit("<->"), F.col("b").cast("string"), F.concat(F.lit("("), "weight", F.lit(")"))))


def concept_lines(entities: DataFrame, membership: DataFrame, limit: int = 30) -> DataFrame:
    """``community_id, lines``: labels and types of each community's first members by id. entities: node, label, entity_type."""
    top = best(membership.join(entities, "node"), ["community_id"], ["node"], limit)
    return _lines(top, F.concat(F.lit("- "), "label", F.lit(" ("), "entity_type", F.lit(")")))


def auto_summary(labels: Column, n: Column) -> Column:
    """A fixed sentence: the count and the first five labels."""
    return F.concat(F.lit("Community of "), n.cast("string"), F.lit(" concepts: "), F.array_join(F.slice(labels, 1, 5), ", "), F.lit("."))


def gap_pairs(edges: DataFrame, asked: DataFrame, tried: DataFrame, per_query: int = 2, most_hops: int = 3) -> DataFrame:
    """``query_id, a, b``: pairs of a query's entities (query_id, entity) without a short path, not tried before; few for each query."""
    left, right = asked.select("query_id", F.col("entity").alias("a")).distinct(), asked.select("query_id", F.col("entity").alias("b")).distinct()
    pairs = left.join(right, "query_id").where("a < b")
    open_ = paths(edges, pairs, most_hops).where(~F.col("connected")).select("a", "b")
    fresh = pairs.join(open_, ["a", "b"]).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return best(fresh, ["query_id"], ["a", "b"], per_query).select("query_id", "a", "b")


def with_communities(entities: DataFrame, membership: DataFrame) -> DataFrame:
    """Entities with the communities that they are in. membership: community_id, cui."""
    found = membership.groupBy("cui").agg(F.array_sort(F.collect_set("community_id")).alias("communities"))
    return entities.join(found, "cui", "left").withColumn("communities", F.coalesce("communities", F.array().cast("array<string>")))


def connecting_evidence(edges: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """``a, b, chunk, score, rank``: the chunks that rank highest from both ends of each pair."""
    seeds = pairs.select("a", "b", F.concat_ws("|", "a", "b").alias("query_id"))
    both = seeds.select("query_id", F.col("a").alias("entity")).unionByName(seeds.select("query_id", F.col("b").alias("entity")))
    return seeds.join(best_chunks_of_many(edges, both, k), "query_id").drop("query_id")


def intersections(left: DataFrame, right: DataFrame, by: str, value: str) -> DataFrame:
    """``by, shared, either``: how many values two tables share, and have in all, by an outer join of their distinct values."""
    a, b = left.select(by, value).distinct().withColumn("l_", F.lit(1)), right.select(by, value).distinct().withColumn("r_", F.lit(1))
    return a.join(b, [by, value], "full").groupBy(by).agg(F.count_if(F.col("l_").isNotNull() & F.col("r_").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))
