"""Queries on the mention graph: lineitem as edges, parts as entities, orders as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community as c
from ..operators import graph as g


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.mention_edges(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_partkey", "l_orderkey")


def parts(spark: SparkSession, sf: str, every: int = 1) -> DataFrame:
    """Parts as entities; the searches ask for each ``every``-th one."""
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("entity")).where(F.col("entity") % every == 0)


def sparse_edges(spark: SparkSession, sf: str, *shared: str) -> DataFrame:
    """Parts that share what is named, or else type, size and brand: a graph in which most are mentioned seldom and few are connected."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat_ws("/", *(shared or ("p_type", "p_size", "p_brand"))).alias("chunk"))
    return g.mention_edges(rows, "p_partkey", "chunk")


def pairs(spark, sf):
    return parts(spark, sf, 50).withColumnRenamed("entity", "a").withColumn("b", F.col("a") * 7 % 101 + 1)


def gap_pairs(spark, sf):
    """Groups of neighbouring parts as queries."""
    asked = parts(spark, sf).withColumn("query_id", F.floor(F.col("entity") / 6).cast("long"))
    tried = parts(spark, sf, 12).select(F.col("entity").alias("a"), (F.col("entity") + 1).alias("b"))
    return g.gap_pairs(sparse_edges(spark, sf), asked, tried)


def evidence(spark, sf):
    asked = parts(spark, sf, 50).select(F.col("entity").alias("a"), (F.col("entity") - 1).alias("b"))
    got = g.connecting_evidence(edges(spark, sf), asked)
    return got.select("a", "b", F.col("chunk").cast("long").alias("chunk"), F.round("score", 6).alias("score"), "rank")


def seeds(spark, sf):
    """Nations as seeds of their region's query, twice; number 0 is no part."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("entity"))
    return n.unionByName(n)


def ppr_topk(spark, sf):
    e = edges(spark, sf)
    top = g.best_chunks(e, seeds(spark, sf), 15)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("chunk"), "o_orderpriority")
    return top.withColumn("chunk", F.col("chunk").cast("long")).join(orders, "chunk").select("query_id", "chunk", F.round("score", 6).alias("score"), "rank", "o_orderpriority")


def _label_links(spark, sf):
    """Suppliers and nations as a graph: each supplier of a nation is linked to the nation's smallest, when their keys agree mod 3."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    first = s.groupBy("s_nationkey", (F.col("s_suppkey") % 3).alias("r")).agg(F.min("s_suppkey").alias("b"))
    return s.withColumn("r", F.col("s_suppkey") % 3).join(first, ["s_nationkey", "r"]).select(F.col("s_suppkey").alias("a"), "b")


def communities(spark, sf):
    return c.communities(g.connected_components(_label_links(spark, sf)))


def modularity_of_label(spark, sf):
    links = g.cooccurrence(edges(spark, sf))
    labels = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label"))
    return c.modularity(links, labels).select(F.round("modularity", 6).alias("modularity"))


def communities_modularity(spark, sf):
    return c.leiden(g.cooccurrence(edges(spark, sf)))


QUERIES = {
    "cooccurrence_edges": lambda s, d: g.cooccurrence(edges(s, d)),
    "mention_counts": lambda s, d: g.mention_counts(edges(s, d), parts(s, d)),
    "frontier_entities": lambda s, d: g.frontier(sparse_edges(s, d), parts(s, d)),
    "neighbours_1hop": lambda s, d: g.neighbours(edges(s, d), parts(s, d, 50)),
    "neighbours_2hop": lambda s, d: g.second_neighbours(edges(s, d), parts(s, d, 50)),
    "subgraph_nodes": lambda s, d: g.subgraph(edges(s, d), parts(s, d, 50), hops=2),
    "graph_stats": lambda s, d: g.graph_stats(edges(s, d)),
    "ppr_topk": ppr_topk,
    "path_exists": lambda s, d: g.paths(edges(s, d), pairs(s, d)),
    "path_exists_sparse": lambda s, d: g.paths(sparse_edges(s, d, "p_type", "p_size"), parts(s, d).select(F.col("entity").alias("a"), (F.col("entity") + 7).alias("b"))),
    "components": lambda s, d: g.connected_components(_label_links(s, d)),
    "stable_community_id": communities,
    "modularity_of_label": modularity_of_label,
    "communities_modularity": communities_modularity,
    "gap_pairs": gap_pairs,
    "connecting_evidence": evidence,
}

_E = "edges AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS chunk FROM lineitem)"
_NEAR = f"""{_E}, near AS (
  SELECT x.entity AS start, y.entity AS entity, count(*) AS weight FROM edges x JOIN edges y USING (chunk) WHERE x.entity <> y.entity GROUP BY ALL)"""
_FAR = f"""{_E}, mids AS (SELECT DISTINCT x.entity AS start, y.entity AS mid FROM edges x JOIN edges y USING (chunk) WHERE x.entity <> y.entity AND x.entity % 50 = 0),
far AS (SELECT start, mid, y.entity AS entity, count(*) AS weight FROM mids JOIN edges x ON x.entity = mid JOIN edges y USING (chunk)
  WHERE y.entity <> mid AND y.entity <> start GROUP BY start, mid, y.entity
  QUALIFY row_number() OVER (PARTITION BY start ORDER BY count(*) DESC, mid, y.entity) <= 300)"""
_LINKS = "links AS (SELECT s_suppkey AS a, min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 3) AS b FROM supplier)"
_SPARSE = "edges AS (SELECT DISTINCT p_partkey AS entity, concat_ws('/', p_type, p_size, p_brand) AS chunk FROM part)"
#: Of pairs (a, b): whether three steps over edges join them. An entity shares a chunk with itself, so shorter paths count.
_THREE = """one AS (SELECT DISTINCT x.entity AS n, y.entity AS m FROM edges x JOIN edges y USING (chunk)),
h2 AS (SELECT DISTINCT p.a, q.m FROM pairs p JOIN one o ON o.n = p.a JOIN one q ON q.n = o.m),
hit AS (SELECT DISTINCT p.a, p.b FROM pairs p JOIN h2 USING (a) JOIN one o ON o.n = p.b AND o.m = h2.m)
SELECT a, b, a = b OR (a, b) IN (SELECT (a, b) FROM hit) AS connected FROM pairs"""


def _ppr(seeds: str, k: int) -> str:
    return f"""WITH RECURSIVE {_E}, seeds(q, e) AS ({seeds}), both_ AS (
  SELECT 'e' || entity AS src, 'c' || chunk AS dst FROM edges UNION ALL SELECT 'c' || chunk, 'e' || entity FROM edges
), links AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM both_
), walk AS (
  SELECT DISTINCT 0 AS step, q AS query_id, 'e' || e AS node, 0.15::DOUBLE AS score FROM seeds WHERE e IN (SELECT entity FROM edges)
  UNION ALL
  SELECT step + 1, query_id, dst, 0.85::DOUBLE * sum(score * share) FROM walk JOIN links ON node = src WHERE step < 20 GROUP BY step, query_id, dst
), total AS (SELECT query_id, substr(node, 2) AS chunk, round(sum(score), 8) AS score FROM walk WHERE node LIKE 'c%' GROUP BY 1, 2
), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(chunk), chunk) AS rank FROM total QUALIFY rank <= {k})"""


SQL = {
    "cooccurrence_edges": f"WITH {_E} SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM edges x JOIN edges y USING (chunk) WHERE x.entity < y.entity GROUP BY 1, 2",
    "mention_counts": f"WITH {_E} SELECT p_partkey AS entity, count(chunk) AS mentions FROM part LEFT JOIN edges ON p_partkey = entity GROUP BY 1",
    "frontier_entities": f"WITH {_SPARSE} SELECT p_partkey AS entity, count(chunk) AS mentions FROM part LEFT JOIN edges ON p_partkey = entity GROUP BY 1 HAVING count(chunk) <= 2 ORDER BY 2, 1 LIMIT 8",
    "neighbours_1hop": f"WITH {_NEAR} SELECT * FROM near WHERE start % 50 = 0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, entity) <= 300",
    "neighbours_2hop": f"WITH {_FAR} SELECT * FROM far",
    "subgraph_nodes": f"""WITH {_E}, one AS (SELECT DISTINCT x.entity AS n, y.entity AS m FROM edges x JOIN edges y USING (chunk)),
near AS (SELECT n AS start, m AS entity FROM one WHERE n % 50 = 0)
SELECT start, entity FROM near UNION SELECT near.start, one.m FROM near JOIN one ON one.n = near.entity UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 50 = 0""",
    "graph_stats": f"WITH {_E} SELECT 'entity' AS kind, count(DISTINCT entity) AS n FROM edges UNION ALL SELECT 'chunk', count(DISTINCT chunk) FROM edges UNION ALL SELECT 'mentioned_in', count(*) FROM edges",
    "ppr_topk": _ppr("SELECT n_regionkey::BIGINT, n_nationkey FROM nation", 15) + " SELECT query_id, o_orderkey AS chunk, round(score, 6) AS score, rank, o_orderpriority FROM top JOIN orders ON o_orderkey = chunk::BIGINT",
    "path_exists": f"""WITH {_E}, pairs AS (SELECT p_partkey AS a, p_partkey * 7 % 101 + 1 AS b FROM part WHERE p_partkey % 50 = 0), {_THREE}""",
    "path_exists_sparse": f"""WITH edges AS (SELECT DISTINCT p_partkey AS entity, concat_ws('/', p_type, p_size) AS chunk FROM part), pairs AS (SELECT p_partkey AS a, p_partkey + 7 AS b FROM part), {_THREE}""",
    "components": f"WITH {_LINKS} SELECT a AS node, b AS component FROM links",
    "stable_community_id": f"WITH {_LINKS} SELECT 'comm_' || substr(sha1(string_agg(a::VARCHAR, '|' ORDER BY a::VARCHAR)), 1, 12) AS community_id, count(*) AS size FROM links GROUP BY b HAVING count(*) >= 3",
    "modularity_of_label": f"""WITH {_E}, links AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM edges x JOIN edges y USING (chunk) WHERE x.entity < y.entity GROUP BY 1, 2),
both_ AS (SELECT p.p_brand AS la, q.p_brand AS lb, weight FROM links JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b),
tot AS (SELECT l, sum(weight)::DOUBLE AS t FROM (SELECT la AS l, weight FROM both_ UNION ALL SELECT lb, weight FROM both_) GROUP BY 1),
m AS (SELECT sum(weight)::DOUBLE AS m, sum(weight) FILTER (WHERE la = lb)::DOUBLE AS inside FROM both_)
SELECT round(inside / m - (SELECT sum(t * t) FROM tot) / (4 * m * m), 6) AS modularity FROM m""",
    "gap_pairs": f"""WITH {_SPARSE}, asked AS (SELECT p_partkey // 6 AS query_id, p_partkey AS entity FROM part),
pairs AS (SELECT x.query_id, x.entity AS a, y.entity AS b FROM asked x JOIN asked y USING (query_id) WHERE x.entity < y.entity)
SELECT query_id, a, b FROM pairs WHERE NOT (a % 12 = 0 AND b = a + 1)
 AND NOT EXISTS (SELECT 1 FROM edges x JOIN edges y USING (chunk) WHERE x.entity = a AND y.entity = b)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a, b) <= 2""",
    "connecting_evidence": _ppr("SELECT p_partkey || '|' || (p_partkey - 1), p_partkey FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT p_partkey || '|' || (p_partkey - 1), p_partkey - 1 FROM part WHERE p_partkey % 50 = 0", 3)
    + " SELECT split_part(query_id, '|', 1)::BIGINT AS a, split_part(query_id, '|', 2)::BIGINT AS b, chunk::BIGINT AS chunk, round(score, 6) AS score, rank FROM top",
}
