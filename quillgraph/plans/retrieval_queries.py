"""Search and fusion queries: embeddings as dense vectors, document words as sparse ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocabulary as v
from ..functions.scratch import store
from ..operators import models
from ..operators import retrieval as r


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label")


def queries(spark, sf):
    return vectors(spark, sf).where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "v")


def dense(spark, sf, k=10):
    return r.dense_search(vectors(spark, sf), queries(spark, sf), k, exclude_self=True)


def embedded(spark, sf):
    """Documents by the default embedder's vectors: for each fiftieth one the ten nearest others."""
    rows = store(models.embed(words(spark, sf), "doc_id", "text"), "embedded").withColumnRenamed("doc_id", "item_id")
    asked = rows.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    return r.dense_search(rows, asked, 10, exclude_self=True).select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


def _first_and_rest(batch):
    """A model that names the first concept and counts the others."""
    said = [f"{x[0]} and {n - 1} more" if len(x) and n > 1 else None for x, n in zip(batch["labels"], batch["n"], strict=True)]
    return batch[["community_id"]].assign(summary=said)


def summaries(spark, sf):
    """Nations as communities of suppliers, summarised by a plugged-in model; communities of one keep the default sentence."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    held = models.described(s.select(F.col("s_nationkey").alias("community_id"), F.col("s_suppkey").alias("node")), s.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label")))
    return models.summarise(held, _first_and_rest)


def words(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def sparse(spark, sf, k=10):
    terms = r.sparse_terms(words(spark, sf), "doc_id", F.col("text"))
    mine = terms.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "term", "w")
    return r.sparse_search(terms.withColumnRenamed("doc_id", "item_id"), mine, k)


def dense_topk(spark, sf):
    return dense(spark, sf).select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


def _lanes(spark, sf):
    d = dense(spark, sf, 10).select("query_id", F.lit("vector").alias("lane"), "item_id", "rank")
    s = sparse(spark, sf, 10).select("query_id", F.lit("graph").alias("lane"), "item_id", "rank")
    return d.unionByName(s)


def rrf_fusion(spark, sf):
    return r.rrf(_lanes(spark, sf), 60, ["graph", "vector"]).select("query_id", "item_id", F.round("score", 6).alias("score"), "lane", "rank")


def fused_topn(spark, sf):
    """The 25 fused items of each query that go to the reranker."""
    d = dense(spark, sf, 20).select("query_id", F.lit("vector").alias("lane"), "item_id", "rank")
    s = sparse(spark, sf, 20).select("query_id", F.lit("graph").alias("lane"), "item_id", "rank")
    return r.rrf(d.unionByName(s), 60, ["graph", "vector"]).where("rank <= 25").select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def hybrid(spark, sf):
    return r.hybrid_search(dense(spark, sf, 30), sparse(spark, sf, 30), 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def multilingual(spark, sf):
    """Labels stand for languages: a lane of 12 for each of three, and one without a filter."""
    v = vectors(spark, sf).withColumnRenamed("label", "lang")
    got = r.multilingual_search(v, queries(spark, sf), [0, 1, 2], 12, 25, exclude_self=True)
    return got.select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


def community_cosine(spark, sf):
    """Embeddings as communities of their label's size; every hundredth is a query, some of these with words alone."""
    e = vectors(spark, sf)
    communities = e.select(F.col("item_id").alias("community_id"), F.col("label").alias("size"), "v", F.concat(F.lit("label "), "label").alias("summary"))
    asked = e.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 200 == 0, F.col("v")).alias("v"), F.concat(F.lit("the label "), "label").alias("text"))
    return r.community_search(communities, asked, 5, 200).select("query_id", "community_id", F.round("score", 5).alias("score"), "rank")


def similarity(spark, sf):
    """Pairs of embeddings with a cosine of 0.3 at least (random vectors are seldom nearer), among each one's ten nearest."""
    return r.similarity_edges(vectors(spark, sf).select("item_id", "v"), 10, least=0.3).select("a", "b", F.round("score", 5).alias("score"))


def community_jaccard(spark, sf, most=500):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    communities = items.select(F.col("item_id").alias("community_id"), F.length("text").alias("size"), F.col("text").alias("summary"))
    asked = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return r.community_rank(communities, asked, 5, most).select("query_id", "community_id", F.round("score", 6).alias("score"), "rank")


def _scored(spark, sf):
    return dense(spark, sf, 15).withColumn("score", F.round("score", 5) - F.when(F.col("query_id") % 3 == 0, 0.9).otherwise(0.0))


def rerank(spark, sf):
    return r.rerank_select(_scored(spark, sf), 10).select("query_id", "item_id", "rank", "no_evidence")


def _asked(spark, sf):
    """Turns of conversations and benchmark passages as queries; those with a long word are linked."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    rows = c.unionByName(b).unionByName(d).where("text is not null")
    return rows.withColumn("linked", F.rlike("text", F.lit("[a-z]{12}")))


def classify(spark, sf):
    return _asked(spark, sf).select("id", "text", "linked", r.classify_query(F.col("text"), F.col("linked")).alias("c")).select("id", "c.query_type", "c.has_signal")


def plans(spark, sf):
    rows = _asked(spark, sf).withColumn("c", r.classify_query(F.col("text"), F.col("linked")))
    return rows.select("id", r.plan_query(F.col("c.query_type"), F.col("c.has_signal"), F.col("linked")).alias("p")).select("id", "p.*")


def tiers(spark, sf):
    """Entities and depth by the text's length; some are not known."""
    rows = _asked(spark, sf).withColumn("c", r.classify_query(F.col("text"), F.col("linked")))
    n = F.length("text")
    return rows.select("id", r.complexity_tier(F.when(n % 4 > 0, n % 4), n % 3 + 1, F.col("c.query_type")).alias("tier"))


def parsed(spark, sf):
    """Roles and languages as a rewriter's answers."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    tier = F.element_at(F.array(*[F.lit(x) for x in (" small ", "Medium", "LARGE\n", "huge")]), (F.length("text") % 4 + 1).cast("int"))
    one = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), t.parse_tier(F.regexp_replace(tier, r"\s", " ")).alias("tier"), t.parse_language(F.col("role")).alias("language"))
    return one.unionByName(d.select(F.concat(F.lit("d"), "doc_id").alias("id"), t.parse_tier(tier).alias("tier"), t.parse_language(F.concat(F.lit(" "), F.upper("lang"))).alias("language")))


def moderation(spark, sf):
    """Labels as a moderator's answers."""
    said = F.when(F.col("toxic") == 1, F.concat(F.lit("Unsafe\ns6"), F.when(F.col("doc_id") % 2 == 0, ", S1").otherwise(""))).when(F.col("quality") == 0, "unsafe").otherwise("safe\nS1")
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", t.moderation_verdict(said).alias("v"))
    return rows.select("doc_id", "v.safe", F.array_join("v.categories", "|").alias("categories"), "v.allowed")


def coerced(spark, sf):
    """Numbers of each conversation's turns as citations, with signs around them."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    raw = F.array_sort(F.collect_list(F.concat(F.lit("["), F.when(F.col("role") == "system", "x").otherwise(F.col("turn").cast("string")), F.lit("]"))))
    return c.groupBy("conv_id").agg(raw.alias("raw")).select("conv_id", F.array_join(F.array_sort(t.coerce_citations(F.col("raw"))).cast("array<string>"), ",").alias("numbers"))


def stitched(spark, sf):
    """Conversations' last answers with the marks that they lack."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 5 > 0, F.concat("text", F.lit(" [1]"))).otherwise(" ").alias("a"))
    return c.select("conv_id", "turn", F.md5(r.stitch_citations(F.col("a"), F.array(F.lit(1), F.col("turn").cast("int") + 1))).alias("digest"))


def node_labels(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    some = lambda n, c: F.when(F.col("p_size") % n == 0, F.col(c)).when(F.col("p_size") % n == 1, "")
    return p.select("p_partkey", t.node_label(some(5, "p_brand"), some(4, "p_type"), some(3, "p_name"), F.lit(None).cast("string"), some(2, "p_name")).alias("label"))


def sparse_merge(spark, sf):
    """Each order's parts as terms, discounts as weights, some of them 0 or less."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").cast("string").alias("k"), F.round(F.col("l_discount") - 0.02, 4).alias("w"), "l_linenumber")
    maps = line.select(F.col("l_orderkey").alias("id"), F.create_map("k", "w").alias("terms"))
    return r.merge_sparse(maps)


def lanes(spark, sf, most=500):
    """The three adapters over searches' results: documents as graph chunks, with their sources as parents, and benchmark passages as communities, the ``most`` largest or all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text", "source")
    hits = sparse(spark, sf, 10).drop("rank").join(docs, "item_id").withColumnRenamed("item_id", "chunk_id")
    found = community_jaccard(spark, sf, most).drop("rank").join(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("community_id"), F.col("text").alias("summary")), "community_id")
    parents = hits.withColumn("parent_text", F.when(F.col("chunk_id") % 2 == 0, F.col("source")).when(F.col("chunk_id") % 4 == 1, ""))
    out = r.graph_lane(hits, F.md5).unionByName(r.vector_lane(parents, F.md5)).unionByName(r.community_lane(found, F.md5))
    return out.select("query_id", "lane", "item_id", "rank", F.round("score", 6).alias("score"), F.col("text").alias("digest"))


def routed(spark, sf):
    """Lanes' rows that the plans of documents as queries leave."""
    asked = words(spark, sf).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text", F.rlike("text", F.lit("[a-z]{12}")).alias("linked"))
    return r.routed_lanes(asked, lanes(spark, sf, None)).select("query_id", "lane", "item_id", "rank")


def paths_used(spark, sf):
    return r.paths_used(lanes(spark, sf, None)).select("query_id", F.array_join("lanes", "|").alias("lanes"))


def _ranked_texts(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text", "lang", "source")
    return sparse(spark, sf, 10).join(texts, "item_id")


def near_duplicates(spark, sf):
    starts = words(spark, sf).select(F.col("doc_id").alias("item_id"), r.text_start(F.col("text")).alias("start"))
    ranked = sparse(spark, sf, 10).join(starts, "item_id")
    return r.near_duplicate_drop(ranked.select("query_id", "item_id", "rank", "start")).select("query_id", "item_id", "rank")


def contexts(spark, sf):
    # the part of a text that is shown is cut before texts are moved to their hits
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), r.shown(F.col("text")).alias("text"), F.col("source").alias("title"), F.col("lang").alias("section"))
    items = sparse(spark, sf, 10).join(texts, "item_id").select("query_id", "rank", "text", "title", "section")
    return r.numbered_context(items).select("query_id", F.md5("context").alias("digest"))


def citations(spark, sf):
    items = _ranked_texts(spark, sf)
    answers = items.select("query_id").distinct().select("query_id", F.concat(F.lit("a [2] b [1] c ["), (F.col("query_id") % 15).cast("string"), F.lit("] [2]")).alias("answer"), F.array(F.lit(3)).alias("citations"))
    return r.resolve_citations(answers, items).select("query_id", F.col("position").cast("long").alias("position"), F.col("number").cast("long").alias("number"), "item_id", "resolved")


def retrieve(spark, sf):
    """Classified, planned, fused, rid of near duplicates, scored and selected, from three lanes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("string").alias("parent_text"))
    asked = words(spark, sf).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text", F.rlike("text", F.lit("[a-z]{12}")).alias("linked"))
    hits = sparse(spark, sf, 40).drop("rank").withColumnRenamed("item_id", "chunk_id")
    found = community_jaccard(spark, sf).drop("rank")
    communities = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("community_id"), F.col("text").alias("summary"))
    return r.retrieve_ids(asked, hits.where("chunk_id % 2 = 0"), hits, found, docs, communities)


QUERIES = {
    "embedded_search": embedded,
    "community_summaries": summaries,
    "dense_topk": dense_topk,
    "sparse_topk": lambda s, d: sparse(s, d),
    "rrf_fusion": rrf_fusion,
    "fused_topn": fused_topn,
    "hybrid_rrf": hybrid,
    "multilingual_search": multilingual,
    "community_jaccard": community_jaccard,
    "community_cosine": community_cosine,
    "similarity_edges": similarity,
    "parse_tier_language": parsed,
    "moderation_verdict": moderation,
    "coerce_citations": coerced,
    "stitch_citations": stitched,
    "node_label": node_labels,
    "merge_sparse_terms": sparse_merge,
    "lane_adapters": lanes,
    "routed_lanes": routed,
    "retrieval_paths": paths_used,
    "rerank_select": rerank,
    "classify_query": classify,
    "plan_query": plans,
    "complexity_tier": tiers,
    "near_duplicate_drop": near_duplicates,
    "numbered_context": contexts,
    "citations": citations,
    "retrieve": retrieve,
}

_DENSE = """dense_all AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label,
  round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
dense AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense_all)"""
_SPARSE = r"""terms AS (SELECT doc_id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2),
sparse AS (SELECT q.doc_id AS query_id, i.doc_id AS item_id, round(sum(q.w * i.w), 6) AS score, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(sum(q.w * i.w), 6) DESC, i.doc_id) AS rank
  FROM terms q JOIN terms i USING (term) WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)"""


def _fused(dense_lane: str, sparse_lane: str, most: int) -> str:
    order = {"graph": 1, "vector": 2, "dense": 1, "sparse": 2}
    return f"""lanes AS (SELECT query_id, item_id, rank, '{dense_lane}' AS lane, {order[dense_lane]} AS o FROM dense WHERE rank <= {most}
 UNION ALL SELECT query_id, item_id, rank, '{sparse_lane}', {order[sparse_lane]} FROM sparse WHERE rank <= {most}),
fused AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(lane, o * 1000 + rank) AS lane, min(o * 1000 + rank) AS first FROM lanes GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item_id) AS rank FROM fused)"""


def _fits(patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in patterns) + ")"


#: The rules' patterns, matched by the other engine over the same texts.
_ASKED = """asked AS (SELECT conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents),
linked AS (SELECT id, text, regexp_matches(text, '[a-z]{12}') AS linked FROM asked WHERE text IS NOT NULL)"""
_KIND = "CASE " + " ".join(f"WHEN {_fits(ps)} THEN '{kind}'" for kind, ps in v.QUERY_RULES) + " END"
_CLASS = f"""{_ASKED}, kinds AS (SELECT *, {_KIND} AS k FROM linked),
class AS (SELECT id, text, linked, coalesce(k, CASE WHEN linked THEN 'CLINICAL_DECISION' ELSE 'PATIENT_FAQ' END) AS query_type, k IS NOT NULL OR linked AS has_signal FROM kinds)"""
_PLAN = """query_type IN ('DRUG_INTERACTION', 'CLINICAL_DECISION', 'LITERATURE_MULTIHOP') OR linked AS use_graph, true AS use_vector, query_type = 'CROSS_CORPUS' AS use_community,
 CAST(greatest(CASE WHEN linked THEN 1 ELSE 0 END, CASE query_type WHEN 'DRUG_INTERACTION' THEN 1 WHEN 'CLINICAL_DECISION' THEN 2 WHEN 'LITERATURE_MULTIHOP' THEN 2 ELSE 0 END) AS INTEGER) AS graph_hops,
 CAST(CASE query_type WHEN 'CROSS_CORPUS' THEN 20 WHEN 'CLINICAL_DECISION' THEN 40 WHEN 'LITERATURE_MULTIHOP' THEN 40 ELSE 25 END AS INTEGER) AS vector_limit,
 CAST(CASE query_type WHEN 'CROSS_CORPUS' THEN 8 ELSE 0 END AS INTEGER) AS community_limit, NOT has_signal AS is_chitchat"""
_COMMUNITY = r"""cq AS (SELECT doc_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS a FROM documents WHERE doc_id % 50 = 0),
 cc AS (SELECT item_id AS community_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS b FROM (SELECT * FROM benchmark ORDER BY length(text) DESC, item_id LIMIT 500)),
 cs AS (SELECT query_id, community_id, len(list_intersect(a, b)) AS n, len(a) AS la, len(b) AS lb FROM cq, cc),
 community AS (SELECT query_id, community_id, round(n / (la + lb - n), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(n / (la + lb - n), 9) DESC, community_id) AS rank FROM cs WHERE n > 0 QUALIFY rank <= 5)"""
_LANES = rf"""{_SPARSE}, {_COMMUNITY}, hits AS (SELECT query_id, item_id, score, text, source FROM sparse JOIN documents ON item_id = doc_id WHERE rank <= 10),
lanes AS (SELECT query_id, 'graph' AS lane, item_id::VARCHAR AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, score, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM hits
 UNION ALL SELECT query_id, 'vector', item_id::VARCHAR, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id), score, md5(CASE WHEN item_id % 2 = 0 THEN source ELSE text END) FROM hits
 UNION ALL SELECT query_id, 'community', community_id::VARCHAR, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community_id), score, md5(text) FROM community JOIN benchmark ON item_id = community_id)"""
#: The same with all communities instead of the 500 largest.
_ALL_LANES = _LANES.replace(" (SELECT * FROM benchmark ORDER BY length(text) DESC, item_id LIMIT 500)", " benchmark")

SQL = {
    "embedded_search": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \n\t\r\f\v]+')) AS w FROM documents), c AS (SELECT doc_id, md5(w) AS h, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
 v AS (SELECT doc_id, substr(h, 1, 2) AS b, sum(CASE WHEN substr(h, 3, 1) < '8' THEN n ELSE -n END)::DOUBLE AS x FROM c GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1),
 u AS (SELECT doc_id, b, x / l AS x FROM v JOIN l USING (doc_id) WHERE l > 0), every AS (SELECT DISTINCT doc_id FROM u),
 s AS (SELECT q.doc_id AS query_id, i.doc_id AS item_id FROM every q JOIN every i ON q.doc_id % 50 = 0 AND q.doc_id <> i.doc_id),
 d AS (SELECT q.doc_id AS query_id, i.doc_id AS item_id, sum(q.x * i.x) AS dot FROM u q JOIN u i ON q.b = i.b WHERE q.doc_id % 50 = 0 AND q.doc_id <> i.doc_id GROUP BY ALL)
SELECT query_id, item_id, round(coalesce(dot, 0), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0), 9) DESC, item_id) AS rank FROM s LEFT JOIN d USING (query_id, item_id) QUALIFY rank <= 10""",
    "community_summaries": """SELECT s_nationkey AS community_id, CASE WHEN count(*) > 1 THEN arg_min(s_name, s_suppkey) || ' and ' || (count(*) - 1) || ' more' ELSE 'Community of 1 concepts: ' || min(s_name) || '.' END AS summary FROM supplier GROUP BY 1""",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, item_id, round(score, 5) AS score, rank FROM dense WHERE rank <= 10",
    "sparse_topk": f"WITH {_SPARSE} SELECT query_id, item_id, score, rank FROM sparse WHERE rank <= 10",
    "rrf_fusion": f"WITH {_DENSE}, {_SPARSE}, {_fused('vector', 'graph', 10)} SELECT query_id, item_id, round(score, 6) AS score, lane, rank FROM placed",
    "fused_topn": f"WITH {_DENSE}, {_SPARSE}, {_fused('vector', 'graph', 20)} SELECT query_id, item_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 25",
    "hybrid_rrf": f"WITH {_DENSE}, {_SPARSE}, {_fused('dense', 'sparse', 30)} SELECT query_id, item_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 10",
    "multilingual_search": f"""WITH {_DENSE}, lanes AS (SELECT query_id, item_id, score FROM dense WHERE rank <= 12
 UNION ALL SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS r FROM dense_all WHERE label IN (0, 1, 2)) WHERE r <= 12),
 u AS (SELECT query_id, item_id, max(score) AS score FROM lanes GROUP BY 1, 2)
SELECT query_id, item_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM u QUALIFY rank <= 25""",
    "community_jaccard": f"WITH {_COMMUNITY} SELECT * FROM community",
    "community_cosine": f"""WITH largest AS (SELECT * FROM embeddings ORDER BY label DESC, vec_id LIMIT 200),
 d AS (SELECT q.vec_id AS query_id, e.vec_id AS community_id,
  round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score FROM embeddings q JOIN largest e ON q.vec_id % 200 = 0
  UNION ALL SELECT q.vec_id, e.vec_id, round(CASE WHEN q.label = e.label THEN 2 ELSE 1 END / (CASE WHEN q.label = e.label THEN 3 ELSE 4 END), 9) FROM embeddings q JOIN largest e ON q.vec_id % 200 = 100)
SELECT query_id, community_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community_id) AS rank FROM d QUALIFY rank <= 5""",
    "similarity_edges": """WITH d AS (SELECT q.vec_id AS q, e.vec_id AS i,
  round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
 t AS (SELECT * FROM d WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, i) <= 10) SELECT DISTINCT least(q, i) AS a, greatest(q, i) AS b, round(score, 5) AS score FROM t""",
    "parse_tier_language": """WITH r AS (SELECT conv_id || '-' || turn AS id, [' small ', 'Medium', 'LARGE ', 'huge'][length(text) % 4 + 1] AS tier, role AS said FROM conversations
 UNION ALL SELECT 'd' || doc_id, [' small ', 'Medium', 'LARGE ', 'huge'][length(text) % 4 + 1], ' ' || upper(lang) FROM documents)
SELECT id, CASE WHEN upper(trim(tier)) IN ('SMALL', 'MEDIUM', 'LARGE') THEN upper(trim(tier)) ELSE 'LARGE' END AS tier, CASE WHEN lower(trim(said)) IN ('en', 'zh', 'de') THEN lower(trim(said)) END AS language FROM r""",
    "moderation_verdict": """WITH s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Unsafe' || chr(10) || 's6' || CASE WHEN doc_id % 2 = 0 THEN ', S1' ELSE '' END WHEN quality = 0 THEN 'unsafe' ELSE 'safe' || chr(10) || 'S1' END AS said FROM labels),
 x AS (SELECT doc_id, lower(split_part(said, chr(10), 1)) AS first, list_transform(string_split(upper(coalesce(nullif(split_part(said, chr(10), 2), ''), 'unknown')), ','), lambda c: trim(c)) AS found FROM s)
SELECT doc_id, NOT contains(first, 'unsafe') AS safe, CASE WHEN contains(first, 'unsafe') THEN array_to_string(found, '|') ELSE '' END AS categories,
 starts_with(first, 'safe') OR NOT contains(first, 'unsafe') OR (list_contains(found, 'S6') AND NOT list_has_any(found, ['S1', 'S2', 'S3', 'S4', 'S5', 'S7', 'S8', 'S9', 'S10', 'S11', 'S12', 'S13', 'S14'])) AS allowed FROM x""",
    "coerce_citations": "SELECT conv_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS numbers FROM conversations GROUP BY 1",
    "stitch_citations": """SELECT conv_id, turn, md5(CASE WHEN turn % 5 = 0 THEN 'No answer could be given.' WHEN contains(text || ' [1]', '[' || (turn + 1) || ']') THEN text || ' [1]' ELSE text || ' [1] [' || (turn + 1) || ']' END) AS digest FROM conversations""",
    "node_label": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_name ELSE '?' END AS label FROM part""",
    "merge_sparse_terms": "SELECT l_orderkey AS id, l_partkey::VARCHAR AS term, max(round(l_discount - 0.02, 4)) AS w FROM lineitem WHERE round(l_discount - 0.02, 4) > 0 GROUP BY 1, 2",
    "lane_adapters": f"WITH {_LANES} SELECT * FROM lanes",
    "routed_lanes": f"""WITH {_ALL_LANES}, linked AS (SELECT doc_id AS query_id, text, regexp_matches(text, '[a-z]{{12}}') AS linked FROM documents WHERE doc_id % 50 = 0), kinds AS (SELECT *, {_KIND} AS k FROM linked),
 class AS (SELECT query_id, linked, coalesce(k, CASE WHEN linked THEN 'CLINICAL_DECISION' ELSE 'PATIENT_FAQ' END) AS query_type, k IS NOT NULL OR linked AS has_signal FROM kinds), p AS (SELECT query_id, {_PLAN} FROM class)
SELECT query_id, lane, item_id, rank FROM lanes JOIN p USING (query_id) WHERE CASE lane WHEN 'graph' THEN use_graph AND rank <= 15 * graph_hops WHEN 'vector' THEN rank <= vector_limit ELSE use_community AND rank <= community_limit END""",
    "retrieval_paths": f"WITH {_ALL_LANES} SELECT query_id, string_agg(DISTINCT lane, '|' ORDER BY lane) AS lanes FROM lanes GROUP BY 1",
    "rerank_select": f"""WITH {_DENSE}, s AS (SELECT query_id, item_id, rank, round(score, 5) - CASE WHEN query_id % 3 = 0 THEN 0.9 ELSE 0 END AS score FROM dense WHERE rank <= 15),
 w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place, count(*) FILTER (WHERE score >= 0.25) OVER (PARTITION BY query_id) AS good, max(score) OVER (PARTITION BY query_id) AS top FROM s)
SELECT query_id, item_id, place AS rank, good = 0 AND top < 0.05 AS no_evidence FROM w WHERE CASE WHEN good > 0 THEN score >= 0.25 AND place <= 10 ELSE place <= 2 END""",
    "classify_query": f"WITH {_CLASS} SELECT id, query_type, has_signal FROM class",
    "plan_query": f"WITH {_CLASS} SELECT id, {_PLAN} FROM class",
    "complexity_tier": f"""WITH {_CLASS}, n AS (SELECT *, length(text) % 4 AS e, length(text) % 3 + 1 AS d FROM class) SELECT id, CASE WHEN e > 0 THEN CASE WHEN e + d <= 3 THEN 'SMALL' WHEN e + d = 4 THEN 'MEDIUM' ELSE 'LARGE' END
 WHEN query_type = 'PATIENT_FAQ' THEN 'SMALL' WHEN query_type = 'DRUG_INTERACTION' THEN 'MEDIUM' ELSE 'LARGE' END AS tier FROM n""",
    "numbered_context": f"""WITH {_SPARSE} SELECT query_id, md5(string_agg('[' || rank || '] ' || substr(text, 1, 3000) || '  (' || source || ' › ' || lang || ')', chr(10) || chr(10) ORDER BY rank)) AS digest
 FROM sparse JOIN documents ON item_id = doc_id WHERE rank <= 10 GROUP BY 1""",
    "citations": f"""WITH {_SPARSE}, top AS (SELECT * FROM sparse WHERE rank <= 10), n AS (SELECT DISTINCT query_id, unnest([3, 2, 1, query_id % 15]) AS number, unnest([0, 1, 2, 3]) AS p FROM top),
 f AS (SELECT query_id, number, min(p) AS p FROM n GROUP BY 1, 2)
SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY p) - 1 AS position, number::BIGINT AS number, item_id, item_id IS NOT NULL AS resolved FROM f LEFT JOIN top ON top.query_id = f.query_id AND top.rank = number""",
}
