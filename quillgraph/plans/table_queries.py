"""Upsert and upkeep queries: orders, lineitem and documents as the stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.scratch import shared_dir
from ..operators import graph as g
from ..operators import linking as l
from ..operators import memory as m
from ..operators import quality as q
from ..operators import retrieval as r
from ..sources import tables


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), "o_totalprice", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("parent_text"))


def upsert_chunks(spark, sf):
    """Orders as chunks, those of 1996 and later again with a higher price; only customers in debt are known documents."""
    o = _orders(spark, sf)
    new = o.where("y >= 1996").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    chunks, edges = tables.upsert_chunks(o, new, table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("doc_id")))
    return chunks.join(edges.withColumn("edge", F.lit(True)), ["chunk_id", "doc_id"], "left").select("chunk_id", "doc_id", F.round("o_totalprice", 2).alias("price"), F.coalesce("edge", F.lit(False)).alias("edge"), F.lit("parent_text" in chunks.columns).alias("has_parent"))


def _mentions(spark, sf):
    line = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_suppkey") % 7 == 0, "Unknown").otherwise(F.concat(F.lit("T"), F.col("l_partkey") % 3))
    return line.select(
        F.col("l_partkey").cast("string").alias("cui"), kind.alias("entity_type"), F.col("l_shipmode" if "l_shipmode" in line.columns else "l_returnflag").alias("label"), F.round("l_discount", 2).alias("confidence"),
        F.col("l_orderkey").alias("chunk_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("start"), (F.col("l_linenumber") + 5).alias("end"), F.concat(F.lit("m"), "l_linenumber").alias("mention_text"),
    )


def upsert_entities(spark, sf):
    old = spark.createDataFrame([], "entity_type string, cui string, label string, confidence double")
    entities, _ = tables.upsert_entities(old, _mentions(spark, sf))
    return entities.select("entity_type", "cui", "confidence")


def mention_edges(spark, sf):
    old = spark.createDataFrame([], "entity_type string, cui string, label string, confidence double")
    _, edges = tables.upsert_entities(old, _mentions(spark, sf))
    return edges.select("entity_type", "cui", "chunk_id", "mention_text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def upsert_communities(spark, sf):
    """Nations as communities of suppliers; the second version of some has other members, the first ones stay."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("community_id"), F.col("s_suppkey").cast("string").alias("cui"), "s_acctbal")
    old = s.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    members = s.select("community_id", "cui")
    new = s.where("s_acctbal > 0").groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.concat(F.lit("x"), "cui"))).alias("members"))
    tabled, kept = tables.upsert_communities(old, members, new)
    return tabled.select("community_id", "size").join(kept.groupBy("community_id").agg(F.count(F.lit(1)).alias("members")), "community_id")


def upsert_vectors(spark, sf):
    """Embeddings, half of them again with another label and some of these without a vector."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), "label")
    new = e.where("chunk_id % 2 = 0").select("chunk_id", F.when(F.col("chunk_id") % 6 > 0, F.col("dense")).alias("dense"), (F.col("label") + 100).alias("label"))
    kept, skipped = tables.upsert_vectors(e, new)
    counts = kept.select(F.col("chunk_id").cast("string").alias("what"), F.col("label").cast("long").alias("n"))
    return counts.unionByName(skipped.select(F.lit("skipped").alias("what"), F.col("skipped").alias("n")))


def patch_payload(spark, sf):
    """Pages' addresses as payload; every third one is patched, some of these with nothing."""
    p = table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("chars"))
    patch = p.where("page_id % 3 = 0").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("new-"), "url")).alias("url"))
    return tables.patch_payload(p, patch, "page_id").withColumn("chars", F.col("chars").cast("long"))


def delete_by_doc(spark, sf):
    """Line items of orders that are not urgent."""
    gone = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.delete_by(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


def purge_junk(spark, sf):
    """Lines of documents that are no junk, with their words as edges."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(t.paragraphs(F.col("text"), r"\n+")).alias("pos", "text"))
    chunks = rows.select(F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), "text")
    edges = chunks.select("chunk_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    kept, left = tables.purge_junk(chunks, edges, t.is_junk(F.col("text"), F.lit("en")))
    return kept.select("chunk_id").join(left.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("edges")), "chunk_id")


def snapshot(spark, sf):
    """A stage that was saved comes back; one that was not is none."""
    folder = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    tables.snapshot(table(spark, sf, "nation"), folder, "chunks")
    found, none = tables.recover(spark, folder, "chunks"), tables.recover(spark, folder, "linked")
    return found.select("n_nationkey", "n_name", F.lit(none is None).alias("other_is_absent"))


def pipeline_summary(spark, sf):
    return tables.pipeline_summary({"parsed": table(spark, sf, "documents"), "chunks": table(spark, sf, "orders"), "entities": table(spark, sf, "part"), "linked": table(spark, sf, "lineitem").where("l_discount > 0.05"), "frontier": table(spark, sf, "nation").where("false")})


def intake_summary(spark, sf):
    """Linked and all mentions of each type."""
    rows = _mentions(spark, sf).withColumn("linked", F.col("confidence") >= 0.05)
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("linked").alias("linked"), F.count_distinct("cui").alias("entities"))


def latest_status(spark, sf):
    """Each user's last event as the status of a domain."""
    e = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("status"))
    got = tables.latest_status(e.select(F.col("user_id").alias("domain"), F.col("ts").alias("updated_at"), "event_id", "status"))
    return got.select("domain", "event_id", "status")


def append_dedup(spark, sf):
    """Customers' orders as test questions, later years appended."""
    o = _orders(spark, sf).select(F.col("doc_id").alias("question"), F.col("chunk_id").alias("pos"), "y")
    kept, removed = tables.append_dedup(o.where("y < 1996"), o.where("y >= 1996").withColumn("extra", F.lit("x")), "question")
    return kept.select(F.col("question").cast("string").alias("question"), "pos", "extra").unionByName(removed.select(F.lit("removed").alias("question"), F.col("removed").alias("pos"), F.lit(None).cast("string").alias("extra")))


def write_if_absent(spark, sf):
    """Customers over suppliers by number: absent ones are added, with overwriting all are taken."""
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    a = tables.write_if_absent(new, old, "id").withColumn("overwrite", F.lit(False))
    return a.unionByName(tables.write_if_absent(new, old, "id", overwrite=True).withColumn("overwrite", F.lit(True)))


# entities, communities, linking


def with_communities(spark, sf):
    members = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("community_id"), F.col("s_suppkey").alias("cui"))
    asked = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cui")).distinct().unionByName(table(spark, sf, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("cui")))
    return g.with_communities(asked, members).select("cui", F.array_join("communities", "|").alias("communities"))


def _gold(spark, sf):
    """Parts of an order as gold entities, their first words as text; every third one is predicted under a longer text."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    first = F.substring_index("p_name", " ", 1)
    gold = rows.select(F.col("l_orderkey").alias("sample"), "l_linenumber", first.alias("text"), F.concat(F.lit("T"), F.col("p_size") % 2).alias("entity_type"), F.col("p_partkey").cast("string").alias("cui"))
    predicted = gold.where("l_linenumber % 3 <> 0").withColumn("text", F.concat(F.lit("so "), "text"))
    return gold, predicted


def gold_found(spark, sf):
    gold, predicted = _gold(spark, sf)
    return l.gold_found(gold.select("sample", "cui", "l_linenumber"), predicted.select("sample", "cui"))


def overlap_match(spark, sf):
    """All gold entities and predictions of each order."""
    gold, predicted = _gold(spark, sf)
    return l.overlap_match(gold.select("sample", "text", "entity_type"), predicted.select("sample", "text", "entity_type"))


def semantic_search(spark, sf):
    """Embeddings as concepts, their labels as types; every hundredth asks for the type after its own."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), F.col("label").alias("entity_type"))
    asked = e.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "v", F.when(F.col("item_id") % 300 > 0, (F.col("entity_type") + 1) % 10).alias("entity_type"))
    return r.semantic_concept_search(e, asked, 5, 200).select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


def answer_concepts(spark, sf):
    line = table(spark, sf, "lineitem")
    return r.answer_concepts(line.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("cui")), line.select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("cui")))


def intersections(spark, sf):
    """Words that each conversation's users and assistants share."""
    w = table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    return g.intersections(w.where("role = 'user'"), w.where("role = 'assistant'"), "conv_id", "w")


def distinct_labels(spark, sf):
    w = table(spark, sf, "conversations").where("text is not null").select("conv_id", F.explode(F.split("text", " ")).alias("label"), "turn")
    first = w.groupBy("conv_id", "label").agg(F.min("turn").alias("turn"))
    ranked = first.select("conv_id", "label", F.concat_ws("-", F.lpad(F.col("turn").cast("string"), 6, "0"), "label").alias("pos"))
    return r.distinct_labels(ranked, "conv_id").select("conv_id", F.size("labels").cast("long").alias("n"), F.md5(F.array_join("labels", "|")).alias("digest"))


def graph_counts(spark, sf):
    line, e = table(spark, sf, "lineitem"), table(spark, sf, "events")
    return g.graph_counts(
        {"Chunk": table(spark, sf, "orders"), "Entity": table(spark, sf, "part"), "Document": table(spark, sf, "customer"), "Session": table(spark, sf, "conversations").select("conv_id").distinct(), "None": e.where("false")},
        {"MENTIONED_IN": line, "FROM_DOC": table(spark, sf, "orders").where("o_custkey is not null"), "INTERESTED_IN": e.where("user_id is not null")},
    )


def _communities(spark, sf):
    """Nations as communities of their suppliers, linked where they sell the same part."""
    member = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("community_id"), F.col("s_suppkey").alias("node"))
    edges = g.mention_edges(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")
    return g.cooccurrence(edges), member


def inner_links(spark, sf):
    return g.inner_links(*_communities(spark, sf))


def community_lines(spark, sf):
    return g.community_lines(*_communities(spark, sf)).select("community_id", F.md5("lines").alias("digest"))


def concept_lines(spark, sf):
    _, member = _communities(spark, sf)
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label"), F.when(F.col("s_acctbal") > 0, "Drug").otherwise("Disease").alias("entity_type"))
    return g.concept_lines(names, member).select("community_id", F.md5("lines").alias("digest"))


def auto_summary(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return s.select("s_nationkey", g.auto_summary(F.transform("x", lambda x: x["s_name"]), F.col("n")).alias("summary"))


# users, memories, metrics


def _memories(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    mentions = e.select("user_id", F.col("event_id").alias("qa_id"), k.alias("cui"), F.col("value").alias("weight"), F.col("ts").alias("last_accessed"))
    return e, mentions


def memory_write(spark, sf):
    """Purchases come in as new memories over all other events."""
    e, mentions = _memories(spark, sf)
    bought = e.where("event_type = 'purchase'").select("event_id")
    old = mentions.join(bought, mentions["qa_id"] == bought["event_id"], "left_anti")
    memories = e.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("qa_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    k = F.get_json_object("props", "$.k").cast("int") % 5
    new = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("qa_id"), F.lit("q").alias("question"), F.lit("new").alias("answer"), F.array(k).alias("cuis"), "ts")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    _, kept = m.memory_write(old, memories, new, now, cap=5)
    return kept.select("user_id", "qa_id", "answer")


def memory_reinforce(spark, sf):
    """Every memory is used as often as the number of its event's hour says, up to three times."""
    e, mentions = _memories(spark, sf)
    used = mentions.withColumn("n", F.explode(F.sequence(F.lit(1), F.hour("last_accessed") % 4))).where("hour(last_accessed) % 4 > 0").select("user_id", "qa_id", "cui", (F.col("last_accessed") + F.expr("make_dt_interval(n)")).alias("ts"))
    return m.memory_reinforce(mentions, used).select("user_id", "qa_id", "cui", F.round("weight", 6).alias("weight"), F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("last"))


def memory_context(spark, sf):
    """Each conversation's exchanges as memories, a day apart."""
    c = table(spark, sf, "conversations")
    rows = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])
    got = r.memory_context(rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), (F.col("turn") * 9).cast("int").alias("days"), "question", "answer"))
    return got.select("query_id", F.md5("context").alias("digest"))


def token_usage(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("user_id").alias("prompt_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("completion_tokens"))
    return m.token_usage(e, ["event_type"])


def top1_accuracy(spark, sf):
    """Documents' languages told from their texts; those without a label are skipped."""
    rows = table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 10 > 0, F.col("lang")).alias("expected"), F.when(F.length("text") > 200, t.detect_query_language(F.col("text"))).alias("predicted"))
    return q.top1_accuracy(rows, ["source"]).withColumn("accuracy", F.round("accuracy", 6))


def quota_by_label(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 100, F.col("lang")).alias("lang"))
    return q.quota_by_label(rows, "lang", ["doc_id"], 25)


def long_enough(spark, sf):
    return q.long_enough(table(spark, sf, "documents"), "text", ["doc_id"], 40).select("doc_id", F.length("text").cast("long").alias("chars"))


def testset(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'").select(F.col("text").alias("user_input"), F.col("conv_id").alias("reference"))
    got = q.testset(c, {"user_input": "question", "reference": "ground_truth"}, ["question", "ground_truth", "category"])
    return got.select(F.md5("question").alias("question"), "ground_truth", "category")


def shortfall(spark, sf):
    rows, wanted = table(spark, sf, "documents"), table(spark, sf, "documents").groupBy("lang").agg((F.count(F.lit(1)) * 2).alias("wanted"))
    return q.shortfall(rows.where("length(text) > 200"), "lang", wanted)


QUERIES = {
    "upsert_chunks": upsert_chunks,
    "upsert_entities": upsert_entities,
    "upsert_mention_edges": mention_edges,
    "upsert_communities": upsert_communities,
    "upsert_chunk_vectors": upsert_vectors,
    "patch_payload": patch_payload,
    "delete_by_doc": delete_by_doc,
    "purge_junk_chunks": purge_junk,
    "stage_snapshot": snapshot,
    "pipeline_summary": pipeline_summary,
    "intake_summary": intake_summary,
    "latest_status": latest_status,
    "append_dedup": append_dedup,
    "write_if_absent": write_if_absent,
    "with_communities": with_communities,
    "gold_found": gold_found,
    "overlap_match": overlap_match,
    "semantic_concept_search": semantic_search,
    "answer_concepts": answer_concepts,
    "jaccard_sizes": intersections,
    "distinct_labels": distinct_labels,
    "graph_counts": graph_counts,
    "inner_links": inner_links,
    "community_lines": community_lines,
    "concept_lines": concept_lines,
    "auto_summary": auto_summary,
    "memory_write": memory_write,
    "memory_reinforce": memory_reinforce,
    "memory_context": memory_context,
    "token_usage": token_usage,
    "top1_accuracy": top1_accuracy,
    "quota_by_label": quota_by_label,
    "min_length_sample": long_enough,
    "testset_columns": testset,
    "testset_shortfall": shortfall,
}

_M = """m AS (SELECT l_partkey::VARCHAR AS cui, CASE WHEN l_suppkey % 7 = 0 THEN 'Unknown' ELSE 'T' || (l_partkey % 3) END AS entity_type, round(l_discount, 2) AS confidence, l_orderkey AS chunk_id,
 CASE WHEN l_linenumber > 1 THEN l_linenumber ELSE -1 END AS start, l_linenumber + 5 AS "end", 'm' || l_linenumber AS mention_text FROM lineitem)"""
_GOLD = """gold AS (SELECT l_orderkey AS sample, l_linenumber AS n, split_part(p_name, ' ', 1) AS text, 'T' || (p_size % 2) AS entity_type, p_partkey::VARCHAR AS cui FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_CO = """e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS c FROM lineitem),
co AS (SELECT x.s AS a, y.s AS b, count(*) AS weight FROM e x JOIN e y USING (c) WHERE x.s < y.s GROUP BY 1, 2),
inside AS (SELECT 'n' || p.s_nationkey AS community_id, a, b, weight FROM co JOIN supplier p ON p.s_suppkey = a JOIN supplier q ON q.s_suppkey = b WHERE p.s_nationkey = q.s_nationkey)"""

SQL = {
    "upsert_chunks": """SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, round(o_totalprice + CASE WHEN year(o_orderdate) >= 1996 THEN 1 ELSE 0 END, 2) AS price,
 o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS edge, false AS has_parent FROM orders""",
    "upsert_entities": f"WITH {_M} SELECT entity_type, cui, confidence FROM m WHERE entity_type <> 'Unknown' QUALIFY row_number() OVER (PARTITION BY entity_type, cui ORDER BY chunk_id DESC, start DESC, confidence DESC) = 1",
    "upsert_mention_edges": f"""WITH {_M} SELECT entity_type, cui, chunk_id, mention_text, start, "end" FROM m WHERE entity_type <> 'Unknown' QUALIFY row_number() OVER (PARTITION BY entity_type, cui, chunk_id ORDER BY start, "end") = 1""",
    "upsert_communities": """WITH a AS (SELECT s_nationkey AS k, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS p FROM supplier GROUP BY 1) SELECT k::VARCHAR AS community_id, CASE WHEN p > 0 THEN p ELSE n END AS size, n + p AS members FROM a""",
    "upsert_chunk_vectors": """SELECT vec_id::VARCHAR AS what, label + CASE WHEN vec_id % 2 = 0 AND vec_id % 6 > 0 THEN 100 ELSE 0 END AS n FROM embeddings UNION ALL SELECT 'skipped', count(*) FROM embeddings WHERE vec_id % 6 = 0""",
    "patch_payload": "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'new-' || url ELSE url END AS url, length(html) AS chars FROM pages",
    "delete_by_doc": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "purge_junk_chunks": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
 c AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS line FROM p)
SELECT doc_id || '-' || pos AS chunk_id, len(list_distinct(string_split(line, ' '))) AS edges FROM c WHERE length(regexp_replace(line, '[^\p{L}\p{N}_]|\s|[0-9]', '', 'g')) >= 20""",
    "stage_snapshot": "SELECT n_nationkey, n_name, true AS other_is_absent FROM nation",
    "pipeline_summary": """SELECT 'parsed' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM orders UNION ALL SELECT 'entities', count(*) FROM part
 UNION ALL SELECT 'linked', count(*) FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'frontier', 0""",
    "intake_summary": f"WITH {_M} SELECT entity_type, count(*) AS mentions, count(*) FILTER (WHERE confidence >= 0.05) AS linked, count(DISTINCT cui) AS entities FROM m GROUP BY 1",
    "latest_status": "SELECT user_id AS domain, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "append_dedup": """WITH o AS (SELECT o_custkey AS q, o_orderkey AS pos, year(o_orderdate) >= 1996 AS late FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY late DESC, pos DESC) AS n FROM o)
SELECT q::VARCHAR AS question, pos, CASE WHEN late THEN 'x' END AS extra FROM r WHERE n = 1 UNION ALL SELECT 'removed', count(*), NULL FROM r WHERE n > 1""",
    "write_if_absent": """SELECT s_suppkey AS id, s_name AS name, false AS overwrite FROM supplier UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT c_custkey, c_name, true FROM customer UNION ALL SELECT s_suppkey, s_name, true FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""",
    "with_communities": """WITH a AS (SELECT DISTINCT l_suppkey AS cui FROM lineitem UNION ALL SELECT -n_nationkey - 1 FROM nation) SELECT cui, coalesce('n' || s_nationkey, '') AS communities FROM a LEFT JOIN supplier ON s_suppkey = cui""",
    "gold_found": f"WITH {_GOLD} SELECT sample, cui, n AS l_linenumber, EXISTS (SELECT 1 FROM gold p WHERE p.n % 3 <> 0 AND p.sample = gold.sample AND p.cui = gold.cui) AS found FROM gold",
    "overlap_match": f"""WITH RECURSIVE {_GOLD}, g AS (SELECT sample, list({{'t': text, 'k': entity_type}} ORDER BY text, entity_type) AS free FROM gold GROUP BY 1),
 p AS (SELECT sample, 'so ' || text AS text, entity_type AS k, row_number() OVER (PARTITION BY sample ORDER BY 'so ' || text, entity_type) AS i FROM gold WHERE n % 3 <> 0),
 walk AS (SELECT sample, 0 AS i, free, '' AS text, '' AS k, false AS hit FROM g
  UNION ALL SELECT sample, i, CASE WHEN at_ > 0 THEN list_concat(free[:at_ - 1], free[at_ + 1:]) ELSE free END, text, k, at_ > 0 FROM (
   SELECT w.sample, p.i, w.free, p.text, p.k, coalesce(list_position(list_transform(w.free, lambda x: x.k = p.k AND (contains(lower(replace(p.text, ' ', '')), lower(replace(x.t, ' ', ''))) OR contains(lower(replace(x.t, ' ', '')), lower(replace(p.text, ' ', ''))))), true), 0) AS at_
   FROM walk w JOIN p ON p.sample = w.sample AND p.i = w.i + 1)),
 rest AS (SELECT sample, unnest(free) AS x FROM walk QUALIFY row_number() OVER (PARTITION BY sample ORDER BY i DESC) = 1)
SELECT sample, text, k AS entity_type, hit AS gold, true AS predicted FROM walk WHERE i > 0 UNION ALL SELECT sample, x.t, x.k, true, false FROM rest""",
    "semantic_concept_search": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label AS k, CASE WHEN q.vec_id % 300 > 0 THEN (q.label + 1) % 10 END AS want,
  round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
 p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 200)
SELECT query_id, item_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p WHERE want IS NULL OR k = want QUALIFY rank <= 5""",
    "answer_concepts": "SELECT l_orderkey AS query_id, l_partkey AS cui FROM lineitem UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber > 1",
    "jaccard_sizes": r"""WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations WHERE role IN ('user', 'assistant')),
 c AS (SELECT conv_id, w, count(*) AS n FROM w GROUP BY 1, 2) SELECT conv_id, count(*) FILTER (WHERE n = 2) AS shared, count(*) AS either FROM c GROUP BY 1""",
    "distinct_labels": """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS label FROM conversations), f AS (SELECT conv_id, label, lpad(min(turn)::VARCHAR, 6, '0') || '-' || label AS pos FROM w GROUP BY 1, 2),
 d AS (SELECT conv_id, arg_min(label, pos) AS label, min(pos) AS pos FROM f GROUP BY conv_id, lower(label))
SELECT conv_id, count(*) AS n, md5(string_agg(label, '|' ORDER BY pos)) AS digest FROM d GROUP BY 1""",
    "graph_counts": """SELECT 'node' AS what, 'Chunk' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'node', 'Entity', count(*) FROM part UNION ALL SELECT 'node', 'Document', count(*) FROM customer UNION ALL SELECT 'node', 'Session', count(DISTINCT conv_id) FROM conversations
 UNION ALL SELECT 'node', 'None', 0 UNION ALL SELECT 'edge', 'MENTIONED_IN', count(*) FROM lineitem UNION ALL SELECT 'edge', 'FROM_DOC', count(o_custkey) FROM orders UNION ALL SELECT 'edge', 'INTERESTED_IN', count(user_id) FROM events""",
    "inner_links": f"WITH {_CO} SELECT * FROM inside",
    "community_lines": f"""WITH {_CO}, r AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY weight DESC, a, b) AS n FROM inside QUALIFY n <= 30)
SELECT community_id, md5(string_agg(a || ' <-> ' || b || ' (' || weight || ')', chr(10) ORDER BY n)) AS digest FROM r GROUP BY 1""",
    "concept_lines": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier QUALIFY n <= 30)
SELECT 'n' || s_nationkey AS community_id, md5(string_agg('- ' || s_name || ' (' || CASE WHEN s_acctbal > 0 THEN 'Drug' ELSE 'Disease' END || ')', chr(10) ORDER BY n)) AS digest FROM r GROUP BY 1""",
    "auto_summary": "SELECT s_nationkey, 'Community of ' || count(*) || ' concepts: ' || array_to_string(list_slice(list(s_name ORDER BY s_suppkey), 1, 5), ', ') || '.' AS summary FROM supplier GROUP BY 1",
    "memory_write": """WITH e AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::INT % 5 AS cui, event_type = 'purchase' AS fresh, ts, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE value END AS w FROM events),
 s AS (SELECT *, round(w * exp(-ln(2) / 30.0 * floor((epoch((SELECT date_trunc('second', max(ts)) FROM events)) - epoch(date_trunc('second', ts))) / 86400)), 6) AS s FROM e)
SELECT user_id, event_id AS qa_id, CASE WHEN fresh THEN 'new' ELSE 'a' END AS answer FROM s QUALIFY row_number() OVER (PARTITION BY user_id, cui ORDER BY s DESC, event_id) <= 5""",
    "memory_reinforce": """SELECT user_id, event_id AS qa_id, json_extract_string(props, '$.k')::INT % 5 AS cui, round(value * pow(0.9::DOUBLE, hour(ts) % 4) + 10 * (1 - pow(0.9::DOUBLE, hour(ts) % 4)), 6) AS weight,
 strftime(ts + INTERVAL 1 DAY * (hour(ts) % 4), '%Y-%m-%d %H:%M:%S') AS last FROM events""",
    "memory_context": """WITH x AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a, u.turn * 9 AS d FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
 w AS (SELECT *, '[' || CASE WHEN d < 1 THEN 'today' WHEN d < 30 THEN d || 'd ago' ELSE (d // 30) || 'mo ago' END || '] ' AS l FROM x)
SELECT conv_id AS query_id, md5(chr(10) || chr(10) || '[Relevant past conversation with this user]' || chr(10) || string_agg(l || 'User asked: ' || q || chr(10) || l || 'You answered: ' || a, chr(10) || chr(10) ORDER BY turn)) AS digest FROM w GROUP BY 1""",
    "token_usage": "SELECT event_type, sum(user_id + CASE WHEN event_id % 3 > 0 THEN event_id ELSE 0 END)::BIGINT AS tokens FROM events GROUP BY 1",
    "top1_accuracy": r"""WITH d AS (SELECT source, CASE WHEN doc_id % 10 > 0 THEN lang END AS e, CASE WHEN length(text) > 200 THEN CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN NULL WHEN regexp_matches(text, '[äöüßÄÖÜ]') THEN 'de' ELSE 'en' END END AS p FROM documents)
SELECT source, count(*) FILTER (WHERE e = p) AS "right", count(e) AS judged, count(*) FILTER (WHERE e IS NULL) AS skipped, round(coalesce(count(*) FILTER (WHERE e = p) / nullif(count(e), 0), 0), 6) AS accuracy FROM d GROUP BY 1""",
    "quota_by_label": "SELECT doc_id, lang FROM documents WHERE length(text) > 100 AND lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 25",
    "min_length_sample": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= 200 ORDER BY doc_id LIMIT 40",
    "testset_columns": "SELECT md5(text) AS question, conv_id AS ground_truth, NULL::VARCHAR AS category FROM conversations WHERE role = 'user'",
    "testset_shortfall": "SELECT lang, count(*) FILTER (WHERE length(text) > 200) AS made, count(*) * 2 AS wanted, count(*) * 2 - count(*) FILTER (WHERE length(text) > 200) AS short FROM documents GROUP BY 1",
}
