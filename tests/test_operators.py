from pyspark.sql import functions as F

from quillgraph.operators import community as c
from quillgraph.operators import graph as g
from quillgraph.operators import linking as l
from quillgraph.operators import quality as q
from quillgraph.operators import retrieval as r

CONCEPTS = [
    ("D1", "Aspirin", "Drug", ["acetylsalicylic acid", "ASA"], {"de": "Acetylsalicylsäure", "zh": "阿司匹林"}),
    ("D2", "Diabetes Mellitus", "Disease", ["diabetes"], {"zh": "糖尿病"}),
    ("D3", "Warfarin", "Drug", [], None),
]


def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "cui string, label string, entity_type string, synonyms array<string>, lang_labels map<string,string>")


def test_linking(spark):
    mentions = spark.createDataFrame([("aspirin", "Drug", 0.9), ("warfarine", "Drug", 0.8), ("糖尿病", "Disease", 0.7), ("diabetes", "Drug", 0.5), ("zzz", "Drug", 0.9), ("Acetylsalicylsäure", "Drug", 0.95)], "text string, entity_type string, confidence double")
    got = {x.text: x for x in l.link_mentions(mentions, concepts(spark)).collect()}
    assert {k: v.cui for k, v in got.items()} == {"aspirin": "D1", "warfarine": "D3", "糖尿病": "D2", "diabetes": "D2", "zzz": None, "Acetylsalicylsäure": "D1"}
    assert got["aspirin"].link_confidence == 0.9 and not got["zzz"].linked
    assert l.link_mentions(mentions.limit(0), concepts(spark)).count() == 0


def test_spans(spark):
    text = "acute renal failure and pain"
    spans = [(0, 5, "acute", "Disease", 0.5), (6, 11, "renal", "Disease", 0.9), (8, 9, "n", "Disease", 0.1), (24, 28, "pain", "Symptom", 0.7), (24, 28, "pain", "Disease", 0.2)]
    row = spark.createDataFrame([(text, spans)], f"text string, spans {l.SPAN}")
    merged = row.select(l.merge_adjacent(F.col("spans"), F.col("text")).alias("x")).first().x
    assert [(s.start, s.end, s.entity_type, s.confidence) for s in merged] == [(0, 9, "Disease", 0.9), (24, 28, "Disease", 0.2), (24, 28, "Symptom", 0.7)]
    kept = row.select(l.drop_dominated(F.col("spans")).alias("a"), l.drop_dominated(F.col("spans"), any_type=True).alias("b")).first()
    assert [(s.start, s.entity_type) for s in kept.a] == [(6, "Disease"), (24, "Symptom"), (0, "Disease"), (24, "Disease")]
    assert [(s.start, s.entity_type) for s in kept.b] == [(6, "Disease"), (24, "Symptom"), (0, "Disease")]


def test_overlap_match(spark):
    gold = spark.createDataFrame([(1, "renal failure", "Disease"), (1, "pain", "Symptom"), (2, "x", "Drug")], "sample int, text string, entity_type string")
    said = spark.createDataFrame([(1, "acute renal failure", "Disease"), (1, "renal failure", "Disease"), (1, "pain", "Drug")], "sample int, text string, entity_type string")
    (m,) = q.prf1(l.overlap_match(gold, said).withColumn("k", F.lit(1)), ["k"]).collect()
    assert (m.tp, round(m.precision, 3), round(m.recall, 3)) == (1, 0.333, 0.333)


def test_pagerank_mass_and_order(spark):
    edges = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "9")], "entity string, chunk string")
    ranks = g.personalised_pagerank(edges, spark.createDataFrame([(1, "a"), (1, "a"), (2, "nobody")], "query_id int, entity string"))
    got = {x.node: x.score for x in ranks.collect()}
    assert 0.9 < sum(got.values()) <= 1 + 1e-9 and got["c1"] > got["c2"] and "ed" not in got and "c9" not in got


def test_communities_and_paths(spark):
    links = spark.createDataFrame([(a, b, 1) for block in (0, 10) for a in range(block, block + 4) for b in range(a + 1, block + 4)] + [(3, 10, 1)], "a int, b int, weight int")
    labels = c.label_moves(links)
    groups = {}
    for x in labels.collect():
        groups.setdefault(x.label, set()).add(x.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [10, 11, 12, 13]]
    assert c.modularity(links, labels).first()[0] > 0.3
    found = c.communities(g.connected_components(links.where("a <> 3 or b <> 10")), 3)
    assert sorted(x.size for x in found.collect()) == [4, 4] and all(x.community_id.startswith("comm_") for x in found.collect())
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    assert {x.component for x in g.connected_components(chain).collect()} == {0}
    edges = spark.createDataFrame([(i, c) for i in range(6) for c in (i, i + 1)], "entity int, chunk int")
    pairs = spark.createDataFrame([(0, 3), (0, 4), (2, 2), (0, 99)], "a int, b int")
    assert {(x.a, x.b): x.connected for x in g.paths(edges, pairs, 3).collect()} == {(0, 3): True, (0, 4): False, (2, 2): True, (0, 99): False}


def test_fusion_is_free_of_lane_order(spark):
    rows = [(1, "graph", "x", 1), (1, "vector", "y", 1), (1, "vector", "x", 2), (1, "graph", "z", 2)]
    frame = lambda x: spark.createDataFrame(x, "query_id int, lane string, item_id string, rank int")
    got = [[tuple(x) for x in r.rrf(frame(x), 60, ["graph", "vector"]).orderBy("rank").select("item_id", "rank", "lane").collect()] for x in (rows, rows[::-1])]
    assert got[0] == got[1] == [("x", 1, "graph"), ("y", 2, "vector"), ("z", 3, "graph")]


def test_rerank(spark):
    rows = [(1, "a", 1, 0.9), (1, "b", 2, 0.1), (1, "c", 3, 0.3), (2, "d", 1, 0.02), (2, "e", 2, 0.04), (2, "f", 3, 0.01), (3, "g", 2, None), (3, "h", 1, None)]
    got = r.rerank_select(spark.createDataFrame(rows, "query_id int, item_id string, rank int, score double"), 2).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.item_id, x.no_evidence) for x in got] == [(1, "a", False), (1, "c", False), (2, "e", True), (2, "d", True), (3, "h", False), (3, "g", False)]


def test_routing_and_answers(spark):
    text = lambda s, **k: spark.range(1).select(r.classify_query(F.lit(s), F.lit(k.get("e", False)), k.get("own", ()), k.get("b", True)).alias("c")).first().c
    assert tuple(text("What is aspirin?")) == ("PATIENT_FAQ", True) and tuple(text("hi")) == ("PATIENT_FAQ", False) and text("hi", e=True).query_type == "CLINICAL_DECISION"
    assert tuple(text("what is Quill?", own=("quill",))) == ("PATIENT_FAQ", False)
    assert text("糖尿病的诊断标准").query_type == "PATIENT_FAQ" and text("糖尿病的诊断标准", b=False).query_type == "CLINICAL_DECISION"
    answer = spark.range(1).select(r.stitch_citations(F.lit("Yes [1]."), F.array(F.lit(1), F.lit(2))).alias("a"), r.stitch_citations(F.lit(" "), F.array(F.lit(1))).alias("b")).first()
    assert answer.a == "Yes [1]. [2]" and answer.b == "No answer could be given."


def test_memory_writes(spark):
    from quillgraph.operators import memory as m

    at = lambda d: f"timestamp '2024-01-{d:02d}'"
    mentions = spark.sql(f"select * from values (1, 10, 'a', 1.0D, {at(1)}), (1, 11, 'a', 1.0D, {at(2)}) t(user_id, qa_id, cui, weight, last_accessed)")
    memories = spark.sql("select * from values (1, 10, 'q', 'x'), (1, 11, 'q', 'x') t(user_id, qa_id, question, answer)")
    new = spark.sql(f"select 1 user_id, 12 qa_id, 'q' question, 'y' answer, array('a', 'b') cuis, {at(3)} ts")
    kept, left = m.memory_write(mentions, memories, new, F.expr(at(3)), cap=2)
    assert sorted((x.qa_id, x.cui) for x in kept.collect()) == [(11, "a"), (12, "a"), (12, "b")] and sorted(x.qa_id for x in left.collect()) == [11, 12]
    again = m.memory_reinforce(mentions, spark.sql(f"select 1 user_id, 10 qa_id, 'a' cui, {at(5)} ts"))
    assert sorted((x.qa_id, round(x.weight, 6), x.last_accessed.day) for x in again.collect()) == [(10, 1.9, 5), (11, 1.0, 2)]


def test_small_joins_and_lists(spark):
    rows = spark.createDataFrame([(1, 1, 0, "q1", "a1"), (1, 2, 40, "q2", "a2")], "query_id int, rank int, days int, question string, answer string")
    context = r.memory_context(rows).first().context
    assert context.endswith("[today] User asked: q1\n[today] You answered: a1\n\n[1mo ago] User asked: q2\n[1mo ago] You answered: a2")
    labels = spark.createDataFrame([(1, 0, "B"), (1, 1, "a"), (1, 2, "b"), (1, 3, "A")], "q int, pos int, label string")
    assert r.distinct_labels(labels, "q").first().labels == ["B", "a"]
    sets = g.intersections(labels.where("pos < 2"), labels.where("pos > 0"), "q", "label").first()
    assert (sets.shared, sets.either) == (1, 4)
    found = g.with_communities(spark.createDataFrame([("x",), ("y",)], "cui string"), spark.createDataFrame([("c", "x")], "community_id string, cui string"))
    assert {x.cui: x.communities for x in found.collect()} == {"x": ["c"], "y": []}


def test_cooccurrence_of_large_chunks_in_tiles(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(1)
    chunks = {0: range(40), 1: range(20, 33), 2: [5], **{c: rng.sample(range(60), 6) for c in range(3, 20)}}
    edges = spark.createDataFrame([(e, c) for c, es in chunks.items() for e in es], "entity int, chunk int")
    want = {}
    for es in chunks.values():
        for pair in itertools.combinations(sorted(es), 2):
            want[pair] = want.get(pair, 0) + 1
    for tile in (2048, 12, 7):
        monkeypatch.setattr(g, "TILE", tile)
        assert {(x.a, x.b): x.weight for x in g.cooccurrence(edges).collect()} == want
    assert g.cooccurrence(edges.limit(0)).count() == 0
