import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import readers as r
from quillgraph.sources import tables as t


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(folder)


def sections(row):
    return [(s.title, s.content) for s in row.sections]


def test_document_json(spark, tmp_path):
    put(tmp_path, "a/x.json", json.dumps({"doc_id": "d1", "title": "T", "language": "en", "unknown": 3, "sections": [{"title": "S", "content": "c"}]}))
    put(tmp_path, "bad.json", "{not json")
    docs, rejects = r.document_json(spark, str(tmp_path))
    assert [(d.doc_id, sections(d)) for d in docs.collect()] == [("d1", [("S", "c")])]
    assert [x._file.rsplit("/", 1)[1] for x in rejects.collect()] == ["bad.json"]


def test_qa_and_parallel(spark, tmp_path):
    qa = put(tmp_path / "q", "a.jsonl", '{"id": "1", "question": "Q?", "answer": "A.", "related_diseases": ["x", "y"]}\n\n{"question": "R?", "answer": "B."}\n')
    got = {d.title: d for d in r.qa_jsonl(spark, qa).collect()}
    assert sections(got["Q?"]) == [("Question", "Q?"), ("Answer", "A."), ("Related Diseases", "x, y")] and got["Q?"].doc_id == "1"
    assert len(sections(got["R?"])) == 2 and got["R?"].doc_id.startswith("qa_")
    pairs = put(tmp_path / "p", "a.json", json.dumps([{"de": "Hallo", "en": "Hello"}, {"de": "Nur"}]))
    got = {d.title: d for d in r.parallel_json(spark, pairs).collect()}
    assert sections(got["Hallo"]) == [("German", "Hallo"), ("English", "Hello")] and got["Hallo"].doc_id == "germed_d1bf93299de1"
    assert len(sections(got["Nur"])) == 1


def test_xml_sources(spark, tmp_path):
    article = """<Set><PubmedArticle><PMID>7</PMID><ArticleTitle>On <i>it</i></ArticleTitle><Abstract><AbstractText Label="BACKGROUND">One.</AbstractText><AbstractText NlmCategory="BACKGROUND">Two <b>x</b>.</AbstractText><AbstractText>Rest.</AbstractText></Abstract><Language>ger</Language><PubDate><Year>2020</Year></PubDate></PubmedArticle></Set>"""
    (d,) = r.article_xml(spark, put(tmp_path / "a", "a.xml", article))[0].collect()
    assert (d.doc_id, d.language, d.title, d.source.source_version) == ("pmid_7", "de", "On it", "2020")
    assert sections(d) == [("Background", "One.\nTwo x."), ("Abstract", "Rest.")]
    label = '<document xmlns="urn:x"><title>L</title><section><title>Use</title><text>For <b>all</b>.</text><section><title>Inner</title><text>Deep</text></section></section></document>'
    (d,) = r.label_xml(spark, put(tmp_path / "l", "lab.xml", label))[0].collect()
    assert d.doc_id == "lab" and sections(d) == [("Use", "For all. InnerDeep"), ("Inner", "Deep")]
    drug = '<drugbank><drug><drugbank-id>X</drugbank-id><drugbank-id primary="true">DB1</drugbank-id><name>N</name><description>Desc</description><indication> </indication><toxicity>T</toxicity></drug></drugbank>'
    (d,) = r.drug_xml(spark, put(tmp_path / "d", "d.xml", drug)).collect()
    assert d.doc_id == "DB1" and sections(d) == [("Description", "Desc"), ("Toxicity", "T")]


def test_concepts(spark, tmp_path):
    text = "*NEWRECORD\nRECTYPE = D\nMH = Aspirin\nPRINT ENTRY = Acetyl|T109\nENTRY = ASA|x\nENTRY = ASA|y\nMN = D02.455\nUI = D001\n\n*NEWRECORD\nMH = No id\n"
    concepts = r.concept_ascii(spark, put(tmp_path / "c", "c.bin", text))
    assert [tuple(c) for c in concepts.collect()] == [("D001", "Aspirin", ["Acetyl", "ASA"], ["D02.455"])]
    lines = "D001\tde\tAspirin alt\nD001\tde\tAspirin neu\nD001\tzh\t \nD999\tde\tx\nbroken line\nD001\tzh\t阿司匹林\n"
    got = r.concept_translations(spark, put(tmp_path / "t", "t.tsv", lines), concepts).collect()
    assert [(x.cui, x.lang_labels) for x in got] == [("D001", {"de": "Aspirin neu", "zh": "阿司匹林"})]


def test_listing_and_csv(spark, tmp_path):
    put(tmp_path / "f", "one.pdf", "x")
    assert [(d.doc_id, d.format) for d in r.binary_listing(spark, put(tmp_path / "f", "two.txt", "y")).collect()] == [("one", "pdf")]
    path = put(tmp_path / "e", "e.csv", 'question,ground_truth,contexts\n"a, b",g,"[""c1"", ""c2""]"\n')
    assert r.eval_csv(spark, path).first().contexts == ["c1", "c2"]
    with pytest.raises(ValueError, match="ground_truth"):
        r.eval_csv(spark, put(tmp_path / "g", "g.csv", "question\nq\n"))


def test_markdown(spark):
    text = "intro\n\n# A\na text\n## B\nb text\n#### D\nd text\n# E\n\n## F\nf"
    got = r.markdown_sections(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "id int, md string"), "id", "md").orderBy("id", "ordinal").collect()
    assert [(x.id, x.section_path, x.level, x.content) for x in got] == [
        (1, "Preamble", 0, "intro"), (1, "A", 1, "a text"), (1, "A > B", 2, "b text"), (1, "A > B > D", 4, "d text"), (1, "E > F", 2, "f"), (2, "Preamble", 0, "plain"),
    ]


def test_layout_and_pages(spark):
    body = [{"label": "text", "text": "pre", "prov": [{"page_no": 1}]}, {"label": "section_header", "text": "H", "prov": [{"page_no": 2}]}, {"label": "text", "text": "t1", "prov": [{"page_no": 3}]}, {"label": "table", "data": "{}"}, {"label": "text", "text": "t2"}]
    got = r.layout_sections(spark.createDataFrame([(1, json.dumps({"body": body}))], "id int, j string"), "id", "j").orderBy("ordinal").collect()
    assert [(x.title, x.content, x.tables, x.page_start) for x in got] == [("Preamble", "pre", [], 1), ("H", "t1\nt2", ["{}"], 2)]
    (p,) = r.page_sections(spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 3, " ")], "file string, page_no int, text string")).collect()
    assert p.full_text == "a\n\nb" and [(s.title, s.page_start) for s in p.sections] == [("Page 1", 1), ("Page 2", 2)]


def test_links_ranges_and_vocabulary(spark):
    pages = [
        '<a href="/x.pdf">no</a><a class="k" href="/a/product-information/x">English <b>(EN)</b></a><a href="/product-information/y.pdf">z</a>',
        '<a href="http://h/z.PDF">Product information</a>', '<a href="/q">q</a>',
    ]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    got = [x.u for x in rows.select("i", r.product_link(F.col("h"), "https://b").alias("u")).orderBy("i").collect()]
    assert got == ["https://b/a/product-information/x", "http://h/z.PDF", None]
    (x,) = spark.sql("select date '2024-01-15' a, date '2024-03-10' b").select(r.month_ranges(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(str(m["from"]), str(m["to"])) for m in x.m] == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-10")]
    known = spark.createDataFrame([("d", "the query", ["a", "b", "c"])], "domain string, query string, items array<string>")
    asked = spark.createDataFrame([("d",), ("free text",)], "domain string")
    assert sorted(tuple(x) for x in r.domain_queries(asked, known, 2).collect()) == [("d", "the query", ["a", "b"]), ("free text", "free text", ["free text"])]
    new = spark.createDataFrame([(1,), (2,)], "k int")
    assert [x.k for x in r.skip_existing(new, new.where("k = 1"), "k").collect()] == [2]
    assert [x.k for x in r.ranged_cap(new, ["k"], 1).collect()] == [1]


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "id int, v string")
    once = t.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "D")]
    assert sorted(map(tuple, t.upsert(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, t.patch_payload(old, new.where("id = 2"), "id").collect())) == [(1, "a"), (2, "B")]
    assert [x.id for x in t.delete_by(old, new, "id").collect()] == [1]
    assert sorted(map(tuple, t.write_if_absent(new.where("id < 3"), old, "id").collect())) == [(1, "a"), (2, "b")]
    t.snapshot(old, str(tmp_path), "s")
    assert t.recover(spark, str(tmp_path), "s").count() == 2 and t.recover(spark, str(tmp_path), "none") is None
    assert {x.stage: x.n for x in t.pipeline_summary({"a": old, "b": new}).collect()} == {"a": 2, "b": 3}
    kept, removed = t.append_dedup(old.withColumn("pos", F.col("id")), new.withColumn("pos", F.col("id")), "id")
    assert kept.count() == 3 and removed.first().removed == 2
    ups = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "domain string, updated_at int, state string")
    assert t.latest_status(ups).first().state == "y"


def test_entities_vectors_and_ids(spark):
    mentions = spark.createDataFrame(
        [("Drug", "c1", "A", 0.5, "k1", 3, 5, "aa"), ("Drug", "c1", "B", 0.7, "k2", None, None, "bb"), ("Drug", "c1", "B", 0.7, "k2", 9, 11, "bb"), ("Unknown", "c2", "U", 0.1, "k1", 0, 1, "u")],
        "entity_type string, cui string, label string, confidence double, chunk_id string, start int, end int, mention_text string",
    )
    entities, edges = t.upsert_entities(spark.createDataFrame([], "entity_type string, cui string, label string, confidence double"), mentions)
    assert [tuple(x) for x in entities.collect()] == [("Drug", "c1", "B", 0.7)]
    assert sorted((x.chunk_id, x.start) for x in edges.collect()) == [("k1", 3), ("k2", -1)]
    got = spark.createDataFrame([("D001",), ("é",)], "c string").select("c", t.uuid5(F.col("c")).alias("u")).collect()
    assert all(x.u == str(uuid.uuid5(uuid.NAMESPACE_OID, x.c)) for x in got)
    vectors, skipped = t.upsert_vectors(spark.createDataFrame([], "chunk_id string, dense array<float>"), spark.createDataFrame([("a", [1.0]), ("b", None)], "chunk_id string, dense array<float>"))
    assert vectors.count() == 1 and skipped.first().skipped == 1
    chunks, edges = t.purge_junk(spark.createDataFrame([("a", "x"), ("b", "long text")], "chunk_id string, t string"), spark.createDataFrame([("a",), ("b",)], "chunk_id string"), F.length("t") < 3)
    assert chunks.count() == edges.count() == 1


def test_backfill(spark):
    chunks = spark.createDataFrame([("c1", "s", "A", "one", 1, 0, None), ("c2", "s", "A", "two", 1, 5, "Full A"), ("c3", "s", "B", "tail", None, None, None), ("c4", "s", "B", "head", 2, 0, None)], "chunk_id string, source_id string, section_path string, text string, page int, char_offset int, parent_text string")
    parts = spark.createDataFrame([("s", "A", "short"), ("s", "A", "Full A")], "source_id string, section_path string, content string")
    got = {x.chunk_id: (x.parent_text, x.how) for x in t.parent_text_backfill(chunks, parts).collect()}
    assert got == {"c1": ("Full A", "section"), "c3": ("head\n\ntail", "fallback"), "c4": ("head\n\ntail", "fallback")}


def test_document_files_are_written_by_all_cores(spark, tmp_path):
    from quillgraph.functions.scratch import shared_dir
    from quillgraph.plans import reader_queries

    spark.range(1, 60).selectExpr("id as s_suppkey", "concat('S', id) as s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    before = set(Path(shared_dir(spark)).glob("source-documents-*"))
    assert reader_queries.document_json(spark, str(tmp_path)).count() == 59
    (made,) = set(Path(shared_dir(spark)).glob("source-documents-*")) - before
    assert len(list(made.glob("*.txt"))) == 59 and len({f.name[:10] for f in made.glob("*.txt")}) > 4
