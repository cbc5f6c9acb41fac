"""Source queries: tables written in each source's format to the shared folder, then read by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import shared_dir
from ..sources import readers as s


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark, name):
    return f"{shared_dir(spark)}/source-{name}-{uuid.uuid4().hex}"


def _written(rows: DataFrame, column, name: str, **options) -> str:
    """The folder of text files that hold a column's values, one a line."""
    path = _folder(rows.sparkSession, name)
    rows.select(column.alias("value")).write.options(**options).text(path)
    return path


def document_json(spark, sf):
    """Suppliers as documents, a file for each; a nation's number that is not a string makes a file a reject."""
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("doc_id"), F.lit("en").alias("language"), F.col("s_name").alias("title"), F.array(F.struct(F.lit("Name").alias("title"), F.col("s_name").alias("content"))).alias("sections"),
        (F.col("s_suppkey") % 4 == 0).alias("broken"),
    )
    json = F.to_json(F.struct("doc_id", "language", "title", "sections"))
    path = _folder(spark, "documents")
    whole = F.when(F.col("broken"), F.concat(json, F.lit("]"))).otherwise(json)
    files = rows.select(F.when(F.col("broken"), F.expr("substring(to_json(struct(doc_id, language, title, sections)), 1, 20)")).otherwise(whole).alias("value"))
    # the rows are few bytes but each is a file, so that they are dealt to all cores; the number keeps Spark from drawing them together
    files.repartition(4 * spark.sparkContext.defaultParallelism, "value").write.option("maxRecordsPerFile", 1).format("text").save(path)
    # the text sink names its files .txt; the reader takes .json
    docs, bad = s.document_json(spark, path, "*.txt")
    good = docs.select("doc_id", "title", F.size("sections").cast("long").alias("sections"), F.col("sections")[0]["content"].alias("content"))
    return good.unionByName(bad.select(F.lit("rejected").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("sections"), F.lit(None).cast("string").alias("content")))


def qa_jsonl(spark, sf):
    c = table(spark, sf, "conversations")
    turn = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    rows = c.groupBy("conv_id").agg(turn("user").alias("question"), turn("assistant").alias("answer")).where("question is not null")
    path = _written(rows, F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "question", "answer")), "qa")
    got = s.qa_jsonl(spark, path)
    return got.select("doc_id", "title", F.md5("abstract").alias("abstract"), F.size("sections").cast("long").alias("sections"), F.md5("full_text").alias("full_text"))


def parallel_json(spark, sf):
    """Benchmark passages and a second form of some, ten to an array."""
    b = table(spark, sf, "benchmark").select((F.col("item_id") / 10).cast("long").alias("g"), F.struct(F.col("text").alias("de"), F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("EN "), "text")).alias("en")).alias("x"))
    path = _written(b.groupBy("g").agg(F.to_json(F.collect_list("x")).alias("j")), F.col("j"), "parallel", maxRecordsPerFile=1)
    return s.parallel_json(spark, path).select("doc_id", F.size("sections").cast("long").alias("sections"), F.md5("full_text").alias("full_text"), F.length("title").cast("long").alias("title_chars"))


def _articles(spark, sf):
    b = table(spark, sf, "benchmark")
    half = F.floor(F.length("text") / 2).cast("int")
    one = lambda label, text: F.concat(F.lit(f'<AbstractText Label="{label}">'), text, F.lit("</AbstractText>"))
    broken = F.when(F.col("item_id") % 10 == 3, "<b>").otherwise("")
    xml = F.concat(
        F.lit("<PubmedArticle><PMID>"), F.col("item_id").cast("string"), F.lit("</PMID><ArticleTitle>T"), F.col("item_id").cast("string"), F.lit("</ArticleTitle><Abstract>"),
        one("AIMS", F.expr("substring(text, 1, int(floor(length(text) / 2)))")), one("AIMS", F.lit("More.")), one("RESULTS", F.expr("substring(text, int(floor(length(text) / 2)) + 1)")), broken,
        F.lit("</Abstract><Language>ger</Language></PubmedArticle>"),
    )
    return s.article_xml(spark, _written(b.where(half > 0), xml, "articles"))


def article_xml(spark, sf):
    docs, bad = _articles(spark, sf)
    names = F.array_join(F.transform("sections", lambda x: x["title"]), "|")
    good = docs.select("doc_id", "language", "title", names.alias("names"), F.md5("abstract").alias("abstract"))
    null = F.lit(None).cast("string")
    return good.unionByName(bad.select(F.lit("rejected").alias("doc_id"), null.alias("language"), null.alias("title"), null.alias("names"), null.alias("abstract")))


def label_xml(spark, sf):
    """A label for each region: its nations are sections, one in another."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.lit("<section><title>"), "n_name", F.lit("</title><text>Nation <b>"), F.col("n_nationkey").cast("string"), F.lit("</b></text>"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("x")))).alias("p"), F.count(F.lit(1)).cast("int").alias("k"))
    xml = F.concat(F.lit('<document xmlns="urn:x"><title>'), "r_name", F.lit("</title>"), F.array_join(F.transform("p", lambda x: x["x"]), ""), F.repeat(F.lit("</section>"), F.col("k")), F.lit("</document>"))
    docs, _ = s.label_xml(spark, _written(rows, xml, "labels", maxRecordsPerFile=1))
    return docs.select("title", F.posexplode("sections").alias("pos", "x")).select("title", F.col("pos").cast("long").alias("pos"), F.col("x.title").alias("section"), F.length("x.content").cast("long").alias("chars"))


def drug_xml(spark, sf):
    xml = F.concat(
        F.lit("<drug><drugbank-id>alt"), F.col("p_partkey").cast("string"), F.lit('</drugbank-id><drugbank-id primary="true">DB'), F.col("p_partkey").cast("string"), F.lit("</drugbank-id><name>"), "p_name",
        F.lit("</name><description>"), "p_type", F.lit("</description><toxicity>"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" "), F.lit("</toxicity></drug>"),
    )
    files = table(spark, sf, "part").groupBy("p_brand").agg(F.concat(F.lit("<drugbank>"), F.array_join(F.collect_list(xml), ""), F.lit("</drugbank>")).alias("x"))
    got = s.drug_xml(spark, _written(files, F.col("x"), "drugs", maxRecordsPerFile=1))
    return got.select("doc_id", "title", "abstract", F.array_join(F.transform("sections", lambda x: F.concat_ws("=", x["title"], x["content"])), "|").alias("sections"))


def _concepts(spark, sf):
    line = lambda name, value: F.concat(F.lit(f"{name} = "), value, F.lit("\n"))
    record = F.concat(
        F.lit("*NEWRECORD\n"), F.when(F.col("p_partkey") % 9 > 0, line("UI", F.concat(F.lit("D"), F.col("p_partkey").cast("string")))).otherwise(""), line("MH", F.col("p_name")),
        line("ENTRY", F.concat("p_brand", F.lit("|T109"))), line("PRINT ENTRY", F.col("p_brand")), line("ENTRY", F.col("p_type")), line("MN", F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit(".1"))),
    )
    return s.concept_ascii(spark, _written(table(spark, sf, "part"), record, "concepts"))


def concept_ascii(spark, sf):
    return _concepts(spark, sf).select("cui", "label", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("tree_numbers", "|").alias("trees"))


def concept_translations(spark, sf):
    """Two German labels for each part, of which the last counts, a Chinese one for some, lines with too few parts, and unknown concepts."""
    p = table(spark, sf, "part").select(F.concat(F.lit("D"), "p_partkey").alias("cui"), "p_name", "p_brand", "p_partkey")
    tab = F.lit("\t")
    lines = F.array(
        F.concat("cui", tab, F.lit("de"), tab, "p_brand"), F.concat("cui", tab, F.lit("de"), tab, F.concat(F.lit(" "), "p_name")), F.when(F.col("p_partkey") % 3 == 0, F.concat("cui", tab, F.lit("zh"), tab, "p_brand")),
        F.concat("cui", tab, F.lit("de")), F.concat(F.lit("X"), "cui", tab, F.lit("de"), tab, F.lit("x")), F.concat("cui", tab, F.lit("zh"), tab, F.lit(" ")),
    )
    path = _written(p.select(F.array_join(F.array_compact(lines), "\n").alias("v")), F.col("v"), "translations")
    got = s.concept_translations(spark, path, _concepts(spark, sf))
    return got.select("cui", F.col("lang_labels")["de"].alias("de"), F.col("lang_labels")["zh"].alias("zh"))


def concepts_translated(spark, sf):
    """Concepts with their language labels, if any."""
    c = _concepts(spark, sf)
    path = _written(table(spark, sf, "part").where("p_size > 20"), F.concat(F.lit("D"), F.col("p_partkey").cast("string"), F.lit("\tde\t"), "p_name"), "translations")
    return c.join(s.concept_translations(spark, path, c), "cui", "left").select("cui", "label", F.col("lang_labels")["de"].alias("de"))


def layout_sections(spark, sf):
    """Each document's lines as layout items: every fourth one a header, every seventh a table."""
    kind = lambda i: F.when(i % 4 == 1, "section_header").when(i % 7 == 6, "table").otherwise("text")
    body = F.transform(F.split("text", "\n"), lambda x, i: F.struct(kind(i).alias("label"), x.alias("text"), F.lit(1).alias("level"), F.array(F.struct((i / 3).cast("int").alias("page_no"))).alias("prov"), F.when(i % 7 == 6, i.cast("string")).alias("data")))
    docs = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(body.alias("body"))).alias("layout"))
    got = s.layout_sections(docs, "doc_id", "layout")
    return got.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("title").alias("title"), F.md5("content").alias("content"), F.array_join("tables", "|").alias("tables"), F.col("page_start").cast("long").alias("page_start"))


def page_sections(spark, sf):
    """Each document's lines as pages."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return s.page_sections(pages).select("file", F.size("sections").cast("long").alias("pages"), F.col("sections")[0]["title"].alias("first"), F.md5("full_text").alias("full_text"))


def ranged_cap(spark, sf):
    """Orders by month, then by key, until half of the customers' number are there."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")
    return s.ranged_cap(o, ["month", "o_orderkey"], 500)


def skip_existing(spark, sf):
    """Orders whose customers have no urgent one."""
    o = table(spark, sf, "orders")
    return s.skip_existing(o.select("o_custkey", "o_orderkey"), o.where("o_orderpriority = '1-URGENT'"), "o_custkey")


def domain_vocabulary(spark, sf):
    """Market segments and regions as domains; only regions have a vocabulary."""
    r = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    vocabulary = r.groupBy(F.col("r_name").alias("domain")).agg(F.concat_ws(" OR ", F.array_sort(F.collect_list("n_name"))).alias("query"), F.array_sort(F.collect_list("n_name")).alias("items"))
    asked = table(spark, sf, "region").select(F.col("r_name").alias("domain")).unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("domain")).distinct())
    return s.domain_queries(asked, vocabulary, 3).select("domain", "query", F.array_join("items", "|").alias("items"))


def _graph(spark, sf):
    line = table(spark, sf, "lineitem")
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
    documents = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    mentions = line.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("cui"), F.col("l_returnflag").alias("entity_type"))
    return chunks, documents, mentions


def graph_chunks(spark, sf):
    got = s.graph_chunks(*_graph(spark, sf))
    return got.select("chunk_id", "doc_id", "title", F.size("entities").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat_ws(":", e["cui"], e["entity_type"]))), "|").alias("entities"))


def graph_entities(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "Unknown").otherwise(F.substring_index("p_type", " ", 1))
    rows = p.select(F.when(F.col("p_partkey") % 11 > 0, F.col("p_partkey")).alias("cui"), F.when(F.col("p_partkey") % 13 > 0, F.col("p_name")).alias("label"), kind.alias("entity_type"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("lang_zh"), F.lit(None).cast("string").alias("lang_de"))
    return s.graph_entities(rows)


def vector_scroll(spark, sf):
    return s.vector_scroll(table(spark, sf, "embeddings"), ["embedding"])


def union_documents(spark, sf):
    """Pages and benchmark passages beside documents; columns that a part lacks are null."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.length("text").alias("chars"), "lang")
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.length("text").alias("chars"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), "url")
    return s.union_documents(d, b, p).withColumn("chars", F.col("chars").cast("long"))


def eval_csv(spark, sf):
    """Conversations' last questions and answers as a test set, with contexts as JSON text."""
    c = table(spark, sf, "conversations")
    turn = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    rows = c.groupBy("conv_id").agg(turn("user").alias("question"), turn("assistant").alias("ground_truth")).where("question is not null and ground_truth is not null")
    path = _folder(spark, "testset")
    rows.withColumn("contexts", F.to_json(F.array("ground_truth", F.lit('a "quoted" one')))).write.option("header", True).option("escape", '"').csv(path)
    got = s.eval_csv(spark, path)
    return got.select(F.col("conv_id").cast("long").alias("conv_id"), F.md5("question").alias("question"), F.md5(F.col("contexts")[0]).alias("context"), F.col("contexts")[1].alias("other"))


QUERIES = {
    "document_json": document_json,
    "qa_jsonl": qa_jsonl,
    "parallel_json_array": parallel_json,
    "article_xml": article_xml,
    "label_xml": label_xml,
    "drug_xml": drug_xml,
    "concept_ascii": concept_ascii,
    "concept_translations_tsv": concept_translations,
    "concepts_translated": concepts_translated,
    "layout_json_sections": layout_sections,
    "page_text_sections": page_sections,
    "ranged_cap": ranged_cap,
    "skip_existing": skip_existing,
    "domain_vocabulary": domain_vocabulary,
    "graph_read_chunks": graph_chunks,
    "graph_read_entities": graph_entities,
    "vector_scroll": vector_scroll,
    "union_documents": union_documents,
    "eval_csv": eval_csv,
}

_QA = """qa AS (SELECT conv_id, max(text) FILTER (WHERE role = 'user') AS q, max(text) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1)"""

SQL = {
    "document_json": """SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'rejected' ELSE 's' || s_suppkey END AS doc_id, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS title, CASE WHEN s_suppkey % 4 > 0 THEN 1 END AS sections,
 CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS content FROM supplier""",
    "qa_jsonl": f"""WITH {_QA} SELECT conv_id::VARCHAR AS doc_id, substr(q, 1, 100) AS title, md5(substr(concat_ws(chr(10) || chr(10), q, a), 1, 500)) AS abstract, 1 + (a IS NOT NULL)::INT AS sections,
 md5(concat_ws(chr(10) || chr(10), q, a)) AS full_text FROM qa WHERE q IS NOT NULL""",
    "parallel_json_array": """SELECT 'germed_' || substr(md5(text), 1, 12) AS doc_id, CASE WHEN item_id % 3 > 0 THEN 2 ELSE 1 END AS sections,
 md5(CASE WHEN item_id % 3 > 0 THEN text || chr(10) || chr(10) || 'EN ' || text ELSE text END) AS full_text, least(100, length(text)) AS title_chars FROM benchmark""",
    "article_xml": r"""WITH b AS (SELECT item_id, trim(substr(text, 1, length(text) // 2), ' ' || chr(10) || chr(9)) AS x, trim(substr(text, length(text) // 2 + 1), ' ' || chr(10) || chr(9)) AS y FROM benchmark WHERE length(text) > 1)
SELECT CASE WHEN item_id % 10 = 3 THEN 'rejected' ELSE 'pmid_' || item_id END AS doc_id, CASE WHEN item_id % 10 <> 3 THEN 'de' END AS language, CASE WHEN item_id % 10 <> 3 THEN 'T' || item_id END AS title,
 CASE WHEN item_id % 10 <> 3 THEN 'Aims|Results' END AS names, CASE WHEN item_id % 10 <> 3 THEN md5(x || chr(10) || 'More.' || chr(10) || y) END AS abstract FROM b""",
    "label_xml": """WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT x.r_name AS title, x.i - 1 AS pos, x.n_name AS section, (SELECT sum(length('Nation ' || n_nationkey) + CASE WHEN i > x.i THEN length(n_name) + CASE WHEN i = x.i + 1 THEN 1 ELSE 0 END ELSE 0 END) FROM n y WHERE y.r_name = x.r_name AND y.i >= x.i)::BIGINT AS chars FROM n x""",
    "drug_xml": """SELECT 'DB' || p_partkey AS doc_id, p_name AS title, p_type AS abstract, 'Description=' || p_type || CASE WHEN p_size > 25 THEN '|Toxicity=' || p_brand ELSE '' END AS sections FROM part""",
    "concept_ascii": "SELECT 'D' || p_partkey AS cui, p_name AS label, p_brand || '|' || p_type AS synonyms, 'C' || p_size || '.1' AS trees FROM part WHERE p_partkey % 9 > 0",
    "concept_translations_tsv": "SELECT 'D' || p_partkey AS cui, p_name AS de, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS zh FROM part WHERE p_partkey % 9 > 0",
    "concepts_translated": "SELECT 'D' || p_partkey AS cui, p_name AS label, CASE WHEN p_size > 20 THEN p_name END AS de FROM part WHERE p_partkey % 9 > 0",
    "layout_json_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
 g AS (SELECT *, (i + 3) // 4 AS ordinal FROM l)
SELECT doc_id, ordinal, md5(coalesce(max(x) FILTER (WHERE i % 4 = 1), 'Preamble')) AS title, md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE i % 4 <> 1 AND i % 7 <> 6), '')) AS content,
 coalesce(string_agg(i::VARCHAR, '|' ORDER BY i) FILTER (WHERE i % 4 <> 1 AND i % 7 = 6), '') AS tables, coalesce(min(i) FILTER (WHERE i % 4 = 1), min(i)) // 3 AS page_start FROM g GROUP BY 1, 2
 HAVING coalesce(string_agg(x, chr(10)) FILTER (WHERE i % 4 <> 1 AND i % 7 <> 6), '') <> '' OR count(*) FILTER (WHERE i % 4 <> 1 AND i % 7 = 6) > 0""",
    "page_text_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id AS file, count(*) AS pages, 'Page ' || min(i) AS first, md5(string_agg(x, chr(10) || chr(10) ORDER BY i)) AS full_text FROM l WHERE trim(x) <> '' GROUP BY 1""",
    "ranged_cap": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 500",
    "skip_existing": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "domain_vocabulary": """WITH v AS (SELECT r_name, string_agg(n_name, ' OR ' ORDER BY n_name) AS query, array_to_string(list_slice(list(n_name ORDER BY n_name), 1, 3), '|') AS items FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
 a AS (SELECT r_name AS domain FROM region UNION ALL SELECT DISTINCT c_mktsegment FROM customer)
SELECT domain, coalesce(query, domain) AS query, coalesce(items, domain) AS items FROM a LEFT JOIN v ON domain = r_name""",
    "graph_read_chunks": """WITH m AS (SELECT l_orderkey, count(DISTINCT l_partkey || ':' || l_returnflag) AS n, string_agg(DISTINCT l_partkey || ':' || l_returnflag, '|' ORDER BY l_partkey || ':' || l_returnflag) AS entities FROM lineitem GROUP BY 1)
SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, c_name AS title, coalesce(n, 0) AS n, coalesce(entities, '') AS entities FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN m ON o_orderkey = l_orderkey""",
    "graph_read_entities": """SELECT p_partkey AS cui, p_name AS label, split_part(p_type, ' ', 1) AS entity_type, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS lang_zh, '' AS lang_de FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 13 > 0 AND p_size % 5 <> 0""",
    "vector_scroll": "SELECT vec_id, label FROM embeddings",
    "union_documents": """SELECT doc_id::VARCHAR AS id, length(text) AS chars, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'b' || item_id, length(text), NULL, NULL FROM benchmark UNION ALL SELECT 'p' || page_id, NULL, NULL, url FROM pages""",
    "eval_csv": f"""WITH {_QA} SELECT conv_id, md5(q) AS question, md5(a) AS context, 'a "quoted" one' AS other FROM qa WHERE q IS NOT NULL AND a IS NOT NULL""",
}
