"""Queries with source and upkeep operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import linking as l
from ..operators import retrieval as r
from ..sources import readers as s
from ..sources import tables


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def month_ranges(spark, sf):
    """Months between each customer's first and last order."""
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    rows = spans.select("o_custkey", F.explode(s.month_ranges(F.col("a"), F.col("b"))).alias("m"))
    return rows.select("o_custkey", F.col("m.from").cast("string").alias("start"), F.col("m.to").cast("string").alias("stop"))


def link_select(spark, sf):
    """Links of the pages as they are, under each page one to a product PDF by each of the patterns, and one that none fits."""
    more = ['<a href="/x/1">English (EN)</a>', '<a class="k" href="/product-information/%d">Read <b>English (EN)</b></a>', '<A HREF="https://x.org/%d.pdf"> The  product information </A>', '<a href="/product-information/%d.pdf">here</a>', '<a href="/%d.pdf">leaflet</a>']
    own = F.element_at(F.array(*[F.lit(x) for x in more]), (F.col("page_id") % len(more) + 1).cast("int"))
    html = F.concat("html", F.replace(own, F.lit("%d"), F.col("page_id").cast("string")), F.when(F.col("page_id") % 7 == 0, '<a href="/product-information/late.pdf">z</a>').otherwise(""))
    return table(spark, sf, "pages").select("page_id", s.product_link(html).alias("link"))


def recency(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.to_date(F.max("ts"))).first()[0]
    return e.select("event_id", t.recency_label(F.datediff(F.lit(last), F.to_date("ts")) * 3).alias("when"))


def _chunks(spark, sf):
    """Lines of documents as chunks; every third one's parent is known."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(t.paragraphs(F.col("text"), r"\n+")).alias("pos", "text"))
    return rows.select(F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("section_path"), "text", (F.col("pos") / 10).cast("int").alias("page"), F.col("pos").cast("int").alias("char_offset"), F.lit(None).cast("string").alias("parent_text"))


def parent_backfill(spark, sf):
    sections = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("section_path"), F.col("text").alias("content"))
    return tables.parent_text_backfill(_chunks(spark, sf), sections).select("chunk_id", F.md5("parent_text").alias("digest"), "how")


def markdown(spark, sf):
    """Every fifth line of a document is a heading, its level by its place."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i / 5 % 3 + 1).cast("int")), F.lit(" "), F.concat(F.lit("H"), i.cast("string")))).otherwise(x))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("md"))
    return s.markdown_sections(docs, "doc_id", "md").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "section_path", F.col("level").cast("long").alias("level"), F.md5("content").alias("digest"))


def string_rerank(spark, sf):
    """Parts' names with a sign left out, against parts of the same type and brand as candidates, by label and synonym."""
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("cui"), "p_name", "p_type", "p_brand")
    concepts = p.select("cui", F.col("p_name").alias("label"), F.array("p_brand").alias("synonyms"), F.lit(None).cast("map<string,string>").alias("lang_labels"))
    asked = p.select(F.concat(F.substring("p_name", 1, 4), F.expr("substring(p_name, 6)")).alias("text"), "p_type", "p_brand")
    pairs = asked.distinct().join(p, ["p_type", "p_brand"]).select("text", "cui")
    return l.string_rerank(pairs, concepts)


def edit_ratio(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", F.round(l.edit_ratio(F.col("a"), F.col("b")), 6).alias("edit"))


def upserted(spark, sf):
    """Orders of the last year over those before, by customer: the newest of each."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("d"))
    old = o.where("d < '1997'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("d", "o_orderkey").alias("d"))
    return tables.upsert(old, o.where("d >= '1997'"), ["o_custkey"], [F.desc("o_orderkey")])


def point_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.length(tables.uuid5(F.col("p_name"))).cast("long").alias("n"), tables.uuid5(F.concat(F.lit("P"), "p_partkey")).alias("id"))


def section_similarity(spark, sf):
    """Pairs of benchmark passages that share a hundredth of their words at least, found by shared words."""
    w = table(spark, sf, "benchmark").select("item_id", r.word_set(F.col("text")).alias("w"))
    one = w.select(F.col("item_id").alias("a"), F.size("w").alias("na"), F.explode("w").alias("k"))
    two = one.select(F.col("a").alias("b"), F.col("na").alias("nb"), "k")
    n = one.join(two, "k").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    return n.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("overlap")).where("overlap >= 0.01")


QUERIES = {
    "month_ranges": month_ranges,
    "link_select": link_select,
    "recency_label": recency,
    "parent_backfill": parent_backfill,
    "markdown_sections": markdown,
    "string_rerank": string_rerank,
    "edit_ratio": edit_ratio,
    "upsert": upserted,
    "point_ids": point_ids,
    "section_similarity": section_similarity,
}

SQL = {
    "month_ranges": """WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
 m AS (SELECT o_custkey, a, b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM s)
SELECT o_custkey, greatest(a, m)::VARCHAR AS start, least(last_day(m), b)::VARCHAR AS stop FROM m""",
    "link_select": r"""WITH h AS (SELECT page_id, html || replace(['<a href="/x/1">English (EN)</a>', '<a class="k" href="/product-information/%d">Read <b>English (EN)</b></a>', '<A HREF="https://x.org/%d.pdf"> The  product information </A>',
  '<a href="/product-information/%d.pdf">here</a>', '<a href="/%d.pdf">leaflet</a>'][page_id % 5 + 1], '%d', page_id::VARCHAR) || CASE WHEN page_id % 7 = 0 THEN '<a href="/product-information/late.pdf">z</a>' ELSE '' END AS html FROM pages),
 l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>') AS found FROM h), a AS (SELECT page_id, unnest(found) AS a, unnest(range(len(found))) AS i FROM l),
 x AS (SELECT page_id, i, regexp_extract(a, '(?is)href\s*=\s*"([^"]*)"', 1) AS href, lower(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS said FROM a),
 f AS (SELECT page_id, arg_min(href, i) AS href FROM x WHERE contains(said, 'english (en)') AND contains(lower(href), '/product-information/') OR contains(said, 'product information') AND ends_with(lower(href), '.pdf')
  OR contains(lower(href), '/product-information/') AND ends_with(lower(href), '.pdf') GROUP BY 1)
SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://example.org' || href END AS link FROM pages LEFT JOIN f USING (page_id)""",
    "edit_ratio": """SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type), 1), 6) AS edit FROM part""",
    "point_ids": """WITH h AS (SELECT p_partkey, sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode('P' || p_partkey)) AS h FROM part)
SELECT p_partkey, 36 AS n, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""",
    "markdown_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
 g AS (SELECT doc_id, i // 5 AS n, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE i % 5 > 0) AS body FROM l GROUP BY 1, 2),
 h AS (SELECT doc_id, n, n % 3 + 1 AS level, regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g') AS content FROM g)
SELECT doc_id, n + 1 AS ordinal, CASE level WHEN 1 THEN 'H' || n * 5 WHEN 2 THEN 'H' || (n - 1) * 5 || ' > H' || n * 5 ELSE 'H' || (n - 2) * 5 || ' > H' || (n - 1) * 5 || ' > H' || n * 5 END AS section_path, level, md5(content) AS digest FROM h WHERE content <> ''""",
    "recency_label": """WITH d AS (SELECT event_id, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) * 3 AS n FROM events)
SELECT event_id, CASE WHEN n < 1 THEN 'today' WHEN n < 30 THEN n || 'd ago' ELSE (n // 30) || 'mo ago' END AS "when" FROM d""",
    "parent_backfill": r"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
 c AS (SELECT doc_id, unnest(range(len(ps))) AS pos, CASE WHEN doc_id % 2 = 0 THEN text ELSE array_to_string(ps, chr(10) || chr(10)) END AS parent FROM p)
SELECT doc_id || '-' || pos AS chunk_id, md5(parent) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'section' ELSE 'fallback' END AS how FROM c""",
    "upsert": """WITH o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders),
 n AS (SELECT * FROM o WHERE d >= '1997' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
 p AS (SELECT * FROM o WHERE d < '1997' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM p WHERE o_custkey NOT IN (SELECT o_custkey FROM n)""",
    "section_similarity": r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark),
 j AS (SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.w, y.w)) AS n, len(x.w) AS na, len(y.w) AS nb FROM w x JOIN w y ON x.item_id < y.item_id)
SELECT a, b, round(n / (na + nb - n), 6) AS overlap FROM j WHERE n > 0 AND round(n / (na + nb - n), 6) >= 0.01""",
}
