"""Document sources: JSON, JSON Lines, XML, concept files, PDFs' listings, Markdown, layout JSON, page texts, HTML links.

Readers give the documents schema, or a narrower table that says what it is. Bad inputs go to a column or table of their own, never silently.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTION = "struct<section_path: string, title: string, content: string, page_start: int, page_end: int, tables: string>"
DOCUMENT = (
    "doc_id string, source struct<source_id: string, source_title: string, source_version: string, source_url: string, retrieved_at: timestamp, language: string>, "
    f"language string, title string, abstract string, full_text string, sections array<{SECTION}>, file_path string, format string"
)


def _section(title: Column, content: Column) -> Column:
    return F.struct(
        title.alias("section_path"), title.alias("title"), content.alias("content"), F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"), F.lit(None).cast("string").alias("tables"),
    )


def _documents(df: DataFrame, **columns: Column) -> DataFrame:
    """The documents schema from some of its columns; the others are null."""
    source_id = columns.pop("source_id", columns["doc_id"])
    made = columns | {"source": F.struct(source_id.alias("source_id"), columns.get("title", F.lit(None)).cast("string").alias("source_title"), columns.pop("source_version", F.lit(None)).cast("string").alias("source_version"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("timestamp").alias("retrieved_at"), columns.get("language", F.lit(None)).cast("string").alias("language"))}
    fields = [x.strip().split(" ", 1) for x in ("doc_id string", DOCUMENT[DOCUMENT.index("source ") : DOCUMENT.index(", language string")], "language string", "title string", "abstract string", "full_text string", f"sections array<{SECTION}>", "file_path string", "format string")]
    return df.select(*[made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def document_json(spark: SparkSession, path: str, names: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): one document for each JSON file below ``path`` (whose name fits ``names``); files that do not parse, or have no id, are rejects."""
    rows = (
        spark.read.schema(DOCUMENT + ", _bad string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names)
        .option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.col("_metadata.file_path"))
    )
    bad = F.col("_bad").isNotNull() | F.col("doc_id").isNull()
    return rows.where(~bad).drop("_bad", "_file"), rows.where(bad).select("_file", "_bad")


def qa_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer lines; an id is made from the question where there is none."""
    rows = spark.read.schema("id string, question string, answer string, related_diseases array<string>").json(path).where("question is not null")
    parts = F.filter(
        F.array(
            _section(F.lit("Question"), F.col("question")),
            _section(F.lit("Answer"), F.col("answer")),
            F.when(F.size("related_diseases") > 0, _section(F.lit("Related Diseases"), F.array_join("related_diseases", ", "))),
        ),
        lambda s: s.isNotNull() & s["content"].isNotNull(),
    )
    content = F.concat_ws("\n\n", "question", "answer")
    doc_id = F.coalesce("id", F.concat(F.lit("qa_"), F.hex(F.xxhash64("question"))))
    return _documents(rows, doc_id=doc_id, language=F.lit("zh"), title=F.substring("question", 1, 100), abstract=F.substring(content, 1, 500), full_text=content, sections=parts, format=F.lit("text"))


def parallel_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {de, en}; the id is a digest of the German side."""
    rows = spark.read.schema("de string, en string").option("multiLine", True).json(path).where("de is not null or en is not null")
    parts = F.filter(F.array(F.when(F.col("de").isNotNull(), _section(F.lit("German"), F.col("de"))), F.when(F.col("en").isNotNull(), _section(F.lit("English"), F.col("en")))), lambda s: s.isNotNull())
    doc_id = F.concat(F.lit("germed_"), F.substring(F.md5(F.coalesce("de", F.lit("")).cast("binary")), 1, 12))
    return _documents(rows, doc_id=doc_id, language=F.lit("de"), title=F.substring(F.coalesce("de", "en"), 1, 100), full_text=F.concat_ws("\n\n", "de", "en"), sections=parts, format=F.lit("text"))


def article_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): abstract articles; a label, else a category, titles a section, and neighbours with one title are one section.

    Each article is parsed in the task that holds it. One that does not parse, or has no id, is a reject with its text and the reason.
    """
    # files are cut at the articles' ends, so that large ones are read in splits
    end = "</PubmedArticle>"
    head = F.regexp_extract("value", r"(?s)<PubmedArticle[ >].*", 0)
    raw = spark.read.option("lineSep", end).text(path).select(head.alias("head")).where("head <> ''").select(F.concat("head", F.lit(end)).alias("xml"))
    languages = {"eng": "en", "chi": "zh", "ger": "de"}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for xml in batch["xml"]:
                try:
                    root = ElementTree.fromstring(xml)
                except ElementTree.ParseError as bad:
                    out.append((None, None, None, None, [], [], xml, str(bad)))
                    continue
                text = lambda at, root=root: "".join(e.itertext()).strip() if (e := root.find(at)) is not None else None
                parts: list[list[str]] = []
                for e in root.iter("AbstractText"):
                    title, body = (e.get("Label") or e.get("NlmCategory") or "Abstract").title(), "".join(e.itertext()).strip()
                    if body and parts and parts[-1][0] == title:
                        parts[-1][1] += "\n" + body
                    elif body:
                        parts.append([title, body])
                out.append((text(".//PMID"), languages.get(text(".//Language") or "eng", "en"), text(".//ArticleTitle"), text(".//PubDate/Year"), [p[0] for p in parts], [p[1] for p in parts], xml, None))
            yield pd.DataFrame(out, columns=["id", "language", "title", "year", "names", "bodies", "xml", "reason"])

    every = raw.mapInPandas(parse, "id string, language string, title string, year string, names array<string>, bodies array<string>, xml string, reason string")
    rows = every.where("id is not null")
    rejects = every.where("id is null").select("xml", F.coalesce("reason", F.lit("no id")).alias("reason"))
    parts = F.zip_with("names", "bodies", _section)
    return _documents(rows, doc_id=F.concat(F.lit("pmid_"), "id"), source_id=F.col("id"), source_version=F.col("year"), language=F.col("language"), title=F.col("title"), abstract=F.array_join("bodies", "\n"), sections=parts, format=F.lit("xml")), rejects


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def label_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): drug labels, one a file: every section at any depth with a title of its own, and all its text. Files that do not parse are rejects."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, xml in zip(batch["file_path"], batch["value"], strict=True):
                try:
                    root = ElementTree.fromstring(xml.encode())
                except ElementTree.ParseError as bad:
                    out.append((file, None, [], [], str(bad)))
                    continue
                flat = lambda e: " ".join("".join(e.itertext()).split())
                title = next((flat(e) for e in root if _local(e.tag) == "title"), "")
                names, bodies = [], []
                for s in root.iter():
                    if _local(s.tag) == "section":
                        name = next((flat(e) for e in s if _local(e.tag) == "title"), "")
                        body = " ".join(flat(e) for e in s if _local(e.tag) != "title").strip()
                        if name and body:
                            names.append(name)
                            bodies.append(body)
                out.append((file, title, names, bodies, None))
            yield pd.DataFrame(out, columns=["file_path", "title", "names", "bodies", "reason"])

    every = raw.mapInPandas(parse, "file_path string, title string, names array<string>, bodies array<string>, reason string")
    rows, rejects = every.where("reason is null"), every.where("reason is not null").select("file_path", "reason")
    stem = F.regexp_extract("file_path", r"([^/]+)\.xml$", 1)
    return _documents(rows, doc_id=stem, language=F.lit("en"), title=F.col("title"), full_text=F.array_join("bodies", "\n\n"), sections=F.zip_with("names", "bodies", _section), file_path=F.col("file_path"), format=F.lit("xml")), rejects


DRUG_FIELDS = ["description", "indication", "pharmacodynamics", "mechanism-of-action", "toxicity", "metabolism", "food-interactions"]


def drug_xml(spark: SparkSession, path: str) -> DataFrame:
    """Drug monographs by Spark's XML source: seven fields are sections where they say something; the primary id counts."""
    schema = "`drugbank-id` array<struct<_VALUE: string, _primary: string>>, name string, " + ", ".join(f"`{f}` string" for f in DRUG_FIELDS)
    rows = spark.read.format("xml").schema(schema).option("rowTag", "drug").option("ignoreNamespace", True).load(path).where("name is not null")
    parts = F.filter(F.array(*[_section(F.lit(f.replace("-", " ").title()), F.trim(F.regexp_replace(F.col(f"`{f}`"), r"\s+", " "))) for f in DRUG_FIELDS]), lambda s: F.coalesce(s["content"], F.lit("")) != "")
    ids = F.col("`drugbank-id`")
    first = F.get(F.filter(ids, lambda x: x["_primary"] == "true"), F.lit(0))["_VALUE"]
    doc_id = F.coalesce(first, F.get(ids, F.lit(0))["_VALUE"])
    return _documents(rows, doc_id=doc_id, language=F.lit("en"), title=F.col("name"), abstract=F.col("description"), sections=parts, format=F.lit("xml"))


def concept_ascii(spark: SparkSession, path: str) -> DataFrame:
    """``cui, label, synonyms, tree_numbers`` from records that start with a marker line; without id or label: none."""
    rows = spark.read.option("lineSep", "*NEWRECORD").text(path)
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name} = (.+?)\s*$", 1)
    every = lambda name: F.regexp_extract_all("value", F.lit(rf"(?m)^{name} = ([^|\n\r]+)"), F.lit(1))
    names = F.array_distinct(F.transform(every("(?:PRINT )?ENTRY"), lambda x: F.trim(x)))
    return rows.select(field("UI").alias("cui"), field("MH").alias("label"), names.alias("synonyms"), F.transform(every("MN"), lambda x: F.trim(x)).alias("tree_numbers")).where("cui <> '' and label <> ''")


def concept_translations(spark: SparkSession, path: str, concepts: DataFrame) -> DataFrame:
    """``cui, lang_labels`` (map): of lines cui, language, label with three parts, the last for each language; unknown concepts do not count."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("p", F.split("value", "\t")).where("size(p) = 3")
    rows = lines.select(F.trim(F.col("p")[0]).alias("cui"), F.trim(F.col("p")[1]).alias("lang"), F.trim(F.col("p")[2]).alias("label"), "n").where("label <> ''")
    last = rows.join(concepts.select("cui").distinct(), "cui", "left_semi").groupBy("cui", "lang").agg(F.max_by("label", "n").alias("label"))
    return last.groupBy("cui").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "label")))).alias("lang_labels"))


def binary_listing(spark: SparkSession, path: str) -> DataFrame:
    """PDFs as documents without text: the contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return _documents(rows, doc_id=stem, title=stem, file_path=F.col("path"), format=F.lit("pdf"))


# structure


def markdown_sections(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, ordinal, section_path, title, level, content``: cut at # headings; deeper headings end with a higher one, a skipped level shortens the path."""
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    lines = lines.withColumns({"level": F.when(mark != "", F.length(mark)), "name": F.when(mark != "", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))})
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ordinal", F.count("level").over(so_far).cast("int"))
    bodies = lines.groupBy(id_col, "ordinal").agg(
        F.max("level").alias("level"), F.max("name").alias("name"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")).alias("content"),
    )
    # the path after each heading: its first level - 1 names, then its own
    heads = bodies.withColumn("before", F.array_sort(F.collect_list(F.struct("ordinal", "level", "name")).over(Window.partitionBy(id_col).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))))
    fold = F.aggregate(
        F.filter("before", lambda h: h["level"].isNotNull()), F.array().cast("array<string>"), lambda path, h: F.concat(F.slice(path, F.lit(1), h["level"] - 1), F.array(h["name"]))
    )
    path = F.when(F.size(fold) > 0, F.array_join(fold, " > ")).otherwise("Preamble")
    clean = F.regexp_replace("content", r"^\s+|\s+$", "")
    return heads.select(id_col, "ordinal", path.alias("section_path"), F.coalesce("name", F.lit("Preamble")).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), clean.alias("content")).where("content <> ''")


LAYOUT = "struct<body: array<struct<label: string, text: string, level: int, prov: array<struct<page_no: int>>, data: string>>>"


def layout_sections(docs: DataFrame, id_col: str, layout: str) -> DataFrame:
    """``id_col, ordinal, title, content, tables, page_start`` from layout JSON: section headers start sections, tables are kept as JSON."""
    items = docs.select(id_col, F.posexplode(F.from_json(layout, LAYOUT)["body"]).alias("pos", "x")).select(id_col, "pos", "x.*")
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("label") == "section_header"
    items = items.withColumns({"ordinal": F.count(F.when(head, 1)).over(so_far), "page": F.get("prov", F.lit(0))["page_no"]})
    kept = lambda what, col: F.transform(F.array_sort(F.collect_list(F.when(what, F.struct("pos", col)))), lambda s: s[col])
    grouped = items.groupBy(id_col, "ordinal").agg(
        F.max(F.when(head, F.col("text"))).alias("title"),
        F.array_join(kept(F.col("label").isin("text", "paragraph", "list_item"), "text"), "\n").alias("content"),
        kept(F.col("label") == "table", "data").alias("tables"),
        F.coalesce(F.min_by("page", F.when(head, F.col("pos"))), F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos")))).alias("page_start"),
    )
    return grouped.withColumn("title", F.coalesce("title", F.lit("Preamble"))).where("content <> '' or size(tables) > 0")


def page_sections(pages: DataFrame) -> DataFrame:
    """``file, sections, full_text`` from (file, page_no, text): a section for each page that is not empty."""
    rows = pages.where(F.trim("text") != "").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return rows.select("file", F.transform("p", lambda x: F.struct(F.concat(F.lit("Page "), x["page_no"].cast("string")).alias("title"), x["text"].alias("content"), x["page_no"].alias("page_start"))).alias("sections"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("full_text"))


def product_link(html: Column, base: str = "https://example.org") -> Column:
    """The first anchor, in page order, that fits one of the three patterns, as a full address; null without."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>'), F.lit(0))

    def fits(a: Column) -> Column:
        href = F.lower(F.regexp_extract(a, r'(?is)href\s*=\s*"([^"]*)"', 1))
        text = F.lower(F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", ""), r"\s+", " ")))
        path, pdf = F.contains(href, F.lit("/product-information/")), F.endswith(href, F.lit(".pdf"))
        return (F.contains(text, F.lit("english (en)")) & path) | (F.contains(text, F.lit("product information")) & pdf) | (path & pdf)

    href = F.regexp_extract(F.get(F.filter(anchors, fits), F.lit(0)), r'(?is)href\s*=\s*"([^"]*)"', 1)
    return F.when(F.startswith(href, F.lit("http")), href).when(href != "", F.concat(F.lit(base), href))


def month_ranges(start: Column, stop: Column) -> Column:
    """Calendar months of [start, stop], the first and last clipped: array<struct<from, to>>."""
    months = F.sequence(F.trunc(start, "MM"), stop, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(start, m).alias("from"), F.least(F.last_day(m), stop).alias("to")))


#: Rows that a search gives without a range.
MOST_WITHOUT_RANGE = 9_999


def ranged_cap(rows: DataFrame, order: list, limit: int, ranged: bool = True) -> DataFrame:
    """What ranges give in order, until ``limit`` in all; without ranges a limit over 9 999 cannot be met and is an error."""
    if not ranged and limit > MOST_WITHOUT_RANGE:
        raise ValueError(f"more than {MOST_WITHOUT_RANGE} rows need a range: {limit}")
    return rows.orderBy(*order).limit(limit)


def skip_existing(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return new.join(stored.select(key).distinct(), key, "left_anti")


def domain_queries(asked: DataFrame, vocabulary: DataFrame, most_items: int) -> DataFrame:
    """``domain, query, items``: a domain's query text, or the domain itself; its first items. vocabulary: domain, query, items."""
    return asked.join(vocabulary, "domain", "left").select("domain", F.coalesce("query", "domain").alias("query"), F.slice(F.coalesce("items", F.array("domain")), 1, most_items).alias("items"))


def graph_chunks(chunks: DataFrame, documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stored chunks with their documents' titles and their entities, for a stage that starts from the graph."""
    found = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("cui", "entity_type"))).alias("entities"))
    return chunks.join(documents.select("doc_id", "title"), "doc_id", "left").join(found, "chunk_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<cui: string, entity_type: string>>")))


def graph_entities(entities: DataFrame) -> DataFrame:
    known = entities.where("entity_type <> 'Unknown' and cui is not null and label is not null")
    return known.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang_zh", "lang_de")}).orderBy("cui", "entity_type")


def vector_scroll(points: DataFrame, vectors: list[str]) -> DataFrame:
    """The payloads of all points; vector columns are not read. Spark's splits are the pages."""
    return points.select(*[c for c in points.columns if c not in vectors])


def union_documents(*parts: DataFrame) -> DataFrame:
    """Fetched and loaded documents (or chunks and those of frontier entities) as one table; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def eval_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("question", "ground_truth"), lists: tuple[str, ...] = ("contexts",)) -> DataFrame:
    """A test set; columns that are missing are an error, lists are read from their JSON text."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in lists if c in rows.columns})
