"""Queries on texts: the documents table as corpus, its lines as paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocabulary as v

LINE = r"\n+"


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def chunks(spark, sf):
    rows = docs(spark, sf).withColumn("chunks", t.chunk_section(F.col("text"), F.col("lang"), 300, 50, LINE))
    return rows.select("doc_id", F.posexplode("chunks").alias("ordinal", "chunk")).select(
        "doc_id", "ordinal", F.sha2(F.concat_ws("\x01", "doc_id", "ordinal"), 256).alias("chunk_id"), "chunk", t.estimate_tokens(F.col("chunk"), F.lit("en")).alias("tokens")
    )


def normalize_text(spark, sf):
    """Whole texts, normalised by their language; conversations too."""
    rows = docs(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", F.col("lang"))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit("en").alias("lang"))
    return rows.unionByName(turns).select("id", F.md5(t.normalize(F.col("text"), F.col("lang"))).alias("digest"))


def dosed(spark, sf):
    """Line items as dosing lines: a quantity with a unit by the line's number, and a frequency by its supplier."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    units, often = ["mg", "Milligrams", "mcg", "µg", "ml", "grams", "IU", "units", "percent"], ["twice daily", "3x daily", "q.i.d", "once a day", "every 4 hours", "as needed", "at bedtime", "never"]
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    text = F.concat(F.lit("Take "), F.col("l_quantity").cast("int").cast("string"), pick(units, F.col("l_partkey")), F.lit(" "), pick(often, F.col("l_suppkey")), F.lit("."))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


def dose_lines(spark, sf):
    return dosed(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.normalize(F.col("text"), F.lit("en")).alias("normalized"))


def dose_table(spark, sf):
    """Distinct sentences with a dose, and whether normalising changes them."""
    rows = dosed(spark, sf).select(F.concat("text", F.lit(" And no dose here. "), "text").alias("text"), F.lit("en").alias("lang"))
    return t.dose_table(rows, "text", "lang").select("sentence", "normalized", "changed")


def detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", t.detect_language(F.col("text")).alias("language"))


def chosen_sections(spark, sf):
    """Documents' first lines as abstracts; every third one has sections, every fourth one says nothing else."""
    rows = docs(spark, sf).withColumn("abstract", F.when(F.col("doc_id") % 5 > 0, F.substring_index("text", "\n", 1)))
    own = F.array(F.struct(F.lit("Own").alias("section_path"), F.col("source").alias("content")))
    full = F.when(F.col("doc_id") % 4 == 0, F.col("abstract")).otherwise(F.col("text"))
    chosen = t.choose_sections(F.when(F.col("doc_id") % 3 == 0, own), F.col("abstract"), full)
    return rows.select("doc_id", F.posexplode(chosen).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), "x.section_path", F.md5("x.content").alias("digest"))


def qa_sources(spark, sf):
    """Documents' lines as sections titled by their place; references are skipped."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(i % 3 == 1, "The References").otherwise("Body").alias("title"), x.alias("content")))
    rows = docs(spark, sf).select("doc_id", F.posexplode(t.qa_source(parts, F.col("text"), ["reference"])).alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("x").alias("digest"))


def parsable(spark, sf):
    """Documents' formats by their ids; paths are missing for some."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("text", "xml", "pdf", "html")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs(spark, sf).withColumns({"format": kinds, "path": F.when(F.col("doc_id") % 3 > 0, F.col("source"))})
    return rows.groupBy("format", t.can_be_parsed(F.col("format"), F.col("path")).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def provisional(spark, sf):
    """Words as provisional concepts, read back from their ids."""
    w = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).where("w <> ''")
    return w.select("w", t.provisional_text(t.provisional_id(F.lit("Drug"), F.col("w"))).alias("back")).distinct()


def language_detected(spark, sf):
    return docs(spark, sf).select("doc_id", t.detect_query_language(F.col("text")).alias("language"))


def token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", t.estimate_tokens(F.col("text"), F.lit("en")).cast("long").alias("tokens"))


def junk_filter(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(t.paragraphs(F.col("text"), LINE)).alias("pos", "line"))
    return lines.where(t.is_junk(F.col("line"), F.lit("en"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("junk_lines"))


def paragraphs(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(t.paragraphs(F.col("text"), LINE)).alias("pos", "paragraph")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("digest"))


def sentence_counts(spark, sf):
    parts = t.sentences(F.col("text"), F.lit("en"))
    return docs(spark, sf).select("doc_id", F.size(parts).cast("long").alias("sentences"), F.aggregate(parts, F.lit(0), lambda n, s: n + F.length(s)).cast("long").alias("chars"))


def clean_titles(spark, sf):
    title = F.concat(F.lit(" - "), F.substring_index("text", " ", 30), F.lit("  .. "))
    return docs(spark, sf).select("doc_id", t.clean_title(title).alias("title"))


def truncated(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.truncate_at_sentence(F.col("text"))).alias("digest"))


def cache_keys(spark, sf):
    return docs(spark, sf).select("doc_id", t.query_cache_key(F.col("text"), F.col("lang")).alias("key"))


QUERIES = {
    "chunk_greedy": chunks,
    "normalize_text": normalize_text,
    "normalize_doses": dose_lines,
    "dose_sentences": dose_table,
    "detect_language": detect_language,
    "choose_text": chosen_sections,
    "qa_source_filter": qa_sources,
    "format_filter": parsable,
    "provisional_id": provisional,
    "detect_query_language": language_detected,
    "token_estimate": token_estimate,
    "junk_filter": junk_filter,
    "paragraphs": paragraphs,
    "sentences": sentence_counts,
    "clean_title": clean_titles,
    "truncate_at_sentence": truncated,
    "query_cache_key": cache_keys,
}

_LINES = r"""lines AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS line FROM documents)"""

def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _normalized(text: str, lang: str) -> str:
    """The rules one after another, in the other engine; it has no look-ahead, so a unit takes the sign after it along."""

    def rules(of, flags):
        out = text
        for code, patterns in of:
            for p in patterns:
                out = f"regexp_replace({out}, {_quoted(flags + p)}, '{code}', 'g')"
        return out

    x = f"CASE {lang} WHEN 'de' THEN {rules(v.FREQUENCY_DE, '(?i)')} WHEN 'zh' THEN {rules(v.FREQUENCY_ZH, '')} ELSE {rules(v.FREQUENCY_EN, '(?i)')} END"
    number = _quoted(r"(?i)(\d+(?:[.,]\d+)?)\s*(" + v.UNIT_ALTERNATIVES + r")([^a-zA-Z]|$)")
    x = f"regexp_replace({x}, {number}, '\\1 ' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    for unit, names in v.UNITS.items():
        x = f"regexp_replace({x}, '(?i)' || chr(1) || {_quoted('(?:' + '|'.join(names) + ')')} || chr(2), '{unit}', 'g')"
    for kept in ("mg", "mcg", "g", "ng", "unit", "units", "percent", "%"):
        x = f"regexp_replace({x}, '(?i)' || chr(1) || '{kept}' || chr(2), '{kept}', 'g')"
    return x


_DOSED = """line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Take ' || l_quantity::INT || ['mg', 'Milligrams', 'mcg', 'µg', 'ml', 'grams', 'IU', 'units', 'percent'][l_partkey % 9 + 1] || ' ' ||
 ['twice daily', '3x daily', 'q.i.d', 'once a day', 'every 4 hours', 'as needed', 'at bedtime', 'never'][l_suppkey % 8 + 1] || '.' AS text FROM lineitem)"""
_UNIT, _OFTEN = "['mg', 'mg', 'mcg', 'mcg', 'mL', 'g', 'IU', 'units', 'percent'][l_partkey % 9 + 1]", "['bid', 'tid', 'qid', 'qd', 'q4h', 'prn', 'qhs', 'never'][l_suppkey % 8 + 1]"
_STOPS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_VOTES = lambda words: f"len(list_filter(w, lambda x: list_contains({_STOPS(words)}, x)))"

def _tokens(x: str) -> str:
    return rf"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, CAST(floor(1.3::DOUBLE * len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))) AS BIGINT)) END"


_TAIL = "list_slice(h, len(list_filter(range(1, len(h) + 1), lambda k: list_sum(list_transform(list_slice(h, k, len(h)), lambda y: y.n)) > 50)) + 1, len(h))"
_EMPTY = "[]::STRUCT(u VARCHAR, n BIGINT)[] AS h, 0::BIGINT AS n, []::VARCHAR[] AS done"


def _walk(name: str, key: str, units: str, joiner: str, apart: bool) -> str:
    """Units one after another into chunks: what is held, its tokens, and the chunks so far."""
    flushed = f"CASE WHEN len(h) > 0 THEN list_append(done, array_to_string(list_transform(h, lambda y: y.u), {joiner})) ELSE done END"
    size = "coalesce(list_sum(list_transform(tail, lambda y: y.n)), 0)::BIGINT"
    keys, own = ", ".join(f"w.{k}" for k in key.split(", ")), " AND ".join(f"w.{k} = x.{k}" for k in key.split(", "))
    too_long = "WHEN x.n > 300 THEN {}" if apart else ""
    return f"""{name} AS (SELECT DISTINCT {key}, 0 AS i, {_EMPTY} FROM {units}
 UNION ALL SELECT {keys}, x.i,
  CASE {too_long.format("tail")} WHEN w.n + x.n <= 300 THEN list_append(h, struct_pack(u := x.u, n := x.n)) ELSE list_append(tail, struct_pack(u := x.u, n := x.n)) END,
  CASE {too_long.format(size)} WHEN w.n + x.n <= 300 THEN w.n + x.n ELSE {size} + x.n END,
  CASE {too_long.format("list_concat(flushed, x.parts)")} WHEN w.n + x.n <= 300 THEN done ELSE flushed END
 FROM (SELECT *, {_TAIL} AS tail, {flushed} AS flushed FROM {name}) w JOIN {units} x ON {own} AND x.i = w.i + 1),
{name}_end AS (SELECT {key}, {flushed} AS parts FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i DESC) = 1)"""


#: Long paragraphs are packed by sentences first, then all paragraphs.
_CHUNKS = rf"""WITH RECURSIVE whole AS (SELECT doc_id, text, {_tokens("text")} AS n FROM documents WHERE trim(text) <> ''),
lists AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM whole WHERE n > 300),
flat AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS u FROM lists),
paras AS (SELECT doc_id, p, u, {_tokens("u")} AS n FROM flat),
cut AS (SELECT doc_id, p, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(u, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda q: regexp_replace(q, '^\s+|\s+$', '', 'g')), lambda q: q <> '') AS ss FROM paras WHERE n > 300),
said AS (SELECT doc_id, p, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS u FROM cut),
sents AS (SELECT doc_id, p, i, u, {_tokens("u")} AS n FROM said),
{_walk("inner_", "doc_id, p", "sents", "' '", False)},
units AS (SELECT paras.doc_id, paras.p AS i, u, n, coalesce(parts, []::VARCHAR[]) AS parts FROM paras LEFT JOIN inner__end e ON e.doc_id = paras.doc_id AND e.p = paras.p),
{_walk("outer_", "doc_id", "units", "chr(10) || chr(10)", True)},
chunks AS (SELECT doc_id, [text] AS parts FROM whole WHERE n <= 300 UNION ALL SELECT doc_id, parts FROM outer__end),
rows_ AS (SELECT doc_id, unnest(range(len(parts))) AS ordinal, unnest(parts) AS chunk FROM chunks)
SELECT doc_id, ordinal, sha256(doc_id || chr(1) || ordinal) AS chunk_id, chunk, {_tokens("chunk")} AS tokens FROM rows_"""

SQL = {
    "chunk_greedy": _CHUNKS,
    "normalize_text": f"""WITH r AS (SELECT 'd' || doc_id AS id, text, lang FROM documents UNION ALL SELECT conv_id || '-' || turn, text, 'en' FROM conversations) SELECT id, md5({_normalized("text", "lang")}) AS digest FROM r""",
    "normalize_doses": f"WITH {_DOSED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Take ' || regexp_extract(text, '[0-9]+') || ' ' || {_UNIT} || ' ' || {_OFTEN} || '.' AS normalized FROM line",
    "dose_sentences": f"""WITH {_DOSED}, s AS (SELECT DISTINCT trim(regexp_extract(text, '^[^.]*'), ' .') AS sentence, 'Take ' || regexp_extract(text, '[0-9]+') || ' ' || {_UNIT} || ' ' || CASE WHEN l_suppkey % 8 = 2 THEN 'q' ELSE {_OFTEN} END AS normalized FROM line)
SELECT sentence, normalized, sentence <> normalized AS changed FROM s""",
    "detect_language": rf"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN length(text) < 2 THEN 'en' WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh' WHEN {_VOTES(v.STOP_DE)} > {_VOTES(v.STOP_EN)} THEN 'de' ELSE 'en' END AS language FROM d""",
    "choose_text": """WITH d AS (SELECT doc_id, text, source, CASE WHEN doc_id % 5 > 0 THEN split_part(text, chr(10), 1) END AS a FROM documents),
 f AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN a ELSE text END AS whole FROM d),
 x AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [{'p': 'Own', 'c': source, 'ok': true}] ELSE [{'p': 'Abstract', 'c': a, 'ok': coalesce(a, '') <> ''}, {'p': 'Body', 'c': whole, 'ok': whole IS NOT NULL AND whole <> '' AND coalesce(a, '') <> whole}] END) AS x, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END)) AS i FROM f)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, x.p AS section_path, md5(x.c) AS digest FROM x WHERE x.ok""",
    "qa_source_filter": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), g AS (SELECT * FROM l WHERE i % 3 <> 1 AND length(x) > 100),
 h AS (SELECT doc_id, text, substr(text, 1, 3000) AS head FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)),
 c AS (SELECT *, greatest(CASE WHEN contains(head, '. ') THEN length(head) - instr(reverse(head), ' .') ELSE 0 END, CASE WHEN contains(head, chr(10)) THEN length(head) - instr(reverse(head), chr(10)) + 1 ELSE 0 END) AS cut FROM h)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, md5(x) AS digest FROM g UNION ALL SELECT doc_id, 0, md5(CASE WHEN length(text) <= 3000 THEN text WHEN cut > 2000 THEN substr(head, 1, cut) ELSE head END) FROM c""",
    "format_filter": """WITH d AS (SELECT ['text', 'xml', 'pdf', 'html'][doc_id % 4 + 1] AS format, doc_id % 3 > 0 AND source IS NOT NULL AS has FROM documents) SELECT format, format IN ('text', 'xml') OR (format = 'pdf' AND has) AS kept, count(*) AS n FROM d GROUP BY 1, 2""",
    "provisional_id": r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) SELECT w, w AS back FROM w WHERE w <> ''""",
    "detect_query_language": r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN NULL
 WHEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0.3 THEN 'zh'
 WHEN regexp_matches(text, '[äöüßÄÖÜ]') THEN 'de' ELSE 'en' END AS language FROM documents""",
    "token_estimate": r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor(1.3::DOUBLE * len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT)) END AS tokens FROM documents""",
    "junk_filter": rf"""WITH {_LINES} SELECT doc_id, count(*) AS junk_lines FROM lines WHERE length(regexp_replace(line, '[^\p{{L}}\p{{N}}_]|\s|[0-9]', '', 'g')) < 20 GROUP BY 1""",
    "paragraphs": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents)
SELECT doc_id, unnest(range(len(ps))) AS pos, md5(unnest(ps)) AS digest FROM p""",
    "sentences": r"""WITH s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS parts FROM s)
SELECT doc_id, len(parts) AS sentences, CAST(coalesce(list_sum(list_transform(parts, lambda p: length(p))), 0) AS BIGINT) AS chars FROM t""",
    "clean_title": r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(' - ' || array_to_string(list_slice(string_split(text, ' '), 1, 30), ' ') || '  .. ', '\s+', ' ', 'g'), '^[.\- ]+|[.\- ]+$', '', 'g') AS bare FROM documents)
SELECT doc_id, CASE WHEN bare = '' THEN 'Medical Reference' WHEN length(bare) > 100 THEN substr(bare, 1, 97) || '...' ELSE bare END AS title FROM b""",
    "truncate_at_sentence": r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 3000) AS head FROM documents),
c AS (SELECT *, greatest(CASE WHEN contains(head, '. ') THEN length(head) - instr(reverse(head), ' .') ELSE 0 END, CASE WHEN contains(head, chr(10)) THEN length(head) - instr(reverse(head), chr(10)) + 1 ELSE 0 END) AS cut FROM h)
SELECT doc_id, md5(CASE WHEN length(text) <= 3000 THEN text WHEN cut > 2000 THEN substr(head, 1, cut) ELSE head END) AS digest FROM c""",
    "query_cache_key": r"""SELECT doc_id, 'ner:' || lang || ':' || substr(sha256(nfc_normalize(lower(trim(text)))), 1, 16) AS key FROM documents""",
}
