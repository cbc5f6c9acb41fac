"""Queries on mentions: words of documents against a dictionary of frequent words, parts as concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocabulary as v
from ..functions.scratch import store
from ..operators import linking as l


def chunks(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")


def dictionary(spark, sf):
    """Words over five signs that occur in ten documents at least, typed by their length."""
    words = chunks(spark, sf).select("chunk_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("term")).where(F.rlike("term", F.lit("^[a-z]{6,}$")))
    frequent = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    kind = F.when(F.length("term") % 2 == 0, "Drug").otherwise("Disease")
    return frequent.select("term", kind.alias("entity_type"), F.round(F.least(F.lit(1.0), F.col("n") / 100), 2).alias("confidence"))


def spans(spark, sf):
    return l.recognise(chunks(spark, sf), dictionary(spark, sf), 0.25)


def no_false_positives(spark, sf):
    """Found words, each tenth of them under the name of a greeting, without greetings and without five that start a text."""
    found = store(spans(spark, sf), "spans")
    first = [r.text.lower() for r in found.where("start = 0").select("text").distinct().orderBy("text").limit(5).collect()]
    greeting = F.element_at(F.array(*[F.lit(x) for x in (" Hi ", "HALLO", "Tschüss", "hit")]), (F.col("start") % 4 + 1).cast("int"))
    named = found.withColumn("text", F.when(F.col("start") % 10 == 0, greeting).otherwise(F.col("text")))
    return l.drop_false_positives(named, "text", first).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def label_types(spark, sf):
    """Words of documents as a recogniser's labels, with their position's mark."""
    words = chunks(spark, sf).select("chunk_id", F.explode(F.split("text", r"\s+")).alias("w"))
    kinds = F.array(*[F.lit(x) for x in ("drug", "Disease", "SYMPTOM", "gene", "o", "unheard", "problem", "test")])
    raw = F.concat(F.when(F.col("chunk_id") % 3 == 0, "B-").when(F.col("chunk_id") % 3 == 1, "i_").otherwise(""), F.element_at(kinds, (F.length("w") % 8 + 1).cast("int")))
    return words.select("chunk_id", t.label_to_type(raw).alias("entity_type")).groupBy("chunk_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def valid_spans(spark, sf):
    """Every word, with its signs, that may be a span."""
    words = chunks(spark, sf).select("chunk_id", F.explode(F.split("text", " ")).alias("w"))
    return words.where(t.is_valid_span(F.col("w"))).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def mention_texts(spark, sf):
    """Each found span's text, cut from its chunk by its places."""
    rows = spans(spark, sf).join(chunks(spark, sf).withColumnRenamed("text", "whole"), "chunk_id")
    return rows.select("chunk_id", "start", t.mention_text(F.col("whole"), F.col("start"), F.col("end")).alias("cut"), "text")


def concept_types(spark, sf):
    """Parts' sizes and brands as tree numbers."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    heads = ["C14", "F03", "D12", "G05", "D02", "E01", "A07", "F01", "B01", "Z99", "C23.888"]
    pick = lambda n: F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (n % len(heads) + 1).cast("int")), F.lit(".1"))
    return p.select("p_partkey", t.concept_type(F.array(pick(F.col("p_partkey")), pick(F.col("p_size")))).alias("entity_type"))


def overlapping(spark, sf):
    """Spans that are eight signs longer, without those that overlap a better one of any type."""
    wide = F.transform("spans", lambda s: s.withField("end", s["end"] + 8))
    return _arrays(spark, sf).select("chunk_id", F.explode(l.drop_dominated(wide, any_type=True)).alias("s")).select("chunk_id", "s.start", "s.end", "s.text", "s.confidence")


def _arrays(spark, sf):
    made = F.array_sort(F.collect_list(F.struct("start", "end", "text", "entity_type", "confidence"))).alias("spans")
    return spans(spark, sf).groupBy("chunk_id").agg(made).join(chunks(spark, sf), "chunk_id")


def span_merge(spark, sf):
    rows = _arrays(spark, sf).select("chunk_id", F.explode(l.merge_adjacent(F.col("spans"), F.col("text"))).alias("s"))
    return rows.select("chunk_id", "s.*")


def span_drop(spark, sf):
    wide = F.transform("spans", lambda s: s.withField("end", s["end"] + 8))
    return _arrays(spark, sf).select("chunk_id", F.explode(l.drop_dominated(wide)).alias("s")).select("chunk_id", "s.start", "s.end", "s.text", "s.confidence")


def span_dedup(spark, sf):
    return l.dedup_mentions(spans(spark, sf)).select("chunk_id", "normalized", "entity_type", "confidence", "start", "cui")


def concepts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("cui"), F.col("p_name").alias("label"), F.substring_index("p_type", " ", 1).alias("entity_type"), F.array(F.col("p_brand")).alias("synonyms"), F.lit(None).cast("map<string,string>").alias("lang_labels"))


def link_exact(spark, sf):
    """Names of parts, upper-cased, back to parts."""
    names = concepts(spark, sf).select(F.upper("label").alias("name"))
    entities = concepts(spark, sf).select("cui", "label", "entity_type", F.lit("").alias("lang_zh"), F.lit("").alias("lang_de"))
    return l.lookup_names(names.distinct(), entities)


def link_mentions(spark, sf):
    """Part names with a sign left out, linked to parts."""
    mentions = concepts(spark, sf).select(F.concat(F.substring("label", 1, 4), F.substring("label", 6, 100)).alias("text"), "entity_type", F.lit(0.9).alias("confidence"))
    return l.link_mentions(mentions.distinct(), concepts(spark, sf)).select("text", "entity_type", "linked", F.round("link_score", 6).alias("link_score"))


def prefix_search(spark, sf):
    entities = concepts(spark, sf).select("cui", "label", "entity_type", F.lit("").alias("lang_zh"), F.lit("").alias("lang_de"))
    prefixes = entities.select(F.substring("label", 1, 3).alias("prefix")).distinct()
    return l.prefix_search(prefixes, entities, None, 10)


QUERIES = {
    "recognise": spans,
    "span_merge": span_merge,
    "span_drop": span_drop,
    "span_dedup": span_dedup,
    "drop_false_positives": no_false_positives,
    "label_to_type": label_types,
    "is_valid_span": valid_spans,
    "mention_text": mention_texts,
    "concept_types": concept_types,
    "dedup_overlapping": overlapping,
    "link_exact": link_exact,
    "link_mentions": link_mentions,
    "prefix_search": prefix_search,
}

_SPANS = r"""tok AS (SELECT doc_id AS chunk_id, unnest(regexp_split_to_array(text, '\s')) AS raw, unnest(range(len(regexp_split_to_array(text, '\s')))) AS pos FROM documents),
dict AS (SELECT term, CASE WHEN length(term) % 2 = 0 THEN 'Drug' ELSE 'Disease' END AS entity_type, round(least(1.0, count(*) / 100), 2) AS confidence
 FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents) WHERE regexp_full_match(term, '[a-z]{6,}') GROUP BY 1 HAVING count(*) >= 10),
placed AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM tok),
trim_ AS (SELECT chunk_id, at_ + length(regexp_extract(raw, '^([^\p{L}\p{N}]*)', 1)) AS start, regexp_extract(raw, '^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$', 1) AS text FROM placed),
spans AS (SELECT chunk_id, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end", text, entity_type, confidence FROM trim_ JOIN dict ON lower(text) = term WHERE confidence >= 0.25)"""
TERMS = _SPANS
#: The greedy drop of wider spans: one after another by confidence and start, against those kept so far.
_DROP = _SPANS + r""", ranked AS (SELECT *, "end" + 8 AS e, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, start, "end" + 8, text, entity_type) AS n FROM spans),
walk AS (SELECT chunk_id, n, [struct_pack(s := start, e := e, t := text, k := entity_type, c := confidence)] AS kept FROM ranked WHERE n = 1
 UNION ALL SELECT r.chunk_id, r.n, CASE WHEN len(list_filter(w.kept, lambda x: x.s < r.e AND r.start < x.e{same})) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(s := r.start, e := r.e, t := r.text, k := r.entity_type, c := r.confidence)) END
 FROM walk w JOIN ranked r ON r.chunk_id = w.chunk_id AND r.n = w.n + 1),
last_ AS (SELECT chunk_id, unnest(kept) AS x FROM walk QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC) = 1)
SELECT chunk_id, x.s AS start, x.e AS "end", x.t AS text, x.c AS confidence FROM last_"""

#: The rules over the built labels and tree numbers.
_LABELS = ", ".join(f"('{label}', '{kind}')" for kind, labels in v.TYPE_LABELS.items() for label in labels)
_TREE = "CASE " + " ".join(f"WHEN starts_with(x, '{prefix}') THEN '{kind}'" for prefix, kind in v.TREE_TYPES) + " END"
_HEADS = "['C14', 'F03', 'D12', 'G05', 'D02', 'E01', 'A07', 'F01', 'B01', 'Z99', 'C23.888']"


SQL = {
    "drop_false_positives": f"""WITH {_SPANS}, firsts AS (SELECT DISTINCT text FROM spans WHERE start = 0 ORDER BY text LIMIT 5) SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id, CASE WHEN start % 10 = 0 THEN [' Hi ', 'HALLO', 'Tschüss', 'hit'][start % 4 + 1] ELSE text END AS text FROM spans)
 WHERE lower(trim(text)) NOT IN (SELECT lower(text) FROM firsts) AND lower(trim(text)) NOT IN ({", ".join(f"'{x}'" for x in v.FALSE_POSITIVES)}) GROUP BY 1""",
    "label_to_type": rf"""WITH w AS (SELECT doc_id AS chunk_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents),
 raw AS (SELECT chunk_id, CASE chunk_id % 3 WHEN 0 THEN 'B-' WHEN 1 THEN 'i_' ELSE '' END || ['drug', 'Disease', 'SYMPTOM', 'gene', 'o', 'unheard', 'problem', 'test'][length(w) % 8 + 1] AS raw FROM w),
 known(label, kind) AS (VALUES {_LABELS})
SELECT chunk_id, CASE WHEN raw NOT IN ('O', 'o') THEN kind END AS entity_type, count(*) AS n FROM raw LEFT JOIN known ON label = lower(regexp_replace(raw, '^(?:[BIESbies]-|[BIESbies]_)', '')) GROUP BY 1, 2""",
    "is_valid_span": r"""WITH w AS (SELECT doc_id AS chunk_id, trim(unnest(string_split(text, ' '))) AS w FROM documents) SELECT chunk_id, count(*) AS n FROM w WHERE length(w) >= 2 AND NOT regexp_matches(w, '^\d+(\.\d+)?$')
 AND NOT regexp_matches(w, '(?i)^\d+\s?(mg|ml|g|kg|ug|mcg|mmol|ng|iu|u|%)\b') AND NOT regexp_matches(w, '^[^\p{L}\p{N}_]+$') AND NOT regexp_matches(w, '^[()''"“”‘’`\-+,;./\\]') AND NOT regexp_matches(w, '[,;]$') GROUP BY 1""",
    "mention_text": f"WITH {_SPANS} SELECT chunk_id, start, text AS cut, text FROM spans",
    "concept_types": f"""WITH k AS (SELECT p_partkey, list_transform([{_HEADS}[p_partkey % 11 + 1] || '.1', {_HEADS}[p_size % 11 + 1] || '.1'], lambda x: {_TREE}) AS k FROM part)
SELECT p_partkey, coalesce({", ".join(f"CASE WHEN list_contains(k, '{x}') THEN '{x}' END" for x in v.TYPE_PRIORITY)}, 'Unknown') AS entity_type FROM k""",
    "dedup_overlapping": "WITH RECURSIVE " + _DROP.replace("{same}", ""),
    "span_drop": "WITH RECURSIVE " + _DROP.replace("{same}", " AND x.k = r.entity_type"),
    "span_merge": f"""WITH RECURSIVE {_SPANS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY start, "end", text, entity_type, confidence) AS n FROM spans),
walk AS (SELECT chunk_id, n, 1 AS g, start, "end" AS e, entity_type AS k, confidence AS c FROM ranked WHERE n = 1
 UNION ALL SELECT r.chunk_id, r.n, CASE WHEN r.entity_type = w.k AND r.start <= w.e + 1 THEN w.g ELSE w.g + 1 END, CASE WHEN r.entity_type = w.k AND r.start <= w.e + 1 THEN w.start ELSE r.start END, r."end", r.entity_type,
  CASE WHEN r.entity_type = w.k AND r.start <= w.e + 1 THEN greatest(w.c, r.confidence) ELSE r.confidence END FROM walk w JOIN ranked r ON r.chunk_id = w.chunk_id AND r.n = w.n + 1),
last_ AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY chunk_id, g ORDER BY n DESC) = 1)
SELECT chunk_id, start, e AS "end", substr(documents.text, start + 1, e - start) AS text, k AS entity_type, c AS confidence FROM last_ JOIN documents ON doc_id = chunk_id""",
    "recognise": f"WITH {_SPANS} SELECT * FROM spans",
    "span_dedup": f"""WITH {_SPANS} SELECT chunk_id, lower(text) AS normalized, entity_type, confidence, start, 'MENTION:' || entity_type || ':' || lower(text) AS cui FROM spans
 QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(text), entity_type ORDER BY confidence DESC, start) = 1""",
    "link_exact": "SELECT upper(p_name) AS name, min('P' || p_partkey) AS cui FROM part GROUP BY 1",
    "prefix_search": """WITH e AS (SELECT 'P' || p_partkey AS cui, p_name AS label FROM part), p AS (SELECT DISTINCT substr(label, 1, 3) AS prefix FROM e)
SELECT prefix, cui, label, row_number() OVER (PARTITION BY prefix ORDER BY length(label), cui) AS rank FROM p JOIN e ON starts_with(label, prefix) QUALIFY rank <= 10""",
}
