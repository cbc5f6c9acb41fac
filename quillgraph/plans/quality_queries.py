"""Samples, metrics and table checks over documents, parts, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stratified(spark, sf):
    rows = table(spark, sf, "documents").where(F.length("text") >= 80)
    return q.stratified_sample(rows, "lang", "doc_id", 60).select("lang", "doc_id", "rank")


def context_groups(spark, sf):
    rows = q.stratified_sample(table(spark, sf, "documents"), "lang", "doc_id", 30)
    return q.context_groups(rows, "doc_id", "text", "lang").select("lang", "group", F.md5("context").alias("digest"))


def refilled_groups(spark, sf):
    """Eight groups a language from seven documents each: the pools are dealt four times."""
    rows = q.stratified_sample(table(spark, sf, "documents"), "lang", "doc_id", 7)
    return q.context_groups(rows, "doc_id", "text", "lang", groups=8).select("lang", "group", F.md5("context").alias("digest"))


TOPICS = [("drinks", "the"), ("land", "and"), ("sea", "de")]


def category_mean(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return q.category_mean(rows, "lang", ["quality", "toxic"]).select("lang", *[F.round(c, 6).alias(c) for c in ("quality", "toxic")])


def prf1(spark, sf):
    """A document is called toxic if it holds one of three words."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    pairs = rows.select("lang", (F.col("toxic") == 1).alias("gold"), F.rlike(F.lower("text"), F.lit("idiot|loser|clown")).alias("predicted"))
    return q.prf1(pairs, ["lang"]).select("lang", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def hit_mrr(spark, sf):
    rank = F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int"))
    return q.hit_mrr(table(spark, sf, "lineitem").select("l_returnflag", rank.alias("rank")), ["l_returnflag"]).select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "mrr")])


def _cited(n):
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3)))


def answers(spark, sf):
    """Whole documents as answers, with marks by their ids."""
    n = F.col("doc_id") % 4
    text = F.concat("text", F.when(n == 0, " sorry").when(n == 1, " [1]. And a further sentence [2]").when(n == 2, "[3]").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.round(q.answer_score(text, _cited(n), _cited(F.col("doc_id") % 3)), 6).alias("score"))


def feedback(spark, sf):
    return table(spark, sf, "documents").select("doc_id", q.feedback(_cited(F.col("doc_id") % 4), _cited(F.col("doc_id") % 3), (F.length("text") % 3).cast("int")).alias("notes"))


def missing_and_extra(spark, sf):
    """Words of each conversation's answers that its questions lack, and the other way round, by their numbers."""
    words = lambda role: F.flatten(F.collect_list(F.when(F.col("role") == role, F.split(F.lower("text"), r"\s+"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(words("user").alias("a"), words("assistant").alias("b"))
    return rows.select("conv_id", F.size(F.array_except("a", "b")).cast("long").alias("missing"), F.size(F.array_except("b", "a")).cast("long").alias("extra"))


def rewrites(spark, sf):
    """Documents as rewritten queries: a judge's match is the share of their length in a thousand."""
    match = F.least(F.lit(1.0), F.length("text") / 1000)
    tier, want = F.element_at(F.array(*[F.lit(x) for x in ("SMALL", "MEDIUM", "LARGE")]), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("MEDIUM")
    return table(spark, sf, "documents").select("doc_id", F.round(q.rewrite_score(tier == want, match, F.col("text")), 6).alias("score"), q.rewrite_feedback(tier, want, match, F.col("text")).alias("notes"))


STOPS = ["in", "the", "red", "hot", "sky"]


def label_pollution(spark, sf):
    p = table(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("label"), F.concat(F.when(F.col("p_partkey") % 7 == 0, "MENTION:").otherwise("C"), "p_partkey").alias("cui"), F.substring_index("p_type", " ", 1).alias("t"))
    flags = q.label_flags(F.col("label"), F.col("cui"), F.col("t"), STOPS, {"SMALL": ["e"]})
    return p.select(*[flags[k].alias(k) for k in flags]).agg(*[F.count_if(F.col(k)).alias(k) for k in flags], F.count_if(F.array_max(F.array(*[F.col(k) for k in flags]))).alias("suspect"))


def near_duplicate_labels(spark, sf):
    words = table(spark, sf, "documents").select(F.col("lang").alias("entity_type"), F.explode(F.split("text", r"\s+")).alias("label")).where(F.length("label") > 3)
    return q.near_duplicate_labels(words)


def compare_runs(spark, sf):
    """Labels' quality and harmlessness as two runs, a language a metric."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    scores = rows.groupBy(F.col("lang").alias("metric")).agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(1 - F.avg("toxic"), 6).alias("harmless"))
    long = scores.select("metric", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("harmless"), "harmless")).alias("run", "value"))
    return q.compare_runs(long, ["quality", "harmless"], 0.72)


def holdout(spark, sf):
    concepts = table(spark, sf, "part").select(F.col("p_partkey").alias("cui"), F.split("p_name", " ").alias("synonyms"))
    return q.synonym_holdout(concepts).select("cui", "query", F.array_join("synonyms", " ").alias("synonyms"))


QUERIES = {
    "stratified_sample": stratified,
    "round_robin": lambda s, d: q.round_robin(table(s, d, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 50),
    "topic_quota": lambda s, d: q.topic_quota(table(s, d, "documents"), "doc_id", "text", TOPICS, 12),
    "context_groups": context_groups,
    "category_mean": category_mean,
    "prf1": prf1,
    "hit_mrr": hit_mrr,
    "answer_score": answers,
    "citation_feedback": feedback,
    "missing_and_extra": missing_and_extra,
    "rewrite_score": rewrites,
    "context_refill": refilled_groups,
    "label_pollution": label_pollution,
    "near_duplicate_labels": near_duplicate_labels,
    "compare_runs": compare_runs,
    "synonym_holdout": holdout,
    "weighted_bucket": lambda s, d: table(s, d, "documents").select("doc_id", q.weighted_bucket("w", {"small": 3, "medium": 4, "large": 3}, "doc_id").alias("tier")),
    "uniqueness": lambda s, d: q.uniqueness(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]),
    "duplicate_texts": lambda s, d: q.duplicate_texts(table(s, d, "documents"), "doc_id", "text"),
    "text_occurrences": lambda s, d: q.text_occurrences(table(s, d, "documents"), "doc_id", "text", "idiot"),
}

_H = "md5('{0}:' || {1})"
_TOPIC = """t{n} AS (SELECT doc_id, '{topic}' AS topic FROM documents WHERE contains(lower(text), '{word}') AND doc_id NOT IN (SELECT doc_id FROM {prev}) ORDER BY doc_id LIMIT 12), a{n} AS (SELECT * FROM {prev} UNION ALL SELECT * FROM t{n})"""


def _topics() -> str:
    parts = ["a0 AS (SELECT NULL::BIGINT AS doc_id, NULL AS topic WHERE false)"]
    for i, (topic, word) in enumerate(TOPICS, 1):
        parts.append(_TOPIC.format(n=i, topic=topic, word=word, prev=f"a{i - 1}"))
    return f"WITH {', '.join(parts)} SELECT * FROM a{len(TOPICS)}"


SQL = {
    "stratified_sample": f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H.format('s', 'doc_id')}, doc_id) AS rank FROM documents WHERE length(text) >= 80 QUALIFY rank <= 60",
    "round_robin": "WITH t AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT lang, doc_id FROM t ORDER BY turn, lang LIMIT 50",
    "topic_quota": _topics(),
    "context_groups": f"""WITH s AS (SELECT lang, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H.format('s', 'doc_id')}, doc_id) <= 30),
 p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H.format('g', 'doc_id')}, doc_id) - 1 AS n FROM s)
SELECT lang, n // 3 AS "group", md5(string_agg('[' || (n % 3 + 1) || '] ' || text, chr(10) ORDER BY n)) AS digest FROM p GROUP BY 1, 2""",
    "category_mean": "SELECT lang, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "prf1": """WITH r AS (SELECT lang, toxic = 1 AS g, regexp_matches(lower(text), 'idiot|loser|clown') AS p FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT lang, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE g) AS ng, count(*) FILTER (WHERE p) AS np FROM r GROUP BY 1),
 m AS (SELECT lang, tp, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(ng, 0), 0) AS recall FROM s)
SELECT lang, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM m""",
    "hit_mrr": """WITH r AS (SELECT l_returnflag, CASE WHEN l_quantity <= 40 THEN l_quantity::INT END AS rank FROM lineitem)
SELECT l_returnflag, round(avg(coalesce(rank <= 1, false)::INT), 6) AS hit1, round(avg(coalesce(rank <= 5, false)::INT), 6) AS hit5, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM r GROUP BY 1""",
    "label_pollution": """WITH p AS (SELECT split_part(p_name, ' ', 1) AS label, p_partkey % 7 = 0 AS unresolved, split_part(p_type, ' ', 1) AS t FROM part),
 f AS (SELECT length(label) <= 3 AS short, regexp_matches(label, '^[^\\w]+$') AS punctuation, lower(label) IN ('in', 'the', 'red', 'hot', 'sky') AS stop_word, regexp_matches(label, '^\\d+$') AS number, unresolved, t = 'SMALL' AND contains(label, 'e') AS mismatch FROM p)
SELECT count(*) FILTER (WHERE short) AS short, count(*) FILTER (WHERE punctuation) AS punctuation, count(*) FILTER (WHERE stop_word) AS stop_word, count(*) FILTER (WHERE number) AS number,
 count(*) FILTER (WHERE unresolved) AS unresolved, count(*) FILTER (WHERE mismatch) AS mismatch, count(*) FILTER (WHERE short OR punctuation OR stop_word OR number OR unresolved OR mismatch) AS suspect FROM f""",
    "near_duplicate_labels": r"""WITH w AS (SELECT DISTINCT lang AS entity_type, label FROM (SELECT lang, unnest(regexp_split_to_array(text, '\s+')) AS label FROM documents) WHERE length(label) > 3),
 k AS (SELECT *, regexp_replace(regexp_replace(lower(trim(label)), 's+$', ''), 'e+$', '') AS key FROM w),
 f AS (SELECT entity_type, label, min(label) OVER (PARTITION BY entity_type, key) AS first FROM k) SELECT entity_type, first, label AS other FROM f WHERE label <> first""",
    "compare_runs": """WITH s AS (SELECT lang AS metric, round(avg(quality), 6) AS quality, round(1 - avg(toxic), 6) AS harmless FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, quality >= 0.72 AS quality_passes, harmless >= 0.72 AS harmless_passes FROM s""",
    "context_refill": """WITH s AS (SELECT lang, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) <= 7),
 d AS (SELECT *, unnest(range(4)) AS deal FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY deal, md5('g:' || CASE WHEN deal > 0 THEN deal || ':' ELSE '' END || doc_id), doc_id) - 1 AS n FROM d)
SELECT lang, n // 3 AS "group", md5(string_agg('[' || (n % 3 + 1) || '] ' || text, chr(10) ORDER BY n)) AS digest FROM p WHERE n < 24 GROUP BY 1, 2""",
    "citation_feedback": """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [1, 2] ELSE [3] END AS c, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN [1, 2] ELSE [3] END AS e, length(text) % 3 AS u FROM documents)
SELECT doc_id, concat_ws('; ', CASE WHEN len(list_filter(e, lambda x: NOT list_contains(c, x))) > 0 THEN 'Missing citations: ' || array_to_string(list_filter(e, lambda x: NOT list_contains(c, x)), ', ') END,
 CASE WHEN len(list_filter(c, lambda x: NOT list_contains(e, x))) > 0 THEN 'Extra citations: ' || array_to_string(list_filter(c, lambda x: NOT list_contains(e, x)), ', ') END, CASE WHEN u > 0 THEN u || ' sentences without a citation' END) AS notes FROM d""",
    "missing_and_extra": r"""WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, (SELECT count(*) FROM w WHERE w.conv_id = c.conv_id AND role = 'user' AND w NOT IN (SELECT x.w FROM w x WHERE x.conv_id = c.conv_id AND x.role = 'assistant')) AS missing,
 (SELECT count(*) FROM w WHERE w.conv_id = c.conv_id AND role = 'assistant' AND w NOT IN (SELECT x.w FROM w x WHERE x.conv_id = c.conv_id AND x.role = 'user')) AS extra FROM c""",
    "rewrite_score": """WITH d AS (SELECT doc_id, doc_id % 3 AS t, least(1.0::DOUBLE, length(text) / 1000) AS m, length(text) AS n FROM documents)
SELECT doc_id, round(CASE WHEN t = 1 THEN 1.0 ELSE 0.3 END * (0.85 * m + 0.15 * least(1.0::DOUBLE, n / 80)), 6) AS score,
 concat_ws('; ', CASE t WHEN 0 THEN 'Tier SMALL instead of MEDIUM' WHEN 2 THEN 'Tier LARGE instead of MEDIUM' END, CASE WHEN m < 0.5 THEN 'The rewritten query says something else' END, CASE WHEN n < 80 THEN 'The rewritten query is short' END) AS notes FROM d""",
    "synonym_holdout": """WITH p AS (SELECT p_partkey AS cui, string_split(p_name, ' ') AS names FROM part), n AS (SELECT cui, names, unnest(list_distinct(names)) AS s FROM p),
 q AS (SELECT cui, arg_min(s, md5('h:' || cui || ':' || s)) AS query FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT cui, query, array_to_string(list_filter(names, lambda x: x <> query), ' ') AS synonyms FROM q JOIN p USING (cui)""",
    "weighted_bucket": "SELECT doc_id, CASE WHEN b < 3 THEN 'small' WHEN b < 7 THEN 'medium' ELSE 'large' END AS tier FROM (SELECT doc_id, ('0x' || substr(md5('w:' || doc_id), 1, 8))::BIGINT % 10 AS b FROM documents)",
    "uniqueness": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "duplicate_texts": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "text_occurrences": "SELECT doc_id, substr(text, 1, 100) AS preview FROM documents WHERE contains(text, 'idiot')",
    "answer_score": r"""WITH d AS (SELECT doc_id, doc_id % 4 AS n, doc_id % 3 AS m, text || CASE doc_id % 4 WHEN 0 THEN ' sorry' WHEN 1 THEN ' [1]. And a further sentence [2]' WHEN 2 THEN '[3]' ELSE '' END AS a FROM documents),
 x AS (SELECT *, CASE n WHEN 0 THEN [] WHEN 1 THEN [1, 2] ELSE [3] END AS c, CASE m WHEN 0 THEN [] WHEN 1 THEN [1, 2] ELSE [3] END AS e,
  list_filter(list_transform(regexp_split_to_array(a, '[。!?！？\n]|\.\s+'), lambda s: trim(s)), lambda s: length(s) > 15) AS ss FROM d),
 y AS (SELECT *, contains(a, 'sorry') OR contains(a, 'not enough') OR contains(a, 'cannot identify') AS r, len(list_filter(ss, lambda s: regexp_matches(s, '\[\d+\]'))) AS k FROM x)
SELECT doc_id, round(greatest(0, CASE WHEN c = e THEN 0.25 WHEN len(e) = 0 THEN 0.12 ELSE 0 END
 + CASE WHEN len(c) > 0 THEN CASE WHEN (n = 1) OR (n = 2) OR contains(a, '[3]') THEN 0.15 ELSE 0 END WHEN m = 0 THEN 0.15 ELSE 0 END
 + CASE WHEN m = 0 THEN CASE WHEN r THEN 0.25 ELSE 0 END WHEN r THEN -0.25 WHEN length(a) > 50 THEN 0.25 ELSE 0 END
 + CASE WHEN m = 0 THEN 0.35 WHEN len(ss) = 0 THEN CASE WHEN regexp_matches(a, '\[\d+\]') THEN 0.35 ELSE 0 END ELSE 0.35 * k / len(ss) END), 6) AS score FROM y""",
}
