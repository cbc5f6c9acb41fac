"""Quality metrics, table checks and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.scratch import store
from .graph import best


def hashed(seed: str, *columns: str) -> Column:
    """An order without pattern that any engine gives alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


# samples


def stratified_sample(rows: DataFrame, by: str, id_col: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows of each stratum at most, by hash."""
    return best(rows.withColumn("h_", hashed(seed, id_col)), [by], ["h_", id_col], n).drop("h_")


def round_robin(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """One row of each group in turn, groups in their names' order, up to ``limit``."""
    placed = rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return placed.where(F.col("turn") <= limit).orderBy("turn", by).limit(limit).drop("turn")


def topic_quota(rows: DataFrame, id_col: str, text: str, topics: list[tuple[str, str]], n: int) -> DataFrame:
    """``id_col, topic``: each topic in order takes its first ``n`` rows that hold its word and no earlier topic took.

    A topic's rows are among its first n * (number of topics), as earlier ones take n each at most; so one
    pass over the texts ranks these, and the turns are taken on a table of bounded size.
    """
    flags = [F.when(F.contains(F.lower(text), F.lit(word)), F.lit(i)) for i, (_, word) in enumerate(topics)]
    hits = rows.select(id_col, F.explode(F.array_compact(F.array(*flags))).alias("t_"))
    left = store(best(hits, ["t_"], [id_col], n * len(topics)).drop("rank"), "topics")
    taken = None
    for i, (topic, _) in enumerate(topics):
        mine = left.where(F.col("t_") == i)
        if taken is not None:
            mine = mine.join(taken.select(id_col), id_col, "left_anti")
        got = store(mine.orderBy(id_col).limit(n).select(id_col, F.lit(topic).alias("topic")), "topics-taken")
        taken = got if taken is None else taken.unionByName(got)
    return taken


def quota_by_label(rows: DataFrame, label: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each label; rows without one do not count."""
    return best(rows.where(F.col(label).isNotNull()), [label], order, n).drop("rank")


def long_enough(rows: DataFrame, text: str, order: list, n: int, least: int = 200) -> DataFrame:
    """The first ``n`` rows with ``least`` signs or more."""
    return rows.where(F.length(text) >= least).orderBy(*order).limit(n)


def context_groups(rows: DataFrame, id_col: str, text: str, strata: str, size: int = 3, groups: int | None = None, seed: str = "g") -> DataFrame:
    """``strata, group, context``: rows in hash order, ``size`` to a group, numbered.

    ``groups`` asks for so many in each stratum; a pool that is too short is dealt again from its
    start, in another order, as often as is needed. Without it, every row is used once. A stratum's pool is a sample, so it is small.
    """
    counted = rows.withColumn("pool_", F.count(F.lit(1)).over(Window.partitionBy(strata)))
    again = F.ceil(F.lit((groups or 0) * size) / F.col("pool_")) if groups else F.lit(1)
    dealt = counted.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), again).cast("int") - 1)))
    order = [F.col("deal_"), F.md5(F.concat_ws(":", F.lit(seed), F.nullif(F.col("deal_"), F.lit(0)).cast("string"), F.col(id_col).cast("string"))), F.col(id_col)]
    placed = dealt.withColumn("n_", F.row_number().over(Window.partitionBy(strata).orderBy(*order)) - 1)
    lines = placed.withColumns({"group": F.floor(F.col("n_") / size).cast("long"), "p_": (F.col("n_") % size + 1).cast("int")})
    if groups:
        lines = lines.where(F.col("group") < groups)
    line = F.concat(F.lit("["), F.col("p_").cast("string"), F.lit("] "), F.col(text))
    return lines.groupBy(strata, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_", line.alias("x_")))), lambda x: x["x_"]), "\n").alias("context"))


def synonym_holdout(concepts: DataFrame, seed: str = "h") -> DataFrame:
    """``cui, query, synonyms``: one synonym of each concept, by hash, taken out as its query. Concepts with one or none have no query."""
    names = concepts.select("cui", F.explode(F.array_distinct("synonyms")).alias("s")).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "cui", "s")))
    picked = names.groupBy("cui").agg(F.min_by("s", "h").alias("query"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return concepts.join(picked, "cui").select("cui", "query", F.array_remove("synonyms", F.col("query")).alias("synonyms"))


def weighted_bucket(seed: str, weights: dict[str, int], *columns: str) -> Column:
    """A choice by weight, fixed by hash."""
    at, out = 0, F.lit(None).cast("string")
    place = F.pmod(F.conv(F.substring(hashed(seed, *columns), 1, 8), 16, 10).cast("long"), F.lit(sum(weights.values())))
    for name, w in weights.items():
        at += w
        out = F.coalesce(out, F.when(place < at, name))
    return out


# metrics


def prf1(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 from boolean columns gold and predicted; 0 where there is nothing to divide by."""
    both, gold, said = F.count_if(F.col("gold") & F.col("predicted")), F.count_if("gold"), F.count_if("predicted")
    sums = pairs.groupBy(*by).agg(both.alias("tp"), gold.alias("gold"), said.alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = sums.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("gold"))})
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("gold", "said")


def category_mean(rows: DataFrame, by: str, scores: list[str]) -> DataFrame:
    """Mean of each score in each category; rows without a score do not count for it."""
    return rows.groupBy(by).agg(*[F.avg(c).alias(c) for c in scores])


def top1_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """``right, judged, skipped, accuracy`` of columns expected and predicted: what has nothing expected is skipped, no prediction is wrong."""
    judged = F.count_if(F.col("expected").isNotNull())
    right = F.count_if(F.col("expected").eqNullSafe(F.col("predicted")) & F.col("expected").isNotNull())
    sums = rows.groupBy(*by).agg(right.alias("right"), judged.alias("judged"), F.count_if(F.col("expected").isNull()).alias("skipped"))
    return sums.withColumn("accuracy", F.coalesce(F.try_divide("right", "judged"), F.lit(0.0)))


def testset(rows: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """A generator's columns by our names; columns that it did not give are null."""
    named = rows.withColumnsRenamed(names)
    return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in columns])


def shortfall(rows: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """``by, made, wanted, short``: how many rows each group still lacks. wanted: by, wanted."""
    made = rows.groupBy(by).agg(F.count(F.lit(1)).alias("made"))
    return wanted.join(made, by, "left").select(by, F.coalesce("made", F.lit(0)).cast("long").alias("made"), "wanted", F.greatest(F.lit(0), F.col("wanted") - F.coalesce("made", F.lit(0))).cast("long").alias("short"))


def hit_mrr(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Hit at 1 and 5 and mean reciprocal rank of ``rank``, null where the target was not found."""
    mean = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return ranks.groupBy(*by).agg(mean(F.col("rank") <= 1).alias("hit1"), mean(F.col("rank") <= 5).alias("hit5"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def compare_runs(scores: DataFrame, runs: list[str], least: float) -> DataFrame:
    """``metric``, a column for each run, and whether each passes. scores: run, metric, value."""
    wide = scores.groupBy("metric").pivot("run", runs).agg(F.max("value"))
    return wide.select("metric", *runs, *[(F.col(r) >= least).alias(f"{r}_passes") for r in runs])


def answer_score(answer: Column, cited: Column, expected: Column) -> Column:
    """Citation set .25 (.12 for a superset), marks .15, substance or refusal .25, cited sentences .35; 0 at least."""
    cited_set, wanted = F.array_distinct(cited), F.array_distinct(expected)
    refusal_due = F.size(expected) == 0
    lacks, extra = F.size(F.array_except(wanted, cited_set)), F.size(F.array_except(cited_set, wanted))
    sets = F.when((lacks == 0) & (extra == 0), 0.25).when(lacks == 0, 0.12).otherwise(0.0)
    marked = F.forall(cited, lambda c: F.contains(answer, F.concat(F.lit("["), c.cast("string"), F.lit("]"))))
    marks = F.when(F.size(cited) > 0, F.when(marked, 0.15).otherwise(0.0)).otherwise(F.when(refusal_due, 0.15).otherwise(0.0))
    refuses = F.lit(False)
    for word in v.REFUSALS:
        refuses = refuses | F.contains(answer, F.lit(word))
    substance = F.when(refusal_due, F.when(refuses, 0.25).otherwise(0.0)).otherwise(F.when(refuses, -0.25).when(F.length(answer) > 50, 0.25).otherwise(0.0))
    sentences = F.filter(F.transform(F.split(answer, r"[。!?！？\n]|\.\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 15)
    has = lambda s: F.rlike(s, F.lit(r"\[\d+\]"))
    share = F.size(F.filter(sentences, has)) / F.size(sentences)
    density = F.when(refusal_due, 0.35).when(F.size(sentences) == 0, F.when(has(answer), 0.35).otherwise(0.0)).otherwise(0.35 * share)
    return F.greatest(F.lit(0.0), sets + marks + substance + density)


def rewrite_score(tier_right: Column, match: Column, rewritten: Column) -> Column:
    """A wrong tier leaves .3; then .85 for the judged match and .15 for length."""
    return F.when(tier_right, 1.0).otherwise(0.3) * (0.85 * match + 0.15 * F.least(F.lit(1.0), F.length(rewritten) / 80))


def rewrite_feedback(tier: Column, expected_tier: Column, match: Column, rewritten: Column) -> Column:
    """What a rewritten query lacks, as one line."""
    notes = F.array(
        F.when(tier != expected_tier, F.concat(F.lit("Tier "), tier, F.lit(" instead of "), expected_tier)),
        F.when(match < 0.5, F.lit("The rewritten query says something else")),
        F.when(F.length(rewritten) < 80, F.lit("The rewritten query is short")),
    )
    return F.array_join(F.array_compact(notes), "; ")


def feedback(cited: Column, expected: Column, uncited: Column) -> Column:
    """What an answer's citations lack, as one line."""
    lacks, extra = F.array_except(expected, cited), F.array_except(cited, expected)
    note = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs.cast("array<string>"), ", ")))
    notes = F.array(note("Missing citations: ", lacks), note("Extra citations: ", extra), F.when(uncited > 0, F.concat(uncited.cast("string"), F.lit(" sentences without a citation"))))
    return F.array_join(F.filter(notes, lambda x: x.isNotNull()), "; ")


# table checks


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``digest, n, first_id`` of texts that occur more than once; ids are counted, not gathered, as a group may be huge."""
    return df.groupBy(F.md5(text).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def text_occurrences(df: DataFrame, id_col: str, text: str, phrase: str, preview: int = 100) -> DataFrame:
    return df.where(F.contains(text, F.lit(phrase))).select(id_col, F.substring(text, 1, preview).alias("preview"))


def label_flags(label: Column, cui: Column, entity_type: Column, stop_words: list[str], hints: dict[str, list[str]]) -> dict[str, Column]:
    """Why a label may not be an entity."""
    t = F.trim(label)
    hinted = F.lit(False)
    for kind, words in hints.items():
        for w in words:
            hinted = hinted | ((entity_type == kind) & F.contains(F.lower(label), F.lit(w)))
    return {
        "short": F.length(t) <= 3,
        "punctuation": F.rlike(t, F.lit(r"(?U)^[^\w]+$")),
        "stop_word": F.lower(t).isin(*stop_words),
        "number": F.rlike(t, F.lit(r"(?i)^\d+(\.\d+)?$|^\d+\s?(mg|ml|g|kg|ug|mcg|mmol|μg|ng|iu|u|%|x|×)\b")),
        "unresolved": F.startswith(cui, F.lit("MENTION:")),
        "mismatch": hinted,
    }


def near_duplicate_labels(entities: DataFrame) -> DataFrame:
    """``entity_type, first, other``: labels that are the same without their last s's and e's, each with the first of them. entities: entity_type, label."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("label")), "s+$", ""), "e+$", "")
    w = Window.partitionBy("entity_type", "key").orderBy("label")
    return entities.distinct().withColumn("key", key).withColumns({"first": F.first("label").over(w), "p": F.row_number().over(w)}).where("p > 1").select("entity_type", "first", F.col("label").alias("other"))
