"""Spans and mentions: merging, dropping, looking up names, linking to concepts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocabulary as v
from ..functions.scratch import store
from .graph import best

SPAN = "array<struct<start: int, end: int, text: string, entity_type: string, confidence: double>>"


def _span(start: Column, end: Column, text: Column, kind: Column, confidence: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"), kind.alias("entity_type"), confidence.alias("confidence"))


def merge_adjacent(spans: Column, text: Column) -> Column:
    """Spans by start; one that starts at most one sign after the current one, with its type, joins it and sets its end (which may shrink)."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = _span(last["start"], s["end"], t.mention_text(text, last["start"], s["end"]), last["entity_type"], F.greatest(last["confidence"], s["confidence"]))
        touches = last.isNotNull() & (last["entity_type"] == s["entity_type"]) & (s["start"] <= last["end"] + 1)
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), step)


def drop_dominated(spans: Column, any_type: bool = False) -> Column:
    """Spans by confidence, then start; one that overlaps a kept one (of its type) goes."""
    order = F.transform(spans, lambda s: F.struct((-s["confidence"]).alias("c"), s["start"].alias("s"), s.alias("span")))

    def step(kept: Column, x: Column) -> Column:
        s = x["span"]
        hit = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]) & (F.lit(any_type) | (k["entity_type"] == s["entity_type"])))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(F.array_sort(order), F.array().cast(SPAN), step)


def dedup_mentions(spans: DataFrame) -> DataFrame:
    """The best span of each normalised text and type in a chunk, with its provisional id."""
    norm = F.lower(F.trim("text"))
    top = best(spans.withColumn("normalized", norm), ["chunk_id", "normalized", "entity_type"], [F.desc("confidence"), "start"], 1)
    return top.drop("rank").withColumn("cui", t.provisional_id(F.col("entity_type"), F.col("normalized")))


#: Bytes of terms that one automaton holds, and that every task is sent.
AUTOMATON_BYTES = 32 << 20
#: Characters on which words end.
SPACE = re.compile(r"\s")


def _lowered(text: str) -> str:
    """Lower case with every character in its place, white space as blanks."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return SPACE.sub(" ", low)


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether only signs lie between the place and the white space (or end) on both sides."""
    while start and text[start - 1] != " ":
        start -= 1
        if text[start].isalnum():
            return False
    while end < len(text) and text[end] != " ":
        if text[end].isalnum():
            return False
        end += 1
    return True


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in terms:
        out.add_word(term, term)
    out.make_automaton()
    return out


#: Texts that a task turns into strings at once, and hits after which it hands them on.
SCANNED, HELD_HITS = 256, 20_000


def _hits(batch: pa.RecordBatch, automaton: ahocorasick.Automaton) -> Iterator[pa.RecordBatch]:
    """The terms in a batch of (chunk_id, text), in batches of ``HELD_HITS`` and what is left of a text."""
    at, starts, ends, texts, terms = [], [], [], [], []

    def found() -> pa.RecordBatch:
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string()), pa.array(terms, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["chunk_id", "start", "end", "text", "term_"])

    for n, text in enumerate(batch.column(1).to_pylist()):
        low = _lowered(text)
        last_one = len(low)
        for last, term in automaton.iter(low):
            start, end = last + 1 - len(term), last + 1
            before, after = low[start - 1] if start else " ", low[end] if end < last_one else " "
            # most places within a word are seen by the signs beside them
            if before.isalnum() or after.isalnum() or not (before == after == " " or _stands_alone(low, start, end)):
                continue
            at.append(n)
            starts.append(start)
            ends.append(end)
            texts.append(text[start:end])
            terms.append(term)
        if len(at) >= HELD_HITS:
            yield found()
            at, starts, ends, texts, terms = [], [], [], [], []
    if at:
        yield found()


def recognise(chunks: DataFrame, dictionary: DataFrame, least_confidence: float = 0.25) -> DataFrame:
    """The default recogniser: terms of a dictionary (term, entity_type, confidence), of one word or several, with their places in chunks.

    An Aho-Corasick automaton finds all terms in one scan of a text, in any case; a term counts where it is cut off by white space and signs
    on both sides, and its words are parted by single white space. Texts stay where they are read, and only hits leave their row. The automaton is
    broadcast; terms of more than ``AUTOMATON_BYTES`` are dealt to several by hash, each with a scan of its own. Types and confidences are joined
    to the hits in the cluster. Terms that overlap are all given (see ``drop_dominated``).

    A null or empty text has no terms; blank terms and those with a null in the row do not count; repeated rows of the dictionary give repeated hits.
    """
    known = dictionary.where(F.col("confidence") >= least_confidence).select(F.lower(F.regexp_replace(F.trim("term"), r"\s", " ")).alias("term_"), "entity_type", "confidence")
    known = store(known.where("term_ <> '' and entity_type is not null"), "dictionary")
    size = known.agg(F.sum(F.octet_length("term_") + 64)).first()[0] or 0
    shards = -(-size // AUTOMATON_BYTES) or 1
    kind = dict(chunks.dtypes)["chunk_id"]
    rows = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for i in range(shards):
        terms = known.where(F.pmod(F.xxhash64("term_"), F.lit(shards)) == i).select("term_").distinct().toArrow()  # of bounded size
        shared = rows.sparkSession.sparkContext.broadcast(_automaton(terms.column(0).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows if len(shared.value) else 0, SCANNED):
                    yield from _hits(batch.slice(begin, SCANNED), shared.value)

        hits = rows.mapInArrow(run, f"chunk_id {kind}, start int, end int, text string, term_ string")
        found = hits if found is None else found.unionByName(hits)
    valid = found.where(t.is_valid_span(F.col("text")))
    return valid.join(known, "term_").select("chunk_id", "start", "end", "text", "entity_type", "confidence")


def drop_false_positives(mentions: DataFrame, label: str, more: list[str] | None = None) -> DataFrame:
    return mentions.where(~F.lower(F.trim(F.col(label))).isin(*v.FALSE_POSITIVES, *(more or [])))


def aliases(concepts: DataFrame) -> DataFrame:
    """``alias, cui, place``: label, language labels and synonyms of concepts, lower-cased; place 0 is the label."""
    names = F.concat(F.array("label"), F.coalesce(F.map_values("lang_labels"), F.array().cast("array<string>")), F.coalesce("synonyms", F.array().cast("array<string>")))
    rows = concepts.select("cui", F.posexplode(names).alias("place", "alias")).where("alias is not null and trim(alias) <> ''")
    return rows.groupBy(F.lower(F.trim("alias")).alias("alias"), "cui").agg(F.min("place").alias("place"))


def lookup_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``name, cui``: for each name an entity whose label (in any case) or language label is that name; labels first, then the smaller cui.

    An equi-join on exploded keys in place of an OR.
    """
    keys = entities.select("cui", F.explode(F.array(
        F.struct(F.lower("label").alias("k"), F.lit(0).alias("p"), F.lit(True).alias("lower")), F.struct(F.col("label").alias("k"), F.lit(1).alias("p"), F.lit(False).alias("lower")),
        F.struct(F.col("lang_zh").alias("k"), F.lit(1).alias("p"), F.lit(False).alias("lower")), F.struct(F.col("lang_de").alias("k"), F.lit(1).alias("p"), F.lit(False).alias("lower")),
    )).alias("x")).select("cui", "x.*")
    asked = names.select("name", F.explode(F.array(F.struct(F.lower("name").alias("k"), F.lit(True).alias("lower")), F.struct(F.col("name").alias("k"), F.lit(False).alias("lower")))).alias("x")).select("name", "x.*")
    return best(asked.join(keys, ["k", "lower"]), ["name"], ["p", "cui"], 1).select("name", "cui")


def prefix_search(prefixes: DataFrame, entities: DataFrame, types: list[str] | None = None, limit: int = 10, key: int = 2) -> DataFrame:
    """``prefix, cui, label, rank``: entities with a name that starts so, shortest label first. Joined on the first ``key`` signs; shorter prefixes are matched on their own length."""
    rows = entities.where(F.col("entity_type").isin(*types)) if types else entities
    names = rows.select("cui", "label", F.explode(F.array_distinct(F.filter(F.array("label", "lang_zh", "lang_de"), lambda x: x.isNotNull() & (x != "")))).alias("n"))
    heads = names.select("cui", "label", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(key), F.length("n")))).alias("l")).withColumn("k", F.substring("n", F.lit(1), F.col("l")))
    asked = prefixes.where("prefix <> ''").select("prefix", F.least(F.lit(key), F.length("prefix")).alias("l")).withColumn("k", F.substring("prefix", F.lit(1), F.col("l")))
    hits = asked.join(heads, ["l", "k"]).where(F.startswith("n", F.col("prefix"))).select("prefix", "cui", "label").distinct()
    return best(hits, ["prefix"], [F.length("label"), "cui"], limit)


def _grams(text: Column, n: int = 3) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substring(padded, i, F.lit(n))))


def string_ratio(left: str, right: str, least: float = 0.0) -> Column:
    """Matching-blocks ratio of two text columns, in Arrow batches; 0 where lengths or letter counts show that it is below ``least``."""

    def one(x: str, y: str) -> float:
        m = difflib.SequenceMatcher(None, x, y)
        return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return ratio(F.col(left), F.col(right))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length: the quick measure, with scores of its own."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def string_rerank(pairs: DataFrame, concepts: DataFrame, least: float = 0.70) -> DataFrame:
    """``text, cui, score``: of each text's candidates (text, cui) the one whose label, synonym or language label is most like it, from ``least``; ties to the smaller cui."""
    # of concepts with one alias only the smallest cui can be chosen, so each text meets each spelling once
    spelt = pairs.select("text", "cui").distinct().join(aliases(concepts), "cui").groupBy("text", "alias").agg(F.min("cui").alias("cui")).withColumn("low_", F.lower("text"))
    scored = spelt.withColumn("score", F.round(string_ratio("low_", "alias", least), 9))
    # filtered last: a filter on the score would be moved below the aggregate and compare every copy
    return best(scored.select("text", "cui", "score"), ["text"], [F.desc("score"), "cui"], 1).where(F.col("score") >= least).drop("rank")


def gold_found(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold concepts (sample, cui) with ``found``: whether the sample's predictions hold the concept."""
    hits = predicted.select("sample", "cui").distinct().withColumn("hit_", F.lit(True))
    return gold.join(hits, ["sample", "cui"], "left").withColumn("found", F.coalesce("hit_", F.lit(False))).drop("hit_")


def link_mentions(mentions: DataFrame, concepts: DataFrame, accept: float = 0.75, accept_other: float = 0.70, least_string: float = 0.70, pool: int = 50) -> DataFrame:
    """Mentions (text, entity_type, confidence) with ``cui, link_score, linked``.

    Each distinct (text, type) is linked once. A text that is an alias of its own type has a score of 1, which nothing is above, so it is
    linked by an equi-join. Candidates of the others: aliases that share character
    trigrams, the ``pool`` most alike by cosine; those of the mention's own type if any. The best is taken
    at ``accept`` (``accept_other`` for texts beyond ASCII), else the one with the best string ratio, from ``least_string``. Of equally good ones the greatest cui counts.
    """
    every = mentions.select("text", "entity_type").distinct()
    names = aliases(concepts)
    kinds = concepts.select("cui", F.col("entity_type").alias("concept_type"))
    same = names.join(kinds, "cui").groupBy("alias", F.col("concept_type").alias("entity_type")).agg(F.max("cui").alias("cui"))
    exact = every.withColumn("alias", F.lower("text")).join(same, ["alias", "entity_type"]).select("text", "entity_type", F.struct("cui", F.lit(1.0).alias("score")).alias("c"))
    exact = store(exact, "link-exact")
    asked = every.join(exact, ["text", "entity_type"], "left_anti")
    left = asked.withColumn("g", _grams(F.col("text"))).select("text", "entity_type", F.size("g").alias("na"), F.explode("g").alias("gram"))
    # spellings are compared once, whatever number of concepts shares them
    spelt = names.select("alias").distinct().withColumn("g", _grams(F.col("alias")))
    right = spelt.select("alias", F.size("g").alias("nb"), F.explode("g").alias("gram"))
    shared = left.join(right, "gram").groupBy("text", "entity_type", "alias", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    alike = shared.withColumn("score", F.col("n") / F.sqrt(F.col("na") * F.col("nb"))).drop("na", "nb", "n")
    # a concept after the first ``pool`` of its spelling has as many smaller ones before it that score no less
    first = best(names.select("alias", "cui"), ["alias"], ["cui"], pool).drop("rank")
    scored = alike.join(first, "alias").groupBy("text", "entity_type", "cui").agg(F.max("score").alias("score"), F.max_by("alias", F.struct("score", "alias")).alias("alias"))
    pooled = best(scored, ["text", "entity_type"], [F.desc("score"), "cui"], pool).join(kinds, "cui")
    own = F.max(F.col("concept_type") == F.col("entity_type")).over(Window.partitionBy("text", "entity_type"))
    kept = pooled.withColumn("own", own).where("not own or concept_type = entity_type").withColumn("low", F.lower("text"))
    kept = kept.withColumn("string", string_ratio("low", "alias", least_string))
    ascii_ = ~F.rlike("text", F.lit(r"[^\x00-\x7f]"))
    direct = F.when(ascii_, F.col("score") >= accept).otherwise(F.col("score") >= accept_other)
    top = kept.groupBy("text", "entity_type").agg(
        F.max_by(F.struct("cui", "score"), F.when(direct, F.struct("score", "string", "cui"))).alias("vector"),
        F.max_by(F.struct("cui", F.col("string").alias("score")), F.when(F.col("string") >= least_string, F.struct("string", "score", "cui"))).alias("lexical"),
    )
    chosen = top.select("text", "entity_type", F.coalesce("vector", "lexical").alias("c")).unionByName(exact)
    joined = mentions.join(chosen, ["text", "entity_type"], "left")
    return joined.select(*mentions.columns, F.col("c.cui").alias("cui"), F.col("c.score").alias("link_score"), F.col("c").isNotNull().alias("linked"), F.least("confidence", F.coalesce("c.score", F.lit(0.0))).alias("link_confidence"))


def overlap_match(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``sample, text, entity_type, gold, predicted`` for precision and recall: a prediction matches a gold entity of its type if one text holds the other (spaces aside).

    Each gold entity is used once, both sides in the order of their texts. A sample is one sentence, so its lists are short.
    """
    item, made = "struct<text: string, entity_type: string>", "array<struct<text: string, entity_type: string, gold: boolean, predicted: boolean>>"
    lists = lambda df, name: df.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("text", "entity_type"))).alias(name))
    both = lists(gold, "free").join(lists(predicted, "said"), "sample", "full")
    none = F.array().cast(f"array<{item}>")
    squash = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", ""))
    row = lambda x, g, p: F.struct(x["text"].alias("text"), x["entity_type"].alias("entity_type"), g.alias("gold"), p.alias("predicted"))
    yes = F.lit(True)

    def step(acc: Column, p: Column) -> Column:
        fits = lambda x: (x["entity_type"] == p["entity_type"]) & (F.contains(squash(p["text"]), squash(x["text"])) | F.contains(squash(x["text"]), squash(p["text"])))
        hit = F.get(F.filter(acc["free"], fits), F.lit(0))
        at = F.coalesce(F.array_position(acc["free"], hit), F.lit(0)).cast("int")
        rest = F.when(at > 0, F.concat(F.slice(acc["free"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["free"], at + 1, F.size(acc["free"])))).otherwise(acc["free"])
        return F.struct(rest.alias("free"), F.concat(acc["out"], F.array(row(p, at > 0, yes))).alias("out"))

    start = F.struct(F.coalesce("free", none).alias("free"), F.array().cast(made).alias("out"))
    finish = lambda acc: F.concat(acc["out"], F.transform(acc["free"], lambda x: row(x, yes, F.lit(False))))
    return both.select("sample", F.explode(F.aggregate(F.coalesce("said", none), start, step, finish)).alias("x")).select("sample", "x.*")


def in_batches(df: DataFrame, model, schema: str) -> DataFrame:
    """Runs a pluggable model (pandas frame -> pandas frame) over a table in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(model, batches)

    return df.mapInPandas(run, schema)
