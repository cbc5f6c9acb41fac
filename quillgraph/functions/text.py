"""Text functions as Column expressions: language, tokens, chunks, normalisation, labels, titles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as v

CJK = r"[\x{4e00}-\x{9fff}]"
WIDE_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """Split at Unicode white space, empty ones dropped."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def lookup(keys: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])[key]


# language


def detect_language(text: Column) -> Column:
    """zh with any CJK sign; else the language of most stop words (en, de); under two characters, or a tie: en."""
    bag = words(F.lower(text))
    votes = lambda stop: F.size(F.filter(bag, lambda w: w.isin(*stop)))
    return F.when(F.length(text) < 2, "en").when(F.rlike(text, F.lit(CJK)), "zh").when(votes(v.STOP_DE) > votes(v.STOP_EN), "de").otherwise("en")


def detect_query_language(text: Column) -> Column:
    """zh if over 0.3 of the letters are CJK; de with an umlaut; null without letters; else en."""
    letters = count(text, r"(?U)\p{L}")
    return (
        F.when(letters == 0, F.lit(None)).when(count(text, WIDE_CJK) / letters > 0.3, "zh").when(F.rlike(text, F.lit("[äöüßÄÖÜ]")), "de").otherwise("en")
    )


# tokens, junk, splitting


def estimate_tokens(text: Column, language: Column) -> Column:
    """0 for no text, else 1 at least: 1.3 a word; for zh 0.75 a sign and 1.3 an ASCII word."""
    zh = F.floor(count(text, CJK) * 0.75 + count(text, r"[a-zA-Z0-9]+") * 1.3)
    other = F.floor(F.size(words(text)) * 1.3)
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.when(language == "zh", zh).otherwise(other))).cast("int")


def is_junk(text: Column, language: Column) -> Column:
    """Too little is left without punctuation, spaces and digits."""
    left = F.length(F.regexp_replace(text, r"(?U)[^\w]|\s|\d", ""))
    return left < F.when(language == "zh", 8).otherwise(20)


def paragraphs(text: Column, separator: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def sentences(text: Column, language: Column) -> Column:
    zh = F.split(text, "(?<=[。？！…])")
    other = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\x{4e00}-\x{9fff}])")
    parts = F.when(language == "zh", zh).otherwise(other)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def overlap_tail(units: Column, tokens: Column, budget: int) -> Column:
    """The longest suffix of ``units`` whose tokens sum to ``budget`` at most. tokens: as many numbers."""
    pairs = F.reverse(F.arrays_zip(units.alias("u"), tokens.alias("t")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        more = acc["n"] + x["t"]
        full = acc["full"] | (more > budget)
        return F.struct(
            F.when(full, acc["kept"]).otherwise(F.concat(F.array(x["u"]), acc["kept"])).alias("kept"), F.when(full, acc["n"]).otherwise(more).alias("n"), full.alias("full")
        )

    return F.aggregate(pairs, start, step, lambda acc: acc["kept"])


def greedy_pack(units: Column, language: Column, most: int = 300, overlap: int = 50, joiner: str = "\n\n", split=None) -> Column:
    """Chunks of consecutive units with ``most`` tokens at most; each starts with the tail of the one before that fits in ``overlap``.

    A unit over ``most`` is packed by itself with ``split`` (unit -> its chunks), and the tail before it stays for what follows.
    A unit's tokens are counted once, and go with it.
    """
    held_type = "array<struct<u: string, n: int>>"
    counted = F.transform(units, lambda u: F.struct(u.alias("u"), estimate_tokens(u, language).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(held_type).alias("held"), F.lit(0).alias("n"))
    total = lambda held: F.aggregate(held, F.lit(0), lambda s, x: s + x["n"])

    def tail(held: Column) -> Column:
        """The longest suffix within the overlap."""
        empty = F.struct(F.array().cast(held_type).alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def back(acc: Column, x: Column) -> Column:
            full = acc["full"] | (acc["n"] + x["n"] > overlap)
            return F.when(full, F.struct(acc["kept"].alias("kept"), acc["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
                F.struct(F.concat(F.array(x), acc["kept"]).alias("kept"), (acc["n"] + x["n"]).alias("n"), F.lit(False).alias("full"))
            )

        return F.aggregate(F.reverse(held), empty, back, lambda acc: acc["kept"])

    def flush(acc: Column) -> Column:
        text = F.array_join(F.transform(acc["held"], lambda x: x["u"]), joiner)
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(text))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        added = F.struct(acc["done"].alias("done"), F.concat(acc["held"], F.array(x)).alias("held"), (acc["n"] + x["n"]).alias("n"))
        left = tail(acc["held"])
        moved = F.struct(flush(acc).alias("done"), F.concat(left, F.array(x)).alias("held"), (total(left) + x["n"]).alias("n"))
        out = F.when(acc["n"] + x["n"] <= most, added).otherwise(moved)
        if split is not None:
            apart = F.struct(F.concat(flush(acc), split(x["u"])).alias("done"), left.alias("held"), total(left).alias("n"))
            out = F.when(x["n"] > most, apart).otherwise(out)
        return out

    return F.aggregate(counted, start, step, flush)


def sentence_pack(text: Column, language: Column, most: int = 300, overlap: int = 50) -> Column:
    return greedy_pack(sentences(text, language), language, most, overlap, " ")


def chunk_section(text: Column, language: Column, most: int = 300, overlap: int = 50, separator: str = r"\n{2,}") -> Column:
    """The whole section if it fits, else packed paragraphs; none for a blank one."""
    packed = greedy_pack(paragraphs(text, separator), language, most, overlap, "\n\n", lambda u: sentence_pack(u, language, most, overlap))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).when(estimate_tokens(text, language) <= most, F.array(text)).otherwise(packed)


def choose_sections(sections: Column, abstract: Column, full_text: Column) -> Column:
    """Sections if any; else the abstract, and the full text if it says something else. array<struct<section_path, content>>"""
    part = lambda name, x: F.struct(F.lit(name).alias("section_path"), x.alias("content"))
    other = F.filter(
        F.array(part("Abstract", abstract), F.when(F.coalesce(abstract, F.lit("")) != full_text, part("Body", full_text))),
        lambda s: s.isNotNull() & (F.coalesce(s["content"], F.lit("")) != ""),
    )
    return F.when(F.size(sections) > 0, sections).otherwise(other)


# normalisation


def normalize_frequency(text: Column, language: Column) -> Column:
    """Dosing frequencies to their codes, by the language's rules in order; unknown languages use those of en."""

    def applied(rules: list[tuple[str, list[str]]], flags: str) -> Column:
        out = text
        for code, patterns in rules:
            for p in patterns:
                out = F.regexp_replace(out, flags + p, code)
        return out

    return F.when(language == "zh", applied(v.FREQUENCY_ZH, "(?U)")).when(language == "de", applied(v.FREQUENCY_DE, "(?iU)")).otherwise(applied(v.FREQUENCY_EN, "(?iU)"))


def normalize_units(text: Column) -> Column:
    """"500mg" to "500 mg", and unit names to their signs; one pass per sign over numbers that no earlier pass has marked."""
    mark = "\x00"
    out = F.regexp_replace(text, rf"(?iU)(\d+(?:[.,]\d+)?)\s*({v.UNIT_ALTERNATIVES})(?![a-zA-Z])", f"$1 {mark}$2{mark}")
    for unit, names in v.UNITS.items():
        out = F.regexp_replace(out, f"(?iu){mark}(?:{'|'.join(names)}){mark}", unit)
    # units without a sign of their own are only lower-cased
    kept = F.split(out, mark)
    return F.array_join(F.transform(kept, lambda x, i: F.when(i % 2 == 1, F.lower(F.regexp_replace(x, r"\s+", " "))).otherwise(x)), "")


def normalize(text: Column, language: Column) -> Column:
    return normalize_units(normalize_frequency(text, language))


# labels and spans


def label_to_type(raw: Column) -> Column:
    """Entity type of a recogniser's label: its position prefix goes, O and unknown labels are null."""
    bare = F.regexp_replace(F.trim(raw), r"^(?:[BIESbies]-|[BIESbies]_)", "")
    return F.when(F.trim(raw).isin("O", "o"), F.lit(None)).otherwise(lookup({x: t for t, labels in v.TYPE_LABELS.items() for x in labels}, F.lower(bare)))


def is_valid_span(text: Column) -> Column:
    t = F.trim(text)
    no = [r"^\d+(\.\d+)?$", r"(?i)^\d+\s?(mg|ml|g|kg|ug|mcg|mmol|ng|iu|u|%)\b", r"(?U)^[^\w]+$", r"""^[()'"\x{201c}\x{201d}\x{2018}\x{2019}`\-+,;./\\]""", r"[,;]$"]
    out = F.length(t) >= 2
    for p in no:
        out = out & ~F.rlike(t, F.lit(p))
    return out


def mention_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def provisional_id(entity_type: Column, normalized: Column) -> Column:
    return F.concat_ws(":", F.lit("MENTION"), entity_type, normalized)


def provisional_text(cui: Column) -> Column:
    return F.regexp_extract(cui, "^MENTION:(?:[^:]*:)?(.*)$", 1)


def concept_type(tree_numbers: Column) -> Column:
    """The most useful type among a concept's tree numbers; each number has the type of its first fitting prefix."""
    of = F.lit(None).cast("string")
    has = lambda x, p: F.startswith(x, F.lit(p))

    def kind(x: Column) -> Column:
        out = of
        for prefix, name in reversed(v.TREE_TYPES):
            out = F.when(has(x, prefix), name).otherwise(out)
        return out

    found = F.transform(tree_numbers, kind)
    return F.coalesce(*[F.when(F.array_contains(found, name), name) for name in v.TYPE_PRIORITY], F.lit("Unknown"))


# titles, sources, answers


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def query_cache_key(query: Column, language: Column) -> Column:
    """Same for queries that differ in case, outer spaces and how their letters are composed. Only texts beyond ASCII leave the JVM for that."""
    low = F.lower(F.trim(query))
    other = F.when(F.rlike(low, F.lit(r"[^\x00-\x7f]")), low)
    return F.concat(F.lit("ner:"), language, F.lit(":"), F.substring(F.sha2(F.coalesce(composed(other), low), 256), 1, 16))


def clean_title(title: Column) -> Column:
    bare = title
    for phrase in v.TITLE_BOILERPLATE:
        bare = F.replace(bare, F.lit(phrase), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"^[.\- ]+|[.\- ]+$", "")
    cut = F.when(F.length(bare) > 100, F.concat(F.substring(bare, 1, 97), F.lit("..."))).otherwise(bare)
    return F.when(F.coalesce(title, F.lit("")) == "", "Unknown Source").when(bare == "", "Medical Reference").otherwise(cut)


def truncate_at_sentence(text: Column, most: int = 3000, least: int = 2000) -> Column:
    """Up to the last full stop or line end in the first ``most`` characters, if it lies beyond ``least``."""
    head = F.substring(text, 1, most)
    last = lambda sign: F.length(head) - F.locate(sign[::-1], F.reverse(head)) - len(sign) + 2
    place = lambda sign: F.when(F.locate(sign, head) > 0, last(sign)).otherwise(0)
    cut = F.greatest(place(". "), place("\n"))
    return F.when(F.length(text) <= most, text).when(cut > least, F.substring(head, F.lit(1), cut)).otherwise(head)


def recency_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "previously").when(days < 1, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d ago"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )


def moderation_categories(verdict: Column) -> Column:
    """The categories that a moderator's second line names."""
    second = F.get(F.split(F.trim(verdict), "\n"), F.lit(1))
    return F.transform(F.split(F.upper(F.trim(F.coalesce(second, F.lit("unknown")))), ","), lambda x: F.trim(x))


def moderation_allowed(verdict: Column) -> Column:
    """Whether a moderator's answer lets a text pass: not said to be unsafe, or unsafe for specialised advice (S6) alone."""
    first = F.trim(F.get(F.split(F.lower(F.trim(verdict)), "\n"), F.lit(0)))
    found = moderation_categories(verdict)
    hard = F.array(*[F.lit(f"S{i}") for i in range(1, 15) if i != 6])
    return F.startswith(first, F.lit("safe")) | ~F.contains(first, F.lit("unsafe")) | (F.array_contains(found, "S6") & ~F.arrays_overlap(found, hard))


def moderation_verdict(verdict: Column) -> Column:
    """struct<safe, categories, allowed>; a safe text has no categories."""
    safe = ~F.contains(F.lower(F.get(F.split(F.trim(verdict), "\n"), F.lit(0))), F.lit("unsafe"))
    return F.struct(safe.alias("safe"), F.when(safe, F.array().cast("array<string>")).otherwise(moderation_categories(verdict)).alias("categories"), moderation_allowed(verdict).alias("allowed"))


def coerce_citations(raw: Column) -> Column:
    """["[1]", "2", "x"] to [1, 2]."""
    return F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"^[\[\]\s]+|[\[\]\s]+$", "").try_cast("int")), lambda x: x.isNotNull())


def parse_tier(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return F.when(t.isin("SMALL", "MEDIUM", "LARGE"), t).otherwise("LARGE")


def parse_language(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t.isin("en", "zh", "de"), t)


def node_label(zh: Column, de: Column, label: Column, name: Column, cui: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (zh, de, label, name, cui)], F.lit("?"))


def dose_sentences(text: Column) -> Column:
    """Sentences that hold a number with a unit."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)[^.!?。\n]*\d+(?:[.,]\d+)?\s*(?:" + v.UNIT_ALTERNATIVES + r")(?![a-zA-Z])[^.!?。\n]*"), F.lit(0))


def dose_table(docs: DataFrame, text: str, language: str, n: int | None = None, seed: str = "d") -> DataFrame:
    """``language, sentence, normalized, changed``: distinct sentences with a dose, ``n`` of them by hash (all without), and what normalising makes of each."""
    rows = docs.select(F.col(language).alias("language"), F.explode(dose_sentences(F.col(text))).alias("sentence"))
    rows = rows.select("language", F.trim("sentence").alias("sentence")).distinct()
    if n is not None:
        rows = rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "language", "sentence")), "sentence").limit(n)
    return rows.withColumn("normalized", normalize(F.col("sentence"), F.col("language"))).withColumn("changed", F.col("normalized") != F.col("sentence"))


def qa_source(sections: Column, full_text: Column, skip: list[str], least: int = 100) -> Column:
    """Texts for questions: sections without a skipped word in their title and over ``least`` signs, else the cut full text."""

    def good(s: Column) -> Column:
        out = F.length(s["content"]) > least
        for word in skip:
            out = out & ~F.contains(F.lower(s["title"]), F.lit(word.lower()))
        return out

    kept = F.transform(F.filter(sections, good), lambda s: s["content"])
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(truncate_at_sentence(full_text)))


def can_be_parsed(format_: Column, file_path: Column) -> Column:
    """Text and XML always, PDF with a path; nothing else."""
    return format_.isin("text", "xml") | ((format_ == "pdf") & file_path.isNotNull())
