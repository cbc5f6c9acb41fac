import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as t


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


FREQUENCIES = [
    ("take twice daily", "en", "take bid"), ("q12h", "en", "bid"), ("three times daily", "en", "tid"), ("four times a day", "en", "qid"), ("once daily", "en", "qd"), ("daily", "en", "qd"),
    ("every 4 hours", "en", "q4h"), ("as needed", "en", "prn"), ("at bedtime", "en", "qhs"), ("2x täglich", "de", "bid"), ("dreimal täglich", "de", "tid"), ("einmal täglich", "de", "qd"),
    ("bei Bedarf", "de", "prn"), ("zur Nacht", "de", "qhs"), ("bis die", "de", "bid"), ("每日两次", "zh", "bid"), ("一天三次", "zh", "tid"), ("每日一次", "zh", "qd"), ("每4小时一次", "zh", "q4h"), ("必要时", "zh", "prn"),
]
DOSES = [("500mg", "500 mg"), ("50mcg", "50 mcg"), ("50µg", "50 mcg"), ("1000milligrams", "1000 mg"), ("0.5Grams", "0.5 g"), ("500 mg", "500 mg"), ("10ml and 2 Units", "10 mL and 2 units"), ("5 mgx", "5 mgx")]


def test_normalisation(spark):
    rows = spark.createDataFrame([(i, x, g, w) for i, (x, g, w) in enumerate(FREQUENCIES)], "i int, x string, g string, w string")
    got = rows.withColumn("y", t.normalize_frequency(F.col("x"), F.col("g"))).where("y <> w").collect()
    assert not got, got
    rows = spark.createDataFrame(DOSES, "x string, w string").withColumn("y", t.normalize_units(F.col("x"))).where("y <> w").collect()
    assert not rows, rows


def test_splitting(spark):
    assert one(spark, t.paragraphs(F.col("a")), a="A.\n\n\nB.\n\n ") == ["A.", "B."]
    assert one(spark, t.sentences(F.col("a"), F.lit("en")), a="One. Two? three. Four 1.5 mg.") == ["One.", "Two? three.", "Four 1.5 mg."]
    assert one(spark, t.sentences(F.col("a"), F.lit("zh")), a="一。二？三") == ["一。", "二？", "三"]
    units, sizes = F.array(*[F.lit(x) for x in ("aa", "bbb", "c")]), F.array(F.lit(2), F.lit(3), F.lit(1))
    assert [one(spark, t.overlap_tail(units, sizes, n)) for n in (0, 1, 5, 9)] == [[], ["c"], ["bbb", "c"], ["aa", "bbb", "c"]]


def plain_pack(units, size, most, overlap, joiner, split=None):
    done, held = [], []
    tail = lambda: next((held[i:] for i in range(len(held) + 1) if sum(map(size, held[i:])) <= overlap and all(sum(map(size, held[j:])) <= overlap for j in range(i, len(held)))), [])
    for u in units:
        if split and size(u) > most:
            if held:
                done.append(joiner.join(held))
            held = tail()
            done += split(u)
        elif sum(map(size, held)) + size(u) <= most:
            held = held + [u]
        else:
            if held:
                done.append(joiner.join(held))
            held = tail() + [u]
    return done + ([joiner.join(held)] if held else [])


def test_chunks_equal_a_plain_loop(spark):
    size = lambda u: max(1, int(len(u.split()) * 1.3)) if u else 0
    paragraphs = [" ".join(f"w{i}{j}" for j in range(n)) for i, n in enumerate((30, 10, 5, 60, 3, 20, 28))]
    long = ". ".join(" ".join(f"X{i}{j}" for j in range(12)) for i in range(20)) + "."
    text = "\n\n".join([*paragraphs[:4], long, *paragraphs[4:]])
    import re

    split = lambda u: plain_pack([s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", u)], size, 60, 15, " ")
    want = plain_pack(text.split("\n\n"), size, 60, 15, "\n\n", split)
    got = spark.createDataFrame([(text,)], "a string").select(t.chunk_section(F.col("a"), F.lit("en"), 60, 15).alias("x")).first().x
    assert got == want and len(got) > 5
    assert one(spark, t.chunk_section(F.col("a"), F.lit("en")), a="short") == ["short"] and one(spark, t.chunk_section(F.col("a"), F.lit("en")), a=" ") == []


@pytest.mark.parametrize(("raw", "kind"), [("B-disease", "Disease"), ("I_chem", "Drug"), ("O", None), ("药物", "Drug"), ("nonsense", None), ("S-SYM", "Symptom"), ("M", "Unknown")])
def test_labels(spark, raw, kind):
    assert one(spark, t.label_to_type(F.col("a")), a=raw) == kind


def test_spans_concepts_titles(spark):
    valid = {"aspirin": True, "a": False, "500": False, "5 mg": False, "--": False, "(x)": False, "word,": False, "糖尿病": True, "x-1": True}
    assert {a: one(spark, t.is_valid_span(F.col("a")), a=a) for a in valid} == valid
    trees = {("C14.280",): "Disease", ("F03.600",): "Disease", ("D02.145",): "Drug", (): "Unknown", ("Z99",): "Unknown", ("D12.1", "D08.2"): "Gene", ("C23.888.1", "C1"): "Symptom", ("G05",): "Gene", ("G07",): "Physiology"}
    for numbers, kind in trees.items():
        assert one(spark, t.concept_type(F.array(*[F.lit(n) for n in numbers]).cast("array<string>"))) == kind
    assert one(spark, t.clean_title(F.col("a")), a="HIGHLIGHTS OF PRESCRIBING INFORMATION  A  b. -") == "A b"
    assert one(spark, t.clean_title(F.col("a")), a="") == "Unknown Source" and len(one(spark, t.clean_title(F.col("a")), a="x" * 200)) == 100
    assert [one(spark, t.recency_label(F.lit(n).cast("int"))) for n in (None, 0, 5, 65)] == ["previously", "today", "5d ago", "2mo ago"]
    assert one(spark, t.provisional_text(t.provisional_id(F.lit("Drug"), F.lit("warfarin")))) == "warfarin"
    assert one(spark, t.coerce_citations(F.array(F.lit("[1]"), F.lit("2"), F.lit("x")))) == [1, 2]
    assert one(spark, t.mention_text(F.col("a"), F.lit(2), F.lit(5)), a="abcdef") == "cde"


def test_languages_and_verdicts(spark):
    want = {"": "en", "糖尿病": "zh", "der Mann ist mit dem Hund von hier": "de", "the man is here": "en"}
    assert {a: one(spark, t.detect_language(F.col("a")), a=a) for a in want} == want
    want = {"123": None, "Was für": "de", "糖尿病 abc": "zh", "hello": "en"}
    assert {a: one(spark, t.detect_query_language(F.col("a")), a=a) for a in want} == want
    want = {"safe": True, "unsafe\nS6": True, "unsafe\nS6, S2": False, "unsafe": False, "maybe": True}
    assert {a: one(spark, t.moderation_allowed(F.col("a")), a=a) for a in want} == want
    assert one(spark, t.estimate_tokens(F.col("a"), F.lit("en")), a="a b　c") == 3 and one(spark, t.estimate_tokens(F.col("a"), F.lit("en")), a="") == 0
    assert one(spark, t.is_junk(F.col("a"), F.lit("en")), a="12 - 34 ... short") is True
