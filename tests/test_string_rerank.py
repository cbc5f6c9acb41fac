import difflib

from pyspark.sql import functions as F

from quillgraph.operators import linking as l


def test_each_spelling_is_compared_once(spark, monkeypatch):
    """Forty concepts under two labels: a text meets two spellings, and the smallest cui of the better one is taken."""
    seen = spark.sparkContext.accumulator(0)

    def counted(left, right, least=0.0):
        @F.udf("double")
        def ratio(a, b):
            seen.add(1)
            return difflib.SequenceMatcher(None, a, b).ratio()

        return ratio(F.col(left), F.col(right))

    monkeypatch.setattr(l, "string_ratio", counted)
    concepts = spark.range(40).selectExpr("concat('C', id) as cui", "if(id % 2 = 0, 'Aspirin', 'Aspirant') as label", "array(cast(null as string)) as synonyms", "cast(null as map<string,string>) as lang_labels")
    pairs = concepts.select(F.lit("Asprin").alias("text"), "cui").unionByName(concepts.select(F.lit("Aspirant").alias("text"), "cui"))
    got = {(x.text, x.cui, x.score) for x in l.string_rerank(pairs, concepts).collect()}
    assert got == {("Asprin", "C0", round(difflib.SequenceMatcher(None, "asprin", "aspirin").ratio(), 9)), ("Aspirant", "C1", 1.0)}
    assert seen.value <= 8  # four pairs, and as many again where Spark evaluates the filter apart
