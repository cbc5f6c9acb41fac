"""The tasks of co-occurrence follow the pairs, not the session's setting alone."""

from pyspark.sql import functions as F

from quillgraph.operators import graph as g


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(g, "TASK_PAIRS", 100)
    edges = spark.range(60 * 20).select((F.col("id") % 60).alias("entity"), F.floor(F.col("id") / 60).alias("chunk"))
    got = g.cooccurrence(edges)
    assert got.rdd.getNumPartitions() == 20 * (60 * 59 // 2) // 100
    assert got.groupBy("weight").count().collect() == [(20, 60 * 59 // 2)]
    assert g.cooccurrence(edges.limit(0)).collect() == []
