"""The stages of the corpus pipeline: language ID, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of documents; the last returns pieces of packed sequences.

Defined results: a null or empty text, or one without a letter, goes in the first stage; very long texts are taken whole; rows
with a null id stay rows of their own, and of two texts with one id each is kept or dropped by its text; of rows that are
equal as a whole one stays; ties in a component go to the smaller id, then to hashes; an empty table stays empty;
columns beyond those of documents are carried to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table
from .language_id import keep_identified, train
from .mixing import PRODUCTION, mix
from .packing import pack
from .simhash_similar import shingle_sets, similar_components

#: A calibrated probability below this says that the text is in no language that was learned; a guess among four has 0.25.
LEAST_SCORE = 0.34


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go."""
    return keep_identified(docs, train(docs), LEAST_SCORE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component (SimHash BK-trees; texts with a Jaccard similarity of 0.8 or more, by five words) stays.

    It is the first by id (null ids last), then by the hash of its shingles, then by that of
    the whole row; so a component without ids keeps one row, and one id with unlike texts one row for each.
    A row is known by two 64-bit hashes of different seeds.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"column{i}_" for i in range(len(columns))])  # names of our own: none can clash
    every = [*plain.columns, *[F.col(c).isNull() for c in plain.columns]]
    marked = plain.withColumn("row_", F.struct(F.xxhash64(*every).alias("a"), F.xxhash64(F.lit("second"), *every).alias("b")))
    marked = marked.withColumn("text", plain[plain.columns[columns.index("text")]]).withColumn("doc_id", plain[plain.columns[columns.index("doc_id")]])
    sets = store(shingle_sets(marked, ["doc_id", "row_"]), "near-shingles")
    group = F.coalesce("component", "sig").alias("group")
    rows = sets.select("doc_id", "sig", "row_").join(similar_components(sets, marked), "sig", "left").select(group, "doc_id", "sig", "row_")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig", "row_")).alias("x")
    kept = store(rows.groupBy("group").agg(first).select("x.row_"), "near-kept")
    # rows that are equal as a whole: one of them
    return marked.join(kept, "row_", "left_semi").dropDuplicates(["row_"]).select(*plain.columns).toDF(*columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; the clean domain grows, so its documents all stay."""
    return mix(docs, table(spark, sf_dir, "labels"), PRODUCTION)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)
