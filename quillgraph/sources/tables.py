"""Keyed upserts and upkeep of the stored tables. A new version is a new folder; what points to the current one is moved when it is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: list | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; of several new ones the first by ``newest`` counts."""
    order = newest or [F.col(c).desc_nulls_last() for c in new.columns if c not in keys] or keys
    once = new.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)


def upsert_chunks(old: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, from_doc edges): edges only to known documents; parents' texts are not kept with chunks."""
    chunks = upsert(old.drop("parent_text"), new.drop("parent_text"), ["chunk_id"])
    return chunks, chunks.select("chunk_id", "doc_id").join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def upsert_entities(old: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities by type and cui, one mention edge for each and chunk): the last mention by chunk and place wins; Unknown ones are not kept."""
    known = mentions.where("entity_type <> 'Unknown' and cui is not null").withColumns({"start": F.coalesce("start", F.lit(-1)), "end": F.coalesce("end", F.lit(-1))})
    rows = known.select("entity_type", "cui", "label", "confidence", "chunk_id", "start")
    once = rows.withColumn("n_", F.row_number().over(Window.partitionBy("entity_type", "cui").orderBy(F.desc("chunk_id"), F.desc("start"), F.desc("confidence")))).where("n_ = 1").drop("n_", "chunk_id", "start")
    edge = Window.partitionBy("entity_type", "cui", "chunk_id").orderBy("start", "end")
    edges = known.withColumn("n_", F.row_number().over(edge)).where("n_ = 1").select("entity_type", "cui", "chunk_id", "mention_text", "start", "end")
    return upsert(old, once, ["entity_type", "cui"]), edges


def upsert_communities(old: DataFrame, old_members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communities, members): earlier members stay."""
    members = new.select("community_id", F.explode("members").alias("cui"))
    return upsert(old, new, ["community_id"]), old_members.unionByName(members).distinct()


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "chunk_id", vector: str = "dense") -> tuple[DataFrame, DataFrame]:
    """(vectors, a row that says how many new ones had none)."""
    return upsert(old, new.where(F.col(vector).isNotNull()), [key]), new.agg(F.count_if(F.col(vector).isNull()).alias("skipped"))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_OID) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def patch_payload(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Sets a patch's columns where it has a value; other columns, vectors too, stay."""
    fields = [c for c in patch.columns if c != key]
    joined = rows.join(patch.select(key, *[F.col(c).alias(f"{c}_new") for c in fields]), key, "left")
    return joined.withColumns({c: F.coalesce(f"{c}_new", c) for c in fields if c in rows.columns}).select(rows.columns)


def delete_by(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def purge_junk(chunks: DataFrame, edges: DataFrame, junk: Column) -> tuple[DataFrame, DataFrame]:
    """(chunks, edges) without junk; entities stay."""
    kept = chunks.where(~F.coalesce(junk, F.lit(False)))
    return kept, edges.join(kept.select("chunk_id"), "chunk_id", "left_semi")


def snapshot(df: DataFrame, folder: str, stage: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{stage}")


def recover(spark: SparkSession, folder: str, stage: str) -> DataFrame | None:
    """A stage's table if it was saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{stage}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/{stage}") if found else None


def pipeline_summary(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, n`` of several tables in one plan."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def latest_status(updates: DataFrame) -> DataFrame:
    """The last update of each domain."""
    return updates.groupBy("domain").agg(F.max_by(F.struct(*[c for c in updates.columns if c != "domain"]), "updated_at").alias("s")).select("domain", "s.*")


def append_dedup(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with each key's last occurrence, a row with how many were removed). Both have a column ``pos``."""
    both = old.withColumn("batch_", F.lit(0)).unionByName(new.withColumn("batch_", F.lit(1)), allowMissingColumns=True)
    ranked = both.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch_"), F.desc("pos"))))
    return ranked.where("n_ = 1").drop("n_", "batch_"), ranked.agg(F.count_if(F.col("n_") > 1).alias("removed"))


def write_if_absent(new: DataFrame, stored: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    return upsert(stored, new, [key]) if overwrite else stored.unionByName(new.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def parent_text_backfill(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """``chunk_id, parent_text, how``: a chunk's section, the longest of its path, else its group's chunks in reading order; only what changes.

    chunks: chunk_id, source_id, section_path, text, page, char_offset, parent_text; sections: source_id, section_path, content.
    """
    key = ["source_id", "section_path"]
    longest = sections.groupBy(*key).agg(F.max_by("content", F.struct(F.length("content").alias("n"), F.col("content").alias("c"))).alias("section"))
    order = F.array_sort(F.collect_list(F.struct(F.col("page").isNull().alias("a"), "page", F.col("char_offset").isNull().alias("b"), "char_offset", "chunk_id", "text")))
    joined = chunks.groupBy(*key).agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n\n").alias("whole"))
    rows = chunks.join(longest, key, "left").join(joined, key, "left").withColumn("new", F.coalesce("section", "whole"))
    return rows.where(~F.col("new").eqNullSafe(F.col("parent_text"))).select("chunk_id", F.col("new").alias("parent_text"), F.when(F.col("section").isNotNull(), "section").otherwise("fallback").alias("how"))
