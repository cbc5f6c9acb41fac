"""Documents to chunks, mentions and entities: one build for whole tables and for each batch of a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as t
from ..operators import linking as l
from ..sources.tables import upsert

#: Tables of a build. Documents are written last: rows of the others count only with their document.
TABLES = ("chunks", "mentions", "documents")


@dataclass(frozen=True)
class Build:
    """What a build needs besides documents: the recogniser's dictionary (term, entity_type, confidence), the concepts that mentions are linked to, and the chunks' sizes."""

    dictionary: DataFrame
    concepts: DataFrame
    most_tokens: int = 300
    overlap: int = 50
    #: Whether spans of one type that touch become one.
    merge: bool = True

    def once(self, documents: DataFrame) -> DataFrame:
        """One row of each doc_id (the greatest by its columns); null ids go."""
        rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("language", F.lit("en")).alias("language")).where("doc_id is not null")
        return upsert(rows.limit(0), rows, ["doc_id"])

    def chunks(self, documents: DataFrame) -> DataFrame:
        """``doc_id, chunk_id, pos, text``: normalised chunks of each document."""
        cut = t.chunk_section(F.col("text"), F.col("language"), self.most_tokens, self.overlap)
        rows = documents.select("doc_id", "language", F.posexplode(cut).alias("pos", "text"))
        return rows.select("doc_id", F.concat_ws("#", "doc_id", "pos").alias("chunk_id"), "pos", t.normalize(F.col("text"), F.col("language")).alias("text"))

    def mentions(self, chunks: DataFrame) -> DataFrame:
        """``doc_id, chunk_id, cui, entity_type, label, start, end, confidence``: of each entity its best span in a chunk. Unlinked ones have a provisional id."""
        spans = l.recognise(chunks, self.dictionary)
        lists = spans.groupBy("chunk_id").agg(F.collect_list(F.struct("start", "end", "text", "entity_type", "confidence")).alias("spans"))  # of one chunk
        held = lists.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
        whole = l.merge_adjacent(F.col("spans"), F.col("text")) if self.merge else F.col("spans")
        kept = held.select("doc_id", "chunk_id", F.explode(l.drop_dominated(whole)).alias("s")).select("doc_id", "chunk_id", "s.*")
        linked = l.link_mentions(l.dedup_mentions(kept).withColumnRenamed("cui", "provisional"), self.concepts)
        names = self.concepts.select("cui", F.col("label").alias("concept"))
        named = linked.join(names, "cui", "left").withColumn("label", F.coalesce("concept", "normalized")).withColumn("cui", F.coalesce("cui", "provisional"))
        first = Window.partitionBy("chunk_id", "entity_type", "cui").orderBy("start", "end")
        one = named.withColumn("n_", F.row_number().over(first)).where("n_ = 1")
        return one.select("doc_id", "chunk_id", "cui", "entity_type", "label", "start", "end", F.round("link_confidence", 6).alias("confidence"))

    def write(self, documents: DataFrame, folder: str, number: int) -> None:
        """Writes the tables of some documents below ``folder``, as batch ``number``; what was there of that batch is replaced."""
        spark = documents.sparkSession
        docs = self.once(documents).withColumn("digest", F.md5("text"))
        place = {name: f"{folder}/{name}/batch={number}" for name in TABLES}
        self.chunks(docs).write.mode("overwrite").parquet(place["chunks"])
        chunks = spark.read.parquet(place["chunks"])
        self.mentions(chunks).write.mode("overwrite").parquet(place["mentions"])
        docs.select("doc_id", "language", "digest", t.estimate_tokens(F.col("text"), F.col("language")).cast("long").alias("tokens")).write.mode("overwrite").parquet(place["documents"])


def ingest(documents: DataFrame, build: Build, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of documents (doc_id, text, language), built batch by batch into the tables below ``folder``.

    A batch writes only its own rows, in a folder of its number, so one that is run again changes nothing; one that was cut off before its documents were
    written is not seen. A document that comes again replaces all that the earlier one had.
    """

    def write(batch: DataFrame, number: int) -> None:
        build.write(batch, folder, number)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables as they stand: ``documents``, ``chunks``, ``mentions`` of each document's newest batch, and ``entities`` that are mentioned in them."""
    rows = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    newest = rows["documents"].groupBy("doc_id").agg(F.max("batch").alias("batch"))
    held = {name: df.join(newest, ["doc_id", "batch"], "left_semi").drop("batch") for name, df in rows.items()}
    entities = held["mentions"].groupBy("entity_type", "cui").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("mentions"))
    return held | {"entities": entities}
