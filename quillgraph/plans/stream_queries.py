"""Streams over the given tables, run to their end; what they wrote is the result."""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import shared_dir, store
from ..streaming import ingest, jobs
from ..streaming import memories as memory_jobs
from .linking_queries import TERMS, dictionary


def _stream(spark, sf, name) -> DataFrame:
    """A table's file, or the files of its folder, as a stream of new files."""
    kind = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # as a pattern: a plain path of a stream must be a folder
    rows = spark.readStream.schema(kind).parquet(f"{sf}/{name}.parque[t]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in kind if f.dataType.simpleString() == "timestamp_ntz"})


def _folder(spark, name):
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def _finished(df: DataFrame, name: str) -> DataFrame:
    """Every update that the stream gives, with its batch's number."""
    spark, out = df.sparkSession, _folder(df.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def interests(spark, sf):
    """Weights by user and concept, kept in state; the last update of each counts."""
    touches = _stream(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("cui"), "ts")
    updates = _finished(jobs.interests(touches), "interests")
    return updates.groupBy("user_id", "cui").agg(F.round(F.max("weight"), 6).alias("weight"), F.date_format(F.max("last_accessed"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def quota_windows(spark, sf):
    """Requests of each day and user; the last update of each counts."""
    requests = _stream(spark, sf, "events").select("ts", F.col("user_id").alias("client"))
    updates = _finished(jobs.quota_windows(requests, "40 days"), "quota")
    return updates.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "client").agg(F.max("n").alias("n"))


def _build(spark, sf):
    """The frequent words of the documents as dictionary and concepts; terms of one word need no merging."""
    words = dictionary(spark, sf)
    concepts = words.select(F.concat(F.lit("W:"), "term").alias("cui"), F.col("term").alias("label"), "entity_type", F.array().cast("array<string>").alias("synonyms"), F.lit(None).cast("map<string,string>").alias("lang_labels"))
    return ingest.Build(store(words, "stream-words"), store(concepts, "stream-concepts"), merge=False)


def intake(spark, sf):
    """New documents to chunks, mentions and entities; each document with its tokens and the number of entities mentioned in it."""
    folder = _folder(spark, "intake")
    docs = _stream(spark, sf, "documents").select("doc_id", "text", F.lit("en").alias("language"))
    ingest.ingest(docs, _build(spark, sf), folder, _folder(spark, "checkpoint")).awaitTermination()
    held = ingest.graph(spark, folder)
    found = held["mentions"].groupBy("doc_id").agg(F.count_distinct("cui").alias("found"))
    return held["documents"].join(found, "doc_id", "left").select("doc_id", "digest", "tokens", F.coalesce("found", F.lit(0)).alias("entities"))


#: The time at which memories' strength is taken.
NOW = dt.datetime(2024, 3, 1)


def _memory_rows(spark, sf, read):
    events = read(spark, sf, "events").where("event_type <> 'error'")
    return events.select("user_id", F.col("event_id").alias("qa_id"), F.array(F.col("event_type")).alias("cuis"), "ts")


def _stateful(spark):
    """State stores of transformWithState, for as long as a query runs."""

    @contextmanager
    def held():
        before = spark.conf.get(jobs.STATE_STORE[0], None)
        spark.conf.set(*jobs.STATE_STORE)
        try:
            yield
        finally:
            spark.conf.set(jobs.STATE_STORE[0], before) if before else spark.conf.unset(jobs.STATE_STORE[0])

    return held()


def memory_writes(spark, sf):
    """Events as new memories about their type: of each user and type the five strongest stay."""
    with _stateful(spark):
        updates = _finished(memory_jobs.memory_write(_memory_rows(spark, sf, _stream), NOW, cap=5), "memories")
    return memory_jobs.memories(updates).select("user_id", "cui", F.col("qa_id").cast("long").alias("qa_id"), "weight")


def memory_uses(spark, sf):
    """Users' event types as stored memories, used again at each of the user's later errors."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stored = store(rows.where("user_id is not null").groupBy("user_id", F.col("event_type").alias("cui")).agg(F.min("event_id").alias("qa_id"), F.min("ts").alias("last_accessed")).withColumn("weight", F.lit(1.0)), "stream-stored")
    errors = _stream(spark, sf, "events").where("event_type = 'error'")
    used = errors.join(stored.select("user_id", "qa_id", "cui"), "user_id").select("user_id", "qa_id", "cui", "ts")
    with _stateful(spark):
        updates = _finished(memory_jobs.memory_reinforce(used, stored, "60 days"), "reinforced")
    return memory_jobs.reinforced(stored, updates).select("user_id", "cui", F.round("weight", 6).alias("weight"), F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("last"))


def progress(spark, sf):
    """What an intake's listener has written of its batches: their rows."""
    folder = _folder(spark, "progress")
    listener = jobs.Progress(spark, folder)
    spark.streams.addListener(listener)
    try:
        query = jobs.intake(_stream(spark, sf, "orders"), lambda b: b.select("o_orderkey"), "o_orderkey", _folder(spark, "intake"), _folder(spark, "checkpoint"))
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return jobs.progress_table(spark, folder).where("stage = 'batch'").agg(F.sum("rows").alias("rows"))


QUERIES = {
    "stream_interests": interests,
    "stream_quota_windows": quota_windows,
    "stream_intake": intake,
    "stream_memory_write": memory_writes,
    "stream_memory_reinforce": memory_uses,
    "stream_progress": progress,
}

SQL = {
    "stream_interests": """SELECT user_id, json_extract_string(props, '$.k') AS cui, round(10 * (1 - pow(0.9::DOUBLE, count(*))), 6) AS weight, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events
 WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2""",
    "stream_quota_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS client, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_intake": rf"""WITH {TERMS}, found AS (SELECT chunk_id AS doc_id, count(DISTINCT lower(text)) AS n FROM spans GROUP BY 1)
SELECT d.doc_id, md5(text) AS digest, CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor(1.3::DOUBLE * len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT)) END AS tokens, coalesce(n, 0) AS entities
FROM documents d LEFT JOIN found USING (doc_id)""",
    "stream_memory_write": """SELECT user_id, event_type AS cui, event_id AS qa_id, 1.0::DOUBLE AS weight FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL AND ts IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(TIMESTAMP '2024-03-01' - ts) / 86400), event_id::VARCHAR) <= 5""",
    "stream_memory_reinforce": """WITH m AS (SELECT user_id, event_type AS cui, min(event_id) AS qa_id, min(ts) AS first FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2), e AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, cui, round(pow(0.9::DOUBLE, coalesce(n, 0)) + 10 * (1 - pow(0.9::DOUBLE, coalesce(n, 0))), 6) AS weight, strftime(greatest(first, coalesce(last, first)), '%Y-%m-%d %H:%M:%S') AS last FROM m LEFT JOIN e USING (user_id)""",
    "stream_progress": "SELECT count(*) AS rows FROM orders",
}
