"""Structured Streaming forms: interests, quotas, reuse of results, idle sessions, intake of new documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.memory import KEEP
from ..sources.tables import upsert

#: State stores of transformWithState need this provider.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def interests(touches: DataFrame) -> DataFrame:
    """A stream of ``user_id, cui, weight, last_accessed`` updates from touches (user_id, cui, ts).

    Every touch keeps a share of the weight and adds 1, so the weight follows from the number of touches alone, in whatever order and
    however late they come; the last access only moves forward. The state of a pair is these two, which Spark adds up before the shuffle.
    """
    known = touches.where("user_id is not null and cui is not null")
    held = known.groupBy("user_id", "cui").agg(F.count(F.lit(1)).alias("n"), F.max("ts").cast("timestamp").alias("last_accessed"))
    return held.select("user_id", "cui", ((1 - F.pow(F.lit(KEEP), "n")) / (1 - KEEP)).alias("weight"), "last_accessed")


def quota_windows(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """``day, client, n``: requests of each UTC day; those that come ``late`` after newer ones are dropped."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "client").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("day"), "client", "n")


def fresh_queries(queries: DataFrame, key: str, ttl: str = "1 hour") -> DataFrame:
    """The queries whose result cannot be reused: the first of each key within the time to live."""
    return queries.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def intake(documents: DataFrame, process: Callable[[DataFrame], DataFrame], key: str, folder: str, checkpoint: str) -> StreamingQuery:
    """New documents, processed as in a build and upserted into the table below ``folder`` (read by ``intake_table``).

    Each batch writes only its own rows, to a folder of its number; a batch that is run again
    replaces its folder, so nothing changes. What is stored already is not read.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = process(batch)
        once = upsert(once.limit(0), once, [key])
        once.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_table(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.parquet(folder)
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return rows.withColumn("n_", F.row_number().over(newest)).where("n_ = 1").drop("n_", "batch")


def compact(spark: SparkSession, folder: str, key: str, target: str) -> None:
    """Writes the table to a new folder as one batch of number -1, which later batches of the stream take precedence over."""
    intake_table(spark, folder, key).write.parquet(f"{target}/batch=-1")


class Progress(StreamingQueryListener):
    """Writes a row for each batch of all streams below ``folder``: name, run, batch, rows in, milliseconds, time.

    Register it with ``spark.streams.addListener``. A row is a file named by query, run and batch, so it is there once, whoever
    restarts; ``progress_table`` reads what all runs have left. A stream without a name has its id as one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _put(self, name: str, row: dict) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        self._put(f"{event.id}-{event.runId}-started", {"query": event.name or str(event.id), "run": str(event.runId), "stage": "started", "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query": p.name or str(p.id), "run": str(p.runId), "stage": "batch", "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "at": p.timestamp}
        self._put(f"{p.id}-{p.runId}-{p.batchId}", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put(f"{event.id}-{event.runId}-ended", {"query": str(event.id), "run": str(event.runId), "stage": "failed" if event.exception else "ended"})


def progress_table(spark: SparkSession, folder: str) -> DataFrame:
    """``query, run, stage`` (started, batch, ended or failed) ``, batch, rows, ms, at`` of all runs."""
    return spark.read.schema("query string, run string, stage string, batch long, rows long, ms long, at string").json(folder)
