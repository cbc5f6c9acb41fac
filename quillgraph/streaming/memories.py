"""Memories as keyed state: written with eviction, reinforced by their use."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import KEEP


def _micros(ts: str):
    """A time as a long: rows of these pass to the processors and their state without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp")).alias(ts)


def _strength(weight: float, last: int, now: int, half_life_days: float) -> float:
    return round(weight * math.exp(-math.log(2) / half_life_days * ((now - last) // 86_400_000_000)), 6)


class Written(StatefulProcessor):
    """Of each user and concept, the strongest memories in list state; the rest are evicted as they come."""

    def __init__(self, now: datetime, cap: int, half_life_days: float, forget_ms: int | None):
        self.now, self.cap, self.half_life_days, self.forget_ms = round(now.timestamp() * 1_000_000), cap, half_life_days, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a memory that is not written again for so long is dropped by the state's timer
        self.held = handle.getListState("memories", "qa_id string, weight double, last long", ttlDurationMs=self.forget_ms)
        self.writes = handle.getValueState("writes", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(row["qa_id"], row["us"]) for row in rows]
        held = {q: (w, us) for q, w, us in self.held.get()}
        for q, us in new:
            if q not in held or us > held[q][1]:
                held[q] = (1.0, us)
        ranked = sorted(held, key=lambda q: (-_strength(*held[q], self.now, self.half_life_days), q))
        self.held.put([(q, *held[q]) for q in ranked[: self.cap]])
        n = (self.writes.get() or (0,))[0] + 1
        self.writes.update((n,))
        for place, q in enumerate(ranked):
            yield Row(user_id=key[0], cui=key[1], qa_id=q, weight=held[q][0], last_accessed=held[q][1], kept=place < self.cap, version=n)

    def close(self) -> None:
        pass


def memory_write(new: DataFrame, now: datetime, cap: int = 20, half_life_days: float = 30.0, forget_ms: int | None = None) -> DataFrame:
    """Updates ``user_id, cui, qa_id, weight, last_accessed, kept, version`` from a stream of new memories (user_id, qa_id, cuis, ts).

    Strength is taken at ``now``, so the memories that stay do not depend on the order in which they come. Of a memory that comes
    twice the later one counts. Rows with a null user, memory, time or concept do not count. ``memories`` gives the state from the updates.
    """
    kinds = dict(new.dtypes)
    rows = new.where("user_id is not null and qa_id is not null and ts is not null").select("user_id", F.col("qa_id").cast("string").alias("qa_id"), F.explode(F.array_distinct("cuis")).alias("cui"), _micros("ts").alias("us")).where("cui is not null")
    schema = f"user_id {kinds['user_id']}, cui string, qa_id string, weight double, last_accessed long, kept boolean, version long"
    updates = rows.groupBy("user_id", "cui").transformWithState(Written(now, cap, half_life_days, forget_ms), schema, outputMode="Update", timeMode="ProcessingTime" if forget_ms else "None")
    return updates.withColumn("last_accessed", F.timestamp_micros("last_accessed"))


def memories(updates: DataFrame) -> DataFrame:
    """``user_id, cui, qa_id, weight, last_accessed``: what stays by the newest update of each user and concept."""
    newest = updates.groupBy("user_id", "cui").agg(F.max("version").alias("version")).toDF("u_", "c_", "v_")
    same = (F.col("user_id") == F.col("u_")) & (F.col("cui") == F.col("c_")) & (F.col("version") == F.col("v_"))
    return updates.join(newest, same, "left_semi").where("kept").select("user_id", "cui", "qa_id", "weight", "last_accessed").distinct()


class Reinforced(StatefulProcessor):
    """The weight of each stored memory; every use keeps a share of it and adds 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "weight double, last long, uses long")
        self.late = None

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update((float(initialState["weight"]), initialState["last_accessed"], 0))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        uses_at = [row["us"] for row in rows]
        held = self.state.get()
        if held is None:
            return  # no such memory
        if self.late is None:  # one for the batch
            self.late = timerValues.getCurrentWatermarkInMs() * 1000
        weight, last, uses = held
        for us in uses_at:
            if us >= self.late:
                weight, last, uses = weight * KEEP + 1, max(last, us), uses + 1
        self.state.update((weight, last, uses))
        yield Row(user_id=key[0], qa_id=key[1], cui=key[2], weight=weight, last_accessed=last, uses=uses)

    def close(self) -> None:
        pass


def memory_reinforce(used: DataFrame, mentions: DataFrame, late: str = "1 day") -> DataFrame:
    """Updates ``user_id, qa_id, cui, weight, last_accessed, uses`` from a stream of uses (user_id, qa_id, cui, ts) of stored memories (with weight, last_accessed).

    The stored ones are the first state. Uses that are ``late`` behind the newest of earlier batches do not count, nor do those of
    memories that are not stored or with a null key or time. Stored rows are unique by user, memory and concept.
    """
    keys = ["user_id", "qa_id", "cui"]
    kinds = dict(mentions.dtypes)
    rows = used.select(*[F.col(k).cast(kinds[k]) for k in keys], "ts").where(" and ".join(f"{c} is not null" for c in [*keys, "ts"])).withWatermark("ts", late)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", weight double, last_accessed long, uses long"
    first = mentions.select(*keys, "weight", _micros("last_accessed")).groupBy(*keys)
    updates = rows.select("*", _micros("ts").alias("us")).groupBy(*keys).transformWithState(Reinforced(), schema, outputMode="Update", timeMode="EventTime", initialState=first)
    return updates.withColumn("last_accessed", F.timestamp_micros("last_accessed"))


def reinforced(mentions: DataFrame, updates: DataFrame) -> DataFrame:
    """``mentions`` with what the newest update of each says."""
    keys = ["user_id", "qa_id", "cui"]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct("weight", "last_accessed"), "uses").alias("u_"))
    joined = mentions.join(newest, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col("u_")[c], F.col(c)) for c in ("weight", "last_accessed")}).drop("u_")
