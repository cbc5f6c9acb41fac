"""Per-user interests and memories that decay, quotas, sessions and histories, over whole event tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import best

#: A touch keeps this share of the weight so far and adds 1.
KEEP = 0.9


def touch_weight(touches: Column) -> Column:
    """The weight after so many touches, in closed form; late touches only count once more."""
    return (1 - F.pow(F.lit(KEEP), touches)) / (1 - KEEP)


def interests(touches: DataFrame) -> DataFrame:
    """``user_id, cui, weight, last_accessed, touches`` from touches (user_id, cui, ts); anonymous and unlinked ones do not count."""
    known = touches.where("user_id is not null and cui is not null and not startswith(cast(cui as string), 'MENTION:')")
    return known.groupBy("user_id", "cui").agg(F.count(F.lit(1)).alias("touches"), F.max("ts").alias("last_accessed")).withColumn("weight", touch_weight(F.col("touches")))


def decayed(weight: Column, last: Column, now: Column, half_life_days: float) -> Column:
    """Weight after whole days since the last access."""
    return weight * F.exp(F.lit(-math.log(2) / half_life_days) * F.floor((F.unix_timestamp(now) - F.unix_timestamp(last)) / 86_400))


def top_interests(weights: DataFrame, now: Column, k: int = 5, half_life_days: float = 30.0) -> DataFrame:
    scored = weights.withColumn("score", F.round(decayed(F.col("weight"), F.col("last_accessed"), now, half_life_days), 6))
    return best(scored, ["user_id"], [F.desc("score"), "cui"], k)


def memory_topk(mentions: DataFrame, asked: DataFrame, now: Column, k: int = 5, half_life_days: float = 30.0) -> DataFrame:
    """``user_id, qa_id, score, rank``: memories by their best mention of an asked concept. asked: user_id, cui."""
    live = mentions.join(asked.distinct(), ["user_id", "cui"]).withColumn("e", F.round(decayed(F.col("weight"), F.col("last_accessed"), now, half_life_days), 6))
    return best(live.groupBy("user_id", "qa_id").agg(F.max("e").alias("score")), ["user_id"], [F.desc("score"), "qa_id"], k)


def memory_evict(mentions: DataFrame, now: Column, cap: int = 20, half_life_days: float = 30.0) -> DataFrame:
    """The mentions that stay: the ``cap`` strongest of each user and concept."""
    live = mentions.withColumn("e", F.round(decayed(F.col("weight"), F.col("last_accessed"), now, half_life_days), 6))
    return best(live, ["user_id", "cui"], [F.desc("e"), "qa_id"], cap).drop("e", "rank")


def drop_orphans(memories: DataFrame, mentions: DataFrame) -> DataFrame:
    """Memories with a mention left."""
    return memories.join(mentions.select("user_id", "qa_id").distinct(), ["user_id", "qa_id"], "left_semi")


def quota_counts(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``day, level, bucket, n, over_limit`` from requests (ts, client, key, admin): all, by client and by key; admins do not count. UTC days."""
    rows = requests.where(~F.coalesce("admin", F.lit(False))).withColumn("day", F.to_date("ts"))
    levels = F.array(
        F.struct(F.lit("global").alias("level"), F.lit("all").alias("bucket")),
        F.struct(F.lit("client").alias("level"), F.col("client").cast("string").alias("bucket")),
        F.struct(F.lit("key").alias("level"), F.col("key").cast("string").alias("bucket")),
    )
    counted = rows.select("day", F.explode(levels).alias("x")).where("x.bucket is not null").groupBy("day", "x.level", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("level")]
    return counted.withColumn("over_limit", F.coalesce(F.col("n") > limit, F.lit(False)))


def idle_sessions(events: DataFrame, key: str, gap: str = "120 seconds") -> DataFrame:
    """``key, start, end, n``: bursts of events with no pause over ``gap``."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _bucket_chains(ttl: int, width: int):
    """Per key and bucket of time: where a chain of misses that enters at one of the first moments leaves it, and how many misses that makes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["t"].to_numpy())
        n = len(t)
        after = np.searchsorted(t, t + ttl, side="right").tolist()
        misses, last = [0] * n, t.tolist()
        for i in range(n - 1, -1, -1):
            j = after[i]
            misses[i] = 1 + (misses[j] if j < n else 0)
            last[i] = last[j] if j < n else last[i]
        # a result from before the bucket is served up to here at most; the first lookup after that is an entry, too
        entries = min(n, int(np.searchsorted(t, int(rows["b"].iloc[0]) * width + ttl, side="left")) + 1)
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "b": [rows["b"].iloc[0]], "entry": [t[:entries]], "last": [last[:entries]], "misses": [misses[:entries]]})

    return run


def _key_chain(ttl: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total, served = 0, None
        for entry, last, misses in rows.sort_values("b")[["entry", "last", "misses"]].itertuples(index=False):
            at = 0 if served is None else int(np.searchsorted(entry, served, side="right"))
            if at < len(entry):
                total += int(misses[at])
                served = int(last[at]) + ttl
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "misses": [total]})

    return run


def query_reuse(events: DataFrame, key: str, ttl_seconds: int = 3600, bucket_ttls: int = 720) -> DataFrame:
    """``key, hits, misses``: lookups served from a result at most ``ttl_seconds`` old; a miss starts a new one (a hit does not prolong it).

    Two levels: lookups of one second are one row; a task follows the misses within a bucket of ``bucket_ttls`` times to live, from each of the
    moments at which they can enter it, and a key's buckets are then chained by these summaries. So no row or task holds a key's
    lookups, however many there are; a summary has ``ttl_seconds`` entries at most. Lookups without a time do not count; a null key is a key.
    """
    width = ttl_seconds * bucket_ttls
    named = events.select(F.col(key).alias("own"), F.to_json(F.struct(F.col(key).alias("k"))).alias("k"), F.unix_timestamp("ts").alias("t"))
    seconds = named.where("t is not null").groupBy("k", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("t") / width))
    chains = seconds.select("k", "b", "t").groupBy("k", "b").applyInPandas(_bucket_chains(ttl_seconds, width), "k string, b long, entry array<long>, last array<long>, misses array<long>")
    missed = chains.groupBy("k").applyInPandas(_key_chain(ttl_seconds), "k string, misses long")
    counts = named.groupBy("own", "k").agg(F.count("t").alias("n"))
    joined = counts.join(missed, "k", "left").withColumn("misses", F.coalesce("misses", F.lit(0)).cast("long"))
    return joined.select(F.col("own").alias(key), (F.col("n") - F.col("misses")).alias("hits"), "misses")


def concurrency(requests: DataFrame, by: str, bucket: int = 3_600_000_000) -> DataFrame:
    """``by, peak``: most requests (start, end) active at once; an end before a start at the same moment.

    Two levels: starts less ends are summed for each moment, then for each bucket of time (``bucket`` units of the columns, microseconds for
    timestamps), whose running sums say how many are active when a bucket begins. Moments are then summed within their bucket, so a
    task orders a bucket of a key, not all of its events. Requests with a null start or end do not count; a key with no other has a peak of 0.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if dict(requests.dtypes)[c].startswith("timestamp") else F.col(c).cast("long")
    whole = requests.where("start is not null and end is not null")
    steps = whole.select(F.col(by).alias("k_"), F.explode(F.array(F.struct(at("start").alias("at"), F.lit(1).alias("d")), F.struct(at("end").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    moments = steps.groupBy("k_", "x.at").agg(F.sum("x.d").alias("d")).withColumn("b_", F.floor(F.col("at") / bucket))
    sums = moments.groupBy("k_", "b_").agg(F.sum("d").alias("d"))
    before = F.sum("d").over(Window.partitionBy("k_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1))
    begin = sums.select(F.col("k_").alias("key_"), F.col("b_").alias("bucket_"), F.coalesce(before, F.lit(0)).alias("begin"))
    inner = F.sum("d").over(Window.partitionBy("k_", "b_").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    most = moments.withColumn("inner", inner).groupBy("k_", "b_").agg(F.max("inner").alias("most"))
    peaks = most.join(begin, F.col("k_").eqNullSafe(F.col("key_")) & (F.col("b_") == F.col("bucket_"))).groupBy("k_").agg(F.max(F.col("begin") + F.col("most")).alias("peak"))
    keys = requests.select(F.col(by)).distinct()
    return keys.join(peaks, F.col(by).eqNullSafe(F.col("k_")), "left").select(by, F.coalesce("peak", F.lit(0)).alias("peak"))


def session_list(messages: DataFrame) -> DataFrame:
    """``user_id, session_id, n, first_message, updated_at, place``: each user's sessions, the newest (by its last message) at place 1."""
    rows = messages.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("content", "created_at").alias("first_message"), F.max("created_at").alias("updated_at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "session_id")).cast("long"))


def session_messages(messages: DataFrame) -> DataFrame:
    """``session_id, messages array<struct<created_at, role, content>>`` in order."""
    return messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "role", "content"))).alias("messages"))


def history_window(messages: DataFrame, n: int = 5) -> DataFrame:
    """Each message with the ``n`` before it as text."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    before = Window.partitionBy("session_id").orderBy("created_at").rowsBetween(-n, -1)
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))


def memory_write(mentions: DataFrame, memories: DataFrame, new: DataFrame, now: Column, cap: int = 20, half_life_days: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(mentions, memories) after new memories (user_id, qa_id, question, answer, cuis, ts): the weakest over the cap go, and memories without a mention."""
    added = new.select("user_id", "qa_id", F.explode("cuis").alias("cui"), F.lit(1.0).alias("weight"), F.col("ts").alias("last_accessed"))
    kept = memory_evict(mentions.unionByName(added), now, cap, half_life_days)
    return kept, drop_orphans(memories.unionByName(new.select(memories.columns), allowMissingColumns=True), kept)


def memory_reinforce(mentions: DataFrame, used: DataFrame) -> DataFrame:
    """Mentions of used memories (user_id, qa_id, cui, ts), touched once more."""
    touched = used.groupBy("user_id", "qa_id", "cui").agg(F.count(F.lit(1)).alias("n_"), F.max("ts").alias("t_"))
    joined = mentions.join(touched, ["user_id", "qa_id", "cui"], "left")
    weight = F.col("weight") * F.pow(F.lit(KEEP), F.coalesce("n_", F.lit(0))) + touch_weight(F.coalesce("n_", F.lit(0)))
    return joined.withColumns({"weight": weight, "last_accessed": F.greatest("last_accessed", "t_")}).drop("n_", "t_")


def token_usage(usage: DataFrame, by: list[str]) -> DataFrame:
    """``by..., tokens``: prompt and completion tokens; a missing number counts as 0."""
    return usage.groupBy(*by).agg(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))
