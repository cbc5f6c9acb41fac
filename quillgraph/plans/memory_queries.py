"""Queries on events (users' touches), conversations (sessions) and lineitem (requests). Now is the last event's time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as m


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def touches(spark, sf):
    return events(spark, sf).select("user_id", F.get_json_object("props", "$.k").alias("cui"), "ts")


def now(spark, sf):
    return F.lit(events(spark, sf).agg(F.max("ts")).first()[0])


def mentions(spark, sf):
    """Each event as a memory that mentions a concept and the next one."""
    e = events(spark, sf).select("user_id", F.col("event_id").alias("qa_id"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").alias("weight"), F.col("ts").alias("last_accessed"))
    return e.select("user_id", "qa_id", F.explode(F.array(F.col("k") % 5, F.col("k") % 5 + 1)).alias("cui"), "weight", "last_accessed")


def interest_weight(spark, sf):
    return m.interests(touches(spark, sf)).select("user_id", "cui", "touches", F.round("weight", 6).alias("weight"))


def top_interests(spark, sf):
    return m.top_interests(m.interests(touches(spark, sf)), now(spark, sf)).select("user_id", "cui", "score", "rank")


def memory_topk(spark, sf):
    asked = events(spark, sf).select("user_id").distinct().withColumn("cui", (F.col("user_id") % 5).cast("int"))
    return m.memory_topk(mentions(spark, sf), asked, now(spark, sf)).select("user_id", "qa_id", "score", "rank")


def memory_evict(spark, sf):
    kept = m.memory_evict(mentions(spark, sf), now(spark, sf))
    return m.drop_orphans(events(spark, sf).select("user_id", F.col("event_id").alias("qa_id")), kept)


def quota_breach(spark, sf):
    requests = events(spark, sf).select("ts", F.col("user_id").alias("client"), F.col("event_type").alias("key"), (F.col("user_id") % 50 == 0).alias("admin"))
    return m.quota_counts(requests, {"global": 80, "client": 4}).withColumn("day", F.col("day").cast("string"))


def idle_sessions(spark, sf):
    return m.idle_sessions(events(spark, sf), "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def query_reuse(spark, sf):
    return m.query_reuse(touches(spark, sf), "cui")


def concurrency_peak(spark, sf):
    requests = events(spark, sf).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000).cast("long") * 1_000_000).alias("end"))
    return m.concurrency(requests, "event_type")


def messages(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def session_list(spark, sf):
    """Ten conversations to a user."""
    return m.session_list(messages(spark, sf).withColumn("user_id", F.floor(F.col("session_id") / 10).cast("long"))).withColumnRenamed("first_message", "first")


def session_messages(spark, sf):
    rows = m.session_messages(messages(spark, sf))
    return rows.select("session_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("digest"))


def history_window(spark, sf):
    return m.history_window(messages(spark, sf)).select("session_id", "created_at", F.md5("history").alias("digest"))


QUERIES = {
    "interest_weight": interest_weight,
    "top_interests": top_interests,
    "memory_topk": memory_topk,
    "memory_evict": memory_evict,
    "quota_breach": quota_breach,
    "idle_sessions": idle_sessions,
    "query_reuse": query_reuse,
    "concurrency_peak": concurrency_peak,
    "session_list": session_list,
    "session_messages": session_messages,
    "history_window": history_window,
}

_K = "json_extract_string(props, '$.k')"
_DAYS = "floor((epoch((SELECT date_trunc('second', max(ts)) FROM events)) - epoch(date_trunc('second', {0}))) / 86400)"
_DECAY = "round({1} * exp(-ln(2) / 30.0 * " + _DAYS + "), 6)"
_MENTIONS = f"mentions AS (SELECT user_id, event_id AS qa_id, unnest([{_K}::INT % 5, {_K}::INT % 5 + 1]) AS cui, value AS weight, ts AS last_accessed FROM events)"

SQL = {
    "interest_weight": f"SELECT user_id, {_K} AS cui, count(*) AS touches, round(10 * (1 - pow(0.9, count(*))), 6) AS weight FROM events GROUP BY 1, 2",
    "top_interests": f"""WITH i AS (SELECT user_id, {_K} AS cui, 10 * (1 - pow(0.9::DOUBLE, count(*))) AS weight, max(ts) AS last FROM events GROUP BY 1, 2),
 s AS (SELECT user_id, cui, {_DECAY.format('last', 'weight')} AS score FROM i) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, cui) AS rank FROM s QUALIFY rank <= 5""",
    "memory_topk": f"""WITH {_MENTIONS}, s AS (SELECT user_id, qa_id, max({_DECAY.format('last_accessed', 'weight')}) AS score FROM mentions WHERE cui = user_id % 5 GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, qa_id) AS rank FROM s QUALIFY rank <= 5""",
    "memory_evict": f"""WITH {_MENTIONS}, kept AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY user_id, cui ORDER BY {_DECAY.format('last_accessed', 'weight')} DESC, qa_id) <= 20)
 SELECT DISTINCT user_id, qa_id FROM kept""",
    "quota_breach": """WITH r AS (SELECT ts::DATE::VARCHAR AS day, user_id, event_type FROM events WHERE user_id % 50 <> 0),
 l AS (SELECT day, 'global' AS level, 'all' AS bucket FROM r UNION ALL SELECT day, 'client', user_id::VARCHAR FROM r UNION ALL SELECT day, 'key', event_type FROM r)
 SELECT day, level, bucket, count(*) AS n, coalesce(count(*) > CASE level WHEN 'global' THEN 80 WHEN 'client' THEN 4 END, false) AS over_limit FROM l GROUP BY 1, 2, 3""",
    "idle_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 120 SECONDS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "query_reuse": f"""WITH RECURSIVE e AS (SELECT {_K} AS cui, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
 m AS (SELECT cui, min(t) AS since FROM e GROUP BY 1 UNION ALL SELECT m.cui, min(e.t) FROM m JOIN e ON e.cui = m.cui AND e.t > m.since + 3600 GROUP BY m.cui, m.since)
 SELECT cui, (SELECT count(*) FROM e WHERE e.cui = m.cui) - count(*) AS hits, count(*) AS misses FROM m GROUP BY cui""",
    "concurrency_peak": """WITH x AS (SELECT event_type, epoch_us(ts) AS t_, 1 AS d FROM events UNION ALL SELECT event_type, epoch_us(ts) + floor(value * 1000)::BIGINT * 1000000, -1 FROM events),
 a AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t_, d ROWS UNBOUNDED PRECEDING) AS active FROM x) SELECT event_type, CAST(max(active) AS BIGINT) AS peak FROM a GROUP BY 1""",
    "session_list": """WITH s AS (SELECT conv_id // 10 AS user_id, conv_id AS session_id, count(*) AS n, arg_min(text, turn) AS first, max(turn) AS updated_at FROM conversations GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id) AS place FROM s""",
    "session_messages": "SELECT conv_id AS session_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "history_window": """WITH l AS (SELECT conv_id, turn, list(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
 SELECT conv_id AS session_id, turn AS created_at, md5(coalesce(array_to_string(h, chr(10)), '')) AS digest FROM l""",
}
