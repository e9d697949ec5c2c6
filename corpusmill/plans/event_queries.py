"""Queries over events: JSON, dates, tumbling, sliding and session windows, and their Structured Streaming twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python_udfs import WordWindows, weighted_exp
from ..registry import query
from ..sources.tables import table as t
from ..streaming import jobs
from .text_queries import _WORDS


@query("events_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_json(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "events_by_day",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
)
def events_by_day(spark, d):
    return t(spark, d, "events").groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_HOURLY = "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


@query("events_tumbling", _HOURLY)
def events_tumbling(spark, d):
    w = F.window("ts", "1 hour")
    return t(spark, d, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_timestamp("window.start").alias("start"), "event_type", "n"
    )


@query(
    "events_sliding",
    "SELECT (epoch(time_bucket(INTERVAL '30 minutes', ts))::BIGINT - o) AS start, count(*) AS n FROM events, (VALUES (0), (1800)) x(o) GROUP BY ALL"
)
def events_sliding(spark, d):
    w = F.window("ts", "1 hour", "30 minutes")
    return t(spark, d, "events").groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_timestamp("window.start").alias("start"), "n"
    )


_SESSIONS = """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new, event_id FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM a) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM b GROUP BY user_id, s"""


@query("events_sessions", _SESSIONS)
def events_sessions(spark, d):
    s = F.session_window("ts", "30 minutes")
    return t(spark, d, "events").groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.unix_timestamp("session_window.start").alias("start"), "n"
    )


@query("events_sessionised", _SESSIONS)
def events_sessionised(spark, d):
    """The same by window functions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1)
    x = t(spark, d, "events").withColumn("new", new).withColumn("s", F.sum("new").over(w))
    return x.groupBy("user_id", "s").agg(F.unix_timestamp(F.min("ts")).alias("start"), F.count(F.lit(1)).alias("n")).drop("s")


@query("stream_tumbling", _HOURLY)
def stream_tumbling(spark, d):
    return jobs.tumbling(spark, d)


@query(
    "stream_dedup",
    "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) FROM events) GROUP BY ALL"
)
def stream_dedup(spark, d):
    return jobs.deduplicated(spark, d)


@query("stream_sessions", _SESSIONS)
def stream_sessions(spark, d):
    return jobs.sessions(spark, d)


@query(
    "stream_static_join",
    "SELECT n_name, count(*) AS n FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def stream_static_join(spark, d):
    return jobs.static_join(spark, d)


@query(
    "stream_frontier",
    "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' WHEN count(*) > 3 THEN 'claimed' ELSE 'pending' END AS status, count(*) AS seen FROM events GROUP BY user_id"
)
def stream_frontier(spark, d):
    return jobs.frontier(spark, d)


@query(
    "stream_followed",
    "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'"
)
def stream_followed(spark, d):
    return jobs.followed(spark, d)


@query(
    "stream_late",
    "SELECT epoch(TIMESTAMP '2024-01-01 10:00:00')::BIGINT + h * 3600 AS start, 1::BIGINT AS n FROM (VALUES (0), (2), (4)) v(h)"
)
def stream_late(spark, d):
    return jobs.late(spark)


@query("udaf_geometric_mean", "SELECT event_type, round(exp(avg(ln(1 + abs(value)))), 6) AS mean FROM events GROUP BY event_type")
def udaf_geometric_mean(spark, d):
    """A grouped aggregate over Arrow batches; what it is given was summed by hour first, so groups stay small."""
    hourly = t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum(F.log(1 + F.abs("value"))).alias("s"), F.count(F.lit(1)).alias("n")
    )
    return hourly.groupBy("event_type").agg(F.round(weighted_exp("s", "n"), 6).alias("mean"))


@query(
    "udtf_windows",
    "SELECT doc_id, s::BIGINT AS start, array_to_string(w[s+1:s+8], ' ') AS words FROM (SELECT doc_id, w, unnest(range(0, len(w), 4)) AS s FROM (SELECT doc_id, " + _WORDS + " AS w FROM documents)) WHERE s = 0 OR s + 4 < len(w)"
)
def udtf_windows(spark, d):
    """A table function, joined laterally: windows of eight words, every four."""
    docs = t(spark, d, "documents").select("doc_id", F.array_join(X.words(F.col("text")), " ").alias("text"))
    windows = WordWindows(F.col("text").outer(), F.lit(8), F.lit(4))
    return docs.lateralJoin(windows).select("doc_id", F.col("start"), F.col("words"))
