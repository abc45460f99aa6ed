"""Streaming queries over the events table, each equal to its batch SQL once drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.plans.base import query
from paddock.runtime import keep_until_exit, shared_dir, table
from paddock.streaming import events as S


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _over(spark: SparkSession, d: str, build) -> DataFrame:
    b = S.source(spark, d, "events")
    return S.drained(build(b.events), b)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", event_type, count(*) n, sum(value::DECIMAL(18, 4))::DOUBLE total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_over(spark, d, S.tumbling), "start")


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR s, * FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts), * FROM events) SELECT s AS \"start\", event_type, count(*) n FROM w GROUP BY ALL")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_over(spark, d, S.sliding), "start")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTES AS "end", count(*) n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_over(spark, d, S.sessions), "start", "end")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Repeats within an hour go in the stream, with bounded state; the rest in the table it fills."""
    s = _over(spark, d, lambda e: S.first_of_each(e, ["user_id", "event_type"]).select("user_id", "event_type"))
    return s.where("event_type is not null").distinct()


@query("SELECT user_id, max(ts)::TIMESTAMP newest, arg_max(event_id, (ts, event_id)) event_id FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, kept by upserts."""
    path = f"{shared_dir(spark).rstrip('/')}/paddock/latest-{uuid.uuid4().hex[:12]}"
    for p in (path, f"{path}-state"):
        keep_until_exit(spark, p)
    rows = S.source(spark, d, "events").events.select("user_id", F.struct("ts", "event_id").alias("at"))
    S.upserts(rows, path, ["user_id"], "at", f"{path}-state")()
    return _plain(S.current(spark, path, ["user_id"], "at").select("user_id", F.col("at.ts").alias("newest"), F.col("at.event_id").alias("event_id")), "newest")


_MID = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", event_type, count(*) n FROM events WHERE ts >= {_MID} GROUP BY ALL")
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts where the first half of the events arrives after the second: it is too late and left out.

    The engine drops late rows by the watermark of the batch before the last, so the second half comes in two.
    """
    e = table(spark, d, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    mid = F.lit(low + (high - low) / 2).cast("timestamp_ntz")
    b = S.feed([e.where((F.col("ts") >= mid) & (F.col("event_id") % 2 == 0)), e.where((F.col("ts") >= mid) & (F.col("event_id") % 2 != 0)), e.where(F.col("ts") < mid)])
    return _plain(S.drained(S.tumbling(b.events), b), "start").select("start", "event_type", "n")


@query("SELECT a.user_id, a.event_id first_id, b.event_id second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within six hours of a view by the same user, joined as two streams."""
    a, b = S.source(spark, d, "events"), S.source(spark, d, "events")
    pairs = S.followed(a.events.where("event_type = 'view'"), b.events.where("event_type = 'purchase'"), "user_id", "6 hours")
    return S.drained(pairs.select("user_id", "first_id", "second_id"))
