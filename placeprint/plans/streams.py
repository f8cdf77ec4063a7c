"""Streaming queries over the events as a file stream, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeprint.plans.registry import register
from placeprint.plans.signals import SIG, SIZE
from placeprint.streaming import ingest


def _events(spark, sf_dir):
    return ingest.timed(ingest.file_stream(spark, sf_dir, "events.parquet", files_a_trigger=None))


@register("stream_ingest_ledger", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def stream_ingest_ledger(spark, sf_dir):
    """Events ingested exactly once, also when the same stream runs again."""
    table, checkpoint = ingest.paths_for(spark, "ingest")
    ingest.ingest(_events(spark, sf_dir), table, "event_id", checkpoint)
    again = ingest.ingest(_events(spark, sf_dir), table, "event_id", f"{checkpoint}-again")
    return again.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@register("stream_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir):
    table, checkpoint = ingest.paths_for(spark, "daily")
    ingest.run_available(ingest.daily(_events(spark, sf_dir)), lambda b, _: b.write.mode("overwrite").parquet(table), checkpoint, "complete")
    return spark.read.parquet(table).withColumn("total", F.round("total", 4))


@register(
    "stream_windows",
    f"WITH {SIG} SELECT stream, pos // {SIZE} AS window, count(*) AS n, round(sum(sample), 4) AS total FROM sig GROUP BY ALL HAVING count(*) = {SIZE}",
)
def stream_windows(spark, sf_dir):
    """Full windows of each stream with the leftover carried over."""
    table, checkpoint = ingest.paths_for(spark, "windows")
    ingest.run_available(ingest.windows(_events(spark, sf_dir), SIZE), lambda b, i: b.write.mode("overwrite").parquet(f"{table}/batch={i}"), checkpoint)
    return spark.read.parquet(table).select("stream", "window", "n", F.round("total", 4).alias("total"))


@register(
    "stream_ema",
    f"""WITH RECURSIVE {SIG}, e(stream, pos, m) AS (SELECT stream, pos, sample FROM sig WHERE pos = 0 UNION ALL SELECT s.stream, s.pos, 0.95 * e.m + 0.05 * s.sample FROM e JOIN sig s ON s.stream = e.stream AND s.pos = e.pos + 1)
SELECT stream, max(pos) + 1 AS n, round(arg_max(m, pos), 6) AS baseline FROM e GROUP BY stream""",
)
def stream_ema(spark, sf_dir):
    """Baselines kept as state; the table holds the last one of each stream."""
    table, checkpoint = ingest.paths_for(spark, "ema")
    return ingest.upsert(ingest.ema(_events(spark, sf_dir)), table, "stream", checkpoint).withColumn("baseline", F.round("baseline", 6))


@register("stream_replay_dedupe", "SELECT DISTINCT user_id, event_type, (epoch(ts)::BIGINT // 86400)::VARCHAR AS date_bucket FROM events")
def stream_replay_dedupe(spark, sf_dir):
    return ingest.first_of_day(_events(spark, sf_dir), *ingest.paths_for(spark, "replay"))


@register(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, event_id, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOURS) IS NOT TRUE AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_sessions(spark, sf_dir):
    """Sessions that are closed at the final watermark."""
    table, checkpoint = ingest.paths_for(spark, "sessions")
    ingest.run_available(ingest.sessions(_events(spark, sf_dir)), lambda b, i: b.write.mode("overwrite").parquet(f"{table}/batch={i}"), checkpoint)
    return spark.read.parquet(table).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
