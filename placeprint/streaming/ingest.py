"""Structured Streaming twins of the batch operators: each runs what is available and ends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placeprint.functions import vectors
from placeprint.sources import artifacts, sinks
from placeprint.sources.shared import new_path


def file_stream(spark: SparkSession, root: str, name: str, archive: str | None = None, files_a_trigger: int | None = 1000) -> DataFrame:
    """A stream of the Parquet table name below root; processed files go to the archive if one is given.

    files_a_trigger: files of one micro-batch; None: all that are there. Files come in order of their modification, so an
    operator with a watermark that has to see rows in order of event time needs None, or files that arrive in that order.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{root}/{name}").schema)
    if files_a_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    at = f"{root}/{name}"
    is_dir = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    is_dir = is_dir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(is_dir).isDirectory()
    return reader.parquet(at) if is_dir else reader.option("pathGlobFilter", name).parquet(root)


def timed(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP (session zone UTC); watermarks take no other type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there in micro-batches, committed one by one in the checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to: the same after a restart, another one for any other checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def ingest(stream: DataFrame, table: str, key: str | tuple[str, ...], checkpoint: str) -> DataFrame:
    """Append rows to a Parquet table, each key once over all batches, restarts and streams: the table is its own ledger.

    A batch owns the partition (stream, batch) and replaces only that when it runs again; all other partitions are the
    ledger. Streams with checkpoints of their own may follow one another into one table, not write it at the same time.
    Of rows that share a key within a batch any one stays; a null key is new to every batch. In a key of several columns
    a null is a value like any other.
    """
    spark, known = stream.sparkSession, {}
    keys = [key] if isinstance(key, str) else list(key)

    def each(batch: DataFrame, number: int) -> None:
        own = known["id"] if known else known.setdefault("id", stream_id(spark, checkpoint))
        fresh = batch.dropDuplicates(keys)
        if artifacts.exists(spark, table):
            others, types = ~((F.col("stream") == own) & (F.col("batch") == number)), dict(batch.dtypes)
            schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "stream string, batch long"])
            there = spark.read.schema(schema).parquet(table).where(others).select(*[F.col(f"`{k}`").alias(f"there_{i}") for i, k in enumerate(keys)])
            same = [fresh[f"`{k}`"] == F.col(f"there_{i}") if len(keys) == 1 else fresh[f"`{k}`"].eqNullSafe(F.col(f"there_{i}")) for i, k in enumerate(keys)]
            fresh = fresh.join(there, same, "left_anti")
        fresh.withColumns({"stream": F.lit(own), "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(table)

    run_available(stream, each, checkpoint)
    return spark.read.parquet(table) if artifacts.exists(spark, table) else spark.createDataFrame([], stream.schema)


def upsert(stream: DataFrame, root: str, key: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Keep the last row of each key: every batch merges into a new version of the table below root.

    The table goes on from its last complete version after a restart and for a stream with another checkpoint. A batch
    that runs again merges the same rows a second time, which changes nothing. A batch has each key once (as an
    aggregation's updates do); of repeats within a batch all stay.
    """
    spark, table = stream.sparkSession, sinks.Versions(stream.sparkSession, root)

    def each(batch: DataFrame, number: int) -> None:
        last = table.read()
        table.put(batch if last is None else sinks.upserted(last, batch, key))

    run_available(stream, each, checkpoint, mode)
    last = table.read()
    return spark.createDataFrame([], stream.schema) if last is None else last


def _ema(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    level, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for x in rows["value"]:
        level, n = (x if level is None else 0.95 * level + 0.05 * x), n + 1
    state.update((float(level), n))
    yield pd.DataFrame({"stream": [key[0]], "n": [n], "baseline": [float(level)]})


def ema(events: DataFrame) -> DataFrame:
    """stream, n, baseline after each batch; order within a batch by (ts, event_id), across batches by arrival."""
    return events.groupBy("user_id").applyInPandasWithState(_ema, "stream long, n long, baseline double", "level double, n long", "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, size: int) -> DataFrame:
    """stream, window, n, total of full windows, with what is left over carried into the next batch."""

    def run(key, batches, state):
        held, done = state.get if state.exists else ([], 0)
        values = [*held, *pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"].tolist()]
        full = len(values) // size
        state.update((values[full * size :], done + full))
        totals = [float(sum(values[i * size : (i + 1) * size])) for i in range(full)]
        out = pd.DataFrame({"stream": [key[0]] * full, "window": list(range(done, done + full)), "n": [size] * full, "total": totals})
        yield out.astype({"stream": "int64", "window": "int64", "n": "int64", "total": "float64"})

    return events.groupBy("user_id").applyInPandasWithState(run, "stream long, window long, n long, total double", "held array<double>, done long", "append", GroupStateTimeout.NoTimeout)


def daily(events: DataFrame) -> DataFrame:
    """day, event_type, n, total: tumbling windows of a day."""
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


#: What a signal may come once a day by.
DAILY_KEY = ("user_id", "event_type", "date_bucket")


def first_of_day(events: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """user_id, event_type, date_bucket, each once: repeats are dropped as replays, however late they or the first ones come.

    The table is the ledger. No watermark is used, as it would drop the first signal of a day that comes late (or any from
    before 1970), and no state is held.
    """
    keyed = events.select("user_id", "event_type", vectors.date_bucket_of_second(F.col("ts")).alias("date_bucket"))
    return ingest(keyed, table, DAILY_KEY, checkpoint).select(*DAILY_KEY)


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """user_id, start, n of sessions with gaps below the given one."""
    s = events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def paths_for(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh paths of a table and its checkpoint."""
    root = new_path(spark, name)
    return f"{root}/table", f"{root}/checkpoint"
