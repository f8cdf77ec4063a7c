"""Typed views over the tables of a dataset folder: what plays clips, signals and recordings there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, location, vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("clip_id"), F.format_string("loc_%d", "label").alias("location"), F.col("embedding").cast("array<double>").alias("vector"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, file (a day), ts, event_id, pos (within the stream), sample. A stream is a user, its order that of time."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("stream"), F.date_format("ts", "yyyy-MM-dd").alias("file"), "ts", "event_id",
        (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("value").alias("sample"),
    )


def centred(df: DataFrame) -> DataFrame:
    """The samples less their stream's mean, so that they have signs."""
    return df.withColumn("sample", F.col("sample") - F.avg("sample").over(Window.partitionBy("stream")))
