"""Sinks: clips as Parquet or WAV, CSV and JSON results, upserts, runs, model bundles, archives."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeprint.functions import dsp, paths


def write_clips(clips: DataFrame, path: str, pcm16: bool = False) -> None:
    """Clips (location, clip_index, samples, ...) as Parquet by location; pcm16 applies the rounding of 16-bit files."""
    if pcm16:

        @F.pandas_udf("array<float>")
        def rounded(samples: pd.Series) -> pd.Series:
            return samples.map(dsp.pcm16)

        clips = clips.withColumn("samples", rounded("samples"))
    clips.write.mode("overwrite").partitionBy("location").parquet(path)


def wav_bytes(clips: DataFrame) -> DataFrame:
    """location, name and the bytes of a 16-bit WAV file of each clip."""

    @F.pandas_udf("binary")
    def encoded(samples: pd.Series) -> pd.Series:
        return samples.map(dsp.encode_wav)

    return clips.select("location", paths.clip_name(F.col("location"), F.col("clip_index")).alias("name"), encoded("samples").alias("content"))


def write_wav(clips: DataFrame, root: str) -> DataFrame:
    """WAV files root/location/name.wav on a file system that all executors mount; the rows are the files written."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for location, name, content in zip(b["location"], b["name"], b["content"]):
                folder = os.path.join(root, location)
                os.makedirs(folder, exist_ok=True)
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))  # a retried task leaves the same file
                out.append((location, os.path.join(folder, name), len(content)))
            yield pd.DataFrame(out, columns=["location", "path", "length"])

    return wav_bytes(clips).mapInPandas(run, "location string, path string, length long")


def segments(files: DataFrame, seconds: int = 10, rate: int = dsp.RATE) -> DataFrame:
    """Fixed segments of decoded files (path, samples), the short last one included: path, segment, samples."""
    n, size = F.size("samples"), seconds * rate
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"), F.lit(size)), lambda i: F.slice("samples", i + 1, F.lit(size)))
    return files.where(n > 0).select("path", F.posexplode(cut).alias("segment", "samples"))


def preview(files: DataFrame, start: float, seconds: float, rate: int = dsp.RATE) -> DataFrame:
    """A stretch of each decoded file for listening."""
    return files.select("path", F.slice("samples", int(start * rate) + 1, int(seconds * rate)).alias("samples"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; refuses an empty table, as a feature file without rows means that nothing was usable."""
    if df.limit(1).count() == 0:
        raise ValueError("no rows to write")
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON, replacing what was there."""
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key has no new row, and all new rows."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest_run(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the last run."""
    return runs.join(runs.agg(F.max(run).alias(run)), run, "left_semi")


def archive(spark: SparkSession, files: DataFrame, folder: str, retries: int = 5, delay: float = 0.5) -> DataFrame:
    """path, moved_to: the files (path) of one batch, moved to a folder under names that aren't taken there.

    A move that fails is tried again; where all tries fail the file stays and moved_to is null, which does no harm as
    long as a ledger, not the folder, says what has been processed. The driver renames; nothing is copied.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    taken = spark.createDataFrame([(f.getPath().getName(),) for f in fs.listStatus(path(folder))], "name string")
    rows = []
    for r in archived_names(files.select("path"), taken).orderBy("path").collect():
        to, moved = f"{folder}/{r['archived']}", False
        for attempt in range(retries):
            try:
                moved = fs.rename(path(r["path"]), path(to))
            except Py4JJavaError:
                moved = False
            if moved:
                break
            time.sleep(delay if attempt + 1 < retries else 0)
        rows.append((r["path"], to if moved else None))
    return spark.createDataFrame(rows, "path string, moved_to string")


def archived_names(files: DataFrame, taken: DataFrame, path: str = "path") -> DataFrame:
    """Files with the name under which they go to the archive: their own, or with _1, _2, ... where that is taken.

    taken has the names (column name) that the archive holds. Suffixes go on from the highest one there.
    """
    p = F.col(path)
    own = files.withColumn("__stem", paths.stem(p)).withColumn("__ext", F.regexp_extract(paths.basename(p), r"(?<=.)(\.[^.]*)$", 1))
    there = taken.select(F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("s"), F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1).alias("__ext"))
    there = there.select(
        F.regexp_replace("s", r"_[0-9]+$", "").alias("__stem"), "__ext",
        F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("s", r"_([0-9]+)$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("int").alias("n"),
    )
    there = there.unionByName(taken.select(F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("__stem"), F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1).alias("__ext"), F.lit(0).alias("n")))
    highest = there.groupBy("__stem", "__ext").agg((F.max("n") + 1).alias("__free"))
    out = own.join(highest, ["__stem", "__ext"], "left")
    place = F.row_number().over(Window.partitionBy("__stem", "__ext").orderBy(path)) - 1 + F.coalesce("__free", F.lit(0))
    return out.withColumn("archived", F.concat("__stem", F.when(place > 0, F.concat(F.lit("_"), place.cast("string"))).otherwise(""), "__ext")).drop(
        "__stem", "__ext", "__free",
    )


class Versions:
    """A table of which every write is a whole new version below root: v0, v1, ... A version counts once its mark v0.done
    is there, so a write that was cut short is never read, and the next one replaces it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def complete(self) -> list[int]:
        """Numbers of the versions that count, in order."""
        if not self.files.exists(self.path(self.root)):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(self.root))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def read(self) -> DataFrame | None:
        there = self.complete()
        return self.spark.read.parquet(f"{self.root}/v{there[-1]}") if there else None

    def put(self, df: DataFrame) -> None:
        """Write the next version and remove those before the last one, which readers may still have open."""
        there = self.complete()
        number = there[-1] + 1 if there else 0
        df.write.mode("overwrite").parquet(f"{self.root}/v{number}")
        self.files.create(self.path(f"{self.root}/v{number}.done"), True).close()
        for old in there[:-1]:
            self.files.delete(self.path(f"{self.root}/v{old}.done"), False)
            self.files.delete(self.path(f"{self.root}/v{old}"), True)


def save_model(model, path: str) -> None:
    """A fitted pipeline with all its stages."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
