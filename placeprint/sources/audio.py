"""Recordings: directory scans and the decoder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeprint.functions import dsp, paths

#: Recordings by extension.
DECODED = (".wav",)
KNOWN = (".wav", ".amr")


def scan_files(spark: SparkSession, *roots: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Files below the roots: path, length, modificationTime, content (read only if it is used)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(list(roots))


def list_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Recordings right in a folder, extensions in lower case only, sorted by path."""
    return scan_files(spark, root, recursive=False, pattern="*.{wav,amr}").orderBy("path")


def scan_locations(spark: SparkSession, root: str) -> DataFrame:
    """Recordings in the folders of a root, extensions in any case; the folder is the location."""
    files = scan_files(spark, f"{root}/*", recursive=False)
    return files.where(paths.extension(F.col("path")).isin(*KNOWN)).withColumn("location", paths.parent(F.col("path")))


def scan_flat(spark: SparkSession, root: str) -> DataFrame:
    """Recordings right in a folder, all of the location unlabeled."""
    files = scan_files(spark, root, recursive=False)
    return files.where(paths.extension(F.col("path")).isin(*KNOWN)).withColumn("location", F.lit("unlabeled"))


def scan_three_levels(spark: SparkSession, root: str) -> DataFrame:
    """root/location/recording/file.wav, as three columns and the content."""
    files = scan_files(spark, f"{root}/*/*", recursive=False)
    p = F.col("path")
    return files.where(paths.extension(p) == ".wav").select(
        paths.parent(p, 2).alias("location"), paths.parent(p).alias("recording"), paths.basename(p).alias("filename"), p, "content",
    )


def locations(files: DataFrame) -> DataFrame:
    """Distinct locations, sorted."""
    return files.select("location").distinct().orderBy("location")


def routed(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with the profile that their extension asks for: wide (wav), narrow (amr), unsupported."""
    ext = paths.extension(F.col(path))
    return files.withColumn("profile", F.when(ext == ".wav", "wide").when(ext == ".amr", "narrow").otherwise("unsupported"))


def decode(path: Column, content: Column) -> Column:
    """struct(samples, error): mono samples at 16 kHz, or why there are none. A file that fails doesn't fail the query."""

    @F.pandas_udf("samples array<float>, error string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, raw in zip(names, contents):
            try:
                if not (name or "").lower().endswith(DECODED):
                    raise dsp.UnsupportedAudio(f"unsupported audio format: {name}")
                out.append((dsp.decode_wav(bytes(raw)).tolist(), None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["samples", "error"])

    return run(path, content)


def decoded(files: DataFrame) -> DataFrame:
    """Files with samples and error instead of content."""
    return files.withColumn("__audio", decode(F.col("path"), F.col("content"))).select(*[c for c in files.columns if c != "content"], "__audio.samples", "__audio.error")
