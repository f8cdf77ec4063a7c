"""Feature extraction as Arrow UDFs over array columns of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeprint.functions import dsp
from placeprint.operators import windows


def preprocess(samples: Column) -> Column:
    """Without mean, pre-emphasised, peak-normalised."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else dsp.preprocess(v))

    return run(samples)


def ingest_normalised(samples: Column, target: float = 0.95) -> Column:
    """To a peak of target; signals below 1e-6 stay as they are."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            if v is None or not len(v) or (peak := np.abs(v).max()) < 1e-6:
                return v
            return v * np.float32(target / peak)

        return x.map(one)

    return run(samples)


def features_104(samples: Column, profile: windows.Profile = windows.WIDE) -> Column:
    """The 104 numbers of a clip; null for null or no samples."""
    fmin, fmax = profile.fmin, profile.fmax

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or not len(v) else dsp.features_104(np.asarray(v), fmin, fmax))

    return run(samples)


def environment(samples: Column) -> Column:
    """struct of the nine environment features; nulls for null or no samples."""
    names = dsp.ENVIRONMENT

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[None] * len(names) if v is None or not len(v) else dsp.environment_features(np.asarray(v)) for v in x], columns=names)

    return run(samples)


def clips_of(files: DataFrame, seconds: float = 5.0, profile: windows.Profile = windows.WIDE, normalise: bool = True) -> DataFrame:
    """location, path, clip_index, samples of decoded files(location, path, samples): windows of each file by itself.

    Peak-normalised to 0.95 first if asked; silent windows are left out but keep their index.
    """
    x = ingest_normalised(F.col("samples")) if normalise else F.col("samples")
    cut = windows.array_windows(F.col("samples"), int(seconds * dsp.RATE), profile.short_files)
    out = files.where(F.col("samples").isNotNull()).withColumn("samples", x).select("location", "path", F.posexplode(cut).alias("clip_index", "samples"))
    return out.where(windows.audible_array(F.col("samples"), profile))


def joined_clips_of(files: DataFrame, seconds: float = 5.0, profile: windows.Profile = windows.WIDE, normalise: bool = True, fade: bool = True) -> DataFrame:
    """location, clip_index, samples, source_files, merged of decoded files(location, path, samples): windows of each
    location's files one after another, as training cuts them.

    Every file is peak-normalised by itself, seams are faded over 20 ms, the leftover of a location is dropped; silent
    windows are left out but keep their index.
    """
    x = ingest_normalised(F.col("samples")) if normalise else F.col("samples")
    known = files.where(F.col("samples").isNotNull()).withColumn("samples", x)
    out = windows.joined_windows(known, int(seconds * dsp.RATE), dsp.RATE // 100 if fade else 0).withColumnRenamed("window", "clip_index")
    return out.where(windows.audible_array(F.col("samples"), profile))


def wide(clips: DataFrame, vector: str = "vector", n: int = 104) -> DataFrame:
    """Feature_1..Feature_n instead of the array."""
    return clips.select(*[c for c in clips.columns if c != vector], *[F.col(vector)[i].alias(f"Feature_{i + 1}") for i in range(n)])


def narrow(table: DataFrame, n: int = 104, vector: str = "vector") -> DataFrame:
    """The array instead of Feature_1..Feature_n."""
    names = [f"Feature_{i + 1}" for i in range(n)]
    return table.select(*[c for c in table.columns if c not in names], F.array(*names).alias(vector))
