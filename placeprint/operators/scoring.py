"""Baselines, scores of clips against them, and what follows from scores per window and per file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeprint.functions import classify, vectors
from placeprint.operators import joins

#: Baselines that are broadcast as one matrix: numbers in it at most (16 MB). More make several matrices.
MATRIX_NUMBERS = 2_000_000


def long_form(clips: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    """One row for each dimension: keys, pos, x."""
    return clips.select(*keys, F.posexplode(vector).alias("pos", "x"))


def mean_vectors(clips: DataFrame, by: str = "location", vector: str = "vector") -> DataFrame:
    """(by, vector): the mean of each dimension in each group. Partial sums before the shuffle, one row a dimension."""
    means = long_form(clips, by, vector=vector).groupBy(by, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


def global_stats(clips: DataFrame, eps: float = 1e-8) -> DataFrame:
    """pos, mean, std (population, plus eps), n over all clips."""
    return long_form(clips).groupBy("pos").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + eps).alias("std"), F.count("*").alias("n"))


def stats_row(stats: DataFrame) -> DataFrame:
    """The statistics as one row of two arrays."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return stats.agg(F.transform(rows, lambda s: s["mean"]).alias("mean"), F.transform(rows, lambda s: s["std"]).alias("std"))


def with_stats(clips: DataFrame, stats: DataFrame) -> DataFrame:
    """Clips with the columns mean and std; one row of a fixed size is broadcast."""
    return clips.crossJoin(F.broadcast(stats_row(stats)))


def normalised(clips: DataFrame, stats: DataFrame) -> DataFrame:
    """Clips with their vectors z-scored and cut at 3."""
    return with_stats(clips, stats).withColumn("vector", vectors.zscore(F.col("vector"), F.col("mean"), F.col("std"))).drop("mean", "std")


def _scores(spark, names: list[str], matrix: np.ndarray):
    """A pandas UDF: vector -> best score of each of the named groups of rows of the matrix."""
    unique = sorted(set(names))
    group = np.array([unique.index(n) for n in names])
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(unique)))
    shared = spark.sparkContext.broadcast((matrix[order], np.sqrt((matrix[order] ** 2).sum(axis=1)), starts))

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series) -> pd.Series:
        m, size, at = shared.value
        if not len(clips):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in clips])
        cos = (x @ m.T) / (np.sqrt((x**2).sum(axis=1))[:, None] * size + vectors.EPS)
        return pd.Series(list(np.maximum.reduceat(cos, at, axis=1)))

    return unique, run


def score(clips: DataFrame, baselines: DataFrame, *keys: str, matrix_numbers: int | None = None) -> DataFrame:
    """keys, base_location, score: the best cosine of each clip with any baseline of each location.

    baselines has location and vector, one or more rows a location. They are counted first: a set of up to matrix_numbers
    numbers becomes one broadcast matrix, and each Arrow batch of clips one matrix product. A larger set is dealt by hash
    into matrices of that size: the clips pass each of them where they lie, and the best is taken after partial
    aggregation. keys name a clip. Without baselines there are no rows.
    """
    known, matrix_numbers = baselines.select("location", "vector"), matrix_numbers or MATRIX_NUMBERS
    numbers = known.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-numbers // matrix_numbers)), None
    for block in range(blocks):
        own = known if blocks == 1 else known.where(F.pmod(F.xxhash64("location", "vector"), F.lit(blocks)) == block)
        rows = own.collect()
        if not rows:
            continue
        names, best = _scores(clips.sparkSession, [r[0] for r in rows], np.array([r[1] for r in rows]))
        part = clips.select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("l"), best("vector").alias("s"))).alias("x"))
        part = part.select(*keys, F.col("x.l").alias("base_location"), F.col("x.s").alias("score"))
        out = part if out is None else out.unionAll(part)
    if out is None:
        return clips.select(*keys).limit(0).withColumn("base_location", F.lit("")).withColumn("score", F.lit(0.0))
    return out if blocks == 1 else out.groupBy(*keys, "base_location").agg(F.max("score").alias("score"))


def best(scores: DataFrame, *keys: str, score_: str = "score", location: str = "base_location") -> DataFrame:
    """keys, best_location, best_score, margin to the second (null with one location). Ties: the first by name.

    One pass of partial aggregation instead of a sort by window: the two best of a key are all that is kept.
    """
    rank = F.struct((-F.col(score_)).alias("s"), F.col(location).alias("l"))
    top = scores.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(rank)), 1, 2).alias("top"))
    first = F.col("top")[0]
    return top.select(
        *keys, first["l"].alias("best_location"), (-first["s"]).alias("best_score"),
        F.when(F.size("top") > 1, F.try_element_at("top", F.lit(2))["s"] - first["s"]).alias("margin"),
    )


def matrix(scores: DataFrame, key: str, locations: list[str]) -> DataFrame:
    """One row a key, one column a location (null where there is no score), and the location of the largest."""
    wide = scores.groupBy(key).pivot("base_location", locations).agg(F.first("score"))
    return wide.join(best(scores, key).select(key, "best_location"), key)


def nearest(clips: DataFrame, queries: DataFrame, block_rows: int = 20_000, key: str = "clip_id") -> DataFrame:
    """key, nearest_id, nearest_location, similarity: of each query the most similar clip other than itself.

    Queries come in blocks of a fixed number of rows, each one matrix in a broadcast; all clips pass each block once as
    Arrow batches, which put out the best clip of the batch for each query. Ties: the smallest id.
    """
    spark = clips.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).select(key, "vector").toPandas() if n else None
        if own is None or own.empty:
            continue
        q = np.stack(own["vector"].map(np.asarray)).astype(np.float64)
        shared = spark.sparkContext.broadcast((own[key].to_numpy(), q, np.sqrt((q**2).sum(axis=1))))

        def run(batches, shared=shared):
            ids, q, size = shared.value
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["vector"].map(np.asarray)).astype(np.float64)
                mine, places = b[key].to_numpy(), b["location"].to_numpy()
                cos = (q @ x.T) / (size[:, None] * np.sqrt((x**2).sum(axis=1)) + vectors.EPS)
                cos[ids[:, None] == mine[None, :]] = -np.inf
                top = cos.max(axis=1)
                at = np.where(cos == top[:, None], mine[None, :], np.iinfo(np.int64).max).argmin(axis=1)
                ok = np.isfinite(top)
                yield pd.DataFrame({key: ids[ok], "nearest_id": mine[at[ok]], "nearest_location": places[at[ok]], "similarity": top[ok]})

        part = clips.select(key, "location", "vector").mapInPandas(run, f"{key} long, nearest_id long, nearest_location string, similarity double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], f"{key} long, nearest_id long, nearest_location string, similarity double")
    order = F.struct((-F.col("similarity")).alias("s"), F.col("nearest_id").alias("n"), F.col("nearest_location").alias("l"))
    return out.groupBy(key).agg(F.min(order).alias("m")).select(
        key, F.col("m.n").alias("nearest_id"), F.col("m.l").alias("nearest_location"), (-F.col("m.s")).alias("similarity"),
    )


def predict_files(scores: DataFrame, files: DataFrame, thresholds: classify.Thresholds, in_order: bool = False, low_windows: int = 2) -> DataFrame:
    """Records of files from scores (file, window, base_location, score) and the list of files.

    Mean score and votes of each location, best match, margin, confidence, drift class, open-set verdict and message. A
    file without a usable window is REJECTED_LOW_QUALITY with nulls. low_windows: as many windows or fewer are flagged.
    """
    votes = best(scores, "file", "window").groupBy("file", F.col("best_location").alias("base_location")).agg(F.count("*").alias("votes"))
    mean = scores.groupBy("file", "base_location").agg(F.avg("score").alias("score"), F.count("*").alias("windows"))
    mean = mean.join(votes, ["file", "base_location"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    maps = mean.groupBy("file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("base_location", "score")))).alias("avg_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("base_location", "votes")))).alias("vote_counts"),
        F.max("windows").alias("num_windows"), F.count("*").alias("known"),
    )
    top = best(mean, "file")
    rule = classify.drift_class_in_order if in_order else classify.drift_class
    out = files.select("file").join(maps, "file", "left").join(top, "file", "left").withColumn("num_windows", F.coalesce("num_windows", F.lit(0)))
    out = out.withColumn(
        "status",
        F.when(F.col("num_windows") == 0, "REJECTED_LOW_QUALITY").otherwise(rule(F.col("best_score"), F.lit(thresholds.stable), F.lit(thresholds.moderate))),
    )
    verdict = F.when(F.col("num_windows") > 0, classify.open_set(F.col("status"), F.col("best_location")))
    return out.select(
        "file", "num_windows", "avg_scores", "vote_counts", F.col("best_location").alias("final_match"), F.col("best_score").alias("final_score"), "status", verdict.alias("location_verdict"),
        classify.open_set_message(F.col("status"), F.col("best_location"), F.col("best_score"), F.col("known")).alias("verdict_message"), "margin", classify.confidence(F.col("margin")).alias("confidence"),
        (F.col("num_windows").between(1, low_windows)).alias("few_windows"),
    )


def majority(votes: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """key, match, share, windows: the most frequent vote of each key and its share; of equals, the one that comes first
    in order."""
    counted = votes.groupBy(key, vote).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    best_ = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("f"), F.col(vote).alias("v")))
    out = counted.groupBy(key).agg(best_.alias("b"), F.sum("__n").alias("windows"))
    return out.select(key, F.col("b.v").alias("match"), (-F.col("b.n") / F.col("windows")).alias("share"), "windows")


def verification(scores: DataFrame, files: DataFrame, thresholds: classify.Thresholds, in_order: bool = False) -> DataFrame:
    """The report of held-out files(file, location) from scores (file, window, base_location, score): expected_location,
    num_windows, all_scores, best_match, best_score, best_status, expected_score, expected_status, correct_match, margin.

    Files without a usable window, and those of locations that no baseline has, are left out.
    """
    rule = classify.drift_class_in_order if in_order else classify.drift_class
    found = predict_files(scores, files, thresholds, in_order).where("num_windows > 0")
    out = files.select("file", F.col("location").alias("expected_location")).join(found, "file")
    out = out.withColumn("expected_score", F.try_element_at("avg_scores", F.col("expected_location"))).where("expected_score is not null")
    expected = rule(F.col("expected_score"), F.lit(thresholds.stable), F.lit(thresholds.moderate))
    return out.select(
        "file", "expected_location", "num_windows", F.col("avg_scores").alias("all_scores"), F.col("final_match").alias("best_match"), F.col("final_score").alias("best_score"),
        F.col("status").alias("best_status"), "expected_score", expected.alias("expected_status"), (F.col("final_match") == F.col("expected_location")).alias("correct_match"), "margin",
    )


def same_and_different(scores: DataFrame, own: Column) -> DataFrame:
    """Scores with the flag same: whether the base is the clip's own location."""
    return scores.withColumn("same", F.col("base_location") == own)


def population_stats(scores: DataFrame) -> DataFrame:
    """same, mean, min, max, std (population), n."""
    return scores.groupBy("same").agg(
        F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.stddev_pop("score").alias("std"),
        F.count("*").alias("n"),
    )


def _sides(scores: DataFrame, same: list[float], different: list[float]) -> tuple[list[float | None], list[float | None]]:
    """Percentiles (0 to 100) of the scores with the own location, and of those with others."""
    return tuple(joins.percentiles(scores.where(side), "score", [p / 100 for p in some]) for side, some in ((F.col("same"), same), (~F.col("same"), different)))


def calibrated(scores: DataFrame, stable_percentile: float = 10, moderate_percentile: float = 90, override_stable: float | None = None, override_moderate: float | None = None) -> DataFrame:
    """stable_threshold, moderate_threshold, valid, manual_override: exact percentiles with linear interpolation.

    One row, worked out at once; no task or buffer holds all scores (joins.percentiles).
    """
    (s,), (m,) = _sides(scores, [stable_percentile], [moderate_percentile])
    s, m = (own if given is None else float(given) for own, given in ((s, override_stable), (m, override_moderate)))
    row = (s, m, None if s is None or m is None else s > m, override_stable is not None or override_moderate is not None)
    return scores.sparkSession.createDataFrame([row], "stable_threshold double, moderate_threshold double, valid boolean, manual_override boolean")


#: Percentile pairs that are tried in turn.
CANDIDATES = ((10, 90), (15, 85), (20, 80), (25, 75), (30, 70), (35, 65), (40, 60))


def candidate_pairs(scores: DataFrame, pairs=CANDIDATES) -> DataFrame:
    """ordinal, low, high, stable, moderate, valid, chosen: every pair, the first valid one chosen."""
    stable, moderate = _sides(scores, [a for a, _ in pairs], [b for _, b in pairs])
    valid = [None if s is None or m is None else s > m for s, m in zip(stable, moderate)]
    first = valid.index(True) if True in valid else None
    rows = [(i, a, b, s, m, ok, i == first) for i, ((a, b), s, m, ok) in enumerate(zip(pairs, stable, moderate, valid))]
    return scores.sparkSession.createDataFrame(rows, "ordinal int, low int, high int, stable double, moderate double, valid boolean, chosen boolean")


def environment_thresholds(levels: DataFrame, label: str = "label", level: str = "level") -> DataFrame:
    """quiet_threshold (90th percentile of quiet), noisy_threshold (10th of noisy); raises if a label is missing or they cross."""
    (quiet,), (noisy,) = (joins.percentiles(levels.where(F.col(label) == name), level, [share]) for name, share in (("quiet", 0.9), ("noisy", 0.1)))
    if quiet is None or noisy is None:
        raise ValueError("both quiet and noisy rows are needed")
    if quiet >= noisy:
        raise ValueError("quiet threshold isn't below noisy threshold")
    return levels.sparkSession.createDataFrame([(quiet, noisy)], "quiet_threshold double, noisy_threshold double")


def ranked(df: DataFrame, by: list, *order) -> DataFrame:
    """df with rank, from 1, in each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
