"""The ways to use the library end to end: train on recordings, verify on held-out ones, score incoming files, classify
environments.

Each is one plan over tables: features are computed once and written to the shared folder, all that follows reads them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeprint.functions import classify, dsp, paths, vectors
from placeprint.operators import features, learning, scoring, sets, windows
from placeprint.plans.files import folder, put_file, recordings
from placeprint.plans.registry import register
from placeprint.sources import audio, sinks
from placeprint.sources.shared import new_path, written


@dataclass
class Trained:
    """clips (with vectors and source files), stats, baselines (location, sub_id, vector), thresholds (one row), and the
    seconds that each stage took."""

    clips: DataFrame
    stats: DataFrame
    baselines: DataFrame
    thresholds: DataFrame
    profile: windows.Profile
    clip_seconds: float
    seconds: dict[str, float] = field(default_factory=dict)

    def pair(self) -> classify.Thresholds:
        """The thresholds, or those of an uncalibrated system where there are none."""
        t = self.thresholds.first()
        or_else = lambda x, y: y if x is None else x
        return classify.Thresholds(or_else(t["stable_threshold"], classify.UNCALIBRATED.stable), or_else(t["moderate_threshold"], classify.UNCALIBRATED.moderate))


def in_stage(seconds: dict[str, float], name: str, run: Callable):
    """The result of run, its wall time noted under the name of the stage."""
    began = time.monotonic()
    try:
        return run()
    finally:
        seconds[name] = time.monotonic() - began


def feature_table(spark: SparkSession, files: DataFrame, profile: windows.Profile = windows.WIDE, clip_seconds: float = 5.0) -> DataFrame:
    """clip_id, location, clip_index, source_files, merged, vector of all audible clips of files(location, path, content):
    each location's files one after another."""
    clips = features.joined_clips_of(audio.decoded(files).where("error is null"), clip_seconds, profile)
    vector = features.features_104(features.preprocess(F.col("samples")), profile)
    out = clips.select("location", "clip_index", "source_files", "merged", vector.alias("vector"))
    return written(out.withColumn("clip_id", F.xxhash64("location", F.col("source_files")[0], "clip_index")), "features")


def train(spark: SparkSession, root: str, profile: windows.Profile = windows.WIDE, clip_seconds: float = 5.0, stable_percentile: float = 10, moderate_percentile: float = 90,
          override_stable: float | None = None, override_moderate: float | None = None, seen: DataFrame | None = None, held_out: DataFrame | None = None) -> Trained:
    """Recordings to statistics, sub-baselines and thresholds. Files of the ledger ``seen`` (path) and of the split
    ``held_out`` (location, path) are left out, undecoded."""
    files, seconds = audio.scan_locations(spark, root), {}
    for ledger in (seen, held_out):
        files = files if ledger is None else sets.unseen(files, ledger)
    clips = in_stage(seconds, "features", lambda: feature_table(spark, files, profile, clip_seconds))
    stats = in_stage(seconds, "statistics", lambda: written(scoring.global_stats(clips), "stats"))
    scaled = scoring.normalised(clips, stats)
    baselines = in_stage(seconds, "baselines", lambda: learning.kmeans_by_location(scaled).select("location", "sub_id", F.col("centroid").alias("vector")))
    scores = in_stage(seconds, "scores", lambda: written(scoring.score(scaled, baselines, "clip_id", "location"), "scores"))
    flagged = scoring.same_and_different(scores, F.col("location"))
    thresholds = in_stage(seconds, "thresholds", lambda: scoring.calibrated(flagged, stable_percentile, moderate_percentile, override_stable, override_moderate))
    return Trained(clips, stats, baselines, thresholds, profile, clip_seconds, seconds)


def window_scores(files: DataFrame, trained: Trained) -> tuple[DataFrame, DataFrame]:
    """Vectors (file, window, vector) of files(path, location, content), each cut by itself, and their scores."""
    clips = features.clips_of(audio.decoded(files).where("error is null"), trained.clip_seconds, trained.profile)
    vector = features.features_104(features.preprocess(F.col("samples")), trained.profile)
    clips = written(clips.select(F.col("path").alias("file"), F.col("clip_index").alias("window"), vector.alias("vector")), "incoming")
    return clips, scoring.score(scoring.normalised(clips, trained.stats), trained.baselines, "file", "window")


def predict(spark: SparkSession, files: DataFrame, trained: Trained, device: str = "unregistered_test_device", ledger: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """A record of every file of files(path, location, content): scores, votes, match, margin, confidence, status, verdict
    and window hashes. Files of the ledger (path) are left out, as are those in the folders of clips and archives."""
    files = files if ledger is None else sets.unseen(files, ledger)
    files = sets.without_folders(files, "_chunks", "_processed")
    clips, scores = window_scores(files, trained)
    records = scoring.predict_files(scores, files.select(F.col("path").alias("file")), trained.pair(), in_order)
    q = vectors.quantise(vectors.zscore_single(F.col("vector"), F.col("mean"), F.col("std")))
    hashed = scoring.with_stats(clips, trained.stats).select("file", "window", vectors.location_hash(q, F.lit(device), vectors.date_bucket(F.current_timestamp())).alias("h"))
    hashes = hashed.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "h"))), lambda s: s["h"]).alias("acoustic_hashes"))
    return records.join(hashes, "file", "left").withColumn("device_id", F.lit(device)).withColumn("date_bucket", vectors.date_bucket(F.current_timestamp()))


def incoming(spark: SparkSession, root: str, trained: Trained, table: sinks.Versions, files_a_commit: int = 1000) -> DataFrame:
    """Score what has been dropped into a folder: name, record fields, moved_to of the files that were new.

    The table of records, by file name, is the ledger: a file in it is not scored again, wherever it lies. New files are
    taken in order of their paths, so many at a time; each lot's records are committed before its files are moved to
    _processed, so a crash loses nothing and repeats at most one lot's scoring.
    """
    done = []
    there = audio.scan_flat(spark, root).select("path", "location", "content")
    known = table.read()
    names = there.select("path", paths.basename(F.col("path")).alias("name"))
    new = [r["path"] for r in (names if known is None else sets.unseen(names, known, "name")).orderBy("path").collect()]
    for i in range(0, len(new), files_a_commit):
        lot = audio.scan_files(spark, *new[i : i + files_a_commit]).withColumn("location", F.lit("unlabeled"))
        records = written(predict(spark, lot, trained).withColumn("name", paths.basename(F.col("file"))), "records")
        last = table.read()
        table.put(records if last is None else sinks.upserted(last, records, "name"))
        moved = sinks.archive(spark, records.select(F.col("file").alias("path")), f"{root}/_processed")
        done.append(records.join(F.broadcast(moved), F.col("file") == F.col("path"), "left").drop("path"))
    if not done:
        return spark.createDataFrame([], "name string, status string, moved_to string")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def split(files: DataFrame, table: sinks.Versions, share: float = 0.2, seed: int | str = 42, extend: bool = True) -> DataFrame:
    """location, path of held-out files, kept in a table: locations that are in it stay as they were drawn, new ones are
    drawn and added (extend=False: an existing split is returned untouched)."""
    last = table.read()
    if last is not None and not extend:
        return last
    new = files.select("location", "path")
    new = new if last is None else new.join(last.select("location").distinct(), "location", "left_anti")
    drawn = written(sets.holdout(new, "location", "path", share, seed).where("held_out").select("location", "path"), "split")
    if last is None or drawn.limit(1).count():
        table.put(drawn if last is None else last.unionByName(drawn))
    return table.read()


def verify(spark: SparkSession, root: str, held_out: DataFrame, trained: Trained, in_order: bool = False) -> DataFrame:
    """The verification report of held-out files(location, path) below root, with leaked: whether a training clip draws on
    the file. Files of locations without a baseline and files without usable audio are left out."""
    files = audio.scan_locations(spark, root).join(held_out.select("path"), "path", "left_semi")
    files = files.join(trained.baselines.select("location").distinct(), "location", "left_semi").select("path", "location", "content")
    _, scores = window_scores(files, trained)
    report = scoring.verification(scores, files.select(F.col("path").alias("file"), "location"), trained.pair(), in_order)
    leaked = sets.leaked(files.select("path"), trained.clips).select(F.col("path").alias("file")).distinct().withColumn("leaked", F.lit(True))
    out = report.join(leaked, "file", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
    return out.withColumn("key", F.concat_ws("/", "expected_location", paths.basename(F.col("file"))))


def environment_table(files: DataFrame, clip_seconds: float = 5.0, joined: bool = True) -> DataFrame:
    """location, source_files (names joined with +), clip_index and the nine features of files(location, path, content):
    windows of each location's files one after another, silent ones left out; or of each file by itself, all of them."""
    decoded = audio.decoded(files).where("error is null")
    if joined:
        clips = features.joined_clips_of(decoded, clip_seconds, windows.ENVIRONMENT, normalise=False, fade=False)
    else:
        cut = windows.array_windows(F.col("samples"), int(clip_seconds * dsp.RATE), "whole")
        clips = decoded.where(F.size("samples") > 0).select("location", F.array("path").alias("source_files"), F.posexplode(cut).alias("clip_index", "samples"))
    clips = clips.withColumn("f", features.environment(F.col("samples")))
    names = F.array_distinct(F.transform("source_files", paths.basename))
    return clips.select("location", paths.joined(names).alias("source_files"), F.col("clip_index").cast("long").alias("clip_index"), "f.*")


def environments(spark: SparkSession, root: str, clip_seconds: float = 5.0, k: int = 3) -> DataFrame:
    """location, source_files, clip_index, nine features, and the label of the cluster that their noise floor ranks."""
    table = written(environment_table(audio.scan_locations(spark, root), clip_seconds), "environment")
    rows = table.withColumn("vector", F.array(*dsp.ENVIRONMENT)).withColumn("clip_id", F.xxhash64("location", "source_files", "clip_index"))
    labels = learning.cluster_and_label(rows, k).select("clip_id", "level", "label", "distance_to_centroid")
    return rows.join(labels, "clip_id").drop("vector", "clip_id")


@dataclass
class EnvironmentModel:
    """A fitted pipeline, the rows whose statistics scale its input, its labels, and rule thresholds if there are any."""

    model: object
    train: DataFrame
    labels: list[str]
    thresholds: tuple[float, float] | None = None


def train_environment(table: DataFrame, kind: str = "logistic", thresholds: tuple[float, float] | None = None) -> EnvironmentModel:
    """A classifier of labelled rows(label, nine features)."""
    rows = table.select(F.col("label").alias("location"), F.array(*dsp.ENVIRONMENT).alias("vector"))
    labels = [r[0] for r in rows.select("location").distinct().orderBy("location").collect()]
    return EnvironmentModel(learning.train(learning.prepared(learning.standardised(rows)), kind), rows, labels, thresholds)


def predict_environment(files: DataFrame, trained: EnvironmentModel, clip_seconds: float = 5.0) -> DataFrame:
    """file, num_windows, ml_prediction, ml_confidence, window_agreement, class_probabilities, and rule_based_prediction
    and agrees_with_rule_based (null without thresholds) of files(location, path, content).

    Every window of a file votes, silent or not; of equal votes the one that came first wins. Probabilities are means
    over windows, rounded to three digits.
    """
    table = environment_table(files.withColumn("location", F.col("path")), clip_seconds, joined=False)
    rows = table.select(F.col("location").alias("file"), F.col("clip_index").alias("window"), F.array(*dsp.ENVIRONMENT).alias("vector"), "noise_floor_rms")
    scaled = learning.standardised(rows, trained.train)
    out = learning.with_probabilities(trained.model, scaled.withColumn("features", learning.array_to_vector("vector")), trained.labels)
    out = written(out.select("file", "window", "predicted", "probabilities", "noise_floor_rms"), "environment-votes")
    votes = scoring.majority(out, "file", "predicted", "window")
    mean = out.select("file", F.explode("probabilities").alias("label", "p")).groupBy("file", "label").agg(F.bround(F.avg("p"), 3).alias("p"))
    mean = mean.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("class_probabilities"))
    found = votes.join(mean, "file").select(
        "file", F.col("windows").alias("num_windows"), F.col("match").alias("ml_prediction"), F.try_element_at("class_probabilities", F.col("match")).alias("ml_confidence"),
        F.bround("share", 3).alias("window_agreement"), "class_probabilities",
    )
    if trained.thresholds is None:
        return found.withColumn("rule_based_prediction", F.lit(None).cast("string")).withColumn("agrees_with_rule_based", F.lit(None).cast("boolean"))
    ruled = out.withColumn("rule", classify.environment_rule(F.col("noise_floor_rms"), *trained.thresholds))
    ruled = scoring.majority(ruled, "file", "rule", "window").select("file", F.col("match").alias("rule_based_prediction"))
    return found.join(ruled, "file").withColumn("agrees_with_rule_based", F.col("rule_based_prediction") == F.col("ml_prediction"))


@register("training_flow")
def training_flow(spark, sf_dir):
    """Thresholds and the number of baselines after training on the synthesised recordings."""
    t = train(spark, folder(spark))
    n = t.baselines.agg(F.count("*").alias("baselines"), F.count_distinct("location").alias("locations"))
    return t.thresholds.crossJoin(n)


_CLIPS = """VALUES ('office', 0, 'noise.WAV', false), ('office', 1, 'sine_440.wav', false), ('office', 2, 'sine_440.wav', false), ('park', 0, 'part_0.wav+part_1.wav+part_2.wav', true),
('street', 0, 'quiet_peak.wav', false), ('street', 1, 'quiet_peak.wav+short.wav+silence.wav', true)"""


@register("training_clips", f"SELECT * FROM ({_CLIPS}) t(location, clip_index, sources, merged)")
def training_clips(spark, sf_dir):
    """The clips that training cuts from each location's files one after another, and the files that each draws on."""
    t = feature_table(spark, audio.scan_locations(spark, folder(spark)))
    names = paths.joined(F.transform("source_files", paths.basename))
    return t.select("location", F.col("clip_index").cast("int").alias("clip_index"), names.alias("sources"), "merged")


@register(
    "stage_times",
    "SELECT * FROM (VALUES ('features', true), ('statistics', true), ('baselines', true), ('scores', true), ('thresholds', true)) t(stage, measured)",
)
def stage_times(spark, sf_dir):
    """The stages of a training run, each with its wall time."""
    t = train(spark, folder(spark))
    return spark.createDataFrame(list(t.seconds.items()), "stage string, seconds double").select("stage", (F.col("seconds") > 0).alias("measured"))


@register("predict_flow")
def predict_flow(spark, sf_dir):
    """The synthesised recordings scored against baselines of themselves."""
    root = folder(spark)
    r = predict(spark, audio.scan_locations(spark, root), train(spark, root))
    return r.select(
        paths.basename(F.col("file")).alias("name"), "num_windows", "final_match", "status", "location_verdict", "confidence",
        F.size("acoustic_hashes").alias("hashes"),
    )


@register("drop_directory_flow", "SELECT * FROM (VALUES ('first', 'again.wav', 1), ('first', 'tone.wav', 1), ('second', 'tone_late.wav', 1)) t(run, name, moved)")
def drop_directory_flow(spark, sf_dir):
    """Files dropped into a folder, scored once and moved: a second run scores only what is new, though a name comes again."""
    t, root, content = train(spark, folder(spark)), new_path(spark, "drop"), recordings()
    table = sinks.Versions(spark, new_path(spark, "predictions"))
    put_file(spark, f"{root}/tone.wav", content["office/sine_440.wav"])
    put_file(spark, f"{root}/again.wav", content["street/short.wav"])
    first = written(incoming(spark, root, t, table, files_a_commit=1), "first")
    put_file(spark, f"{root}/tone_late.wav", content["office/sine_440.wav"])
    put_file(spark, f"{root}/again.wav", content["office/noise.WAV"])
    second = written(incoming(spark, root, t, table), "second")
    rows = [d.select(F.lit(run).alias("run"), "name", F.col("moved_to").isNotNull().cast("int").alias("moved")) for run, d in (("first", first), ("second", second))]
    return rows[0].unionAll(rows[1])


@register("verification_flow", "SELECT * FROM (VALUES ('office', 1, false), ('street', 1, false)) t(expected_location, files, leaked)")
def verification_flow(spark, sf_dir):
    """Held-out files of a kept split, scored against baselines of the others."""
    root = new_path(spark, "recordings")
    for name, content in recordings().items():
        for i in range(2 if name.startswith(("office/sine", "street/short")) else 0):
            put_file(spark, f"{root}/{name.replace('.wav', f'_{i}.wav')}", content)
    held_out = split(audio.scan_locations(spark, root), sinks.Versions(spark, new_path(spark, "split")))
    report = verify(spark, root, held_out, train(spark, root, clip_seconds=2.0, held_out=held_out))
    return report.groupBy("expected_location").agg(F.count("*").cast("int").alias("files"), F.bool_or("leaked").alias("leaked"))


@register("environment_flow")
def environment_flow(spark, sf_dir):
    return environments(spark, folder(spark))


@register("environment_prediction_flow")
def environment_prediction_flow(spark, sf_dir):
    """Every recording's environment by a classifier of the clustered clips, beside the rule's."""
    root = folder(spark)
    table = written(environments(spark, root), "environments")
    model = train_environment(table, "logistic", thresholds=(0.02, 0.09))
    out = predict_environment(audio.scan_locations(spark, root), model)
    return out.withColumn("name", paths.basename(F.col("file"))).drop("file")


@register(
    "three_level_scan",
    "SELECT split_part(p, '/', 1) AS location, split_part(p, '/', 2) AS recording, split_part(p, '/', 3) AS filename FROM (SELECT 'site/' || "
    "unnest(['office/sine_440.wav', 'office/noise.WAV', 'street/silence.wav', 'street/short.wav', 'street/quiet_peak.wav', 'park/corrupt.wav', 'park/part_0.wav', "
    "'park/part_1.wav', 'park/part_2.wav']) AS p)",
)
def three_level_scan(spark, sf_dir):
    """location/recording/file.wav."""
    return audio.scan_three_levels(spark, folder(spark, "site")).select("location", "recording", "filename")
