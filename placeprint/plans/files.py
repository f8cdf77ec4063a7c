"""Queries over files: synthesised recordings are written to the shared folder, scanned, decoded, cut and stored."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from placeprint.functions import dsp, paths, vectors
from placeprint.operators import features, scoring, sets, windows
from placeprint.plans.registry import register
from placeprint.sources import artifacts, audio, sinks
from placeprint.sources.shared import new_path, written


def put_file(spark, path: str, content: bytes) -> None:
    """Write a small file on any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


def recordings() -> dict[str, bytes]:
    """Name -> bytes: tones, noise, silence, short, stereo, broken and foreign files in three folders."""
    rng, t = np.random.default_rng(5), np.arange(12 * dsp.RATE) / dsp.RATE
    noise = rng.normal(0, 0.1, 5 * dsp.RATE)
    out = {
        "office/sine_440.wav": dsp.encode_wav(0.5 * np.sin(2 * np.pi * 440 * t)),
        "office/noise.WAV": dsp.encode_wav(noise),
        "street/silence.wav": dsp.encode_wav(np.zeros(5 * dsp.RATE)),
        "street/short.wav": dsp.encode_wav(0.3 * np.sin(2 * np.pi * 1000 * t[: 3 * dsp.RATE])),
        "street/quiet_peak.wav": dsp.encode_wav(0.047 * np.sin(2 * np.pi * 250 * t[: 6 * dsp.RATE])),
        "park/corrupt.wav": bytes(range(256)),
        "park/call.amr": b"#!AMR\n",
        "park/notes.txt": b"no recording",
    }
    for i in range(3):
        out[f"park/part_{i}.wav"] = dsp.encode_wav(rng.normal(0, 0.2, 2 * dsp.RATE))
    return out


def folder(spark, site: str | None = None) -> str:
    """A fresh folder with the recordings, or one that holds them in a folder of its own."""
    top = new_path(spark, "recordings")
    root = f"{top}/{site}" if site else top
    for name, content in recordings().items():
        put_file(spark, f"{root}/{name}", content)
    return top


#: The recordings as SQL: folder, name, seconds that decode (null: none).
_FILES = """files AS (SELECT * FROM (VALUES ('office', 'sine_440.wav', 12), ('office', 'noise.WAV', 5), ('street', 'silence.wav', 5), ('street', 'short.wav', 3), ('street', 'quiet_peak.wav', 6),
('park', 'corrupt.wav', NULL), ('park', 'call.amr', NULL), ('park', 'notes.txt', NULL), ('park', 'part_0.wav', 2), ('park', 'part_1.wav', 2), ('park', 'part_2.wav', 2)) t(folder, name, seconds)),
recordings AS (SELECT * FROM files WHERE lower(name) LIKE '%.wav' OR lower(name) LIKE '%.amr')"""


@register(
    "scan_layouts",
    f"""WITH {_FILES} SELECT 'per location' AS scan, folder, name FROM recordings UNION ALL SELECT 'flat', folder, name FROM recordings WHERE folder = 'office'
UNION ALL SELECT 'recursive', folder, name FROM files UNION ALL SELECT 'listed', folder, name FROM files WHERE folder = 'office' AND (name LIKE '%.wav' OR name LIKE '%.amr')""",
)
def scan_layouts(spark, sf_dir):
    """What each kind of scan finds in one folder tree."""
    root = folder(spark)
    found = {"per location": audio.scan_locations(spark, root), "flat": audio.scan_flat(spark, f"{root}/office"), "recursive": audio.scan_files(spark, root), "listed": audio.list_recordings(spark, f"{root}/office")}
    out = None
    for kind, df in found.items():
        one = df.select(F.lit(kind).alias("scan"), paths.parent(F.col("path")).alias("folder"), paths.basename(F.col("path")).alias("name"))
        out = one if out is None else out.unionAll(one)
    return out


@register(
    "route_by_extension",
    f"WITH {_FILES} SELECT CASE WHEN lower(name) LIKE '%.wav' THEN 'wide' WHEN lower(name) LIKE '%.amr' THEN 'narrow' ELSE 'unsupported' END AS profile, count(*) AS n "
    "FROM files GROUP BY 1",
)
def route_by_extension(spark, sf_dir):
    return audio.routed(audio.scan_files(spark, folder(spark))).groupBy("profile").agg(F.count("*").alias("n"))


@register(
    "decode_audio",
    f"WITH {_FILES} SELECT folder AS location, name, CASE WHEN seconds IS NULL THEN NULL ELSE seconds * 16000 END::INT AS n, seconds IS NULL AS failed "
    "FROM recordings",
)
def decode_audio(spark, sf_dir):
    """Samples of each file, or why there are none."""
    d = audio.decoded(audio.scan_locations(spark, folder(spark)))
    return d.select("location", paths.basename(F.col("path")).alias("name"), F.size("samples").alias("n"), F.col("error").isNotNull().alias("failed"))


def _clips(spark, **kw):
    return features.clips_of(audio.decoded(audio.scan_locations(spark, folder(spark))), **kw)


@register("mfcc_104")
def mfcc_104(spark, sf_dir):
    c = _clips(spark).withColumn("vector", features.features_104(features.preprocess(F.col("samples"))))
    return scoring.long_form(c, "location", "path", "clip_index").select(
        "location", paths.basename(F.col("path")).alias("name"), "clip_index", "pos", F.round("x", 4).alias("x"),
    )


@register("env_9_features")
def env_9_features(spark, sf_dir):
    c = _clips(spark, profile=windows.ENVIRONMENT, normalise=False).withColumn("f", features.environment(F.col("samples")))
    return c.select("location", paths.basename(F.col("path")).alias("name"), "clip_index", *[F.round(f"f.{n}", 6).alias(n) for n in dsp.ENVIRONMENT])


@register(
    "device_and_path_functions",
    "SELECT s_suppkey, 'device_' || s_name || '_001' AS device, regexp_replace(s_name, '[0-9_]+$', '') AS session, 'loc_' || printf('%04d', s_suppkey::INT) || '.wav' AS "
    "clip FROM supplier",
)
def device_and_path_functions(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(
        "s_suppkey", vectors.device_id(F.col("s_name")).alias("device"), paths.session_prefix(F.col("s_name")).alias("session"),
        paths.clip_name(F.lit("loc"), F.col("s_suppkey")).alias("clip"),
    )


@register(
    "sink_roundtrip",
    f"""WITH {_FILES}, clips AS (SELECT folder AS location, greatest(seconds // 5, 1) AS n FROM recordings WHERE seconds IS NOT NULL AND name <> 'silence.wav')
SELECT sink, location, sum(n)::BIGINT AS n FROM clips, (VALUES ('parquet'), ('csv'), ('json'), ('wav')) s(sink) GROUP BY ALL""",
)
def sink_roundtrip(spark, sf_dir):
    """Rows that come back from each sink."""
    clips = written(_clips(spark), "clips")
    out = new_path(spark, "sinks")
    sinks.write_clips(clips, f"{out}/clips", pcm16=True)
    sinks.write_csv(clips.select("location", "clip_index"), f"{out}/csv")
    sinks.write_json(clips.select("location", "clip_index"), f"{out}/json")
    back = {"parquet": spark.read.parquet(f"{out}/clips"), "csv": spark.read.csv(f"{out}/csv", header=True), "json": spark.read.json(f"{out}/json"), "wav": sinks.wav_bytes(clips)}
    rows = None
    for kind, df in back.items():
        one = df.groupBy("location").agg(F.count("*").alias("n")).select(F.lit(kind).alias("sink"), "location", "n")
        rows = one if rows is None else rows.unionAll(one)
    return rows


@register("archive_names", f"WITH {_FILES} SELECT name, CASE name WHEN 'short.wav' THEN 'short_2.wav' ELSE name END AS archived FROM recordings")
def archive_names(spark, sf_dir):
    """Names in the archive for files that meet taken ones."""
    files = audio.scan_locations(spark, folder(spark)).select("path")
    taken = spark.createDataFrame([("short.wav",), ("short_1.wav",)], "name string")
    return sinks.archived_names(files, taken).select(paths.basename(F.col("path")).alias("name"), "archived")


@register(
    "fixed_segments",
    f"""WITH {_FILES} SELECT name, segment::INT AS segment, (least(seconds - 10 * segment, 10) * 16000)::INT AS n
FROM (SELECT name, seconds, unnest(range((seconds + 9) // 10)) AS segment FROM recordings WHERE seconds IS NOT NULL)""",
)
def fixed_segments(spark, sf_dir):
    """Ten-second segments, the short last one kept."""
    d = audio.decoded(audio.scan_locations(spark, folder(spark)))
    return sinks.segments(d.where("error is null")).select(paths.basename(F.col("path")).alias("name"), "segment", F.size("samples").alias("n"))


@register("folder_locations", f"WITH {_FILES} SELECT DISTINCT folder AS location FROM recordings")
def folder_locations(spark, sf_dir):
    """Locations are the folders that hold recordings."""
    return audio.locations(audio.scan_locations(spark, folder(spark)))


@register("preview_clip", f"WITH {_FILES} SELECT name, least(greatest(seconds - 1, 0), 3) * 16000 AS n FROM recordings WHERE seconds IS NOT NULL")
def preview_clip(spark, sf_dir):
    """Three seconds of each recording from the first second on."""
    d = audio.decoded(audio.scan_locations(spark, folder(spark))).where("error is null")
    return sinks.preview(d, 1.0, 3.0).select(paths.basename(F.col("path")).alias("name"), F.size("samples").alias("n"))


@register("csv_scan", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def csv_scan(spark, sf_dir):
    """Suppliers written as CSV with a header and read back under their schema."""
    path = new_path(spark, "csv")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    sinks.write_csv(s, path)
    return artifacts.csv(spark, path, "key long, name string, balance double")


#: Records of an earlier run as a JSON artifact: file, scores by location (null: none), status.
_RECORDS = (
    ("a.wav", {"office": 0.75, "park": 0.25}, "STABLE"), ("b.wav", None, "REJECTED_LOW_QUALITY"), ("c.wav", {"park": 0.5}, "MODERATE_DRIFT"),
    ("d.wav", {"park": 0.125}, "RELOCATION_OR_FRAUD"),
)


def _artifact(spark, value) -> str:
    path = f"{new_path(spark, 'artifact')}/artifact.json"
    put_file(spark, path, json.dumps(value).encode())
    return path


def _records(spark):
    content = {file: {"num_windows": len(scores or {}), "avg_scores": scores, "status": status} for file, scores, status in _RECORDS}
    return artifacts.json_map(spark, _artifact(spark, content), artifacts.PREDICTION, key="file")


@register("json_artifacts", """SELECT * FROM (VALUES ('records', 'a.wav', 2, 0.75::DOUBLE), ('records', 'b.wav', 0, NULL), ('records', 'c.wav', 1, 0.5), ('records', 'd.wav', 1, 0.125),
('list', 'c.wav', NULL, NULL), ('split', 'office/x.wav', NULL, NULL), ('split', 'office/y.wav', NULL, NULL), ('baselines', 'office', 1, 3.0), ('baselines', 'office', 0, 1.0)) t(artifact, key, n, value)""")  # fmt: skip
def json_artifacts(spark, sf_dir):
    """Each kind of JSON artifact as rows; one that isn't there is an empty table."""
    records = _records(spark).select(
        F.lit("records").alias("artifact"), F.col("file").alias("key"), F.col("num_windows").alias("n"),
        F.array_max(F.map_values("avg_scores")).alias("value"),
    )
    lists = artifacts.json_list(spark, _artifact(spark, ["c.wav"])).select(F.lit("list"), "value", F.lit(None).cast("int"), F.lit(None).cast("double"))
    splits = artifacts.json_lists(spark, _artifact(spark, {"office": ["x.wav", "y.wav"]})).select(
        F.lit("split"), F.concat_ws("/", "location", "path"), F.lit(None).cast("int"), F.lit(None).cast("double"),
    )
    bases = artifacts.baselines(spark, _artifact(spark, {"office": [[1.0, 2.0], [3.0, 4.0]]})).select(F.lit("baselines"), "location", "sub_id", F.col("centroid")[0])
    missing = artifacts.json_list(spark, f"{new_path(spark, 'none')}/none.json").select(F.lit("missing"), "value", F.lit(None).cast("int"), F.lit(None).cast("double"))
    return records.unionAll(lists).unionAll(splits).unionAll(bases).unionAll(missing)


@register("usable_records", "SELECT * FROM (VALUES ('c.wav', 'MODERATE_DRIFT')) t(file, status)")
def usable_records(spark, sf_dir):
    """Records with scores, of the latest run, that haven't been plotted."""
    latest, plotted = (artifacts.json_list(spark, _artifact(spark, x), name="file") for x in (["a.wav", "b.wav", "c.wav"], ["a.wav"]))
    return sets.usable(_records(spark), latest, plotted).select("file", "status")



_WAVS = ", ".join(f"('{place}', '{place}_{i:04d}.wav', 160044)" for place, n in (("office", 3), ("park", 1), ("street", 2)) for i in range(n))


@register("wav_files", f"SELECT * FROM (VALUES {_WAVS}) t(location, name, length)")
def wav_files(spark, sf_dir):
    """The clips of training as WAV files of five seconds, listed from the folder that they were written to."""
    clips = features.joined_clips_of(audio.decoded(audio.scan_locations(spark, folder(spark))).where("error is null"))
    root = new_path(spark, "wav")
    sinks.write_wav(clips, root.removeprefix("file://").removeprefix("file:")).count()
    files = audio.scan_locations(spark, root)
    return files.select("location", paths.basename(F.col("path")).alias("name"), F.col("length").cast("int").alias("length"))
