"""Kernels against closed forms, classes and paths against the published artifacts' rules."""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeprint.functions import classify, dsp, paths, vectors
from placeprint.operators import diagnostics, graph, learning, scoring, sets, windows
from placeprint.sources import artifacts, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sine_features():
    t = np.arange(5 * dsp.RATE) / dsp.RATE
    f = dsp.features_104(np.sin(2 * np.pi * 440 * t))
    assert f.shape == (104,) and np.isfinite(f).all()
    zcr, centroid, flatness, rms = f[100:]
    assert abs(zcr - 2 * 440 / dsp.RATE) < 0.002 and abs(centroid - 440) < 40 and flatness < 0.01 and abs(rms - np.sqrt(0.5)) < 0.02
    noise = dsp.features_104(np.random.default_rng(0).normal(0, 0.1, 5 * dsp.RATE))
    assert noise[102] > 0.4 and abs(noise[101] - 4000) < 200
    assert np.isfinite(dsp.features_104(np.zeros(10))).all()
    assert not np.allclose(dsp.features_104(np.sin(2 * np.pi * 440 * t), 300, 3400)[:100], f[:100])


def test_mel_filters_and_dct():
    m = dsp.mel_filters()
    assert m.shape == (40, 257) and (m >= 0).all() and np.allclose(dsp.mel_to_hz(dsp.hz_to_mel(np.array([10.0, 999, 5000]))), [10, 999, 5000])
    d = dsp.dct_matrix(20, 40)
    assert np.allclose(d @ d.T, np.eye(20))
    assert dsp.decibels(np.array([1.0, 1e-20])).tolist() == [0.0, -80.0]


def test_coefficient_stats_equal_numpy():
    x = np.random.default_rng(1).normal(size=(3, 50))
    s = dsp.coefficient_stats(x)
    assert np.allclose(s[:, 0], x.mean(1)) and np.allclose(s[:, 1], x.std(1)) and np.allclose(s[:, 3], np.percentile(x, 10, axis=1))
    assert dsp.coefficient_stats(np.ones((1, 5)))[0, 2] == 0


def test_environment_features():
    rng = np.random.default_rng(2)
    quiet, loud = rng.normal(0, 0.01, dsp.RATE), rng.normal(0, 0.3, dsp.RATE)
    f = dict(zip(dsp.ENVIRONMENT, dsp.environment_features(np.concatenate([quiet, loud]))))
    assert f["noise_floor_rms"] < f["speech_rms"] and f["snr_estimate_db"] > 0 and 0.4 < f["zcr_mean"] < 0.6
    flat = dsp.environment_features(np.zeros(100))
    assert np.isfinite(flat).all()


@pytest.mark.parametrize(("channels", "width", "rate"), [(1, 2, 16000), (2, 2, 44100), (1, 1, 8000), (2, 3, 16000), (1, 4, 48000)])
def test_decode_wav(channels, width, rate):
    t = np.arange(rate) / rate
    x = np.sin(2 * np.pi * 200 * t) * 0.5
    full = {1: 127, 2: 32767, 3: 8388607, 4: 2147483647}[width]
    v = np.rint(x * full).astype(np.int64) + (128 if width == 1 else 0)
    raw = np.repeat(v, channels).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((channels, width, rate, 0, "NONE", ""))
        w.writeframes(raw)
    y = dsp.decode_wav(out.getvalue())
    assert len(y) == dsp.RATE and np.abs(y[1000:-1000] - 0.5 * np.sin(2 * np.pi * 200 * np.arange(dsp.RATE) / dsp.RATE)[1000:-1000]).max() < 0.02
    with pytest.raises(dsp.UnsupportedAudio):
        dsp.decode_wav(b"RIFFxxxx")
    assert np.abs(dsp.decode_wav(dsp.encode_wav(y)) - dsp.pcm16(y)).max() == 0


def test_crossfade_happens_once():
    a, b = dsp.crossfade(np.ones(1000), np.ones(1000))
    assert a[:840].min() == 1 and a[-160] == 1 and a[-1] < 0.51 and b[0] == 0 and b[160:].min() == 1
    a, b = dsp.crossfade(np.ones(3), np.ones(1000))
    assert a[0] == 1 and b[3:].min() == 1
    assert dsp.crossfade(np.ones(1), np.ones(0))[0].tolist() == [1]


def test_vector_functions(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert abs(one(spark, vectors.cosine(arr(1, 2), arr(2, 4))) - 1) < 1e-9 and one(spark, vectors.cosine(arr(0, 0), arr(1, 1))) == 0
    assert one(spark, vectors.cosine_plain(arr(0, 0), arr(1, 1))) == 0
    assert one(spark, vectors.zscore(arr(10, -10, 1), arr(0, 0, 0), arr(1, 1, 2))) == [3, -3, 0.5]
    z = np.array([-3, -1.5, 0, 0.01, 2.9999, 3], dtype=np.float32)
    q = np.rint(((z + np.float32(3)) / np.float32(6)) * np.float32(255)).astype(np.uint8)
    got = one(spark, vectors.quantise(F.array(*[F.lit(float(x)).cast("float") for x in z])))
    assert got == q.tolist()
    want = hashlib.sha256(q.tobytes() + b"device_x_001" + b"19000").hexdigest()
    assert one(spark, vectors.location_hash(F.array(*[F.lit(int(x)) for x in q]), vectors.device_id(F.lit("x")), F.lit("19000"))) == want
    assert one(spark, vectors.date_bucket(F.lit("1970-01-11 23:00:00").cast("timestamp"))) == "10"
    assert np.allclose(one(spark, vectors.ema(arr(1, 0), arr(0, 1))), [0.95, 0.05])
    single = one(spark, vectors.zscore_single(arr(1, 5), arr(0, 5), arr(0.5, 0)))
    assert single == [2.0, 0.0]


def test_classes(spark):
    s = spark.createDataFrame([(0.4655,), (0.46551,), (0.38,), (0.92,), (0.65,), (0.1,)], "s double")
    wide = [r[0] for r in s.select(classify.drift_class(F.col("s"), 0.4655, 0.38407)).collect()]
    assert wide == ["MODERATE_DRIFT", "STABLE", "RELOCATION_OR_FRAUD", "STABLE", "STABLE", "RELOCATION_OR_FRAUD"]
    swapped = [r[0] for r in s.select(classify.drift_class(F.col("s"), 0.38407, 0.4655)).collect()]
    assert swapped == wide
    assert [r[0] for r in s.select(classify.drift_class_in_order(F.col("s"), 0.38, 0.4)).collect()][2] == "RELOCATION_OR_FRAUD"
    assert [r[0] for r in s.select(classify.drift_class_four(F.col("s"))).collect()][3:] == ["Stable Environment", "Significant Drift", "Relocated / Fraud Suspected"]
    m = spark.createDataFrame([(0.2,), (0.15,), (0.05,), (None,)], "m double").select(classify.confidence(F.col("m"))).collect()
    assert [r[0] for r in m] == ["HIGH", "MODERATE", classify.LOW_CONFIDENCE, None]


def test_paths(spark):
    p = F.lit("raw\\office\\clip_0007.wav")
    assert one(spark, paths.basename(p)) == "clip_0007.wav" and one(spark, paths.parent(p)) == "office" and one(spark, paths.extension(p)) == ".wav"
    assert one(spark, paths.session_prefix(p)) == "clip" and one(spark, paths.clip_index(p)) == 7
    names = spark.createDataFrame([("a_0003.wav",), ("a_0011.wav",), ("note.txt",)], "n string")
    assert names.agg(paths.next_index(F.col("n"))).first()[0] == 12 and names.limit(0).agg(paths.next_index(F.col("n"))).first()[0] == 0


def test_published_predictions_recompute(spark):
    """Wherever PREDICTIONS names a published file of narrow-band predictions."""
    import os

    path = os.environ.get("PREDICTIONS", "")
    if not os.path.exists(path):
        pytest.skip("no published predictions here")
    rows = artifacts.json_map(spark, path, artifacts.PREDICTION, "file").where("avg_scores is not null")
    scores = rows.select("file", F.explode("avg_scores").alias("base_location", "score"))
    best = {r["file"]: r for r in scoring.best(scores, "file").withColumn("s", classify.drift_class_in_order(F.col("best_score"))).withColumn("c", classify.confidence(F.col("margin"))).collect()}
    for r in rows.collect():
        b = best[r["file"]]
        assert (b["best_location"], b["c"], b["s"]) == (r["final_match"], r["confidence"], r["status"]) and abs(b["margin"] - r["margin"]) < 1e-6


def test_missing_artifacts_are_empty(spark, tmp_path):
    assert artifacts.json_map(spark, f"{tmp_path}/no.json", artifacts.LEDGER).count() == 0
    assert artifacts.json_list(spark, f"{tmp_path}/no.json").count() == artifacts.baselines(spark, f"{tmp_path}/no.json").count() == artifacts.json_lists(spark, f"{tmp_path}/no.json").count() == 0


def test_upsert_and_guards(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "file string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "file string, v int")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, "file").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sets.guarded(old.where("file = 'a'"), new, "file").count() == 1
    with pytest.raises(Exception, match="both sides"):
        sets.guarded(old, new, "file").collect()
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_csv(old.limit(0), "/tmp/never")
    levels = spark.createDataFrame([("quiet", 1.0), ("noisy", 0.5)], "label string, level double")
    with pytest.raises(Exception, match="below noisy"):
        scoring.environment_thresholds(levels).collect()
    with pytest.raises(Exception, match="needed"):
        scoring.environment_thresholds(levels.where("label = 'quiet'")).collect()


def test_scores_by_matrix_and_by_join_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    clips = spark.createDataFrame([(i, f"l{i % 4}", rng.normal(size=6).tolist()) for i in range(40)], "clip_id long, location string, vector array<double>")
    base = clips.where("clip_id < 10").select("location", "vector")
    a = {(r[0], r[1]): r[2] for r in scoring.score(clips, base, "clip_id").collect()}
    monkeypatch.setattr(scoring, "MATRIX_NUMBERS", 10)
    b = {(r[0], r[1]): r[2] for r in scoring.score(clips, base, "clip_id").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert scoring.score(clips, base.limit(0), "clip_id").count() == 0
    assert scoring.score(clips.limit(0), base, "clip_id").count() == 0


def test_prediction_of_files_without_windows(spark):
    scores = spark.createDataFrame([("f", 0, "a", 0.9), ("f", 0, "b", 0.2), ("f", 1, "a", 0.7), ("f", 1, "b", 0.8)], "file string, window int, base_location string, score double")
    files = spark.createDataFrame([("f",), ("silent",)], "file string")
    got = {r["file"]: r for r in scoring.predict_files(scores, files, classify.WIDE_BAND).collect()}
    f, s = got["f"], got["silent"]
    assert f["final_match"] == "a" and abs(f["margin"] - 0.3) < 1e-9 and f["vote_counts"] == {"a": 1, "b": 1} and f["few_windows"] and f["verdict_message"] is None
    assert s["status"] == "REJECTED_LOW_QUALITY" and s["final_match"] is None and s["num_windows"] == 0 and s["location_verdict"] is None


def test_kmeans_finds_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"l{i % 2}", (np.eye(3)[i % 3] * 10 + rng.normal(size=3) * 0.1).tolist()) for i in range(60)] + [(100, "tiny", [1.0, 2.0, 3.0])]
    out = learning.kmeans_by_location(spark.createDataFrame(rows, "clip_id long, location string, vector array<double>"))
    by = {}
    for r in out.collect():
        by.setdefault(r["location"], []).append(r)
    assert len(by["l0"]) == len(by["l1"]) == 3 and len(by["tiny"]) == 1 and by["tiny"][0]["centroid"] == [1, 2, 3]
    assert sum(r["inertia"] for r in by["l0"]) < 5
    x = np.array([r[2] for r in rows[:60:2]])
    assert abs(dsp.kmeans(x, 3)[2] - sum(r["inertia"] for r in by["l0"])) < 0.5
    assert [learning.baselines_of(n) for n in (1, 5, 6, 11, 12, 17, 18, 500)] == [1, 1, 1, 1, 2, 2, 3, 3]


def test_windows_cover_every_sample_once(spark):
    rows = [(s, f"d{f}", p, float(p)) for s in range(3) for f in range(4) for p in range((s + 1) * (f + 2))]
    sig = spark.createDataFrame(rows, "stream int, file string, file_pos long, sample double")
    m = windows.merged(sig, 5).collect()
    for s in range(3):
        total = sum(1 for r in rows if r[0] == s)
        own = sorted(r["gpos"] for r in m if r["stream"] == s)
        assert own == list(range(total // 5 * 5))


def test_running_sum_and_components(spark):
    rows = [("a", float(i % 50), i) for i in range(300)] + [("b", 1.0, 5)]
    df = spark.createDataFrame(rows, "k string, o double, v long").groupBy("k", "o").agg(F.sum("v").alias("v"))
    got = {(r["k"], r["o"]): r["s"] for r in diagnostics.running_sum(df, "k", "o", "v", "s", width=8).collect()}
    assert got == {(k, o): sum(v for kk, oo, v in rows if kk == k and oo < o) for k, o, _ in rows}
    g = graph.groups_of(spark.createDataFrame([("f1", 1), ("f2", 1), ("f2", 2), ("f3", 2), ("f4", 3)], "f string, c int"), "f", "c")
    assert {r[0]: r[1] for r in g.collect()} == {"f1": "f1", "f2": "f1", "f3": "f1", "f4": "f4"}


def test_ledgers_and_record_filters(spark):
    records = spark.createDataFrame([("a", {"x": 1.0}), ("b", None), ("c", {"x": 2.0}), ("d", {"y": 1.0})], "file string, avg_scores map<string,double>")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "file string")
    assert {r["file"] for r in sets.usable(records, names("a", "b", "c"), names("c")).collect()} == {"a"} and sets.usable(records).count() == 3
    files = spark.createDataFrame([("root/in/_chunks/x.wav",), ("root\\in\\_processed\\y.wav",), ("root/in/z.wav",)], "path string")
    assert [r["path"] for r in sets.without_folders(files, "_chunks", "_processed").collect()] == ["root/in/z.wav"]
    split = spark.createDataFrame([("office", "raw\\office\\a.wav"), ("office", "raw/office/b.wav")], "location string, path string")
    used = spark.createDataFrame([(["raw/office/a.wav", "raw/office/c.wav"],)], "source_files array<string>")
    assert [r["path"] for r in sets.leaked(split, used).collect()] == ["raw\\office\\a.wav"]


def test_array_windows_and_silence(spark):
    df = spark.createDataFrame([(1, [0.5] * 10), (2, [0.001] * 4), (3, [])], "id int, samples array<float>")
    cut = {r["id"]: [len(w) for w in r["w"]] for r in df.select("id", windows.array_windows(F.col("samples"), 4).alias("w")).collect()}
    whole = {r["id"]: [len(w) for w in r["w"]] for r in df.select("id", windows.array_windows(F.col("samples"), 8, "whole").alias("w")).collect()}
    assert cut == {1: [4, 4], 2: [4], 3: []} and whole == {1: [8], 2: [4], 3: []}
    heard = {r["id"]: r["a"] for r in df.select("id", windows.audible_array(F.col("samples")).alias("a")).collect()}
    assert heard == {1: True, 2: False, 3: False}
