"""Features, windows, percentiles and components against versions of their own, written out from the definitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeprint.functions import dsp
from placeprint.operators import diagnostics, features, graph, joins, learning, scoring, trees, windows
from placeprint.plans import flows
from placeprint.sources import sinks


def percentile(values, share):
    v, place = sorted(values), share * (len(values) - 1)
    lo = math.floor(place)
    return v[lo] + (place - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo])


def dft_power(frame):
    """Squared magnitudes of the lower half of the spectrum, by sums of cosines and sines."""
    n = len(frame)
    angle = 2 * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n
    return (np.cos(angle) @ frame) ** 2 + (np.sin(angle) @ frame) ** 2


def clip(kind):
    t, rng = np.arange(8000) / 16000, np.random.default_rng(4)
    tone = 0.4 * np.sin(2 * np.pi * 500 * t) + 0.1 * np.sin(2 * np.pi * 2300 * t)
    return {"tone": tone, "noise": rng.normal(0, 0.1, 8000), "both": np.where(t < 0.25, rng.normal(0, 0.01, 8000), tone), "short": tone[:300]}[kind]


@pytest.mark.parametrize("kind", ["tone", "noise", "both", "short"])
def test_environment_features_by_their_definitions(kind):
    x = clip(kind)
    x = np.concatenate([x, np.zeros(max(0, 400 - len(x)))])
    frames = [x[i : i + 400] for i in range(0, len(x) - 399, 160)]
    energy = [math.sqrt(sum(v * v for v in f) / 400 + 1e-10) for f in frames]
    crossings = [sum((a >= 0) != (b >= 0) for a, b in zip(f, f[1:])) / 399 for f in frames]
    hann = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / 399) for i in range(400)])
    flatness, centroid, band = [], [], []
    for f in frames:
        power = dft_power(f * hann)
        size = np.sqrt(power) + 1e-10
        flatness.append(math.exp(sum(math.log(s) for s in size) / 201) / (sum(size) / 201))
        centroid.append(sum(s * i * 40 for i, s in enumerate(size)) / sum(size))
        p = power + 1e-10
        band.append(sum(p[i] for i in range(201) if 300 <= i * 40 <= 1000) / sum(p))
    cut = percentile(energy, 0.6)
    mean = lambda v: sum(v) / len(v)
    quiet = [i for i, e in enumerate(energy) if e <= cut] or list(range(len(energy)))
    loud = [i for i, e in enumerate(energy) if e > cut] or list(range(len(energy)))
    noise, speech = mean([energy[i] for i in quiet]), mean([energy[i] for i in loud])
    zm = mean(crossings)
    want = [
        noise, speech, 20 * math.log10((speech + 1e-10) / (noise + 1e-10)), mean([flatness[i] for i in quiet]), mean(centroid), zm, math.sqrt(mean([(c - zm) ** 2 for c in crossings])),
        percentile(energy, 0.95) - percentile(energy, 0.05), mean([band[i] for i in quiet]),
    ]
    assert np.allclose(dsp.environment_features(clip(kind)), want, rtol=1e-6, atol=1e-9)


def mel(f):
    return 3 * f / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)


def hertz(m):
    return 200 * m / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)


@pytest.mark.parametrize(("kind", "fmin", "fmax"), [("tone", 0, 8000), ("noise", 0, 8000), ("both", 300, 3400)])
def test_104_features_by_their_definitions(kind, fmin, fmax):
    x = clip(kind)
    edges = [hertz(mel(fmin) + i * (mel(fmax) - mel(fmin)) / 41) for i in range(42)]
    bank = np.zeros((40, 257))
    for b in range(40):
        lo, mid, hi = edges[b : b + 3]
        for i in range(257):
            f = i * 16000 / 512
            weight = (f - lo) / (mid - lo) if lo <= f <= mid else (hi - f) / (hi - mid) if mid < f <= hi else 0.0
            bank[b, i] = max(weight, 0) * 2 / (hi - lo)

    def spectra(n, hop):
        hann = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)])
        padded = np.concatenate([np.zeros(n // 2), x, np.zeros(n // 2)])
        return [dft_power(padded[i : i + n] * hann) for i in range(0, len(padded) - n + 1, hop)]

    power = np.array([bank @ s for s in spectra(512, 160)])
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * math.log10(max(power.max(), 1e-10))
    db = np.maximum(db, db.max() - 80)
    want = []
    for k in range(20):
        c = [sum(row[i] * math.cos(math.pi * k * (2 * i + 1) / 80) for i in range(40)) * math.sqrt((1 if k == 0 else 2) / 40) for row in db]
        m = sum(c) / len(c)
        s = math.sqrt(sum((v - m) ** 2 for v in c) / len(c))
        want += [m, s, sum((v - m) ** 3 for v in c) / len(c) / s**3, percentile(c, 0.1), percentile(c, 0.9)]
    held = np.concatenate([np.full(1024, x[0]), x, np.full(1024, x[-1])])
    empty = np.concatenate([np.zeros(1024), x, np.zeros(1024)])
    starts = range(0, len(held) - 2047, 512)
    want.append(np.mean([sum((a < 0) != (b < 0) for a, b in zip(held[i : i + 2047], held[i + 1 : i + 2048])) / 2048 for i in starts]))
    size = [np.sqrt(s) for s in spectra(2048, 512)]
    want.append(np.mean([(s * np.arange(1025) * 16000 / 2048).sum() / s.sum() for s in size]))
    want.append(np.mean([np.exp(np.log(np.maximum(s**2, 1e-10)).mean()) / np.maximum(s**2, 1e-10).mean() for s in size]))
    want.append(np.mean([math.sqrt((empty[i : i + 2048] ** 2).mean()) for i in starts]))
    assert np.allclose(dsp.features_104(x, fmin, fmax), want, rtol=1e-5, atol=1e-6)


def brute_windows(files, size, half):
    """One location: files (path, samples) joined by path; each seam faded once, by the lengths of its two files."""
    files = sorted((p, np.array(x, dtype=np.float64)) for p, x in files if x)
    gains = [np.ones(len(x)) for _, x in files]
    for i in range(len(files) - 1):
        a, b = len(files[i][1]), len(files[i + 1][1])
        n, mid = min(half, a) + min(half, b), min(half, a, b)
        if half and n > 1:
            ramp = np.linspace(0, 1, n)[:mid]
            gains[i][a - mid :] *= 1 - ramp
            gains[i + 1][:mid] *= ramp
    flat = np.concatenate([x * g for (_, x), g in zip(files, gains)]) if files else np.zeros(0)
    owner = [p for p, x in files for _ in x]
    out = {}
    for w in range(len(flat) // size):
        own = owner[w * size : (w + 1) * size]
        out[w] = (flat[w * size : (w + 1) * size], list(dict.fromkeys(own)))
    return out


@pytest.mark.parametrize("half", [0, 3])
def test_joined_windows(spark, half):
    rng = random.Random(half)
    rows = [(f"l{k % 3}", f"f{k:02d}", [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))]) for k in range(30)] + [("l9", "only", [1.0, 2.0]), ("l0", "null", None)]
    files = spark.createDataFrame(rows, "location string, path string, samples array<float>").repartition(4)
    got = {}
    for r in windows.joined_windows(files, 7, half).collect():
        got.setdefault(r["location"], {})[r["window"]] = (r["samples"], r["source_files"], r["merged"])
    for loc in {r[0] for r in rows}:
        want = brute_windows([(p, x) for a, p, x in rows if a == loc and x], 7, half)
        assert sorted(got.get(loc, {})) == sorted(want)
        for w, (x, sources) in want.items():
            assert np.allclose(got[loc][w][0], x, atol=1e-6) and got[loc][w][1] == sources and got[loc][w][2] == (len(sources) > 1)


def test_training_clips_cover_files_that_end_within_a_window(spark):
    rows = [("a", f"{i}.wav", [0.5, -0.5] * 16000) for i in range(4)]  # four files of two seconds
    files = spark.createDataFrame(rows, "location string, path string, samples array<float>")
    clips = features.joined_clips_of(files, 5.0).collect()
    assert [(c["clip_index"], c["source_files"], c["merged"], len(c["samples"])) for c in clips] == [(0, ["0.wav", "1.wav", "2.wav"], True, 80_000)]


@pytest.mark.parametrize("sorted_", [20, 100_000])
def test_percentiles_are_exact(spark, monkeypatch, sorted_):
    monkeypatch.setattr(joins, "SORTED", sorted_)
    monkeypatch.setattr(joins, "MARKS", 8)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=900), np.full(500, 0.25), rng.normal(size=300) * 1e9])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    shares = [0, 0.1, 0.25, 0.5, 0.613, 0.9, 1]
    assert np.allclose(joins.percentiles(df, "x", shares), np.percentile(values, [100 * s for s in shares]), rtol=1e-12)
    assert joins.percentiles(df.where("x is null"), "x", [0.5]) == [None]


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "SPLIT_EDGES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 4)
    edges = [(1000, i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(20)] + [(2010, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 322 and set(got.values()) == {0}


def test_starts_do_not_depend_on_size(spark, monkeypatch):
    """Centres of a location stay as they are when another one grows, or rows come in another order."""
    rng = np.random.default_rng(6)
    small = [(i, "small", rng.normal(size=4).tolist()) for i in range(40)]
    large = [(1000 + i, "large", rng.normal(size=4).tolist()) for i in range(3000)]
    schema = "clip_id long, location string, vector array<double>"
    alone = learning.kmeans_by_location(spark.createDataFrame(small, schema)).collect()
    both = learning.kmeans_by_location(spark.createDataFrame((small + large)[::-1], schema).repartition(5)).where("location = 'small'").collect()
    assert [(r["sub_id"], r["size"]) for r in alone] == [(r["sub_id"], r["size"]) for r in both]
    assert np.allclose([r["centroid"] for r in alone], [r["centroid"] for r in both])
    with pytest.raises(RuntimeError, match="settled"):
        learning.kmeans_by_location(spark.createDataFrame(large, schema), steps=1)


def test_a_split_stays_as_it_was_drawn(spark, tmp_path):
    table = sinks.Versions(spark, str(tmp_path / "split"))
    files = spark.createDataFrame([("a", f"a{i}") for i in range(10)] + [("b", "b0")], "location string, path string")
    first = {tuple(r) for r in flows.split(files, table).collect()}
    assert sorted(r[0] for r in first) == ["a", "a", "b"]
    more = files.unionAll(spark.createDataFrame([("a", f"new{i}") for i in range(50)] + [("c", f"c{i}") for i in range(5)], files.schema))
    assert {tuple(r) for r in flows.split(more, table, extend=False).collect()} == first
    second = {tuple(r) for r in flows.split(more, table).collect()}
    assert first < second and [r[0] for r in second - first] == ["c"]
    assert {tuple(r) for r in flows.split(more, table).collect()} == second and table.complete() == [0, 1]


def test_archive_keeps_what_is_there(spark, tmp_path):
    for name in ("x.wav", "y.wav"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "x.wav").write_bytes(b"older")
    files = spark.createDataFrame([(f"file:{tmp_path}/x.wav",), (f"file:{tmp_path}/y.wav",), (f"file:{tmp_path}/gone.wav",)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["moved_to"] for r in sinks.archive(spark, files, f"file:{tmp_path}/done", retries=2, delay=0.01).collect()}
    assert got["gone.wav"] is None and got["x.wav"].endswith("done/x_1.wav") and (tmp_path / "done" / "x.wav").read_bytes() == b"older"
    assert (tmp_path / "done" / "x_1.wav").read_bytes() == b"x.wav" and not (tmp_path / "y.wav").exists()


def test_majority_and_verification(spark):
    votes = spark.createDataFrame([("f", 0, "b"), ("f", 1, "a"), ("f", 2, "a"), ("f", 3, "b"), ("g", 0, "c")], "file string, window int, vote string")
    assert {r["file"]: (r["match"], r["share"], r["windows"]) for r in scoring.majority(votes, "file", "vote", "window").collect()} == {"f": ("b", 0.5, 4), "g": ("c", 1.0, 1)}
    scores = spark.createDataFrame([("f", 0, "a", 0.9), ("f", 0, "b", 0.2), ("g", 0, "a", 0.5), ("g", 0, "b", 0.4)], "file string, window int, base_location string, score double")
    files = spark.createDataFrame([("f", "a"), ("g", "b"), ("h", "a"), ("f2", "zz")], "file string, location string")
    pair = flows.classify.Thresholds(0.6, 0.45)
    got = {r["file"]: r for r in scoring.verification(scores, files, pair).collect()}
    assert set(got) == {"f", "g"} and got["f"]["correct_match"] and not got["g"]["correct_match"]
    assert (got["g"]["best_status"], got["g"]["expected_status"], got["g"]["expected_score"]) == ("MODERATE_DRIFT", "RELOCATION_OR_FRAUD", 0.4)


def test_wav_files_and_kernel_features(spark, tmp_path):
    x = (0.3 * np.sin(np.arange(800) / 7)).astype(np.float32).tolist()
    clips = spark.createDataFrame([("a", 0, x), ("b", 12, x)], "location string, clip_index int, samples array<float>")
    rows = sinks.write_wav(clips, str(tmp_path / "out")).collect()
    assert sorted(r["path"].rsplit("/", 2)[-2:] for r in rows) == [["a", "a_0000.wav"], ["b", "b_0012.wav"]]
    assert np.allclose(dsp.decode_wav((tmp_path / "out" / "b" / "b_0012.wav").read_bytes()), x, atol=2 / 32768)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(6, 5))
    got = learning.fourier_features(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "i int, vector array<double>"), dims=4000).orderBy("i").collect()
    f = np.array([r["features"].toArray() for r in got])
    want = np.exp(-((v[:, None] - v[None]) ** 2).sum(-1) / 5)
    assert np.abs(f @ f.T - want).max() < 0.1


def test_stage_times_are_kept_when_a_stage_fails():
    seconds = {}
    assert flows.in_stage(seconds, "fine", lambda: 5) == 5
    with pytest.raises(ZeroDivisionError):
        flows.in_stage(seconds, "broken", lambda: 1 / 0)
    assert set(seconds) == {"fine", "broken"}


def test_extremely_randomised_trees(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.5)  # no single cut tells the first two classes apart
    rows = [(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, vector array<double>, label double")
    train, test = df.where("i < 400"), df.where("i >= 400")
    model = trees.fit(train.repartition(3), trees=40)
    again = trees.fit(train.orderBy(F.desc("i")).repartition(5), trees=40)
    assert np.array_equal(model.feature, again.feature) and np.array_equal(model.counts, again.counts)
    got = trees.predicted(model, test).collect()
    assert np.mean([r["prediction"] == r["label"] for r in got]) > 0.7  # the most frequent class has 0.37 of the rows
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"]) for r in got)
    inner = np.argwhere(model.feature >= 0)
    assert all((model.counts[t, n] == model.counts[t, 2 * n] + model.counts[t, 2 * n + 1]).all() for t, n in inner)
    for t, n in inner[:20]:  # counts are those of the rows that come by
        own = [c for v, c in zip(x[:400], y[:400]) if n in came_by(model, t, v)]
        assert np.bincount(own, minlength=4).tolist() == model.counts[t, n].tolist()
    with pytest.raises(ValueError, match="no rows"):
        trees.fit(df.limit(0))


def came_by(model, tree, v):
    out = [1]
    while model.feature[tree, out[-1]] >= 0:
        out.append(2 * out[-1] + int(v[model.feature[tree, out[-1]]] > model.cut[tree, out[-1]]))
    return out


def test_grouped_percentiles_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in rng.normal(size=700)] + [("a", 0.5)] * 90 + [("b", 3.0)] + [("c", float(v)) for v in (1, 2, 2, 9)] + [("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p77": 0.77, "top": 1.0}
    got = {r["k"]: r for r in diagnostics.grouped_percentiles(df, ["k"], "x", shares).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for k in got:
        own = [x for g, x in rows if g == k and x is not None]
        assert np.allclose([got[k][n] for n in shares], np.percentile(own, [100 * s for s in shares.values()]), rtol=1e-12)
