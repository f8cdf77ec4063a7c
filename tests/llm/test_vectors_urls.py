"""Lattice hashing and the URL filter, with every edge case; the shared components."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from placeprint.llm import common, lattice, queries, url_filter

SCHEMA = "vec_id long, embedding array<float>, label int, h1 long, row int"


def clusters(seed: int, dim: int = 64, groups: int = 12, noise: float = 0.02):
    rng = np.random.default_rng(seed)
    rows, vec_id = [], 0
    for g in range(groups):
        centre = rng.normal(size=dim)
        for k in range(int(rng.integers(1, 9))):
            rows.append((vec_id, (centre + rng.normal(size=dim) * noise * (k + 1)).astype(np.float32).tolist(), g % 3))
            vec_id += 1
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(5)] + [(500, rows[3][1], rows[3][2])]
    rows += [(600, rows[3][1], None), (601, None, 1), (602, [], 1), (603, [0.0] * dim, 1), (604, [float("nan")] + [1.0] * (dim - 1), 1), (605, [float("inf")] + [1.0] * (dim - 1), 1), (606, [None] + [1.0] * (dim - 1), 1), (607, [1.0, 2.0], 1), (608, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2])]
    return [(*r, 1, 2) for r in rows]


def brute(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], dtype=np.float64) / np.linalg.norm(np.array(r[1], dtype=np.float64)) if o else None for r, o in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0] is None, r[0] or 0, n[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("settings", [lattice.Settings(), lattice.Settings(bucket_rows=3), lattice.Settings(cell_rows=1)])
def test_lattice_equals_brute_force(spark, settings):
    rows = clusters(4)
    got = lattice.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), settings).collect()
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows)


def test_lattice_recall_on_the_table(spark, sf_dir):
    got = {r["vec_id"]: r for r in queries.op9_lattice(spark, sf_dir).collect()}
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    assert sum(r["n_links"] for r in got.values()) == sum(w[2] for w in want) and len(got) == len(rows)


def test_lattice_recall_at_the_threshold():
    """Pairs of cosine 0.93 exactly share a point in some table."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    for rows, least in ((1000, 0.995), (1_000_000, 0.95), (100_000_000, 0.95)):
        blocks, settings = lattice.planned(rows, lattice.Settings())
        t, met = lattice.Tables(64, blocks, settings), np.zeros(len(x), dtype=bool)
        for k in range(settings.tables):
            a, b = t.codes(x, k), t.codes(y, k)
            met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
        assert met.mean() > least, (blocks, met.mean())


def test_e8_decodes_to_the_nearest_point():
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.decode_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert (((x[:, None] - p[:, None] - lattice.NEIGHBOURS) ** 2).sum(-1).min(axis=1) >= d - 1e-9).all()
    assert (np.rint(p * 2).sum(axis=1).astype(int) % 4 == 0).all() and d.max() <= 1 + 1e-9


def test_empty_vectors(spark):
    assert lattice.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(5, 5), (None, 3), (3, None), (70, 60), (70, 60)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://COM/x", "https://a.com", "https://a.com/", "https://a.COM/en/1?x#y", "http://www.example.com/en/5", "http://x.www.example.com/en/5", "http://example.com/en/", "http://m.example.com/en/7#a",
    "http://notexample.com/en/1", "http://example.net/es/1", "http://x.example.net/fr/2?q=1", "http://example.net/de/2", "http://a.org/en/1", "http://a.org#frag", "http://a.org?x=/en/", "ftp://b.net/fr/", "x://y://com/z", "http://a.com\n/en/", "http://" + "long" * 3000 + ".com/en/" + "p" * 9000,
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), says, h + p) for says, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, says, rule = max(fits) if fits else (0, None, None)
    return host, path, rule, says


def test_url_rules_and_model(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = url_filter.filter_urls(df, url_filter.Settings(order=3)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, says = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == says if says else r["verdict"] in ("allow", "block") and (r["llr"] is None or (r["llr"] < 0) == (r["verdict"] == "block"))
    assert {r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame([(1, None), (2, "http://a.org/")], "page_id long, url string")).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_markov_probabilities_sum_to_one():
    m = url_filter.Markov(2, url_filter.Markov.count(["abab", "abc", "b"], 2))
    letters = [chr(i) for i in range(256)]
    for context in ("", "a", "ab", "zz"):
        p = sum(math.exp(m.log_p(context, c)) for c in letters)
        assert abs(p + 1 / url_filter.ALPHABET * 0 - 1) < 0.05 and p <= 1 + 1e-9


def test_calibration_splits_the_classes():
    t = url_filter.calibrate([1.0, 2.0, 3.0], [-1.0, 0.5, 1.5])
    assert 0.5 < t <= 1.0 and url_filter.calibrate([], [1.0]) == 0.0


def test_url_model_generalises(spark, sf_dir):
    """Labels that the rules hide from the model in one fold are told again."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()  # fifty pages have too few labels
    labelled = [(p["url"].lower(), says) for p in pages if (says := brute_rule(p["url"])[3])]
    train, test = labelled[::2], labelled[1::2]
    r = url_filter.Ratio(*(url_filter.Markov(5, url_filter.Markov.count([u for u, s in train if s == v], 5)) for v in ("allow", "block")))
    good = sum((r.score(u) > 0) == (s == "allow") for u, s in test)
    assert good / len(test) > 0.8
