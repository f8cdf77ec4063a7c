"""Lloyd's algorithm goes on until its centres have settled, however many steps that takes."""

from __future__ import annotations

import numpy as np
import pytest

from placeprint.operators import learning

SCHEMA = "clip_id long, location string, vector array<double>"


def chain(n=500, low=100, high=1000):
    """Points between copies of 0 and of 1, of which each step hands one more to the lower centre."""
    x = np.linspace(0.5, 0.8, n)
    for _ in range(200):
        before = np.concatenate([[0], np.cumsum(x)])
        centres = before / (low + np.arange(n + 1)), (high + x.sum() - before) / (high + n - np.arange(n + 1))
        between = (centres[0] + centres[1]) / 2
        x = np.concatenate([[between[0] - 1e-4], (between[:-2] + between[1:-1]) / 2])
    return np.concatenate([np.zeros(low), x, np.ones(high), np.full(20, 1000.0)])


def counted(values, passes):
    """_lloyd_sums over values of one location, without Spark."""

    def sums(_, centres):
        passes.append({loc: len(c) for loc, c in centres.items()})
        out = {}
        for loc, c in centres.items():
            one = np.eye(c.shape[1])[((values[:, None, None] - c[..., 0]) ** 2).argmin(axis=2)]
            off = (one * (values[:, None, None] - c[..., 0]) ** 2).sum(axis=0)
            out[loc] = np.einsum("nrk,n->rk", one, values)[..., None], one.sum(axis=0), off
        return out

    return sums


def test_centres_that_take_hundreds_of_steps_settle(spark, monkeypatch):
    v, passes = chain(), []
    clips = spark.createDataFrame([(i, "a", [float(x)]) for i, x in enumerate(v)], SCHEMA)
    first = [0.0, 1.0, 1000.0, 0.0, 0.5, 1000.0]  # the second run settles sooner
    monkeypatch.setattr(learning, "_starts", lambda *_: {"a": [np.array([x]) for x in first]})
    monkeypatch.setattr(learning, "_lloyd_sums", counted(v, passes))
    got = {r["sub_id"]: r for r in learning.kmeans_by_location(clips, runs=2).collect()}
    assert len(passes) > 301 and {p["a"] for p in passes} == {1, 2}
    centres = np.array([got[k]["centroid"][0] for k in range(3)])
    own = ((v[:, None] - centres) ** 2).argmin(axis=1)
    assert [got[k]["size"] for k in range(3)] == np.bincount(own).tolist()
    assert np.allclose(centres, [v[own == k].mean() for k in range(3)])
    passes.clear()
    with pytest.raises(RuntimeError, match="settled"):
        learning.kmeans_by_location(clips, runs=2, steps=300)


def test_a_tie_tossed_by_rounding_ends(spark, monkeypatch):
    """Centres that move to and fro at one inertia have settled."""
    clips, calls = spark.createDataFrame([(i, "a", [float(i)]) for i in range(5)], SCHEMA), []

    def sums(_, centres):
        calls.append(1)
        return {loc: (np.full((len(c), 1, 1), 10.0 + len(calls) % 2), np.full((len(c), 1), 5.0), np.full((len(c), 1), 7.0)) for loc, c in centres.items()}

    monkeypatch.setattr(learning, "_lloyd_sums", sums)
    (r,) = learning.kmeans_by_location(clips).collect()
    assert r["size"] == 5 and r["inertia"] == 7 and len(calls) < 20
