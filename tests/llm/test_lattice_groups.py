"""Candidate groups of the lattice tables: large ones, dense balls, sketches."""

from __future__ import annotations

import numpy as np
import pytest

from placeprint.llm import lattice
from test_vectors_urls import SCHEMA, brute, clusters


def found(spark, rows, settings):
    got = lattice.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), settings).collect()
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)


@pytest.mark.parametrize("settings", [lattice.Settings(group_rows=2), lattice.Settings(group_rows=3, bucket_rows=3), lattice.Settings(bucket_rows=2, cell_rows=1)])
def test_large_groups_and_points_equal_brute_force(spark, settings):
    rows = clusters(11)
    assert found(spark, rows, settings) == brute(rows)


@pytest.mark.parametrize("group_rows", [4096, 50])
def test_a_dense_ball_and_a_chain(spark, group_rows):
    """A ball of near vectors, and vectors that only follow one another."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.08).tolist(), 1, 0, 0) for i in range(150)]
    a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    rows += [(1000 + i, (np.cos(i * 0.3) * a + np.sin(i * 0.3) * b).tolist(), 2, 0, 0) for i in range(12)]
    assert found(spark, rows, lattice.Settings(group_rows=group_rows)) == brute(rows)


def test_double_vectors(spark):
    rows = [(1, [1.0, 0.0, 1e-9], 1), (2, [1.0, 0.0, 2e-9], 1), (3, [0.0, 1e300, 0.0], 1), (4, [0.0, 1e-300, 0.0], 1), (5, [0.0, 1.0, 0.0], 2)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_sketches_of_links_are_near():
    """At the threshold itself, out of 20,000 pairs none is lost; unrelated vectors are told apart."""
    rng, s = np.random.default_rng(2), lattice.Settings()
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    t = lattice.Tables(64, 1, s)
    far = lambda a, b: np.bitwise_count(t.sketch(a) ^ t.sketch(b)).sum(axis=1, dtype=np.int64)
    assert (far(x, y) <= s.sketch_bits()).all() and (far(x, np.roll(x, 1, axis=0)) > s.sketch_bits()).all()
