"""Streams keep every row over restarts, second checkpoints and writes that were cut short."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from placeprint.sources import sinks
from placeprint.streaming import ingest


def put(spark, root, name, rows):
    spark.createDataFrame(rows, "k long, x string").coalesce(1).write.mode("append").parquet(f"{root}/{name}")


@pytest.fixture
def source(spark, tmp_path):
    put(spark, tmp_path, "in", [(1, "a"), (2, "b"), (2, "b")])
    return str(tmp_path)


def test_ingest_goes_on_after_a_restart_and_for_another_stream(spark, source):
    stream = lambda name="in": ingest.file_stream(spark, source, name, files_a_trigger=1)
    first = ingest.ingest(stream(), f"{source}/table", "k", f"{source}/one")
    assert sorted(r["k"] for r in first.collect()) == [1, 2]
    put(spark, source, "in", [(2, "again"), (3, "c")])
    again = ingest.ingest(stream(), f"{source}/table", "k", f"{source}/one")
    assert sorted((r["k"], r["x"]) for r in again.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    put(spark, source, "other", [(3, "late"), (4, "d")])
    both = ingest.ingest(stream("other"), f"{source}/table", "k", f"{source}/two")
    assert sorted((r["k"], r["x"]) for r in both.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert both.select("stream").distinct().count() == 2


def test_a_batch_that_runs_again_replaces_itself_only(spark, source):
    """As after a crash between the write and its commit."""
    stream = lambda: ingest.file_stream(spark, source, "in", files_a_trigger=1)
    ingest.ingest(stream(), f"{source}/table", "k", f"{source}/one")
    put(spark, source, "in", [(3, "c")])
    ingest.ingest(stream(), f"{source}/table", "k", f"{source}/one")
    (last,) = [p for p in __import__("pathlib").Path(source, "one", "commits").iterdir() if p.name == "1"]
    last.unlink()
    (last.parent / ".1.crc").unlink(missing_ok=True)
    out = ingest.ingest(stream(), f"{source}/table", "k", f"{source}/one")
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3]


def test_upsert_goes_on_after_a_restart(spark, source):
    def counts(name, checkpoint):
        s = ingest.file_stream(spark, source, name, files_a_trigger=1).groupBy("k").agg(F.count("*").alias("n"))
        return {r["k"]: r["n"] for r in ingest.upsert(s, f"{source}/table", "k", f"{source}/{checkpoint}").collect()}

    assert counts("in", "one") == {1: 1, 2: 2}
    put(spark, source, "in", [(3, "c"), (1, "a")])
    assert counts("in", "one") == {1: 2, 2: 2, 3: 1}
    put(spark, source, "other", [(4, "d"), (3, "c")])
    assert counts("other", "two") == {1: 2, 2: 2, 3: 1, 4: 1}
    assert counts("other", "two") == {1: 2, 2: 2, 3: 1, 4: 1}


def test_a_version_that_was_cut_short_is_not_read(spark, tmp_path):
    table = sinks.Versions(spark, str(tmp_path / "t"))
    assert table.read() is None and table.complete() == []
    for i in range(4):
        table.put(spark.createDataFrame([(i,)], "k long"))
    spark.createDataFrame([(99,)], "k long").write.parquet(f"{tmp_path}/t/v4")  # without its mark
    assert table.complete() == [2, 3] and table.read().collect()[0]["k"] == 3
    table.put(spark.createDataFrame([(5,)], "k long"))
    assert table.read().collect()[0]["k"] == 5 and table.complete() == [3, 4]
