"""Days of replays are those of their SQL: of the nearest second, before 1970 as well, and none for times without one."""

from __future__ import annotations

import duckdb
import pytest

from placeprint.plans import catalogue
from placeprint.streaming import ingest

ODD = [
    ("2024-01-01 23:59:59.5", 1, "click"), ("2024-01-01 23:59:59.500001", 1, "click"), ("2024-01-02 00:00:01", 1, "click"), ("2024-01-01 23:59:59.499999", 1, "click"), ("2024-01-01 23:59:58.5", 1, "click"),
    ("1970-01-01 00:00:00", 2, "view"), ("1969-12-31 23:59:59.5", 2, "view"), ("1969-12-31 12:00:00", 2, "view"), ("1969-12-30 12:00:00", 2, "view"), ("1960-05-05 12:00:00", 2, "view"), ("1960-05-05 13:00:00", 2, "view"),
    ("1969-12-31 00:00:00.5", 3, "x"), ("1969-12-30 23:59:59.5", 3, "x"), ("1969-12-30 23:59:58.5", 3, "x"), ("0001-01-01 00:00:00", 3, "x"), ("9999-12-31 23:59:59.6", 3, "x"), ("2300-01-01 23:59:59.7", 3, "x"),
    (None, 4, "view"), (None, 4, "view"), (None, None, None), (None, None, None), ("infinity", 5, "view"), ("infinity", 5, "view"), ("-infinity", 5, "view"),
    ("2024-01-01 00:00:00", None, "view"), ("2024-01-01 10:00:00", None, "view"), ("2024-01-01 00:00:00", 6, None), ("2024-01-01 10:00:00", 6, None),
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    root, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?::TIMESTAMP, ?, ?, 1, NULL)", [(i, *r) for i, r in enumerate(ODD)])
    con.execute(f"COPY events TO '{root}/events.parquet' (FORMAT parquet)")
    return str(root), con


def same_as_sql(spark, odd, name):
    root, con = odd
    got = catalogue.queries()[name](spark, root)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_replay_dupes_of_odd_times(spark, odd):
    same_as_sql(spark, odd, "replay_dupes")


def test_stream_replay_dedupe_of_odd_times(spark, odd):
    same_as_sql(spark, odd, "stream_replay_dedupe")


def test_replays_are_known_over_batches_in_any_order(spark, tmp_path):
    """Files of one batch each, the latest day first; a second run goes on with what has come since."""
    def put(*rows):
        spark.createDataFrame(rows, "ts string, user_id long, event_type string").selectExpr("ts::timestamp", "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def days():
        stream = ingest.file_stream(spark, str(tmp_path), "in", files_a_trigger=1)
        return sorted((tuple(r) for r in ingest.first_of_day(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint").collect()), key=repr)

    put(("2024-03-01 12:00:00", 1, "a"), ("2024-03-01 13:00:00", 1, "a"), (None, 1, None))
    assert days() == [(1, "a", "19783"), (1, None, None)]
    put(("2024-01-01 12:00:00", 1, "a"), ("2024-03-01 23:00:00", 1, "a"), (None, 1, None))
    put(("2024-01-01 13:00:00", 1, "a"), ("2024-01-02 12:00:00", None, "a"))
    assert days() == [(1, "a", "19723"), (1, "a", "19783"), (1, None, None), (None, "a", "19724")]
    put(("2024-01-02 13:00:00", None, "a"))
    assert len(days()) == 4
