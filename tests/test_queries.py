"""Every query with a SQL twin equals it; the others run and keep what they promise."""

from __future__ import annotations

import os

import duckdb
import pytest

from placeprint.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, tmp_path, name):
    catalogue.queries()[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {catalogue.oracle_sql()[name]}")
    columns = sorted(c[0] for c in duck.execute("DESCRIBE got").fetchall())
    assert columns == sorted(c[0] for c in duck.execute("DESCRIBE want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


def test_connected_components_equal_union_find(spark, sf_dir):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect():
        a, b = sorted((find(r[0]), find(first.setdefault((r[1], r[2]), r[0]))))
        root[b] = a
    got = {r["member"]: r["group"] for r in catalogue.queries()["connected_components"](spark, sf_dir).collect()}
    assert got == {i: find(i) for i in root}


@pytest.mark.parametrize("name", ["scan_layouts", "route_by_extension", "decode_audio", "mfcc_104", "env_9_features", "sink_roundtrip", "archive_names", "fixed_segments", "stream_sessions"])
def test_file_and_stream_queries_run(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_names_in_the_archive(spark, sf_dir):
    got = {r["name"]: r["archived"] for r in catalogue.queries()["archive_names"](spark, sf_dir).collect()}
    assert got["short.wav"] == "short_2.wav" and got["silence.wav"] == "silence.wav"


def test_scans_and_decoding(spark, sf_dir):
    q = catalogue.queries()
    d = {r["name"]: r for r in q["decode_audio"](spark, sf_dir).collect()}
    assert d["sine_440.wav"]["n"] == 192_000 and d["corrupt.wav"]["failed"] and d["call.amr"]["failed"] and not d["noise.WAV"]["failed"]
    r = {x["profile"]: x["n"] for x in q["route_by_extension"](spark, sf_dir).collect()}
    assert r == {"wide": 9, "narrow": 1, "unsupported": 1}
    s = {(x["name"], x["segment"]): x["n"] for x in q["fixed_segments"](spark, sf_dir).collect()}
    assert s["sine_440.wav", 0] == 160_000 and s["sine_440.wav", 1] == 32_000
    clips = {(x["name"], x["clip_index"]) for x in q["mfcc_104"](spark, sf_dir).collect()}
    assert ("silence.wav", 0) not in clips and ("short.wav", 0) in clips and {("sine_440.wav", 0), ("sine_440.wav", 1)} <= clips and ("sine_440.wav", 2) not in clips


def test_entry_and_import_without_the_subpackage(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    root = Path(e.__file__).parent
    code = "import sys; sys.modules['placeprint.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(root)})
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[-3]) == len(catalogue.queries())


def test_flows(spark, sf_dir):
    q = catalogue.queries()
    t = q["training_flow"](spark, sf_dir).first()
    assert t["locations"] == 3 and t["baselines"] >= 3 and -1 <= t["moderate_threshold"] <= 1
    got = {r["name"]: r for r in q["predict_flow"](spark, sf_dir).collect()}
    assert got["silence.wav"]["status"] == got["corrupt.wav"]["status"] == "REJECTED_LOW_QUALITY" and got["silence.wav"]["final_match"] is None
    assert got["sine_440.wav"]["final_match"] == "office" and got["sine_440.wav"]["num_windows"] == got["sine_440.wav"]["hashes"] == 2
    env = q["environment_flow"](spark, sf_dir).collect()
    assert {r["label"] for r in env} <= {"quiet", "moderate", "noisy"} and len(env) > 3
    three = {r["filename"]: r["recording"] for r in q["three_level_scan"](spark, sf_dir).collect()}
    assert three["sine_440.wav"] == "office" and "call.amr" not in three and "notes.txt" not in three
