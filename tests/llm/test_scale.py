"""The ways that only large inputs take, forced on small ones."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeprint.llm import langid, lm, mixing, simhash, token_scan


@pytest.mark.parametrize("n", [1 << 12, 2 * 3 * 5 * 7 * 11, 2 * 1009])
def test_large_token_files_are_read_in_ranges(spark, tmp_path, monkeypatch, n):
    """By blocks that divide the file: of many ids, or of one where its length is twice a prime."""
    monkeypatch.setattr(token_scan, "WHOLE_BYTES", 1000)
    monkeypatch.setattr(token_scan, "RANGE_BYTES", 512)
    rng = random.Random(n)
    ids = [rng.choice([0, 3, 9, 2570, 65535]) for _ in range(n // 2)] + [7, 7]
    (tmp_path / "large").write_bytes(np.array(ids[: n // 2], dtype="<u2").tobytes())
    (tmp_path / "small").write_bytes(np.array([5, 0, 0, 6], dtype="<u2").tobytes())
    got = Counter((r["path"].rsplit("/", 1)[1], r["doc"], r["n_tokens"], r["ended"]) for r in token_scan.scan_flat(spark, str(tmp_path), block=64).collect())
    want, doc, k = Counter({("small", 0, 1, True): 1, ("small", 1, 0, True): 1, ("small", 2, 1, False): 1}), 0, 0
    for x in ids[: n // 2]:
        if x:
            k += 1
        else:
            want["large", doc, k, True] += 1
            doc, k = doc + 1, 0
    if k:
        want["large", doc, k, False] += 1
    assert got == want


def test_blocks_divide_the_file():
    assert [token_scan.record_bytes(x, 64) for x in (0, 2, 128, 2 * 1009, 96, 130)] == [2, 2, 64, 2, 48, 26]


def test_token_files_of_odd_length_raise(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"\x01\x00\x02")
    with pytest.raises(Exception, match="its length is odd"):
        token_scan.scan_flat(spark, str(tmp_path)).collect()


def test_a_lost_document_raises(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c") for i in range(10)], "doc_id long, text string")
    scan = token_scan.scan_flat
    monkeypatch.setattr(token_scan, "scan_flat", lambda *a: scan(*a).where("doc <> 1"))
    with pytest.raises(Exception, match="doesn't give back the documents"):
        token_scan.count_tokens(docs, bytes_a_file=60).collect()


def test_token_files_of_a_hot_id(spark):
    """Null and repeated ids hold most rows; several files a partition."""
    rows = [(None if i % 3 else 5, "w " * (i % 7)) for i in range(300)]
    got = token_scan.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bytes_a_file=40)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, len(t.split())) for i, t in rows)


@pytest.fixture(scope="module")
def sources(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        s = rng.choice([None, "large", "large", *(f"s{k}" for k in range(40))])
        rows.append((i, s, " ".join(["w"] * rng.randrange(6)), 1, "x", 2, 3))
    rows += [(1000 + i, f"none{i % 2}", None if i % 3 else "", 1, "x", 2, 3) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, __mix long, mix_key string, `s` int, plan int").repartition(3).cache()


def test_many_sources_give_the_same_mix(sources, monkeypatch):
    settings = mixing.Settings(entropy=1.0, max_repeat=3.0)
    want = Counter(map(tuple, mixing.mix(sources, settings).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(mixing, "HOT_SHARE", 5)
    got = mixing.mix(sources, settings)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 0
    kept = mixing.mix(sources, settings, prefix="other")
    assert kept.columns[:7] == sources.columns and {r["mix_key"] for r in kept.collect()} == {"x"}


def test_budgets_of_equal_sources_add_up(spark):
    """Extra tokens that only some of many equal sources get."""
    rows = [(i, f"s{i}", "a b c") for i in range(97)] + [(200, "t", "a " * 20), (201, "u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    settings = mixing.Settings(entropy=None, budget=400)
    totals = docs.groupBy("source").agg({"doc_id": "count"}).selectExpr("source as s", "case when source = 't' then 20L when source = 'u' then 0L else 3L end as t", "1L as n")
    plan = {r["s"]: r for r in mixing._planned(totals, settings).collect()}
    tokens = {s: {"t": 20, "u": 0}.get(s, 3) for s in plan}
    assert len(plan) == 99 and plan["u"]["passes"] == 1 and plan["u"]["rest"] == 0
    assert sum(p["passes"] * tokens[s] + p["rest"] for s, p in plan.items()) == 400
    own = [p["passes"] * 3 + p["rest"] for s, p in plan.items() if s not in "tu"]
    assert max(own) - min(own) == 1
    assert sum(b for _, b in mixing.budgets([3] * 97 + [20], settings)) == 400


def test_shards_asked_in_groups_give_the_same_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held, deleted = langid.held_out("doc_id", 7), langid.held_out("doc_id", 7, 3)
    scores = [{tuple(r) for r in lm.score(docs, held, deleted, lm.Settings(block_bytes=40_000, shard_tokens=500, fan=fan)).collect()} for fan in (10**6, 2)]
    assert scores[0] == scores[1] and len(scores[0]) == docs.count()
    nothing_deleted = [{tuple(r) for r in lm.score(docs.limit(30), held, F.lit(False), lm.Settings(block_bytes=9_000, shard_tokens=300, fan=fan)).collect()} for fan in (10**6, 2)]
    assert nothing_deleted[0] == nothing_deleted[1]


@pytest.mark.parametrize("tau", [1, 2, 3, 4])
def test_simhash_links_of_any_width_through_full_buckets(spark, tau):
    rng = random.Random(tau)
    fps = {rng.getrandbits(64) for _ in range(25)} | {rng.getrandbits(7) << 40 for _ in range(20)}
    for f in list(fps)[:25]:
        for _ in range(5):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), tau=tau, bucket_rows=2).collect()]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()

    def groups(pairs):
        root = {s: s for s in signed}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for s in signed:
            out.setdefault(find(s), []).append(s)
        return sorted(out.values())

    assert groups(edges) == groups([(a, b) for i, a in enumerate(signed) for b in signed[:i] if far(a, b) <= tau])
