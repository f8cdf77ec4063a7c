"""Grace dedup of hot texts: bounded rows and tables, two rounds, clashing names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeprint.llm import grace_dedup as g


def folded(rows, table_bytes):
    fold, out = g.Fold(7 << 32, table_bytes), []
    for doc, content in rows:
        fold.put(doc, hash(content) % 1000, content)
        out += [r for b in fold.take() for r in b.to_pylist()]
        assert len(fold.entries) <= g.TABLE_ROWS + 1 and fold.held <= g.HELD_IDS + 1
    return out + [r for b in fold.take(last=True) for r in b.to_pylist()]


def test_a_hot_text_sends_one_row_a_task(monkeypatch):
    monkeypatch.setattr(g, "CHUNK_IDS", 50)
    rng, rows = random.Random(1), []
    for i in range(6000):
        rows.append((i if i % 11 else None, b"hot text " * 3 if i % 3 == 0 else b"" if i % 3 == 1 else b"cold %d" % rng.randrange(10**9)))
    out = folded(rows, 2000)
    assert all(len(r["ids"]) <= 50 for r in out)
    entries = [r for r in out if r["h"] is not None]
    sent = Counter(r["content"] for r in entries)
    assert sent[b"hot text " * 3] == 1 and sent[b""] == 1 and max(sent.values()) == 1
    ids, want = defaultdict(list), defaultdict(list)
    content = {r["rep"]: r["content"] for r in entries}
    for r in out:
        ids[content[r["rep"]]] += r["ids"]
    for i, c in rows:
        want[c].append(i)
    key = lambda v: (v is None, v or 0)
    assert {c: sorted(x, key=key) for c, x in ids.items()} == {c: sorted(x, key=key) for c, x in want.items()}
    by_chunk = {(r["rep"], r["chunk"]): r["ids"] for r in out}
    for r in entries:
        assert r["n"] == len(want[r["content"]]) and r["top"] == max((i for i in want[r["content"]] if i is not None), default=None)
        assert by_chunk[r["rep"], r["top_chunk"]][0] == r["top"]


def test_tables_are_bounded_by_rows_and_ids(monkeypatch):
    monkeypatch.setattr(g, "TABLE_ROWS", 40)
    monkeypatch.setattr(g, "HELD_IDS", 90)
    rows = [(i, b"%d" % (i % 60)) for i in range(3000)]
    out = folded(rows, 1 << 20)
    assert sum(len(r["ids"]) for r in out) == 3000 and sum(r["n"] for r in out if r["n"]) == 3000


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(i, "" if i % 3 == 0 else "the same text" if i % 3 == 1 else f"text {i % 50}", 1, 2, "x", "y") for i in range(900)]
    rows += [(None, None, 1, 2, "x", "y"), (899, "the same text", 1, 2, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, __h long, hot_h long, __bucket string, salt string").repartition(40, F.rand(3)).cache()


@pytest.mark.parametrize("hot_rows", [3, 10**9])
@pytest.mark.parametrize("table_bytes", [60, 1 << 20])
def test_two_rounds_give_the_same(hot, monkeypatch, hot_rows, table_bytes):
    monkeypatch.setattr(g, "HOT_ROWS", hot_rows)
    data, groups = hot.collect(), defaultdict(list)
    for r in data:
        groups[r["text"] or ""].append(r["doc_id"])
    top = {t: max(i for i in ids if i is not None) for t, ids in groups.items()}
    got = g.exact_dedup(hot, table_bytes=table_bytes).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter((r["doc_id"], top[r["text"] or ""], len(groups[r["text"] or ""])) for r in data)
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert Counter(kept) == Counter(top.values())
    whole = g.drop_exact(hot, table_bytes=table_bytes)
    assert whole.columns == hot.columns
    assert Counter(tuple(r) for r in whole.collect()) == Counter((i, t, 1, 2, "x", "y") for t, i in top.items())


def test_windows_keep_what_occurs_again():
    one = lambda i, t: pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t], "h": [len(t)]})
    batches = [one(i, "hot" if i % 2 else f"cold text {i}") for i in range(200)]
    out = [r for b in g._rows_fold("doc_id", "text", "h", 400)(iter(batches)) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out if r["text"] == "hot"] == [199] and len(out) == 101
