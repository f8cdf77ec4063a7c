"""Disclosing terms against a brute-force version, and the texts that are left."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from placeprint.llm import queries, sanitise
from placeprint.operators import joins


def corpus(seed: int) -> list[tuple]:
    """People with an address and words that stand near it often, sometimes, or by chance; repeated rows and copies."""
    rng, out = random.Random(seed), []
    people = [(f"p{k}@mail{k % 3}.org", [f"name{k}", f"Job{k % 5}"]) for k in range(12)]
    for i in range(400):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 25))]
        if rng.random() < 0.35:
            address, own = rng.choice(people)
            words.insert(rng.randrange(len(words)), address)
            words += [w for w in own if rng.random() < 0.8]
            if rng.random() < 0.2:
                words.append("10.0.0.1")
        elif rng.random() < 0.1:
            words.append(rng.choice(rng.choice(people)[1]))
        out.append((i, " ".join(words)))
    return out + [out[3], out[3], (None, out[5][1]), (900, None), (901, ""), (902, "once@only.org zeppelin")]


def brute(rows, settings=sanitise.Settings()):
    docs, n_t, n_e = [], Counter(), Counter()
    pairs, support = Counter(), defaultdict(set)
    for _, text in rows:
        text = text or ""
        spans = sanitise.base_spans(text)
        taken = {i for a, _, b in spans for i in range(a, b)}
        places = defaultdict(list)
        for m in re.finditer(r"\w+", text):
            if m.end() - m.start() > 1 and not taken & set(range(*m.span())):
                places[m.group().lower()].append(m.span())
        around = tuple(t for _, t in sorted((s, t) for t, at in places.items() for s in at))
        entities = {(k, text[a:b]) for a, k, b in spans}
        n_t.update({m.lower() for m in re.findall(r"\w+", text)})
        n_e.update(entities)
        docs.append((spans, entities, places))
        for e in entities:
            for t in places:
                pairs[e, t] += 1
                support[e, t].add(around)
    total, action = len(rows), {}
    for (e, t), n in pairs.items():
        own = math.log2(total / n_e[e])
        if len(support[e, t]) >= settings.support and own > 0:
            given = math.log2(n * total / (n_e[e] * max(n_t[t], n)))
            if given >= settings.generalise * own:
                action[e, t] = "remove" if given >= settings.remove * own else "generalise"
    out = []
    for spans, entities, places in docs:
        marks = [(a, k, b, "mask") for a, k, b in spans]
        for t, at in places.items():
            said = [action[e, t] for e in entities if (e, t) in action]
            marks += [(a, 4, b, max(said)) for a, b in at if said]
        out.append(sorted(marks))
    return out


@pytest.mark.parametrize("share", [1000, 10])
def test_terms_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    rows = corpus(4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, entity string").repartition(3)
    got = Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"], s["action"]) for s in r["spans"])) for r in sanitise.find_private(df).collect())
    names = (*sanitise.KINDS, "term")
    want = Counter((i, tuple((a, names[k], b, x) for a, k, b, x in marks)) for (i, _), marks in zip(rows, brute(rows)))
    assert got == want
    actions = Counter(s[3] for (_, spans), n in want.items() for s in spans for _ in range(n))
    assert actions["remove"] > 20 and actions["generalise"] > 5  # the method has something to do here


def test_sanitised_texts(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    for (i, text), marks in zip(rows, brute(rows)):
        if text is not None:
            parts, at = [], 0
            for a, k, b, action in marks:
                if a >= at:
                    parts += [text[at:a], "" if action == "remove" else f"[{(*sanitise.KINDS, 'term')[k]}]"]
                    at = b
            text = "".join(parts) + text[at:]
        want[i, text] += 1
    assert Counter((r["doc_id"], r["text"]) for r in sanitise.sanitised(df).collect()) == want
    assert sanitise.sanitised(df.limit(0)).count() == 0


def test_query_reports_what_is_left(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_sanitise(spark, sf_dir).collect():
        if not r["spans"]:
            assert r["clean_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest() and r["n_removed"] == r["n_generalised"] == 0
        else:
            assert r["clean_sha256"] != hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("share", [2, 1000])
def test_split_join_is_a_join(spark, monkeypatch, share):
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    left = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 1), (3, 1), (None, 5)], "k long, x long")
    right = spark.createDataFrame([(1, 20, "a"), (2, 1, "b"), (9, 1, "c")], "k long, n long, y string")
    got = joins.split_join(left, right, "k", "n", 23)
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    assert got.columns == left.join(right, "k").columns and got.where(F.col("k") == 1).count() == 20
