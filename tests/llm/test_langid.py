"""Language ID against a brute-force version; the model's cuts are by language."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from placeprint.llm import langid, queries


def brute(rows, settings=langid.Settings()):
    """rows: (text, lang) to learn from, all of the sample. A function: text -> (language, score)."""
    counts = defaultdict(Counter)  # (order, lang): grams
    for text, lang in rows:
        for w in langid.words(text):
            if w.isalpha():
                counts[0, lang][w] += 1
                for n in settings.orders:
                    counts[n, lang].update(langid.grams(w, n))
    langs = sorted({lang for _, lang in rows})
    log, kept = {}, {}
    for n in (0, *settings.orders):
        total = Counter()
        for lang in langs:
            total.update(counts[n, lang])
        kept[n] = set()
        for lang in langs:
            some = [g for g in counts[n, lang] if total[g] >= settings.min_count]
            kept[n] |= set(sorted(some, key=lambda g: (-counts[n, lang][g], g))[: settings.max_grams])
        for lang in langs:
            whole = sum(counts[n, lang].values()) + settings.smoothing * (len(kept[n]) + 1)
            for g in kept[n]:
                log[n, lang, g] = math.log((counts[n, lang][g] + settings.smoothing) / whole)

    def of_word(w):
        if w in kept[0]:
            return [log[0, lang, w] for lang in langs]
        for n in settings.orders:
            if some := [g for g in langid.grams(w, n) if g in kept[n]]:
                return [sum(log[n, lang, g] for g in some) / len(some) for lang in langs]
        return [0.0] * len(langs)

    def predict(text):
        some = [w for x in langid.words(text or "") if (w := "".join(c for c in x if c.isalpha()))]
        if not some:
            return "und", 0.0
        totals = [sum(x) / math.sqrt(len(some)) for x in zip(*map(of_word, some))]
        odds = [math.exp(t - max(totals)) for t in totals]
        return langs[odds.index(max(odds))], max(odds) / sum(odds)

    return predict


@pytest.mark.parametrize("most", [100_000, 40])
def test_language_id_equals_brute_force(spark, sf_dir, most):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    settings = langid.Settings(max_grams=most)
    model = langid.fit(langid.training_rows(table), settings)
    predict = brute([(r["text"], r["lang"]) for r in langid.training_rows(table).collect()], settings)
    for r in langid.identify(table, model).collect():
        lang, score = predict(r["text"])
        assert (r["language"]["lang_pred"], round(r["language"]["score"], 9)) == (lang, round(score, 9))


def test_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    predict = brute([(r["text"], r["lang"]) for r in langid.training_rows(table).collect()])
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in queries.op5_langid(spark, sf_dir).collect():
        lang, score = predict(texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def test_no_language_pushes_out_another(spark):
    """A hundred words of a frequent language and four of a rare one, at a cut of fifty each."""
    rows = [(i, " ".join(f"{a}{b}{c}" for c in "klmnopqrst") * 3, "big") for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "abcdefghij")]
    rows += [(1000 + i, "zyx zyxu zwv zwvu", "small") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(max_grams=50))
    assert len(model.known) == 54 and {"zyx", "zyxu", "zwv", "zwvu"} < model.known.keys()
    assert model.predict(["zyx zwvu", "zyxwv"])[0] == ["small", "small"]
    few = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(max_entries=100))
    assert len(few.known) <= 20 and few.predict(["zyx"])[0] == ["small"]


def test_sparse_sums():
    logs = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    s = langid.Sparse.dense(logs)
    assert s.sums(np.array([2, 0, 1]), np.array([0, 0, 2]), 3).tolist() == [[6, 8], [0, 0], [3, 4]]
    own = langid.Sparse(np.array([-1.0, -2.0]), np.array([0, 1, 1, 3]), np.array([1, 0, 1]), np.array([0.5, 1.0, 2.0]))
    assert own.sums(np.array([0, 1, 2]), np.array([0, 1, 1]), 2).tolist() == [[-1.0, -1.5], [-1.0, -2.0]]
    assert own.sums(np.array([], dtype=np.int64), np.array([], dtype=np.int64), 1).tolist() == [[0, 0]]
