"""The character models, the threshold and the verdicts against a brute-force version."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeprint.llm import queries, url_filter


class Brute:
    """Witten-Bell over dictionaries, character by character."""

    def __init__(self, urls, order):
        self.order, self.after = order, defaultdict(lambda: defaultdict(int))
        for url in urls:
            text = url + "\0"
            for i, c in enumerate(text):
                for k in range(min(i, order) + 1):
                    self.after[text[i - k : i]][c] += 1

    def log_p(self, context, c):
        p = 1 / url_filter.ALPHABET
        for k in range(len(context) + 1):
            after = self.after.get(context[len(context) - k :])
            if after is None:
                break
            p = (after.get(c, 0) + len(after) * p) / (sum(after.values()) + len(after))
        return math.log(p)


def brute_score(accepted, rejected, url):
    text, total = url + "\0", 0.0
    for i, c in enumerate(text):
        context = text[max(0, i - accepted.order) : i]
        total += accepted.log_p(context, c) - rejected.log_p(context, c)
    return total / len(text)


URLS = ["http://a.com/x", "http://b.org/es/1", "", "http://日本.jp/é", "http://a.com/x", "z" * 50, "http://long.net/" + "ab" * 400]


@pytest.mark.parametrize("window", [7, 64, 1 << 17])
@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_scores_equal_brute_force(monkeypatch, window, order):
    monkeypatch.setattr(url_filter, "WINDOW", window)
    models = [Brute(some, order) for some in (URLS[:4], URLS[3:6])]
    ratio = url_filter.Ratio(*(url_filter.Markov(order, url_filter.Markov.count(some, order)) for some in (URLS[:4], URLS[3:6])))
    assert np.allclose(ratio.scores(URLS), [brute_score(*models, u) for u in URLS], rtol=0, atol=1e-9)
    assert ratio.scores([]).tolist() == []
    for context, c in (("", "h"), ("ht", "t"), ("qq", "x"), ("http:"[-order:] if order else "", "/")):
        if len(context) <= order:
            assert abs(ratio.accepted.log_p(context, c) - models[0].log_p(context, c)) < 1e-12


def test_probabilities_of_a_known_context_add_up():
    m = url_filter.Markov(2, url_filter.Markov.count(["abab", "abc", "b"], 2))
    p = {context: [math.exp(m.log_p(context, chr(i))) for i in range(url_filter.ALPHABET)] for context in ("", "a", "ab", "zz")}
    assert all(abs(sum(x) - 1) < 1e-9 for x in p.values())


def check(spark, pages, got, settings=url_filter.Settings()):
    """pages: (id, url); got: rows of the query."""
    lower = lambda u: "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "")
    url = {r["page_id"]: lower(r["url"]) for r in pages}
    none = {r["page_id"] for r in pages if r["url"] is None}
    draw = F.xxhash64("url", F.lit("url filter"))
    fold = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in set(url.values())], "url string").select("url", F.pmod(F.shiftright(draw, 32), F.lit(5))).collect()}
    labelled = [(r["page_id"], r["verdict"]) for r in got if r["rule"] and r["page_id"] not in none]
    models = [Brute([url[i] for i, v in labelled if v == says and fold[url[i]] and len(url[i]) <= settings.max_chars], settings.order) for says in ("allow", "block")]
    score = {u: brute_score(*models, u) for u in set(url.values())}
    rest = [((math.floor(score[url[i]] / url_filter.SCORE_BIN) + 0.5) * url_filter.SCORE_BIN, v) for i, v in labelled if not fold[url[i]] or len(url[i]) > settings.max_chars]
    kept, gone = [s for s, v in rest if v == "allow"], [s for s, v in rest if v == "block"]
    marks = sorted({s for s, _ in rest})
    cuts = [marks[0], *((a + b) / 2 for a, b in zip(marks, marks[1:]))] if kept and gone else [0.0]
    value = lambda t: sum(s >= t for s in kept) / len(kept) + sum(s < t for s in gone) / len(gone) if kept and gone else 0
    threshold = max(cuts, key=lambda t: (round(value(t), 9), -t))
    for r in got:
        if r["rule"]:
            assert r["llr"] is None
        else:
            want = score[url[r["page_id"]]] - threshold
            assert abs(r["llr"] - want) < 1e-9 and r["verdict"] == ("block" if want < 0 else "allow")


def test_query_equals_brute_force(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")  # fifty pages have too few labels
    pages = spark.read.parquet(f"{at}/pages.parquet").select("page_id", "url").collect()
    got = queries.op8_url_filter(spark, at).collect()
    assert len(got) == len(pages) and sum(r["rule"] is None for r in got) > 5
    check(spark, pages, got)


def test_repeated_urls_count_as_often_as_they_occur(spark):
    urls = ["http://a.com/Index"] * 40 + [f"http://b{i % 9}.com/page/{i}" for i in range(30)] + [f"http://c{i % 5}.net/es/{i}" for i in range(30)] + ["http://d.net/fr/"] * 7
    urls += [f"http://e.com/{'long' * 2000}{i}" for i in range(4)]
    urls += [None, "", "http://x.org/es/4", "http://x.org/page/4", "http://x.org/page/4"]
    pages = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    check(spark, df.collect(), url_filter.filter_urls(df).collect())
