"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models, of URLs that the rules accept and reject, each interpolate all context lengths down to
a uniform base (Witten-Bell). The length-normalised difference of log-likelihoods against a calibrated threshold decides.

Texts are handled as one array of code points a batch: contexts and contexts with their next character are 64-bit hashes,
counted by sorting and looked up in sorted tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches

#: The rules, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Characters of the uniform base, the end among them.
ALPHABET = 257
#: Characters that are handled at a time.
WINDOW = 1 << 17
#: Width of the bins in which scores are counted for the threshold.
SCORE_BIN = 1 / 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """order: longest context. rows_per_class: distinct labelled URLs of each verdict that are drawn for the models, in
    expectation (a bounded sample by a hash of the URL); four in five of them are fitted on, but for those longer than
    max_chars. All labelled URLs that are not fitted on calibrate the threshold."""

    order: int = 5
    rows_per_class: int = 20_000
    max_chars: int = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    whole = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does. Of equally long, the longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def contexts(texts: list[str], order: int) -> Iterator[tuple[slice, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Of the characters of all texts, an end after each, WINDOW at a time: which ones, and for each context length which
    of them have so long a context, its hash, and its hash with the character."""
    flat = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    place = np.arange(len(flat)) - np.repeat(np.append(0, ends[:-1]), np.diff(ends, prepend=0)) if len(texts) else np.zeros(0, dtype=np.int64)
    for lo in range(0, len(flat), WINDOW):
        at = slice(lo, min(len(flat), lo + WINDOW))
        codes, pos = flat[max(0, lo - order) : at.stop].astype(np.uint64), place[at]
        skip, out = min(lo, order), []
        now, h = codes[skip:], np.full(at.stop - lo, np.uint64(0x9E3779B97F4A7C15))
        for k in range(order + 1):
            if k:
                before = np.zeros(len(now), dtype=np.uint64)
                before[max(0, k - skip) :] = codes[max(0, skip - k) : max(0, len(codes) - k)]
                h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + before)
            some = np.nonzero(pos >= k)[0]
            context = _mixed(h[some] + np.uint64(k + 1))
            out.append((some, context, _mixed(context * np.uint64(0xA0761D6478BD642F) + now[some])))
        yield at, out


def counted(texts: list[str], weights: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of contexts, of contexts with a character, and how often each of the latter occurs."""
    each = np.repeat(weights, [len(t) + 1 for t in texts])
    found = []
    for at, lengths in contexts(texts, order):
        for some, context, gram in lengths:
            key, first, back = np.unique(gram, return_index=True, return_inverse=True)
            found.append((context[first], key, np.bincount(back, weights=each[at][some], minlength=len(key)).astype(np.int64)))
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    context, gram, n = map(np.concatenate, zip(*found))
    key, first, back = np.unique(gram, return_index=True, return_inverse=True)
    return context[first], key, np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)


class Markov:
    """Counts of characters after contexts of 0 to order characters, in tables sorted by hash."""

    def __init__(self, order: int, counts: tuple[np.ndarray, np.ndarray, np.ndarray]):
        context, gram, n = counts
        by = np.argsort(gram)
        self.order, self.grams, self.n = order, gram[by], n[by]
        self.known, back = np.unique(context, return_inverse=True)
        self.types = np.bincount(back, minlength=len(self.known))
        self.total = np.bincount(back, weights=n, minlength=len(self.known)).astype(np.int64)

    @staticmethod
    def count(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return counted(urls, np.ones(len(urls)), order)

    def step(self, p: np.ndarray, context: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Probabilities after one more character of context; as they were where it is unknown."""
        if not len(self.known):
            return p
        c = np.minimum(np.searchsorted(self.known, context), len(self.known) - 1)
        g = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        n = np.where(self.grams[g] == gram, self.n[g], 0)
        return np.where(self.known[c] == context, (n + self.types[c] * p) / (self.total[c] + self.types[c]), p)

    def log_p(self, context: str, c: str) -> float:
        """Of a character after a context, all its endings interpolated."""
        p = np.array([1 / ALPHABET])
        for _, lengths in contexts([context + c], self.order):
            for some, of, gram in lengths:
                if (at := np.nonzero(some == len(context))[0]).size:
                    p = self.step(p, of[at], gram[at])
        return math.log(p[0])


class Ratio:
    """Difference of the two models per character, and the threshold below which a URL is blocked."""

    def __init__(self, accepted: Markov, rejected: Markov, threshold: float = 0.0):
        self.accepted, self.rejected, self.threshold = accepted, rejected, threshold

    def scores(self, urls: list[str]) -> np.ndarray:
        """Of each text, its end included; a character's probability is worked out once for each distinct context of a
        window."""
        if not urls:
            return np.zeros(0)
        sizes = np.array([len(u) + 1 for u in urls])
        each = np.zeros(int(sizes.sum()))
        for at, lengths in contexts(urls, self.accepted.order):
            last = np.zeros(at.stop - at.start, dtype=np.uint64)
            for some, _, gram in lengths:
                last[some] = gram  # the longest context of each place
            _, first, back = np.unique(last, return_index=True, return_inverse=True)
            p = np.full((2, len(first)), 1 / ALPHABET)
            for some, context, gram in lengths:
                mine = np.searchsorted(some, first)
                own = np.nonzero((mine < len(some)) & (some[np.minimum(mine, len(some) - 1)] == first))[0] if len(some) else np.zeros(0, dtype=np.int64)
                for model, q in zip((self.accepted, self.rejected), p):
                    q[own] = model.step(q[own], context[mine[own]], gram[mine[own]])
            each[at] = np.log(p[0] / p[1])[back]
        return np.add.reduceat(each, np.append(0, np.cumsum(sizes)[:-1])) / sizes

    def score(self, url: str) -> float:
        return float(self.scores([url])[0])


def calibrate(accepted: list[float], rejected: list[float]) -> float:
    """The threshold of the best balanced accuracy; the lowest of equals. Halfway between the two scores around it."""
    return best_cut([(s, 1, 0) for s in accepted] + [(s, 0, 1) for s in rejected])


def best_cut(scores: list[tuple[float, int, int]]) -> float:
    """The same of (score, accepted, rejected) counts; 0 without any of either."""
    marks = sorted(scores)
    all_kept, all_gone = (sum(m[i] for m in marks) for i in (1, 2))
    if not all_kept or not all_gone:
        return 0.0
    best, at, kept, gone = -1.0, 0.0, all_kept, 0
    for i, (s, good, bad) in enumerate(marks):
        if i == 0 or s > marks[i - 1][0]:
            value = kept / all_kept + gone / all_gone
            if value > best + 1e-12:
                best, at = value, s if i == 0 else (s + marks[i - 1][0]) / 2
        kept, gone = kept - good, gone + bad
    return at


def _sum_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            says, urls, n = (b.column(i).to_pylist() for i in range(3))
            for verdict in sorted(set(says)):
                own = [i for i, x in enumerate(says) if x == verdict]
                context, gram, times = counted([urls[i] for i in own], np.array([n[i] for i in own]), order)
                for i in range(0, len(gram), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(gram[part])), pa.array(context[part].view(np.int64)), pa.array(gram[part].view(np.int64)), pa.array(times[part])], ["verdict", "context", "gram", "n"])

    return run


def _draw(settings: Settings, labelled: DataFrame) -> Column | None:
    """Whether a labelled URL is one that the models are fitted on; None if either class is missing."""
    seen = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if not all(seen.get(v) for v in ("allow", "block")):
        return None
    share = F.create_map(*[x for v, n in seen.items() for x in (F.lit(v), F.lit(min(1.0, settings.rows_per_class / n)))])
    draw = F.xxhash64(F.col("url"), F.lit("url filter"))
    drawn = (F.pmod(draw, F.lit(1_000_000)) < share[F.col("verdict")] * 1_000_000) & (F.pmod(F.shiftright(draw, 32), F.lit(5)) != 0)
    return drawn & (F.length("url") <= settings.max_chars)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Ratio | None:
    """Learn from labelled(url, verdict): verdict allow or block, url not null. None if either class is missing.

    The models see the drawn URLs as often as they occur; equal URLs are one row with a count before they reach Python.
    The threshold is that of all other labelled URLs, whose scores are counted in bins of SCORE_BIN.
    """
    drawn = _draw(settings, labelled)
    if drawn is None:
        return None
    train = labelled.where(drawn).groupBy("verdict", "url").agg(F.count("*").alias("n"))
    counts = train.mapInArrow(_sum_counts(settings.order), "verdict string, context long, gram long, n long").groupBy("verdict", "context", "gram").agg(F.sum("n").alias("n")).toArrow()
    says = np.array(counts["verdict"].to_pylist(), dtype=object)
    tables = [counts[c].to_numpy() for c in ("context", "gram", "n")]
    models = [Markov(settings.order, tuple(x[says == v].view(np.uint64) if i < 2 else x[says == v] for i, x in enumerate(tables))) for v in ("allow", "block")]
    ratio = Ratio(*models)
    bin_ = F.floor(_scorer(labelled.sparkSession, ratio)("url") / SCORE_BIN)
    scores = labelled.where(~drawn).select("verdict", bin_.alias("bin")).groupBy("bin").agg(F.count_if(F.col("verdict") == "allow").alias("kept"), F.count_if(F.col("verdict") == "block").alias("gone"))
    ratio.threshold = best_cut([((r["bin"] + 0.5) * SCORE_BIN, r["kept"], r["gone"]) for r in scores.collect()])
    return ratio


def _scorer(spark, ratio: Ratio):
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(urls)), dtype="float64")

    return score


def filter_urls(df: DataFrame, settings: Settings = Settings(), rules=RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule, llr and verdict (columns so called are replaced).

    Every row is judged: by the longest rule that fits, else by the models; llr is the score less its threshold, null
    where a rule decided or there is no model (then the verdict is allow). A null or empty URL has empty host and path
    and is scored as the empty text. URLs are scored whole, A-Z lower-cased. Repeated rows repeat their verdict; they
    count in training and calibration as often as they occur. An empty table gives an empty one. Map-only but for the
    counts of the model and of scores by bin. Bounds the session's Arrow batches.
    """
    bounded_batches(df.sparkSession)
    host, path = host_and_path(F.col(url))
    df = df.withColumn("host", host).withColumn("path", path)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("verdict", says)
    lower = F.translate(F.coalesce(F.col(url), F.lit("")), _UPPER, _LOWER)
    ratio = fit(df.where(F.col("verdict").isNotNull() & F.col(url).isNotNull()).select(lower.alias("url"), "verdict"), settings)
    if ratio is None:
        return df.withColumn("llr", F.lit(None).cast("double")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    df = df.withColumn("llr", F.when(F.col("rule").isNull(), _scorer(df.sparkSession, ratio)(lower) - ratio.threshold))
    return df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("llr") < 0, "block").otherwise("allow")))
