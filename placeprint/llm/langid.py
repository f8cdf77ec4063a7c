"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. A word that training hasn't seen falls back to its character
n-grams, the longest ones first, and to shorter ones while none is known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, drop_written, trim, written

#: Languages that the driver is ready to hold (more raise).
MAX_LANGUAGES = 10_000
#: Resolved words in a worker's memory, and numbers in it (one for each word and language).
CACHE_WORDS = 100_000
CACHE_NUMBERS = 8_000_000
_RUN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """rows_per_lang: labelled rows that the model is fitted on, in expectation, for each language (a bounded sample,
    taken by a hash of the id). max_grams: words, and n-grams of each order, that the model keeps for each language (its
    most frequent ones, so that no language pushes out another's); max_entries: of these in all, shared alike, which
    bounds the broadcast model. min_count: of a word or n-gram in the sample. orders: character n-grams for words that
    are unknown, longest first."""

    rows_per_lang: int = 600
    max_grams: int = 100_000
    max_entries: int = 4_000_000
    orders: tuple[int, ...] = (4, 3, 2, 1)
    smoothing: float = 0.1
    min_count: int = 2


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased; characters that look like letters but are numbers are left out."""
    return _RUN.findall(text.lower())


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between its ends."""
    padded = f"<{word}>" if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _counts(orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                by_lang.setdefault(lang, Counter()).update(w for w in words(text.as_py() or "") if w.isalpha())
        for lang, seen in by_lang.items():
            out = {0: seen} | {n: Counter() for n in orders}
            for word, c in seen.items():
                for n in orders:
                    for g in grams(word, n):
                        out[n][g] += c
            for n, counter in out.items():
                items = list(counter.items())
                for i in range(0, len(items), 50_000):
                    some = items[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([n] * len(some), pa.int32()), pa.array([g for g, _ in some]), pa.array([c for _, c in some], pa.int64())], ["lang", "n", "gram", "c"])

    return run


def gram_keys(codes: np.ndarray, order: int) -> np.ndarray:
    """Keys of all windows of ``order`` code points, row by row."""
    n = codes.shape[1] - order + 1
    keys = np.full((len(codes), n), np.uint64(order))
    for i in range(order):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[:, i : i + n]
        keys ^= keys >> np.uint64(31)
    return keys


def _codes(words_: list[str], order: int) -> np.ndarray:
    """Code points of words of one length, between their ends where the order is above one."""
    if order > 1:
        words_ = [f"<{w}>" for w in words_]
    return np.frombuffer("".join(words_).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words_), -1).astype(np.uint64)


class Sparse:
    """Log frequencies by language of words or n-grams: base holds each language's value for what it hasn't seen; row i
    has entries starts[i] to starts[i + 1] of (language, value less base)."""

    def __init__(self, base: np.ndarray, starts: np.ndarray, langs: np.ndarray, values: np.ndarray):
        self.base, self.starts, self.langs, self.values = base, starts, langs, values

    @staticmethod
    def dense(logs: np.ndarray) -> Sparse:
        """Of a matrix (rows, languages)."""
        n, k = logs.shape
        return Sparse(np.zeros(k), np.arange(n + 1) * k, np.tile(np.arange(k), n), logs.ravel())

    def sums(self, at: np.ndarray, into: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): rows ``at`` summed into the places ``into``."""
        sizes = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(at) else at, sizes) + np.arange(int(sizes.sum()))
        cell = np.repeat(into, sizes) * len(self.base) + self.langs[entry]
        out = np.bincount(cell, weights=self.values[entry], minlength=n * len(self.base)).reshape(n, len(self.base))
        return out + np.bincount(into, minlength=n)[:, None] * self.base


class Model:
    """Log frequencies by language: of words by name, of n-grams by sorted key; pickled into a broadcast."""

    def __init__(self, langs: list[str], known: dict[str, int], word_logs: np.ndarray | Sparse, grams_: dict[int, tuple[np.ndarray, np.ndarray | Sparse]]):
        sparse = lambda x: x if isinstance(x, Sparse) else Sparse.dense(x)
        self.langs, self.known, self.word_logs, self.grams = langs, known, sparse(word_logs), {n: (keys, sparse(x)) for n, (keys, x) in grams_.items()}
        self.forget()

    def __reduce__(self):
        return Model, (self.langs, self.known, self.word_logs, self.grams)

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((64, max(1, len(self.langs))))
        self.used = 1  # row 0 says nothing: not a letter

    def vectors(self, unknown: list[str]) -> np.ndarray:
        """Log frequency by language of each of the words: of the word itself, else the mean of its known n-grams of the
        longest order of which it has any; zeros if it has none."""
        out = np.zeros((len(unknown), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        named: list[tuple[int, int]] = []
        for i, w in enumerate(unknown):
            if (k := self.known.get(w)) is not None:
                named.append((k, i))
            else:
                by_length.setdefault(len(w), []).append(i)
        if named:
            at, into = (np.array(x, dtype=np.int64) for x in zip(*named))
            out[into] = self.word_logs.sums(at, np.arange(len(at)), len(at))
        for length, at in by_length.items():
            left = np.array(at)
            for order, (keys, logs) in self.grams.items():
                if not len(left) or not len(keys) or length + 2 * (order > 1) < order:
                    continue
                wanted = gram_keys(_codes([unknown[i] for i in left], order), order)
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[found] == wanted
                n = hit.sum(axis=1)
                some = n > 0
                out[left[some]] = logs.sums(found[hit], np.nonzero(hit[some])[0], int(some.sum())) / n[some, None]
                left = left[~some]
        return out

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha()]
        for w in new:
            if not w.isalpha():  # a letter-like number among the letters, or alone
                rest = "".join(c for c in w if c.isalpha())
                self.at[w] = 0
                if rest:
                    letters.append(rest)
        while self.used + len(letters) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used : self.used + len(letters)] = self.vectors(letters)
        self.at.update(zip(letters, range(self.used, self.used + len(letters))))
        self.used += len(letters)
        for w in new:
            if not w.isalpha() and (rest := "".join(c for c in w if c.isalpha())):
                self.at[w] = self.at[rest]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; und and 0 where there is no letter or nothing was learned."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for i in range(0, len(texts), 512):
            seen = [words(t or "") for t in texts[i : i + 512]]
            if len(self.at) > CACHE_WORDS or self.rows.size > CACHE_NUMBERS:
                self.forget()
            self._learn(sorted(set().union(*seen) - self.at.keys()))
            get = self.at.__getitem__
            for some in seen:
                at = np.fromiter(map(get, some), dtype=np.int64, count=len(some))
                n = int(np.count_nonzero(at))
                if not n:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(self.langs))
                for i in range(0, len(at), 4096):
                    total += self.rows[at[i : i + 4096]].sum(axis=0)
                total /= np.sqrt(n)  # tempered: words of a text aren't independent
                odds = np.exp(total - total.max())
                best = int(odds.argmax())
                langs.append(self.langs[best])
                scores.append(float(odds[best] / odds.sum()))
        return langs, scores


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from train(doc_id, text, lang), lang not null. Counts of languages cover all rows; the words and n-grams
    come from the bounded sample of Settings. Without rows the model knows no language. Bounds the session's Arrow batches."""
    bounded_batches(train.sparkSession)
    seen = train.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in seen)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {})
    share = F.create_map(*[x for r in seen for x in (F.lit(r["lang"]), F.lit(min(1.0, settings.rows_per_lang / r["count"])))])
    drawn = train.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language id")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counts = drawn.select("lang", "text").mapInArrow(_counts(settings.orders), "lang string, n int, gram string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    counts = written(counts, "grams")
    most = max(1, min(settings.max_grams, settings.max_entries // (len(langs) * (1 + len(settings.orders)))))
    often = counts.groupBy("n", "gram").agg(F.sum("c").alias("total")).where(F.col("total") >= settings.min_count).drop("total")
    place_ = F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("c"), "gram"))  # a language's part of the sample
    kept = counts.join(often, ["n", "gram"], "left_semi").withColumn("place", place_).where(F.col("place") <= most).select("n", "gram").distinct()
    entries = counts.join(kept, ["n", "gram"], "left_semi").orderBy("n", "gram", "lang").toArrow()
    orders = (0, *settings.orders)
    sums = {n: np.zeros(len(langs)) for n in orders}
    place = {lang: i for i, lang in enumerate(langs)}
    for r in counts.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect():
        sums[r["n"]][place[r["lang"]]] = r["c"]
    order_of, lang_of = entries["n"].to_numpy(), np.array([place[x] for x in entries["lang"].to_pylist()], dtype=np.int32)
    known, by_key, word_logs = {}, {}, None
    for n in orders:
        at = np.nonzero(order_of == n)[0]
        own = entries["gram"].take(pa.array(at)).to_pylist()
        first = np.array([i for i, g in enumerate(own) if i == 0 or g != own[i - 1]], dtype=np.int64)
        names, starts, langs_ = [own[i] for i in first], np.append(first, len(own)), lang_of[at]
        if n:  # in the order of their keys
            keys = gram_keys(np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, n).astype(np.uint64), n).ravel()
            order = np.argsort(keys)
        else:
            keys, order = None, np.arange(len(names))
        sizes = np.diff(starts)[order]
        entry = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order]) if len(order) else np.zeros(0, dtype=np.int64)
        floor = np.log(sums[n] + settings.smoothing * (len(names) + 1))
        c = entries["c"].to_numpy()[at][entry]
        logs = Sparse(np.log(settings.smoothing) - floor, np.concatenate([[0], np.cumsum(sizes)]), langs_[entry], np.log(settings.smoothing + c) - np.log(settings.smoothing))
        if n:
            by_key[n] = keys[order], logs
        else:
            known, word_logs = {g: i for i, g in enumerate(names)}, logs
    drop_written(counts)
    return Model(langs, known, word_logs, by_key)


def predictor(spark, model: Model):
    """A pandas UDF: text -> struct(lang_pred, score)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                langs, scores = shared.value.predict(list(texts))
                yield pd.DataFrame({"lang_pred": langs, "score": scores})
        finally:
            shared.value.forget()
            trim()

    return predict


def held_out(doc_id: str | Column, folds: int, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows to learn from."""
    return docs.where(~held_out("doc_id", 4) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def identify(df: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """df with a struct column ``name``: lang_pred and score (the tempered posterior, 0 to 1) of its whole text.

    Null texts and those without a letter are und with score 0. Map-only; ties go to the first language in
    alphabetical order; repeated rows repeat their result; other columns pass through, one called ``name`` is replaced.
    Bounds the session's Arrow batches.
    """
    return df.withColumn(name, predictor(df.sparkSession, model)(F.col(text)))
