"""Personal data by pattern, and terms that disclose it by information theory.

Patterns find the protected entities. A term of the same document discloses one if its pointwise mutual information with the
entity, from co-occurrence over the corpus, comes near the entity's own information content: then seeing the term is
almost as good as seeing the entity. Such terms are removed, or generalised where they disclose less.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, split_join, trim, written

KINDS = ("email", "ip", "card", "phone")
#: The characters of an e-mail's local part, and the patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """support: documents of distinct words in which a term has to occur with an entity. generalise, remove: shares of
    the entity's information that a term gives away."""

    support: int = 2
    generalise: float = 0.75
    remove: float = 0.95


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @, what may stand before and after it."""
    out, done, left, at = [], 0, 0, text.find("@")
    while at >= 0:
        start = left + len(text[left:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        left = max(done, at + 1)
        at = text.find("@", left)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all matches that pass, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Where each term of a text stands outside all spans: lower-cased term to (start, end) in order."""
    out, at, done = {}, 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while at < len(spans) and spans[at][0] < e:  # spans are sorted by start
            done = max(done, spans[at][2])
            at += 1
        if e - s > 1 and s >= done:
            out.setdefault(m.group().lower(), []).append((s, e))
    return out


_KIND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
_PLACES = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
#: One row a document; rows without a row number count documents of a task that hold a term, by the hash of the term.
_FOUND = (
    "row long, doc_id long, counts array<long>, base_sha256 string, spans array<struct<start:long,kind:long,end:long>>, entities array<string>, around long, "
    "terms array<struct<term:string,at:array<struct<start:int,end:int>>>>, sha string, text string, h long, n long"
)
_FOUND_TYPES = {
    "row": pa.int64(), "doc_id": pa.int64(), "counts": pa.list_(pa.int64()), "base_sha256": pa.string(), "spans": _KIND, "entities": pa.list_(pa.string()), "around": pa.int64(),
    "terms": _PLACES, "sha": pa.string(), "text": pa.string(), "h": pa.int64(), "n": pa.int64(),
}
#: Occurrences of terms, or characters of texts, in one batch of results, but for a single document's.
_OCCURRENCES = 50_000
_CHARACTERS = 2_000_000
#: Terms that a task counts before it puts their counts out.
_TERMS = 200_000


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _FOUND_TYPES.items()], list(_FOUND_TYPES))


def _find(every_text: bool):
    """Base spans and terms of documents, and the counts of all terms by document, in one pass. The text goes along for
    documents with an entity, or for all."""
    named, digest = lambda names, values: dict(zip(names, values)), xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, counted = TaskContext.get().partitionId() << 33, Counter()

        def counts():
            h = np.fromiter(counted.keys(), dtype=np.uint64, count=len(counted)).view(np.int64)
            n = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
            counted.clear()
            order = np.argsort(h)
            for i in range(0, len(order), 65_536):
                at = order[i : i + 65_536]
                own = {"h": pa.array(h[at]), "n": pa.array(n[at])}
                yield pa.RecordBatch.from_arrays([own.get(k, pa.nulls(len(at), t)) for k, t in _FOUND_TYPES.items()], list(_FOUND_TYPES))

        for b in batches:
            rows, many, size = [], 0, 0
            for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
                text = value.as_py() or ""
                spans = base_spans(text)
                said = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)
                terms = occurrences(text, spans) if spans else {}
                around = xxhash.xxh64_intdigest(" ".join(t for _, t in sorted((s, t) for t, at in terms.items() for s, _ in at))) >> 1
                counted.update({digest(t.lower(), 42) for t in set(_TERM.findall(text))})  # as occurrences() has them
                row += 1
                many += sum(map(len, terms.values()))
                size += len(text) if spans or every_text else 0
                rows.append({
                    "row": row, "doc_id": doc, "counts": [sum(s[1] == i for s in spans) for i in range(4)], "base_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "spans": [named(("start", "kind", "end"), s) for s in spans], "entities": sorted({f"{KINDS[k]}:{text[a:e]}" for a, k, e in spans}), "around": around,
                    "terms": [{"term": t, "at": [named(("start", "end"), x) for x in at]} for t, at in terms.items()], "sha": hashlib.sha256(text.encode()).hexdigest(),
                    "text": value.as_py() if spans or every_text else None,
                })
                if many > _OCCURRENCES or size > _CHARACTERS:
                    yield _batch(rows)
                    rows, many, size = [], 0, 0
                if len(counted) > _TERMS:
                    yield from counts()
            yield _batch(rows)
        yield from counts()
        trim()

    return run


def disclosing(found: DataFrame, of_term: DataFrame, settings: Settings) -> DataFrame:
    """(row, term, action): the terms of documents that disclose an entity of theirs; action is generalise or remove.

    With D documents, n(e) and n(t) of them holding entity and term, and n(e, t) holding both, the term gives away
    log2(n(e, t) D / (n(e) n(t))) of the entity's log2(D / n(e)) bits; of_term has n(t) by the 64-bit hash of the term. Entities and terms that
    lack support on their own are left out before pairs are formed, as no pair of theirs could have it.
    """
    total = found.count()
    holds = found.select("row", "around", F.explode("entities").alias("entity"))
    of_entity = holds.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_distinct("around").alias("s_e")).where(F.col("s_e") >= settings.support).select("entity", "n_e")
    of_entity = written(of_entity, "entities")
    holds = split_join(holds, of_entity, "entity", "n_e", total)
    has = found.select("row", "around", F.explode("terms.term").alias("term"))
    twice = has.groupBy("term").agg(F.count("*").alias("m_t"), F.count_distinct("around").alias("s_t")).where(F.col("s_t") >= settings.support).select("term", "m_t")
    has = has.join(holds.select("row").distinct(), "row", "left_semi").select("row", "term")
    both = written(holds.join(split_join(has, twice, "term", "m_t", total), "row"), "together")
    pairs = both.groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), F.first("m_t").alias("m_t"), F.count("*").alias("n_et"), F.count_distinct("around").alias("support"))
    own = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))

    def given(n_t: str) -> Column:
        return F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.greatest(n_t, "n_et")))

    # A term stands in as many documents at least as in those with any entity: what gives too little even so never gives enough.
    pairs = pairs.where((F.col("support") >= settings.support) & (own > 0) & (given("m_t") >= settings.generalise * own)).select("entity", "term", "n_e", "n_et")
    rated = pairs.withColumn("h", F.xxhash64("term")).join(of_term.groupBy("h").agg(F.sum("n").alias("n_t")), "h").where(given("n_t") >= settings.generalise * own)
    rated = written(rated.select("entity", "term", "n_et", F.when(given("n_t") >= settings.remove * own, "remove").otherwise("generalise").alias("action")), "rated")
    marks = split_join(both.select("row", "entity", "term"), rated, ["entity", "term"], "n_et", total)
    return marks.groupBy("row", "term").agg(F.max("action").alias("action"))


def find_private(df: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", every_text: bool = False) -> DataFrame:
    """One row per row of df: doc_id, counts (email, ip, card, phone), base_sha256, spans (start, kind, end, action), and
    for sanitised(): sha (of the text) and whole (the text, of documents with an entity, or of all if every_text).

    Base spans are always there, with the action mask; term spans are all occurrences of disclosing terms in documents
    that hold the entity they disclose, at any distance. Offsets are code points, ends exclusive. Documents without an
    entity have no spans. Null and empty texts have none; repeated rows repeat their result and count as often as they
    occur, but documents of equal words support a term once only. An empty table gives an empty one; other columns of df
    aren't looked at. Bounds the session's Arrow batches.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = written(rows.mapInArrow(_find(every_text), _FOUND), "private")
    found = seen.where("row is not null")
    marks = disclosing(found, seen.where("h is not null").select("h", "n"), settings)
    places = found.select("row", F.explode("terms").alias("x")).select("row", "x.term", "x.at")
    terms = places.join(marks, ["row", "term"]).select("row", F.explode("at").alias("x"), "action").select("row", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "action")
    terms = terms.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).cast("long").alias("kind"), "end", "action")).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("mask").alias("action")))
    out = found.select("row", "doc_id", "counts", "base_sha256", "sha", F.col("text").alias("whole"), base.alias("base")).join(terms, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast("array<struct<start:long,kind:long,end:long,action:string>>"))))
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), (s["kind"] + 1).cast("int"))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["end"].alias("end"), s["action"].alias("action")))
    return out.select("doc_id", "counts", "base_sha256", named.alias("spans"), "sha", "whole")


def sanitised(df: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, text with the spans of find_private() masked, generalised or removed, and spans.

    A null text stays null; cases are those of find_private().
    """
    found = find_private(df, settings, doc_id, text, every_text=True)
    return found.select("doc_id", redact()("whole", "spans").alias("text"), "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact():
    """A pandas UDF: (text, spans) -> the text with entities as their kind in brackets, generalised terms as [term], and
    removed terms gone. Null texts stay null; of overlapping spans the first one stands."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, spans):
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in some:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], "" if s["action"] == "remove" else f"[{s['kind']}]"]
                    at = s["end"]
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return run
