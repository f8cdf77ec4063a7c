"""SimHash near-dedup under the generalised pigeonhole principle.

64-bit fingerprints link when they differ in few bits. Bits are grouped into partitions by their measured correlation.
Each fingerprint gets its own thresholds, one for each partition, whose sum is tau - partitions + 1: then any linked
fingerprint is within the threshold in some partition. Dynamic programming picks the thresholds that bring the fewest
estimated candidates. What is probed together is verified on all 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, components, free_name, trim, written

#: Rows that meet in one bucket at most; fuller buckets take the way by midpoints, which is exact and linear.
BUCKET_ROWS = 512
#: What shuffling one probe costs, in candidates.
PROBE_COST = 8.0
BITS = 64
#: Fingerprints of more than one part in so many of all rows are looked up in a broadcast.
HOT_SHARE = 1000


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """Of a whole text: A-Z lower-cased, words joined in shingles; the majority of the shingles' XXH64 bit by bit."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - width]])
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; map-only. Null and empty texts have the fingerprint 0."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64))
        trim()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), of(F.col(text)).alias("fp"))


def group_bits(together: np.ndarray, ones: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of the bits: each grows from its least used bit by the bit most correlated with it so far."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [free.pop(int(np.argmax(corr[np.ix_(free, free)].sum(axis=1))))]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(corr[np.ix_(free, group)].sum(axis=1)))))
        out.append(sorted(group))
    return out


def pack(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The value of a group's bits, for rows of 64 bits."""
    return (bits[:, group].astype(np.int64) << np.arange(len(group))).sum(axis=1)


def unpack(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _blocks(groups: list[list[int]]) -> list[list[list[int]]]:
    """Blocks of at most 8 bits of each group, whose values are counted for the estimates."""
    return [[g[i : i + 8] for i in range(0, len(g), 8)] for g in groups]


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    for b in batches:
        bits = unpack(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
        both += bits.T @ bits
    at = np.nonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at[0] * BITS + at[1], pa.int64()), pa.array(both[at].astype(np.int64))], ["k", "n"])


def _value_counts(blocks: list[list[int]]):
    def run(batches):
        out = np.zeros((len(blocks), 256), dtype=np.int64)
        for b in batches:
            bits = unpack(b.column(0).to_numpy(zero_copy_only=False))
            for i, block in enumerate(blocks):
                out[i] += np.bincount(pack(bits, block), minlength=256)
        at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at[0] * 256 + at[1], pa.int64()), pa.array(out[at])], ["k", "n"])

    return run


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """Counters of all rows; size numbers reach the driver."""
    out = np.zeros(size, dtype=np.int64)
    for k, n in df.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def near_tables(counts: np.ndarray, blocks: list[list[list[int]]], n: int, tau: int) -> list[np.ndarray]:
    """For each group and each of its blocks: the share of rows at distance 0..tau from each value of the block."""
    out, at = [], 0
    values = np.arange(256)
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    for group in blocks:
        tables = np.zeros((len(group), 256, tau + 1))
        for j in range(len(group)):
            for e in range(tau + 1):
                tables[j, :, e] = (distance == e) @ counts[at] / max(n, 1)
            at += 1
        out.append(tables)
    return out


def estimates(bits: np.ndarray, blocks: list[list[int]], tables: np.ndarray, n: int, tau: int) -> np.ndarray:
    """Estimated rows within 0..tau of each row in one group, its blocks taken as independent."""
    share = np.zeros((len(bits), tau + 1))
    share[:, 0] = 1
    for block, table in zip(blocks, tables):
        own, nxt = table[pack(bits, block)], np.zeros_like(share)
        for e in range(tau + 1):
            for d in range(e + 1):
                nxt[:, e] += share[:, e - d] * own[:, d]
        share = nxt
    return n * np.cumsum(share, axis=1)


def allocate(cost: np.ndarray, tau: int) -> np.ndarray:
    """Thresholds (rows, groups) of least cost with sum tau - groups + 1; cost is (rows, groups, tau + 1), -1 is free."""
    rows, groups, _ = cost.shape
    spend = np.arange(tau + 2)  # threshold + 1; the sum over groups is tau + 1
    best = np.full((rows, tau + 2), np.inf)
    best[:, 0] = 0
    choice = np.zeros((groups, rows, tau + 2), dtype=np.int8)
    for g in range(groups):
        nxt = np.full_like(best, np.inf)
        for s in spend:
            for c in range(s + 1):
                new = best[:, s - c] + (cost[:, g, c - 1] if c else 0)
                less = new < nxt[:, s]
                nxt[less, s], choice[g, less, s] = new[less], c
        best = nxt
    out, left = np.zeros((rows, groups), dtype=np.int64), np.full(rows, tau + 1)
    for g in range(groups - 1, -1, -1):
        c = choice[g, np.arange(rows), left]
        out[:, g], left = c - 1, left - c
    return out


def _flips(width: int, e: int) -> np.ndarray:
    """Masks of at most e of width bits, the empty one first."""
    masks = [np.zeros(1, dtype=np.int64)]
    for _ in range(e):
        masks.append(np.unique(np.concatenate([m ^ (np.int64(1) << np.arange(width)) for m in masks[-1]])) if len(masks[-1]) else masks[-1])
    return np.array(sorted(set(np.concatenate(masks).tolist()), key=lambda m: (m.bit_count(), m)), dtype=np.int64)


def _probes(groups: list[list[int]], tables: list[np.ndarray], n: int, tau: int):
    """Rows (part, value, fp, home, asks): each fingerprint is at home in every partition and asks at what it probes."""
    blocks = _blocks(groups)
    masks = [[_flips(len(g), e) for e in range(tau + 1)] for g in groups]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 8192):
                fps = whole.column(0).slice(i, 8192).to_numpy(zero_copy_only=False)
                bits = unpack(fps)
                cost = np.stack([estimates(bits, b, t, n, tau) + PROBE_COST * np.array([len(m) - 1 for m in ms]) for b, t, ms in zip(blocks, tables, masks)], axis=1)
                chosen = allocate(cost, tau)
                for g, group in enumerate(groups):
                    value = pack(bits, group)
                    yield _probe_rows(g, value, fps, True, chosen[:, g] >= 0)
                    for e in range(1, tau + 1):
                        some = chosen[:, g] == e
                        if some.any():
                            flips = masks[g][e][1:]
                            yield _probe_rows(g, (value[some, None] ^ flips).ravel(), np.repeat(fps[some], len(flips)), False, True)

    return run


def _probe_rows(part: int, value: np.ndarray, fps: np.ndarray, home: bool, asks) -> pa.RecordBatch:
    n = len(fps)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, dtype=np.int32)), pa.array(value), pa.array(fps), pa.array(np.full(n, home)), pa.array(np.broadcast_to(asks, n).copy())], ["part", "value", "fp", "home", "asks"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the components of pairs (a, b): (node, least node) of every node that isn't the least itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        nxt = label.copy()
        np.minimum.at(nxt, label[x], least)
        np.minimum.at(nxt, label[y], least)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _verify(tau: int):
    """Rows sorted by part and value: links of what meets in a bucket, as stars."""

    def links(key: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray, asks: np.ndarray):
        found, many, step = [], 0, 0
        left = np.arange(len(fp))
        while True:
            step += 1
            left = left[left + step < len(fp)]
            left = left[(key[left] == key[left + step]) & (part[left] == part[left + step])]
            if not len(left):
                break
            right = left + step
            ok = ((asks[left] & home[right]) | (asks[right] & home[left])) & (np.bitwise_count(fp[left].view(np.uint64) ^ fp[right].view(np.uint64)) <= tau) & (fp[left] != fp[right])
            if ok.any():
                found.append((fp[left[ok]], fp[right[ok]]))
                many += int(ok.sum())
                if many > 200_000:
                    found, many = [forest(*map(np.concatenate, zip(*found)))], 0
        return forest(*map(np.concatenate, zip(*found))) if found else None

    def run(batches):
        rest: list[np.ndarray] | None = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            part, value = now[0], now[1]
            if not len(part):
                continue
            last = int(np.argmax((part == part[-1]) & (value == value[-1])))  # the last bucket may go on in the next batch
            got = links(value[:last], part[:last], *(x[:last] for x in now[2:]))
            rest = [x[last:] for x in now]
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])
        if rest is not None and (got := links(rest[1], rest[0], *rest[2:])) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])

    return run


def masks(bits: int) -> np.ndarray:
    """All words of at most so many one bits, by their number."""
    one, out = np.uint64(1), [np.zeros(1, dtype=np.uint64)]
    for n in range(1, bits + 1):
        rows = np.array(list(itertools.combinations(range(BITS), n)), dtype=np.uint64)
        out.append(np.bitwise_or.reduce(one << rows, axis=1))
    return np.concatenate(out)


def _midpoints(tau: int):
    """(mid, fp, near): each fingerprint with all words within half of tau bits, rounded up; near: rounded down. Two
    fingerprints are within tau bits exactly if they share a word that is near for one of them."""

    def run(batches):
        flips = masks((tau + 1) // 2)
        near = np.bitwise_count(flips) <= tau // 2
        for b in batches:
            step = max(1, 500_000 // len(flips))
            for i in range(0, b.num_rows, step):
                fps = b.column(0).slice(i, step).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array((fps.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fps, len(flips))), pa.array(np.tile(near, len(fps)))], ["mid", "fp", "near"])

    return run


def parts_for(n: int) -> int:
    """Partitions that bring the fewest candidates and probes among n fingerprints of independent bits."""
    cost = {m: min(sum(n * w / 2 ** (BITS / m) + PROBE_COST * w for w in ws) for ws in ws_) for m, ws_ in {2: [(33, 1)], 3: [(1, 1, 1)], 4: [(1, 1, 1)]}.items()}
    return min(cost, key=cost.get)


def links(fps: DataFrame, tau: int = 2, parts: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most tau bits connect among distinct fingerprints fps(fp).

    Stars within each bucket instead of all its pairs. A bucket with more than bucket_rows rows leaves this way: its
    fingerprints are linked through the words around them within half of tau bits, which is exact and linear: 65 rows for
    each at tau = 1 or 2 (as many meet at most in one word), 2081 at 3 or 4.
    """
    n = fps.count()
    parts = parts or parts_for(n)
    both = _summed(fps, _bit_counts, BITS * BITS).reshape(BITS, BITS)
    groups = group_bits(both, np.diag(both), n, parts)
    blocks = _blocks(groups)
    flat = [b for g in blocks for b in g]
    tables = near_tables(_summed(fps, _value_counts(flat), len(flat) * 256).reshape(-1, 256), blocks, n, tau)
    probes = written(fps.mapInArrow(_probes(groups, tables, n, tau), "part int, value long, fp long, home boolean, asks boolean"), "probes")
    full = probes.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0").select("part", "value", (F.col("n") > bucket_rows).alias("hot"))
    met = probes.join(full, ["part", "value"])
    some = met.where("not hot").select("part", "value", "fp", "home", "asks")
    some = some.repartition(*_width(fps, 3 * n), "part", "value").sortWithinPartitions("part", "value").mapInArrow(_verify(tau), "a long, b long")
    mids = met.where("hot").select("fp").distinct().mapInArrow(_midpoints(tau), "mid long, fp long, near boolean")
    centres = mids.groupBy("mid").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").drop("n")
    stars = mids.join(centres, "mid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return some.unionAll(stars)


def _width(df: DataFrame, rows: int) -> tuple[int]:
    """Partitions for a shuffle of so many narrow rows."""
    return (max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 1_000_000),)


def near_dedup(df: DataFrame, width: int = 3, tau: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, fp, component_id (the smallest id reachable by links, itself included).

    Null and empty texts have the fingerprint 0 and link like any other. Null ids are ignored in the minimum; a component
    of null ids only has a null component_id. Repeated rows give repeated results; an empty table an empty one; other
    columns of df aren't looked at. Bounds the session's Arrow batches.
    """
    own = written(fingerprints(df, width, seed, doc_id, text), "fingerprints")
    first = written(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    reached = components(links(first.select("fp"), tau))
    least = first.join(reached, first.fp == reached.node).groupBy("root").agg(F.min("first").alias("component_id"))
    of_linked = reached.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    of_all = written(first.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "components")
    # A fingerprint of more than a thousandth of all rows is one of fewer than a thousand: these are broadcast, the rest is joined.
    common = F.broadcast(of_all.where(F.col("n") * HOT_SHARE > first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select("fp", "component_id", F.lit(True).alias("found")))
    met = own.join(common, "fp", "left")
    rest = met.where("found is null").select("doc_id", "fp").join(of_all, "fp")
    return met.where("found").select("doc_id", "fp", "component_id").unionAll(rest.select("doc_id", "fp", "component_id"))


def fingerprint_hex(fp):
    """A signed long column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Dropped ids are broadcast up to so many (about 1 MB); beyond, they meet the documents in a shuffle.
BROADCAST_IDS = 100_000


def drop_near(df: DataFrame, width: int = 3, tau: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df of which near_dedup() says that theirs is the smallest id of its component; all columns stay.

    Rows without an id stay. Rows that share an id are one document here: they stay or go together. An empty table gives
    an empty one.
    """
    found, name = near_dedup(df, width, tau, seed, doc_id, text), free_name(df, "gone")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return df.join(F.broadcast(gone) if few else gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
