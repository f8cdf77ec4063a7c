"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how often the context was seen. The weights
are learned by expectation-maximisation on deleted training documents, against the counts of the others.

The model is as large as the corpus, so it is nowhere whole: documents are packed into blocks; each block asks the shards
of the n-gram space for the counts of its own distinct n-grams, and gets them back in the order in which it asked. Rows
are arrays: one for each block and shard, whatever the frequency of a word. Beyond Settings.fan shards a block asks
groups of shards only: the questions of a range of blocks to a group are gathered into one, split by shard, and the
answers dealt out again, so that rows stay long however large the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, written

_START, _END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")


@dataclass(frozen=True)
class Settings:
    """block_bytes: text in one block. shard_tokens: tokens of the corpus for each shard. fan: shards that a block asks
    at most before they are asked in groups. iterations: of EM. step: of the logarithmic grid (in octaves) on which EM sees probabilities; its size doesn't depend on the corpus."""

    block_bytes: int = 8 << 20
    shard_tokens: int = 4_000_000
    fan: int = 1024
    iterations: int = 60
    step: float = 0.25


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, the lowest first; planes of zeros only at the top are left out."""
    values = values.astype("<u8")
    n = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return values.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        got = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
        out[:, : len(got)] = got.T
    return out.reshape(-1).view("<u8")


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a bigram from the keys of its parts."""
    k = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(31)))
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def _pack(block_bytes: int):
    """Documents into blocks: local words, and each text as local indices. Deleted documents have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        state = {}

        def flush(deleted: bool):
            nonlocal made
            docs, held, lens, words, seq, _ = state.pop(deleted)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
            made += 1
            train = int(sum(n + 1 for n, h in zip(lens, held) if not h))
            yield pa.RecordBatch.from_arrays([
                pa.array([base + made]), pa.array([deleted]), pa.array([train]), pa.array([sum(lens) + len(lens)]), pa.array([docs], pa.list_(pa.int64())), pa.array([np.array(held, dtype=np.uint8).tobytes()], pa.binary()),
                pa.array([np.array(lens, dtype="<u4").tobytes()], pa.binary()), pa.array([hashes.astype("<u8").tobytes()], pa.binary()), pa.array([planes(np.concatenate(seq) if seq else np.zeros(0))], pa.binary()),
            ], ["block", "deleted", "train_tokens", "tokens", "docs", "held", "lens", "words", "seq"])

        for b in batches:
            for doc, held, deleted, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                raw = text.as_py() or b""
                docs, helds, lens, words, seq, size = state.setdefault(deleted, [[], [], [], {}, [], 0])
                cut = raw.lower().split()
                docs.append(doc)
                helds.append(held)
                lens.append(len(cut))
                put = words.setdefault
                if cut:
                    seq.append(np.fromiter((put(w, len(words)) for w in cut), dtype=np.uint32, count=len(cut)))
                state[deleted][5] = size + len(raw)
                if state[deleted][5] >= block_bytes:
                    yield from flush(deleted)
        for deleted in list(state):
            yield from flush(deleted)

    return run


_BLOCK = "block long, deleted boolean, train_tokens long, tokens long, docs array<long>, held binary, lens binary, words binary, seq binary"


class Block:
    """A block's tokens with their keys: unique unigrams and bigrams, and where each token finds its own."""

    def __init__(self, held: bytes, lens: bytes, words: bytes, seq: bytes):
        self.held, self.lens = np.frombuffer(held, dtype=np.uint8).astype(bool), np.frombuffer(lens, dtype="<u4").astype(np.int64)
        local = np.concatenate([np.frombuffer(words, dtype="<u8"), np.array([_END, _START], dtype=np.uint64)])
        end, start, n = len(local) - 2, len(local) - 1, int(self.lens.sum())
        self.last = np.cumsum(self.lens + 1) - 1  # where each text's end stands
        self.first = self.last - self.lens
        token = np.full(n + len(self.lens), end, dtype=np.int64)
        inside = np.ones(len(token), dtype=bool)
        inside[self.last] = False
        token[inside] = unplanes(seq, n).astype(np.int64)
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.first] = start
        self.train = np.repeat(~self.held, self.lens + 1)
        order = np.argsort(local)
        place = np.empty_like(order)
        place[order] = np.arange(len(local))
        self.uni, self.token, self.context, self.start = local[order], place[token], place[context], int(place[start])
        self.bi, self.pair = np.unique(joined(local[context], local[token]), return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each unique unigram and bigram occurs in training texts; the start counts once a text."""
        uni = np.bincount(self.token[self.train], minlength=len(self.uni))
        uni[self.start] = int((~self.held).sum())
        return uni, np.bincount(self.pair[self.train], minlength=len(self.bi))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the key space, in order."""
    width = np.uint64(-(-(2**64) // shards)) if shards > 1 else np.uint64(2**64 - 1)
    return np.minimum(keys // width, np.uint64(shards - 1)).astype(np.int64)


_ASKED = "shard long, block long, order long, n long, keys binary, counts binary, gone binary"
_ASKED_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _asked(rows: list[tuple]) -> pa.Table:
    """Rows of _ASKED; gone: the part of the counts that deleted texts bring, null where there is none."""
    cols = list(zip(*rows)) or [[]] * len(_ASKED_TYPES)
    return pa.table({x.split()[0]: pa.array(c, t) for x, c, t in zip(_ASKED.split(", "), cols, _ASKED_TYPES)})


def _split(asker: int, order: int, keys: np.ndarray, counts: np.ndarray, gone: np.ndarray | None, shard: np.ndarray) -> Iterator[tuple]:
    """One row for each shard of sorted keys."""
    for s in np.unique(shard):
        lo, hi = np.searchsorted(shard, [s, s + 1])
        yield int(s), asker, order, int(hi - lo), planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), planes(counts[lo:hi]), None if gone is None else planes(gone[lo:hi])


def _ask(shards: int):
    """One row for each block, order and shard: the block's keys there and its own counts."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() for name in ("block", "deleted", "held", "lens", "words", "seq")}
                block = Block(row["held"], row["lens"], row["words"], row["seq"])
                for order, keys, counts in zip((1, 2), (block.uni, block.bi), block.counts()):
                    for one in _split(row["block"], order, keys, counts, counts if row["deleted"] else None, _shard_of(keys, shards)):
                        yield from _asked([one]).to_batches()

    return run


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of one order: their distinct keys, summed counts and summed deleted counts, and where each row's keys are."""
    keys = np.concatenate([np.cumsum(unplanes(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
    counts = np.concatenate([unplanes(r["counts"], r["n"]) for r in rows]).astype(np.int64)
    gone = np.concatenate([np.zeros(r["n"], dtype=np.int64) if r["gone"] is None else unplanes(r["gone"], r["n"]).astype(np.int64) for r in rows])
    unique, at = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(at, weights=x, minlength=len(unique)).astype(np.int64) for x in (counts, gone)), at


def _gather(shards: int):
    """The questions of a range of blocks to a group of shards as those of one asker, by shard."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for order in (1, 2):
            if some := [r for r in rows if r["order"] == order]:
                unique, counts, gone, _ = _summed(some)
                out += _split(key[1].as_py(), order, unique, counts, gone if any(r["gone"] is not None for r in some) else None, _shard_of(unique, shards))
        return _asked(out)

    return run


def _scatter(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The answers to a gathered question, dealt out to the blocks that asked."""
    rows, got, out = left.to_pylist(), right.to_pylist(), []
    for order in (1, 2):
        some = [r for r in rows if r["order"] == order]
        back = sorted((r for r in got if r["order"] == order), key=lambda r: r["shard"])
        if not some:
            continue
        *_, at = _summed(some)
        whole = np.concatenate([unplanes(r["whole"], r["n"]) for r in back])
        rest = np.concatenate([unplanes(r["rest"], r["n"]) for r in back]) if back[0]["rest"] is not None else None
        types, i = sum(r["types"] for r in back), 0
        for r in some:
            mine = at[i : i + r["n"]]
            i += r["n"]
            out.append((r["block"], r["shard"], order, r["n"], planes(whole[mine]), planes(rest[mine]) if r["gone"] is not None else None, types))
            types = 0
    return _replies(out)


_REPLY_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())


def _replies(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(_REPLY_TYPES)
    return pa.table({x.split()[0]: pa.array(c, t) for x, c, t in zip(_REPLY.split(", "), cols, _REPLY_TYPES)})


def _reply(table: pa.Table) -> pa.Table:
    """A shard's rows of all askers: what each asked for, summed over the corpus, with and without deleted texts."""
    rows, out = table.to_pylist(), []
    for order in (1, 2):
        some = [r for r in rows if r["order"] == order]
        if not some:
            continue
        unique, whole, gone, at = _summed(some)
        rest = whole - gone
        types = int(np.count_nonzero(whole[unique != np.uint64(_START)])) if order == 1 else 0
        i = 0
        for r in some:
            mine = at[i : i + r["n"]]
            i += r["n"]
            out.append((r["block"], r["shard"], order, r["n"], planes(whole[mine]), planes(rest[mine]) if r["gone"] is not None else None, types))
            types = 0
    return _replies(out)


_REPLY = "block long, shard long, order long, n long, whole binary, rest binary, types long"


def _read_back(left: pa.Table, right: pa.Table, column: str) -> tuple[dict, Block, np.ndarray, np.ndarray]:
    row = left.to_pylist()[0]
    block = Block(row["held"], row["lens"], row["words"], row["seq"])
    got = sorted(right.select(["order", "shard", "n", column]).to_pylist(), key=lambda r: (r["order"], r["shard"]))
    uni, bi = (np.concatenate([unplanes(r[column], r["n"]) for r in got if r["order"] == o] or [np.zeros(0, dtype=np.uint64)]).astype(np.int64) for o in (1, 2))
    return row, block, uni, bi


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the binary logarithm of its frequency."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1))[1], 0)


def _estimates(block: Block, uni: np.ndarray, bi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: its context's bucket, and the maximum-likelihood estimates of order 2 and 1."""
    context = uni[block.context]
    return bucket(context), bi[block.pair] / np.maximum(context, 1), uni[block.token] / max(n, 1)


def _grid(n_rest: int, step: float):
    """Deleted texts as counts on a grid of (bucket, log of order 2, log of order 1)."""

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(-np.log2(np.where(p > 0, p, 1)) / step), -1).astype(np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, block, uni, bi = _read_back(left, right, "rest")
        where, p2, p1 = _estimates(block, uni, bi, n_rest)
        cells, n = np.unique(np.stack([where, level(p2), level(p1)])[:, block.train], axis=1, return_counts=True)
        return pa.table({"bucket": pa.array(cells[0]), "p2": pa.array(cells[1]), "p1": pa.array(cells[2]), "n": pa.array(n)})

    return run


def learn_weights(cells: np.ndarray, types: int, settings: Settings) -> np.ndarray:
    """Weights (bucket, order 2 / order 1 / uniform) by EM; cells has rows bucket, level of p2, level of p1, count.

    Each component starts with one token of its own, so no weight becomes zero; an unseen context has none for order 2.
    Buckets without deleted tokens take the weights of all.
    """
    out = np.tile(np.array([0.6, 0.35, 0.05]), (66, 1))
    p = np.stack([np.where(x >= 0, np.exp2(-x * settings.step), 0.0) for x in (cells[:, 1], cells[:, 2])] + [np.full(len(cells), 1 / (types + 1))], axis=1)

    def em(some: np.ndarray) -> np.ndarray:
        w, n = np.array([0.6, 0.35, 0.05]), cells[some, 3]
        for _ in range(settings.iterations):
            share = w * p[some]
            w = 1 + (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0)
            w /= w.sum()
        return w

    if len(cells):
        out[:] = em(np.ones(len(cells), dtype=bool))
        for b in np.unique(cells[:, 0]):
            out[b] = em(cells[:, 0] == b)
    out[0, 0] = 0
    return out / out.sum(axis=1, keepdims=True)


def _score(n: int, types: int, weights: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block, uni, bi = _read_back(left, right, "whole")
        where, p2, p1 = _estimates(block, uni, bi, n)
        w, own = weights[where], uni[block.token]
        logs = np.stack([np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1)), np.log10((own + 1) / (n + types + 1)), own > 0])
        sums = np.add.reduceat(logs, block.first, axis=1) if len(block.first) else np.zeros((3, 0))
        k = len(block.lens)
        return pa.table({
            "doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.lens + 1), "n_known": pa.array(sums[2].astype(np.int64)),
            "train_tokens": pa.array(np.full(k, n)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0]),
        })

    return run


def _by_groups(asks: DataFrame, shards: int) -> DataFrame:
    """Replies to blocks that ask groups of shards: as many groups as ranges of blocks and as shards in a group, a power
    of two, so that no shard crosses the border of a group."""
    groups = 1 << math.ceil(math.log2(shards) / 2)
    shards, ranges = groups * groups, groups
    asked = written(asks.mapInArrow(_ask(groups), _ASKED).withColumn("asker", F.pmod(F.xxhash64("block"), F.lit(ranges))), "lm-asked")
    mid = asked.groupBy("shard", "asker").applyInArrow(_gather(shards), _ASKED)
    answers = mid.groupBy("shard").applyInArrow(_reply, _REPLY).withColumn("group", F.floor(F.col("shard") / groups).cast("long"))
    back = answers.groupBy("group", F.col("block").alias("asker"))
    return asked.groupBy(F.col("shard").alias("group"), "asker").cogroup(back).applyInArrow(_scatter, _REPLY)


def score(df: DataFrame, held_out: Column, deleted: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out texts are scored only; the others are learned from too. deleted names those on which the weights are learned
    (where they are not held out). Counts cover all training texts; the weights see deleted texts against the counts of
    the rest, the scores use all. Words are split at ASCII white space, A-Z lower-cased; an end follows each text and
    counts as a token. base_score is add-one smoothing over the training types and one more.

    Null and empty texts have one token, the end. Without training texts all scores come from the uniform estimate.
    Repeated rows are learned and scored as often as they occur; an empty table gives an empty one; other columns of df
    aren't looked at. Bounds the session's Arrow batches.
    """
    bounded_batches(df.sparkSession)
    held = F.coalesce(held_out, F.lit(False))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held"), (F.coalesce(deleted, F.lit(False)) & ~held).alias("deleted"), F.col(text).cast("binary").alias("text"))
    blocks = written(rows.mapInArrow(_pack(settings.block_bytes), _BLOCK), "lm-blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("train_tokens"), F.when(~F.col("deleted"), F.col("train_tokens")), F.col("tokens"))]).first()
    n, n_rest, tokens = sums
    shards = max(64, -(-tokens // settings.shard_tokens))
    asks = blocks.select("block", "deleted", "held", "lens", "words", "seq")
    if shards <= settings.fan:
        replies = written(asks.mapInArrow(_ask(shards), _ASKED).groupBy("shard").applyInArrow(_reply, _REPLY), "lm-replies")
    else:
        replies = written(_by_groups(asks, shards), "lm-replies")
    types = replies.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]

    def paired(some: DataFrame, column: str):
        return some.select("block", "docs", "held", "lens", "words", "seq").groupBy("block").cogroup(replies.where(F.col(column).isNotNull()).select("block", "order", "shard", "n", column).groupBy("block"))

    grid = paired(blocks.where("deleted"), "rest").applyInArrow(_grid(n_rest, settings.step), "bucket long, p2 long, p1 long, n long").groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))
    cells = np.array([tuple(r) for r in grid.collect()], dtype=np.int64).reshape(-1, 4)
    weights = learn_weights(cells, types, settings)
    return paired(blocks, "whole").applyInArrow(_score(n, types, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
