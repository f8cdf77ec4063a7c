"""Embedding near-dedup by lattice hashing.

Each of several tables projects unit vectors at random to eight dimensions (or a few times eight) and decodes the result
to its point of the E8 lattice. Vectors meet at their own point and at the neighbouring points that they probe.

What meets is a key, an identity and a sketch of 256 signs, not the vector. Sketches that differ in few bits join their
vectors to a candidate group, as stars; a vector then travels once, to its group, where all cosines are worked out in
double precision. Groups that are too large for one task are probed again with whole vectors, point by point.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, components, split_join, trim, written
from placeprint.llm.simhash import forest

#: Signs of a sketch, as 64-bit words, and bits in which those of a link may differ: at a cosine of 0.93 they differ in 31
#: on average, and in more than this with a probability of some millionths. Scaled with the angle for other thresholds.
WORDS = 4
SKETCH_SLACK = 4.7
#: One vector in so many is posted beforehand to see how full the points are.
KEY_SHARE = 16
#: Rows of a point up to which its sketches are compared by shifting the sorted rows against each other.
FEW = 32


@dataclass(frozen=True)
class Settings:
    """threshold: least cosine of a link. tables: independent projections (three times as many for each further block).
    probes: neighbouring points asked in each. scale: of a unit vector's projection against the lattice. cell_rows: rows
    of a label that one point should hold; sets the number of lattice blocks in a key. bucket_rows: rows of one point that
    are compared in one piece. group_rows: vectors of a candidate group that is compared in one task."""

    threshold: float = 0.93
    tables: int = 8
    probes: int = 2
    scale: float = 1.7
    cell_rows: int = 64
    bucket_rows: int = 4096
    group_rows: int = 4096
    seed: int = 7

    def sketch_bits(self) -> int:
        """Bits in which the sketches of a link differ at most, but for a very rare one."""
        p, n = math.acos(min(1.0, max(-1.0, self.threshold))) / math.pi, 64 * WORDS
        return math.floor(n * p + SKETCH_SLACK * math.sqrt(n * p * (1 - p)))


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = minimal_vectors()


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round; if the sum is odd, round the worst coordinate the other way."""
    point = np.rint(x)
    off = x - point
    worst = np.abs(off).argmax(axis=1)
    odd = np.nonzero(point.sum(axis=1).astype(np.int64) & 1)[0]
    point[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return point


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8 and of D8 shifted by a half, the closer one."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Tables:
    """Projections for vectors of one length; the codes of home points and probed points in every table."""

    def __init__(self, dim: int, blocks: int, settings: Settings):
        rng = np.random.default_rng([settings.seed, dim, blocks])
        self.settings, self.blocks = settings, blocks
        self.planes = []
        for _ in range(settings.tables * blocks):
            g = rng.normal(size=(max(dim, 8), 8))
            self.planes.append((np.linalg.qr(g)[0] * settings.scale * math.sqrt(max(dim, 8) / 8))[:dim])
        self.mix = rng.integers(1, 2**63, size=(blocks, 8), dtype=np.uint64) | np.uint64(1)
        self.signs = rng.normal(size=(dim, 64 * WORDS))

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """(rows, WORDS): on which side of 256 random planes each vector lies."""
        return np.packbits(unit @ self.signs > 0, axis=1, bitorder="little").view("<u8")

    def _hash(self, points: np.ndarray, block: int) -> np.ndarray:
        doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
        h = (doubled * self.mix[block]).sum(axis=-1, dtype=np.uint64)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def codes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(rows, 1 + probes): the code of the home point, then those of the nearest other points that differ in one block."""
        n, p = len(unit), self.settings.probes
        home = np.zeros(n, dtype=np.uint64)
        parts, gains, moved = [], [], []
        for b in range(self.blocks):
            x = unit @ self.planes[table * self.blocks + b]
            point = decode_e8(x)
            parts.append(self._hash(point, b))
            home += parts[-1]
            gain = (x - point) @ NEIGHBOURS.T
            best = np.argsort(-gain, axis=1, kind="stable")[:, :p]
            gains.append(np.take_along_axis(gain, best, 1))
            moved.append(self._hash(point[:, None, :] + NEIGHBOURS[best], b) - parts[-1][:, None])
        gain, step = np.concatenate(gains, axis=1), np.concatenate(moved, axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :p]
        return np.concatenate([home[:, None], home[:, None] + np.take_along_axis(step, best, 1)], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length, and their unit vectors in double precision."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.nonzero(sizes == dim)[0]
        yield at, _unit(flat[starts[at][:, None] + np.arange(dim)])


_known: dict[tuple, Tables] = {}


def _tables(dim: int, blocks: int, settings: Settings) -> Tables:
    key = (dim, blocks, settings)
    if key not in _known:
        _known[key] = Tables(dim, blocks, settings)
    return _known[key]


def _salts(labels: pa.Array) -> np.ndarray:
    """A number of each label, mixed into the keys: vectors of different labels hardly ever meet."""
    raw = [x.encode()[-8:].rjust(8, b"\0") for x in labels.to_pylist()]
    return np.frombuffer(b"".join(raw), dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)


def _keys(code: np.ndarray, salt: np.ndarray, table: int) -> np.ndarray:
    return (((code ^ salt) + np.uint64(table)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


_SKETCHES = "key long, node long, " + ", ".join(f"s{i} long" for i in range(WORDS))


def _sketch_posts(blocks: int, settings: Settings, lean: bool):
    """From rows (node, label, vector): _SKETCHES, a vector's sketch at its home point (node even) and at its probes
    (node odd) in every table; lean: the keys only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SKETCHES.split(", ")]
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                node, salt = b.column(0).to_numpy(zero_copy_only=False), _salts(b.column(1))
                for at, unit in _by_size(b.column(2)):
                    tables = _tables(unit.shape[1], blocks, settings)
                    words = [] if lean else [pa.array(w.astype("<u8").view(np.int64)) for w in tables.sketch(unit).T]
                    for t in range(settings.tables):
                        codes = tables.codes(unit, t)
                        for k in range(codes.shape[1]):
                            key = pa.array(_keys(codes[:, k], salt[at], t))
                            yield pa.RecordBatch.from_arrays([key] if lean else [key, pa.array(node[at] + (k > 0)), *words], names[:1] if lean else names)

    return run


def _near_sketches(bits: int):
    """Rows of _SKETCHES with a, b, chunk, sorted by (key, a, b): of what meets at a point, one of each pair at home, stars
    over the nodes whose sketches are near."""

    def few(node, words, group, size):
        """Points of FEW rows at most, all at once."""
        left, found = np.nonzero(size[group] <= FEW)[0], []
        home, own = node & 1 == 0, node >> 1
        for step in range(1, FEW):
            left = left[left + step < len(node)]
            left = left[group[left] == group[left + step]]
            if not len(left):
                break
            right = left + step
            near = np.bitwise_count(words[left] ^ words[right]).sum(axis=1, dtype=np.int64) <= bits
            ok = near & (home[left] | home[right]) & (own[left] != own[right])
            found.append((own[left[ok]], own[right[ok]]))
        return found

    def many(node, words, split, chunk):
        """One point: everyone at home against all."""
        home, own, found = np.nonzero(node & 1 == 0)[0], node >> 1, []
        for i in range(0, len(home), 128):
            at = home[i : i + 128]
            far = np.zeros((len(at), len(node)), dtype=np.int64)
            for w in words.T:
                far += np.bitwise_count(w[at, None] ^ w[None, :])
            ok = (far <= bits) & (own[at, None] != own[None, :])
            if split:
                ok &= chunk[at, None] != chunk[None, :]
            l, r = np.nonzero(ok)
            if len(l):
                found.append(forest(own[at[l]], own[r]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                now = rest
            else:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
                now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if now is None or not len(now[0]):
                continue
            key, node, a, b, chunk = now[0], now[1], now[-3], now[-2], now[-1]
            change = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[0] + 1])
            if batch is not None:  # the last point may go on in the next batch
                rest = [x[change[-1] :] for x in now]
                if not change[-1]:
                    continue
                key, node, a, b, chunk = (x[: change[-1]] for x in (key, node, a, b, chunk))
                change = change[:-1]
            size = np.diff(change, append=len(key))
            words = np.stack([x[: len(key)] for x in now[2 : 2 + WORDS]], axis=1).view(np.uint64)
            found = few(node, words, np.repeat(np.arange(len(size)), size), size)
            for s, n in zip(change[size > FEW], size[size > FEW]):
                own = slice(s, s + n)
                found += many(node[own], words[own], a[s] != b[s], chunk[own])
            found = [x for x in found if len(x[0])]
            if found:
                star = forest(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], ["a", "b"])
        trim()

    return run


_LINKED = "row long, n long, root long"


def _within_groups(threshold: float):
    """Rows (group, row, label, mult, vector) sorted by group: of each row with a link, the other rows linked with it and
    the least row that links reach."""

    def links(b: pa.RecordBatch):
        row, mult = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
        label = np.unique(np.array(b.column(2).to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        degree, found = np.zeros(len(row), dtype=np.int64), []
        for at, unit in _by_size(b.column(4)):
            for i in range(0, len(at), 512):
                near = (unit[i : i + 512] @ unit.T >= threshold) & (label[at[i : i + 512], None] == label[None, at])
                near[np.arange(len(near)), np.arange(i, i + len(near))] = False
                degree[at[i : i + 512]] += near @ mult[at]
                l, r = np.nonzero(near)
                if len(l):
                    found.append(forest(row[at[l + i]], row[at[r]]))
        if not found:
            return None
        far, least = forest(*map(np.concatenate, zip(*found)))
        root = dict(zip(far.tolist(), least.tolist()))
        some = np.nonzero(degree)[0]
        return pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(degree[some]), pa.array([root.get(x, x) for x in row[some].tolist()], pa.int64())], ["row", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            of = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(of[1:] != of[:-1])[0] + 1).tolist(), len(of)] if len(of) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != of[lo]:
                    if (out := links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                        yield out
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held and (out := links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
            yield out
        trim()

    return run


def _post(blocks: int, settings: Settings, lean: bool):
    """Rows (key, home, tab, code, row, label, mult, vector): a vector at its home point and at its probes in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                row, mult = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                label, salt = np.array(b.column(1).to_pylist(), dtype=object), _salts(b.column(1))
                for at, unit in _by_size(b.column(3)):
                    raw = [v.tobytes() for v in unit]
                    for t in range(settings.tables):
                        codes = _tables(unit.shape[1], blocks, settings).codes(unit, t)
                        for k in range(codes.shape[1]):
                            code = codes[:, k]
                            cols = {"key": pa.array(_keys(code, salt[at], t)), "home": pa.array(np.full(len(at), k == 0))}
                            if not lean:
                                cols |= {"tab": pa.array(np.full(len(at), t, dtype=np.int32)), "code": pa.array(code.view(np.int64)), "row": pa.array(row[at]), "label": pa.array(label[at].tolist(), pa.string()), "mult": pa.array(mult[at]), "vector": pa.array(raw, pa.binary())}
                            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _compare(blocks: int, settings: Settings):
    """Rows sorted by (key, a, b): in every bucket, who links, as numbers of links and as stars.

    A pair may meet in several tables; it is counted in the first one, and there in one bucket only: both work out from
    the vectors where that is.
    """

    def bucket(rows: dict[str, np.ndarray]):
        """Pairs of a bucket that link: (left, right) positions. One of each is at home; equal chunks meet once."""
        order = np.argsort(~rows["home"], kind="stable")
        homes = int(rows["home"].sum())
        if not homes or len(order) < 2:
            return []
        dims = {len(v) for v in rows["vector"]}
        found = []
        for dim in dims:
            own = order if len(dims) == 1 else order[[len(rows["vector"][k]) == dim for k in order]]
            base = own[rows["home"][own]]
            if not len(base):
                continue
            rank = np.zeros(len(rows["home"]), dtype=np.int64)
            rank[own] = np.arange(len(own))
            x = np.frombuffer(b"".join(rows["vector"][own]), dtype=np.float64).reshape(len(own), -1)
            for i in range(0, len(base), 512):
                near = x[i : i + 512][: len(base) - i] @ x[i:].T  # base comes first in own, so later columns cover each pair once
                l, r = np.nonzero(near >= settings.threshold)
                l, r = own[l + i], own[r + i]
                ok = (l != r) & (rows["row"][l] != rows["row"][r]) & (rows["label"][l] == rows["label"][r]) & (rows["tab"][l] == rows["tab"][r]) & (rows["code"][l] == rows["code"][r])
                ok &= (rows["a"][l] == rows["b"][l]) | (rows["chunk"][l] != rows["chunk"][r])
                both = rows["home"][l] & rows["home"][r]
                ok &= ~both | (rank[l] < rank[r])
                found.append((l[ok], r[ok]))
        return found

    def here(rows: dict[str, np.ndarray], l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Whether this bucket is where the pair counts."""
        used, at = np.unique(np.concatenate([l, r]), return_inverse=True)
        left, right = at[: len(l)], at[len(l) :]
        sizes = np.array([len(rows["vector"][k]) for k in used])
        codes = np.zeros((settings.tables, len(used), 1 + settings.probes), dtype=np.uint64)
        for size in np.unique(sizes):
            some = np.nonzero(sizes == size)[0]
            unit = np.frombuffer(b"".join(rows["vector"][used[some]]), dtype=np.float64).reshape(len(some), -1)
            for t in range(settings.tables):
                codes[t, some] = _tables(size // 8, blocks, settings).codes(unit, t)
        first = np.full(len(l), -1)
        where = np.zeros(len(l), dtype=np.uint64)
        swap = rows["row"][l] > rows["row"][r]
        lo, hi = np.where(swap, right, left), np.where(swap, left, right)
        for t in range(settings.tables):
            same = codes[t, lo, 0] == codes[t, hi, 0]
            by_hi = (codes[t, hi, 1:] == codes[t, lo, :1]).any(axis=1)
            by_lo = (codes[t, lo, 1:] == codes[t, hi, :1]).any(axis=1)
            new = (first < 0) & (same | by_hi | by_lo)
            first[new] = t
            where[new] = np.where(same | by_hi, codes[t, lo, 0], codes[t, hi, 0])[new]
        return (first == rows["tab"][l]) & (where == rows["code"][l].view(np.uint64))

    def done(rows: dict[str, np.ndarray], pairs: list):
        if not pairs:
            return
        l, r = (np.concatenate(x) for x in zip(*pairs))
        keep = here(rows, l, r)
        l, r = l[keep], r[keep]
        if not len(l):
            return
        ids = np.concatenate([rows["row"][l], rows["row"][r]])
        n = np.concatenate([rows["mult"][r], rows["mult"][l]])
        node, at = np.unique(ids, return_inverse=True)
        degree = np.bincount(at, weights=n).astype(np.int64)
        a, b = forest(rows["row"][l], rows["row"][r])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, a])), pa.array([None] * len(node) + b.tolist(), pa.int64()), pa.array(degree.tolist() + [None] * len(a), pa.int64())], ["a", "b", "n"])

    def run(batches):
        names = ("key", "home", "tab", "code", "row", "label", "mult", "vector", "a", "b", "chunk")
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = {}
                for name in names:
                    col = batch.column(name)
                    now[name] = np.array(col.to_pylist(), dtype=object) if name in ("label", "vector") else col.to_numpy(zero_copy_only=False)
                if rest is not None:
                    now = {k: np.concatenate([rest[k], now[k]]) for k in names}
            else:
                now = rest
            if now is None or not len(now["key"]):
                continue
            change = np.nonzero((now["key"][1:] != now["key"][:-1]) | (now["a"][1:] != now["a"][:-1]) | (now["b"][1:] != now["b"][:-1]))[0] + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(now["key"])]])
            if batch is not None:  # the last bucket may go on in the next batch
                rest = {k: v[starts[-1] :] for k, v in now.items()}
                starts, ends = starts[:-1], ends[:-1]
            pairs, many = [], 0
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                for l, r in bucket({k: v[s:e] for k, v in now.items()}):
                    if len(l):
                        pairs.append((l + s, r + s))
                        many += len(l)
                if many > 200_000:
                    yield from done(now, pairs)
                    pairs, many = [], 0
            yield from done(now, pairs)

    return run


def blocks_for(rows: int, settings: Settings) -> int:
    """Lattice blocks in a key for so many rows of one label: each tells about 200 points apart at this scale."""
    return max(1, math.ceil(math.log2(max(rows, 1) / settings.cell_rows) / 7.8))


def planned(rows: int, settings: Settings) -> tuple[int, Settings]:
    """Blocks for so many rows of one label, and settings with as many more tables as longer keys need for the recall."""
    blocks = blocks_for(rows, settings)
    return blocks, replace(settings, tables=settings.tables * 3 ** (blocks - 1))


def _dealt(posts: DataFrame, keys: DataFrame, settings: Settings, by: str, share: int = 1) -> DataFrame:
    """posts with a, b, chunk: the rows of a point with more than bucket_rows rows are dealt in chunks by the column
    ``by``, and come once for each pair of chunks that is compared in a task of its own; all others have zeros. keys has
    the key of one post in ``share``, from which sizes are estimated: they only say in how many pieces a point is compared."""
    hot = keys.groupBy("key").agg((F.count("*") * share).alias("n")).where(F.col("n") > settings.bucket_rows)
    hot = written(hot.select("key", F.ceil(F.col("n") / settings.bucket_rows).cast("int").alias("chunks")), "hot-points")
    if not hot.limit(1).count():
        return posts.withColumns({k: F.lit(0) for k in ("a", "b", "chunk")})
    posts = posts.join(hot, "key", "left").withColumn("own", F.pmod(F.hash(by), F.coalesce("chunks", F.lit(1))))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    posts = posts.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).withColumn("chunk", F.col("own"))
    return posts.drop("chunks", "other", "own")


def _point_by_point(vectors: DataFrame, blocks: int, settings: Settings, parts: int) -> tuple[DataFrame, DataFrame]:
    """Links among vectors(row, label, mult, v) that share a point in some table, with whole vectors at every point:
    (row, n) and stars (a, b)."""
    source = vectors.repartition(parts, "row")
    lean = source.mapInArrow(_post(blocks, settings, True), "key long, home boolean")
    posts = source.mapInArrow(_post(blocks, settings, False), "key long, home boolean, tab int, code long, row long, label string, mult long, vector binary")
    posts = _dealt(posts, lean, settings, "row")
    met = written(posts.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_compare(blocks, settings), "a long, b long, n long"), "links")
    return met.where("n is not null").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n")), met.where("n is null").select("a", "b")


def near_vectors(df: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    n_links counts the other rows of the same label whose cosine reaches the threshold; equal vectors are one entry with
    a multiplicity and never expanded into pairs. component_id is the smallest vec_id reachable, kept whether it is the
    row's own. A vector without label, without components, with a null or non-finite one, or of zeros links with nothing;
    neither do vectors of different lengths. Null ids are ignored in the minimum; rows that repeat an id are kept or
    dropped together. An empty table gives an empty one; other columns of df aren't looked at. Bounds the session's Arrow
    batches.

    Exact but for pairs that no table brings together; see the README for the measured recall. A point with more than
    bucket_rows rows is dealt in chunks, every two of which are compared once in a task of their own.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(embedding) if dict(df.dtypes)[embedding] == "array<float>" else F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good).withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "label", "v")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    known = rows.where("good")
    # Equal vectors are one entry, the first of its rows. A node is 63 bits of its hash: two that share one are only compared.
    alike = written(known.groupBy("h1", "h2").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"), F.min("row").alias("row"), F.any_value("label").alias("label")), "alike")
    node = F.shiftleft(F.shiftrightunsigned("h1", 1), 1)
    largest = alike.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    blocks, settings = planned(largest[0], settings)
    parts = max(least_parts, largest[1] * settings.tables * (1 + settings.probes) // 1_000_000)
    # The rows that are first of their kind, told by a join of ids where there are others at all.
    some = known if largest[1] == known.count() else known.join(alike.select("row"), "row", "left_semi")
    some = some.select(node.alias("node"), "label", "v")
    share = min(KEY_SHARE, max(1, settings.bucket_rows // 64))
    keys = some.where(F.pmod(F.shiftright("node", 1), F.lit(share)) == 0).mapInArrow(_sketch_posts(blocks, settings, True), "key long")
    posts = some.mapInArrow(_sketch_posts(blocks, settings, False), _SKETCHES)
    dealt = _dealt(posts, keys, settings, "node", share).repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    groups = components(dealt.mapInArrow(_near_sketches(settings.sketch_bits()), "a long, b long"))
    groups = written(groups.select(F.shiftleft("node", 1).alias("node"), F.col("root").alias("group")), "groups")
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    asked = written(alike.select("row", "mult", node.alias("node")).join(groups.join(sizes, "group"), "node").select("row", "mult", "group", (F.col("size") > settings.group_rows).alias("large")), "asked")
    vectors = known.select("row", "label", "v").join(asked, "row")
    small = vectors.where("not large").select("group", "row", "label", "mult", "v").repartition(least_parts, "group").sortWithinPartitions("group")
    linked = small.mapInArrow(_within_groups(settings.threshold), _LINKED)
    if asked.where("large").limit(1).count():
        degree, stars = _point_by_point(vectors.where("large").select("row", "label", "mult", "v"), blocks, settings, parts)
        reached = components(stars).select(F.col("node").alias("row"), "root")
        linked = linked.unionAll(degree.join(reached, "row").select("row", "n", "root"))
    of_rep = alike.select("row", "h1", "h2", "mult", "first").join(linked, "row", "left").withColumn("root", F.coalesce("root", "row"))
    of_rep = written(of_rep.select("h1", "h2", "first", "root", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), "mult"), "linked")
    least = of_rep.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("rows"))
    total = largest[1]
    of_rep = split_join(of_rep, least, "root", "rows", total).select("h1", "h2", "n", "component_id", "mult")
    own = rows.select("vec_id", "h1", "h2")
    met = split_join(own.where("h1 is not null"), of_rep, ["h1", "h2"], "mult", rows.count()).select("vec_id", F.col("n").alias("n_links"), "component_id")
    out = met.unionAll(own.where("h1 is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
