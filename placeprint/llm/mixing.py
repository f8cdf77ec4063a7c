"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in [0, 1] and normalised. Bisection finds the largest a whose entropy
meets the target, lowered no further than a repetition limit allows. The weights then become token budgets, and each
budget a number of whole passes over its source and one pass cut short, every pass in its own permutation of blocks.

Weights depend on a source's tokens only, so the driver plans by distinct token counts: k different counts add up to
k (k + 1) / 2 tokens at least, which bounds them by the root of twice the corpus (5 million at 10^13 tokens), however
many sources there are.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeprint.llm.common import WORD, free_name, written

#: Up to so many rows (about 200 bytes each) a plan is broadcast. Beyond, sources with more than one document in
#: HOT_SHARE are (fewer than HOT_SHARE), the others meet their documents in a shuffle.
BROADCAST_ROWS = 10_000
HOT_SHARE = 1000
STEPS = 60


@dataclass(frozen=True)
class Settings:
    """entropy: least entropy of the weights, as a share of the largest possible; None: no target.
    max_repeat: passes over any one source at most. budget: tokens of the mix; None: as many as there are.
    rounded: budgets from weights in whole millionths, as the SQL of op2 has them; it loses sources below half a millionth."""

    entropy: float | None = 0.95
    max_repeat: float = 4.0
    budget: int | None = None
    seed: str = "mix"
    rounded: bool = False


def weights_at(shares: list[float], a: float) -> list[float]:
    """Shares raised to a, normalised."""
    raised = [p**a for p in shares]
    total = sum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights)


def _largest(fits, steps: int = STEPS) -> float:
    """The largest a in [0, 1] that fits, where all smaller ones do; 0 if none does."""
    if fits(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def exponent(tokens: list[int], settings: Settings, times: list[int] | None = None) -> float:
    """Of sources with so many tokens each, all above zero; times: how many sources have as many."""
    n = np.ones(len(tokens)) if times is None else np.array(times, dtype=np.float64)
    total = sum(tokens) if times is None else sum(t * c for t, c in zip(tokens, times))
    shares, budget, count = np.array([t / total for t in tokens]), settings.budget or total, int(n.sum())

    def spread(x: float) -> float:
        raised = shares**x
        w = raised / (n * raised).sum()
        return float(-(n * w * np.log(w)).sum())

    a = 1.0
    if settings.entropy is not None and count > 1:
        least = settings.entropy * math.log(count)
        a = _largest(lambda x: spread(x) >= least)
    smallest = float(shares.min())

    def repeats(x: float) -> float:
        return smallest**x / float((n * shares**x).sum()) * budget / (smallest * total)

    if repeats(a) > settings.max_repeat:  # raising a lowers it
        a = 1.0 - _largest(lambda x: repeats(1.0 - x) <= settings.max_repeat)
    return a


def level_budgets(levels: list[tuple[int, int]], settings: Settings) -> list[tuple[int, int, int, int]]:
    """(tokens, weight in millionths, tokens of the mix, extra) of levels (tokens of a source, sources that have as many).

    Budgets come from the weights as they are, as whole tokens with the remainders dealt out by size: extra sources of a
    level get one token more. Without the repetition limit they add up to the whole budget; only the reported weight is
    rounded (with settings.rounded, the budget is that of the rounded weight).
    """
    tokens, times = [t for t, _ in levels], [c for _, c in levels]
    a, total = exponent(tokens, settings, times), sum(t * c for t, c in levels)
    budget, raised = settings.budget or total, [t / total for t in tokens]
    flat = np.array(raised) ** a
    ppm = np.floor(flat / (np.array(times) * flat).sum() * 1e6 + 0.5).astype(np.int64).tolist()
    most = [math.floor(settings.max_repeat * t) for t in tokens]
    if settings.rounded:
        return [(t, x, min(x * budget // 1_000_000, m), 0) for t, x, m in zip(tokens, ppm, most)]
    whole_numbers = tokens if a == 1.0 else [int(math.ldexp(p**a, 200)) for p in raised]
    whole = sum(x * c for x, c in zip(whole_numbers, times))
    parts = [divmod(x * budget, whole) for x in whole_numbers]
    left, extra = budget - sum(x * c for (x, _), c in zip(parts, times)), [0] * len(levels)
    for i in sorted(range(len(parts)), key=lambda i: -parts[i][1]):
        extra[i] = min(left, times[i])
        left -= extra[i]
    return [(t, x, min(b, m), 0 if b + 1 > m else e) for t, x, (b, _), e, m in zip(tokens, ppm, parts, extra, most)]


def budgets(tokens: list[int], settings: Settings) -> list[tuple[int, int]]:
    """(weight in millionths, tokens of the mix) of each source; the extra tokens of a level go to its first sources."""
    plan = {t: [x, b, e] for t, x, b, e in level_budgets(sorted(Counter(tokens).items()), settings)}
    out = []
    for t in tokens:
        own = plan[t]
        out.append((own[0], own[1] + (own[2] > 0)))
        own[2] -= own[2] > 0
    return out


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _extras(sources: DataFrame, extra: int, seed: str) -> Column:
    """Whether a source is one of so many that are first by a hash: a condition on the columns s. Hashes are counted by
    their first four digits; only those of the one bin that holds the cut reach the driver."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.lit("extra"), F.coalesce("s", F.lit("")), F.col("s").isNull().cast("string")))
    before = 0
    for bin_, n in sorted(tuple(r) for r in sources.groupBy(F.substring(h, 1, 4)).count().collect()):
        if before + n >= extra:
            cut = sorted(r[0] for r in sources.select(h.alias("h")).where(F.substring("h", 1, 4) == bin_).collect())[extra - before - 1]
            return h <= cut
        before += n
    return F.lit(True)


def _planned(totals: DataFrame, settings: Settings) -> DataFrame:
    """s, n, ppm, passes, rest of every source of totals(s, t, n)."""
    levels = [tuple(r) for r in totals.where("t > 0").groupBy("t").agg(F.count("*").alias("c")).orderBy("t").collect()]
    plan = level_budgets(levels, settings) if levels else []
    table = pa.table({name: pa.array([x[i] for x in plan], pa.int64()) for i, name in enumerate(("t", "ppm", "b", "extra"))})
    table = totals.sparkSession.createDataFrame(table)
    own = totals.join(F.broadcast(table) if len(plan) <= BROADCAST_ROWS else table, "t", "left")
    more, times = F.coalesce(F.col("extra") > 0, F.lit(False)), dict(levels)
    for t, _, _, extra in plan:
        if 0 < extra < times[t]:  # of one level at most, some sources get the extra token
            more = F.when(F.col("t") == t, _extras(totals.where(F.col("t") == t), extra, settings.seed)).otherwise(more)
    b = F.col("b") + more.cast("long")
    none = F.col("t") == 0
    own = own.withColumn("b", b).withColumn("u", F.greatest("t", F.lit(1)))
    return own.select("s", "n", F.coalesce("ppm", F.lit(0)).alias("ppm"), F.when(none, 1).otherwise(F.expr("b div u")).cast("long").alias("passes"), F.when(none, 0).otherwise(F.expr("b % u")).cast("long").alias("rest"))


def mix(df: DataFrame, settings: Settings = Settings(), source: str = "source", doc_id: str = "doc_id", tokens: Column | None = None, prefix: str = "mix") -> DataFrame:
    """Rows of df, each as often as its source's budget takes it, with mix_epoch, mix_block, mix_key and mix_ppm.

    A source with T tokens and budget b gives b div T whole passes, then the blocks of one more pass in its permuted
    order up to the rest of the budget; in the block where it ends, the documents in permuted order that still fit.
    Sorting by (mix_epoch, mix_block, mix_key) gives each source's order. A null source is a source of its own; a source
    without any token is passed once. Rows that share id and source (repeated rows, null ids) stand or fall together; a
    null text has no token. An empty table gives an empty one. Columns of df called like the new ones are replaced
    (another prefix gives others); all others pass whatever their names.

    Texts are read once to count their words; what follows works on a lean table of ids, sources, blocks and counts, and
    shuffles one number for each source and block (4096 blocks a source) and the documents of one block a source. Texts
    themselves are shuffled only where there are more than BROADCAST_ROWS sources, but for those of the large sources.
    The driver sees one row for each distinct number of tokens.
    """
    seed = settings.seed
    tokens = word_count() if tokens is None else tokens
    name, ident = F.col(source).cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    block = F.substring(F.md5(F.concat_ws("|", F.lit(seed), ident)), 1, 3)
    lean = written(df.select(name.alias("s"), ident.alias("d"), block.alias("b"), tokens.alias("t")), "mix-lean")
    by_block = written(lean.groupBy("s", "b").agg(F.sum("t").alias("t"), F.count("*").alias("n")), "mix-blocks")
    totals = by_block.groupBy("s").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    plan = written(_planned(totals, settings), "mix-plan").withColumnRenamed("s", "source_")
    sources, rows = plan.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = (lambda x: F.broadcast(x)) if sources <= BROADCAST_ROWS else (lambda x: x)

    def permuted(source_: Column, epoch: Column, block_: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(source_, F.lit("")), epoch.cast("string"), block_))

    def key(epoch: Column, ident_: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), ident_))

    ordered = Window.partitionBy("s").orderBy("p")
    at = by_block.drop("n").join(small(plan.where("rest > 0")), F.col("s").eqNullSafe(F.col("source_"))).withColumn("p", permuted(F.col("s"), F.col("passes"), F.col("b")))
    at = at.withColumn("upto", F.sum("t").over(ordered)).where("upto > rest and upto - t <= rest")
    end = F.struct("p", F.col("b").alias("end_block"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left"), F.col("passes").alias("pass"))
    ends = at.groupBy("source_").agg(F.min_by(end, "p").alias("e")).select(F.col("source_").alias("end_source"), "e.*")
    within = lean.join(small(ends), F.col("s").eqNullSafe(F.col("end_source")) & (F.col("b") == F.col("end_block")))
    within = within.select("end_source", "t", "left", key(F.col("pass"), F.col("d")).alias("k"))
    within = within.withColumn("upto", F.sum("t").over(Window.partitionBy("end_source").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)))
    last = within.where("upto <= left").groupBy(F.col("end_source").alias("last_source")).agg(F.max("k").alias("k"))
    cuts = ends.select("end_source", "p").join(last, F.col("end_source").eqNullSafe(F.col("last_source")), "left")
    cuts = cuts.select("end_source", "p", F.coalesce("k", F.lit("")).alias("k"))
    cuts = plan.join(cuts, F.col("source_").eqNullSafe(F.col("end_source")), "left").select("source_", "n", F.struct("ppm", "passes", "p", "k").alias("plan"))

    own = free_name(df, "mix")
    keyed = lambda some: some.select(F.col("source_").alias(f"{own}_s"), F.col("plan").alias(own))
    same = name.eqNullSafe(F.col(f"{own}_s"))
    if sources <= BROADCAST_ROWS:
        out = df.join(F.broadcast(keyed(cuts)), same)
    else:
        cuts = written(cuts, "mix-cuts")
        met = df.join(F.broadcast(keyed(cuts.where(F.col("n") * HOT_SHARE > rows))), same, "left")
        rest = met.where(F.col(own).isNull()).drop(own, f"{own}_s").join(keyed(cuts.where(F.col("n") * HOT_SHARE <= rows)), same)
        out = met.where(F.col(own).isNotNull()).unionByName(rest)
    out = out.drop(f"{own}_s")
    passes = F.col(f"{own}.passes")
    block_at, key_at = permuted(name, passes, block), key(passes, ident)
    part = F.coalesce((block_at < F.col(f"{own}.p")) | ((block_at == F.col(f"{own}.p")) & (key_at <= F.col(f"{own}.k"))), F.lit(False))
    copies = passes + part.cast("long")
    epochs = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>"))
    out = out.withColumn(f"{prefix}_ppm", F.col(f"{own}.ppm")).withColumn(f"{prefix}_epoch", F.explode(epochs)).drop(own)
    return out.withColumn(f"{prefix}_block", permuted(name, F.col(f"{prefix}_epoch"), block)).withColumn(f"{prefix}_key", key(F.col(f"{prefix}_epoch"), ident))
