"""Diagnostics and evaluation: what separates locations, what confuses them, and how good predictions are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeprint.operators import scoring


def coefficient_stats(long: DataFrame, *keys: str) -> DataFrame:
    """keys, mean, std (population), skew (biased; null without spread), p10, p90 of x."""
    out = long.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.skewness("x").alias("skew"))
    return out.join(grouped_percentiles(long, list(keys), "x", {"p10": 0.1, "p90": 0.9}), list(keys))


def grouped_percentiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and exact percentiles of a column, named by shares, with linear interpolation between neighbours.

    Equal numbers are counted first; how many lie below each is a running sum by ranges, so no group's numbers meet in
    one task or buffer. Nulls in the column are no numbers; a group without any has no row; keys may not be null.
    """
    steps = df.where(F.col(column).isNotNull()).groupBy(F.struct(*keys).alias("__key"), F.col(column).alias("__x")).agg(F.count("*").alias("__c"))
    total = steps.groupBy("__key").agg(F.sum("__c").alias("__n"))
    steps = running_sum(steps, "__key", "__x", "__c", "__below").join(total, "__key")
    picked = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("__n") - 1)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__c"))
            picked.append(F.max(F.when(here, F.col("__x"))).alias(f"__{name}_{end}"))
    out = steps.groupBy("__key").agg(F.first("__n").alias("__n"), *picked)

    def value(name: str, share: float) -> Column:
        place = F.lit(share) * (F.col("__n") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name)

    return out.select("__key.*", *[value(name, share) for name, share in shares.items()])


def fisher_scores(clips: DataFrame, label: str = "location") -> DataFrame:
    """pos, fisher, weight: spread between label means over spread within labels, by dimension.

    The overall mean is the unweighted mean of the label means. Weights are shares of the largest score.
    """
    by = scoring.long_form(clips, label).groupBy(label, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("w"))
    by_pos = by.groupBy("pos").agg(F.collect_list(F.struct("m", "n")).alias("g"), F.avg("m").alias("mm"), F.sum("w").alias("w"))  # one entry a label
    between = F.aggregate("g", F.lit(0.0), lambda s, x: s + x["n"] * (x["m"] - F.col("mm")) * (x["m"] - F.col("mm")))
    scored = by_pos.select("pos", (between / (F.col("w") + 1e-8)).alias("fisher"))
    largest = scored.agg(F.max("fisher").alias("largest"))
    return scored.crossJoin(F.broadcast(largest)).select("pos", "fisher", (F.col("fisher") / (F.col("largest") + 1e-8)).alias("weight"))


def own_and_other(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, location, own_score, other_location, other_score, wrong, from scores with location and base_location.

    The best other location: ties go to the first by name; null where there is no other.
    """
    keys = keys or ("clip_id",)
    own = F.max(F.when(F.col("location") == F.col("base_location"), F.col("score")))
    other = F.min(F.when(F.col("location") != F.col("base_location"), F.struct((-F.col("score")).alias("s"), F.col("base_location").alias("l"))))
    out = scores.groupBy(*keys, "location").agg(own.alias("own_score"), other.alias("o"))
    return out.select(*keys, "location", "own_score", F.col("o.l").alias("other_location"), (-F.col("o.s")).alias("other_score")).withColumn(
        "wrong", F.col("own_score") < F.col("other_score"),
    )


def by_location(own: DataFrame) -> DataFrame:
    """location, clips, mean, min, max of own scores, worst_confusion."""
    return own.groupBy("location").agg(
        F.count("*").alias("clips"), F.avg("own_score").alias("mean"), F.min("own_score").alias("min"), F.max("own_score").alias("max"),
        F.max("other_score").alias("worst_confusion"),
    )


def spectrum(clips: DataFrame, top_hz: float = 8000.0) -> DataFrame:
    """clip_id, pos, freq, s: absolute vector entries as a spectrum over 0..top_hz."""
    n = F.size("vector")
    return clips.select("clip_id", n.alias("n"), F.posexplode("vector").alias("pos", "x")).select(
        "clip_id", "pos", (F.col("pos") * top_hz / (F.col("n") - 1)).alias("freq"), (F.abs("x") + 1e-10).alias("s"),
    )


def confusion(predicted: DataFrame) -> DataFrame:
    """actual, predicted, n."""
    return predicted.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def _both_sides() -> Column:
    """A cell of the confusion matrix under both its labels: struct(label, t, p) with its count as true and as predicted."""
    none = F.lit(0).cast("long")
    true = F.struct(F.col("actual").alias("label"), F.col("n").alias("t"), none.alias("p"))
    return F.explode(F.array(true, F.struct(F.col("predicted").alias("label"), none.alias("t"), F.col("n").alias("p"))))


def class_report(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of every actual label; 0 where a quotient isn't defined."""
    sides = matrix.select(
        _both_sides().alias("s"),
        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    c = sides.groupBy("s.label").agg((F.sum("hit") / 2).alias("tp"), F.sum("s.p").alias("p"), F.sum("s.t").alias("support")).where("support > 0")
    q = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        "label", q(F.col("tp"), F.col("p")).alias("precision"), q(F.col("tp"), F.col("support")).alias("recall"),
        q(2 * F.col("tp"), F.col("p") + F.col("support")).alias("f1"), "support",
    )


def agreement(matrix: DataFrame) -> DataFrame:
    """accuracy, Cohen's kappa and Matthews' coefficient, closed forms over the confusion counts."""
    n, ok = F.sum("n").cast("double"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double")
    whole = matrix.agg(n.alias("n"), ok.alias("ok"))
    labels = matrix.select(_both_sides().alias("s")).groupBy("s.label").agg(
        F.sum("s.t").cast("double").alias("t"), F.sum("s.p").cast("double").alias("p"),
    )
    sums = labels.agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    n, ok, tp, tt, pp = map(F.col, ("n", "ok", "tp", "tt", "pp"))
    return whole.crossJoin(sums).select(
        (ok / n).alias("accuracy"), F.try_divide(ok / n - tp / (n * n), 1 - tp / (n * n)).alias("kappa"),
        F.try_divide(ok * n - tp, F.sqrt((n * n - pp) * (n * n - tt))).alias("mcc"),
    )


def soft_max(scores: DataFrame, sharpness: float = 10.0, *keys: str) -> DataFrame:
    """Scores as probabilities p of the base locations of each clip."""
    keys = keys or ("clip_id",)
    e = scores.withColumn("e", F.exp(F.lit(sharpness) * F.col("score")))
    return e.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy(*keys))).drop("e")


def log_loss_and_auc(probabilities: DataFrame) -> DataFrame:
    """log_loss (mean -ln p of the true location) and auc (mean over locations, one against the rest, ties by half).

    The area is a rank sum: counts by distinct p first, then a running sum that is split by ranges of p, so that no
    location's rows meet in one task.
    """
    loss = probabilities.where(F.col("location") == F.col("base_location")).agg(F.avg(-F.ln(F.greatest("p", F.lit(1e-15)))).alias("log_loss"))
    hit = F.col("location") == F.col("base_location")
    steps = probabilities.groupBy("base_location", "p").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    steps = running_sum(steps, "base_location", "p", "neg", "below")
    area = steps.groupBy("base_location").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("a"), F.sum("pos").cast("double").alias("pos"),
        F.sum("neg").cast("double").alias("neg"),
    )
    return loss.crossJoin(area.agg(F.avg(F.try_divide(F.col("a"), F.col("pos") * F.col("neg"))).alias("auc")))


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str, width: int = 256) -> DataFrame:
    """df with name: the sum of value over the rows of the key that come before in order.

    Rows of a key are dealt into ranges of the order column (its approximate quantiles by key), summed by range, and only
    then run through a window, each range in a task of its own.
    """
    marks = df.groupBy(key).agg(F.percentile_approx(order, F.array(*[F.lit(i / width) for i in range(1, width)]), F.lit(4 * width)).alias("__marks"))
    at = df.join(marks, key).withColumn("__range", F.size(F.filter("__marks", lambda m: m < F.col(order)))).drop("__marks")
    sums = at.groupBy(key, "__range").agg(F.sum(value).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = at.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, [key, "__range"])
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def expected_and_best(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, location, best_location, best_score, margin, expected_score, correct_match."""
    keys = keys or ("clip_id",)
    expected = scores.where(F.col("location") == F.col("base_location")).select(*keys, F.col("score").alias("expected_score"))
    return scoring.best(scores, *keys, "location").join(expected, list(keys), "left").withColumn("correct_match", F.col("best_location") == F.col("location"))


def duplicates(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """md5, path: every file whose content occurs more than once."""
    keyed = files.select(F.md5(content).alias("md5"), F.col(path).alias("path"))
    return keyed.join(keyed.groupBy("md5").agg(F.count("*").alias("n")).where("n > 1").select("md5"), "md5", "left_semi")


def duplicate_groups(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """md5, n, first of contents that occur more than once; a group of any size is one partial aggregate."""
    return files.select(F.md5(content).alias("md5"), F.col(path).alias("path")).groupBy("md5").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def profile(df: DataFrame) -> DataFrame:
    """column, n, nulls, mean, std, min, max of every numeric column, in one pass."""
    names = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    aggs = [f(F.col(c)).cast("double").alias(f"{c}:{n}") for c in names for n, f in (("n", F.count), ("nulls", lambda x: F.count_if(x.isNull())), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    row = df.agg(*aggs)
    stats = ("n", "nulls", "mean", "std", "min", "max")
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}:{s}`").alias(s) for s in stats]) for c in names])).alias("x")).select(
        "x.column", F.col("x.n").cast("long").alias("n"), F.col("x.nulls").cast("long").alias("nulls"), "x.mean", "x.std", "x.min", "x.max",
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One number: rows that repeat another one in all columns."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n: equal widths between minimum and maximum, the last one closed; empty bins included."""
    c = F.col(column)
    ends = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    counted = df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).select(F.least(F.floor(F.coalesce(F.try_divide((c - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    return every.join(counted, "bin", "left").select(
        "bin", (F.col("lo") + step * F.col("bin")).alias("low"), (F.col("lo") + step * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r for every two columns, by one pass over the rows."""
    pairs = [(a, b) for a in names for b in names]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs if a < b])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else F.col(f"`{min(a, b)}|{max(a, b)}`")).alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """label, code: codes from 0 in alphabetical order over the distinct labels."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)
