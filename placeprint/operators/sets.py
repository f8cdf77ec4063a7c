"""Ledgers, leakage, splits and set rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeprint.functions import paths


def unseen(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Files whose key isn't in the ledger. Put it below the decoder: only then is a file's content never read."""
    return files.join(ledger.select(key), key, "left_anti")


def without_folders(files: DataFrame, *names: str, path: str = "path") -> DataFrame:
    """Files with none of the named folders in their path."""
    parts = F.split(paths.normal(F.col(path)), "/")
    return files.where(~F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names])))


def leaked(split: DataFrame, provenance: DataFrame, path: str = "path") -> DataFrame:
    """Held-out files that some training clip draws on; paths compared in normal form."""
    used = provenance.select(F.explode("source_files").alias("__p")).select(paths.normal(F.col("__p")).alias("__p"))
    return split.join(used, paths.normal(F.col(path)) == F.col("__p"), "left_semi")


def without_baseline(files: DataFrame, baselines: DataFrame) -> DataFrame:
    """Files of locations that have no baseline, with the warning."""
    return files.join(baselines.select("location"), "location", "left_anti").withColumn("warning", F.format_string("no baseline for %s", "location"))


def usable(records: DataFrame, latest: DataFrame | None = None, plotted: DataFrame | None = None, key: str = "file") -> DataFrame:
    """Records with scores, of the latest run if one is given, and not plotted yet if that is known."""
    out = records.where(F.col("avg_scores").isNotNull())
    if latest is not None:
        out = out.join(latest.select(key), key, "left_semi")
    return out if plotted is None else out.join(plotted.select(key), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """n: keys that are on both sides."""
    return left.select(*keys).intersect(right.select(*keys)).agg(F.count("*").alias("n"))


def guarded(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left, failing when a key is on both sides."""
    n = overlap(left, right, *keys).select(F.when(F.col("n") > 0, F.raise_error(F.format_string("%d groups are on both sides of the split", "n"))).otherwise(F.lit(True)).cast("boolean").alias("__ok"))
    return left.crossJoin(F.broadcast(n)).where("__ok").drop("__ok")


def draw(key: Column, seed: int | str = 42) -> Column:
    """A stable pseudo-random order of keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def holdout(files: DataFrame, label: str, key: str, share: float = 0.2, seed: int | str = 42) -> DataFrame:
    """Files with held_out: of each label max(1, share of its files, half to even) by a stable random order.

    No label becomes one task: the cut is the order value at the wanted rank, found in two steps. Rows are counted by
    label and by the first two digits of the order value (256 bins a label); only the bin that holds the cut is ranked.
    """
    at = files.withColumn("__d", draw(F.col(key), seed)).withColumn("__bin", F.substring("__d", 1, 2))
    bins = at.groupBy(label, "__bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy(label).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(label)))
    bins = bins.withColumn("want", F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("total")).cast("long")))
    cut = bins.where("before < want and want <= before + n").select(
        F.col(label).alias("__label"), F.col("__bin").alias("cut_bin"), (F.col("want") - F.col("before")).alias("rest"),
    )
    inside = at.join(cut, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bin") == F.col("cut_bin"))).withColumn(
        "__r", F.row_number().over(Window.partitionBy("__label").orderBy("__d", key)),
    )
    last = inside.where("__r = rest").select("__label", F.struct("__d", key).alias("__cut"))
    out = at.join(last, F.col(label).eqNullSafe(F.col("__label")))
    return out.withColumn("held_out", F.struct("__d", key) <= F.col("__cut")).drop("__d", "__bin", "__label", "__cut")


def grouped_split(rows: DataFrame, label: str, group: str, share: float = 0.25, seed: int | str = 42) -> DataFrame:
    """Rows with fold_test: whole groups held out, so many of each label that about the share of its groups is."""
    groups = rows.groupBy(group).agg(F.min(label).alias(label))
    chosen = holdout(groups, label, group, share, seed).select(group, F.col("held_out").alias("fold_test"))
    return rows.join(chosen, group)


def groups_per_class(rows: DataFrame, label: str, group: str, least: int = 2) -> DataFrame:
    """label, n_groups, too_few."""
    return rows.groupBy(label).agg(F.count_distinct(group).alias("n_groups")).withColumn("too_few", F.col("n_groups") < least)
