"""Segmentation of signals into clips, and the rules that go with it. Long form: one row a sample.

Keys are streams (or locations); no window function runs over more than one file or clip, running offsets come from the
files' lengths, so that a long stream doesn't become one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeprint.sources.shared import written


@dataclass(frozen=True)
class Profile:
    """What the generations of the product do differently."""

    rms_floor: float | None = 0.0015
    quiet_level: float = 0.004
    quiet_share: float = 0.92
    short_files: str = "whole"  # or drop
    fmin: float = 0.0
    fmax: float | None = None


WIDE = Profile()
NARROW = Profile(short_files="drop", fmin=300.0, fmax=3400.0)
ENVIRONMENT = Profile(rms_floor=None, quiet_level=0.01, quiet_share=0.7)


def tumbling(signal: DataFrame, size: int, key: str = "stream", pos: str = "pos", short_files: str = "drop", keep_tail: bool = False) -> DataFrame:
    """Samples with window: consecutive windows of size samples by position; the tail is dropped.

    short_files = whole keeps a stream shorter than one window as its only window; keep_tail keeps the short last one.
    """
    out = signal.withColumn("window", F.floor(F.col(pos) / size))
    if keep_tail:
        return out
    length = signal.groupBy(key).agg(F.count("*").alias("__n"))
    full = F.col("window") < F.floor(F.col("__n") / size)
    return out.join(length, key).where(full | (F.col("__n") < size) if short_files == "whole" else full).drop("__n")


def array_windows(samples: Column, size: int, short_files: str = "drop") -> Column:
    """The same over an array column: an array of windows."""
    n = F.floor(F.size(samples) / size).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(samples, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<float>>"))
    if short_files == "whole":
        return F.when((n == 0) & (F.size(samples) > 0), F.array(samples)).otherwise(cut)
    return cut


def file_offsets(signal: DataFrame, key: str = "stream", file: str = "file") -> DataFrame:
    """key, file, length, offset: where each file of a stream begins when its files follow one another by name."""
    lengths = signal.groupBy(key, file).agg(F.count("*").alias("length"))
    before = Window.partitionBy(key).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def merged(signal: DataFrame, size: int, key: str = "stream", file: str = "file", pos: str = "file_pos") -> DataFrame:
    """Samples with gpos (position in the stream of files joined by name) and window; the leftover at the end is dropped."""
    offsets = file_offsets(signal, key, file)
    total = offsets.groupBy(key).agg(F.sum("length").alias("__total"))
    at = signal.join(offsets.join(total, key), [key, file]).withColumn("gpos", F.col("offset") + F.col(pos)).withColumn(
        "window", F.floor((F.col("offset") + F.col(pos)) / size),
    )
    return at.where(F.col("window") < F.floor(F.col("__total") / size)).drop("__total", "offset", "length")


def lineage(windows: DataFrame, key: str = "stream", file: str = "file", gpos: str = "gpos") -> DataFrame:
    """key, window, source_files in order, merged: the files that each window draws on."""
    by = windows.groupBy(key, "window", file).agg(F.min(gpos).alias("__first"))
    out = by.groupBy(key, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", file))), lambda s: s[file]).alias("source_files"))
    return out.withColumn("source_files", F.array_distinct("source_files")).withColumn("merged", F.size("source_files") > 1)


def crossfade(signal: DataFrame, half: int, key: str = "stream", file: str = "file", pos: str = "file_pos") -> DataFrame:
    """Samples faded around the seams between files of a stream: once at each seam, half samples on either side.

    With n samples in the window around a seam and mid the shorter side of it, the last mid samples before the seam fall
    along 1 - ramp and the first mid after it rise along ramp, ramp being the first mid of n equal steps from 0 to 1.
    """
    files = file_offsets(signal, key, file)
    order = Window.partitionBy(key).orderBy(file)
    files = files.withColumn("__prev", F.lag("length").over(order)).withColumn("__next", F.lead("length").over(order))
    h = F.lit(half)

    def side(other: str) -> tuple[Column, Column]:
        own, there = F.least(F.col("length"), h), F.least(F.col(other), h)
        return own + there, F.least(own, there)

    (n0, mid0), (n1, mid1) = side("__prev"), side("__next")
    at = signal.join(files, [key, file])
    i, j = F.col(pos), F.col(pos) - (F.col("length") - mid1)
    rise = F.when(F.col("__prev").isNotNull() & (n0 > 1) & (i < mid0), F.try_divide(i.cast("double"), n0 - 1)).otherwise(1.0)
    fall = F.when(F.col("__next").isNotNull() & (n1 > 1) & (j >= 0), 1.0 - F.try_divide(j.cast("double"), n1 - 1)).otherwise(1.0)
    return at.withColumn("sample", F.col("sample") * rise * fall).drop("length", "offset", "__prev", "__next")


def silent(rms: Column, quiet: Column, profile: Profile = WIDE) -> Column:
    """Whether a window is dead air: too low an RMS, or too large a share of quiet samples."""
    by_share = quiet > profile.quiet_share
    return by_share if profile.rms_floor is None else (rms < profile.rms_floor) | by_share


def loudness(samples: DataFrame, *keys: str, profile: Profile = WIDE) -> DataFrame:
    """keys, n, rms, peak, quiet: quiet is the share of samples below the profile's level."""
    x = F.col("sample")
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"),
        F.avg((F.abs(x) < profile.quiet_level).cast("double")).alias("quiet"),
    )


def audible(samples: DataFrame, *keys: str, profile: Profile = WIDE) -> DataFrame:
    """Loudness rows of the windows that aren't silent. Windows keep their index: silent ones leave gaps."""
    return loudness(samples, *keys, profile=profile).where(~silent(F.col("rms"), F.col("quiet"), profile))


def audible_array(samples: Column, profile: Profile = WIDE) -> Column:
    """The same test on an array column, native, so that it runs below any feature extraction."""
    n = F.size(samples)
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.nullif(n, F.lit(0)))
    quiet = F.size(F.filter(samples, lambda x: F.abs(x) < profile.quiet_level)) / F.nullif(n, F.lit(0))
    return F.coalesce(~silent(rms, quiet, profile), F.lit(False))


def pre_emphasis(samples: DataFrame, *keys: str, coefficient: float = 0.97, pos: str = "pos") -> DataFrame:
    """y[i] = x[i] - c x[i-1], the first sample as it is."""
    before = F.lag("sample").over(Window.partitionBy(*keys).orderBy(pos))
    return samples.withColumn("sample", F.col("sample") - coefficient * F.coalesce(before, F.lit(0.0)))


def without_mean(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.withColumn("sample", F.col("sample") - F.avg("sample").over(Window.partitionBy(*keys)))


def peak_normalised(samples: DataFrame, *keys: str) -> DataFrame:
    """Over the largest magnitude plus 1e-8."""
    return samples.withColumn("sample", F.col("sample") / (F.max(F.abs("sample")).over(Window.partitionBy(*keys)) + 1e-8))


def ingest_normalised(samples: DataFrame, *keys: str, target: float = 0.95) -> DataFrame:
    """To a peak of target; signals below 1e-6 stay as they are."""
    peak = F.max(F.abs("sample")).over(Window.partitionBy(*keys))
    return samples.withColumn("sample", F.when(peak < 1e-6, F.col("sample")).otherwise(F.col("sample") * (target / F.nullif(peak, F.lit(0.0)))))


def frames(samples: DataFrame, size: int, hop: int, *keys: str, pos: str = "pos") -> DataFrame:
    """Samples once for each frame of size samples every hop that covers them: frame and pos in it.

    A clip shorter than one frame is one frame padded with zeros (its samples alone appear; aggregate over size).
    """
    length = samples.groupBy(*keys).agg(F.count("*").alias("__n"))
    at = samples.join(length, list(keys))
    last = F.greatest(F.floor((F.col("__n") - size) / hop), F.lit(0))
    first = F.greatest(F.ceil((F.col(pos) - size + 1) / hop), F.lit(0))
    upto = F.least(F.floor(F.col(pos) / hop), last)
    covered = F.when(first <= upto, F.sequence(first, F.greatest(first, upto))).otherwise(F.array().cast("array<bigint>"))
    return at.withColumn("frame", F.explode(covered)).withColumn("frame_pos", F.col(pos) - F.col("frame") * hop).drop("__n")


def frame_levels(framed: DataFrame, size: int, *keys: str) -> DataFrame:
    """keys, frame, energy (root of the mean square plus 1e-10), zcr (sign changes over neighbours, 0 counts as plus)."""
    sign = F.when(F.col("sample") >= 0, 1).otherwise(-1)
    change = F.abs(sign - F.lag(sign).over(Window.partitionBy(*keys, "frame").orderBy("frame_pos")))
    return framed.withColumn("__c", change).groupBy(*keys, "frame").agg(
        F.sqrt(F.sum(F.col("sample") * F.col("sample")) / size + 1e-10).alias("energy"), (F.avg("__c") / 2).alias("zcr"),
    )


def voice_split(levels: DataFrame, *keys: str) -> DataFrame:
    """keys, noise_floor_rms, speech_rms, snr_estimate_db, zcr_mean, zcr_std, energy_dynamic_range: frames above the 60th
    percentile of energy are voice; an empty side stands for all frames."""
    marks = levels.groupBy(*keys).agg(F.percentile("energy", F.array(F.lit(0.6), F.lit(0.05), F.lit(0.95))).alias("p"))
    at = levels.join(marks, list(keys)).withColumn("voice", F.col("energy") > F.col("p")[0])
    out = at.groupBy(*keys).agg(
        F.avg(F.when(~F.col("voice"), F.col("energy"))).alias("n"), F.avg(F.when(F.col("voice"), F.col("energy"))).alias("s"), F.avg("energy").alias("a"),
        F.avg("zcr").alias("zcr_mean"), F.stddev_pop("zcr").alias("zcr_std"), F.any_value("p").alias("p"),
    )
    noise, speech = F.coalesce("n", "a"), F.coalesce("s", "a")
    return out.select(
        *keys, noise.alias("noise_floor_rms"), speech.alias("speech_rms"),
        (20 * F.log10((speech + 1e-10) / (noise + 1e-10))).alias("snr_estimate_db"), "zcr_mean", "zcr_std",
        (F.col("p")[2] - F.col("p")[1]).alias("energy_dynamic_range"),
    )


def seam_faded(samples: Column, before: Column, after: Column, half: int) -> Column:
    """A file's samples faded at the seams with the files before and after it in a stream (their lengths; null: none), as
    crossfade() does in long form."""
    own, h = F.size(samples), F.lit(half)

    def side(other: Column) -> tuple[Column, Column]:
        a, b = F.least(own, h), F.least(other, h)
        return a + b, F.least(a, b)

    (n0, mid0), (n1, mid1) = side(before), side(after)

    def gain(x: Column, i: Column) -> Column:
        j = i - (own - mid1)
        rise = F.when(before.isNotNull() & (n0 > 1) & (i < mid0), F.try_divide(i.cast("double"), n0 - 1)).otherwise(1.0)
        fall = F.when(after.isNotNull() & (n1 > 1) & (j >= 0), 1.0 - F.try_divide(j.cast("double"), n1 - 1)).otherwise(1.0)
        return (x * rise * fall).cast("float")

    return F.transform(samples, gain)


def joined_windows(files: DataFrame, size: int, half: int = 0, key: str = "location", path: str = "path", samples: str = "samples") -> DataFrame:
    """key, window, samples, source_files, merged: the files of a key one after another by path, cut into windows of size
    samples across their borders; the leftover at the end is dropped. half: samples faded on either side of each seam.

    Files are written to the shared folder first, as decoding them is dear and both their lengths and their samples are
    needed. Only lengths are ordered by key. Each file is cut where it lies into the pieces of the windows that it reaches into;
    pieces meet by window, so a task never holds more of a key than windows. Files without samples take no part;
    source_files are the paths in order; files that share key and path follow one another in any order.
    """
    own = files.where(F.size(samples) > 0).select(F.col(key).alias("__key"), F.col(path).alias("__path"), F.size(samples).alias("__n"), F.col(samples).alias("__x"))
    own = written(own.withColumn("__id", F.monotonically_increasing_id()), "joined-files")
    order = Window.partitionBy("__key").orderBy("__path", "__id")
    lengths = own.select("__key", "__path", "__n", "__id")
    total = F.sum("__n").over(Window.partitionBy("__key"))
    lengths = lengths.select(
        "__id", F.lag("__n").over(order).alias("__before"), F.lead("__n").over(order).alias("__after"), total.alias("__total"),
        F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("__from"),
    )
    at = own.join(lengths, "__id")
    at = at.withColumn("__x", seam_faded(F.col("__x"), F.col("__before"), F.col("__after"), half)) if half else at
    first, last = F.floor(F.col("__from") / size), F.floor((F.col("__from") + F.col("__n") - 1) / size)
    at = at.withColumn("window", F.explode(F.sequence(first, last))).where(F.col("window") < F.floor(F.col("__total") / size))
    start = F.greatest(F.col("window") * size, "__from")
    stop = F.least((F.col("window") + 1) * size, F.col("__from") + F.col("__n"))
    piece = F.struct(start.alias("start"), F.col("__path").alias("path"), F.slice("__x", (start - F.col("__from") + 1).cast("int"), (stop - start).cast("int")).alias("x"))
    out = at.groupBy("__key", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    sources = F.array_distinct(F.transform("p", lambda x: x["path"]))
    return out.select(
        F.col("__key").alias(key), "window", F.flatten(F.transform("p", lambda x: x["x"])).alias("samples"), sources.alias("source_files"),
        (F.size(sources) > 1).alias("merged"),
    )


def joined_sessions(files: DataFrame, session: Column, path: str = "path", samples: str = "samples", least: int = 2) -> DataFrame:
    """session, clips, samples: the clips of sessions with at least so many, joined in order of their paths.

    A row is one session's recording, to be written as one file. Windows over sessions of any length are joined_windows()
    with the session as key.
    """
    by = files.select(session.alias("session"), F.struct(F.col(path).alias("path"), F.col(samples).alias("samples")).alias("s")).groupBy("session").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return by.where(F.size("s") >= least).select("session", F.size("s").alias("clips"), F.flatten(F.transform("s", lambda x: x["samples"])).alias("samples"))
