"""Queries over signals: the events of a user are its samples, a day is a file."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeprint.operators import scoring, windows
from placeprint.plans.registry import register
from placeprint.sources import tables

SIZE, HALF, FRAME, HOP = 16, 8, 5, 2
SIG = (
    "sig AS (SELECT user_id AS stream, strftime(ts, '%Y-%m-%d') AS file, event_id, ts, value AS sample, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts, event_id) - 1 AS pos FROM events)"
)
CEN = f"{SIG}, cen AS (SELECT * REPLACE (sample - avg(sample) OVER (PARTITION BY stream) AS sample) FROM sig)"
FILES = (
    f"{SIG}, fs AS (SELECT *, row_number() OVER (PARTITION BY stream, file ORDER BY ts, event_id) - 1 AS file_pos FROM sig), offs AS (SELECT stream, file, length, "
    "coalesce(sum(length) OVER (PARTITION BY stream ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, lag(length) OVER (PARTITION BY stream "
    "ORDER BY file) AS prev, lead(length) OVER (PARTITION BY stream ORDER BY file) AS nxt FROM (SELECT stream, file, count(*) AS length "
    "FROM fs GROUP BY ALL))"
)


def _signal(spark, sf_dir):
    return tables.signal(spark, sf_dir)


def _in_files(spark, sf_dir):
    order = Window.partitionBy("stream", "file").orderBy("ts", "event_id")
    return _signal(spark, sf_dir).withColumn("file_pos", (F.row_number().over(order) - 1).cast("long"))


@register(
    "tumbling_windows",
    f"WITH {SIG} SELECT stream, pos // {SIZE} AS window, count(*) AS n, round(sum(sample), 4) AS total FROM sig GROUP BY ALL HAVING count(*) = {SIZE}",
)
def tumbling_windows(spark, sf_dir):
    w = windows.tumbling(_signal(spark, sf_dir), SIZE)
    return w.groupBy("stream", "window").agg(F.count("*").alias("n"), F.round(F.sum("sample"), 4).alias("total"))


@register(
    "short_file_windows",
    f"WITH {SIG}, l AS (SELECT *, count(*) OVER (PARTITION BY stream) AS len FROM sig) SELECT stream, pos // 64 AS window, count(*) AS n "
    "FROM l GROUP BY stream, pos // 64, len HAVING count(*) = 64 OR len < 64",
)
def short_file_windows(spark, sf_dir):
    """Windows of 64; a stream shorter than that is one window as it is."""
    return windows.tumbling(_signal(spark, sf_dir), 64, short_files="whole").groupBy("stream", "window").agg(F.count("*").alias("n"))


@register("segments_with_tail", f"WITH {SIG} SELECT stream, pos // {SIZE} AS segment, count(*) AS n, count(*) < {SIZE} AS short FROM sig GROUP BY ALL")
def segments_with_tail(spark, sf_dir):
    w = windows.tumbling(_signal(spark, sf_dir), SIZE, keep_tail=True)
    return w.groupBy("stream", F.col("window").alias("segment")).agg(F.count("*").alias("n"), (F.count("*") < SIZE).alias("short"))


@register(
    "merged_windows_lineage",
    f"""WITH {FILES}, g AS (SELECT stream, file, off + file_pos AS gpos, (off + file_pos) // {SIZE} AS "window" FROM fs JOIN offs USING (stream, file))
SELECT stream, "window"::BIGINT AS "window", string_agg(DISTINCT file, '+' ORDER BY file) AS source_files, count(DISTINCT file) > 1 AS merged, count(*) AS n FROM g GROUP BY stream, "window" HAVING count(*) = {SIZE}""",
)
def merged_windows_lineage(spark, sf_dir):
    """Windows across file borders with the files they draw on."""
    m = windows.merged(_in_files(spark, sf_dir), SIZE)
    n = m.groupBy("stream", "window").agg(F.count("*").alias("n"))
    return windows.lineage(m).join(n, ["stream", "window"]).select("stream", "window", F.array_join("source_files", "+").alias("source_files"), "merged", "n")


@register("file_offsets", f"WITH {FILES} SELECT stream, file, length, off::BIGINT AS \"offset\" FROM offs")
def file_offsets(spark, sf_dir):
    return windows.file_offsets(_signal(spark, sf_dir))


@register("preemphasis", f"WITH {SIG} SELECT event_id, round(sample - 0.97 * coalesce(lag(sample) OVER (PARTITION BY stream ORDER BY pos), 0), 6) AS y FROM sig")
def preemphasis(spark, sf_dir):
    return windows.pre_emphasis(_signal(spark, sf_dir), "stream").select("event_id", F.round("sample", 6).alias("y"))


@register("dc_peak_normalise", f"WITH {CEN} SELECT event_id, round(sample / (max(abs(sample)) OVER (PARTITION BY stream) + 1e-8), 6) AS y FROM cen")
def dc_peak_normalise(spark, sf_dir):
    return windows.peak_normalised(windows.without_mean(_signal(spark, sf_dir), "stream"), "stream").select("event_id", F.round("sample", 6).alias("y"))


@register(
    "ingest_peak_normalise",
    f"WITH {SIG}, p AS (SELECT *, max(abs(sample)) OVER (PARTITION BY stream, file) AS peak FROM sig) SELECT event_id, round(CASE WHEN peak < 1e-6 THEN sample ELSE sample "
    "* (0.95 / peak) END, 6) AS y FROM p",
)
def ingest_peak_normalise(spark, sf_dir):
    return windows.ingest_normalised(_signal(spark, sf_dir), "stream", "file").select("event_id", F.round("sample", 6).alias("y"))


@register(
    "seam_crossfade",
    f"""WITH {FILES}, c AS (SELECT event_id, sample, file_pos, length, prev, nxt, least(length, {HALF}) + least(prev, {HALF}) AS n0, least(length, least(prev, {HALF})) AS m0, least(length, {HALF}) + least(nxt, {HALF}) AS n1, least(length, least(nxt, {HALF})) AS m1 FROM fs JOIN offs USING (stream, file))
SELECT event_id, round(sample * CASE WHEN prev IS NOT NULL AND n0 > 1 AND file_pos < m0 THEN file_pos / (n0 - 1) ELSE 1.0::DOUBLE END
  * CASE WHEN nxt IS NOT NULL AND n1 > 1 AND file_pos - (length - m1) >= 0 THEN 1.0::DOUBLE - (file_pos - (length - m1)) / (n1 - 1) ELSE 1.0::DOUBLE END, 6) AS y FROM c""",
)
def seam_crossfade(spark, sf_dir):
    return windows.crossfade(_in_files(spark, sf_dir), HALF).select("event_id", F.round("sample", 6).alias("y"))


LOUD = f"{SIG}, l AS (SELECT stream, pos // {SIZE} AS \"window\", sqrt(avg(power(sample / 1000, 2))) AS rms, max(abs(sample / 1000)) AS peak, avg((abs(sample / 1000) < {{level}})::INT) AS quiet FROM sig GROUP BY ALL HAVING count(*) = {SIZE})"


def _scaled(spark, sf_dir):
    return windows.tumbling(_signal(spark, sf_dir).withColumn("sample", F.col("sample") / 1000), SIZE)


@register("loudness_probe", f"WITH {LOUD.format(level=0.004)} SELECT stream, \"window\", round(rms, 6) AS rms, round(peak, 6) AS peak, round(quiet, 6) AS quiet FROM l")
def loudness_probe(spark, sf_dir):
    l = windows.loudness(_scaled(spark, sf_dir), "stream", "window")
    return l.select("stream", "window", *[F.round(c, 6).alias(c) for c in ("rms", "peak", "quiet")])


@register("silence_filter_wide", f"WITH {LOUD.format(level=0.004)} SELECT stream, \"window\", round(rms, 6) AS rms FROM l WHERE NOT (rms < 0.0015 OR quiet > 0.92)")
def silence_filter_wide(spark, sf_dir):
    return windows.audible(_scaled(spark, sf_dir), "stream", "window").select("stream", "window", F.round("rms", 6).alias("rms"))


@register("silence_filter_environment", f"WITH {LOUD.format(level=0.01)} SELECT stream, \"window\", round(quiet, 6) AS quiet FROM l WHERE quiet <= 0.7")
def silence_filter_environment(spark, sf_dir):
    return windows.audible(_scaled(spark, sf_dir), "stream", "window", profile=windows.ENVIRONMENT).select("stream", "window", F.round("quiet", 6).alias("quiet"))


FRAMES = f"""{CEN}, len AS (SELECT stream, count(*) AS n FROM cen GROUP BY stream), f AS (SELECT stream, unnest(range(0, 1 + greatest((n - {FRAME}) // {HOP}, 0))) AS frame FROM len),
fr AS (SELECT f.stream, f.frame, c.pos - f.frame * {HOP} AS fpos, c.sample FROM f JOIN cen c ON c.stream = f.stream AND c.pos >= f.frame * {HOP} AND c.pos < f.frame * {HOP} + {FRAME}),
ch AS (SELECT *, abs(CASE WHEN sample >= 0 THEN 1 ELSE -1 END - lag(CASE WHEN sample >= 0 THEN 1 ELSE -1 END) OVER (PARTITION BY stream, frame ORDER BY fpos)) AS c FROM fr),
lev AS (SELECT stream, frame, sqrt(sum(sample * sample) / {FRAME} + 1e-10) AS energy, avg(c) / 2 AS zcr FROM ch GROUP BY ALL)"""


def _levels(spark, sf_dir):
    return windows.frame_levels(windows.frames(tables.centred(_signal(spark, sf_dir)), FRAME, HOP, "stream"), FRAME, "stream")


@register("frame_levels", f"WITH {FRAMES} SELECT stream, frame, round(energy, 6) AS energy, round(zcr, 6) AS zcr FROM lev")
def frame_levels(spark, sf_dir):
    return _levels(spark, sf_dir).select("stream", "frame", F.round("energy", 6).alias("energy"), F.round("zcr", 6).alias("zcr"))


@register(
    "frame_features",
    f"""WITH {FRAMES}, p AS (SELECT stream, quantile_cont(energy, 0.6) AS p60, quantile_cont(energy, 0.05) AS p5, quantile_cont(energy, 0.95) AS p95 FROM lev GROUP BY stream),
a AS (SELECT stream, coalesce(avg(energy) FILTER (WHERE energy <= p60), avg(energy)) AS n, coalesce(avg(energy) FILTER (WHERE energy > p60), avg(energy)) AS s, avg(zcr) AS zm, stddev_pop(zcr) AS zs, any_value(p95 - p5) AS r FROM lev JOIN p USING (stream) GROUP BY stream)
SELECT stream, round(n, 6) AS noise_floor_rms, round(s, 6) AS speech_rms, round(20 * log10((s + 1e-10) / (n + 1e-10)), 6) AS snr_estimate_db, round(zm, 6) AS zcr_mean, round(zs, 6) AS zcr_std, round(r, 6) AS energy_dynamic_range FROM a""",
)
def frame_features(spark, sf_dir):
    v = windows.voice_split(_levels(spark, sf_dir), "stream")
    return v.select("stream", *[F.round(c, 6).alias(c) for c in v.columns[1:]])


ENV = (
    f"{SIG}, lab AS (SELECT event_id, stream, CASE event_type WHEN 'view' THEN 'quiet' WHEN 'purchase' THEN 'noisy' ELSE 'moderate' END AS label, CASE event_type WHEN "
    "'view' THEN value / 10 WHEN 'purchase' THEN value + 200 ELSE value END AS level FROM events JOIN sig USING (event_id))"
)


def _levels_by_label(spark, sf_dir):
    kind = F.col("event_type")
    label = F.when(kind == "view", "quiet").when(kind == "purchase", "noisy").otherwise("moderate")
    level = F.when(kind == "view", F.col("value") / 10).when(kind == "purchase", F.col("value") + 200).otherwise(F.col("value"))
    return tables.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream"), "ts", label.alias("label"), level.alias("level"))


@register(
    "env_thresholds",
    f"WITH {ENV} SELECT round(quantile_cont(level, 0.9) FILTER (WHERE label = 'quiet'), 6) AS quiet_threshold, round(quantile_cont(level, 0.1) FILTER (WHERE label = "
    "'noisy'), 6) AS noisy_threshold FROM lab",
)
def env_thresholds(spark, sf_dir):
    return scoring.environment_thresholds(_levels_by_label(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("quiet_threshold", "noisy_threshold")])


RULE = "CASE WHEN level <= q THEN 'quiet' WHEN level >= n THEN 'noisy' ELSE 'moderate' END"
RULED = (
    f"{ENV}, t AS (SELECT quantile_cont(level, 0.9) FILTER (WHERE label = 'quiet') AS q, quantile_cont(level, 0.1) FILTER (WHERE label = 'noisy') AS n "
    f"FROM lab), ruled AS (SELECT event_id, stream, {RULE} AS cls FROM lab, t)"
)


def _ruled(spark, sf_dir):
    from placeprint.functions import classify

    levels = _levels_by_label(spark, sf_dir)
    t = scoring.environment_thresholds(levels)
    return levels.crossJoin(F.broadcast(t)).withColumn("cls", classify.environment_rule(F.col("level"), F.col("quiet_threshold"), F.col("noisy_threshold")))


@register("rule_classify", f"WITH {RULED} SELECT event_id, cls FROM ruled")
def rule_classify(spark, sf_dir):
    return _ruled(spark, sf_dir).select("event_id", "cls")


@register(
    "majority_vote",
    f"""WITH {RULED}, v AS (SELECT stream, cls, count(*) AS votes, min(pos) AS first_pos FROM ruled JOIN sig USING (event_id, stream) GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY stream) AS n, row_number() OVER (PARTITION BY stream ORDER BY votes DESC, first_pos) AS rn FROM v)
SELECT stream, cls AS majority, votes, round_even(votes / n, 3) AS agreement FROM r WHERE rn = 1""",
)
def majority_vote(spark, sf_dir):
    """A stream's most frequent class; ties go to the one seen first."""
    at = F.struct("ts", "event_id")
    v = _ruled(spark, sf_dir).groupBy("stream", "cls").agg(F.count("*").alias("votes"), F.min(at).alias("first"))
    top = v.groupBy("stream").agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", "cls")).alias("m"), F.sum("votes").alias("n"))
    return top.select("stream", F.col("m.cls").alias("majority"), (-F.col("m.v")).alias("votes"), F.bround(-F.col("m.v") / F.col("n"), 3).alias("agreement"))


@register(
    "class_shares",
    f"WITH {RULED} SELECT stream, cls, round_even(count(*) / sum(count(*)) OVER (PARTITION BY stream), 3) AS share FROM ruled GROUP BY stream, cls",
)
def class_shares(spark, sf_dir):
    """Mean probability of each class over a stream's windows, three places half to even."""
    c = _ruled(spark, sf_dir).groupBy("stream", "cls").agg(F.count("*").alias("c"))
    n = c.groupBy("stream").agg(F.sum("c").alias("n"))
    return c.join(n, "stream").select("stream", "cls", F.bround(F.col("c") / F.col("n"), 3).alias("share"))


@register(
    "ema_baseline",
    f"""WITH RECURSIVE {SIG}, e(stream, pos, m) AS (SELECT stream, pos, sample FROM sig WHERE pos = 0 UNION ALL SELECT s.stream, s.pos, 0.95 * e.m + 0.05 * s.sample FROM e JOIN sig s ON s.stream = e.stream AND s.pos = e.pos + 1)
SELECT stream, max(pos) + 1 AS n, round(arg_max(m, pos), 6) AS baseline FROM e GROUP BY stream""",
)
def ema_baseline(spark, sf_dir):
    """The baseline of each stream after all its samples in order, each weighing 0.05.

    In closed form: a sample k steps before the last weighs 0.05 * 0.95^k, the first one 0.95^(n-1). So the fold over an
    ordered stream is a plain sum with partial aggregation.
    """
    s = _signal(spark, sf_dir)
    n = s.groupBy("stream").agg(F.count("*").alias("n"))
    w = F.when(F.col("pos") == 0, F.pow(F.lit(0.95), F.col("n") - 1)).otherwise(0.05 * F.pow(F.lit(0.95), F.col("n") - 1 - F.col("pos")))
    return s.join(n, "stream").groupBy("stream", "n").agg(F.round(F.sum(w * F.col("sample")), 6).alias("baseline")).select("stream", "n", "baseline")
