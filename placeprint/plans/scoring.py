"""Queries over feature vectors: baselines, scores, thresholds, classes, hashes, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeprint.functions import classify, vectors
from placeprint.operators import diagnostics, scoring
from placeprint.plans.registry import register
from placeprint.sources import tables

#: DuckDB: clips, their dimensions, baselines and scores.
FV = "fv AS (SELECT vec_id AS clip_id, 'loc_' || label AS location, embedding::DOUBLE[] AS vector FROM embeddings)"
LONG = f"{FV}, long AS (SELECT clip_id, location, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM fv)"
BASE = (
    f"{LONG}, base AS (SELECT location AS base_location, list(m ORDER BY pos) AS centroid FROM (SELECT location, pos, avg(x) AS m "
    "FROM long GROUP BY ALL) GROUP BY ALL)"
)
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-10)"
SCORES = f"{BASE}, scores AS (SELECT clip_id, location, base_location, {COS.format(a='vector', b='centroid')} AS score FROM fv, base)"
BEST = f"""{SCORES}, ranked AS (SELECT *, row_number() OVER w AS rn, score - lead(score) OVER w AS margin FROM scores WINDOW w AS (PARTITION BY clip_id ORDER BY score DESC, base_location)),
best AS (SELECT clip_id, location, base_location AS best_location, score AS best_score, margin FROM ranked WHERE rn = 1)"""
DRIFT = "CASE WHEN {s} > greatest({a}, {b}) THEN 'STABLE' WHEN {s} > least({a}, {b}) THEN 'MODERATE_DRIFT' ELSE 'RELOCATION_OR_FRAUD' END"
IN_ORDER = "CASE WHEN {s} > {a} THEN 'STABLE' WHEN {s} > {b} THEN 'MODERATE_DRIFT' ELSE 'RELOCATION_OR_FRAUD' END"
CONFIDENCE = f"CASE WHEN margin IS NULL THEN NULL WHEN margin > 0.15 THEN 'HIGH' WHEN margin > 0.05 THEN 'MODERATE' ELSE '{classify.LOW_CONFIDENCE}' END"
W, N = classify.WIDE_BAND, classify.NARROW_BAND


def _clips(spark, sf_dir):
    return tables.feature_vectors(spark, sf_dir)


def _scores(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    return scoring.score(clips, scoring.mean_vectors(clips), "clip_id", "location")


def _best(spark, sf_dir):
    return scoring.best(_scores(spark, sf_dir), "clip_id", "location")


@register(
    "cosine_nearest_location",
    f"WITH {BEST} SELECT clip_id, location, best_location, round(best_score, 6) AS best_score, round(margin, 6) AS margin, "
    f"{DRIFT.format(s='best_score', a=W.stable, b=W.moderate)} AS status, {CONFIDENCE} AS confidence FROM best",
)
def cosine_nearest_location(spark, sf_dir):
    """Every clip's best baseline with class, margin and confidence (flagship)."""
    status = classify.drift_class(F.col("best_score"), W.stable, W.moderate)
    return _best(spark, sf_dir).select(
        "clip_id", "location", "best_location", F.round("best_score", 6).alias("best_score"), F.round("margin", 6).alias("margin"),
        status.alias("status"), classify.confidence(F.col("margin")).alias("confidence"),
    )


@register("global_stats", f"WITH {LONG} SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-8, 6) AS std, count(*) AS n FROM long GROUP BY pos")
def global_stats(spark, sf_dir):
    return scoring.global_stats(_clips(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


STATS = f"{LONG}, stats AS (SELECT pos, avg(x) AS mean, stddev_pop(x) + 1e-8 AS std FROM long GROUP BY pos)"


@register("zscore_clip", f"WITH {STATS} SELECT clip_id, pos, round(greatest(-3, least(3, (x - mean) / std)), 6) AS z FROM long JOIN stats USING (pos)")
def zscore_clip(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    return scoring.long_form(scoring.normalised(clips, scoring.global_stats(clips)), "clip_id").select("clip_id", "pos", F.round("x", 6).alias("z"))


@register("mean_vectors", f"WITH {LONG} SELECT location, pos, round(avg(x), 6) AS mean FROM long GROUP BY ALL")
def mean_vectors(spark, sf_dir):
    return scoring.long_form(scoring.mean_vectors(_clips(spark, sf_dir)), "location").select("location", "pos", F.round("x", 6).alias("mean"))


@register(
    "score_matrix_long",
    f"WITH {SCORES} SELECT clip_id, location AS true_location, base_location AS compared_to, round(score, 6) AS similarity, location = base_location AS is_same_location "
    "FROM scores",
)
def score_matrix_long(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select(
        "clip_id", F.col("location").alias("true_location"), F.col("base_location").alias("compared_to"), F.round("score", 6).alias("similarity"),
        (F.col("location") == F.col("base_location")).alias("is_same_location"),
    )


@register(
    "score_matrix_pivot",
    f"WITH {SCORES} SELECT clip_id, " + ", ".join(f"round(max(score) FILTER (WHERE base_location = 'loc_{i}'), 6) AS loc_{i}" for i in range(10)) + ", arg_max(base_location, score) AS best_location FROM scores GROUP BY clip_id",
)
def score_matrix_pivot(spark, sf_dir):
    names = [f"loc_{i}" for i in range(10)]
    wide = scoring.matrix(_scores(spark, sf_dir), "clip_id", names)
    return wide.select("clip_id", *[F.round(n, 6).alias(n) for n in names], "best_location")


@register(
    "nearest_clip",
    f"""WITH {FV}, pairs AS (SELECT q.clip_id, f.clip_id AS nearest_id, f.location AS nearest_location, {COS.format(a='q.vector', b='f.vector')} AS s FROM fv q, fv f WHERE q.clip_id % 100 = 0 AND q.clip_id <> f.clip_id)
SELECT clip_id, nearest_id, nearest_location, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY s DESC, nearest_id) AS rn FROM pairs) WHERE rn = 1""",
)
def nearest_clip(spark, sf_dir):
    """Every query clip (ids divisible by 100: the stated query set) against all clips."""
    clips = _clips(spark, sf_dir)
    return scoring.nearest(clips, clips.where("clip_id % 100 = 0")).withColumn("similarity", F.round("similarity", 6))


SAME = f"{SCORES}, flagged AS (SELECT *, location = base_location AS same FROM scores)"


def _flagged(spark, sf_dir):
    return scoring.same_and_different(_scores(spark, sf_dir), F.col("location"))


@register(
    "same_diff_stats",
    f"WITH {SAME} SELECT same, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max, round(stddev_pop(score), 6) AS std, count(*) AS n "
    "FROM flagged GROUP BY same",
)
def same_diff_stats(spark, sf_dir):
    return scoring.population_stats(_flagged(spark, sf_dir)).select("same", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "std")], "n")


@register(
    "calibrated_thresholds",
    f"""WITH {SAME}, t AS (SELECT quantile_cont(score, 0.1) FILTER (WHERE same) AS s, quantile_cont(score, 0.9) FILTER (WHERE NOT same) AS m FROM flagged)
SELECT round(s, 6) AS stable_threshold, round(m, 6) AS moderate_threshold, s > m AS valid, false AS manual_override FROM t""",
)
def calibrated_thresholds(spark, sf_dir):
    return scoring.calibrated(_flagged(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("stable_threshold", "moderate_threshold")})


@register(
    "candidate_pairs",
    f"""WITH {SAME}, grid(ordinal, low, high) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(scoring.CANDIDATES))}),
q AS (SELECT [quantile_cont(score, x / 100) FILTER (WHERE same)] AS s FROM flagged, (SELECT 10 AS x) GROUP BY x),
t AS (SELECT """
    + ", ".join(f"quantile_cont(score, {a / 100}) FILTER (WHERE same) AS s{i}, quantile_cont(score, {b / 100}) FILTER (WHERE NOT same) AS m{i}" for i, (a, b) in enumerate(scoring.CANDIDATES))
    + f""" FROM flagged),
rows AS (SELECT ordinal, low, high, CASE ordinal {' '.join(f'WHEN {i} THEN s{i}' for i in range(7))} END AS stable, CASE ordinal {' '.join(f'WHEN {i} THEN m{i}' for i in range(7))} END AS moderate FROM grid, t)
SELECT ordinal, low, high, round(stable, 6) AS stable, round(moderate, 6) AS moderate, stable > moderate AS valid, coalesce(ordinal = min(ordinal) FILTER (WHERE stable > moderate) OVER (), false) AS chosen FROM rows""",
)
def candidate_pairs(spark, sf_dir):
    return scoring.candidate_pairs(_flagged(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("stable", "moderate")})


@register(
    "classify_wide",
    f"WITH {BEST} SELECT clip_id, {DRIFT.format(s='best_score', a=W.stable, b=W.moderate)} AS status, "
    f"{DRIFT.format(s='best_score', a=classify.UNCALIBRATED.stable, b=classify.UNCALIBRATED.moderate)} AS status_uncalibrated "
    "FROM best",
)
def classify_wide(spark, sf_dir):
    u = classify.UNCALIBRATED
    return _best(spark, sf_dir).select(
        "clip_id", classify.drift_class(F.col("best_score"), W.stable, W.moderate).alias("status"),
        classify.drift_class(F.col("best_score"), u.stable, u.moderate).alias("status_uncalibrated"),
    )


@register("classify_narrow", f"WITH {BEST} SELECT clip_id, {IN_ORDER.format(s='best_score', a=N.stable, b=N.moderate)} AS status FROM best")
def classify_narrow(spark, sf_dir):
    return _best(spark, sf_dir).select("clip_id", classify.drift_class_in_order(F.col("best_score")).alias("status"))


@register(
    "classify_four",
    f"WITH {BEST} SELECT clip_id, CASE WHEN best_score >= 0.92 THEN 'Stable Environment' WHEN best_score >= 0.80 THEN 'Minor Drift' WHEN best_score >= 0.65 THEN "
    "'Significant Drift' ELSE 'Relocated / Fraud Suspected' END AS status FROM best",
)
def classify_four(spark, sf_dir):
    return _best(spark, sf_dir).select("clip_id", classify.drift_class_four(F.col("best_score")).alias("status"))


@register("confidence_band", f"WITH {BEST} SELECT clip_id, {CONFIDENCE} AS confidence FROM best")
def confidence_band(spark, sf_dir):
    return _best(spark, sf_dir).select("clip_id", classify.confidence(F.col("margin")).alias("confidence"))


@register(
    "open_set_verdict",
    f"WITH {BEST}, s AS (SELECT *, {DRIFT.format(s='best_score', a=W.stable, b=W.moderate)} AS status FROM best) SELECT clip_id, CASE WHEN status = 'RELOCATION_OR_FRAUD' "
    "THEN 'UNKNOWN_NEW_LOCATION' ELSE best_location END AS verdict, status = 'RELOCATION_OR_FRAUD' AS has_message FROM s",
)
def open_set_verdict(spark, sf_dir):
    b = _best(spark, sf_dir).withColumn("status", classify.drift_class(F.col("best_score"), W.stable, W.moderate))
    message = classify.open_set_message(F.col("status"), F.col("best_location"), F.col("best_score"), F.lit(10))
    return b.select("clip_id", classify.open_set(F.col("status"), F.col("best_location")).alias("verdict"), message.isNotNull().alias("has_message"))


@register(
    "quantize_hash",
    f"""WITH {STATS}, q AS (SELECT clip_id, location, pos, round_even((greatest(-3, least(3, (x - mean) / std)) + 3) / 6 * 255, 0)::INT AS q FROM long JOIN stats USING (pos))
SELECT clip_id, sum(q)::BIGINT AS level_sum, sha256(unhex(string_agg(printf('%02X', q), '' ORDER BY pos)) || encode('device_' || location || '_001') || encode('19723')) AS location_hash FROM q GROUP BY clip_id, location""",
)
def quantize_hash(spark, sf_dir):
    """Double arithmetic, as the SQL twin has it; quantise() itself works in single precision by default."""
    clips = _clips(spark, sf_dir)
    q = scoring.normalised(clips, scoring.global_stats(clips)).withColumn("q", vectors.quantise(F.col("vector"), single=False))
    return q.select(
        "clip_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("level_sum"),
        vectors.location_hash(F.col("q"), vectors.device_id(F.col("location")), F.lit("19723")).alias("location_hash"),
    )


@register(
    "replay_dupes",
    "SELECT user_id, CAST(epoch(ts)::BIGINT // 86400 AS VARCHAR) AS date_bucket, event_type, count(*) AS n FROM events GROUP BY ALL "
    "HAVING count(*) > 1",
)
def replay_dupes(spark, sf_dir):
    """Same device, day and kind of signal more than once: candidates of a replay."""
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy("user_id", vectors.date_bucket_of_second(F.col("ts")).alias("date_bucket"), "event_type").agg(F.count("*").alias("n")).where("n > 1")


@register(
    "predict_record",
    f"""WITH {SCORES}, w AS (SELECT clip_id // 10 AS file, clip_id, base_location, score FROM scores),
top AS (SELECT file, base_location, count(*) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, base_location) AS rn FROM w) WHERE rn = 1 GROUP BY ALL),
m AS (SELECT file, base_location, avg(score) AS score, count(*) AS windows FROM w GROUP BY ALL),
r AS (SELECT m.*, coalesce(votes, 0) AS votes, row_number() OVER k AS rn, m.score - lead(m.score) OVER k AS margin FROM m LEFT JOIN top USING (file, base_location) WINDOW k AS (PARTITION BY file ORDER BY m.score DESC, base_location)),
f AS (SELECT *, {DRIFT.format(s='score', a=W.stable, b=W.moderate)} AS status FROM r WHERE rn = 1)
SELECT file, windows AS num_windows, base_location AS final_match, round(score, 6) AS final_score, status, CASE WHEN status = 'RELOCATION_OR_FRAUD' THEN 'UNKNOWN_NEW_LOCATION' ELSE base_location END AS location_verdict,
round(margin, 6) AS margin, {CONFIDENCE} AS confidence, votes AS match_votes, windows <= 2 AS few_windows FROM f""",
)
def predict_record(spark, sf_dir):
    s = _scores(spark, sf_dir).select(F.floor(F.col("clip_id") / 10).alias("file"), F.col("clip_id").alias("window"), "base_location", "score")
    files = _clips(spark, sf_dir).select(F.floor(F.col("clip_id") / 10).alias("file")).distinct()
    r = scoring.predict_files(s, files, W)
    return r.select(
        "file", "num_windows", "final_match", F.round("final_score", 6).alias("final_score"), "status", "location_verdict",
        F.round("margin", 6).alias("margin"), "confidence", F.element_at("vote_counts", F.col("final_match")).alias("match_votes"), "few_windows",
    )


@register(
    "coef_stats",
    f"""WITH {LONG}, m AS (SELECT *, avg(x) OVER (PARTITION BY location, pos) AS mu FROM long)
SELECT location, pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg(power(x - mu, 3)) / power(stddev_pop(x), 3), 6) AS skew, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90 FROM m GROUP BY location, pos""",
)
def coef_stats(spark, sf_dir):
    return diagnostics.coefficient_stats(scoring.long_form(_clips(spark, sf_dir), "location"), "location", "pos").select(
        "location", "pos", *[F.round(c, 6).alias(c) for c in ("mean", "std", "skew", "p10", "p90")],
    )


FISHER = f"""{LONG}, g AS (SELECT location, pos, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM long GROUP BY ALL),
f AS (SELECT pos, sum(n * power(m - mm, 2)) / (sum(w) + 1e-8) AS fisher FROM (SELECT *, avg(m) OVER (PARTITION BY pos) AS mm FROM g) GROUP BY pos)"""


@register("fisher_scores", f"WITH {FISHER} SELECT pos, round(fisher, 6) AS fisher, round(fisher / ((SELECT max(fisher) FROM f) + 1e-8), 6) AS weight FROM f")
def fisher_scores(spark, sf_dir):
    return diagnostics.fisher_scores(_clips(spark, sf_dir)).select("pos", F.round("fisher", 6).alias("fisher"), F.round("weight", 6).alias("weight"))


@register(
    "top_dims",
    f"WITH {FISHER}, r AS (SELECT pos, round(fisher, 6) AS fisher FROM f) (SELECT pos, fisher, 'top' AS which FROM r ORDER BY fisher DESC, pos LIMIT 10) "
    "UNION ALL (SELECT pos, fisher, 'bottom' FROM r ORDER BY fisher, pos LIMIT 10)",
)
def top_dims(spark, sf_dir):
    """The ten most and least telling dimensions."""
    f = diagnostics.fisher_scores(_clips(spark, sf_dir)).select("pos", F.round("fisher", 6).alias("fisher"))
    return f.orderBy(F.desc("fisher"), "pos").limit(10).withColumn("which", F.lit("top")).unionAll(f.orderBy("fisher", "pos").limit(10).withColumn("which", F.lit("bottom")))


OWN = f"""{SCORES}, own AS (SELECT clip_id, location, score AS own_score FROM scores WHERE location = base_location),
other AS (SELECT clip_id, base_location AS other_location, score AS other_score FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, base_location) AS rn FROM scores WHERE location <> base_location) WHERE rn = 1),
o AS (SELECT * FROM own JOIN other USING (clip_id))"""


@register(
    "own_vs_best_other",
    f"WITH {OWN} SELECT clip_id, location, round(own_score, 6) AS own_score, other_location, round(other_score, 6) AS other_score, own_score < other_score AS wrong "
    "FROM o",
)
def own_vs_best_other(spark, sf_dir):
    return diagnostics.own_and_other(_scores(spark, sf_dir)).select(
        "clip_id", "location", F.round("own_score", 6).alias("own_score"), "other_location", F.round("other_score", 6).alias("other_score"), "wrong",
    )


@register(
    "location_diagnostics",
    f"WITH {OWN} SELECT location, count(*) AS clips, round(avg(own_score), 6) AS mean, round(min(own_score), 6) AS min, round(max(own_score), 6) AS max, "
    "round(max(other_score), 6) AS worst_confusion FROM o GROUP BY location",
)
def location_diagnostics(spark, sf_dir):
    return diagnostics.by_location(diagnostics.own_and_other(_scores(spark, sf_dir))).select(
        "location", "clips", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "worst_confusion")],
    )


@register(
    "diagnose_worst",
    f"WITH {OWN}, r AS (SELECT clip_id, location, round(own_score, 6) AS own_score, other_location, round(other_score, 6) AS other_score "
    "FROM o) (SELECT 'lowest own' AS kind, * FROM r ORDER BY own_score, location, clip_id LIMIT 5) UNION ALL (SELECT 'highest other', * "
    "FROM r ORDER BY other_score DESC, location, clip_id LIMIT 5)",
)
def diagnose_worst(spark, sf_dir):
    """The five clips least like their own location and the five most like another one."""
    r = diagnostics.own_and_other(_scores(spark, sf_dir)).select(
        "clip_id", "location", F.round("own_score", 6).alias("own_score"), "other_location", F.round("other_score", 6).alias("other_score"),
    )
    low = r.orderBy("own_score", "location", "clip_id").limit(5).select(F.lit("lowest own").alias("kind"), "*")
    return low.unionAll(r.orderBy(F.desc("other_score"), "location", "clip_id").limit(5).select(F.lit("highest other").alias("kind"), "*"))


SPECTRUM = f"{LONG}, spec AS (SELECT clip_id, pos * 8000.0 / 63 AS freq, abs(x) + 1e-10 AS s FROM long)"


@register("spectral_flatness", f"WITH {SPECTRUM} SELECT clip_id, round(exp(avg(ln(s))) / avg(s), 6) AS flatness FROM spec GROUP BY clip_id")
def spectral_flatness(spark, sf_dir):
    return diagnostics.spectrum(_clips(spark, sf_dir)).groupBy("clip_id").agg(F.round(F.exp(F.avg(F.ln("s"))) / F.avg("s"), 6).alias("flatness"))


@register("spectral_centroid", f"WITH {SPECTRUM} SELECT clip_id, round(sum(s * freq) / sum(s), 6) AS centroid FROM spec GROUP BY clip_id")
def spectral_centroid(spark, sf_dir):
    return diagnostics.spectrum(_clips(spark, sf_dir)).groupBy("clip_id").agg(F.round(F.sum(F.col("s") * F.col("freq")) / F.sum("s"), 6).alias("centroid"))


@register(
    "band_ratio",
    f"WITH {SPECTRUM} SELECT clip_id, round(coalesce(sum(s * s) FILTER (WHERE freq BETWEEN 300 AND 1000), 0) / sum(s * s), 6) AS ratio "
    "FROM spec GROUP BY clip_id",
)
def band_ratio(spark, sf_dir):
    p = F.col("s") * F.col("s")
    return diagnostics.spectrum(_clips(spark, sf_dir)).groupBy("clip_id").agg(F.round(F.sum(F.when(F.col("freq").between(300, 1000), p).otherwise(0.0)) / F.sum(p), 6).alias("ratio"))


PREDICTED = f"{BEST}, actual AS (SELECT clip_id, location AS actual, best_location AS predicted FROM best)"


def _predicted(spark, sf_dir):
    return _best(spark, sf_dir).select("clip_id", F.col("location").alias("actual"), F.col("best_location").alias("predicted"))


@register("confusion", f"WITH {PREDICTED} SELECT actual, predicted, count(*) AS n FROM actual GROUP BY ALL")
def confusion(spark, sf_dir):
    return diagnostics.confusion(_predicted(spark, sf_dir))


@register(
    "class_report",
    f"""WITH {PREDICTED}, l AS (SELECT DISTINCT actual AS label FROM actual),
c AS (SELECT label, count(*) FILTER (WHERE actual = label AND predicted = label) AS tp, count(*) FILTER (WHERE predicted = label) AS p, count(*) FILTER (WHERE actual = label) AS support FROM actual, l GROUP BY label)
SELECT label, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + support, 0), 0), 6) AS f1, support FROM c""",
)
def class_report(spark, sf_dir):
    return diagnostics.class_report(diagnostics.confusion(_predicted(spark, sf_dir))).select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support",
    )


@register(
    "kappa_mcc",
    f"""WITH {PREDICTED}, c AS (SELECT label, count(*) FILTER (WHERE actual = label) AS t, count(*) FILTER (WHERE predicted = label) AS p FROM actual, (SELECT DISTINCT unnest([actual, predicted]) AS label FROM actual) GROUP BY label),
s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE actual = predicted)::DOUBLE AS ok FROM actual), x AS (SELECT sum(t * p)::DOUBLE AS tp, sum(t * t)::DOUBLE AS tt, sum(p * p)::DOUBLE AS pp FROM c)
SELECT round(ok / n, 6) AS accuracy, round((ok / n - tp / (n * n)) / (1 - tp / (n * n)), 6) AS kappa, round((ok * n - tp) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc FROM s, x""",
)
def kappa_mcc(spark, sf_dir):
    return diagnostics.agreement(diagnostics.confusion(_predicted(spark, sf_dir))).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "kappa", "mcc")])


SOFT = f"{SCORES}, soft AS (SELECT clip_id, location, base_location, exp(10 * score) / sum(exp(10 * score)) OVER (PARTITION BY clip_id) AS p FROM scores)"


@register(
    "logloss_auc",
    f"""WITH {SOFT}, r AS (SELECT *, (rank() OVER w + count(*) OVER (PARTITION BY base_location ORDER BY p RANGE BETWEEN CURRENT ROW AND CURRENT ROW) / 2 - 0.5)::DOUBLE AS rk FROM soft WINDOW w AS (PARTITION BY base_location ORDER BY p)),
a AS (SELECT base_location, sum(rk) FILTER (WHERE location = base_location) AS s, count(*) FILTER (WHERE location = base_location)::DOUBLE AS pos, count(*) FILTER (WHERE location <> base_location)::DOUBLE AS neg FROM r GROUP BY base_location)
SELECT round((SELECT avg(-ln(greatest(p, 1e-15))) FROM soft WHERE location = base_location), 6) AS log_loss, round((SELECT avg((s - pos * (pos + 1) / 2) / (pos * neg)) FROM a), 6) AS auc""",
)
def logloss_auc(spark, sf_dir):
    """Scores as class probabilities: mean -ln p of the truth, and the mean one-vs-rest AUC by rank sums."""
    return diagnostics.log_loss_and_auc(diagnostics.soft_max(_scores(spark, sf_dir))).select(F.round("log_loss", 6).alias("log_loss"), F.round("auc", 6).alias("auc"))


@register(
    "expected_vs_best",
    f"WITH {BEST} SELECT b.clip_id, b.location AS expected_location, best_location, round(best_score, 6) AS best_score, round(s.score, 6) AS expected_score, best_location "
    f"= b.location AS correct_match, {DRIFT.format(s='s.score', a=W.stable, b=W.moderate)} AS expected_status FROM best b JOIN scores s ON s.clip_id = b.clip_id AND "
    "s.base_location = b.location",
)
def expected_vs_best(spark, sf_dir):
    r = diagnostics.expected_and_best(_scores(spark, sf_dir))
    return r.select(
        "clip_id", F.col("location").alias("expected_location"), "best_location", F.round("best_score", 6).alias("best_score"),
        F.round("expected_score", 6).alias("expected_score"), "correct_match",
        classify.drift_class(F.col("expected_score"), W.stable, W.moderate).alias("expected_status"),
    )


@register("accuracy_summary", f"WITH {BEST} SELECT count(*) FILTER (WHERE best_location = location) AS correct, count(*) AS total FROM best")
def accuracy_summary(spark, sf_dir):
    return _best(spark, sf_dir).agg(F.count_if(F.col("best_location") == F.col("location")).alias("correct"), F.count("*").alias("total"))
