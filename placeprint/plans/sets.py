"""Queries over ledgers, splits, groups, profiles: customers, orders, parts and documents play the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeprint.functions import paths
from placeprint.operators import diagnostics, graph, sets
from placeprint.plans.registry import register
from placeprint.sources import sinks, tables


def _t(spark, sf_dir, name):
    return tables.table(spark, sf_dir, name)


@register("ledger_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def ledger_anti(spark, sf_dir):
    """Customers (files) that no order (the ledger) names."""
    return sets.unseen(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@register("ledger_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def ledger_difference(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey").subtract(_t(spark, sf_dir, "orders").select("o_custkey"))


@register(
    "path_exclusion",
    "SELECT p_partkey FROM part WHERE NOT list_contains(string_split(replace(p_name, ' ', '/'), '/'), 'blue') AND NOT list_contains(string_split(replace(p_name, ' ', "
    "'/'), '/'), 'green')",
)
def path_exclusion(spark, sf_dir):
    """Parts (paths) without the words (folders) blue and green."""
    p = _t(spark, sf_dir, "part").withColumn("path", F.replace("p_name", F.lit(" "), F.lit("/")))
    return sets.without_folders(p, "blue", "green").select("p_partkey")


@register(
    "leakage_semi",
    "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text "
    "HAVING count(*) > 1))",
)
def leakage_semi(spark, sf_dir):
    """Labelled (held-out) documents whose content occurs again among the documents (training clips)."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"))
    again = docs.groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    provenance = docs.join(again, "m", "left_semi").select(F.array(F.format_string("clips/%d", "doc_id")).alias("source_files"))
    split = _t(spark, sf_dir, "labels").select("doc_id", F.format_string("clips\\%d", "doc_id").alias("path"))
    return sets.leaked(split, provenance).select("doc_id")


@register(
    "missing_baseline",
    "SELECT n_name AS location, count(*) AS files FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL) "
    "GROUP BY n_name",
)
def missing_baseline(spark, sf_dir):
    """Nations (locations) without a supplier (baseline)."""
    files = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("location"), "n_nationkey")
    known = _t(spark, sf_dir, "supplier").join(files, F.col("s_nationkey") == F.col("n_nationkey")).select("location").distinct()
    return sets.without_baseline(files, known).groupBy("location").agg(F.count("*").alias("files"))


@register(
    "upsert_latest",
    "SELECT o_custkey AS key, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def upsert_latest(spark, sf_dir):
    """Ledger by customer: the statuses before 1997, then the later ones over them."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    last = lambda d: d.groupBy("key").agg(F.max_by("status", "at").alias("status"))
    late = F.col("at.o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return sinks.upserted(last(o.where(~late)), last(o.where(late)), "key")


@register(
    "latest_run",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS run_id FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate::DATE) "
    "FROM orders)",
)
def latest_run(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_id"))
    return sinks.latest_run(o)


@register("union_formats", "SELECT 'customer' AS format, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def union_formats(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("format"), F.col("c_custkey").alias("id"))
    return a.unionByName(_t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("format"), F.col("s_suppkey").alias("id")))


@register("ledger_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def ledger_union(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.unionByName(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


@register("overlap_guard", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def overlap_guard(spark, sf_dir):
    return sets.overlap(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@register("distinct_sources", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("source").distinct()


_HOLD = """WITH g AS (SELECT {key} AS k, {label} AS l, sha256('42|' || {key}::VARCHAR) AS d FROM {table}),
r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, k) AS rn, count(*) OVER (PARTITION BY l) AS n FROM g)"""


@register("holdout_split", _HOLD.format(key="doc_id", label="lang", table="documents") + " SELECT k AS doc_id, l AS lang, rn <= greatest(1, round_even(0.2 * n, 0)) AS held_out FROM r")
def holdout_split(spark, sf_dir):
    return sets.holdout(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "held_out")


@register("stratified_split", _HOLD.format(key="doc_id", label="quality", table="labels") + " SELECT k AS doc_id, l AS quality, rn <= greatest(1, round_even(0.2 * n, 0)) AS held_out FROM r")
def stratified_split(spark, sf_dir):
    return sets.holdout(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id").select("doc_id", "quality", "held_out")


@register(
    "grouped_split",
    """WITH gr AS (SELECT source, min(lang) AS lang FROM documents GROUP BY source), g AS (SELECT source AS k, lang AS l, sha256('42|' || source) AS d FROM gr),
r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, k) AS rn, count(*) OVER (PARTITION BY l) AS n FROM g)
SELECT doc_id, source, rn <= greatest(1, round_even(0.25 * n, 0)) AS fold_test FROM documents JOIN r ON k = source""",
)
def grouped_split(spark, sf_dir):
    """Sources are never on both sides."""
    return sets.grouped_split(_t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "lang", "source").select("doc_id", "source", "fold_test")


@register("groups_per_class", "SELECT lang, count(DISTINCT source) AS n_groups, count(DISTINCT source) < 2 AS too_few FROM documents GROUP BY lang")
def groups_per_class(spark, sf_dir):
    return sets.groups_per_class(_t(spark, sf_dir, "documents"), "lang", "source")


@register("duplicates_md5", "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicates_md5(spark, sf_dir):
    return diagnostics.duplicate_groups(_t(spark, sf_dir, "documents"), F.col("text").cast("binary"), "doc_id")


@register(
    "connected_components",
    """WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS member, l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS c FROM lineitem),
firsts AS (SELECT c, min(member) AS f FROM m GROUP BY c), e AS (SELECT DISTINCT member AS a, f AS b FROM m JOIN firsts USING (c) WHERE member <> f),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, root) USING KEY (node) AS (SELECT DISTINCT member, member FROM m
  UNION SELECT x.a, min(cc.root) FROM cc JOIN both_ways x ON x.b = cc.node JOIN recurring.cc AS old ON old.node = x.a WHERE cc.root < old.root GROUP BY x.a)
SELECT node AS member, root AS "group" FROM cc""",
)
def connected_components(spark, sf_dir):
    """Customers that are linked by parts of their orders, over all line items; node = order, group = least order."""
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("member"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return graph.groups_of(items.select("member", F.concat_ws("-", "p", "s").alias("container")), "member", "container")


@register(
    "profile",
    "SELECT 'l_quantity' AS \"column\", count(l_quantity) AS n, count(*) - count(l_quantity) AS nulls, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem "
    "UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), count(*) - count(l_extendedprice), round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4), min(l_extendedprice), max(l_extendedprice) FROM lineitem "
    "UNION ALL SELECT 'l_discount', count(l_discount), count(*) - count(l_discount), round(avg(l_discount), 4), round(stddev_samp(l_discount), 4), min(l_discount), max(l_discount) FROM lineitem",
)
def profile(spark, sf_dir):
    p = diagnostics.profile(_t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))
    return p.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@register("duplicate_rows", "SELECT (count(*) - count(DISTINCT (l_partkey, l_suppkey, l_quantity)))::BIGINT AS duplicate_rows FROM lineitem")
def duplicate_rows(spark, sf_dir):
    return diagnostics.duplicate_rows(_t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"))


@register(
    "histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT i::INT AS bin, round(lo + (hi - lo) / 30 * i, 4) AS low, round(lo + (hi - lo) / 30 * (i + 1), 4) AS high, coalesce(n, 0) AS n FROM e, range(30) t(i) LEFT JOIN b ON bin = i""",
)
def histogram(spark, sf_dir):
    h = diagnostics.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice")
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


_C = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(corr({min(a, b)}, {max(a, b)}), 6)") + " AS r FROM " + ("(SELECT 1)" if a == b else "lineitem") for a in _C for b in _C))
def corr_matrix(spark, sf_dir):
    return diagnostics.correlations(_t(spark, sf_dir, "lineitem"), list(_C)).withColumn("r", F.round("r", 6))


@register("label_encode", "SELECT p_type AS label, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)")
def label_encode(spark, sf_dir):
    return diagnostics.label_codes(_t(spark, sf_dir, "part").select(F.col("p_type").alias("label")), "label").withColumn("code", F.col("code").cast("long"))


@register("recordings_per_location", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def recordings_per_location(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@register(
    "session_prefix_merge",
    "SELECT regexp_replace(c_name, '[0-9_]+$', '') AS session, count(*) AS clips, md5(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_name)) AS joined FROM customer GROUP BY 1 HAVING count(*) >= 2",
)
def session_prefix_merge(spark, sf_dir):
    """Names without trailing digits are sessions; their clips are joined in order of name."""
    from placeprint.operators import windows

    c = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.array("c_custkey").alias("samples"))
    j = windows.joined_sessions(c, paths.session_prefix(F.col("path")))
    return j.select("session", F.col("clips").cast("long").alias("clips"), F.md5(F.array_join("samples", ",")).alias("joined"))
