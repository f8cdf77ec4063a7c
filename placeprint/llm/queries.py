"""The registered queries opN_<name> over the whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeprint.llm import bpe, grace_dedup, langid, lattice, lm, mixing, sanitise, simhash, token_scan, url_filter

#: The vocabulary of op1: a parameter of the operator, never a file of this repository.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the decoded bytes."""
    out = bpe.bpe_encode(_read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, carry=["doc_id"])
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources: every document of it with its pass and its place in the pass; budgets as its SQL has them."""
    out = mixing.mix(_read(spark, sf_dir, "documents"), mixing.Settings(rounded=True))
    return out.select("doc_id", "source", F.col("mix_ppm").alias("weight_ppm"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block_key"), F.col("mix_key").alias("doc_key"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash of 3-word shingles and the least document that links of at most 2 bits reach."""
    out = simhash.near_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files of word ids."""
    return token_scan.count_tokens(_read(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents outside fold 2 of 4."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out("doc_id", 4).alias("held_out"), "language.lang_pred", "language.score")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from the documents outside fold 2 of 7; weights from fold 3."""
    return lm.score(_read(spark, sf_dir, "documents"), langid.held_out("doc_id", 7), langid.held_out("doc_id", 7, 3))


def op7_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts and whether it stays."""
    return grace_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "llr")


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.93 or more within its label, and its component."""
    return lattice.near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data and disclosing terms, what is done about the terms, and the digest of the text that
    is left."""
    out = sanitise.find_private(_read(spark, sf_dir, "documents"))
    counts = [F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(sanitise.KINDS)]
    done = [F.size(F.filter("spans.action", lambda x: x == action)).cast("long").alias(f"n_{action}d") for action in ("generalise", "remove")]
    clean = F.coalesce(F.sha2(sanitise.redact()("whole", "spans"), 256), "sha")
    return out.select("doc_id", *counts, "base_sha256", sanitise.span_text(F.col("spans")).alias("spans"), *done, clean.alias("clean_sha256"))


_OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(row_number() OVER (g ORDER BY doc_id DESC) = 1, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP2_SQL = f"""
WITH RECURSIVE lean AS (
  SELECT doc_id, source, coalesce(source, '') AS s, coalesce(doc_id::VARCHAR, '') AS d, {_WORDS} AS t,
         substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS b FROM documents),
totals AS (SELECT source, s, sum(t)::HUGEINT AS t FROM lean GROUP BY ALL HAVING sum(t) > 0),
every AS (SELECT list(t / (SELECT sum(t) FROM totals) ORDER BY source NULLS FIRST) AS p, sum(t) AS budget, count(*) AS k, min(t) AS smallest FROM totals),
halves(i, lo, hi, p, k) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, p, k FROM every
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, p, k FROM (
    SELECT *, -list_sum(list_transform(w, lambda x: x * ln(x))) >= 0.95 * ln(k) AS ok FROM (
      SELECT *, list_transform(p, lambda x: pow(x, mid) / list_sum(list_transform(p, lambda y: pow(y, mid)))) AS w FROM (
        SELECT *, (lo + hi) / 2 AS mid FROM halves WHERE i < 60)))),
flat AS (SELECT -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.95 * ln(k) OR k = 1 AS plain FROM every),
by_entropy AS (SELECT CASE WHEN plain THEN 1.0::DOUBLE ELSE lo END AS a0 FROM halves, flat WHERE i = 60),
raised(i, lo, hi, p) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, p FROM every
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, p FROM (
    SELECT *, pow(list_min(p), 1 - mid) / list_sum(list_transform(p, lambda y: pow(y, 1 - mid))) / list_min(p) <= 4 AS ok FROM (
      SELECT *, (lo + hi) / 2 AS mid FROM raised WHERE i < 60))),
fits AS (SELECT a0, pow(list_min(p), a0) / list_sum(list_transform(p, lambda y: pow(y, a0))) / list_min(p) <= 4 AS ok,
                1 / len(p) / list_min(p) <= 4 AS all_fit FROM by_entropy, every),
chosen AS (SELECT CASE WHEN ok THEN a0 WHEN all_fit THEN 0 ELSE 1 - lo END AS a FROM fits, raised WHERE i = 60),
ppm AS (SELECT source, s, totals.t, floor(pow(totals.t / budget, a) / list_sum(list_transform(p, lambda y: pow(y, a))) * 1e6 + 0.5)::HUGEINT AS ppm, budget FROM totals, every, chosen),
plan AS (SELECT source, s, ppm, least(ppm * budget // 1000000, 4 * t) // t AS passes, least(ppm * budget // 1000000, 4 * t) % t AS rest FROM ppm
         UNION ALL SELECT DISTINCT source, s, 0, 1, 0 FROM lean WHERE NOT EXISTS (SELECT 1 FROM totals WHERE totals.source IS NOT DISTINCT FROM lean.source)),
blocks AS (SELECT plan.source, lean.b, plan.rest, plan.passes, md5('mix|' || plan.s || '|' || plan.passes || '|' || lean.b) AS p, sum(lean.t) AS t
           FROM lean JOIN plan ON plan.source IS NOT DISTINCT FROM lean.source WHERE rest > 0 GROUP BY ALL),
upto AS (SELECT *, sum(t) OVER (PARTITION BY source ORDER BY p) AS upto FROM blocks),
ends AS (SELECT source, min(p) AS p, arg_min(b, p) AS b, arg_min(rest - upto + t, p) AS rest_in, any_value(passes) AS passes FROM upto WHERE upto > rest AND upto - t <= rest GROUP BY source),
inside AS (SELECT ends.source, lean.t, rest_in, md5('mix|' || passes || '|' || d) AS k FROM lean JOIN ends ON ends.source IS NOT DISTINCT FROM lean.source AND ends.b = lean.b),
summed AS (SELECT source, rest_in, k, sum(t) OVER (PARTITION BY source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM inside),
cuts AS (SELECT ends.source, ends.p, coalesce((SELECT max(k) FROM summed WHERE summed.source IS NOT DISTINCT FROM ends.source AND upto <= rest_in), '') AS k FROM ends),
keyed AS (SELECT lean.*, plan.ppm, plan.passes, cuts.p, cuts.k, md5('mix|' || lean.s || '|' || plan.passes || '|' || lean.b) AS own, md5('mix|' || plan.passes || '|' || lean.d) AS own_k
          FROM lean JOIN plan ON plan.source IS NOT DISTINCT FROM lean.source LEFT JOIN cuts ON cuts.source IS NOT DISTINCT FROM lean.source),
copies AS (SELECT *, unnest(range(0, (passes + CASE WHEN own < p OR own = p AND own_k <= k THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM keyed)
SELECT doc_id, source, ppm::BIGINT AS weight_ppm, epoch, md5('mix|' || s || '|' || epoch || '|' || b) AS block_key, md5('mix|' || epoch || '|' || d) AS doc_key FROM copies
"""

_OP4_SQL = f"SELECT doc_id, {_WORDS}::BIGINT AS n_tokens FROM documents"

_OP9_SQL = """
WITH RECURSIVE own AS (SELECT row_number() OVER () AS r, vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings),
fit AS (SELECT r, vec_id, label, len(v) AS dim, v, sqrt(list_dot_product(v, v)) AS size FROM own
        WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r
         WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
cc(r, least) USING KEY (r) AS (SELECT r, vec_id FROM own
  UNION SELECT near.a, min(cc.least) FROM cc JOIN near ON near.b = cc.r JOIN recurring.cc AS old ON old.r = near.a WHERE cc.least < old.least GROUP BY near.a)
SELECT own.vec_id, (SELECT count(*) FROM near WHERE near.a = own.r)::BIGINT AS n_links, cc.least AS component_id, coalesce(own.vec_id = cc.least, false) AS kept
FROM own JOIN cc USING (r)
"""

_QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_token_scan": op4_token_scan,
    "op5_langid": op5_langid,
    "op6_lm": op6_lm,
    "op7_grace_dedup": op7_grace_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_lattice": op9_lattice,
    "op10_sanitise": op10_sanitise,
}
_SQL: dict[str, str] = {"op2_mixing": _OP2_SQL, "op4_token_scan": _OP4_SQL, "op7_grace_dedup": _OP7_SQL, "op9_lattice": _OP9_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
