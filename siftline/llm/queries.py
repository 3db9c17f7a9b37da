"""Queries of the operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, clusters, decontam, exact_dedup, languages, licenses, lm, packing, pii, quality, repair, secrets, simhash

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(_table(spark, sf_dir, "documents"), end=2)


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"))


def op5_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), end=1, with_ids=False).drop("ids")


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op8_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op9_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_hadamard_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_output_code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify_documents(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_repair_token_files,
    op2_bootstrapped_pii,
    op3_winnowing_decontamination,
    op4_entropy_secrets,
    op5_quadratic_quality,
    op6_ffd_packing,
    op7_license_digests,
    op8_perfect_hash_dedup,
    op9_ball_simhash,
    op10_bloom_lm,
    op11_hadamard_filter_audit,
    op12_partial_distance_clusters,
    op13_output_code_languages,
)

#: Lower-casing of A-Z only, as an argument of DuckDB's translate.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP8_SQL = f"""WITH own AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM own WINDOW g AS (PARTITION BY text_sha256)"""

OP3_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


OP11_SQL = r"""WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM base),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat_ws('', CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first_id THEN 'E' END) AS failed
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1 : step - 1] AS earlier FROM o, range(1, 6) r(step)),
m AS (SELECT part, s.filter_order, step, n, good, toxic, failed, contains(failed, own) AS fails, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND failed <> '' AS before FROM c, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT before), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT before), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND before), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND failed = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fails AND NOT before), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT before), 0) AS BIGINT) AS toxic_lost
  FROM (SELECT m.*, s.own FROM m JOIN s USING (filter_order, step)) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op3_winnowing_decontamination": OP3_SQL.replace("\\\\", "\\"), "op7_license_digests": licenses.sql(), "op8_perfect_hash_dedup": OP8_SQL, "op11_hadamard_filter_audit": OP11_SQL, "op12_partial_distance_clusters": clusters.sql()}
