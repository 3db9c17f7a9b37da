"""Verdict files and the semantic gate, which fails closed: what was not judged does not pass.

``files`` has run_id, file_no and payload: a JSON array of {claimId, sourceId, verdict, note}, or an object with such
an array in ``pairs`` or ``verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grounding import SEVERITY, check, claim_pairs, reduce_verdicts, worklists

DEPTH_ORDER = ("summary", "standard", "deep")


def _text(item: str, name: str) -> Column:
    """A member that is a JSON string; null for other values."""
    return F.when(F.col(item).rlike(rf'"{name}"\s*:\s*"'), F.get_json_object(item, f"$.{name}"))


def read_verdict_files(files: DataFrame) -> DataFrame:
    """run_id, file_no, place, claim_id, source_id, verdict, note of each usable row; a verdict of another kind is null."""
    body = F.trim("payload")
    rows = F.when(body.startswith("["), body).otherwise(F.coalesce(F.get_json_object(body, "$.pairs"), F.get_json_object(body, "$.verdicts")))
    items = files.select("run_id", "file_no", F.posexplode(F.from_json(rows, "array<string>")).alias("place", "item"))
    verdict = _text("item", "verdict")
    found = items.select("run_id", "file_no", "place", _text("item", "claimId").alias("claim_id"), _text("item", "sourceId").alias("source_id"), F.when(verdict.isin(*SEVERITY), verdict).alias("verdict"), _text("item", "note").alias("note"))
    return found.filter("claim_id is not null and source_id is not null")


def refused_files(files: DataFrame) -> DataFrame:
    """run_id, file_no of the files without a usable row: an empty fold would pass a gate of nothing."""
    used = read_verdict_files(files).select("run_id", "file_no").distinct()
    return files.select("run_id", "file_no").join(used, ["run_id", "file_no"], "left_anti")


def merged_verdicts(files: DataFrame) -> DataFrame:
    """The last verdict of each pair of a run, files in order."""
    rows = read_verdict_files(files)
    last = rows.groupBy("run_id", "claim_id", "source_id").agg(F.max_by(F.struct("verdict", "note"), F.struct("file_no", "place")).alias("v"))
    return last.select("run_id", "claim_id", "source_id", "v.*")


def semantic_gate(runs: DataFrame, files: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row for each run: counts and ``ok``.

    A run passes if it has files, each of them has rows, something was judged, no claim is refuted or without any
    support and, where the expected ``pairs`` (run_id, claim_id, source_id) are given, all of them are judged.
    """
    merged = merged_verdicts(files)
    claim = F.struct("run_id", "claim_id")
    claims = reduce_verdicts(merged.select(claim.alias("claim_id"), "verdict"))
    failed = F.col("status").isin("refuted", "unsupported")
    folded = claims.groupBy(F.col("claim_id.run_id").alias("run_id")).agg(
        *[F.sum(c).alias(c) for c in ("pairs", *SEVERITY)], F.count_if(failed).alias("failures"), F.count_if(F.col("supported") + F.col("partial") + F.col("unsupported") + F.col("refuted") < F.col("pairs")).alias("unadjudicated"), F.count_if("contradiction").alias("contradictions")
    )
    refused = refused_files(files).groupBy("run_id").agg(F.count(F.lit(1)).alias("refused"))
    out = runs.select("run_id").distinct().join(folded, "run_id", "left").join(refused, "run_id", "left")
    if pairs is not None:
        judged = merged.filter("verdict is not null").select("run_id", "claim_id", "source_id")
        missing = pairs.select("run_id", "claim_id", "source_id").distinct().join(judged, ["run_id", "claim_id", "source_id"], "left_anti")
        out = out.join(missing.groupBy("run_id").agg(F.count(F.lit(1)).alias("uncovered")), "run_id", "left")
    names = ["pairs", *SEVERITY, "failures", "unadjudicated", "contradictions", "refused", *(["uncovered"] if pairs is not None else [])]
    out = out.select("run_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    adjudicated = sum((F.col(k) for k in SEVERITY), F.lit(0))
    ok = (adjudicated > 0) & (F.col("failures") == 0) & (F.col("refused") == 0)
    if pairs is not None:
        ok = ok & (F.col("uncovered") == 0)
    return out.withColumn("adjudicated", adjudicated).withColumn("ok", ok)


def check_semantic(reports: DataFrame, sources: DataFrame, files: DataFrame, require_verify: bool = False, **options) -> DataFrame:
    """The mechanical gate with the semantic one folded in; ``files`` has report_id, file_no, payload.

    The semantic part only adds failures: a report without verdicts fails. With ``require_verify`` the pairs of claims and
    sources are derived from REPORT.md again, so a verdict that was left out, or a report changed after it was judged, fails too.
    """
    expected = worklists(claim_pairs(reports, sources)).select(F.col("report_id").alias("run_id"), "claim_id", "source_id") if require_verify else None
    runs = reports.select(F.col("report_id").alias("run_id"))
    judged = semantic_gate(runs, files.withColumnRenamed("report_id", "run_id"), expected)
    extra = ["failures", "unadjudicated", "contradictions", *(["uncovered"] if require_verify else [])]
    gate = check(reports, sources, judged.select(F.col("run_id").alias("report_id"), "ok"), **options)
    return gate.join(judged.select(F.col("run_id").alias("report_id"), *extra), "report_id")


def merge_manifests(manifests: DataFrame, group: str) -> DataFrame:
    """The manifest of merged runs: time of the latest, depth of the deepest, all backends once, number of sub-questions.

    ``manifests`` has group, run_dir, built_at, depth, backends and backends_used (arrays).
    """
    depth = F.array_position(F.array(*[F.lit(d) for d in DEPTH_ORDER]), F.col("depth"))
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("backends", "backends_used")]  # sets of a small vocabulary
    out = manifests.groupBy(group).agg(F.max("built_at").alias("built_at"), F.max_by("depth", depth).alias("depth"), *lists, F.count(F.lit(1)).alias("sub_questions"))
    return out.withColumn("depth", F.coalesce("depth", F.lit("deep")))


def run_tallies(candidates: DataFrame, run: str, floor: int, budget: int) -> DataFrame:
    """What became of the candidates of each run: duplicates, those beyond the budget, those kept, backends that gave any, and whether the run is thin.

    ``candidates`` has run, backend, identity_key.
    """
    keys = candidates.groupBy(run, "identity_key").agg(F.count(F.lit(1)).alias("n")).groupBy(run).agg(F.sum("n").alias("found"), F.count(F.lit(1)).alias("distinct_found"))
    used = candidates.groupBy(run).agg(F.array_sort(F.collect_set("backend")).alias("backends_used"))
    out = keys.join(used, run).withColumn("duplicates", F.col("found") - F.col("distinct_found")).withColumn("kept", F.least("distinct_found", F.lit(budget)))
    return out.withColumn("not_fetched", F.col("distinct_found") - F.col("kept")).withColumn("thin", F.col("kept") < floor)
