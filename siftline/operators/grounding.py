"""Reports against sources: citations, claims, numerals, the grounding gate, verdicts.

``reports`` has report_id, file, text; ``sources`` has report_id, source_id, trust, text (and canonical_url).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.claims import SOURCE, body_lines, bracket_tokens, claim_words, normalize_numerals, numerals, source_tokens, units
from siftline.functions.html import junk_reason
from siftline.functions.url import is_api_endpoint

MIN_CLAIM_WORDS = 6
HARD_FILES, SOFT_FILES = ("REPORT.md",), ("SUMMARY.md", "glossary.md")
MAX_VERIFY = 40
SEVERITY = {"supported": 0, "partial": 1, "unsupported": 2, "refuted": 3}


def report_tokens(reports: DataFrame) -> DataFrame:
    """report_id, file, kind of the line, token: every bracket token outside code."""
    lines = reports.select("report_id", "file", F.explode(body_lines("text")).alias("l")).filter("l.kind <> 'code'")
    return lines.select("report_id", "file", F.col("l.kind").alias("kind"), F.explode(bracket_tokens(F.col("l.line"))).alias("token"))


def citations(reports: DataFrame) -> DataFrame:
    return report_tokens(reports).filter(F.col("token").rlike(SOURCE)).withColumnRenamed("token", "source_id")


def dangling_citations(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited ids without a source, those of appendices too."""
    return citations(reports).select("report_id", "source_id").distinct().join(sources.select("report_id", "source_id"), ["report_id", "source_id"], "left_anti")


def uncited_sources(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that no line of a body or hint cites."""
    cited = citations(reports).filter("kind <> 'appendix'").select("report_id", "source_id").distinct()
    return sources.join(cited, ["report_id", "source_id"], "left_anti")


def claim_strings(reports: DataFrame) -> DataFrame:
    """report_id, file, unit, item, kind, claim: prose units whole, lists item by item, in order."""
    u = reports.select("report_id", "file", F.posexplode(units("text")).alias("unit", "u"))
    return u.select("report_id", "file", "unit", F.col("u.kind").alias("kind"), F.posexplode("u.items").alias("item", "claim"))


def unsourced_claims(reports: DataFrame) -> DataFrame:
    """Claims of six words or more with neither a source nor the model's mark; a list without such an item counts as one claim."""

    def bare(text: Column) -> Column:
        return (claim_words(text) >= MIN_CLAIM_WORDS) & ~F.exists(bracket_tokens(text), lambda t: t.rlike(SOURCE) | (t == "M"))

    u = reports.select("report_id", "file", F.posexplode(units("text")).alias("unit", "u"))
    flagged = F.filter("u.items", bare)
    joined = F.array_join("u.items", " ")
    found = F.when(F.size(flagged) > 0, flagged).when((F.col("u.kind") == "list") & bare(joined), F.array(joined)).otherwise(F.array().cast("array<string>"))
    return u.select("report_id", "file", "unit", F.explode(found).alias("claim")).withColumn("claim", F.substring(F.trim("claim"), 1, 120))


def _cited_claims(reports: DataFrame, sources: DataFrame, file: str) -> DataFrame:
    """claim_pairs with the ``numerals`` of the whole claim, and whether the source has a text.

    Each source is looked through once for all numerals that any claim of its report asks of it; claims meet the answers, not the text.
    """
    claim = F.col("claim")
    claims = claim_strings(reports.filter(F.col("file") == file)).select(
        "report_id", "unit", "item", F.substring(F.trim(claim), 1, 400).alias("claim"), numerals(claim).alias("numerals"), source_tokens(claim).alias("cited")
    )
    claims = claims.filter(F.size("cited") > 0).withColumn("source_id", F.explode("cited")).drop("cited")
    asked = claims.filter(F.size("numerals") > 0).select("report_id", "source_id", F.explode("numerals").alias("n")).groupBy("report_id", "source_id").agg(F.collect_set("n").alias("asked"))
    read = sources.select("report_id", "source_id", "trust", "text").join(asked, ["report_id", "source_id"], "left")
    plain = F.when(F.size("asked") > 0, normalize_numerals(F.col("text")))
    read = read.withColumn("plain", plain).select("report_id", "source_id", "trust", F.col("text").isNotNull().alias("has_text"), F.filter("asked", lambda n: ~F.col("plain").contains(n)).alias("absent"))
    absent = F.when(F.size("numerals") > 0, F.filter("numerals", lambda n: F.array_contains("absent", n))).otherwise(F.array().cast("array<string>"))
    found = claims.join(read, ["report_id", "source_id"]).withColumn("numerals_absent", absent).drop("absent")
    order = Window.partitionBy("report_id").orderBy("unit", "item")
    return found.withColumn("claim_id", F.concat(F.lit("C"), F.dense_rank().over(order)))


def claim_pairs(reports: DataFrame, sources: DataFrame, file: str = "REPORT.md") -> DataFrame:
    """One row for each claim and source that it cites: claim_id (by order among the claims with a known source), claim (its first 400 characters), numerals that the source lacks."""
    return _cited_claims(reports, sources, file).select("report_id", "claim_id", "source_id", "claim", "numerals_absent", "trust")


def ungrounded_numerals(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Numerals of a whole claim that none of its cited sources has; sources without a text are unknown, not lacking. Claims meet their own sources only, by equality."""
    pairs = _cited_claims(reports, sources, "REPORT.md").filter("has_text")
    rows = pairs.select("report_id", "claim_id", F.explode("numerals").alias("numeral"), "numerals_absent")
    found = rows.groupBy("report_id", "claim_id", "numeral").agg(F.bool_and(F.array_contains("numerals_absent", F.col("numeral"))).alias("absent"))
    return found.filter("absent").drop("absent")


def worklist(pairs: DataFrame, most: int = MAX_VERIFY, shards: int | None = None, shard: int = 0) -> DataFrame:
    """The pairs to judge: the ``most`` of highest trust, then by claim and source as strings; with ``shards``, every n-th of them."""
    order = [F.desc("trust"), F.asc("claim_id"), F.asc("source_id")]
    top = pairs.orderBy(*order).limit(most).withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows
    return top if shards is None else top.filter((F.col("pos") - 1) % shards == shard)


def last_verdicts(verdicts: DataFrame, *order: str) -> DataFrame:
    """The last verdict of each pair. One hash aggregation; a pair judged very often is reduced map-side."""
    own = [c for c in verdicts.columns if c not in ("claim_id", "source_id")]
    return verdicts.groupBy("claim_id", "source_id").agg(F.max_by(F.struct(*own), F.struct(*order)).alias("v")).select("claim_id", "source_id", "v.*")


def reduce_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row for each claim: counts by kind, status (refuted, unsupported, unadjudicated, ok) and contradiction."""
    kind = {k: F.count_if(F.col("verdict") == k).alias(k) for k in SEVERITY}
    out = verdicts.groupBy("claim_id").agg(F.count(F.lit(1)).alias("pairs"), *kind.values())
    support = F.col("supported") + F.col("partial") > 0
    judged = F.col("supported") + F.col("partial") + F.col("refuted") + F.col("unsupported")
    status = F.when(F.col("refuted") > 0, "refuted").when(judged < F.col("pairs"), "unadjudicated").when(~support, "unsupported").otherwise("ok")
    return out.withColumn("status", status).withColumn("contradiction", support & (F.col("refuted") > 0))


def contradictions(verdicts: DataFrame) -> DataFrame:
    """Claims that some sources support and others refute, with both sets of sources."""
    supports = F.collect_set(F.when(F.col("verdict").isin("supported", "partial"), F.col("source_id")))
    refutes = F.collect_set(F.when(F.col("verdict") == "refuted", F.col("source_id")))
    out = verdicts.groupBy("claim_id").agg(F.array_sort(supports).alias("supporting"), F.array_sort(refutes).alias("refuting"))
    return out.filter((F.size("supporting") > 0) & (F.size("refuting") > 0))


def worst_verdict(verdicts: DataFrame) -> DataFrame:
    """source_id, verdict: the most severe of each source."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("verdict")]
    return verdicts.filter(rank.isNotNull()).groupBy("source_id").agg(F.max_by("verdict", rank).alias("verdict"))


def uncovered_pairs(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs without a verdict."""
    judged = verdicts.filter(F.col("verdict").isin(*SEVERITY)).select("claim_id", "source_id")
    return pairs.select("claim_id", "source_id").distinct().join(judged, ["claim_id", "source_id"], "left_anti")


def worklists(pairs: DataFrame, most: int = MAX_VERIFY) -> DataFrame:
    """The pairs to judge of every report: the ``most`` of highest trust of each, then by claim and source as strings."""
    order = Window.partitionBy("report_id").orderBy(F.desc("trust"), F.asc("claim_id"), F.asc("source_id"))
    return pairs.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)


def check(reports: DataFrame, sources: DataFrame, semantic: DataFrame | None = None, strict_numerals: bool = False, least_sources: int | None = None) -> DataFrame:
    """The gate, one row for each report: counts, and ``ok``.

    A report passes if it has a REPORT.md, cites a known source outside its appendices, cites no unknown one anywhere, and REPORT.md
    has no claim without a source or the model's mark; with ``strict_numerals`` also if every numeral of a cited claim is in one of its
    sources, with ``least_sources`` if it has so many, and with ``semantic`` (report_id, ok) if that lets it pass; a report that
    ``semantic`` does not name fails. The other tiers are read for citations only. Cited endpoints (not_citable), cited
    walls, unknown tokens and uncited sources are counted, and do not fail a report.
    """
    own = reports.filter(F.col("file").isin(*HARD_FILES, *SOFT_FILES))
    tokens = report_tokens(own)
    body = F.col("kind") != "appendix"
    source, model = F.col("token").rlike(SOURCE), F.col("token") == "M"
    label = F.lower("token") == "model-hint"
    other = tokens.filter(body & ~source)
    counts = other.groupBy("report_id").agg(F.count_if(model).alias("model_hints"), F.count_distinct(F.when(~model & ~label, F.col("token"))).alias("unknown_tokens"))
    address = next((F.col(c) for c in ("url", "canonical_url") if c in sources.columns), F.lit(None).cast("string"))
    endpoint = F.coalesce(is_api_endpoint(address), F.lit(False))
    known = sources.select("report_id", "source_id", endpoint.alias("endpoint"), junk_reason(F.col("text")).isNotNull().alias("wall"), F.lit(True).alias("known"))
    cited = tokens.filter(source).groupBy("report_id", F.col("token").alias("source_id")).agg(F.count_if(body).alias("n"))
    cited = cited.join(known, ["report_id", "source_id"], "left")
    seen = F.col("known") & (F.col("n") > 0)
    cited = cited.groupBy("report_id").agg(
        F.sum(F.when(F.col("known"), F.col("n"))).alias("citations"),
        F.count_if(F.col("known").isNull()).alias("dangling"),
        F.count_if(seen & F.col("endpoint")).alias("not_citable"),
        F.count_if(seen & F.col("wall")).alias("walls"),
        F.count_if(seen).alias("cited"),
    )
    bare = unsourced_claims(own.filter(F.col("file").isin(*HARD_FILES))).groupBy("report_id").agg(F.count(F.lit(1)).alias("unsourced"))
    held = sources.groupBy("report_id").agg(F.count(F.lit(1)).alias("sources"))
    out = reports.groupBy("report_id").agg(F.max(F.col("file").isin(*HARD_FILES)).alias("has_report"))
    for part in (counts, cited, bare, held, *([ungrounded_numerals(own, sources).groupBy("report_id").agg(F.count(F.lit(1)).alias("absent_numerals"))] if strict_numerals else [])):
        out = out.join(part, "report_id", "left")
    names = ["citations", "model_hints", "unknown_tokens", "dangling", "not_citable", "walls", "unsourced", "cited", "sources", *(["absent_numerals"] if strict_numerals else [])]
    out = out.select("report_id", "has_report", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])
    ok = F.col("has_report") & (F.col("citations") > 0) & (F.col("dangling") == 0) & (F.col("unsourced") == 0)
    if strict_numerals:
        ok = ok & (F.col("absent_numerals") == 0)
    if least_sources is not None:
        ok = ok & (F.col("sources") >= least_sources)
    out = out.withColumn("uncited", F.col("sources") - F.col("cited")).drop("cited")
    if semantic is not None:
        out = out.join(semantic.select("report_id", F.col("ok").alias("semantic_ok")), "report_id", "left").withColumn("semantic_ok", F.coalesce("semantic_ok", F.lit(False)))
        ok = ok & F.col("semantic_ok")
    return out.withColumn("ok", ok)
