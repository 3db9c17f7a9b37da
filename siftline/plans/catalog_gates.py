"""Queries of the gate and of relinking, on reports and sources that differ from part to part.

The SQL states from the numbers of the parts what each rule says about them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import grounding, relink, verdicts

from .catalog import query
from .catalog_rules import parts

def _i() -> Column:
    return F.col("i")


def _if(condition: Column, text: Column | str) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text).otherwise(F.lit(""))


def gate_reports(spark, sf_dir) -> DataFrame:
    """A report for each part: cited, marked, unsourced and dangling claims, appendices, and summaries; some have notes only."""
    price = F.concat((100 + _i() % 7).cast("string"), F.lit(",000"))
    name = F.coalesce("n", F.lit("thing"))
    body = F.concat(
        F.lit("# Report\n\nThe "), name, F.lit(" costs "), price, F.lit(" coins in the usual shop"),
        F.when(_i() % 5 == 0, F.lit(" [M].")).otherwise(F.lit(" [S1].")),
        _if(_i() % 4 == 1, "\n\nIt has no source at all but many words here"),
        _if(_i() % 6 == 2, "\n\nIt is also seen in shops that are far away [S9]"),
        _if(_i() % 7 == 3, "\n\n## Sources\n- the second one [S2]"),
    )
    summary = F.concat(F.lit("# Summary\n\n"), _if(_i() % 9 == 0, "It costs what the others cost [S2]\n\n"), F.lit("This tier has no source in its many words"))
    files = F.array(F.struct(F.when(_i() % 11 == 0, F.lit("NOTES.md")).otherwise(F.lit("REPORT.md")).alias("file"), body.alias("text")), F.struct(F.lit("SUMMARY.md").alias("file"), summary.alias("text")))
    return parts(spark, sf_dir).select(_i().alias("report_id"), F.explode(files).alias("f")).select("report_id", "f.*")


def gate_sources(spark, sf_dir) -> DataFrame:
    """S1, here an endpoint, there a wall or another price; S2 for even parts."""
    price = (100 + _i() % 7 + F.when(_i() % 3 == 0, 7).otherwise(0)).cast("string")
    one = F.when(_i() % 13 == 0, F.lit("Checking your browser before accessing the site")).otherwise(F.concat(F.lit("It is sold at "), price, F.lit(" 000 coins")))
    url = F.concat(F.when(_i() % 10 == 1, F.lit("https://api.x.org/api/v1/")).otherwise(F.lit("https://x.org/")), "k")
    rows = F.array(
        F.struct(F.lit("S1").alias("source_id"), url.alias("url"), one.alias("text"), F.lit(0.9).alias("trust")),
        F.struct(F.lit("S2").alias("source_id"), F.concat(F.lit("https://y.org/"), "k").alias("url"), F.lit("another text").alias("text"), F.lit(0.5).alias("trust")),
    )
    return parts(spark, sf_dir).select(_i().alias("report_id"), F.explode(rows).alias("s")).select("report_id", "s.*").filter((F.col("source_id") == "S1") | (F.col("report_id") % 2 == 0))


_GATE = """p AS (SELECT p_partkey AS i FROM part),
a AS (SELECT i, i % 11 <> 0 AS r, i % 11 <> 0 AND i % 5 <> 0 AS one, i % 9 = 0 AND i % 2 = 0 AS two FROM p),
b AS (SELECT *, CAST(one AS BIGINT) + CAST(two AS BIGINT) AS citations, CAST(r AND i % 5 = 0 AS BIGINT) AS model_hints, CAST(r AND i % 6 = 2 AS BIGINT) + CAST(i % 2 = 1 AND (r AND i % 7 = 3 OR i % 9 = 0) AS BIGINT) AS dangling,
  CAST(one AND i % 10 = 1 AS BIGINT) AS not_citable, CAST(one AND i % 13 = 0 AS BIGINT) AS walls, CAST(r AND i % 4 = 1 AS BIGINT) AS unsourced, CAST(1 + (i + 1) % 2 AS BIGINT) AS sources, CAST(one AND (i % 3 = 0 OR i % 13 = 0) AS BIGINT) AS absent FROM a),
g AS (SELECT *, sources - CAST(one AS BIGINT) - CAST(two AS BIGINT) AS uncited, r AND citations > 0 AND dangling = 0 AND unsourced = 0 AS ok FROM b)"""
_COUNTS = ["citations", "model_hints", "dangling", "not_citable", "walls", "unsourced", "sources", "uncited"]


@query(f"WITH {_GATE} SELECT i AS report_id, r AS has_report, {', '.join(_COUNTS)}, CAST(0 AS BIGINT) AS unknown_tokens, ok FROM g")
def gate_mechanical(spark, sf_dir):
    """Unsourced claims fail a report, in REPORT.md only; known citations count; appendices can dangle; endpoints and walls are counted."""
    return grounding.check(gate_reports(spark, sf_dir), gate_sources(spark, sf_dir)).select("report_id", "has_report", *_COUNTS, "unknown_tokens", "ok")


@query(f"WITH {_GATE} SELECT i AS report_id, absent AS absent_numerals, ok AND absent = 0 AND sources >= 2 AS ok FROM g")
def gate_strict(spark, sf_dir):
    """With numerals that must be in a cited source, and two sources at least."""
    return grounding.check(gate_reports(spark, sf_dir), gate_sources(spark, sf_dir), strict_numerals=True, least_sources=2).select("report_id", "absent_numerals", "ok")


@query(
    f"""WITH {_GATE}, v AS (SELECT *, i % 3 <> 2 AS judged, i % 10 IN (7, 8) AS bad, CAST(one AND (i % 3 = 2 OR i % 10 = 9) AS BIGINT) AS uncovered FROM g)
SELECT i AS report_id, CAST(judged AND bad AS BIGINT) AS failures, uncovered, judged AND NOT bad AND uncovered = 0 AS semantic_ok, ok AND judged AND NOT bad AND uncovered = 0 AS ok FROM v"""
)
def check_semantic(spark, sf_dir):
    """Both gates in one: reports that were not judged, are refuted or unsupported, or miss a verdict for what they cite, fail."""
    claim = F.when(_i() % 10 == 9, F.lit("C9")).otherwise(F.lit("C1"))
    verdict = F.when(_i() % 10 == 7, F.lit("refuted")).when(_i() % 10 == 8, F.lit("unsupported")).otherwise(F.lit("supported"))
    payload = F.to_json(F.array(F.struct(claim.alias("claimId"), F.lit("S1").alias("sourceId"), verdict.alias("verdict"))))
    files = parts(spark, sf_dir).filter(_i() % 3 != 2).select(_i().alias("report_id"), F.lit(0).alias("file_no"), payload.alias("payload"))
    gate = verdicts.check_semantic(gate_reports(spark, sf_dir), gate_sources(spark, sf_dir), files, require_verify=True)
    return gate.select("report_id", "failures", "uncovered", "semantic_ok", "ok")


# --- relinking ------------------------------------------------------------------------------------


def clashing_sources(spark, sf_dir) -> DataFrame:
    """Groups of six sources, ten groups a run: a page that may hold the group's document, two endpoints that name it, an endpoint that
    holds a second document and names a third, one that names the second, and one that names nothing."""
    j = _i()
    g, kind = F.floor(j / 6).cast("string"), j % 6
    named = [F.concat(F.lit(f"Record 10.{n}/"), g, F.lit(". of the library")) for n in (9000, 7000, 8000)]
    url = F.when((kind == 0) & (F.floor(j / 6) % 2 == 0), F.concat(F.lit("https://doi.org/10.9000/"), g)).when(kind == 0, F.concat(F.lit("https://x.org/"), "k")).otherwise(F.concat(F.lit("https://api.x.org/api/v1/"), "k"))
    held = F.when(kind == 3, F.concat(F.lit("https://doi.org/10.7000/"), g)).otherwise(url)
    text = F.when(kind == 0, F.lit("a page")).when(kind < 3, named[0]).when(kind == 3, named[2]).when(kind == 4, named[1]).otherwise(F.concat(F.lit("No  record\n\nof "), "k"))
    title = F.when(kind == 1, url).when(kind == 5, F.concat(F.lit("Title "), "k")).otherwise(F.lit("A title"))
    return parts(spark, sf_dir).select(F.floor(j / 60).alias("run"), F.concat(F.lit("S"), "k").alias("id"), url.alias("url"), held.alias("canonical_url"), title.alias("title"), text.alias("text"), F.lit("file").alias("backend"))


_CLASH = """j AS (SELECT p_partkey AS i, p_partkey AS j FROM part), k AS (SELECT i, j // 60 AS run, CAST(j // 6 AS VARCHAR) AS g, j % 6 AS kind, (j // 6) % 2 = 0 AS held, j - j % 6 AS head FROM j)"""


@query(
    f"""WITH {_CLASH}, m AS (SELECT *, kind IN (3, 4) OR kind = 1 AND NOT held AS moved FROM k)
SELECT run, 'S' || i AS id, moved, CASE WHEN moved THEN 'https://doi.org/10.' || CASE kind WHEN 1 THEN '9000' WHEN 3 THEN '8000' ELSE '7000' END || '/' || g WHEN kind = 0 AND held THEN 'https://doi.org/10.9000/' || g
  WHEN kind = 0 THEN 'https://x.org/' || i ELSE 'https://api.x.org/api/v1/' || i END AS url, CASE WHEN moved THEN 'doi.org' WHEN kind = 0 AND held THEN 'doi.org' WHEN kind = 0 THEN 'x.org' ELSE 'api.x.org' END AS domain,
  CASE WHEN moved THEN 'https://api.x.org/api/v1/' || i END AS text_via, CASE WHEN kind = 5 THEN 'Title ' || i WHEN kind = 1 AND held THEN 'https://api.x.org/api/v1/' || i WHEN kind = 1 THEN 'Record 10.9000/' || g || '. of the library' ELSE 'A title' END AS title FROM m"""
)
def relinked_clashes(spark, sf_dir):
    """A document goes to one source only; one that moves away frees its URL for the next round."""
    repaired, _ = relink.auto_relink(clashing_sources(spark, sf_dir))
    return repaired.select("run", "id", "moved", "url", "domain", "text_via", "title")


@query(
    f"""WITH {_CLASH} SELECT run, 'S' || i AS id, CASE WHEN kind = 5 THEN 'not-citable' ELSE 'duplicate' END AS reason, CASE WHEN kind < 5 THEN 'https://doi.org/10.9000/' || g END AS derived,
  CASE WHEN kind < 5 THEN 'S' || (head + CASE WHEN held THEN 0 ELSE 1 END) END AS twin, CASE WHEN kind = 5 THEN 'Title ' || i END AS title, CASE WHEN kind = 5 THEN 'No record of ' || i END AS excerpt
FROM k WHERE kind IN (2, 5) OR kind = 1 AND held"""
)
def relink_issues(spark, sf_dir):
    """What relinking leaves: endpoints whose document another source holds, the first by number, and those that name none."""
    _, issues = relink.auto_relink(clashing_sources(spark, sf_dir))
    return issues
