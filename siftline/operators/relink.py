"""Repairing sources that cite a machine endpoint: rounds of conflict-free relinking up to a fixpoint.

``sources`` has ``run`` (the table of sources that a row belongs to; any name), id, url, canonical_url, title, text and backend, and may
have text_via. An endpoint whose own text names its document gets that document's URL, unless another source
of the run holds it: then claims would be split over twins, so the endpoint stays and its issue names the twin.
Of endpoints that name one document the first by number wins. A source that moves frees the URL it held, so what was
blocked may move in the next round; rounds end when nobody can move.

Texts are read once, for what they name; rounds go over (run, number, canonical_url, derived) only, and a document
named by very many endpoints is reduced to its first one before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.html import junk_reason
from siftline.functions.text import squeeze, title_from_text
from siftline.functions.url import canonical_url, derive_citable_url, domain_of, is_citable

from .dedup import _cut as cut
from .ranking import trust

EXCERPT = 400


def id_number(source_id: Column) -> Column:
    """The running number of an id, so that S9 comes before S10."""
    return F.regexp_extract(source_id, "([0-9]+)$", 1).try_cast("long")


def _state(sources: DataFrame, run: str) -> DataFrame:
    """What the rounds need of each source; ``derived`` only of endpoints."""
    derived = F.when(~F.coalesce(is_citable(F.col("url")), F.lit(False)), derive_citable_url(F.coalesce("text", F.lit(""))))
    rows = sources.select(run, "id", "canonical_url", derived.alias("derived"))
    return rows.select(run, "id", F.struct(F.coalesce(id_number(F.col("id")), F.lit(0)).alias("n"), "id").alias("place"), "canonical_url", "derived", canonical_url(F.col("derived")).alias("aim"), F.lit(False).alias("moved"))


def _movers(state: DataFrame, run: str) -> DataFrame:
    """(run, aim, place) of the first endpoint of each document that no source holds."""
    waiting = state.filter(~F.col("moved") & F.col("aim").isNotNull() & ~F.col("aim").eqNullSafe(F.col("canonical_url")))
    first = waiting.groupBy(run, "aim").agg(F.min("place").alias("place"))
    held = state.filter("canonical_url is not null").select(run, F.col("canonical_url").alias("aim")).distinct()
    return first.join(held, [run, "aim"], "left_anti")


def relinked(sources: DataFrame, run: str) -> DataFrame:
    """The state after the last round: run, id, place, canonical_url, derived, aim, moved."""
    state = cut(_state(sources, run))
    while True:
        movers = cut(_movers(state, run))
        if movers.isEmpty():
            return state
        mark = movers.select(run, F.col("place.id").alias("id"), F.lit(True).alias("moves"))
        after = state.join(mark, [run, "id"], "left")
        goes = F.coalesce("moves", F.lit(False))
        state = cut(after.select(run, "id", "place", F.when(goes, F.col("aim")).otherwise(F.col("canonical_url")).alias("canonical_url"), "derived", "aim", (F.col("moved") | goes).alias("moved")))


def auto_relink(sources: DataFrame, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """The sources with their repaired URLs, and the issues that are left.

    A repaired source gets the document's URL, its domain and the trust of its route; a title that is the old URL or
    missing is read off the text; ``text_via`` keeps where the text came from. ``moved`` says which rows these are.
    Issues: run, id, reason (not-citable, duplicate or wall), derived, twin, title and excerpt where nothing is named.
    """
    state = relinked(sources, run)
    rows = (sources if "text_via" in sources.columns else sources.withColumn("text_via", F.lit(None).cast("string"))).drop("canonical_url", "domain", "trust", "moved")
    rows = rows.join(state.select(run, "id", "canonical_url", "derived", "moved", "aim"), [run, "id"])
    text, moved = F.coalesce("text", F.lit("")), F.col("moved")
    bare = F.coalesce(F.col("title"), F.lit("")).isin("") | F.col("title").eqNullSafe(F.col("url"))
    title = F.when(bare, F.coalesce(F.nullif(title_from_text(text), F.lit("")), "derived")).otherwise(F.col("title"))
    repaired = rows.withColumns({
        "title": F.when(moved, title).otherwise(F.col("title")),
        "text_via": F.when(moved, F.coalesce("text_via", "url")).otherwise(F.col("text_via")),
        "url": F.when(moved, F.col("derived")).otherwise(F.col("url")),
    })
    repaired = repaired.withColumns({"domain": domain_of(F.col("url")), "trust": trust(F.col("backend"))})

    citable = F.coalesce(is_citable(F.col("url")), F.lit(False))
    reason = F.when(~citable, "not-citable").when(junk_reason(text).isNotNull(), "wall")
    left = repaired.withColumn("reason", reason).filter("reason is not null")
    aims = left.filter("aim is not null").select(run, "aim").distinct()
    holders = state.select(run, F.col("canonical_url").alias("aim"), "place").join(aims, [run, "aim"], "left_semi").groupBy(run, "aim").agg(F.min("place").alias("holder"))
    left = left.join(holders, [run, "aim"], "left")
    twin = F.when((F.col("reason") == "not-citable") & ~F.col("canonical_url").eqNullSafe(F.col("aim")), F.col("holder.id"))
    evidence = (F.col("reason") == "not-citable") & F.col("derived").isNull()
    issues = left.select(
        run,
        "id",
        F.when(twin.isNotNull(), "duplicate").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("reason") == "not-citable", F.col("derived")).alias("derived"),
        twin.alias("twin"),
        F.when(evidence, F.when(bare, title_from_text(text)).otherwise(F.col("title"))).alias("title"),
        F.when(evidence, F.substring(squeeze(text), 1, EXCERPT)).alias("excerpt"),
    )
    return repaired.drop("derived", "aim"), issues
