"""Ranked lists: reciprocal rank fusion, variants, duplicates by URL, caps.

A list is rows with ``list_id`` and ``pos`` (from 1); order is a column, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, list_id: str, *order: Column) -> DataFrame:
    """Adds ``pos``, the place in each list by ``order``, which must have no ties."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(list_id).orderBy(*order)))


def rrf(lists: DataFrame, key: str, k: int = RRF_K, list_no: str | None = None) -> DataFrame:
    """key, score: the sum of 1 / (k + pos) over all rows, and with ``list_no`` found_by, the number of lists. Hash aggregation with partial sums; a key twice in a list counts twice."""
    found = [F.count_distinct(list_no).alias("found_by")] if list_no else []
    return lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("pos"))).alias("score"), *found)


def fuse(lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """One row for each key with its fused score and ``found_by``, the number of lists that have it.

    The row is the first that has text, or the first at all, lists in the order of ``list_no``; its
    map ``meta`` is completed by the others, earlier rows first. ``lists`` has list_no, pos, url,
    title, text, meta and ``key``. Rows of one key are folded pairwise-free: the best row by a
    minimum, the metadata by the first value of each entry.
    """
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    entry = F.struct((~has_text).alias("without"), "list_no", "pos", "url", "title", "text")
    base = lists.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("pos"))).alias("score"),
        F.count_distinct("list_no").alias("found_by"),
        F.min(entry).alias("best"),
    )
    # the row that gives the text also gives its metadata first, then the others in order
    entries = lists.select(key, "list_no", "pos", (~has_text).alias("without"), F.explode("meta").alias("name", "value"))
    first = entries.groupBy(key, "name").agg(F.min(F.struct("without", "list_no", "pos", "value")).alias("e"))
    meta = first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("e.value"))))).alias("meta"))
    out = base.join(meta, key, "left")
    return out.select(key, "best.url", "best.title", "best.text", "meta", "score", "found_by")


def merge_variants(lists: DataFrame, key: str = "canonical_url", k: int = RRF_K) -> DataFrame:
    """Fusion of the query variants of one backend: the same operator by canonical URL."""
    return fuse(lists, key, k)


def dedupe_by_url(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """The best row of each key (ties: the earlier), with ``first_pos`` for the order and ``copies``. One shuffle, no window: a key with a third of the rows is reduced map-side."""
    own = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(F.col(score), -F.col(pos))).alias("best"), F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("copies"))
    return best.select(key, "best.*", "first_pos", "copies")


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps only ``n`` rows of a group in each partition before it shuffles."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= n)


def cascade(engines: DataFrame, per_source: int, breadth: int) -> DataFrame:
    """The engines that a cascade asks, in preference order: waves until ``breadth`` of them gave ``per_source`` items.

    ``engines`` (few rows) has preference, engine, items. A wave is as many engines as satisfied ones are still missing.
    """
    rows = sorted(engines.select("preference", "engine", "items").collect())
    asked, enough = [], 0
    while enough < breadth and len(asked) < len(rows):
        wave = rows[len(asked) : len(asked) + breadth - enough]
        asked += wave
        enough = sum(r["items"] >= per_source for r in asked)
    return engines.sparkSession.createDataFrame([tuple(r) for r in asked], engines.select("preference", "engine", "items").schema)
