"""The table of sources: building it, adding to it, merging runs, hygiene, batches, bibliography."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.html import external_hosts, junk_reason
from siftline.functions.text import squeeze
from siftline.functions.url import canonical_url, declares_identity, derive_citable_url, domain_of, is_citable


def number(df: DataFrame, prefix: str, start: Column | int, *order: Column) -> DataFrame:
    """Adds ``id``: prefix and a running number behind ``start``."""
    base = start if isinstance(start, Column) else F.lit(start)
    return _placed(df, *order).withColumn("id", F.concat(F.lit(prefix), (F.col("__place") + base).cast("string"))).drop("__place")


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``__place``, from 1. Rows are ranked inside ranges of the order and offset by the ranges before, so no task sees all rows."""
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    parted = _cut(parted)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    rows = parted.withColumn("__own", inner).join(F.broadcast(sizes), "__range")  # a row for each shuffle partition
    return rows.withColumn("__place", F.col("__own") + F.col("__before")).drop("__range", "__own", "__before", "__n")


def _cut(df: DataFrame) -> DataFrame:
    from .dedup import _cut as cut

    return cut(df)


def signals(url: Column, text: Column, found_by: Column) -> Column:
    """What speaks for a source: hosts that it links to, whether it declares an identity, lists that have it."""
    hosts = F.size(external_hosts(url, text))
    own = declares_identity(url) | derive_citable_url(text).isNotNull()
    return F.struct(hosts.alias("ref_diversity"), own.alias("self_identified"), found_by.alias("corroboration"))


def build_sources(candidates: DataFrame, *order: Column) -> DataFrame:
    """Candidates (url, title, text, snippet, score, trust, found_by) as a numbered table of sources."""
    url, text = F.col("url"), F.coalesce("text", "snippet", F.lit(""))
    rows = candidates.select(
        "*",
        canonical_url(url).alias("canonical_url"),
        domain_of(url).alias("domain"),
        F.substring(squeeze(F.coalesce("snippet", "text", F.lit(""))), 1, 480).alias("short"),
        signals(url, text, F.col("found_by")).alias("signals"),
        (F.coalesce(F.col("text"), F.lit("")) != "").alias("full_text"),
    )
    return number(rows, "S", 0, *order)


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """New pages (pos, url, title, text) with a reason where they are refused, and ids behind the greatest where they are not."""
    page = new.withColumn("canonical_url", canonical_url(F.col("url")))
    known = sources.select("canonical_url", F.lit(True).alias("known")).distinct()
    page = page.join(known, "canonical_url", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    reason = (
        F.when(F.col("known"), "already a source")
        .when(~is_citable(F.col("url")), "not citable")
        .when(F.trim(text) == "", "no text")
        .otherwise(junk_reason(text))
    )
    page = page.withColumn("refused", reason).drop("known")
    first = page.filter("refused is null").groupBy("canonical_url").agg(F.min("pos").alias("first"))
    page = page.join(first, "canonical_url", "left")
    page = page.withColumn("refused", F.when(F.col("refused").isNull() & (F.col("pos") > F.col("first")), "repeated").otherwise(F.col("refused"))).drop("first")
    top = sources.agg(F.coalesce(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")), F.lit(0)).alias("top")).first()["top"]
    numbered = number(page.filter("refused is null"), "S", top, F.col("pos"))
    return numbered.unionByName(page.filter("refused is not null").withColumn("id", F.lit(None).cast("string")))


def issues(sources: DataFrame) -> DataFrame:
    """id, issue of each source that is not citable, shares its canonical URL, or is a wall."""
    place = F.struct(F.coalesce(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long"), F.lit(0)).alias("n"), "id")  # S9 before S10
    twins = sources.groupBy("canonical_url").agg(F.min(place)["id"].alias("first"), F.count(F.lit(1)).alias("n"))
    rows = sources.join(twins, "canonical_url")
    found = F.array_compact(
        F.array(
            F.when(~is_citable(F.col("canonical_url")), "not citable"),
            F.when((F.col("n") > 1) & (F.col("id") != F.col("first")), F.concat(F.lit("duplicate of "), F.col("first"))),
            F.when(junk_reason(F.col("text")).isNotNull(), "wall"),
        )
    )
    return rows.select("id", F.explode(found).alias("issue"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """identity_key, score (fused over runs), found_by, provenance (distinct runs and sub-questions, sorted).

    ``runs`` has run_dir, sub_question, pos, identity_key.
    """
    return runs.groupBy("identity_key").agg(
        F.sum(1.0 / (60 + F.col("pos"))).alias("score"),
        F.count_distinct("run_dir").alias("found_by"),
        F.array_sort(F.collect_set(F.struct("run_dir", "sub_question"))).alias("provenance"),
    )


def batches(rows: DataFrame, size: int = 8, *order: Column) -> DataFrame:
    """Adds ``batch``: a worklist of any length in chunks of ``size``."""
    return _placed(rows, *order).withColumn("batch", F.floor((F.col("__place") - 1) / size).cast("int")).drop("__place")


def probes(rows: DataFrame, group: str, size: int, *order: Column) -> DataFrame:
    """Adds ``probe`` (from 0) and ``pos`` (from 1): the rows of each group in order, ``size`` to a probe. A group of any size is ranked by ranges and offsets."""
    placed = _cut(_placed(rows, F.asc(group), *order))
    heads = placed.groupBy(group).agg(F.min("__place").alias("__head"))
    both = placed.join(heads, placed[group].eqNullSafe(heads[group])).drop(heads[group])
    at = F.col("__place") - F.col("__head")
    return both.withColumns({"probe": F.floor(at / size).cast("int"), "pos": (at % size + 1).cast("int")}).drop("__place", "__head")


_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_DIGITS = 18  # of a number that fits 64 bits


def _key_base() -> Column:
    """The citation key of a source as long as no other has it: surname, year, first word of more than three letters; the id where these are missing."""

    def words(x: str) -> Column:
        return F.filter(F.split(F.coalesce(x, F.lit("")), _SPACE), lambda w: w != "")

    def plain(w: Column) -> Column:
        return F.regexp_replace(F.lower(w), "[^a-z0-9]", "")

    names, number = words("author"), F.col("year").try_cast("double")
    author = F.coalesce(plain(F.get(names, F.size(names) - 1)), F.lower("id"))
    year = F.when(~F.isnan(number) & (number != 0), F.col("year").try_cast("long").cast("string"))
    word = F.get(F.filter(F.transform(words("title"), plain), lambda w: F.length(w) > 3), F.lit(0))
    base = F.concat(F.coalesce(author, F.lit("")), F.coalesce(year, F.lit("")), F.coalesce(word, F.lit("")))
    return F.when(base != "", base).otherwise(F.coalesce(F.lower("id"), F.lit("")))


def _meeting(bases: DataFrame) -> DataFrame:
    """__run, base of the bases whose numbered keys may meet: one is another with a number behind it that the rows of their family (equal without
    digits at the end) can reach, and some base of the family needs numbers. ``bases`` has __run, base and n, its rows.
    """
    own = bases.select("__run", "base", "n", F.regexp_replace("base", r"[0-9]+\z", "").alias("root"))
    families = own.groupBy("__run", "root").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("bases"), F.max("n").alias("most"))
    some = own.join(families.filter("bases > 1 and most > 1").select("__run", "root", "rows"), ["__run", "root"])
    length = F.length("base")
    heads = F.when(length > F.length("root"), F.sequence(F.greatest(F.length("root"), length - _DIGITS), length - 1))
    parted = some.select("__run", "base", "rows", F.explode(heads).alias("at"))
    tail = F.col("base").substr(F.col("at") + 1, F.lit(_DIGITS))
    parted = parted.filter(~tail.startswith("0") & (tail.cast("long") <= F.col("rows"))).select("__run", "base", F.col("base").substr(F.lit(1), F.col("at")).alias("shorter"))
    pairs = parted.join(some.select("__run", F.col("base").alias("shorter")), ["__run", "shorter"])
    return pairs.select("__run", F.explode(F.array("base", "shorter")).alias("base")).distinct()


def bibliography_keys(sources: DataFrame, group: str) -> DataFrame:
    """Unique citation keys for the scholarly sources of each run, in the order of ``pos``; later keys get a number.

    A base whose keys meet no others has its sources numbered by their places, by ranges and offsets, so a run or a base may have any size.
    A suffix may meet another key: bases with such keys depend on each other, and those of one family are one task, in time
    proportional to its sources.
    """

    def keys(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "id"])
        used: set[str] = set()
        ahead: dict[str, int] = {}  # smaller numbers of the base are taken
        out = []
        for base in rows["base"]:
            key, n = base, ahead.get(base, 2)
            while key in used:
                key, n = f"{base}{n}", n + 1
            used.add(key)
            ahead[base] = n
            out.append(key)
        return rows.assign(key=out)[[group, "id", "key"]]

    kinds = dict(sources.dtypes)
    rows = sources.select(group, "id", "pos", _key_base().alias("base"))
    placed = _cut(_placed(rows, F.asc(group), F.asc("base"), F.asc_nulls_last("pos"), F.asc("id"))).withColumn("__run", F.struct(group))
    bases = placed.groupBy("__run", "base").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("n"))
    meeting = _cut(_meeting(bases))
    alone = placed.join(bases.join(meeting, ["__run", "base"], "left_anti"), ["__run", "base"])
    n = F.col("__place") - F.col("first") + 1
    numbered = alone.select(group, "id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", n.cast("string"))).alias("key"))
    others = placed.join(meeting, ["__run", "base"], "left_semi").select(group, "id", "pos", "base", F.regexp_replace("base", r"[0-9]+\z", "").alias("root"))
    return numbered.unionByName(others.groupBy(group, "root").applyInPandas(keys, f"{group} {kinds[group]}, id string, key string"))


def bibtex(title: Column, key: Column, authors: Column, year: Column, doi: Column, url: Column) -> Column:
    """One BibTeX entry; fields without a value are left out."""

    def clean(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(x, r"[{}\\]", ""), r"\s+", " "))

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))

    fields = [field("title", clean(title)), field("author", F.array_join(F.transform(authors, clean), " and ")), field("year", year.cast("string")), field("doi", clean(doi)), field("url", url)]
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n}\n"))
