"""Walsh-Hadamard audit of how filters interact.

A document fails a set of filters, held as a bit mask. For each part and label the 32 sums of
``(-1) ** |k & mask|``, one for each k, are aggregated; the transform is its own inverse but for the factor 32,
so the number of documents with each mask comes back exactly, in integers. Every order of the filters is
then evaluated on these cells: a step removes what fails its filter and none before it. Summed over all
orders, a document that fails c filters is removed by each of them in 1/c of the orders (120, 60, 40, 30
or 24 of 120), which gives the Shapley numbers in closed form.

Documents are reduced to a digest of their text and a mask in one pass. Of equal texts the least ``doc_id`` is
the first; rows with equal id, digest and part are counted first, so the joins on ids meet no hot key
and no text is shuffled. What grows beyond is one row for each part and label.

Rows: null texts are empty and equal to empty ones; null sources are the part ''; a null ``doc_id`` is
neither smaller nor larger than any other and has no label; several labels of one id count if any of them
holds; repeated rows count each, and equal ids do not make each other fail; very long texts are read whole;
an empty table has no part and gives no row. Extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

WORD_BREAK = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def own_failures(text: Column) -> list[Column]:
    """The conditions A to D, which a text meets or not whatever the others are."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [count < 200, 100 * distinct < 50 * count, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def mask_of(failures: list[Column]) -> Column:
    """Bit i is set where condition i holds."""
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failures)), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: the documents by what they fail, ``n`` rows each (not yet summed over ids)."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), mask_of(own_failures(text)).alias("own"))
    rows = materialise(own.groupBy("doc_id", "digest", "part").agg(F.min("own").alias("own"), F.count(F.lit(1)).alias("n")), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    held = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(old) == 1).cast("int")), F.lit(0)).alias(new) for old, new in (("quality", "good"), ("toxic", "toxic"))))
    named = rows.filter("doc_id is not null").join(firsts, ["doc_id", "digest"], "left").join(held, "doc_id", "left")
    unnamed = rows.filter("doc_id is null").select("*", F.lit(True).alias("first"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    copy = F.when(F.col("first"), 0).otherwise(1 << len(own_failures(text)))
    every = named.unionByName(unnamed)
    return every.select("part", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("good", "toxic")), (F.col("own") + copy).alias("mask"), "n")


def _sign(a: Column, b: Column) -> Column:
    return F.lit(1).cast("long") - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(masks: DataFrame, keys: list[str], filters: int) -> DataFrame:
    """For each of ``keys`` an array ``sums`` of the 2 ** filters signed sums of n; partly summed before the shuffle."""
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), F.lit(k))).alias(f"sum{k}") for k in range(1 << filters)]
    return masks.groupBy(*keys).agg(*sums).select(*keys, F.array(*(f"sum{k}" for k in range(1 << filters))).alias("sums"))


def mask_cells(sums: Column, filters: int) -> Column:
    """The numbers of rows with each mask, exactly: the inverse transform of ``sums``."""
    places = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    total = lambda m: F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc + F.get(sums, k) * _sign(k, m))
    return F.transform(places, lambda m: F.call_function("shiftright", total(m), F.lit(filters)))


def evaluate_orders(cells: DataFrame, names: str) -> DataFrame:
    """From ``cells`` (part, good, toxic, mask, n) with every mask of every part, the numbers of each order and step.

    ``names`` has one character for each filter, that of bit 0 first. A step depends on its filter and the set
    of those before it, not on their order: 80 such pairs stand for the 600 steps of five filters.
    """
    spark, n = cells.sparkSession, len(names)
    steps = []
    for order in permutations(names):
        bits = [1 << names.index(x) for x in order]
        steps += [("".join(order), i + 1, own, sum(bits[:i])) for i, own in enumerate(bits)]
    met = [(own, earlier, mask, bool(mask & own), bool(mask & earlier), mask == own) for own, earlier in sorted({x[2:] for x in steps}) for mask in range(1 << n)]
    pairs = spark.createDataFrame(met, "own int, earlier int, mask int, fails boolean, before boolean, only boolean")
    listed = spark.createDataFrame(steps, "filter_order string, step int, own int, earlier int")
    share = F.when(F.col("fails"), F.expr(f"{factorial(n)} div bit_count(mask)")).otherwise(0)
    removed = F.col("fails") & ~F.col("before")

    def total(which: Column, weight: Column | None = None) -> Column:
        return F.sum(F.when(which, F.col("n") if weight is None else F.col("n") * weight).otherwise(0))

    numbers = (
        cells.join(F.broadcast(pairs), "mask")
        .groupBy("part", "own", "earlier")
        .agg(
            total(~F.col("fails") & ~F.col("before")).alias("kept"),
            total(removed).alias("removed"),
            total(F.col("fails") & F.col("before")).alias("redundant"),
            total(F.col("only")).alias("unique_fails"),
            total(removed & (F.col("good") == 1)).alias("good_lost"),
            total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
            total(F.col("fails"), share).alias("shapley"),
        )
    )
    return numbers.join(F.broadcast(listed), ["own", "earlier"]).drop("own", "earlier")


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit of ``masks`` (part, good, toxic, mask, n) for filters ``names``, one character each."""
    sums = parity_sums(masks, ["part", "good", "toxic"], len(names))
    cells = sums.select("part", "good", "toxic", F.posexplode(mask_cells(F.col("sums"), len(names))).alias("mask", "n"))
    return evaluate_orders(cells, names).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters A to E, and step."""
    return audit(document_masks(docs, labels))
