"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most 2 bits apart have a common neighbour at most 1 bit from each. Every
distinct fingerprint emits the 65 values of its ball of radius 1; rows meet on those values. The
members of a ball are its centre and its single-bit changes, so a ball is gathered as one 64-bit mask
by ``bit_or``: no list is collected and no value can hold more than 65 members. Members of a ball are
linked to the least of them, links are made distinct and verified, and components come from rounds
of least-label propagation with pointer jumping, each round written to the shared folder.

Rows: null, empty and blank texts have fingerprint 0 and link like any other; fewer words than a
shingle give one shingle of all; copies share a fingerprint, so only distinct fingerprints are
linked; null ids are never the least unless a component has no other; an empty table gives no row.
Repeated rows are kept. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, give_back, join_groups, keep_rows, materialise, new_path, text_batches, write_rows

SHINGLE = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        begins = [0, *ends]
        hashes = list(map(xxh64_intdigest, [joined[a : b - 1] for a, b in zip(begins, ends[shingle - 1 :])], repeat(42)))
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[lo : lo + (1 << 14)], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a long with the same 64 bits."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            own = [fingerprint_of((t.as_py() or "").encode(), shingle) for t in column]  # one text at a time
            yield pa.array(np.array(own, dtype=np.uint64).view(np.int64))
        give_back()

    return F.arrow_udf(run, "long")(text)


def links(prints: DataFrame) -> DataFrame:
    """Distinct verified links (a, b), a < b, that connect all of the distinct ``fp`` at most 2 bits apart."""
    shifts = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    ball = F.array(*[F.struct(F.col("fp").bitwiseXOR(F.lit(s).cast("long")).alias("value"), F.lit(s).cast("long").alias("bit")) for s in shifts], F.struct(F.col("fp").alias("value"), F.lit(0).cast("long").alias("bit")))
    # dealt by value before the grouping: hardly any value repeats in one task, so a partial aggregate would only take memory
    balls = prints.select(F.explode(ball).alias("x")).select("x.value", "x.bit").repartition("value").groupBy("value").agg(F.bit_or("bit").alias("mask"), F.max(F.col("bit") == 0).alias("centre"))
    balls = balls.filter(F.bit_count("mask") + F.col("centre").cast("int") > 1)
    around = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1), lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    members = F.concat(around, F.when(F.col("centre"), F.array("value")).otherwise(F.array().cast("array<long>")))
    pairs = balls.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the least node that it is connected to."""
    spark = edges.sparkSession
    both = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    path = new_path(spark, "labels")
    labels = write_rows(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), path)
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        lower = lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        before, path = path, new_path(spark, "labels")
        lower = write_rows(lower, path)
        drop_path(spark, before)  # nothing reads the round before any more
        labels = lower.select("node", "root")
        if lower.filter("root < old").isEmpty():
            return labels


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, n, component_id) of the distinct fingerprints of ``rows`` (doc_id, fp), each with the number of its rows."""
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    found = components(links(prints))
    alone = prints.join(found, prints["fp"] == found["node"], "left_anti").select("fp", "n", F.col("least").alias("component_id"))
    linked = prints.join(found.withColumnRenamed("node", "fp"), "fp")
    sizes = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = join_groups(linked, materialise(sizes, "components"), "root", "members").select("fp", "n", "component_id")
    return materialise(alone.unionByName(named), "named")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    text_batches(docs.sparkSession)
    rows = materialise(docs.select("doc_id", fingerprint("text", shingle).alias("fp")), "fingerprints")
    out = join_groups(rows, fingerprint_components(rows), "fp", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The document of least ``doc_id`` in each component, with all its columns; of rows with equal id and text one stays."""
    text_batches(docs.sparkSession)
    rows = materialise(docs.select("doc_id", F.xxhash64("text").alias("key"), fingerprint("text", shingle).alias("fp")), "fingerprints")
    joined = join_groups(rows, fingerprint_components(rows), "fp", "n").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # two texts of one component may share its least id
    kept = joined.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.doc_id", "x.key")
    return keep_rows(docs, kept, F.xxhash64("text"))
