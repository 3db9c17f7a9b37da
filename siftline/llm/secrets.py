"""Secrets by pattern and by sliding-window entropy, in DataFrame functions only.

Base spans are matches of fixed patterns. Other candidate strings are runs of token characters with a
digit, or with four capitals; each belongs to a character class, and the greatest Shannon entropy of any window of ``WINDOW``
characters is found with counts that change by one character in and one out at each step, in time proportional to its length. A
candidate at or above the threshold of its class is a span of kind ``entropy`` unless the allow-list
suppresses it or it overlaps a base span.

A row needs no other row: nothing is shuffled. Rows: null texts are empty and have no span; repeated
rows give repeated results; an empty table gives none; extra columns are not read. Positions are code
points. They come from the lengths of the parts between matches, summed in blocks of ``BLOCK``
matches, so a long text with very many matches takes time in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"  # runs are maximal, so the length may stand in the pattern

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9]|(?:[a-z+/_=-]*+[A-Z]){4})[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: character class: (pattern of the whole candidate, least entropy in bits)
CLASSES = {
    "hex": (r"^[0-9A-Fa-f]+$", 3.0),
    "mixed": (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", 3.7),
    "one_case": (r"^(?=.*[A-Za-z])(?=.*[0-9])", 3.7),
    "letters": (r"^(?=.*[a-z])(?=(?:[^A-Z]*+[A-Z]){4})", 4.0),
}
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|lorem",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(.)\1{7}",
    r"(?i)0123456789|123456789|abcdefghij",
)
BLOCK = 256

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _matches(df: DataFrame, name: str, pattern: str, only: Column | None = None) -> DataFrame:
    """Adds ``name``: structs (start, end, value) of all matches of ``pattern`` in ``__text``, null without any. Rows that fail ``only`` have none."""
    parts, found, heads = f"{name}_parts", f"{name}_found", f"{name}_heads"
    has = F.col("__text").rlike(pattern)
    if only is not None:
        has = only & has
    df = df.withColumn(found, F.when(has, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(parts, F.when(F.col(found).isNotNull(), F.split("__text", pattern, -1)))
    n = F.size(found)

    def width(i: Column) -> Column:
        return F.length(F.get(F.col(parts), i)) + F.length(F.get(F.col(found), i))

    def block(b: Column) -> Column:
        return F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1)

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    begins = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, b: F.struct((a["at"] + F.aggregate(block(b), F.lit(0), lambda s, i: s + width(i))).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    df = df.withColumn(heads, F.when(F.col(found).isNotNull(), begins))

    def spans(b: Column) -> Column:
        return F.aggregate(
            block(b),
            F.struct(F.get(F.col(heads), b).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
            lambda a, i: F.struct(
                (a["at"] + width(i)).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(F.get(F.col(parts), i))).alias("start"), (a["at"] + width(i)).alias("end"), F.get(F.col(found), i).alias("value")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    df = df.withColumn(name, F.when(F.col(found).isNotNull(), F.flatten(F.transform(blocks, spans))))
    return df.drop(parts, found, heads)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once: inside a lambda an expression would be computed at every step."""
    return F.get(F.transform(F.array(value), f), 0)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of any ``window`` characters in a row; the value has that many.

    The counts that change are those of the character that comes and of the one that goes, each
    taken from the window of the step before, so a value of n characters takes n short steps.
    """
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def of(letters: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            came, went = F.get(letters, i), F.when(i >= window, F.get(letters, i - window))
            held = F.slice(letters, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
            out = F.when(went.isNull(), 0).otherwise(F.size(held) - F.size(F.array_remove(held, went)))
            into = F.size(held) - F.size(F.array_remove(held, came)) - (came.eqNullSafe(went)).cast("int")
            total = a["sum"] - F.get(weights, out) + F.get(weights, F.greatest(out - 1, F.lit(0))) - F.get(weights, into) + F.get(weights, into + 1)
            best = F.when(i >= window - 1, F.greatest(a["best"], F.lit(math.log2(window)) - total / window)).otherwise(a["best"])
            return F.struct(total.alias("sum"), best.alias("best"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda a: a["best"])

    return _bound(F.split(value, ""), of)


def is_secret(value: Column) -> Column:
    """Whether a candidate string reaches the entropy of its class and no entry of the allow-list suppresses it."""
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least)
    plain = F.lit(True)
    for pattern in ALLOWED:
        plain = plain & ~value.rlike(pattern)
    return F.when(plain & least.isNotNull(), window_entropy(value) >= least).otherwise(F.lit(False))


KINDS = ("assign", "access", "hex", "entropy")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of (start, end); ``base`` and ``spans``: arrays of (start, rank of the kind, end) in order."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    low = F.lower("__text")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    df = _matches(df, "assign", ASSIGN, named)
    df = _matches(df, "access", ACCESS, F.col("__text").contains("AKIA"))
    df = _matches(df, "hex", HEX)
    df = _matches(df, "entropy", CANDIDATE)
    good = {
        "assign": lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 12,
        "access": lambda m: F.length(m["value"]) >= 18,
        "hex": lambda m: F.lit(True),
        "entropy": lambda m: is_secret(m["value"]),
    }

    def ranked(kind: str, keep) -> Column:
        own = F.transform(F.filter(kind, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))
        return F.coalesce(own.cast(_SPAN), F.array().cast(_SPAN))

    df = df.withColumn("base", F.array_sort(F.concat(*[ranked(k, good[k]) for k in KINDS[:3]])))
    free = ranked("entropy", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & good["entropy"](m))
    return df.withColumn("spans", F.array_sort(F.concat("base", free))).select("doc_id", "base", "spans")


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
