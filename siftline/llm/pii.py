"""Personal data by pattern, and by bootstrapped contextual extraction.

Seed entities are the matches of fixed patterns. Every identifier-like token of a text, and every run of
short digit groups, is an instance; the words around it are its lexical patterns. On the graph of patterns and instances, a pattern's
score for a kind is the share of its instances that are seeds of the kind or have gained its score, where
unseen instances weigh less than seeds of other kinds; an instance's is the noisy-or of its trusted
patterns; seeds stay certain. After ``ROUNDS`` rounds, instances of high score that are no seeds are
identifiers of that kind wherever a text has them.

Pattern and instance are aggregated before every shuffle, so a frequent word costs one row for each
distinct instance; scores of patterns and instances are joined as tables, never gathered in one task.

Rows: null texts are empty and have no span; repeated rows give repeated results; null ids are kept;
very long texts take time in proportion to their length, runs of digit groups of any length too;
an empty table gives no row. Extra columns are not read. Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_groups, materialise, materialise_few, text_batches

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3  # distinct seeds that a pattern needs before it is trusted
PATTERN_SCORE = 0.8
INSTANCE_SCORE = 0.9
UNSEEN_WEIGHT = 0.3  # an unseen instance may be of the kind: it speaks less against a pattern than a seed of another kind
ROUNDS = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# starts stand at the head of a run of digits: from inside a run nothing matches that the head does not
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
#: Short groups of digits joined by single spaces, hyphens or brackets are one instance if they have enough digits.
#: The pattern takes a run to its end and cannot fail there, so no group is tried twice; what follows is looked at afterwards.
_RUN = re.compile(r"(?<![\w@.+/-])\(?[0-9]{1,6}\)?(?:[ -]\(?[0-9]{1,6}\)?)++")
_GOES_ON = re.compile(r"[\w@]")
_MOST_RUN = 4 * 19  # a digit, two brackets and what joins it to the next, for the most digits of an identifier
_EDGE = "()[]{}<>\"'.,;:!?"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, start)
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _ips(text)] + [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in _phones(text)]
    return sorted(out)


def _words(part: str) -> list[str]:
    return [w.strip(_EDGE).lower() for w in part.split()]


def instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and identifier-like tokens and runs of digit groups beside them, with the lexical patterns around each."""
    spans = [(a, b, k) for a, k, b in base]
    covered = sorted((a, b) for a, _, b in base)
    runs = []
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if b - a < _MOST_RUN and 7 <= len(_NOT_DIGITS.sub("", m.group())) <= 19 and not _GOES_ON.match(text, b) and not (at < len(covered) and covered[at][0] < b):
            runs.append((a, b))
    spans += [(a, b, -1) for a, b in runs]
    covered = sorted(covered + runs)
    at = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if b - a >= 5 and not (at < len(covered) and covered[at][0] < b):
            spans.append((a, b, -1))
    out = []
    for a, b, kind in spans:
        left, right = _words(text[max(0, a - 48) : a])[-2:], _words(text[b : b + 32])[:1]
        patterns = []
        if len(left) == 2 and a > 48 or left:
            patterns.append(f"{left[-1]} _")
        if len(left) == 2:
            patterns.append(f"{left[0]} {left[1]} _")
        if right:
            patterns.append(f"_ {right[0]}")
        if left and right:
            patterns.append(f"{left[-1]} _ {right[0]}")
        out.append({"start": a, "end": b, "seed": kind, "value": text[a:b].lower(), "patterns": patterns})
    return out


_FOUND = "struct<base:array<struct<start:int,rank:int,end:int>>,instances:array<struct<start:int,end:int,seed:int,value:string,patterns:array<string>>>>"


def scan(text: Column | str) -> Column:
    """Base spans and instances of each text."""
    kind = pa.struct([("base", pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))), ("instances", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for value in column:
                text = value.as_py() or ""
                base = base_spans(text)
                own = instances(text, base) if base or _DIGIT.search(text) or "@" in text else []
                out.append({"base": [{"start": a, "rank": k, "end": b} for a, k, b in base], "instances": own})
            yield pa.array(out, type=kind)

    return F.arrow_udf(run, _FOUND)(text)


def _by_kind(column: str, f) -> list[Column]:
    return [f(F.col(f"{column}{k}")).alias(f"{column}{k}") for k in range(len(KINDS))]


def _confidence(own: Column, gained: Column, every: Column, seeds: Column) -> Column:
    """Seeds of the kind and gained scores, over these, the seeds of other kinds, and the rest at ``UNSEEN_WEIGHT``."""
    rest = F.greatest(every - seeds - gained, F.lit(0.0))
    return (own + gained) / (seeds + gained + UNSEEN_WEIGHT * rest)


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, score0.., n_seeds0..) and (value, kind, score) of unseen instances, from distinct (pattern, value, seed).

    Joins know how many edges each pattern and value has, so a frequent one is not gathered in one task.
    """
    edges = materialise_few(edges, "edges")
    kinds = range(len(KINDS))
    seeds = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("seed") >= 0).cast("long")).alias("n_seeds"), *[F.sum((F.col("seed") == k).cast("long")).alias(f"n_seeds{k}") for k in kinds])
    seeds = materialise_few(seeds.filter(F.greatest(*[f"n_seeds{k}" for k in kinds]) >= MIN_SEEDS), "patterns")
    unseen = edges.filter("seed < 0").select("pattern", "value")
    degrees = materialise_few(unseen.groupBy("value").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    scores = rated = None
    for _ in range(rounds):
        if scores is None:
            gained = seeds.select("pattern", *[F.lit(0.0).alias(f"score{k}") for k in kinds])
        else:
            gained = join_groups(unseen, scores, "value", "degree").groupBy("pattern").agg(*_by_kind("score", F.sum))
        rated = seeds.join(gained.toDF("pattern", *[f"gain{k}" for k in kinds]), "pattern", "left")
        rated = rated.select("pattern", "n", "n_seeds", *[_confidence(F.col(f"n_seeds{k}"), F.coalesce(F.col(f"gain{k}"), F.lit(0.0)), F.col("n"), F.col("n_seeds")).alias(f"score{k}") for k in kinds], *[f"n_seeds{k}" for k in kinds])
        rated = materialise_few(rated, "rated")
        trusted = rated.select("pattern", "n", *[F.when((F.col(f"score{k}") >= PATTERN_SCORE) & (F.col(f"n_seeds{k}") >= MIN_SEEDS), F.least(F.col(f"score{k}"), F.lit(0.95))).otherwise(0.0).alias(f"score{k}") for k in kinds])
        trusted = trusted.filter(F.greatest(*[f"score{k}" for k in kinds]) > 0)
        reached = join_groups(unseen, trusted, "pattern", "n").groupBy("value").agg(*_by_kind("score", lambda s: F.lit(1.0) - F.exp(F.sum(F.log1p(-s)))))
        scores = materialise_few(reached.join(degrees, "value"), "instances")
    best = F.array_max(F.array(*[F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("kind")) for k in kinds]))
    return rated.drop("n", "n_seeds"), scores.select("value", best.alias("x")).filter(F.col("x.score") >= INSTANCE_SCORE).select("value", "x.kind", "x.score")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id; ``base`` and ``spans``, arrays of (start, rank of the kind, end) in order; ``spans`` has the discovered ones too."""
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*", F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "pii")
    seen = rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    edges = seen.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    _, found = score_graph(edges)
    counts = seen.filter("seed < 0").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    found = materialise_few(found.join(counts, "value"), "found")
    extra = join_groups(seen.filter("seed < 0"), found, "value", "n").select("row", F.struct("start", F.col("kind").alias("rank"), "end").alias("s"))
    extra = extra.groupBy("row").agg(F.collect_list("s").alias("extra"))  # the spans of one text at most
    extra = materialise_few(extra, "extra")  # where it is small, Spark sees it and leaves the texts' rows where they are
    out = rows.select("row", "doc_id", "base").join(extra, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return out.select("doc_id", "base", spans.alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
