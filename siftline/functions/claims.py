"""Claims, citations and numerals of markdown reports.

Line masks and claim units depend on the lines before, so they are one Arrow function over whole
files; tokens and numerals of a line are column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKET = r"\[([^\]\n]+)\](?!\()"
SOURCE = r"^S[0-9]+$"

_FENCE = re.compile(r"\s*(```|~~~)")
_QUOTE = re.compile(r"\s*>\s?")
_HEADING = re.compile(r"\s*(#{1,6})\s")
_APPENDIX = re.compile(r"\s*(#{2,6})\s+(sources|references)\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s+(?=\S)")
_RULE = re.compile(r"#{1,6}\s|([-*_])\1{2,}$")
_SEPARATOR = re.compile(r"[\s:|-]+$")


def strip_comments(text: str) -> str:
    """HTML comments become spaces; their line breaks stay, so lines keep their numbers."""
    return re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def line_kinds(lines: list[str]) -> list[str]:
    """code, hint (a quote that is labelled as a model's hint), appendix or body for each line."""
    kinds, fenced, level = ["body"] * len(lines), False, 0
    quote: list[int] = []

    def close() -> None:
        if any("[model-hint]" in lines[k].lower() for k in quote):
            for k in quote:
                if kinds[k] == "body":
                    kinds[k] = "hint"
        quote.clear()

    for i, line in enumerate(lines):
        heading = _HEADING.match(line)
        if level and heading and len(heading[1]) <= level:
            level = 0
        if not level and (appendix := _APPENDIX.match(line)):
            level = len(appendix[1])
        if level:
            kinds[i] = "appendix"
        if _FENCE.match(line):
            kinds[i], fenced = "code", not fenced
        elif fenced:
            kinds[i] = "code"
        if line.lstrip().startswith(">"):
            quote.append(i)
        else:
            close()
    close()
    return kinds


def _bare(line: str) -> str:
    return re.sub(r"`[^`\n]*`", " ", line)


def _is_separator(line: str) -> bool:
    return "|" in line and "-" in line and bool(_SEPARATOR.match(line.strip()))


def claim_units(text: str) -> list[dict]:
    """Claim units in order: prose blocks, data rows of tables, quotes, and lists with their items."""
    lines = strip_comments(text).split("\n")
    kinds = line_kinds(lines)
    bare = [_bare(x) for x in lines]
    units: list[dict] = []
    block: list[str] = []
    mode = ""

    def close() -> None:
        nonlocal mode
        if block and mode == "list":
            units.append({"kind": "list", "items": list(block)})
        elif block:
            units.append({"kind": "text", "items": [" ".join(block)]})
        block.clear()
        mode = ""

    def begin(kind: str) -> None:
        nonlocal mode
        if mode != kind:
            close()
            mode = kind

    for i, line in enumerate(bare):
        stripped = line.strip()
        if kinds[i] != "body" or not stripped or _RULE.match(stripped) or _is_separator(line):
            close()
        elif "|" in stripped and not (mode == "quote" and stripped.startswith(">")):
            close()
            below = bare[i + 1] if i + 1 < len(lines) and kinds[i + 1] != "code" else ""
            if not _is_separator(below):  # the row above a separator is a header
                cells = re.sub(r"\|$", "", re.sub(r"^\|", "", stripped)).split("|")
                units.append({"kind": "text", "items": [" ".join(c.strip() for c in cells)]})
        elif mode == "list":
            item = _ITEM.match(line)
            if item:
                block.append(line[item.end() :].strip())
            else:
                block[-1] += " " + stripped  # a continuation belongs to its item
        elif stripped.startswith(">"):
            begin("quote")
            quoted = _QUOTE.sub("", line, count=1).strip()
            if quoted:
                block.append(quoted)
        elif item := _ITEM.match(line):
            begin("list")
            block.append(line[item.end() :].strip())
        else:
            begin("prose")
            block.append(line)
    close()
    return units


_UNITS = "array<struct<kind:string,items:array<string>>>"


def units(text: Column | str) -> Column:
    """The claim units of each file."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("items", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([claim_units(t or "") for t in column.to_pylist()], type=kind)

    return F.arrow_udf(run, _UNITS)(text)


def body_lines(text: Column | str) -> Column:
    """(number, kind, line) of each line, comments blanked."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("line", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for t in column.to_pylist():
                lines = strip_comments(t or "").split("\n")
                out.append([{"n": n, "kind": k, "line": x} for n, (k, x) in enumerate(zip(line_kinds(lines), lines, strict=True))])
            yield pa.array(out, type=kind)

    return F.arrow_udf(run, "array<struct<n:int,kind:string,line:string>>")(text)


def strip_inline_code(text: Column) -> Column:
    return F.regexp_replace(text, r"`[^`\n]*`", " ")


def bracket_tokens(text: Column) -> Column:
    """What stands in brackets that open no link, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(strip_inline_code(text), F.lit(BRACKET), F.lit(1)), lambda x: F.trim(x))


def source_tokens(text: Column) -> Column:
    """Distinct ids of cited sources, in order."""
    return F.array_distinct(F.filter(bracket_tokens(text), lambda t: t.rlike(SOURCE)))


_BETWEEN = "[,\u00a0\u202f' ]"


def normalize_numerals(text: Column) -> Column:
    """Without the separators between digits."""
    return F.regexp_replace(text, rf"([0-9]){_BETWEEN}(?=[0-9])", "$1")


def numerals(text: Column) -> Column:
    """Distinct specific numerals, at most eight: two digits or more, or a decimal point; those of links and tokens do not count."""
    clean = F.regexp_replace(strip_inline_code(text), r"\[([^\]]+)\]\([^)]*\)", "$1")
    clean = F.regexp_replace(clean, r"\[[^\]\n]+\](?!\()", " ")
    found = F.regexp_extract_all(clean, F.lit("[0-9][0-9,\u00a0\u202f']*(?:\\.[0-9]+)?%?"), F.lit(0))
    plain = F.transform(found, lambda n: F.regexp_replace(n, "[,\u00a0\u202f'%]", ""))
    good = F.filter(plain, lambda n: (F.length(F.regexp_replace(n, "[^0-9]", "")) >= 2) | n.contains("."))
    return F.slice(F.array_distinct(good), 1, 8)


def claim_words(unit: Column) -> Column:
    """Words with two letters or digits in a row, tokens and markup left out."""
    clean = F.regexp_replace(unit, r"\[[^\]\n]+\](?!\()", " ")
    clean = F.regexp_replace(clean, r"\[([^\]]+)\]\([^)]*\)", "$1")
    clean = F.regexp_replace(clean, "[#>*`_~|]", " ")
    return F.size(F.filter(F.split(clean, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]{2,}")))
