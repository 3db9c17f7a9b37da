"""Keyword and text functions on columns. All but the planners stay in the JVM; folded terms are in ``terms``."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, English then French.
STOPWORDS = """the a an is are was were be been being do does did how what why when where which who whom this that these
those of in on to for with and or but if then else than as at by from into about it its i you we they he she there here can
could should would will shall may might must have has had not no yes so such only any some all get set use used using work
works working handle handled happen happens default value values please explain tell me my our
le la les de des du un une est sont que qui quoi quel quelle quels quelles pour dans avec entre sur par pas plus et ou où ce
cette ces se sa son ses leur leurs comment pourquoi quand fait faire peut doit être avoir il elle nous vous ils elles au aux
si ne""".split()

# Letters that count as their base letter although they have no decomposition.
_UNDECOMPOSED = {"đ": "d", "ı": "i", "ł": "l", "ø": "o", "ŧ": "t", "ŀ": "l"}


def _accents() -> tuple[str, str]:
    """Characters with one base letter below their marks, and those letters."""
    pairs = dict(_UNDECOMPOSED)
    for code in range(0x80, 0x3000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if len(plain) == 1 and plain != c:
            pairs.setdefault(c, plain)
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
WORD = r"[\p{L}\p{N}_]+"


def deaccent(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def is_stopword(term: Column) -> Column:
    return F.lower(term).isin(STOPWORDS)


def fold_plural(term: Column) -> Column:
    n = F.length(term)
    return (
        F.when((n > 4) & term.endswith("ies"), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & term.rlike("([sxz]|[cs]h)es$"), F.substring(term, F.lit(1), n - 2))
        .when((n > 3) & term.endswith("s") & ~term.rlike("(ss|us|is)$"), F.substring(term, F.lit(1), n - 1))
        .otherwise(term)
    )


def fold_term(raw: Column) -> Column:
    """Lower case without accents and plural endings; two steps, so that the first is evaluated once."""
    return F.get(F.transform(F.array(deaccent(F.lower(raw))), fold_plural), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def once(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_of_each(items: Column, key=F.lower) -> Column:
    """Items whose key no earlier item has, in order. For short arrays: it compares all with all."""
    return once(items, lambda own: once(F.transform(own, key), lambda keys: F.filter(own, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def keywords(text: Column) -> Column:
    """Distinct words (by lower case) with two characters that are no stopwords, in their own spelling."""
    return first_of_each(F.filter(words(text), lambda t: (F.length(t) >= 2) & ~is_stopword(t)))


def ranked_keywords(text: Column) -> Column:
    """Keywords by how distinctive they look: digits, inner capitals, underscores, length; ties in order."""
    return _ranked(keywords(text))


def _ranked(words: Column) -> Column:
    def weight(k: Column) -> Column:
        return (
            F.when(k.rlike("[0-9]"), 3.0).otherwise(0.0)
            + F.when(k.rlike("[A-Z]") & ~k.rlike("^[A-Z0-9]+$"), 2.0).otherwise(0.0)
            + F.when(k.contains("_"), 2.0).otherwise(0.0)
            + F.when(F.length(k) >= 8, 1.5).when(F.length(k) >= 5, 0.5).otherwise(0.0)
        )

    ordered = F.array_sort(F.transform(words, lambda k, i: F.struct((-weight(k)).alias("w"), i.alias("i"), k.alias("k"))))
    return F.transform(ordered, lambda x: x["k"])


# ASCII word borders, whatever the runtime's idea of \b
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
IDENTIFIERS = (
    (rf"{_B}v?[0-9]+(?:\.[0-9]+){{1,}}{_E}", 0),
    (rf"{_B}10\.[0-9]{{4,}}/\S+", 0),
    (rf"{_B}[0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?{_E}", 0),
    (rf"{_B}[a-z]+(?:[A-Z][a-z0-9]+)+{_E}", 0),
    (rf"{_B}[A-Za-z]+_[A-Za-z0-9_]+{_E}", 0),
    (rf"{_B}[0-9]{{3,}}{_E}", 0),
    (r'"([^"\n]{3,})"', 1),
)


def identifiers(text: Column) -> Column:
    """Versions, DOIs, arXiv ids, camelCase, snake_case, numbers of three digits, quoted spans: distinct, by kind."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p, group in IDENTIFIERS]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), lambda x: F.trim(x)), lambda x: x != ""))


def plan_variants(question: Column, depth: str) -> Column:
    """Query variants of a question: itself, ranked keywords, identifiers, a quoted phrase, head word with identifiers."""
    most = {"summary": 1, "standard": 2, "deep": 3}[depth]
    base = F.trim(question)

    def variants(ids: Column, kw: Column) -> Column:
        return F.array(
            base,
            F.array_join(F.slice(_ranked(kw), 1, 8), " "),
            F.array_join(ids, " "),
            F.when(F.size(kw) >= 2, F.concat(F.lit('"'), F.array_join(F.slice(kw, 1, 4), " "), F.lit('"'))),
            F.when((F.size(ids) > 0) & (F.size(kw) > 0), F.concat_ws(" ", F.get(kw, F.lit(0)), F.array_join(ids, " "))),
        )

    candidates = once(identifiers(question), lambda ids: once(keywords(question), lambda kw: variants(ids, kw)))
    found = F.slice(first_of_each(F.filter(candidates, lambda v: v.isNotNull() & (v != ""))), 1, most)
    return once(found, lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(base)))


def subtokens(raw: Column) -> Column:
    """Parts of a compound name in lower case: at least three characters, no stopwords, at most four."""
    spaced = raw
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    parts = F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    good = F.filter(F.transform(parts, F.lower), lambda p: (F.length(p) >= 3) & ~is_stopword(p))
    return F.when(F.size(parts) >= 2, F.slice(F.array_distinct(good), 1, 4)).otherwise(F.array().cast("array<string>"))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), "^https?://", "")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    out = F.substring(out, 1, 80)
    return F.when(out == "", "run").otherwise(out)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_from_text(text: Column) -> Column:
    """The leading heading, else the first paragraph that is no bibliographic line, at most 200 characters."""
    paragraphs = F.split(text, r"\n\s*\n", -1)
    heading = F.trim(F.regexp_extract(F.get(paragraphs, F.lit(0)), r"(?m)^\s*#{1,6}\s+(.+?)\s*#*\s*$", 1))
    clean = F.filter(F.transform(paragraphs, squeeze), lambda p: p != "")
    lead = F.get(clean, F.lit(0))
    record = lead.rlike(r"^\d+\.\s") & lead.rlike(r"(?i)\bdoi:|\bepub\b|\d{4}\s+\w{3}\b")
    pick = F.when(record, F.coalesce(F.get(clean, F.lit(1)), lead)).otherwise(lead)
    return F.when(heading != "", F.substring(heading, 1, 200)).otherwise(F.coalesce(F.substring(pick, 1, 200), F.lit("")))


def heading_lines(text: Column) -> Column:
    own = F.array_join(F.filter(F.split(text, "\n", -1), lambda l: l.rlike(r"^#{1,6}\s")), "\n")
    return F.when(~text.contains("#"), "").otherwise(own)  # most texts have none, and are not split for it


EXTRACT_CAPS = {"summary": 4000, "standard": 8000, "deep": None}


def cap_extract(text: Column, depth: str) -> Column:
    """The first characters of a text, cut at its last line break if that stands behind 60 % of them."""
    cap = EXTRACT_CAPS[depth]
    if cap is None:
        return text
    head = F.substring(text, 1, cap)
    last = F.length(head) - F.instr(F.reverse(head), "\n")  # characters before the last line break
    has = F.instr(head, "\n") > 0
    cut = F.when(has & (last > cap * 0.6), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(cut, F.lit("\n\n… [truncated]")))


# --- sentences that answer a question -------------------------------------------------------------


def _split(raw: str) -> list[str]:
    return re.findall(r"\w+", raw)


_TO_PLAIN = str.maketrans(ACCENTED, PLAIN)


def _deaccent(text: str) -> str:
    return text.translate(_TO_PLAIN)


def _fold_plural(t: str) -> str:
    if len(t) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if len(t) > 4 and re.search("(?:[sxz]|[cs]h)es$", t):
        return t[:-2]
    return t[:-1] if len(t) > 3 and t.endswith("s") and not re.search("(?:ss|us|is)$", t) else t


def query_tokens(question: str) -> list[str]:
    """The distinct folded terms of a question, on the driver."""
    folded = [_fold_plural(_deaccent(w.lower())) for w in _split(question) if len(w) >= 2 and w.lower() not in STOPWORDS]
    return list(dict.fromkeys(t for t in folded if len(t) >= 2))


def query_patterns(question: str, most: int = 8) -> dict[str, str]:
    """canonical term: pattern over lower-cased text without accents; at most ``most`` terms."""
    out: dict[str, str] = {}
    for word in _split(question):
        low = word.lower()
        if len(word) < 2 or low in STOPWORDS:
            continue
        plain = _deaccent(low)
        term = _fold_plural(plain)
        if term in out or len(out) >= most:
            continue
        forms = [plain, term] + ([plain[:-1]] if len(plain) > 4 and plain.endswith("ies") else [])
        pieces = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", word)
        if len(pieces) >= 2:
            forms += [p.lower() for p in pieces if len(p) >= 3 and p.lower() not in STOPWORDS][:4]
        out[term] = "|".join(re.escape(f) for f in dict.fromkeys(forms))
    return out


def matched(text: Column, patterns: dict[str, str]) -> Column:
    """How many of the terms occur in a text as substrings."""
    plain = deaccent(F.lower(text))
    return sum((plain.rlike(p).cast("int") for p in patterns.values()), F.lit(0))


def content_coverage(text: Column, question: str) -> Column:
    patterns = query_patterns(question)
    if not patterns:
        return F.lit(0.0)
    return F.coalesce(matched(text, patterns) / F.lit(float(len(patterns))), F.lit(0.0))


def top_sentences(text: Column, question: str, sentences: int = 3, characters: int = 360) -> Column:
    """The sentences with most terms of the question, in the order of the text, behind their nearest heading."""
    patterns = query_patterns(question)
    lines = F.split(text, "\n", -1)
    fences = F.transform(lines, lambda l: l.rlike(r"^\s*(```|~~~)"))

    def of_line(line: Column, i: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, r"(?<=[.!?])\s+", -1), lambda x: F.trim(x)), lambda s: F.length(s) >= 20)
        return F.transform(parts, lambda s, j: F.struct(i.alias("line"), j.alias("j"), s.alias("text"), matched(s, patterns).alias("score")))

    every = F.flatten(F.filter(F.transform(lines, lambda l, i: F.when(~l.rlike(r"^#{1,6}\s"), of_line(l, i))), lambda x: x.isNotNull()))
    hits = F.filter(every, lambda s: s["score"] > 0)
    pool = F.when(F.size(hits) > 0, hits).otherwise(every)
    best = F.slice(F.array_sort(F.transform(pool, lambda s: F.struct((-s["score"]).alias("a"), s["line"].alias("line"), s["j"].alias("j"), s["text"].alias("text")))), 1, sentences)
    chosen = F.array_sort(F.transform(best, lambda s: F.struct(s["line"].alias("line"), s["j"].alias("j"), s["text"].alias("text"))))
    inside = F.aggregate(
        F.slice(lines, F.lit(1), F.get(chosen, F.lit(0))["line"] + 1),
        F.struct(F.lit(False).alias("fence"), F.lit(None).cast("string").alias("heading")),
        lambda a, l: F.struct(
            F.when(l.rlike(r"^\s*(```|~~~)"), ~a["fence"]).otherwise(a["fence"]).alias("fence"),
            F.when(~a["fence"] & l.rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_extract(l, r"^#{1,6}\s+(.+?)\s*#*\s*$", 1))).otherwise(a["heading"]).alias("heading"),
        ),
        lambda a: a["heading"],
    )
    body = F.array_join(F.transform(chosen, lambda s: s["text"]), " ")
    full = F.when(inside.isNotNull() & ~body.startswith(inside), F.concat(inside, F.lit(" — "), body)).otherwise(body)
    start = F.trim(F.substring(F.array_join(F.slice(lines, 1, 4), " "), 1, characters))
    return F.when(F.size(every) > 0, F.trim(F.substring(full, 1, characters))).otherwise(start)


def since(value: str | None) -> Column:
    """The time that a ``since`` option names; null if it names none. Four digits are the start of a year."""
    if value is None:
        return F.lit(None).cast("timestamp")
    return F.try_to_timestamp(F.lit(f"{value}-01-01" if len(value) == 4 else value))
