"""Expressions of ``siftline.functions`` in DuckDB's dialect, for the queries' reference SQL."""

from __future__ import annotations

from siftline.functions.html import ENTITIES, JUNK
from siftline.functions.text import ACCENTED, PLAIN, STOPWORDS


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STOP = "(" + ", ".join(q(w) for w in STOPWORDS) + ")"


def fold(t: str) -> str:
    """Plural folding of a plain term; ``t`` is a name."""
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '([sxz]|[cs]h)es$') THEN {t}[:-3] "
        f"WHEN length({t}) > 3 AND {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {t}[:-2] ELSE {t} END"
    )


def plain(t: str) -> str:
    return f"translate(lower({t}), {q(ACCENTED)}, {q(PLAIN)})"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def tokens(x: str) -> str:
    kept = f"list_filter({words(x)}, lambda t: length(t) >= 2 AND lower(t) NOT IN {STOP})"
    return f"list_filter(list_transform(list_transform({kept}, lambda t: {plain('t')}), lambda t: {fold('t')}), lambda t: length(t) >= 2)"


def keywords(x: str) -> str:
    """Distinct by lower case, first spelling kept."""
    kept = f"list_filter({words(x)}, lambda t: length(t) >= 2 AND lower(t) NOT IN {STOP})"
    return f"list_filter({kept}, lambda t, i: list_position(list_transform({kept}, lambda u: lower(u)), lower(t)) = i)"


def domain(url: str) -> str:
    host = f"lower(regexp_replace(regexp_replace(regexp_extract(trim({url}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
    return f"regexp_replace({host}, '^www\\.', '')"


def canonical(url: str) -> str:
    scheme = f"lower(regexp_extract(trim({url}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    port = f"regexp_extract(trim({url}), '^[^/]*//[^/?#]*:([0-9]+)([/?#]|$)', 1)"
    path = f"regexp_replace(regexp_extract(trim({url}), '^[^/]*//[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = f"regexp_extract(trim({url}), '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(url_decode(regexp_extract(p, '^([^=]*)', 1)), '(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_src$|ref_url$|spm$|_hsenc$|_hsmi$|igshid$)'))"
    named = f"list_sort(list_transform({pairs}, lambda p, i: {{'k': url_decode(regexp_extract(p, '^([^=]*)', 1)), 'i': i, 'v': url_decode(regexp_extract(p, '^[^=]*=?(.*)$', 1))}}))"
    search = f"array_to_string(list_transform({named}, lambda p: url_encode(p.k) || '=' || url_encode(p.v)), '&')"
    return (
        f"regexp_replace({scheme} || '://' || {domain(url)} || CASE WHEN {port} <> '' AND NOT ({scheme} = 'http' AND {port} = '80') AND NOT ({scheme} = 'https' AND {port} = '443') THEN ':' || {port} ELSE '' END "
        f"|| {path} || CASE WHEN {search} <> '' THEN '?' || {search} ELSE '' END, '/$', '')"
    )


def entities(x: str) -> str:
    for name, value in ENTITIES.items():
        x = f"replace({x}, {q(f'&{name};')}, {q(value)})"
    return x


def html_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    # no back-references: an element ends at its own closing tag, so each name is taken out by itself
    for name in ("script", "style", "noscript", "head", "nav", "footer", "svg", "template"):
        x = f"regexp_replace({x}, '(?is)<{name}.*?</{name}>', ' ', 'g')"
    for level in range(1, 7):
        x = f"regexp_replace({x}, '(?i)<h{level}(\\s[^>]*)?>', chr(10) || '{'#' * level} ', 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|section|article|li|tr|h[1-6]|pre|blockquote|br)>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)<(br|hr)\\s*/?>', chr(10), 'g')"
    x = entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))"


def _seen(x: str) -> str:
    return f"length(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))"


def main_html(html: str) -> str:
    """The main region of a page with one article at most."""
    own = f"nullif(regexp_extract({html}, '(?is)<article\\b[^>]*>(.*)</article', 1), '')"
    return f"CASE WHEN {own} IS NULL OR ({_seen(own)} < 500 AND {_seen(own)} < 0.3 * {_seen(html)}) THEN {html} ELSE {own} END"


def junk(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(substr(trim({x}), 1, 800), {q('(?i)' + p)}) THEN {q(r)}" for p, r in JUNK)
    return f"CASE WHEN length(trim({x})) >= 2000 THEN NULL {cases} END"


def identifiers(x: str) -> str:
    b, e = r"\b", r"\b"
    patterns = [
        rf"{b}v?[0-9]+(?:\.[0-9]+){{1,}}{e}", rf"{b}10\.[0-9]{{4,}}/\S+", rf"{b}[0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?{e}",
        rf"{b}[a-z]+(?:[A-Z][a-z0-9]+)+{e}", rf"{b}[A-Za-z]+_[A-Za-z0-9_]+{e}", rf"{b}[0-9]{{3,}}{e}",
    ]
    found = [f"regexp_extract_all({x}, {q(p)})" for p in patterns] + [f"regexp_extract_all({x}, {q(chr(34) + '([^' + chr(34) + chr(92) + 'n]{3,})' + chr(34))}, 1)"]
    every = f"list_filter(list_transform(flatten([{', '.join(found)}]), lambda v: trim(v)), lambda v: v <> '')"
    return f"list_filter({every}, lambda v, i: list_position({every}, v) = i)"


def numerals(x: str) -> str:
    clean = f"regexp_replace({x}, '`[^`\\n]*`', ' ', 'g')"
    clean = f"regexp_replace({clean}, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g')"
    clean = f"regexp_replace({clean}, '\\[[^\\]\\n]+\\]', ' ', 'g')"
    found = f"regexp_extract_all({clean}, '[0-9][0-9,\u00a0\u202f'']*(?:\\.[0-9]+)?%?')"
    bare = f"list_transform({found}, lambda n: regexp_replace(n, '[,\u00a0\u202f''%]', '', 'g'))"
    good = f"list_filter({bare}, lambda n: length(regexp_replace(n, '[^0-9]', '', 'g')) >= 2 OR contains(n, '.'))"
    return f"list_filter({good}, lambda n, i: list_position({good}, n) = i)[1:8]"
