"""Text of office documents: the parts of zipped XML kinds, and rich text.

A file is told by what it holds, not by its name. Word processing gives a line for each paragraph, headings as # lines; sheets
a line for each row with | between cells; slides a paragraph block each, in order; books their chapters in reading
order. Files are read where the tasks are, one at a time; a part is read to ``MOST_BYTES`` in all at most, and parts that
declare document types or entities are refused, so neither a bomb nor a broken file costs more than its
text. What cannot be read gives null, and whether the text is any good is judged as for other extractions.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.entities import name2codepoint
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
MOST_REPEATS = 64  # of a cell that says how often it stands there
_BLOCKS = {"p", "div", "li", "tr", "pre", "blockquote", "section", "article", "br", "hr", "dt", "dd", "figcaption"}
_SILENT = {"script", "style", "head", "nav", "svg"}


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


_NAMED = re.compile(rb"&([A-Za-z][A-Za-z0-9]{1,30});")


def _numbered(m: re.Match[bytes]) -> bytes:
    """Entities that pages use by name but XML does not know, by number."""
    name = m[1].decode()
    return m[0] if name in ("amp", "lt", "gt", "quot", "apos") or name not in name2codepoint else b"&#%d;" % name2codepoint[name]


class Package:
    """A zip archive whose parts are read within one bound."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names, self.left = self.zip.namelist(), MOST_BYTES

    def part(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        with self.zip.open(name) as f:
            data = f.read(self.left + 1)
        self.left -= len(data)
        if self.left < 0 or re.search(rb"<!(DOCTYPE|ENTITY)[^>]*\[", data[:4096]) or b"<!ENTITY" in data:
            return None
        return ElementTree.fromstring(_NAMED.sub(_numbered, data))

    def numbered(self, pattern: str) -> list[str]:
        """The names that match, by their number."""
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]


def _runs(node: ElementTree.Element, text: str, paragraph: str) -> Iterator[str]:
    """What the runs below a paragraph show; a paragraph inside it (of a text box) is one of its own."""
    for child in node:
        name = _name(child)
        if name == text:
            yield child.text or ""
        elif name in ("tab", "s"):
            yield " " if name == "s" else "\t"
        elif name in ("br", "cr", "line-break"):
            yield "\n"
        elif name != paragraph:
            yield from _runs(child, text, paragraph)


def _document(package: Package) -> str:
    root = package.part("word/document.xml")
    out = []
    for p in root.iter() if root is not None else ():
        if _name(p) != "p":
            continue
        style = next((_attribute(x, "val") or "" for x in p.iter() if _name(x) == "pStyle"), "")
        level = re.fullmatch(r"(?i)(?:heading|titre|berschrift|überschrift)\s*([1-6])", style) or ("1" if style.lower() == "title" else None)
        line = "".join(_runs(p, "t", "p")).strip()
        if line:
            out.append(("#" * int(level if isinstance(level, str) else level[1]) + " " if level else "") + line)
    return "\n".join(out)


def _slides(package: Package) -> str:
    out = []
    for name in package.numbered(r"ppt/slides/slide([0-9]+)\.xml"):
        root = package.part(name)
        if root is not None:
            lines = ("".join(_runs(p, "t", "p")).strip() for p in root.iter() if _name(p) == "p")
            out.append("\n".join(x for x in lines if x))
    return "\n\n".join(x for x in out if x)


def _sheets(package: Package) -> str:
    shared = package.part("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in (shared if shared is not None else ()) if _name(s) == "si"]
    out = []
    for name in package.numbered(r"xl/worksheets/sheet([0-9]+)\.xml"):
        root = package.part(name)
        for row in root.iter() if root is not None else ():
            if _name(row) == "row":
                out.append(" | ".join(_cell(c, strings) for c in row if _name(c) == "c"))
        out.append("")
    return "\n".join(x for x in out if x.strip(" |"))


def _cell(cell: ElementTree.Element, strings: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _name(t) == "t")
    value = next((v.text or "" for v in cell if _name(v) == "v"), "")
    if kind == "s":
        return strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
    return value


def _open_document(package: Package) -> str:
    root = package.part("content.xml")
    return "\n".join(x for x in _open_lines(root) if x.strip(" |")) if root is not None else ""


def _open_lines(node: ElementTree.Element) -> Iterator[str]:
    name = _name(node)
    if name == "h":
        level = _attribute(node, "outline-level") or "1"
        yield "#" * min(6, int(level) if level.isdigit() else 1) + " " + _open_text(node)
    elif name == "p":
        yield _open_text(node)
    elif name == "table-row":
        cells = []
        for cell in node:
            if _name(cell) == "table-cell":
                times = _attribute(cell, "number-columns-repeated") or "1"
                text = " ".join(_open_lines_of(cell))
                cells += [text] * (min(MOST_REPEATS, int(times)) if times.isdigit() and text else 1)
        yield " | ".join(cells).strip(" |")
    else:
        for child in node:
            yield from _open_lines(child)


def _open_lines_of(cell: ElementTree.Element) -> list[str]:
    return [x for child in cell for x in _open_lines(child) if x]


def _open_text(node: ElementTree.Element) -> str:
    out = [node.text or ""]
    for child in node:
        name = _name(child)
        out.append({"tab": "\t", "s": " ", "line-break": "\n"}.get(name) or ("" if name in ("note", "annotation") else _open_text(child)))
        out.append(child.tail or "")
    return "".join(out)


def _book(package: Package) -> str:
    """The chapters in the order of the spine, or by name where there is none."""
    box = package.part("META-INF/container.xml")
    index = next((n.get("full-path") for n in box.iter() if _name(n) == "rootfile"), None) if box is not None else None
    root = package.part(index) if index else None
    files = []
    if root is not None:
        named = {n.get("id"): n.get("href") for n in root.iter() if _name(n) == "item"}
        files = [posixpath.normpath(posixpath.join(posixpath.dirname(index), named[n.get("idref")])) for n in root.iter() if _name(n) == "itemref" and named.get(n.get("idref"))]
    out = []
    for name in files or sorted(n for n in package.names if re.search(r"(?i)\.x?html?$", n)):
        chapter = package.part(name)
        if chapter is not None:
            lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(_page_text(chapter)).split("\n"))
            out.append("\n".join(x for x in lines if x))
    return "\n\n".join(x for x in out if x)


def _page_text(node: ElementTree.Element) -> Iterator[str]:
    name = _name(node)
    if name in _SILENT or not name:
        yield node.tail or ""
        return
    heading = re.fullmatch("h([1-6])", name)
    block = heading or name in _BLOCKS
    if block:
        yield "\n" + ("#" * int(heading[1]) + " " if heading else "")
    yield re.sub(r"\s+", " ", node.text or "")
    for child in node:
        yield from _page_text(child)
    if block:
        yield "\n"
    yield re.sub(r"\s+", " ", node.tail or "")


_RICH = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?[0-9]{1,6}) ?|\\([a-z]+)(-?[0-9]{1,10})? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object", "themedata", "datastore", "listtable", "listoverridetable", "generator"}
_SHOWN = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": " | ", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rich_text(data: bytes) -> str:
    """What a rich text file shows: groups that only describe it are left out, escapes decoded."""
    out: list[str] = []
    hidden, stack, skip, fallback = False, [], 0, 1
    for m in _RICH.finditer(data[:MOST_BYTES].decode("latin-1")):
        code, point, word, number, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, fallback))
        elif brace == "}":
            hidden, fallback = stack.pop() if stack else (False, 1)
        elif word:
            if word in _HIDDEN:
                hidden = True
            elif word == "uc":
                fallback = int(number or 1)
            elif not hidden:
                out.append(_SHOWN.get(word, ""))
        elif symbol == "*":
            hidden = True
        elif not hidden:
            if point is not None:
                value = int(point) % 65536
                out.append(chr(value) if not 0xD800 <= value < 0xE000 else "�")
                skip = fallback
            elif code is not None:
                if skip:
                    skip -= 1
                else:
                    out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
            elif symbol is not None:
                out.append({"~": "\u00a0", "_": "-", "\n": "\n"}.get(symbol, symbol if symbol in "\\{}" else ""))
            elif plain:
                out.append(plain[skip:])
                skip = max(0, skip - len(plain))
    return "\n".join(x.strip(" |") for x in "".join(out).split("\n")).strip()


def office_text_of(data: bytes) -> str | None:
    """The text of one file, null if its kind is not known or it is broken."""
    if data[:5] == b"{\\rtf":
        return rich_text(data)
    if data[:2] != b"PK":
        return None
    try:
        package = Package(data)
        kinds = (("word/document.xml", _document), ("xl/workbook.xml", _sheets), ("ppt/presentation.xml", _slides), ("META-INF/container.xml", _book), ("content.xml", _open_document))
        return next((read(package) for part, read in kinds if part in package.names), None)
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError, EOFError, ValueError, KeyError, RecursionError):
        return None


def office_text(data: Column | str) -> Column:
    """``office_text_of`` of each file."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if (own := x.as_py()) is None else office_text_of(own) for x in column], pa.string())

    return F.arrow_udf(run, "string")(data)
