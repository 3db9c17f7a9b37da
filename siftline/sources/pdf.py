"""The text that the pages of a PDF show.

Objects are found by their marks, those in object streams too. The content of each page is read in order with the fonts of its
resources: strings are literal or hexadecimal and are decoded by the font's ToUnicode map, where it has one. Lines
follow from moves of the text position, words from wide gaps in shown arrays. Streams are inflated to ``MOST_BYTES`` in all at
most. Encrypted or image-only files give no text; whether what is given is any good is judged afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
MOST_RANGE = 1 << 16
GAP = -180  # thousandths of the font size that count as a blank

_OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})\s+[0-9]{1,5}\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"([0-9]{1,10})\s+[0-9]{1,5}\s+R\b")
_FONT_ENTRY = re.compile(rb"/([^\s/<>\[\]()]+)\s+([0-9]{1,10})\s+[0-9]{1,5}\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+[0-9*]?", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class _Pdf:
    def __init__(self, data: bytes):
        self.left = MOST_BYTES
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)
        self.maps: dict[int, tuple[int, dict[int, str]] | None] = {}

    def _unpack(self, body: bytes) -> None:
        first = re.search(rb"/First\s+([0-9]+)", body)
        data = self.stream(body)
        if not first:
            return
        head = [int(x) for x in data[: int(first[1])].split() if x.isdigit()]
        places = list(zip(head[::2], head[1::2]))
        for (number, at), (_, end) in zip(places, [*places[1:], (0, len(data))]):
            self.objects.setdefault(number, data[int(first[1]) + at : (int(first[1]) + end) if end < len(data) else len(data)])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m or self.left <= 0:
            return b""
        data = m[1]
        if re.search(rb"/FlateDecode|/Fl\b", body[: m.start()]) or not data[:1].isascii():
            try:
                data = zlib.decompressobj().decompress(data, self.left)
            except zlib.error:
                data = m[1]
        self.left -= len(data)
        return data

    def entry(self, body: bytes, name: bytes) -> bytes:
        """What stands behind a name: a dictionary or array, or the object that it refers to."""
        m = re.search(rb"/" + name + rb"\b\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        reference = _REFERENCE.match(rest)
        if reference:
            return self.objects.get(int(reference[1]), b"")
        if rest[:2] != b"<<":
            return rest[: rest.find(b"]") + 1] if rest[:1] == b"[" else rest[:64]
        depth = 0
        for x in re.finditer(rb"<<|>>", rest):
            depth += 1 if x.group() == b"<<" else -1
            if not depth:
                return rest[: x.end()]
        return rest

    def inherited(self, body: bytes, name: bytes) -> bytes:
        for _ in range(16):
            found = self.entry(body, name)
            if found:
                return found
            body = self.entry(body, b"Parent")
        return b""

    def fonts(self, resources: bytes) -> dict[bytes, int]:
        return {name: int(n) for name, n in _FONT_ENTRY.findall(self.entry(resources, b"Font"))}

    def unicode_map(self, font: int | None) -> tuple[int, dict[int, str]] | None:
        """Bytes of a code, and the text of each."""
        if font is None:
            return None
        if font not in self.maps:
            self.maps[font] = _read_map(self.stream(self.entry(self.objects.get(font, b""), b"ToUnicode")))
        return self.maps[font]

    def pages(self) -> Iterator[tuple[list[bytes], dict[bytes, int]]]:
        """Contents and fonts of each page, in the order of the tree."""
        done: set[int] = set()
        kids = {n: body for n, body in self.objects.items() if re.search(rb"/Type\s*/Pages?\b", body)}
        below = {int(x) for body in kids.values() for x in _REFERENCE.findall(self.entry(body, b"Kids"))}
        stack = sorted((n for n in kids if n not in below), reverse=True)
        while stack:
            n = stack.pop()
            body = kids.get(n)
            if body is None or n in done:
                continue
            done.add(n)
            if re.search(rb"/Type\s*/Pages\b", body):
                stack += [int(x) for x in reversed(_REFERENCE.findall(self.entry(body, b"Kids")))]
                continue
            m = re.search(rb"/Contents\s*(\[[^\]]*\]|[0-9]+\s+[0-9]+\s+R)", body)
            parts = [self.objects.get(int(x), b"") for x in _REFERENCE.findall(m[1])] if m else []
            yield parts, self.fonts(self.inherited(body, b"Resources"))


def _read_map(data: bytes) -> tuple[int, dict[int, str]] | None:
    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", data)
    if not space:
        return None
    found: dict[int, str] = {}

    def text(x: bytes) -> str:
        return bytes.fromhex(x.decode()[: len(x) // 4 * 4]).decode("utf-16-be", "replace") if len(x) >= 4 else chr(int(x or b"0", 16))

    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            found[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for lo, hi, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            first, last = int(lo, 16), min(int(hi, 16), int(lo, 16) + MOST_RANGE)
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            start = text(one) if one else ""
            for k, code in enumerate(range(first, last + 1)):
                if listed:
                    if k < len(listed):
                        found[code] = text(listed[k])
                elif start and ord(start[-1]) + k < 0x110000:
                    found[code] = start[:-1] + chr(ord(start[-1]) + k)
    return max(1, len(space[1]) // 2), found


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1])


def _shown(content: bytes, pdf: _Pdf, fonts: dict[bytes, int]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    own: tuple[int, dict[int, str]] | None = None

    def decoded(raw: bytes) -> str:
        if own is None:
            return raw.decode("cp1252", "replace") if raw[:2] != b"\xfe\xff" else raw[2:].decode("utf-16-be", "replace")
        width, table = own
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    for m in _TOKEN.finditer(content):
        token = m.group()
        if token[:1] in b"(<[]/+-.0123456789":
            held.append(token)
            continue
        if token == b"Tf":
            name = next((x for x in reversed(held) if x[:1] == b"/"), b"/")
            own = pdf.unicode_map(fonts.get(name[1:]))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in b"(<":
                    out.append(decoded(_string(x)))
                elif token == b"TJ" and x[:1] not in b"[]/" and float(x) < GAP:
                    out.append(" ")
        elif token in (b"T*", b"Tm", b"ET") or token in (b"Td", b"TD") and held[-1:] and held[-1] not in (b"0", b"0.0"):
            out.append("\n")
        elif token in (b"Td", b"TD"):
            out.append(" ")
        held = []
    return "".join(out)


def pdf_text_of(data: bytes) -> str:
    """The text of all pages; of files without a page tree, of all streams that show text."""
    pdf = _Pdf(data)
    if re.search(rb"/Encrypt\b", data):
        return ""
    pages = [_shown(b"\n".join(pdf.stream(p) for p in parts), pdf, fonts) for parts, fonts in pdf.pages()]
    if not any(p.strip() for p in pages):
        bodies = list(pdf.objects.values()) or [data]
        every = {name: n for body in bodies for name, n in pdf.fonts(body).items()}
        streams = [pdf.stream(m.group()) for m in re.finditer(rb"(?:<<.{0,512}?>>\s*)?stream\r?\n.*?endstream", data, re.S)]
        pages = [_shown(x, pdf, every) for x in streams if re.search(rb"\bBT\b", x)]
    lines = (re.sub(r"[ \t]+", " ", line).strip() for page in pages for line in page.split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_text(data: Column | str) -> Column:
    """``pdf_text_of`` of each file."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([pdf_text_of(x.as_py() or b"") for x in column], pa.string())

    return F.arrow_udf(run, "string")(data)
