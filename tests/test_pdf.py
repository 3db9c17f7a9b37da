import random
import time
import zlib

from siftline.sources import pdf

MAP = b"""begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar
2 beginbfrange <0010> <0013> <0061> <0020> <0021> [<00E9> <D83DDE00>] endbfrange endcmap"""


def stream(body, deflate=True, more=b""):
    data = zlib.compress(body) if deflate else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if deflate else b"", more, data)


def made(objects, packed=()):
    out = b"%PDF-1.5\n"
    if packed:
        bodies, head, at = b"", [], 0
        for n, body in packed:
            head.append(b"%d %d" % (n, len(bodies)))
            bodies += body + b" "
        index = b" ".join(head) + b" "
        objects = [*objects, (90, stream(index + bodies, more=b"/Type /ObjStm /N %d /First %d" % (len(packed), len(index))))]
    return out + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>")]
TWO = [(3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"), (4, b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 9 0 R] >>")]
FONTS = [(7, b"<< /Type /Font /ToUnicode 10 0 R >>"), (8, b"<< /Type /Font /BaseFont /Helvetica >>")]
CONTENT = [
    (5, stream(b"BT /F2 12 Tf 72 700 Td (last \\(page\\)) Tj 0 -14 Td (caf\\351 \\\nx) Tj ET")),
    (6, stream(b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <00010010 0011> Tj [<0002> -20 <0012> -400 <0020>] TJ")),
    (9, stream(b"0 -14 Td <0021> Tj /F2 9 Tf (A) ' ET", deflate=False)),
    (10, stream(MAP)),
]


def test_maps_hex_strings_and_order():
    want = "Habfic é\n😀\nA\nlast (page)\ncafé x"
    assert pdf.pdf_text_of(made(PAGES + TWO + FONTS + CONTENT)) == want
    assert pdf.pdf_text_of(made(CONTENT, PAGES + TWO + FONTS)) == want  # the same from an object stream


def test_files_without_pages_encrypted_and_broken():
    assert pdf.pdf_text_of(b"%PDF\nstream\nBT (loose) Tj ET\nendstream") == "loose"
    whole = made(PAGES + TWO + FONTS + CONTENT)
    assert pdf.pdf_text_of(whole.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R")) == ""
    assert pdf.pdf_text_of(b"") == "" and pdf.pdf_text_of(b"not a pdf") == ""
    rng = random.Random(3)
    for _ in range(150):
        cut = bytearray(whole)
        for _ in range(rng.randrange(1, 8)):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        assert isinstance(pdf.pdf_text_of(bytes(cut[: rng.randrange(len(cut))])), str)


def test_cycles_and_long_content():
    loop = [(1, b"<< /Type /Pages /Kids [2 0 R 1 0 R] /Parent 1 0 R >>"), (2, b"<< /Type /Page /Parent 2 0 R /Contents 3 0 R >>"), (3, stream(b"BT (in a loop) Tj ET"))]
    assert pdf.pdf_text_of(made(loop)) == "in a loop"
    began = time.time()
    for body in (b"BT " + b"(word) Tj 0 -1 Td " * 60_000 + b"ET", b"BT " + b"(" * 100_000, b"BT [" + b"(a) -300 " * 60_000 + b"] TJ ET", b"<" * 100_000):
        pdf.pdf_text_of(made([(1, b"<< /Type /Page /Contents 2 0 R >>"), (2, stream(body))]))
    assert time.time() - began < 30
