import io
import random
import zipfile

import pytest

from siftline.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
O = 'xmlns:office="o" xmlns:text="t" xmlns:table="b"'  # noqa: E741


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    def p(text, style=""):
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r>{text}</w:r></w:p>'

    body = p("<w:t>Rates</w:t>", "Title") + p("<w:t>Limits</w:t>", "Heading2") + p('<w:t xml:space="preserve">A </w:t><w:t>bucket</w:t><w:tab/><w:t>fills</w:t><w:br/><w:t>slowly &amp; steadily</w:t>') + p("")
    table = "<w:tbl><w:tr><w:tc>" + p("<w:t>cell</w:t>") + "</w:tc></w:tr></w:tbl>"
    box = "<w:p><w:r><w:t>outer</w:t></w:r><w:r><w:txbxContent>" + p("<w:t>inner</w:t>") + "</w:txbxContent></w:r></w:p>"
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}{table}{box}</w:body></w:document>", "word/styles.xml": "<x/>"})


def xlsx():
    shared = f"<sst {S}><si><t>name</t></si><si><r><t>to</t></r><r><t>tal</t></r></si></sst>"
    one = f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>tea</t></is></c><c><v>42.5</v></c><c t="s"><v>9</v></c></row></sheetData></worksheet>'
    ten, two = (f"<worksheet {S}><sheetData><row><c><v>{n}</v></c></row></sheetData></worksheet>" for n in (10, 2))
    return packed({"xl/workbook.xml": "<x/>", "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": one, "xl/worksheets/sheet10.xml": ten, "xl/worksheets/sheet2.xml": two})


def pptx():
    slide = lambda *lines: f"<p {A}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p>"
    return packed({"ppt/presentation.xml": "<x/>", "ppt/slides/slide2.xml": slide("second"), "ppt/slides/slide10.xml": slide("tenth"), "ppt/slides/slide1.xml": slide("first", "", "more")})


def odt():
    body = '<text:h text:outline-level="2">Part</text:h><text:p>One<text:tab/>two<text:s/>three<text:note>no</text:note> <text:span>four</text:span></text:p><text:p/>'
    row = '<table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>b</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"/></table:table-row>'
    return packed({"mimetype": "x", "content.xml": f"<office:document {O}><office:body>{body}<table:table>{row}</table:table></office:body></office:document>"})


def epub():
    box = '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
    opf = '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="text/a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="none"/></spine></package>'
    page = '<!DOCTYPE html PUBLIC "x" "y"><html><head><title>no</title></head><body><h1>Start&nbsp;here</h1><p>It  <b>was</b>\nso.</p><script>no</script><ul><li>one</li><li>two</li></ul></body></html>'
    return packed({"META-INF/container.xml": box, "OEBPS/book.opf": opf, "OEBPS/b.xhtml": "<html><body><p>End &eacute;</p></body></html>", "OEBPS/text/a.xhtml": page})


RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator X;}\f0 Caf\'e9 \b bold\b0\par Z\u252?rich \'80 \{x\}\~y\par{\pict 0011}a\cell b\row}"

WANT = {
    "docx": "# Rates\n## Limits\nA bucket\tfills\nslowly & steadily\ncell\nouter\ninner",
    "xlsx": "name | total\ntea | 42.5 | \n2\n10",
    "pptx": "first\nmore\n\nsecond\n\ntenth",
    "odt": "## Part\nOne\ttwo three four\na | b | b",
    "epub": "# Start here\nIt was so.\none\ntwo\n\nEnd é",
    "rtf": "Café bold\nZürich € {x}\u00a0y\na | b",
}
MADE = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt, "epub": epub, "rtf": lambda: RTF}


@pytest.mark.parametrize("kind", sorted(MADE))
def test_text_of_each_kind(kind):
    assert office.office_text_of(MADE[kind]()) == WANT[kind]


def test_broken_and_foreign_files_give_none(monkeypatch):
    rng = random.Random(1)
    for kind in sorted(MADE):
        whole = MADE[kind]()
        for _ in range(30):
            cut = bytearray(whole[: rng.randrange(1, len(whole))]) if rng.random() < 0.5 else bytearray(whole)
            for _ in range(rng.randrange(4)):
                cut[rng.randrange(len(cut))] = rng.randrange(256)
            found = office.office_text_of(bytes(cut))
            assert found is None or isinstance(found, str)
    assert office.office_text_of(b"") is None and office.office_text_of(b"PK") is None and office.office_text_of(b"%PDF") is None
    assert office.office_text_of(packed({"other.xml": "<x/>"})) is None
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]>' + f"<w:document {W}><w:p><w:r><w:t>&b;</w:t></w:r></w:p></w:document>"
    assert office.office_text_of(packed({"word/document.xml": bomb})) == ""
    monkeypatch.setattr(office, "MOST_BYTES", 1000)
    assert office.office_text_of(packed({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>{'x' * 5000}</w:t></w:r></w:p></w:document>"})) == ""


def test_files_of_a_folder(spark, tmp_path):
    for kind, make in MADE.items():
        (tmp_path / f"a.{kind}").write_bytes(make())
    (tmp_path / "broken.docx").write_bytes(docx()[:200])
    (tmp_path / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0")
    (tmp_path / "page.html").write_text("<html><head><title>T</title></head><body><nav>menu</nav><article><p>" + "words of the article " * 40 + "</p></article><div>boilerplate</div></body></html>")
    rows = {r.url.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in rows.items() if k.startswith("a.")} == {f"a.{k}": v for k, v in WANT.items()}
    assert all(r.refused is None for k, r in rows.items() if k.startswith("a."))
    assert rows["a.docx"].title == "Rates" and rows["old.doc"].refused == "unsupported format" and rows["broken.docx"].refused and rows["broken.docx"].text is None
    assert "boilerplate" not in rows["page.html"].text and "menu" not in rows["page.html"].text and rows["page.html"].title == "T"
