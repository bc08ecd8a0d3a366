import io
import json
import zipfile

from estateloom.sources import files as S

SHEET = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>vcpu</t></is></c></row>'
    '<row r="3"><c r="A3"><v>7</v></c><c r="C3"><v>9.5</v></c><c r="D3"><f>A3*2</f></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
)
BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Hid" sheetId="2" state="hidden" r:id="rId1"/></sheets></workbook>'
)


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook() -> bytes:
    return zipped(
        {
            "xl/workbook.xml": BOOK, "xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>host</t></si></sst>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        }
    )


def document() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("")}</w:tr><w:tr>{cell("b")}{cell("c")}</w:tr></w:tbl></w:body></w:document>'})


def test_all_formats_and_gaps(spark, tmp_path):
    for name, content in {
        "a.csv": "﻿host;vcpu\n\nx;4\n".encode(), "b.json": json.dumps({"meta": 1, "inv": {"assets": [{"name": "x", "v": 1}, {"name": None, "w": True}]}}).encode(), "bad.json": b"{", "c.md": b"t\n| a | b |\n|--|--|\n| 1 | 2 |\n",
        "d.xlsx": workbook(), "e.docx": document(), "f.pdf": b"%PDF", "empty.txt": b"  ", "g.zip": zipped({"app/x.csv": "a,b\n1,2\n", "node_modules/y.csv": "a,b"}), "evil.zip": zipped({"../x.csv": "a"}),
    }.items():
        (tmp_path / name).write_bytes(content)
    rows = {}
    gaps = {}
    for r in S.grid(S.scan(spark, str(tmp_path))).collect():
        name = r.path.rsplit("/", 1)[1] if "!" not in r.path else r.path.split("/")[-2] + "/" + r.path.rsplit("/", 1)[1]
        if r.gap:
            gaps[name] = r.gap
        else:
            rows.setdefault(name, []).append((r.sheet, r.row_no, r.cells))
    assert rows["a.csv"] == [("", 0, ["host", "vcpu"]), ("", 2, ["x", "4"])]
    assert rows["b.json"] == [("", 0, ["name", "v", "w"]), ("", 1, ["x", "1", ""]), ("", 2, ["", "", "True"])]
    assert rows["c.md"] == [("table 0", 0, ["a", "b"]), ("table 0", 1, ["1", "2"])]
    assert rows["d.xlsx"] == [("One", 0, ["host", "vcpu", ""]), ("One", 1, ["host", "", ""]), ("One", 2, ["7", "", "9.5"])]
    assert rows["e.docx"] == [("", 0, ["Title"]), ("table 0", 1, ["a", ""]), ("table 0", 2, ["b", "c"])]
    assert rows["g.zip!app/x.csv"] == [("", 0, ["a", "b"]), ("", 1, ["1", "2"])]
    assert gaps.pop("d.xlsx") == "1 formulas without a value"
    assert set(gaps) == {"bad.json", "f.pdf", "empty.txt", "evil.zip"} and "leaves" in gaps["evil.zip"]
