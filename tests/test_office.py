"""Office archives: text, merged cells, dates, notes, damage."""

import io
import zipfile

import pytest

from leafwork.operators import office
from leafwork.plans.converters import convert_documents
from leafwork.workload import archives


def _rows(spark, *docs):
    return spark.createDataFrame(
        [(i, kind, bytearray(body) if body is not None else None) for i, (kind, body) in enumerate(docs)],
        "doc_id long, document_type string, content binary",
    )


def _chunks(df):
    return [tuple(r) for r in df.select("doc_id", "chunk_no", "text").orderBy("doc_id", "chunk_no").collect()]


def _patched(archive: bytes, changed: dict[str, str]) -> bytes:
    """The archive with members replaced or added."""
    source, out = zipfile.ZipFile(io.BytesIO(archive)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in source.namelist():
            if name not in changed:
                z.writestr(name, source.read(name))
        for name, body in changed.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_docx_tables_follow_all_paragraphs(spark):
    body = archives.docx(
        ["Title", " ", "  text  "], [[["Format", "Status"], ["PDF", "ok"]], [], [["x"]]]
    )
    assert _chunks(office.docx_to_text(_rows(spark, ("docx", body)))) == [
        (0, 0, "Title\ntext\n[TABLE 1]\nFormat | Status\nPDF | ok\n[TABLE 3]\nx\n")
    ]


def test_docx_chunks_of_fifty_paragraphs(spark):
    exact = archives.docx([f"p{i}" for i in range(100)])
    more = archives.docx([f"p{i}" for i in range(50)], [[["t"]]])
    got = _chunks(office.docx_to_text(_rows(spark, ("docx", exact), ("docx", more))))
    assert [(d, n, t.count("\n")) for d, n, t in got] == [(0, 0, 50), (0, 1, 50), (1, 0, 50), (1, 1, 2)]


def test_docx_runs_breaks_links_and_merged_cells(spark):
    xml = f"""<w:document {W}><w:body>
    <w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type="page"/></w:r>
      <w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>
    <w:tbl>
      <w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc>
            <w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>
      <w:tr><w:tc><w:p><w:r><w:t>l</w:t></w:r></w:p><w:p><w:r><w:t>m</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc>
            <w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr>
    </w:tbl></w:body></w:document>"""
    body = _patched(archives.docx([]), {"word/document.xml": xml})
    assert _chunks(office.docx_to_text(_rows(spark, ("docx", body)))) == [
        (0, 0, "a\tb\nclink\n[TABLE 1]\nwide | wide | tall\nl\nm |  | tall\n")
    ]


def test_xlsx_values_and_gaps(spark):
    sheet = f"""<worksheet {S}><dimension ref="A1:D4"/><sheetData>
    <row r="1"><c r="A1"><v>3</v></c><c r="B1"><v>3.50</v></c><c r="D1" t="b"><v>1</v></c></row>
    <row r="3"><c r="A3" t="inlineStr"><is><t>in</t></is></c><c r="B3" s="1"><v>45292</v></c>
      <c r="C3" s="2"><v>0.5</v></c><c r="D3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>"""
    styles = f"""<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="[$-409]h:mm AM/PM"/></numFmts>
    <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>"""
    base = archives.xlsx({"First": [["s", 1]], "Empty": []})
    rels = zipfile.ZipFile(io.BytesIO(base)).read("xl/_rels/workbook.xml.rels").decode()
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles"
    rels = rels.replace(
        "</Relationships>", f'<Relationship Id="st" Type="{kind}" Target="/xl/styles.xml"/></Relationships>'
    )
    body = _patched(
        base,
        {
            "xl/worksheets/sheet1.xml": sheet,
            "xl/styles.xml": styles,
            "xl/_rels/workbook.xml.rels": rels,
        },
    )
    assert _chunks(office.xlsx_to_text(_rows(spark, ("xlsx", body)))) == [
        (0, 0, "=== Sheet: First ===\n3 | 3.5 |  | True\n |  |  | \nin | 2024-01-01 00:00:00 | 12:00:00 | #N/A\n |  |  | \n"),
        (0, 1, "=== Sheet: Empty ===\n"),
    ]


def test_xlsx_chunks_restart_per_sheet(spark):
    body = archives.xlsx({"A": [[i] for i in range(200)], "B": [["x"]]})
    got = _chunks(office.xlsx_to_text(_rows(spark, ("xlsx", body))))
    assert [(n, t.count("\n")) for _, n, t in got] == [(0, 200), (1, 1), (2, 2)]


def test_pptx_slides_notes_and_numbering(spark):
    body = archives.pptx(
        [
            {"paragraphs": ["One", " ", "two "], "notes": " spoken "},
            {"paragraphs": [" "]},
            {"rows": [["a", "b"], ["", "d"]]},
        ]
    )
    assert _chunks(office.pptx_to_text(_rows(spark, ("pptx", body)))) == [
        (0, 1, "--- Slide 1 ---\nOne\ntwo\n[NOTES] spoken\n"),
        (0, 3, "--- Slide 3 ---\na | b\n | d\n"),
    ]


def test_odt_spaces_tabs_and_headers(spark):
    o = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    content = f"""<office:document-content {o}><office:body><office:text><text:h>heading</text:h>
    <text:p>a<text:s text:c="2"/>b<text:tab/>c<text:line-break/><text:span>d</text:span> e</text:p><text:p> </text:p>
    </office:text></office:body></office:document-content>"""
    styles = f"<office:document-styles {o}><office:master-styles><text:p>page head</text:p></office:master-styles></office:document-styles>"
    body = _patched(archives.odt([]), {"content.xml": content, "styles.xml": styles})
    assert _chunks(office.odt_to_text(_rows(spark, ("odt", body)))) == [
        (0, 0, "page head\na  b\tc\nd e\n")
    ]


def test_bad_archives_are_rows_not_failures(spark):
    docs = _rows(
        spark,
        ("docx", b"no archive"), ("docx", None), ("docx", archives.docx(["ok"])),
        ("xlsx", archives.docx(["wrong kind"])), ("odt", archives.docx(["wrong kind"])), ("docx", archives.docx([])),
    )
    out = convert_documents(docs).orderBy("doc_id").collect()
    assert [r["error"] is None for r in out] == [False, False, True, False, False, True]
    assert out[2]["text"] == "ok\n" and out[2]["pages_processed"] == 1
    assert out[5]["text"] == "" and out[5]["pages_processed"] == 0


@pytest.mark.parametrize("kind", office.OFFICE_TYPES)
def test_conversion_equals_the_chunks_joined(spark, sf_dir, kind):
    docs = archives.build_archives(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20), kind)
    chunks = office.office_chunks(office.unpack_office(docs)).orderBy("doc_id", "chunk_no").collect()
    joined, counted = {}, {}
    for r in chunks:
        joined[r["doc_id"]] = joined.get(r["doc_id"], "") + r["text"]
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    out = convert_documents(docs).collect()
    assert {r["doc_id"]: r["text"] for r in out} == joined
    assert {r["doc_id"]: r["pages_processed"] for r in out} == counted


def _sheet_of(rows: str) -> bytes:
    body = archives.xlsx({"S": [["s"]]})
    return _patched(body, {"xl/worksheets/sheet1.xml": f"<worksheet {S}>{rows}</worksheet>"})


def test_xlsx_cells_beyond_a_stale_dimension(spark):
    cells = '<row r="1"><c r="A1"><v>1</v></c><c r="C1"><v>2</v></c></row><row r="3"><c><v>3</v></c></row><row r="9"/>'
    body = _sheet_of(f'<dimension ref="A1"/><sheetData>{cells}</sheetData>')
    assert _chunks(office.xlsx_to_text(_rows(spark, ("xlsx", body)))) == [
        (0, 0, "=== Sheet: S ===\n1 |  | 2\n |  | \n3 |  | \n")
    ]


def test_xlsx_declared_grids_are_not_made(spark):
    cells = '<row r="1"><c r="A1"><v>1</v></c><c r="C1"><v>2</v></c></row><row r="3"><c><v>3</v></c></row>'
    text = "=== Sheet: S ===\n1 |  | 2\n |  | \n3 |  | \n"
    for ref, shown in (("A1:XFD1048576", text), ("A1:C1048576", text), ("A1:XFD3", text), ("A1:D4", None)):
        body = _sheet_of(f'<dimension ref="{ref}"/><sheetData>{cells}</sheetData>')
        rows = [r[3] for r in office._elements("xlsx", body) if r[2] == "row"]
        assert len(rows) == (3 if shown else 4) and {len(r) for r in rows} == {3 if shown else 4}
        if shown:
            assert _chunks(office.xlsx_to_text(_rows(spark, ("xlsx", body)))) == [(0, 0, shown)]


def test_damaged_documents_are_error_rows_without_text(spark):
    lines = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, 500))
    number = _sheet_of(f'<sheetData>{lines}<row r="500"><c r="A500" t="s"><v>77</v></c></row></sheetData>')
    docs = _rows(spark, ("xlsx", number), ("xlsx", b"no archive"), ("xlsx", _sheet_of("<sheetData/>")), ("xlsx", None))
    got = {(r.doc_id, r.chunk_no): (r.text, r.error) for r in office.xlsx_to_text(docs).collect()}
    assert set(got) == {(0, None), (1, None), (2, 0), (3, None)}
    assert got[0, None] == (None, "IndexError: no shared string 77") and got[2, 0] == ("=== Sheet: S ===\n", None)
    assert got[1, None][0] is None and got[1, None][1] and got[3, None] == (None, "ValueError: File not found")


@pytest.mark.parametrize("kind", office.OFFICE_TYPES)
def test_large_members_are_streamed(kind, monkeypatch):
    # Relations and the like are under this size, texts over it.
    monkeypatch.setattr(office, "MAX_MEMBER_BYTES", 3_000)
    monkeypatch.setattr(office, "SHARED_IN_MEMORY", 3_000)
    lines = [f"line {i} of a long text" for i in range(2_000)]
    body = {
        "docx": lambda: archives.docx(lines, [[[x] for x in lines]]),
        "xlsx": lambda: archives.xlsx({"S": [[x] for x in lines]}),
        "pptx": lambda: archives.pptx([{"paragraphs": lines, "notes": "n" * 4_000}]),
        "odt": lambda: archives.odt(lines),
    }[kind]()
    rows = list(office._elements(kind, body))
    assert [r[5] for r in rows if r[2] == "error"] == []
    texts = [r[3][0] for r in rows if r[2] in ("paragraph", "row")]
    assert texts == lines * (2 if kind == "docx" else 1)


def test_a_broken_document_gives_no_part_of_its_text():
    broken = archives.docx(["kept"] * 3)
    xml = zipfile.ZipFile(io.BytesIO(broken)).read("word/document.xml").decode()[:-20]
    rows = list(office._elements("docx", _patched(broken, {"word/document.xml": xml})))
    assert [r[2] for r in rows] == ["document", "error"]
