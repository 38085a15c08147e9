"""Office archives made from table rows, as input for the office queries.

Each document becomes a small valid archive: its lines are paragraphs, sheet
rows or slides. Building runs as a Spark map, one archive at a time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OD = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _rels(entries: list[tuple[str, str, str]]) -> str:
    rows = "".join(
        f'<Relationship Id="{i}" Type="{_OD}/{kind}" Target="{target}"/>'
        for i, kind, target in entries
    )
    return f'{_HEAD}<Relationships xmlns="{_REL_NS}">{rows}</Relationships>'


def docx(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    def par(text: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join(par(p) for p in paragraphs)
    for table in tables:
        rows = "".join(
            "<w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in row) + "</w:tr>" for row in table
        )
        body += f"<w:tbl>{rows}</w:tbl>"
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    return _zip(
        {
            "_rels/.rels": _rels([("rId1", "officeDocument", "word/document.xml")]),
            "word/document.xml": f'{_HEAD}<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>',
        }
    )


def _column(n: int) -> str:
    name = ""
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """Sheets of rows; strings are shared, numbers are stored, None is left out."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    shared: dict[str, int] = {}
    members, listed, rels = {}, "", []
    for n, (name, rows) in enumerate(sheets.items(), start=1):
        xml, width = "", max((len(r) for r in rows), default=0)
        for r, row in enumerate(rows, start=1):
            cells = ""
            for c, value in enumerate(row, start=1):
                ref = f"{_column(c)}{r}"
                if isinstance(value, str):
                    index = shared.setdefault(value, len(shared))
                    cells += f'<c r="{ref}" t="s"><v>{index}</v></c>'
                elif isinstance(value, bool):
                    cells += f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
                elif value is not None:
                    cells += f'<c r="{ref}"><v>{value}</v></c>'
            xml += f'<row r="{r}">{cells}</row>'
        size = f'<dimension ref="A1:{_column(width)}{len(rows)}"/>' if width else ""
        members[f"xl/worksheets/sheet{n}.xml"] = (
            f'{_HEAD}<worksheet xmlns="{ns}">{size}<sheetData>{xml}</sheetData></worksheet>'
        )
        listed += f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>'
        rels.append((f"rId{n}", "worksheet", f"worksheets/sheet{n}.xml"))
    rels.append(("rIdS", "sharedStrings", "sharedStrings.xml"))
    strings = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
    members |= {
        "_rels/.rels": _rels([("rId1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{ns}" xmlns:r="{_OD}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels(rels),
        "xl/sharedStrings.xml": f'{_HEAD}<sst xmlns="{ns}">{strings}</sst>',
    }
    return _zip(members)


def pptx(slides: list[dict]) -> bytes:
    """Slides as {paragraphs, rows, notes}."""
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    p = "http://schemas.openxmlformats.org/presentationml/2006/main"
    spaces = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{_OD}"'

    def body(lines: list[str], tag: str) -> str:
        pars = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in lines)
        return f"<{tag}>{pars}</{tag}>"

    members, listed, rels = {}, "", []
    for n, slide in enumerate(slides, start=1):
        shapes = f"<p:sp>{body(slide.get('paragraphs', []), 'p:txBody')}</p:sp>"
        if slide.get("rows"):
            rows = "".join(
                "<a:tr>" + "".join(f"<a:tc>{body([c], 'a:txBody')}</a:tc>" for c in row) + "</a:tr>"
                for row in slide["rows"]
            )
            shapes += (
                f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl>"
                "</a:graphicData></a:graphic></p:graphicFrame>"
            )
        members[f"ppt/slides/slide{n}.xml"] = (
            f"{_HEAD}<p:sld {spaces}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        )
        if slide.get("notes"):
            holder = '<p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr>'
            members[f"ppt/notesSlides/notesSlide{n}.xml"] = (
                f"{_HEAD}<p:notes {spaces}><p:cSld><p:spTree><p:sp>{holder}"
                f"{body([slide['notes']], 'p:txBody')}</p:sp></p:spTree></p:cSld></p:notes>"
            )
            members[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels(
                [("rId1", "notesSlide", f"../notesSlides/notesSlide{n}.xml")]
            )
        listed += f'<p:sldId id="{255 + n}" r:id="rId{n}"/>'
        rels.append((f"rId{n}", "slide", f"slides/slide{n}.xml"))
    members |= {
        "_rels/.rels": _rels([("rId1", "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f"{_HEAD}<p:presentation {spaces}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _rels(rels),
    }
    return _zip(members)


def odt(paragraphs: list[str]) -> bytes:
    office = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
    text = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    pars = "".join(f"<text:p>{escape(p)}</text:p>" for p in paragraphs)
    return _zip(
        {
            "mimetype": "application/vnd.oasis.opendocument.text",
            "content.xml": (
                f'{_HEAD}<office:document-content xmlns:office="{office}" xmlns:text="{text}">'
                f"<office:body><office:text>{pars}</office:text></office:body>"
                "</office:document-content>"
            ),
        }
    )


def _build(kind: str, doc_id: int, text: str, lang: str, source: str) -> bytes:
    lines = text.split("\n")
    if kind == "docx":
        return docx(lines, [[["source", "lang"], [source, lang]]])
    if kind == "xlsx":
        return xlsx(
            {
                "Lines": [[i, line] for i, line in enumerate(lines, start=1)],
                "Info": [[doc_id, None, lang, source]],
            }
        )
    if kind == "pptx":
        return pptx(
            [
                {"paragraphs": [line], "notes": f"line {i}" if i % 3 == 0 else ""}
                for i, line in enumerate(lines, start=1)
            ]
            + [{"rows": [["source", "lang"], [source, lang]]}]
        )
    return odt(lines)


def build_archives(documents: DataFrame, kind: str) -> DataFrame:
    """documents -> (doc_id, document_type, content)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = _build(kind, row["doc_id"], row["text"], row["lang"], row["source"])
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": row["doc_id"], "document_type": kind, "content": content}],
                    schema=pa.schema(
                        [("doc_id", pa.int64()), ("document_type", pa.string()), ("content", pa.binary())]
                    ),
                )

    return documents.select("doc_id", "text", "lang", "source").mapInArrow(
        build, "doc_id long, document_type string, content binary"
    )
