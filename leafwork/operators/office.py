"""Office archives (DOCX, XLSX, PPTX, ODT) to lines of text.

Opening a zip archive is the one step Spark has no expression for. It is a
``mapInArrow`` over the file rows that emits element rows and nothing else;
rendering, grouping and counting happen on the DataFrame. An archive that
cannot be read gives one row with ``kind = 'error'`` and never fails the job.
"""

from __future__ import annotations

import datetime as dt
import io
import pickle
import re
import tempfile
import zipfile
from array import array
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork import constants as C

OFFICE_TYPES = ["docx", "xlsx", "pptx", "odt"]
# Members that hold text are streamed, whatever their size: one paragraph, row or shape
# is in memory. The small parts that say how they belong together (relations, workbook,
# styles) are read whole; one beyond this is reported as an error.
MAX_MEMBER_BYTES = 1024 * 1024 * 1024
ROWS_PER_BATCH = 4_096
# Members up to so many bytes are parsed once and kept, so many bytes of them at most.
SMALL_MEMBERS = 1 << 20
# A batch of elements is sent on at so many characters, too.
CHARS_PER_BATCH = 1 << 24
# A sheet may declare this many empty rows or columns more than it has cells; a dimension
# beyond that (whole grids are declared for a few cells) is not made.
MOST_PADDING = 1_000
# Shared strings beyond so many bytes go to a temporary file.
SHARED_IN_MEMORY = 1 << 26

# XML vocabularies (fixed values).
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
# Built-in number formats that show a date or time (fixed values).
DATE_FORMAT_IDS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]


class _Archive:
    """Named members of a zip file, parsed on demand."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.trees: dict[str, ET.Element] = {}
        self.kept = 0

    def small(self, name: str) -> ET.Element | None:
        """The root of a small member; none if it is large or damaged, which is for the
        streaming readers to tell."""
        if name not in self.trees:
            try:
                size = self.zip.getinfo(name).file_size
                if size > SMALL_MEMBERS:
                    return None
                tree = ET.fromstring(self.zip.read(name))
            except Exception:  # streamed, it fails where it is damaged
                return None
            if self.kept + size > SMALL_MEMBERS:
                self.trees, self.kept = {}, 0
            self.trees[name] = tree
            self.kept += size
        return self.trees[name]

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        tree = self.small(name)
        if tree is not None:
            return tree
        if self.zip.getinfo(name).file_size > MAX_MEMBER_BYTES:
            raise ValueError(f"archive member too large: {name}")
        return ET.fromstring(self.zip.read(name))

    def starts(self, name: str, seen: Callable[[str, dict], None]) -> None:
        """Tell ``seen`` the tag and attributes of every element; the whole member is
        checked, so that what is streamed from it later does not break off."""
        tree = self.small(name)
        if tree is not None:
            for node in tree.iter():
                seen(node.tag, node.attrib)
            return
        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True
        parser.StartElementHandler = lambda tag, attrs: seen("{" + tag if "}" in tag else tag, attrs)
        with self.zip.open(name) as source:
            parser.ParseFile(source)

    def root(self, name: str) -> str | None:
        """Tag of the root element of a member, all of which is checked."""
        if name not in self.names:
            return None
        tree = self.small(name)
        if tree is not None:
            return tree.tag
        tags: list[str] = []
        self.starts(name, lambda tag, _: tags or tags.append(tag))
        return tags[0]

    def stream(
        self, name: str, wanted: Callable[[list[str]], bool], marks: Sequence[list[str]] = ()
    ) -> Iterator[ET.Element | str]:
        """The outermost elements whose path of tags is ``wanted``, one held at a time; the
        tag alone where an element of one of the paths ``marks`` below the root starts."""
        deepest = 1 + max(map(len, marks), default=-1)
        tree = self.small(name)
        if tree is not None:
            yield from _outermost(tree, [], wanted, marks, deepest)
            return
        stack: list[ET.Element] = []
        tags: list[str] = []
        top = 0
        with self.zip.open(name) as source:
            for event, node in ET.iterparse(source, ("start", "end")):
                if event == "start":
                    stack.append(node)
                    tags.append(node.tag)
                    if not top and wanted(tags):
                        top = len(tags)
                    elif not top and len(tags) <= deepest and tags[1:] in marks:
                        yield node.tag
                    continue
                if top == len(tags):
                    yield node
                    top = 0
                stack.pop()
                tags.pop()
                if not top and stack:
                    stack[-1].remove(node)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (last word of the relation type, target member)."""
        folder, _, leaf = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{leaf}.rels" if folder else f"_rels/{leaf}.rels")
        found = {}
        for rel in root if root is not None else []:
            target = rel.get("Target", "")
            steps = [] if target.startswith("/") else [s for s in folder.split("/") if s]
            for step in target.strip("/").split("/"):
                if step == "..":
                    steps = steps[:-1]
                elif step != ".":
                    steps.append(step)
            found[rel.get("Id")] = (rel.get("Type", "").rpartition("/")[2], "/".join(steps))
        return found

    def main_part(self, root: str) -> str:
        """Name of the main part, which must be a ``root`` element."""
        for kind, target in self.relations("").values():
            if kind == "officeDocument" and self.root(target) == root:
                return target
        raise ValueError("archive has no main part of this document type")


def _outermost(
    node: ET.Element, above: list[str], wanted: Callable[[list[str]], bool], marks: Sequence[list[str]], deepest: int
) -> Iterator[ET.Element | str]:
    """What ``_Archive.stream`` tells of a member, from its tree."""
    waiting = [(node, above)]
    while waiting:
        node, above = waiting.pop()
        tags = [*above, node.tag]
        if wanted(tags):
            yield node
            continue
        if len(tags) <= deepest and tags[1:] in marks:
            yield node.tag
        waiting.extend((child, tags) for child in reversed(node))


# An element is (part_no, chunk_no, kind, cells).


def _run_text(run: ET.Element) -> str:
    out = []
    for node in run:
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag in (W + "tab", W + "ptab"):
            out.append("\t")
        elif node.tag == W + "cr":
            out.append("\n")
        elif node.tag == W + "br" and node.get(W + "type", "textWrapping") == "textWrapping":
            out.append("\n")
        elif node.tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _word_paragraph(par: ET.Element) -> str:
    out = []
    for node in par:
        if node.tag == W + "r":
            out.append(_run_text(node))
        elif node.tag == W + "hyperlink":
            out.extend(_run_text(run) for run in node.findall(W + "r"))
    return "".join(out)


def _word_row(row: ET.Element, above: list[str]) -> list[str]:
    """Cell texts on the column grid; merged cells repeat their text."""
    cells: list[str] = []
    for cell in row.findall(W + "tc"):
        props = cell.find(W + "tcPr")
        span, merge = None, None
        if props is not None:
            span, merge = props.find(W + "gridSpan"), props.find(W + "vMerge")
        width = int(span.get(W + "val", "1")) if span is not None else 1
        if merge is not None and merge.get(W + "val", "continue") == "continue":
            value = above[len(cells)] if len(cells) < len(above) else ""
        else:
            value = "\n".join(_word_paragraph(p) for p in cell.findall(W + "p")).strip()
        cells += [value] * width
    return cells


class _Later:
    """Elements to be sent after all others, beyond a size on disk."""

    def __init__(self):
        self.data, self.n = tempfile.SpooledTemporaryFile(max_size=SHARED_IN_MEMORY), 0

    def add(self, element: tuple) -> None:
        pickle.dump(element, self.data)
        self.n += 1

    def __iter__(self) -> Iterator[tuple]:
        self.data.seek(0)
        for _ in range(self.n):
            yield pickle.load(self.data)


def _docx(archive: _Archive, per_chunk: int) -> Iterator[tuple]:
    """One pass: paragraphs go on as they come, tables follow them in the last chunk."""
    body, table = [W + "body"], [W + "body", W + "tbl"]
    paths = ([*body, W + "p"], [*table, W + "tr"])
    seen = bodies = number = 0
    cells: list[str] = []
    fresh, later = True, _Later()
    for node in archive.stream(
        archive.main_part(W + "document"), lambda tags: 2 < len(tags) < 5 and tags[1:] in paths, (body, table)
    ):
        if node == body[-1]:
            bodies += 1
        elif node == table[-1]:
            number, cells, fresh = number + 1, [], True
        elif node.tag == W + "p":
            text = _word_paragraph(node).strip()
            if text:
                yield 0, seen // per_chunk, "paragraph", [text]
                seen += 1
        else:
            if fresh:
                later.add((number, "heading", [f"{C.TABLE_MARKER} {number}]"]))
                fresh = False
            cells = _word_row(node, cells)
            later.add((number, "row", cells))
    if not bodies:
        raise ValueError("document has no body")
    for part, kind, shown in later:
        yield part, seen // per_chunk, kind, shown


def _column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _date_styles(styles: ET.Element | None) -> set[int]:
    if styles is None:
        return set()
    dated = set(DATE_FORMAT_IDS)
    for fmt in styles.iter(S + "numFmt"):
        code = re.sub(r"\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]|\"[^\"]*\"", "", fmt.get("formatCode", ""))
        if re.search(r"(?<![_\\])[dmhysDMHYS]", code.split(";")[0]):
            dated.add(int(fmt.get("numFmtId")))
    formats = styles.find(S + "cellXfs")
    return {
        i
        for i, xf in enumerate(formats if formats is not None else [])
        if int(xf.get("numFmtId", "0")) in dated
    }


def _excel_date(serial: float) -> str:
    if 0 <= serial < 1:
        moment = dt.datetime(1900, 1, 1) + dt.timedelta(milliseconds=round(serial * 86_400_000))
        return str(moment.time())
    day = serial + 1 if serial < 60 else serial
    return str(dt.datetime(1899, 12, 30) + dt.timedelta(milliseconds=round(day * 86_400_000)))


def _cell_value(cell: ET.Element, shared: _SharedStrings, dated: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(S + "is")
        return _rich_text(inline) if inline is not None else ""
    raw = cell.findtext(S + "v")
    if raw is None:
        return ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return str(bool(int(raw)))
    if kind != "n":
        return raw
    number = float(raw) if any(c in raw for c in ".eE") else int(raw)
    return _excel_date(number) if int(cell.get("s", "0")) in dated else str(number)


def _rich_text(item: ET.Element) -> str:
    parts = [t.text or "" for t in item.findall(S + "t")]
    parts += [t.text or "" for run in item.findall(S + "r") for t in run.findall(S + "t")]
    return "".join(parts)


class _SharedStrings:
    """The strings that cells refer to by number, beyond a size on disk."""

    def __init__(self, archive: _Archive, member: str):
        self.data = tempfile.SpooledTemporaryFile(max_size=SHARED_IN_MEMORY)
        self.ends = array("Q", [0])
        if member in archive.names:
            for item in archive.stream(member, lambda tags: tags[1:] == [S + "si"]):
                size = self.data.write(_rich_text(item).encode("utf-8", "surrogatepass"))
                self.ends.append(self.ends[-1] + size)

    def __getitem__(self, number: int) -> str:
        if not 0 <= number < len(self.ends) - 1:
            raise IndexError(f"no shared string {number}")
        self.data.seek(self.ends[number])
        return self.data.read(self.ends[number + 1] - self.ends[number]).decode("utf-8", "surrogatepass")


def _extent(archive: _Archive, member: str) -> tuple[int | None, int | None]:
    """(width, height) of a sheet that declares a dimension: the declared ones, or those
    of its cells where these lie beyond, or where the declared ones lie so far beyond them
    that they tell nothing of the sheet. (None, None) where it declares none."""
    declared: list[int] = []
    row = column = width = height = 0

    def seen(tag: str, attrs: dict) -> None:
        nonlocal row, column, width, height
        if tag == S + "dimension":
            corner = attrs.get("ref", "").rpartition(":")[2]
            digits = corner.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz$")
            declared[:] = [_column_number(corner), int(digits) if digits.isdigit() else 0]
        elif tag == S + "row":
            row, column = int(attrs.get("r", row + 1)), 0
        elif tag == S + "c":
            column = _column_number(attrs.get("r", "")) or column + 1
            width, height = max(width, column), max(height, row)

    archive.starts(member, seen)
    if not declared:
        return None, None
    wide, high = (most if most - own <= MOST_PADDING else own for most, own in zip(declared, (width, height)))
    return max(wide, width), max(high, height)


def _sheet_rows(
    archive: _Archive, member: str, extent: tuple[int | None, int | None], shared: _SharedStrings, dated: set[int]
) -> Iterator[list[str]]:
    """Rows in order, padded to the extent, if any; rows the file leaves out come back
    empty."""
    width, height = extent
    done = number = 0
    for node in archive.stream(member, lambda tags: tags[-1] == S + "row"):
        number = int(node.get("r", number + 1))
        if height is not None and number > height:
            continue  # beyond the last cell
        while done < number - 1:
            done += 1
            yield [""] * (width or 0)
        placed, column = {}, 0
        for cell in node.findall(S + "c"):
            column = _column_number(cell.get("r", "")) or column + 1
            placed[column] = _cell_value(cell, shared, dated)
        last = max(placed, default=0) if width is None else width
        yield [placed.get(i, "") for i in range(1, last + 1)]
        done = number
    while height is not None and done < height:
        done += 1
        yield [""] * (width or 0)


def _xlsx(archive: _Archive, per_chunk: int) -> Iterator[tuple]:
    book = archive.main_part(S + "workbook")
    relations = archive.relations(book)
    targets = {kind: target for kind, target in relations.values()}
    shared = _SharedStrings(archive, targets.get("sharedStrings", ""))
    dated = _date_styles(archive.xml(targets.get("styles", "")))
    chunk = 0
    sheets = archive.xml(book).find(S + "sheets")
    members = [relations[s.get(R + "id")][1] for s in (sheets if sheets is not None else [])]
    extents = [_extent(archive, member) for member in members]
    for number, sheet in enumerate(sheets if sheets is not None else [], start=1):
        yield number, chunk, "heading", [f"=== Sheet: {sheet.get('name')} ==="]
        lines = 1
        for row in _sheet_rows(archive, members[number - 1], extents[number - 1], shared, dated):
            yield number, chunk + lines // per_chunk, "row", row
            lines += 1
        chunk += -(-lines // per_chunk)


def _drawing_paragraph(par: ET.Element) -> str:
    out = []
    for node in par:
        if node.tag in (A + "r", A + "fld"):
            out.append(node.findtext(A + "t") or "")
        elif node.tag == A + "br":
            out.append("\v")
    return "".join(out)


def _drawing_paragraphs(body: ET.Element | None) -> list[str]:
    return [_drawing_paragraph(p) for p in body.findall(A + "p")] if body is not None else []


def _notes_text(archive: _Archive, member: str) -> str:
    if member not in archive.names:
        return ""
    for shape in archive.stream(member, lambda tags: tags[-1] == P + "sp"):
        holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
        if holder is not None and holder.get("type") == "body":
            return "\n".join(_drawing_paragraphs(shape.find(P + "txBody"))).strip()
    return ""


def _slide_lines(archive: _Archive, member: str) -> Iterator[tuple[str, list[str]]]:
    tree = [P + "cSld", P + "spTree"]
    shapes = (P + "sp", P + "graphicFrame")
    trees = 0
    for shape in archive.stream(member, lambda tags: tags[1:3] == tree and len(tags) == 4 and tags[3] in shapes, (tree,)):
        if isinstance(shape, str):
            trees += 1
        elif shape.tag == P + "sp":
            for text in _drawing_paragraphs(shape.find(P + "txBody")):
                if text.strip():
                    yield "paragraph", [text.strip()]
        else:
            for row in shape.iter(A + "tr"):
                yield "row", [
                    "\n".join(_drawing_paragraphs(cell.find(A + "txBody"))).strip()
                    for cell in row.findall(A + "tc")
                ]
    if not trees:
        raise ValueError(f"slide has no shapes: {member}")
    for kind, target in archive.relations(member).values():
        if kind == "notesSlide":
            notes = _notes_text(archive, target)
            if notes:
                yield "notes", [f"[NOTES] {notes}"]


def _pptx(archive: _Archive, per_chunk: int) -> Iterator[tuple]:
    deck = archive.main_part(P + "presentation")
    relations = archive.relations(deck)
    order = archive.xml(deck).find(P + "sldIdLst")
    for number, entry in enumerate(order if order is not None else [], start=1):
        _, member = relations[entry.get(R + "id")]
        archive.root(member)
        fresh = True
        for kind, cells in _slide_lines(archive, member):
            if fresh:
                yield number, number, "heading", [f"--- Slide {number} ---"]
                fresh = False
            yield number, number, kind, cells


def _open_text(node: ET.Element) -> str:
    out = [node.text or ""]
    for child in node:
        if child.tag == TEXT + "s":
            out.append(" " * int(child.get(TEXT + "c", "1")))
        elif child.tag == TEXT + "tab":
            out.append("\t")
        elif child.tag == TEXT + "line-break":
            out.append("\n")
        else:
            out.append(_open_text(child))
        out.append(child.tail or "")
    return "".join(out)


def _odt(archive: _Archive, per_chunk: int) -> Iterator[tuple]:
    """Every paragraph anywhere; page headers and footers come first."""
    sources = (("styles.xml", OFFICE + "master-styles"), ("content.xml", OFFICE + "body"))
    for member, _ in sources:
        if archive.root(member) is None and member == "content.xml":
            raise ValueError("archive has no content.xml")
    seen = 0
    for member, section in sources:
        if member not in archive.names:
            continue
        for top in archive.stream(member, lambda tags: tags[-1] == TEXT + "p" and tags[1] == section):
            for par in top.iter(TEXT + "p"):
                text = _open_text(par).strip()
                if text:
                    yield 0, seen // per_chunk, "paragraph", [text]
                    seen += 1


_READERS = {
    "docx": (_docx, C.PARAGRAPHS_PER_CHUNK),
    "xlsx": (_xlsx, C.SHEET_ROWS_PER_CHUNK),
    "pptx": (_pptx, 1),
    "odt": (_odt, C.PARAGRAPHS_PER_CHUNK),
}
_COLUMNS = ["part_no", "chunk_no", "kind", "cells", "elem_no", "error"]


def _elements(kind: str, content: bytes | None) -> Iterator[tuple]:
    """Element rows of one archive. The first row stands for the document, so
    an empty one is still seen; an unreadable one ends in an error row."""
    yield 0, 0, "document", None, 0, None
    number = 0
    try:
        if content is None:
            raise ValueError("File not found")
        read, per_chunk = _READERS[kind]
        for part_no, chunk_no, what, cells in read(_Archive(content), per_chunk):
            number += 1
            yield part_no, chunk_no, what, cells, number, None
    except Exception as exc:  # any damage in the file is a row, not a failed job
        yield 0, 0, "error", None, number + 1, f"{type(exc).__name__}: {exc}"


def element_schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", doc_id),
            T.StructField("document_type", T.StringType()),
            T.StructField("part_no", T.LongType()),
            T.StructField("chunk_no", T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("cells", T.ArrayType(T.StringType())),
            T.StructField("elem_no", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )


_ARROW_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]


def _unpack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, contents = (batch.column(i) for i in range(3))
        picked, rows, chars = [], [], 0
        for i in range(batch.num_rows):
            for row in _elements(kinds[i].as_py(), contents[i].as_py()):
                picked.append(i)
                rows.append(row)
                chars += sum(map(len, row[3] or ()))
                if len(rows) >= ROWS_PER_BATCH or chars >= CHARS_PER_BATCH:
                    yield _element_batch(ids, kinds, picked, rows)
                    picked, rows, chars = [], [], 0
        if rows:
            yield _element_batch(ids, kinds, picked, rows)


def _element_batch(ids, kinds, picked: list[int], rows: list[tuple]) -> pa.RecordBatch:
    at = pa.array(picked, pa.int64())
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), _ARROW_TYPES)]
    return pa.RecordBatch.from_arrays(
        [ids.take(at), kinds.take(at), *columns], names=["doc_id", "document_type", *_COLUMNS]
    )


def unpack_office(documents: DataFrame) -> DataFrame:
    """(doc_id, document_type, content) rows to element rows."""
    wanted = documents.where(F.col("document_type").isin(OFFICE_TYPES)).select(
        "doc_id", "document_type", "content"
    )
    return wanted.mapInArrow(
        _unpack_batches, element_schema(documents.schema["doc_id"].dataType)
    )


def _rendered() -> Column:
    return F.array_join(F.col("cells"), C.CELL_SEPARATOR)


def office_chunks(elements: DataFrame) -> DataFrame:
    """Element rows to the text chunks of each document, numbered in order. A document that
    is damaged anywhere has one row with its ``error`` and none of its text."""
    is_error = F.col("kind") == "error"
    failed = F.max("error").over(Window.partitionBy("doc_id")).isNotNull()
    ordered = F.sort_array(F.collect_list(F.struct("elem_no", "line")))
    return (
        elements.where("kind <> 'document'")
        .select(
            "doc_id", F.when(~is_error, F.col("chunk_no")).alias("chunk_no"), "elem_no",
            F.coalesce(_rendered(), F.lit("")).alias("line"), "error", failed.alias("_failed"),
        )
        .where(~F.col("_failed") | F.col("error").isNotNull())
        .groupBy("doc_id", "chunk_no")
        .agg(ordered.alias("lines"), F.max("error").alias("error"))
        .select(
            "doc_id",
            "chunk_no",
            F.when(
                F.col("error").isNull(), F.concat(F.array_join(F.col("lines.line"), "\n"), F.lit("\n"))
            ).alias("text"),
            "error",
        )
    )


def _typed_chunks(documents: DataFrame, kind: str) -> DataFrame:
    return office_chunks(unpack_office(documents.where(F.col("document_type") == kind)))


def docx_to_text(documents: DataFrame) -> DataFrame:
    """Paragraphs, 50 to a chunk; all tables follow in the last chunk."""
    return _typed_chunks(documents, "docx")


def xlsx_to_text(documents: DataFrame) -> DataFrame:
    """Sheets in workbook order, 200 lines (heading included) to a chunk."""
    return _typed_chunks(documents, "xlsx")


def pptx_to_text(documents: DataFrame) -> DataFrame:
    """A chunk per slide that has text, table rows or notes."""
    return _typed_chunks(documents, "pptx")


def odt_to_text(documents: DataFrame) -> DataFrame:
    """Paragraphs, 50 to a chunk."""
    return _typed_chunks(documents, "odt")


def office_text(elements: DataFrame) -> DataFrame:
    """Element rows to document texts with counts and errors: one shuffle.

    A group is one archive, which one task already held. Every line ends its
    own line, so the lines joined give what joining the chunks would give;
    chunks are counted, not built.
    """
    is_line = ~F.col("kind").isin("document", "error")
    line = F.when(is_line, F.struct("elem_no", "chunk_no", "line"))
    text = F.when(
        F.size("lines") > 0, F.concat(F.array_join(F.col("lines.line"), "\n"), F.lit("\n"))
    ).otherwise("")
    return (
        elements.withColumn("line", _rendered())
        .groupBy("doc_id", "document_type")
        .agg(F.sort_array(F.collect_list(line)).alias("lines"), F.max("error").alias("error"))
        .withColumn("text", F.when(F.col("error").isNull(), text))
        .select(
            "doc_id",
            "document_type",
            "text",
            F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("total_chars"),
            F.when(
                F.col("error").isNull(), F.size(F.array_distinct(F.col("lines.chunk_no")))
            ).otherwise(0).cast("long").alias("pages_processed"),
            "error",
        )
    )
