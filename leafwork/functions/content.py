"""Column expressions on raw document bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.text import normalize_newlines

# Leading bytes in hex -> media type (fixed values).
SIGNATURES = [
    ("255044462D", "application/pdf"),
    ("7B5C727466", "text/rtf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("424D", "image/bmp"),
]
OFFICE_TYPES = [
    ("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
]
OPEN_DOCUMENT_TYPE = "application/vnd.oasis.opendocument.text"
# Windows-1252 characters of the bytes 80 to 9F (fixed values); five bytes
# stand for nothing.
WINDOWS_1252_HIGH = (
    "\u20ac\ufffd\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\ufffd\u017d\ufffd"
    "\ufffd\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\ufffd\u017e\u0178"
)
HTML_START_PATTERN = r"(?i)\A\s*<(?:!doctype html|html|head|title|body)\b"
# What stands before a member's name in a zip archive: its own header, or its
# entry in the directory at the end.
ZIP_NAME_PATTERN = r"(?s)PK(?:\x03\x04.{26}|\x01\x02.{42})"


def sniff_mime(content: Column) -> Column:
    """Media type by leading bytes, archives by the names of all their members,
    then by whether the bytes are UTF-8."""
    head = F.decode(content, "ISO-8859-1")
    head_hex = F.hex(F.substring(content, 1, 12))
    rule = F.when(F.octet_length(content) == 0, "inode/x-empty")
    for prefix, mime in SIGNATURES:
        rule = rule.when(F.startswith(head_hex, F.lit(prefix)), mime)
    rule = rule.when(
        F.startswith(head_hex, F.lit("52494646")) & F.endswith(head_hex, F.lit("57454250")),
        "image/webp",
    )
    archive = F.when(F.contains(head, F.lit(OPEN_DOCUMENT_TYPE)), OPEN_DOCUMENT_TYPE)
    for folder, mime in OFFICE_TYPES:
        archive = archive.when(head.rlike(ZIP_NAME_PATTERN + folder), mime)
    rule = rule.when(
        F.startswith(head_hex, F.lit("504B0304")), archive.otherwise("application/zip")
    )
    rule = rule.when(head.rlike(HTML_START_PATTERN), "text/html")
    return rule.when(F.is_valid_utf8(content.cast("string")), "text/plain").otherwise(
        "application/octet-stream"
    )


def utf8_text(content: Column) -> Column:
    """UTF-8 with a replacement character for every bad sequence."""
    return F.make_valid_utf8(content.cast("string"))


def windows_1252_text(content: Column) -> Column:
    """Latin-1 gives every byte its code point; only 80 to 9F differ."""
    return F.translate(
        F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WINDOWS_1252_HIGH
    )


def decode_text(content: Column) -> Column:
    """Plain-text bytes: byte-order mark, else UTF-8 if valid, else Windows-1252."""
    head_hex = F.hex(F.substring(content, 1, 4))
    raw = (
        F.when(F.startswith(head_hex, F.lit("EFBBBF")), utf8_text(F.substring(content, 4, 2**31 - 1)))
        .when(
            F.startswith(head_hex, F.lit("FFFE")) | F.startswith(head_hex, F.lit("FEFF")),
            F.try_validate_utf8(F.decode(content, "UTF-16")),
        )
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(windows_1252_text(content))
    )
    return normalize_newlines(raw)
