"""Column expressions on keys, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork import constants as C

SUFFIX_PATTERN = r"[^/.][^/]*(\.[^./]*)\z"
URL_PATH_PATTERN = r"\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def literal_map(values: dict[str, str]) -> Column:
    """A constant map of plain words, parsed in one call."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")")


def extension(path: Column) -> Column:
    """Suffix of the last path segment; leading dots do not start one."""
    return F.regexp_extract(path, SUFFIX_PATTERN, 1)


def key_suffix(key: Column) -> Column:
    """Everything after the last dot anywhere in an object key."""
    return F.when(
        F.contains(key, F.lit(".")), F.concat(F.lit("."), F.substring_index(key, ".", -1))
    ).otherwise("")


def url_path(url: Column) -> Column:
    """Path of a URL without query, fragment and last-segment parameters."""
    return F.regexp_replace(F.regexp_extract(url, URL_PATH_PATTERN, 1), r";[^/]*\z", "")


def url_extension(url: Column) -> Column:
    return extension(url_path(url))


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def document_type_of(ext: Column) -> Column:
    """Document type of a lower-case extension, empty when unknown."""
    return F.coalesce(F.try_element_at(literal_map(C.EXTENSION_TYPES), ext), F.lit(""))


def or_default(value: Column, default: Column) -> Column:
    """An empty string counts as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), default)
