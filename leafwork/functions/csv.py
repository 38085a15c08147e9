"""CSV to text with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions.text import let

# One field with its terminator. A quoted field may hold separators, line
# breaks and doubled quotes, and runs to the end of input if never closed; text
# after a closing quote is kept. Possessive quantifiers keep matching linear.
FIELD_PATTERN = (
    r"\"(?:[^\"]++|\"\")*+(?:\"[^,\r\n]*+(?:,|\r\n|\r|\n)|\z)"
    r"|[^,\r\n]*+(?:,|\r\n|\r|\n)"
)


QUOTED_PATTERN = r"(?s)\A\"((?:[^\"]++|\"\")*+)(?:\"(.*))?\z"


def _field_value(field: Column, added: Column) -> Column:
    """Cell text of a field. A bare field and what follows a closing quote hold
    no separator or line break but the terminator; a field that is never closed
    keeps everything except the line break that was ``added``."""
    inside = F.regexp_extract(field, QUOTED_PATTERN, 1)
    after = F.regexp_extract(field, QUOTED_PATTERN, 2)
    shown = F.replace(inside, F.lit('""'), F.lit('"'))
    kept = F.when(added, F.regexp_replace(shown, r"\n\z", "")).otherwise(shown)
    quoted = F.when(after != "", F.concat(shown, F.rtrim(after, F.lit(",\r\n")))).otherwise(kept)
    return F.when(F.startswith(field, F.lit('"')), quoted).otherwise(
        F.rtrim(field, F.lit(",\r\n"))
    )


def csv_records(text: Column) -> Column:
    """Records of a whole CSV file, each as its cells joined by `` | ``."""
    added = (text != "") & ~text.rlike(r"[\r\n]\z")
    ended = F.when(added, F.concat(text, F.lit("\n"))).otherwise(text)
    fields = F.regexp_extract_all(ended, F.lit(FIELD_PATTERN), F.lit(0))
    return let(F.struct(fields.alias("fields"), added.alias("added")), _records)


def _records(split: Column) -> Column:
    fields = split["fields"]
    ends = F.filter(
        F.transform(
            fields,
            lambda f, i: F.when(
                ~F.endswith(f, F.lit(",")) | (i == F.size(fields) - 1), i
            ).otherwise(-1),
        ),
        lambda i: i >= 0,
    )

    def record(end: Column, previous: Column) -> Column:
        cells = F.slice(fields, previous + 2, end - previous)
        return F.array_join(
            F.transform(cells, lambda f: _field_value(f, split["added"])), C.CELL_SEPARATOR
        )

    return let(
        ends,
        lambda es: F.transform(
            es, lambda end, k: record(end, F.coalesce(F.get(es, k - 1), F.lit(-1)))
        ),
    )
