"""Column expressions on text. All of them are row-local built-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork import constants as C

# A run of three or more ASCII letters that is a whole word: no letter, digit
# or underscore of any script may touch it.
WORD_PATTERN = r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``."""
    return F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")
    ).otherwise(text)


def count_substring(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle.encode())).cast("long")


def count_lines(text: Column) -> Column:
    """Lines of newline-normalised text; an unterminated last line counts."""
    open_tail = F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return count_substring(text, "\n") + open_tail


def count_page_markers(text: Column) -> Column:
    """Lines of newline-normalised text that start with a page marker."""
    return count_substring(F.concat(F.lit("\n"), text), "\n" + C.PAGE_MARKER_PREFIX)


def words(text: Column) -> Column:
    """Lower-case words of three or more ASCII letters, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def literal_array(values: list[str]) -> Column:
    """A constant array of plain words, parsed in one call."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def ranked_words(
    tokens: Column, limit: int = C.TOP_WORDS, stop_words: list[str] = C.STOP_WORDS
) -> Column:
    """Most frequent non-stop words as ``array<struct<n, first_pos, word>>``.

    Ties go to the word met first; ``first_pos`` is its place among the distinct
    words. Sorting puts equal words next to each other, so run lengths are the
    counts; the sorted distinct words line up with the runs and bring their
    first places. Count and place pack into one number, so the ranking itself
    sorts plain longs. The work stays in the row: no explode, no shuffle.
    (``sort_array`` compares natively; ``array_sort`` would call an expression
    per comparison.)
    """
    wanted = F.filter(tokens, lambda w: ~w.isin(stop_words)) if stop_words else tokens
    return let(wanted, lambda ws: let(F.array_distinct(ws), lambda ds: _ranked(ws, ds, limit)))


_LAST_PLACE = 2**31 - 1


def _ranked(words_: Column, distinct: Column, limit: int) -> Column:
    placed = F.sort_array(F.transform(distinct, lambda w, i: F.struct(w, i.alias("pos"))))

    def run_starts(ordered: Column) -> Column:
        changed = lambda w, i: (i == 0) | (F.get(ordered, i - 1) != w)
        return F.filter(
            F.transform(ordered, lambda w, i: F.when(changed(w, i), i).otherwise(-1)),
            lambda i: i >= 0,
        )

    def keys(starts: Column, places: Column) -> Column:
        return F.transform(
            starts,
            lambda start, k: F.shiftleft(
                (F.coalesce(F.get(starts, k + 1), F.size(words_)) - start).cast("long"), 32
            )
            + (F.lit(_LAST_PLACE) - F.get(places, k)["pos"]),
        )

    ranked = let(
        let(F.sort_array(words_), run_starts),
        lambda starts: let(
            placed, lambda places: F.slice(F.sort_array(keys(starts, places), False), 1, limit)
        ),
    )

    def decoded(key: Column) -> Column:
        pos = F.lit(_LAST_PLACE) - key.bitwiseAND(F.lit(2**32 - 1))
        return F.struct(
            F.shiftright(key, 32).alias("n"),
            pos.alias("first_pos"),
            F.get(distinct, pos.cast("int")).alias("word"),
        )

    return F.transform(ranked, decoded)


def language_hint(tokens: Column, mode: str = "compat") -> Column:
    """Language whose marker words occur most; ties in marker-table order.

    ``compat`` scores markers after stop words are removed. Every English
    marker is a stop word, so English then never wins. ``all_words`` scores
    before stop words are removed.
    """
    if mode not in ("compat", "all_words"):
        raise ValueError(f"unknown language mode: {mode}")
    usable = {
        lang: [w for w in markers if mode == "all_words" or w not in C.STOP_WORDS]
        for lang, markers in C.LANGUAGE_MARKERS.items()
    }
    every = sorted({w for markers in usable.values() for w in markers})

    def decide(found: Column) -> Column:
        scores = F.array(
            *[
                F.size(F.array_intersect(found, literal_array(ws))) if ws else F.lit(0)
                for ws in usable.values()
            ]
        )
        return let(
            scores,
            lambda s: F.when(F.array_max(s) == 0, C.UNKNOWN_LANGUAGE).otherwise(
                F.get(
                    literal_array(list(usable)),
                    (F.array_position(s, F.array_max(s)) - 1).cast("int"),
                )
            ),
        )

    return let(F.array_intersect(tokens, literal_array(every)), decide)


def has_tables(text: Column) -> Column:
    return F.contains(text, F.lit(C.TABLE_MARKER))


def has_images(text: Column) -> Column:
    return F.contains(text, F.lit(C.IMAGE_MARKER))


def average(total: Column, parts: Column) -> Column:
    """Mean to two places, no parts counting as one, rounded as its exact
    binary value demands (half to even only if that value is a tie).

    ``bround`` rounds the printed value, so 107/40 would become 2.68 although
    the double lies below 2.675. The mean is split into its whole part, a
    multiple of 2**-32 and a remainder; all times 100 are exact, and so is the
    comparison.
    """

    def rounded(q: Column) -> Column:
        whole = F.floor(q)
        scaled = (q - whole) * F.lit(float(2**32))
        part = F.floor(scaled)
        rest = (scaled - part) * F.lit(100.0)
        hundredths = F.shiftright(part * 100, 32)
        gap = F.lit(2**31) - F.pmod(part * 100, F.lit(2**32))
        up = (rest > gap) | ((rest == gap) & (hundredths % 2 == 1))
        return (whole * 100 + hundredths + F.when(up, 1).otherwise(0)) / F.lit(100.0)

    return let(total / F.greatest(parts, F.lit(1)), rounded)


def text_chunks(text: Column, size: int = C.CHUNK_CHARS) -> Column:
    """Consecutive pieces of ``size`` characters, one linear pass."""
    if size < 1:
        raise ValueError("chunk size must be positive")
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0))


def page_texts(text: Column) -> Column:
    """Stripped non-blank pieces between page markers, in order."""
    pieces = F.split(text, C.PAGE_MARKER_PATTERN, -1)
    return F.filter(F.transform(pieces, strip), lambda p: p != "")
