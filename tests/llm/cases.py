"""Rows that every operator has to take: nulls, empty and long texts, ties, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
TEXTS = [
    None, "", "   \t\n ", "a", "one two three", "one two  three", "one\ttwo three", "Ünïcode ßtraße 日本語 ﬁ ² e\u0301",
    "the quick brown fox jumps over the lazy dog and runs away", "The Quick brown fox jumps over the lazy dog and runs away",
    "the quick brown fox jumps over the lazy dog and runs away", LONG, LONG + " end", "<|endoftext|> inside", "x" * 5000,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, sid long, key long, rank string"


def documents(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k else None, len(t or ""), "clash", 1, 2, "r") for k, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None)]
    rows += [rows[5], rows[5]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=15):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(n)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
