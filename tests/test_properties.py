"""Brute force in plain Python on random inputs, one Spark job per property."""

import csv as stdlib_csv
import io
import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import csv, paths, text
from leafwork.operators import analyze, extract

PIECES = [
    "the", "and", "que", "der", "les", "cat", "Dog", "naïve", "abc1", "_x", "ŽLUŤ", "İ", "Kelvin", "ſome",
    " ", "  ", "\n", "\r\n", "\r", "\t", " ", "\xa0", "-", "--- Page 1 ---", "--- Page ", "[TABLE 1]",
    "[IMAGE TEXT]", "١٢", "中文", "😀", ".", ",", '"', '""', "é", "a", "zz",
]


def _texts(n: int, seed: int, pieces=PIECES, most: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [""] + ["".join(rng.choices(pieces, k=rng.randint(0, most))) for _ in range(n)]


def _frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def _expected(body: str) -> tuple:
    """Line by line, as a text file would be read."""
    counter, words_total, lines, chars, pages = Counter(), 0, 0, 0, 0
    for line in io.StringIO(body, newline=None):
        lines += 1
        chars += len(line)
        pages += line.startswith("--- Page ")
        words = re.findall(r"\b[a-zA-Z]{3,}\b", line.lower())
        words_total += len(words)
        counter.update(w for w in words if w not in C.STOP_WORDS)
    return chars, words_total, lines, pages, [w for w, _ in counter.most_common(20)]


def test_analytics_match_a_line_reader(spark):
    values = _texts(400, seed=1)
    out = analyze.analyze_text(_frame(spark, values)).orderBy("id").collect()
    got = [(r["total_chars"], r["total_words"], r["total_lines"], r["total_pages"], r["top_words"]) for r in out]
    assert got == [_expected(v) for v in values]


def test_parts_give_what_the_whole_gives(spark):
    values = _texts(60, seed=2, most=200)
    parts = []
    for i, value in enumerate(values):
        body = re.sub(r"\r\n?", "\n", value)
        lines = re.findall(r"[^\n]*\n|[^\n]+$", body) or [""]
        parts += [(i, n, line) for n, line in enumerate(lines)]
    frame = spark.createDataFrame(parts, "doc_id int, part_no int, text string")
    for mode in ("compat", "all_words"):
        split = analyze.analyze_parts(frame, language_mode=mode).orderBy("doc_id").collect()
        whole = analyze.analyze_text(_frame(spark, values), language_mode=mode).orderBy("id").collect()
        for column in analyze.ANALYTICS:
            assert [r[column] for r in split] == [r[column] for r in whole], column


def test_csv_matches_the_standard_reader(spark):
    values = _texts(500, seed=3, pieces=["a", "b c", ",", ",", '"', '""', "\n", "\r\n", "\r", " ", "é"], most=25)
    out = _frame(spark, values).select("id", csv.csv_records(F.col("text")).alias("r")).orderBy("id")
    for value, row in zip(values, out.collect()):
        want = [" | ".join(r) for r in stdlib_csv.reader(io.StringIO(value, newline=""))]
        assert row["r"] == want, repr(value)


def test_page_split_matches_re_split(spark):
    values = _texts(300, seed=4)
    out = _frame(spark, values).select("id", text.page_texts(F.col("text")).alias("p")).orderBy("id")
    for value, row in zip(values, out.collect()):
        pieces = re.split(r"--- Page \d+ ---\n?", value)
        assert row["p"] == [p.strip() for p in pieces if p.strip()]


def test_extension_matches_splitext(spark):
    values = _texts(500, seed=5, pieces=["a", "b", ".", "/", "..", ".txt", "é"], most=8)
    out = _frame(spark, values).select("id", paths.extension(F.col("text")).alias("e")).orderBy("id")
    assert [r["e"] for r in out.collect()] == [os.path.splitext(v)[1] for v in values]


def test_strip_matches_str_strip(spark):
    values = _texts(300, seed=6, pieces=list(" \t\n\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200bab"), most=8)
    out = _frame(spark, values).select("id", text.strip(F.col("text")).alias("s")).orderBy("id")
    assert [r["s"] for r in out.collect()] == [v.strip() for v in values]


def test_chunks_rejoin(spark):
    values = _texts(100, seed=7)
    chunks = extract.chunk_text(_frame(spark, values), size=7)
    for per_part in (1, 3, 1000):
        parts = extract.concat_chunks(chunks, "id", chunks_per_part=per_part).orderBy("id", "part_no")
        joined: dict[int, str] = {}
        for r in parts.collect():
            joined[r["id"]] = joined.get(r["id"], "") + r["text"]
        assert joined == {i: v for i, v in enumerate(values) if v}
        totals = extract.document_totals(parts, "id").collect()
        assert {r["id"]: (r["total_chars"], r["pages_processed"]) for r in totals} == {
            i: (len(v), -(-len(v) // 7)) for i, v in enumerate(values) if v
        }


def test_line_parts_rejoin_and_end_at_lines(spark):
    values = _texts(200, seed=8, pieces=["a", "bb", "\n", "\n\n", "\r\n", "é😀", "long line "], most=40)
    out = extract.line_parts(_frame(spark, values), size=10).orderBy("id", "part_no").collect()
    parts: dict[int, list[str]] = {}
    for r in out:
        assert r["part_no"] == len(parts.setdefault(r["id"], []))
        parts[r["id"]].append(r["text"])
    for i, value in enumerate(values):
        assert "".join(parts[i]) == value
        assert all(p.endswith("\n") for p in parts[i][:-1])
        assert all(len(p) <= 10 or p.rstrip("\n").count("\n") == 0 for p in parts[i])


def test_average_rounds_as_python_does(spark):
    rng = random.Random(9)
    cases = [(w, lines) for lines in (8, 16, 40, 80, 200, 400) for w in range(0, 6 * lines, 1)]
    cases += [(rng.randint(0, 10**6), rng.randint(1, 5000)) for _ in range(3000)]
    cases += [(3 * 10**9, 2), (10**7, 3)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, w long, l long")
    out = frame.select("id", text.average(F.col("w"), F.col("l")).alias("a")).orderBy("id").collect()
    assert [r["a"] for r in out] == [round(w / lines, 2) for w, lines in cases]


def test_documents_without_text_keep_a_row(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, None)], "id long, text string")
    chunks = extract.chunk_text(docs, size=2)
    parts = extract.concat_chunks(chunks, "id", chunks_per_part=2, documents=docs)
    got = {(r.id, r.part_no): (r.text, r.total_chars, r.pages_processed) for r in parts.collect()}
    assert got == {(1, 0): ("abcd", 4, 2), (1, 1): ("ef", 2, 1), (2, 0): ("", 0, 0), (3, 0): ("", 0, 0)}
    assert {r.id for r in extract.concat_chunks(chunks, "id").collect()} == {1}
