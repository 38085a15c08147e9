"""Documents in parts, cut anywhere, against the same documents whole."""

import random

import pytest
from pyspark.sql import functions as F

from leafwork.functions.html import html_text
from leafwork.operators import extract, outputs, parts

SCHEMA = "doc_id int, part_no long, text string"


def cuts(text, rng, most):
    """Parts of a text: a few, or one per character, some of them empty."""
    n = rng.choice([0, 1, 2, most, len(text)])
    at = sorted(rng.randrange(len(text) + 1) for _ in range(n)) if n < len(text) else list(range(len(text)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def cut_rows(texts, rng, most=6):
    """Part numbers rise but are not dense."""
    out = []
    for k, text in enumerate(texts):
        no = rng.randrange(-3, 5)
        for piece in cuts(text, rng, most):
            out.append((k, no, piece))
            no += rng.choice([1, 1, 2, 1500])
    return out


def frames(rows, texts, seed):
    rng = random.Random(seed)
    return rows(SCHEMA, *cut_rows(texts, rng)).repartition(5), rows("doc_id int, text string", *enumerate(texts))


CSV_PIECES = ['"', '""', ",", "\n", "\r\n", "\r", "a", "b c", '"x"', '"a,b"', '"l1\nl2"', '"q""q"', "ü", '"x"y']


def test_csv_parts(rows):
    rng = random.Random(1)
    texts = ["".join(rng.choice(CSV_PIECES) for _ in range(rng.randrange(0, 40))) for _ in range(250)]
    texts += ["", '"', '""', "\r", "\r\n", 'a,"never closed\n' + "x,\n" * 30, 'a\r\n"b\r\n""c"""\r\nd', ","]
    cut, whole = frames(rows, texts, 2)
    want = sorted(map(tuple, extract.csv_rows(whole).collect()), key=lambda r: (r[0], r[1]))
    got = sorted(map(tuple, parts.csv_part_rows(cut).collect()), key=lambda r: (r[0], r[1]))
    assert got == [(d, n, t) for d, n, t in ((r[0], r[1], r[2]) for r in want)]
    chunks = {(r.doc_id, r.chunk_no, r.text) for r in extract.csv_to_text(whole, rows_per_chunk=3).collect()}
    assert {(r.doc_id, r.chunk_no, r.text) for r in parts.csv_parts_to_text(cut, 3).collect()} == chunks
    assert parts.csv_part_rows(cut.limit(0)).count() == 0


MARKS = ["--- Page 1 ---", "--- Page 23 ---\n", "--- Page ", "-", "--", "---", "----", " ", "Page", "P", "1", "٣", " ---", "x", "\n", "text", "--- Page 4 --"]


def test_pages_across_parts(rows):
    rng = random.Random(3)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    texts += ["--- Page 1 --- Page 2 ---", "--- Page 1 ------ Page 2 ---", "--- P--- Page 7 ---x", "a" * 50, "", " \n"]
    cut, whole = frames(rows, texts, 4)
    want = sorted((r.doc_id, r.page_no, r.text) for r in outputs.split_pages(whole).collect())
    for got in (parts.part_pages(cut), outputs.split_part_pages(cut)):
        assert sorted((r.doc_id, r.page_no, r.text) for r in got.collect()) == want


HTML_PIECES = [
    "<p>", "</p>", "<b class='x'>", '<a href="u>v">', "</a>", "<", ">", "text", " ", "\n", "&amp;", "&am", "p;", "<!-- c -->",
    "<!--", "-->", "<script>", "</script>", "<script src='a>b'>", "<style >p{}", "</style >", "<template>", "</template>",
    "<noscript/>", "</noscript>", "<rt>", "</rt>", "<ruby>", "</ruby>", "<rp >(", '"', "'", "<!doctype html>", "<!x>", "<?y?>",
    "< 5", "<scripts>", "<br/", "<i t=\"a<b>c\">", "<script a=\"<p>\">", "Ünï", "<!-->",
]


@pytest.mark.parametrize("seed", [5, 6])
def test_html_parts(rows, seed):
    rng = random.Random(seed)
    calm = [p for p in HTML_PIECES if p not in ('"', "'", "<!--")]
    texts = ["".join(rng.choice(rng.choice([calm, HTML_PIECES])) for _ in range(rng.randrange(0, 30))) for _ in range(220)]
    texts += ["", "no tags at all", "<p>", "a<b", "<!DOCTYPE x [<!ENTITY a '<b>'>]>t<p>u", "x<a title='<p>never closed"]
    cut, whole = frames(rows, texts, seed)
    want = {r.doc_id: r.t for r in whole.select("doc_id", html_text(F.col("text")).alias("t")).collect() if r.t}
    got = {}
    for r in sorted(parts.html_part_texts(cut).collect(), key=lambda r: (r.doc_id, r.part_no)):
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == want


def test_given_pages_in_parts(spark, sf_dir):
    rng = random.Random(8)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    pieces = [
        (k, n, piece) for k, html in pages.items()
        for n, piece in enumerate(cuts(html, rng, 9) if len(html) < 3000 else [html[i : i + 400] for i in range(0, len(html), 400)])
    ]
    cut = spark.createDataFrame(pieces, "doc_id long, part_no long, text string")
    want = {r.page_id: r.t for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text(F.col("html")).alias("t")).collect()}
    got = {}
    for r in sorted(parts.html_part_texts(cut).collect(), key=lambda r: (r.doc_id, r.part_no)):
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == want


def test_running_over_blocks(rows):
    rng = random.Random(9)
    data = [(d, n, rng.choice([None, 1, 2, 30])) for d in range(4) for n in rng.sample(range(-50, 400), 60)]
    df = rows("doc_id int, no long, v long", *data)
    for how, by_hand in ((F.sum, sum), (F.max, max)):
        got = {(r.doc_id, r.no): r.before for r in parts.running(df, "doc_id", "no", "v", how, block_size=7).collect()}
        for d, n, _ in data:
            earlier = [v for e, m, v in data if e == d and m < n and v is not None]
            assert got[d, n] == (by_hand(earlier) if earlier else None)


def test_states_over_blocks(rows):
    rng = random.Random(10)
    steps = [(d, n, "".join(rng.choice("xyz") for _ in range(3))) for d in range(3) for n in rng.sample(range(200), 90)]
    got = {(r.doc_id, r.no): r.state for r in parts.carried_states(rows("doc_id int, no long, step string", *steps), "doc_id", "no", "xyz", block_size=8).collect()}
    for d in range(3):
        state = "x"
        for _, n, step in sorted(s for s in steps if s[0] == d):
            assert got[d, n] == state
            state = step["xyz".index(state)]


def test_records_in_parts_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, 0, 'a,"b'), (1, 1, 'c"\nd,e\n'), (2, 0, "x")], "doc_id long, part_no long, text string")
    found = parts.csv_part_rows(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # what numbers them and what tells them read the same table
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a | bc"), (1, 2, "d | e"), (2, 1, "x")]
