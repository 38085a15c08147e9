import random
import re

import duckdb

from leafwork.llm import licenses, oracles
from tests.llm.cases import LONG, TEXTS, documents, empty

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall


def words(text):
    return WORD(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def blocks_by_hand(text, templates):
    """Every block against every template."""
    mine, out = words(text), set()
    for k, (_, passage) in enumerate(templates):
        t, size = words(passage), 2
        while size < 2 * len(t):
            size *= 2
        for start in range(0, max(len(mine), 1), size // 2):
            if start and start + size // 2 >= len(mine):
                break
            shared = len(set(t) & set(mine[start : start + size]))
            if t and shared * licenses.OF >= len(set(t)) * licenses.CONTAINED:
                out.add((k, start, min(size, len(mine) - start), shared))
    return out


def by_hand(text):
    w, places = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    found = blocks_by_hand(text, licenses.TEMPLATES)
    base = {label for _, label in places}
    labels = base | {licenses.TEMPLATES[k][0] for k, *_ in found}
    score = max([float(bool(places))] + [n / len(set(words(licenses.TEMPLATES[k][1]))) for k, *_, n in found])
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


NOTICES = [t for _, t in licenses.TEMPLATES] + [
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
    "under the mit license UNDER THE MIT LICENSE", "under the mit license", "cc-by-nc cc by nc", "apache licensé version 2",
]


def texts_with_notices():
    rng = random.Random(11)
    common = words(" ".join(NOTICES)) + ["thing", "ou", "ünd", "42"]
    texts = list(TEXTS)
    for notice in NOTICES:
        before = " ".join(rng.choice(common[-30:]) for _ in range(rng.randrange(0, 200)))
        texts += [notice, f"{before}\n{notice}\n{before}", LONG + " " + notice]
        part = notice.split()
        for _ in range(3):  # some words changed: around the threshold
            texts.append(" ".join(w if rng.random() < 0.85 else "other" for w in part))
    texts += [" ".join(rng.choice(common) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    return texts


def test_scan_finds_what_counting_finds(spark):
    texts = texts_with_notices()
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, NOTICES[0], "x"), (3, NOTICES[-1], "x"), (3, NOTICES[-1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    got = licenses.scan(docs).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *by_hand(t))) for i, t, _ in rows)
    joined = licenses.license_blocks(docs).collect()
    want = [(i, *b) for i, t, _ in rows for b in blocks_by_hand(t, licenses.TEMPLATES)]
    assert sorted(map(repr, ((r.doc_id, r.template, r.first_word, r.block_words, r.shared) for r in joined))) == sorted(map(repr, want))
    assert any(r.block_words > r.shared for r in joined) and len(want) > 40


def test_other_templates(spark):
    rng = random.Random(12)
    letters = [chr(97 + k) for k in range(12)]
    templates = [(f"t{k}", " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 9)))) for k in range(25)]
    rows = [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [t for t in templates if t[1]]
    got = licenses.license_blocks(docs, templates).collect()
    want = [(i, *b) for i, t in rows for b in blocks_by_hand(t, kept)]
    assert sorted((r.doc_id, r.template, r.first_word, r.block_words, r.shared) for r in got) == sorted(want) and want
    assert licenses.license_blocks(docs, []).count() == 0
    assert licenses.scan(docs, [], {}).agg({"score": "max"}).first()[0] == 0


def test_scan_of_odd_rows(spark):
    docs = documents(spark)
    got = licenses.scan(docs)
    assert got.count() == docs.count()
    by = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert by[0] == by[1] == by[2] == (0, 0, None, None, "", "", 0.0)
    assert by[11] == by_hand(LONG)
    assert licenses.scan(empty(spark)).count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    text = "Ab1-ü2 x" * 50 + "y" * 100 + "\x00é\x7fZ"
    whole = [w for part in licenses.words_of(text) for w in part]
    assert [w.decode() for w in whole] == words(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(licenses, "SLICE", size)
        assert [w for part in licenses.words_of(text) for w in part] == whole


def test_check_sql_on_planted_texts(spark):
    texts = [t for t in texts_with_notices() if "\x1c" not in (t or "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    result = con.sql(oracles.LICENSES)
    want = sorted(repr(dict(zip(result.columns, r))) for r in result.fetchall())
    assert sorted(repr(r.asDict()) for r in licenses.scan(docs).select(*result.columns).collect()) == want
