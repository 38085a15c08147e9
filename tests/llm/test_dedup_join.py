import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafwork.llm import exact_dedup, jaccard
from leafwork.llm.common import lookup, word_hashes
from tests.llm.cases import TEXTS, documents, empty


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        out.append((d, min(ids) if ids else None, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_exact_groups_of_odd_rows(spark):
    docs = documents(spark)
    got = exact_dedup.exact_groups(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(expected_groups(rows))
    assert sum(r.kept for r in got) == len({norm(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_colliding_keys_are_chained_and_overfull_buckets_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_groups(docs, key_bits=6, entries=2).collect()
    assert max(r.chain for r in got) > 0 and len({r.bucket for r in got}) > 16
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(expected_groups(rows))


def test_directory_covers_all_keys_and_doubles_to_the_limit(spark):
    keys = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("key"))
    pointers, depth = exact_dedup.directory(keys, entries=64, key_bits=20)
    table = {r.pointer: r.bucket for r in pointers.collect()}
    assert sorted(table) == list(range(1 << depth))
    load = defaultdict(int)
    for r in keys.collect():
        load[table[r.key >> (20 - depth)]] += 1
    assert max(load.values()) <= 64


def test_deduplicated_keeps_columns(spark):
    docs = documents(spark)
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert len({norm(r.text) for r in got.collect()}) == got.count()
    assert exact_dedup.deduplicated(empty(spark)).count() == 0 == exact_dedup.exact_groups(empty(spark)).count()


def expected_components(rows, size, num, den):
    sets = []
    for _, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def test_similar_groups_of_odd_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()]
    assert order(got) == order(expected_components(rows, 4, 85, 100))
    assert jaccard.similar_groups(empty(spark)).count() == 0


def test_similar_groups_with_chains_families_and_a_common_passage(spark):
    rng = np.random.default_rng(5)
    words = [f"v{k}" for k in range(3000)]
    rows, passage = [], list(rng.choice(words, 60))
    for base in range(12):
        text = list(rng.choice(words, int(rng.integers(40, 200))))
        for _ in range(int(rng.integers(1, 9))):
            for at in rng.integers(0, len(text), int(rng.integers(0, 4))):
                text[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join(passage + list(rng.choice(words, 7)))) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()]
    assert order(got) == order(expected_components(rows, 4, 85, 100))


def test_prefixes_of_every_order_hold_a_shared_token():
    rng = np.random.default_rng(1)
    none = jaccard.Order(None, np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    for _ in range(200):
        a = rng.choice(500, int(rng.integers(4, 90)))
        b = a.copy()
        b[rng.integers(0, len(b))] = 999
        x, y = jaccard.token_sets(pa.array([" ".join(map(str, t)) for t in (a, b)]), 4)
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            p, q = (none.prefix(t, jaccard.prefix_length(len(t), 85, 100)) for t in (x, y))
            assert np.isin(p, q).any()
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            p = none.prefix(small, jaccard.index_length(len(small), 85, 100))
            assert np.isin(p, none.prefix(large, jaccard.prefix_length(len(large), 85, 100))).any()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(1000, 1300)]
    links = spark.createDataFrame(chain + star, "a long, b long")
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(1000, 1300)} == {7}


def test_lookup_of_a_hot_key_and_a_missing_one(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).when(F.col("id") < 2990, F.col("id")).alias("k"))
    table = rows.where("k < 2900").groupBy("k").agg(F.count("*").alias("n"), (F.first("k") * 2).alias("v"))
    got = lookup(rows, table, "k", "n", ["id"]).collect()
    assert len(got) == 3000
    assert all(r.v == (r.k * 2 if r.k is not None and r.k < 2900 else None) for r in got)


def test_word_hashes_tell_words_apart_and_only_words(monkeypatch):
    from leafwork.llm import common

    texts = [t or "" for t in TEXTS] + ["", "  ", "a b", "ab", "b a", "A\x0bB", "É é", "x" * 3000 + " y", ""]
    for chunk in (1, 50, 1 << 20):
        monkeypatch.setattr(common, "CHUNK", chunk)
        for typed in (pa.array(texts), pa.array(["zz zz", *texts])[1:], pa.array(texts, pa.large_string())):
            known, n = {}, 0
            words = (h[a:b] for h, ends in word_hashes(typed) for a, b in zip(ends[:-1], ends[1:]))
            for text, got in zip(texts, words, strict=True):
                want = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
                assert len(got) == len(want)
                n += 1
                for h, w in zip(got.tolist(), want):
                    assert known.setdefault(h, w) == w
            assert n == len(texts) and len(set(known.values())) == len(known)


def test_links_are_named_for_what_they_count(spark):
    found = jaccard.similar_groups(documents(spark))
    assert "compared_links" in found.columns and "n_links" not in found.columns


def test_margin_grows_with_large_sets():
    assert jaccard.margin(1000, 1000) == jaccard.MARGIN
    # Two million elements each: about 931 chance matches.
    assert jaccard.margin(2_000_000, 2_000_000) > 931 + jaccard.MARGIN


def test_small_tables_are_saved_in_few_files(spark, monkeypatch):
    # Each file costs a task and processes, also where Spark joins no partitions of a shuffle.
    own = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    files, put = [], jaccard.saved

    def counted(rows, name, *limits):
        table = put(rows, name, *limits)
        files.append((name, len(table.inputFiles())))
        return table

    monkeypatch.setattr(jaccard, "saved", counted)
    texts = [" ".join(f"f{k % 9}w{j + (k > 20) * (j == 30)}" for j in range(60)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert order(got) == order(expected_components(list(enumerate(texts)), 4, 85, 100))
    small = [n for name, n in files if name.startswith("cc-") or name in ("jaccard-kinds", "jaccard-roles", "jaccard-compared")]
    assert len(small) > 8 and max(small) == 1
