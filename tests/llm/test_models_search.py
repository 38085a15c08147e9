import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafwork.llm import bm25, mixing, quality, toxicity, url_rules
from tests.llm.cases import documents, empty, labels

TEST = "/root/testdata/sf0.01"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w]


@pytest.mark.parametrize("operator, label, least", [(quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.93)])
def test_held_out_accuracy(spark, operator, label, least):
    from zlib import crc32

    docs, known = (spark.read.parquet(f"{TEST}/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, known).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r[label] for r in known.collect()}
    mine = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(mine) > 40 and np.mean([a == b for a, b in mine]) >= least


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(spark, operator):
    docs = documents(spark)
    assert operator(docs, labels(spark)).count() == docs.count()
    assert operator(docs, labels(spark).limit(0)).count() == docs.count()
    assert operator(empty(spark), labels(spark)).count() == 0
    got = {r.doc_id: r.score for r in operator(docs, labels(spark)).collect()}
    assert got[0] == got[1]


def test_negative_risk_is_held_at_zero():
    rng = np.random.default_rng(0)
    positive = np.c_[np.ones(300), rng.normal(2, 1, (300, 3))].astype(np.float32)
    negative = np.c_[np.ones(300), rng.normal(-2, 1, (300, 3))].astype(np.float32)
    w = quality.fit_pu(positive, np.concatenate([positive[:150], negative[:150]]), 0.5)
    assert (positive @ w > 0).mean() > 0.95 and (negative @ w < 0).mean() > 0.95


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    right = [0.9, 0.8, 0.7, 0.6]
    v = np.stack([np.where((rng.random(4000) < p) == y, 1, -1) for p in right], 1)
    v = np.c_[v, v[:, 3], v[:, 3], v[:, 3]]  # the worst voter three times more
    post, table, weight = toxicity.label_model(v, 0.3)
    assert ((post > 0.5) == y).mean() > 0.88
    assert table[1, 0, 2] > table[1, 2, 2] > table[1, 3, 2] and weight[3] < 0.5 < weight[0]


def test_features_read_whole_texts():
    hits = toxicity.Hits({"bad": 0})
    assert toxicity.features("fine " * 100_000 + "bad", hits)[1] > 0
    shapes = quality.Shapes()
    assert (quality.features("fine words " * 9 + "x|| " * 50_000, shapes) != quality.features("fine words " * 9, shapes)).any()


def brute_bm25(rows, queries, k):
    words = {d: Counter(split(t)) for d, t in rows}
    n, average = len(rows), sum(sum(c.values()) for c in words.values()) / len(rows)
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, t in queries:
        score = defaultdict(float)
        for w in sorted(set(split(t))):
            for d, c in words.items():
                if c[w]:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    score[d] += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
        best = sorted(((-round(s, 6), d) for d, s in score.items()))[:k]
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(best)]
    return out


def test_search_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_ROWS", 70)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = sorted((tuple(r) for r in bm25.top_k(docs, queries).collect()), key=lambda r: (r[0], r[3]))
    want = sorted(brute_bm25(rows, [tuple(r) for r in queries.collect()], 10), key=lambda r: (r[0], r[3]))
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want]
    assert np.allclose([a[2] for a in got], [a[2] for a in want], atol=2e-6)


def test_pruned_blocks_change_nothing():
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 30) % 500)) for k in range(600)]
    docs = [(d, *c) for (d, _), c in zip(rows, bm25.term_counts(pa.array([t for _, t in rows])))]
    term = np.concatenate([t for _, t, _, _ in docs])
    order = np.argsort(term, kind="stable")
    found, first = np.unique(term[order], return_index=True)
    place = np.repeat(np.arange(600, dtype="<i4"), [len(t) for _, t, _, _ in docs])
    count = np.concatenate([c for _, _, c, _ in docs]).astype("<i4")
    length = np.array([n for *_, n in docs], "<i8")
    parts = dict(ids=np.arange(600, dtype="<i8"), lengths=length, terms=found, offsets=np.append(first, len(term)).astype("<i8"), places=place[order], counts=count[order])
    shard = bm25.Shard({k: v.tobytes() for k, v in parts.items()}, length.mean())
    df = np.diff(parts["offsets"])
    for q in range(0, 600, 50):
        t = docs[q][1]
        w = np.log(1 + (600 - df[np.searchsorted(found, t)] + 0.5) / (df[np.searchsorted(found, t)] + 0.5))
        want = brute_bm25(rows, [(q, rows[q][1])], 10)
        assert [d for d, _ in shard.search(t, w, 10)] == [r[1] for r in want]


def test_blocks_that_tie_only_when_rounded_are_searched():
    # One term; document 0, of the third block, is under the others by less than rounding shows.
    n = 3 * bm25.BLOCK_ROWS
    ids = np.array([*range(1, 2 * bm25.BLOCK_ROWS + 1), 0, *range(1000, 1000 + bm25.BLOCK_ROWS - 1)], "<i8")
    length = np.full(n, 10, "<i8")
    length[2 * bm25.BLOCK_ROWS :] = 1_000
    parts = dict(ids=ids, lengths=length, terms=np.array([7], np.uint64), offsets=np.array([0, n], "<i8"), places=np.arange(n, dtype="<i4"), counts=np.full(n, 1, "<i4"))
    shard = bm25.Shard({k: v.tobytes() for k, v in parts.items()}, 10.0)
    shard.impacts[:] = 1.0
    shard.impacts[2 * bm25.BLOCK_ROWS :] = 1.0 - 2e-7
    shard.most[:] = np.maximum.reduceat(shard.impacts, shard.starts[:-1])
    assert [d for d, _ in shard.search(np.array([7], np.uint64), np.array([1.0]), 10)] == list(range(10))


def test_search_of_odd_rows(spark):
    docs = documents(spark)
    queries = docs.selectExpr("doc_id AS query_id", "text", "'x' AS score")
    got = bm25.top_k(docs, queries).collect()
    assert {r.query_id for r in got} == {r.doc_id for r in docs.collect() if r.doc_id is not None and split(r.text)}
    assert bm25.top_k(empty(spark), queries).count() == 0 == bm25.top_k(docs, queries.limit(0)).count()


def test_mix_meets_its_targets(spark):
    sizes = {"big": 6000, "mid": 600, "small": 60}
    rows = [(k, s, "w " * 9) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    placed = mixing.mix(docs, entropy=0.7, max_epochs=50, block_tokens=4000).collect()
    weight = {r.source: r.weight for r in placed}
    entropy = -sum(w * math.log(w) for w in weight.values()) / math.log(3)
    assert abs(sum(weight.values()) - 1) < 1e-6 and abs(entropy - 0.7) < 1e-3
    total, got = sum(sizes.values()) * 10, Counter()
    for r in placed:
        got[r.source] += r.tokens
    assert all(abs(got[s] - weight[s] * total) <= 10 for s in sizes)
    # Whole passes before a document comes again, and every run of blocks has the mix.
    times = Counter((r.source, r.doc_id) for r in placed)
    for s in sizes:
        n = [times.get((s, k), 0) for k in range(sizes[s])]
        assert max(n) - min(n) <= 1
    half = max(r.block for r in placed) // 2
    early = Counter()
    for r in placed:
        if r.block < half:
            early[r.source] += r.tokens
    assert all(abs(early[s] / sum(early.values()) - weight[s]) < 0.02 for s in sizes)
    starts = defaultdict(list)
    for r in placed:
        starts[r.source].append((r.start, r.tokens))
    for s in starts.values():
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n


def test_mix_keeps_the_repetition_limit_and_natural_shares(spark):
    rows = [(k, "big" if k >= 20 else "small", "w " * 9) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    small = [r for r in mixing.mix(docs, entropy=1.0, max_epochs=3).collect() if r.source == "small"]
    assert 59 <= len(small) <= 61
    natural = mixing.mix(docs, entropy=0.01).collect()
    assert sorted(r.doc_id for r in natural) == list(range(2000)) and natural[0].exponent == 1.0


def test_mix_of_odd_rows(spark):
    docs = documents(spark)
    assert mixing.mix(docs, entropy=0.0).count() == docs.count()
    assert mixing.mix(empty(spark)).count() == 0
    got = mixing.mixed_documents(docs, entropy=0.0)
    assert got.columns == docs.columns


URLS = [
    "http://a.net/x", "http://a.net", "https://Example.NET/en/1?q=/fr/", "http://notexample.net/en/", "http://x.example.com/de/a#b", "http://example.com/dex",
    "http://org/fr/", "http://b.org/fr", "nothing", "", None, "http://c.com/casino/x", "http://c.com/casinox", "http://net:80/x", "a://b://c.net/", "http://d.net\n/x",
    "http://e.com/CASINO", "HTTP://F.COM?x=://g.net/",
]


def test_url_rules_against_plain_python(spark):
    rows = [(k, u, "c", "d") for k, u in enumerate(URLS)] + [(None, "http://a.net/x", "c", "d"), (0, URLS[0], "c", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    rules = url_rules.site_rules(spark, url_rules.SITE_RULES).union(url_rules.token_rules(spark, url_rules.TOKEN_PATTERNS))
    got = url_rules.judge(pages, rules).collect()

    def want(page, url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(found[1]), found[2]) if found else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in url_rules.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return (page, host, path, max(fit)[1], max(fit)[2])
        bad = any(t in re.split("[^a-z0-9]+", (host + path).lower()) for t in url_rules.TOKEN_PATTERNS)
        return (page, host, path, None, "block" if bad else "allow")

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(want(r[0], r[1])) for r in rows)
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_tokens_end_at_characters_beyond_ascii(spark):
    urls = ["http://\u00fccasino.com/", "http://a.com/\u00fccasino\u00fc", "http://a.com/xcasino\u00fc", "http://m\u00fcnchen.de/x", "http://b.m\u00fcnchen.de/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_rules.site_rules(spark, [("m\u00fcnchen.de", "/", "block")]).union(url_rules.token_rules(spark, ["casino"]))
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, rules).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block"}


def test_rules_without_literals_and_in_any_number(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.com/p{k}") for k in range(300)], "page_id long, url string")
    many = url_rules.site_rules(spark, [(f"h{k}.com", "/", "block") for k in range(200)])
    free = spark.createDataFrame([("any", "(?s)p29[0-9]$", "block", [], 1)], many.schema)
    got = {r.page_id: r.rule for r in url_rules.judge(pages, many.union(free)).collect()}
    assert got[5] == "h5.com/" and got[295] == "any" and got[250] is None


def weights_by_hand(tokens, entropy, max_epochs, budget):
    """Weights by plain bisection of the exponent."""
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items()}

    def weights(t):
        z = sum(p**t for p in share.values())
        return {s: p**t / z for s, p in share.items()}

    def bisect(met, low, high):
        if met(low):
            return low
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if met(mid) else (mid, high)
        return high

    def spread(t):
        return -sum(w * math.log(w) for w in weights(t).values() if w)

    t = bisect(lambda t: spread(t) <= entropy * math.log(len(share)) + 1e-12, 0.0, 1.0)
    if t < 1:
        most, small = max(max_epochs, budget / total), min(tokens, key=tokens.get)
        t = bisect(lambda t: weights(t)[small] * budget / tokens[small] <= most + 1e-12, t, 1.0)
    return weights(t)


@pytest.mark.parametrize("entropy, epochs, budget", [(0.9, 4.0, None), (1.0, 2.5, 3000), (0.5, 9.0, 700), (0.0, 1.0, None)])
def test_mix_against_brute_force(spark, entropy, epochs, budget):
    rng = np.random.default_rng(int(entropy * 10))
    rows = [(int(k), s, "w " * int(rng.integers(0, 12))) for s, n in (("a", 150), ("b", 40), (None, 12)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix(docs, entropy=entropy, max_epochs=epochs, budget=budget, block_tokens=200).collect()
    size = {(s, k): len(t.split()) + 1 for k, s, t in rows}
    tokens = Counter()
    for (s, _), n in size.items():
        tokens[s] += n
    whole = budget or sum(tokens.values())
    want = weights_by_hand(tokens, entropy, epochs, whole)
    for s in tokens:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.start, r.epoch))
        quota, at, epoch_rows = math.floor(want[s] * whole), 0, defaultdict(list)
        assert all(abs(r.weight - want[s]) < 1e-6 for r in mine)
        for r in mine:
            # Gapless, whole passes in order, each copy with its own length, none past the quota.
            assert (r.start, r.tokens, r.epoch) == (at, size[s, r.doc_id], at // tokens[s]) and r.start < quota + 1
            at += r.tokens
            epoch_rows[r.epoch].append(r)
            per_block = max(want[s] * min(200, whole), 1e-9)
            assert abs(r.block - math.floor(r.start / per_block)) <= (abs(r.start / per_block - round(r.start / per_block)) < 1e-4)
        assert at >= quota - 1
        for epoch, there in epoch_rows.items():
            ids = [r.doc_id for r in there]
            assert len(set(ids)) == len(ids) and (epoch == max(epoch_rows) or len(ids) == sum(1 for k in size if k[0] == s))
            runs = [r.section for k, r in enumerate(there) if k == 0 or there[k - 1].section != r.section]
            assert len(runs) == len(set(runs))  # a section is one run
    for rows_of in (list(v) for v in _by_block(got).values()):
        assert sorted(r.position for r in rows_of) == list(range(1, len(rows_of) + 1))


def _by_block(rows):
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.block].append(r)
    return blocks


def test_one_id_or_none_on_a_third_of_the_rows(spark):
    for hot in (5, None):
        rows = [(hot if k % 3 == 0 else 10_000 + k, "s", f"text number {k}") for k in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        sections = Counter(r.section for r in mixing.mix(docs, entropy=0.0).collect())
        assert sum(sections.values()) == 3000 and max(sections.values()) < 200
        if hot:
            mixed = mixing.mixed_documents(docs, entropy=0.0).collect()
            assert sorted(r.text for r in mixed) == sorted(t for *_, t in rows)
        known = spark.createDataFrame([(i, 1, 1) for i, *_ in rows[:600]], "doc_id long, quality int, toxic int")
        for label in ("quality", "toxic"):
            assert quality.sample(docs, known, label, 10, 10).count() <= 20
        assert quality.quality_scores(docs, known, labelled=10, unlabelled=10).count() == 3000


def test_class_prior_and_calibration_without_negatives():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.85):
        positive = np.c_[np.ones(2000), rng.normal(1.5, 1, (2000, 4))].astype(np.float32)
        y = rng.random(4000) < prior
        other = np.c_[np.ones(4000), np.where(y[:, None], rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4)))].astype(np.float32)
        found = quality.class_prior(positive, other)
        assert abs(found - prior) < 0.05
        w = quality.fit_pu(positive, other, found)
        scale, shift = quality.pu_calibration(positive @ w, other @ w, found)
        score = 1 / (1 + np.exp(-(other @ w * scale + shift)))
        assert abs(score.mean() - prior) < 0.06 and ((score > 0.5) == y).mean() > 0.97


def test_many_queries_at_once_find_what_each_finds(monkeypatch):
    # Queries are scored together; common terms by a product, rare ones by postings.
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(bm25, "POSTINGS_AT_ONCE", 50)
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, 20) % 300)) for k in range(300)]
    docs = [(d, *c) for (d, _), c in zip(rows, bm25.term_counts(pa.array([t for _, t in rows])))]
    term = np.concatenate([t for _, t, _, _ in docs])
    order = np.argsort(term, kind="stable")
    found, first = np.unique(term[order], return_index=True)
    place = np.repeat(np.arange(300, dtype="<i4"), [len(t) for _, t, _, _ in docs])
    count = np.concatenate([c for _, _, c, _ in docs]).astype("<i4")
    length = np.array([n for *_, n in docs], "<i8")
    parts = dict(ids=np.arange(300, dtype="<i8"), lengths=length, terms=found, offsets=np.append(first, len(term)).astype("<i8"), places=place[order], counts=count[order])
    shard = bm25.Shard({k: v.tobytes() for k, v in parts.items()}, length.mean())
    df = np.diff(parts["offsets"])
    asked = [docs[q][1] for q in range(40)]
    weights = [np.log(1 + (300 - df[np.searchsorted(found, t)] + 0.5) / (df[np.searchsorted(found, t)] + 0.5)) for t in asked]
    runs = list(shard.search_all(np.cumsum([0, *map(len, asked)]), np.concatenate(asked), np.concatenate(weights), 10))
    assert len(runs) > 1 and 0 < shard.rows.shape[1] < len(found)
    got = [(q, d) for who, ids, _ in runs for q, d in zip(who.tolist(), ids.tolist())]
    assert got == [(r[0], r[1]) for r in brute_bm25(rows, rows[:40], 10)]


def test_a_shard_of_empty_texts_finds_nothing():
    row = dict(ids=np.arange(3, dtype="<i8"), lengths=np.zeros(3, "<i8"), terms=np.zeros(0, np.uint64), offsets=np.zeros(1, "<i8"), places=np.zeros(0, "<i4"), counts=np.zeros(0, "<i4"))
    shard = bm25.Shard({k: v.tobytes() for k, v in row.items()}, 1.0)
    assert shard.search(np.array([7], np.uint64), np.array([1.0]), 10) == []


def test_shards_searched_later_begin_with_the_kth_best(spark, sf_dir, monkeypatch):
    # Ten shards or so: each third is searched first, the others return only what can be among the best.
    monkeypatch.setattr(bm25, "SHARD_ROWS", 10)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(100)
    rows = [tuple(r) for r in docs.collect()]
    returned = []
    monkeypatch.setattr(bm25, "saved", lambda df, name, keep=bm25.saved: returned.append((name, keep(df, name))) or returned[-1][1])
    queries = spark.createDataFrame(rows[::5], "query_id long, text string")
    got = sorted((tuple(r) for r in bm25.top_k(spark.createDataFrame(rows, "doc_id long, text string"), queries, 5).collect()), key=lambda r: (r[0], r[3]))
    want = sorted(brute_bm25(rows, rows[::5], 5), key=lambda r: (r[0], r[3]))
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want]
    first, later = [df.count() for name, df in returned if name == "bm25-found"]
    assert 0 < later < first


def shard_of(kinds):
    """A shard's postings: documents of two kinds in turn, of words of their own and one of both."""
    rng = np.random.default_rng(3)
    texts = [f"both {' '.join(f'{kind}{int(x)}' for x in rng.integers(0, 40, 30))}" for kind in kinds]
    counted = list(bm25.term_counts(pa.array(texts)))
    found, term = np.unique(np.concatenate([t for t, _, _ in counted]), return_inverse=True)
    return texts, found, term, np.repeat(np.arange(len(texts)), [len(t) for t, _, _ in counted]), np.array([n for *_, n in counted])


def test_documents_alike_lie_side_by_side():
    kinds = ["a", "b"] * 200
    _, _, term, place, length = shard_of(kinds)
    order = bm25.alike(term, place, length)
    assert sorted(order.tolist()) == list(range(400))
    assert sum(kinds[a] != kinds[b] for a, b in zip(order[:-1], order[1:])) < bm25.GROUPS


def test_rare_postings_that_count_one_are_places_only():
    # Few bits each, in rows: they are walked for every query. Counts over one keep their impacts.
    n, rng = 700, np.random.default_rng(8)
    count = rng.integers(1, 3, n).astype("<i4")
    parts = dict(ids=np.arange(n, dtype="<i8"), lengths=rng.integers(5, 50, n).astype("<i8"), terms=np.arange(70, dtype=np.uint64))
    parts |= dict(offsets=np.arange(0, n + 1, 10, dtype="<i8"), places=np.arange(n, dtype="<i4"), counts=count)
    shard = bm25.Shard({k: v.tobytes() for k, v in parts.items()}, 20.0)
    terms, weight = np.arange(0, 70, 7).astype(np.uint64), np.linspace(1, 2, 10)
    got = shard.search(terms, weight, 100)
    held = np.concatenate([np.arange(10 * int(t), 10 * int(t) + 10) for t in terms])
    score = np.round(np.repeat(weight, 10) * shard.impacts[held], 6)
    order = np.lexsort((held, -score))
    assert [d for d, _ in got] == held[order].tolist() and np.allclose([s for _, s in got], score[order], atol=2e-6)
    (_, once, none), (_, several, values) = shard.rare_rows
    assert once.dtype == np.int16 and not none.size and several.shape == values.shape


def test_a_shard_in_memory_is_searched_for_several_blocks_of_queries(spark, monkeypatch):
    # One block of queries for each run over the index read and laid out every shard once more.
    monkeypatch.setattr(bm25, "SHARD_ROWS", 12)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 8 + k % 30) % 90)) for k in range(60)]
    runs = []
    monkeypatch.setattr(bm25, "saved", lambda df, name, keep=bm25.saved: runs.append(name) or keep(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame(rows[::5], "query_id long, text string")
    got = sorted((tuple(r) for r in bm25.top_k(docs, queries, 4).collect()), key=lambda r: (r[0], r[3]))
    want = sorted(brute_bm25(rows, rows[::5], 4), key=lambda r: (r[0], r[3]))
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want]
    assert runs.count("bm25-found") == 2


def test_documents_alike_lie_in_the_same_shards_by_length(monkeypatch):
    rng = np.random.default_rng(4)
    kinds = ["a", "b"] * 300
    texts = [" ".join(f"{kind}{int(x)}" for x in rng.integers(0, 40, 5 + k % 50)) for k, kind in enumerate(kinds)]
    heads, size, tie = pa.array(texts), np.array([len(t) for t in texts]), rng.integers(-(1 << 62), 1 << 62, 600)
    monkeypatch.setattr(bm25, "SHARD_ROWS", 20)
    where = bm25.Layout(heads, size, tie, 600)
    shard = where.shard(heads, size, tie)
    assert np.bincount(shard).tolist() == [20] * 30 and 0 < len(where.early) < 10
    mixed = [s for s in range(30) if len({kinds[i] for i in np.flatnonzero(shard == s)}) > 1]
    assert len(mixed) <= 1
    spread = [np.ptp(size[shard == s]) for s in range(30) if s not in mixed]
    assert np.median(spread) < np.ptp(size) / 3
    # Texts without words, and none at all.
    assert bm25.Layout(pa.array(["", " "]), np.array([0, 1]), np.array([1, 2]), 2).shard(pa.array([""]), np.array([0]), np.array([7])).tolist() == [0]
    assert bm25.Layout(pa.array([], pa.string()), np.zeros(0, int), np.zeros(0, int), 0).early == []


def test_queries_told_with_a_threshold_find_what_reaches_it(monkeypatch):
    monkeypatch.setattr(bm25, "FEW", 2)
    rng = np.random.default_rng(6)
    n = 900
    rows = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 25) % 400)) for k in range(n)]
    counted = list(bm25.term_counts(pa.array([t for _, t in rows])))
    term = np.concatenate([t for t, _, _ in counted])
    order = np.argsort(term, kind="stable")
    found, first = np.unique(term[order], return_index=True)
    place = np.repeat(np.arange(n, dtype="<i4"), [len(t) for t, _, _ in counted])
    count, length = np.concatenate([c for _, c, _ in counted]).astype("<i4"), np.array([x for *_, x in counted], "<i8")
    parts = dict(ids=np.arange(n, dtype="<i8"), lengths=length, terms=found, offsets=np.append(first, len(term)).astype("<i8"), places=place[order], counts=count[order])
    shard = bm25.Shard({k: v.tobytes() for k, v in parts.items()}, length.mean())
    df = np.diff(parts["offsets"])
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    want = defaultdict(list)
    for q, d, score, _ in brute_bm25(rows, rows[:30], 10):
        want[q].append((d, score))
    told = []
    for queries in (range(20), range(20, 30)):
        asked = [counted[q][0] for q in queries]
        # Every third threshold is the seventh score, others are out of reach, or none is known.
        known = np.array([(want[q][6][1], 1e6, 0.0)[q % 3] for q in queries])
        codes = np.searchsorted(found, np.concatenate(asked)).astype("<i4")
        # A term that the shard does not hold.
        told.append((np.cumsum([0, *map(len, asked)]), codes, np.append(found, np.uint64(2**64 - 1)), np.append(idf, 1.0), known))
    got = defaultdict(list)
    for block, who, ids, scores in shard.search_told(told, 10):
        for w, d, s in zip(who.tolist(), ids.tolist(), scores.tolist()):
            got[block * 20 + w].append((d, s))
    for q in range(30):
        least = (want[q][6][1] - 1e-5, 1e6, 0.0)[q % 3]
        assert [d for d, s in got[q] if s > least + 2e-5] == [d for d, s in want[q] if s > least + 2e-5]
        assert q % 3 != 1 or not got[q]
        assert q % 3 or len(got[q]) >= 7
