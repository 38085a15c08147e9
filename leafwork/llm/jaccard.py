"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with a Jaccard similarity of at least s share a token among the first
``n - ceil(s * n) + 1`` of each, under any order of all tokens. The first order puts
tokens that many documents hold last, so shared passages make no candidates; others are
random orders. A pair must pass the filter of every order before its sets are compared.

Groups are never expanded to pairs: documents first meet one leader per prefix token;
only where a token still joins documents of different components are its other pairs
compared, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import lookup, mixed, partitions, saved, word_hashes

#: Tokens below this part of the hash range are counted; prefixes lie there unless most
#: of a document's tokens are frequent ones. As that is common in small sets, which hold
#: few of all tokens, all tokens of sets up to SMALL are counted.
COUNTED, SMALL = 0.3, 256
#: From so many documents on a token counts as frequent.
FREQUENT = 48
#: At most so many frequent tokens are told to the tasks (the most frequent), 16 bytes each.
FREQUENT_MOST = 1 << 19
#: Marks of tokens that more than one document holds: a bit each, of fixed size.
SHARED_BITS = 28
#: Tokens that a task counts before it sends its counts on.
COUNT_TOKENS = 1 << 20
#: Cells of the histogram over token hashes that bounds what two sets can share.
CELLS = 256
#: Sets are compared by 32 bits of each hash; a pair that passes by fewer tokens than this
#: is compared by all 64 as well; the margin grows with the tokens expected to agree by chance.
MARGIN = 8
#: Further random orders that a candidate pair has to pass.
ORDERS = 2
#: Turns of further leaders, while the pairs left are over so many times their postings.
TURNS, FEW_PAIRS = 2, 256
#: Marks, a bit each, of the texts that take part in comparisons.
KEY_MARKS = 22
#: A leader with d partners has about sqrt(d) / ROOT_GROUPS groups of them.
ROOT_GROUPS = 8
#: Pairs whose sets a task compares at least.
COMPARED_ROWS = 1 << 11
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    out = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + len(out)]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return mixed(out)


def token_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of runs of ``size`` words; of all its words where fewer."""
    for words, bounds in word_hashes(texts):
        runs = folded(words, size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                x = np.sort(runs[a : b - size + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            else:
                yield folded(words[a:b], b - a) if b > a else words[:0]


def set_id(tokens: np.ndarray) -> int:
    """Signed 64-bit id of a set; two of N sets share one with a chance of N*N / 2**65."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >> 63 else value


def least_shared(a: int, b: int, num: int, den: int) -> int:
    """Tokens that sets of a and b elements share at least if den * I >= num * U."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def index_length(n: int, num: int, den: int) -> int:
    """Prefix of the smaller (or equal) set of a pair."""
    return n - -(-2 * num * n // (num + den)) + 1


def histogram(tokens: np.ndarray) -> bytes:
    """Tokens per cell of the low bits, up to 255 each."""
    cells = np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


class Order:
    """Global token order: frequency class, then a hash; and which tokens are shared at all."""

    def __init__(self, shared: np.ndarray | None, frequent: np.ndarray, classes: np.ndarray):
        self.shared, self.frequent, self.classes = shared, frequent, classes

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(tokens), np.uint8)
        keys = tokens >> np.uint64(64 - 40)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return np.where(self.frequent[at] == keys, self.classes[at], 0).astype(np.uint8)

    def prefix(self, tokens: np.ndarray, length: int) -> np.ndarray:
        """The first tokens in this order; ``tokens`` are sorted by hash."""
        return tokens[np.argsort(self.class_of(tokens), kind="stable")[:length]]

    def is_shared(self, tokens: np.ndarray) -> np.ndarray:
        """False only for counted tokens that one document holds."""
        if self.shared is None:
            return np.ones(len(tokens), bool)
        beyond = tokens >= np.uint64(int(COUNTED * 2**64))
        bit = np.where(beyond, np.uint64(0), tokens) >> np.uint64(64 - SHARED_BITS)
        held = (self.shared[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
        return (held == 1) | beyond


def first_pass(docs: DataFrame, size: int, slice_bits: int) -> DataFrame:
    """One read of the texts: doc_id, key, sid, n, cells (histogram) of every row (sid and cells
    null where the set is empty), and, as rows of their own, counts of the tokens of the counted range (slice, low, many)."""
    low_bits = 40 - slice_bits
    most = np.uint64(int(COUNTED * 2**64))
    fields = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "key", "sid", "n")]
        + [("cells", pa.binary()), ("slice", pa.int32()), ("low", pa.binary()), ("many", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n_held = set(), [], 0

        def counts() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) >> np.uint64(24), return_counts=True)
            slices = (keys >> np.uint64(low_bits)).astype(np.int64)
            low = (keys & np.uint64((1 << low_bits) - 1)).astype("<u4")
            n = np.minimum(n, 65535).astype("<u2")
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(keys)]
            rows = [(int(slices[a]), low[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(len(rows), pa.binary())]
                + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(fields)[5:])],
                schema=fields,
            )

        for batch in batches:
            sids, ns, cells = [], [], []
            for tokens in token_sets(batch.column(2), size):
                ns.append(len(tokens))
                cells.append(histogram(tokens) if len(tokens) else None)
                sid = set_id(tokens) if len(tokens) else None
                sids.append(sid)
                if sid is None or sid in seen:  # copies read together count once
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                if len(tokens) > SMALL:
                    tokens = tokens[: np.searchsorted(tokens, most)]
                held.append(tokens)
                n_held += len(tokens)
                if n_held >= COUNT_TOKENS:
                    yield counts()
                    held, n_held = [], 0
            made = [pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(cells, pa.binary())]
            rest = [pa.nulls(len(ns), f.type) for f in list(fields)[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *rest], schema=fields)
        if n_held:
            yield counts()

    schema = "doc_id long, key long, sid long, n long, cells binary, slice int, low binary, many binary"
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def token_order(sent: DataFrame, slice_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What makes an ``Order``: counts, over all documents, of those that hold each token of the
    counted range, from the tasks' counts (slice, low, many)."""
    low_bits = 40 - slice_bits

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per slice: bits of the shared tokens, and the frequent tokens with their counts."""

        def close(number: int, parts: list) -> pa.RecordBatch:
            low = np.concatenate([np.frombuffer(a, "<u4") for a, _ in parts])
            n = np.concatenate([np.frombuffer(b, "<u2") for _, b in parts]).astype(np.int64)
            keys, inverse = np.unique(low, return_inverse=True)
            n = np.bincount(inverse, n, len(keys)).astype(np.int64)
            bits = np.zeros(1 << max(0, SHARED_BITS - slice_bits), np.uint8)
            bits[keys[n > 1] >> np.uint32(max(0, low_bits - (SHARED_BITS - slice_bits)))] = 1
            often = n >= FREQUENT
            full = (np.uint64(number) << np.uint64(low_bits)) | keys[often].astype(np.uint64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()),
                    pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                    pa.array([full.astype(np.int64).tolist()], pa.list_(pa.int64())),
                    pa.array([n[often].tolist()], pa.list_(pa.int64())),
                ],
                names=["slice", "bits", "keys", "counts"],
            )

        number, parts = None, []
        for batch in batches:
            for s, low, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != number and parts:
                    yield close(number, parts)
                    parts = []
                number = s
                parts.append((low, n))
        if parts:
            yield close(number, parts)

    dealt = sent.repartition(partitions(sent.sparkSession), "slice").sortWithinPartitions("slice")
    sums = saved(
        dealt.mapInArrow(add_up, "slice int, bits binary, keys array<long>, counts array<long>"), "jaccard-counts"
    )
    # The marks have a fixed size; of frequent tokens the commonest classes that fit are told.
    shared = np.zeros(1 << (SHARED_BITS - 3), np.uint8)
    each = len(shared) >> slice_bits
    for row in sums.select("slice", "bits").toLocalIterator():
        shared[row.slice * each : (row.slice + 1) * each] = np.frombuffer(row.bits, np.uint8)
    frequent = sums.select(F.explode(F.arrays_zip("keys", "counts")).alias("t")).select(
        F.col("t.keys").alias("key"), F.floor(F.log2(F.col("t.counts"))).cast("int").alias("class")
    )
    floor, held = 64, 0
    for row in sorted(frequent.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        if held + row["count"] > FREQUENT_MOST:
            break
        floor, held = row["class"], held + row["count"]
    shared = shared[: int(COUNTED * len(shared)) + 1]  # no counted token lies beyond
    told = frequent.where(F.col("class") >= floor).toPandas().sort_values("key")
    return shared, told["key"].to_numpy(np.uint64), told["class"].to_numpy(np.uint8)


def postings(docs: DataFrame, size: int, num: int, den: int, order) -> DataFrame:
    """token, sid, n, place of every prefix token that another document may hold.

    ``place`` is its place in the prefix; copies read together send theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, global_order = set(), Order(*order.value)
        out: list[list[np.ndarray]] = [[], [], [], []]
        names, held = ["token", "sid", "n", "place"], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

        for batch in batches:
            for tokens in token_sets(batch.column(0), size):
                n = len(tokens)
                if not n:
                    continue
                sid = set_id(tokens)
                if sid in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                prefix = global_order.prefix(tokens, prefix_length(n, num, den))
                place = np.flatnonzero(global_order.is_shared(prefix))
                if not len(place):
                    continue
                out[0].append(prefix[place].view(np.int64))
                out[1].append(np.full(len(place), sid, np.int64))
                out[2].append(np.full(len(place), n, np.int64))
                out[3].append(place.astype(np.int64))
                held += len(place)
                if held > 100_000:
                    yield flush()
                    out, held = [[], [], [], []], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "token long, sid long, n long, place long")


def possible(pairs: DataFrame, kinds: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and histograms allow: two sets share at most the sum, over
    the cells, of the smaller count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("a_n", "b_n"))
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("a_cells", "b_cells")
            )
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            most = np.where((x.max(1) == 255) | (y.max(1) == 255), np.minimum(n, m), most)
            good = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (den * most >= num * (n + m - most))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    n_pairs = pairs.count()
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    of_a = kinds.select(F.col("sid").alias("a"), F.col("n").alias("a_n"), F.col("cells").alias("a_cells"))
    named = saved(degree.join(of_a, "a"), "jaccard-degree", n_pairs)
    both = lookup(pairs, named, "a", "degree", ["b"]).join(
        kinds.select(F.col("sid").alias("b"), F.col("n").alias("b_n"), F.col("cells").alias("b_cells")), "b"
    )
    return saved(both.mapInArrow(run, "a long, b long"), "jaccard-possible", n_pairs)


def verified(
    pairs: DataFrame, texts: DataFrame, kinds: DataFrame, size: int, num: int, den: int, whole: bool = False
) -> DataFrame:
    """The pairs (a, b) whose sets are similar: the filters of the other orders, then the sets.

    ``texts``: key, text; ``kinds``: sid and key, where a set's text is found. Sets are made
    where the texts are and travel once for each pair's b, and once for each group of
    partners that one task compares with an a; at first 32 bits of each token do.
    """
    kind = np.dtype(np.uint64 if whole else np.uint32)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, blobs = [], []
            for k, (sid, tokens) in enumerate(zip(batch.column("sid").to_pylist(), token_sets(batch.column("text"), size))):
                if len(tokens) and set_id(tokens) == sid:  # another text may have this key
                    keep.append(k)
                    blobs.append((tokens if whole else tokens >> np.uint64(32)).astype(kind).tobytes())
            at = pa.array(keep, pa.int64())
            cols = [batch.column(c).take(at) for c in ("a", "salt", "sid", "is_b")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(blobs, pa.binary())], names=["a", "salt", "sid", "is_b", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, a_set, a_prefixes = None, None, []

        def prefixes(tokens: np.ndarray) -> list[np.ndarray]:
            length = prefix_length(len(tokens), num, den)
            wide = tokens.astype(np.uint64)
            return [np.partition(mixed(wide, k), length - 1)[:length] for k in range(1, ORDERS + 1)]

        for batch in batches:
            out = []
            for a, sid, is_b, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "sid", "is_b", "tokens"))):
                if not is_b:  # comes before its partners
                    known, a_set = a, np.frombuffer(blob, kind)
                    a_prefixes = prefixes(a_set)
                    continue
                if a != known:
                    continue
                b_set = np.frombuffer(blob, kind)
                small, large = sorted((len(a_set), len(b_set)))
                if den * small < num * large:
                    continue
                if not all(np.isin(p, q).any() for p, q in zip(a_prefixes, prefixes(b_set))):
                    continue
                # Tokens that look alike in 32 bits only add to what is shared.
                both = small - (~np.isin(a_set, b_set)).sum() if len(a_set) == small else small - (~np.isin(b_set, a_set)).sum()
                both = int(both)
                if den * both >= num * (len(a_set) + len(b_set) - both):
                    less = both - margin(len(a_set), len(b_set))
                    out.append((a, sid, whole or den * less >= num * (len(a_set) + len(b_set) - less)))
            cols = zip(*out) if out else ((), (), ())
            kinds_ = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], names=["a", "b", "sure"])

    # A leader may have any number of partners: groups of them grow with the root of it.
    n_pairs = pairs.count()
    degree = saved(pairs.groupBy("a").agg(F.count("*").alias("degree")), "jaccard-degree", n_pairs)
    groups = degree.withColumn("groups", (F.lit(1) + F.floor(F.sqrt("degree") / ROOT_GROUPS)).cast("int"))
    dealt = lookup(pairs, groups, "a", "degree", ["b"]).select(
        F.col("b").alias("sid"), "a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), F.lit(True).alias("is_b")
    )
    leaders = groups.select(
        F.col("a").alias("sid"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(False).alias("is_b")
    )
    # A leader has no more groups than partners and one.
    roles = saved(dealt.union(leaders).join(kinds.select("sid", "key"), "sid"), "jaccard-roles", 3 * n_pairs)
    placed = held_texts(texts, roles).join(roles, "key").select("a", "salt", "sid", "is_b", "text")
    sent = placed.mapInArrow(sets, "a long, salt int, sid long, is_b boolean, tokens binary")
    together = sent.repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "is_b")
    found = saved(together.mapInArrow(compare, "a long, b long, sure boolean"), "jaccard-compared", n_pairs, COMPARED_ROWS)
    links = found.where("sure").select("a", "b").distinct()
    close = found.where("NOT sure").select("a", "b").distinct()
    if whole or not close.limit(1).count():
        return links
    return links.union(verified(close, texts, kinds, size, num, den, whole=True))


def held_texts(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """Texts whose key may be among those of ``roles``: a filter of fixed size before the join,
    which only saves shuffling the others."""
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << KEY_MARKS)).cast("int")
    marks = np.zeros(1 << KEY_MARKS, bool)
    marks[roles.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True
    told = texts.sparkSession.sparkContext.broadcast(np.packbits(marks, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    return texts.select("key", "text", bit.alias("bit")).mapInArrow(run, "key long, text string")


def margin(a: int, b: int) -> int:
    """Matches that may be of chance between 32-bit sets of a and b elements: the expected
    number, eight deviations of it, and MARGIN."""
    chance = a * b / 2**32
    return MARGIN + int(np.ceil(chance + 8 * np.sqrt(chance))) if chance >= 0.01 else MARGIN


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node it reaches.

    Each round takes the least label among the neighbours, then the label of that label;
    rounds end when nothing changes.
    """
    n = 2 * links.count()  # edges, and nodes, at most
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(both.where("a <> b").distinct(), "cc-edges", n)
    degree = saved(edges.groupBy("a").agg(F.count("*").alias("degree")), "cc-degree", n)
    labels = saved(
        edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")),
        "cc-labels", n,
    )
    while True:
        named = degree.join(labels.withColumnRenamed("node", "a"), "a")
        heard = lookup(edges, named, "a", "degree", ["b"]).groupBy("b").agg(F.min("component").alias("m"))
        nearer = saved(
            labels.join(heard.withColumnRenamed("b", "node"), "node", "left").select(
                "node", F.least("component", "m").alias("component"), F.col("component").alias("was")
            ),
            "cc-labels", n,
        )
        uses = nearer.groupBy(F.col("component").alias("name")).agg(F.count("*").alias("uses"))
        of_label = uses.join(nearer.select(F.col("node").alias("name"), F.col("component").alias("jump")), "name")
        of_label = saved(of_label, "cc-jumps", n)
        jumped = lookup(nearer.withColumnRenamed("component", "name"), of_label, "name", "uses", ["node"])
        fresh = saved(
            jumped.select("node", F.least("name", "jump").alias("component"), "was"), "cc-labels", n
        )
        labels = fresh.select("node", "component")
        if not fresh.where("component <> was").limit(1).count():
            return labels


def open_postings(near: DataFrame, named: DataFrame, most: int | None = None) -> DataFrame:
    """The postings, with components, of tokens whose documents are of several components."""
    labelled = near.join(named.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn(
        "component", F.coalesce("component", "sid")
    )
    labelled = saved(labelled.select("token", "sid", "n", "place", "component"), "jaccard-labelled", most)
    ends = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return saved(labelled.join(ends.select("token"), "token", "left_semi").distinct(), "jaccard-rest", most)


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names an id's text by 64 bits, a row without an id by its text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(text_col, F.lit("")))


def similar_groups(
    docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, compared_links.

    Documents link when ``den * shared >= num * union`` of their shingle sets; a document
    without words has an empty set and no link. ``component_id`` is the smallest doc_id
    it reaches, ``compared_links`` counts compared and similar partners (a lower bound within
    groups, which are not expanded). Null texts are empty; rows without an id keep a null
    component unless they reach an id; repeated rows, ties and copies share a set and a
    component; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Where a set's text is found again; one id may stand on several texts.
    texts = texts.withColumn("key", text_key())
    slice_bits = min(16, max(8, (2 * partitions(spark)).bit_length()))
    first = saved(first_pass(texts, size, slice_bits), "jaccard-first")
    rows = first.where("slice IS NULL").select("doc_id", "key", "sid", "n")
    n_rows = rows.count()
    kinds = saved(
        first.where("slice IS NULL AND sid IS NOT NULL").groupBy("sid").agg(
            F.min("doc_id").alias("first"), F.min("key").alias("key"), F.count("*").alias("copies"),
            F.any_value("n").alias("n"), F.any_value("cells").alias("cells"),
        ),
        "jaccard-kinds", n_rows,
    )
    sent = first.where("slice IS NOT NULL").select("slice", "low", "many")
    order = spark.sparkContext.broadcast(token_order(sent, slice_bits))
    posted = saved(postings(texts, size, num, den, order), "jaccard-postings")
    n_posted = posted.count()

    small = F.col("place") < F.col("n") - F.ceil(2 * num * F.col("n") / (num + den)) + 1
    heads = posted.groupBy("token").agg(
        F.min(F.when(small, F.col("sid"))).alias("leader"), F.min("sid").alias("low"), F.max("sid").alias("high"),
        F.count("*").alias("held"),
    )
    heads = saved(heads.where("leader IS NOT NULL AND low <> high").select("token", "leader", "held"), "jaccard-heads", n_posted)
    near = saved(lookup(posted, heads, "token", "held", ["sid"]).where("leader IS NOT NULL"), "jaccard-near", n_posted)
    star = saved(
        near.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct(), "jaccard-pairs", n_posted
    )
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = saved(verified(possible(star, kinds, num, den), texts, kinds, size, num, den), "jaccard-links", star.count())

    # Tokens that still join different components: their other pairs. Where those would be
    # many, further leaders, drawn at random, join most of them first.
    named = components(links)
    rest = open_postings(near, named, n_posted)
    for turn in range(1, TURNS + 1):
        held = rest.groupBy("token").agg(F.count("*").alias("held"), F.count_if(small).alias("heads"))
        rows_left, pairs_left = held.agg(F.sum("held"), F.sum(F.col("held") * F.col("heads"))).first()
        if not rows_left or pairs_left <= FEW_PAIRS * rows_left:
            break
        drawn = F.struct(F.xxhash64("sid", F.lit(turn)).alias("draw"), "sid", "component")
        leaders = rest.groupBy("token").agg(F.min(F.when(small, drawn)).alias("leader"), F.count("*").alias("held"))
        met = lookup(rest, saved(leaders.where("leader IS NOT NULL"), "jaccard-heads", rows_left), "token", "held", ["sid"])
        met = met.where("leader IS NOT NULL AND component <> leader.component").select(
            F.least("sid", "leader.sid").alias("a"), F.greatest("sid", "leader.sid").alias("b")
        )
        met = saved(met.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs", rows_left)
        found = links.union(verified(possible(met, kinds, num, den), texts, kinds, size, num, den))
        links = saved(found, "jaccard-links", links.count() + met.count())
        tried = tried.union(met)
        named = components(links)
        rest = open_postings(near, named, n_posted)
    a = rest.where(small).select("token", *[F.col(c).alias(f"a_{c}") for c in ("sid", "n", "place", "component")])
    b = rest.select("token", *[F.col(c).alias(f"b_{c}") for c in ("sid", "n", "place", "component")])
    need = F.ceil(num * (F.col("a_n") + F.col("b_n")) / (num + den))
    # If this is the first token they share, they share no more than what follows it.
    reach = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    other = a.join(b, "token").where(
        (F.col("a_component") != F.col("b_component"))
        & (F.col("a_n") <= F.col("b_n"))
        & (den * F.col("a_n") >= num * F.col("b_n"))
        & (reach >= need)
    )
    other = other.select(F.least("a_sid", "b_sid").alias("a"), F.greatest("a_sid", "b_sid").alias("b")).distinct()
    other = possible(saved(other.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs"), kinds, num, den)
    if other.limit(1).count():
        found = links.union(verified(other, texts, kinds, size, num, den))
        links = saved(found, "jaccard-links", links.count() + other.count())
        named = components(links)

    return result(rows, kinds, links, named, n_rows)


def result(rows: DataFrame, kinds: DataFrame, links: DataFrame, named: DataFrame, most: int | None = None) -> DataFrame:
    """Rows with the component of their set; copies of a set may be a third of all."""
    degree = links.select(F.col("a").alias("sid")).union(links.select(F.col("b").alias("sid"))).groupBy("sid")
    of_set = (
        kinds.join(named.withColumnRenamed("node", "sid"), "sid", "left")
        .withColumn("component", F.coalesce("component", "sid"))
        .join(degree.agg(F.count("*").alias("compared_links")), "sid", "left")
    )
    of_set = saved(of_set.select("sid", "component", "first", "copies", "compared_links"), "jaccard-of-set", most)
    firsts = of_set.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"))
    whole = lookup(of_set, saved(firsts, "jaccard-firsts", most), "component", "sets", ["sid"])
    whole = saved(whole.select("sid", "component_id", "copies", F.coalesce("compared_links", F.lit(0)).alias("compared_links")), "jaccard-whole", most)
    found = lookup(rows, whole, "sid", "copies", ["doc_id"])
    return found.select(
        "doc_id",
        F.col("key").alias("text_key"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("compared_links", F.lit(0)).cast("long").alias("compared_links"),
    )
