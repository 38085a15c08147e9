"""Toxicity by weak supervision.

Lexicons and patterns vote on documents. A generative label model estimates, without
looking at labels, how often each voter is right and how far voters repeat each other;
its posterior labels train a linear classifier over the lexicons' counts, which scores
whole texts. Lexicons hold words and word beginnings that labelled toxic documents have
far more often than others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafwork.llm.common import held_out
from leafwork.llm.linear import calibration, logistic, sigmoid
from leafwork.llm.quality import sample

MOST_LABELLED = 12_000
MOST_UNLABELLED = 4_000
LEXICON = 1024
BEGINNINGS = (4, 5, 6)
#: A feature enters the lexicons from this likelihood ratio on.
LEAST_RATIO = 15.0
GROUPS = 3
DENSE = 5
WORD = r"[^\W_]+"


def forms(word: str) -> list[str]:
    """The word and its beginnings, the latter marked."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) > k]]


def form_counts(rows: DataFrame) -> DataFrame:
    """form, n1, n0: labelled documents of either kind that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (Counter(), Counter())

        def out():
            names = list(count[0] | count[1])
            both = [pa.array([c[w] for w in names], pa.int64()) for c in count]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), both[1], both[0]], names=["form", "n1", "n0"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count[y].update({f for w in set(re.findall(WORD, text.lower())) for f in forms(w)})
            if len(count[0]) + len(count[1]) > 500_000:
                yield out()
                count = (Counter(), Counter())
        yield out()

    return rows.mapInArrow(run, "form string, n1 long, n0 long").groupBy("form").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def lexicon(rows: DataFrame) -> list[str]:
    """The forms most telling of label 1 among labelled rows (text, y), at most LEXICON."""
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    a, b = F.col("n1"), F.col("n0")
    share = F.lit(n1 / (n1 + n0))
    log = lambda n, p: F.when(n > 0, n * F.log(n / ((a + b) * p))).otherwise(0.0)
    ratio = 2 * (log(a, share) + log(b, 1 - share))
    telling = form_counts(rows).where((a >= 3) & (a * n0 >= 3 * b * n1)).withColumn("ratio", F.round(ratio, 6))
    top = telling.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "form").limit(LEXICON)
    return [r.form for r in top.collect()]


class Hits(dict):
    """Lexicon places of each word, remembered up to a number of words."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = tuple(self.place[f] for f in forms(word) if f in self.place)
        return found


def features(text: str, hits: Hits) -> np.ndarray:
    """Dense marks, then log(1 + count) of each lexicon entry. An empty text has the constant."""
    x = np.zeros(DENSE + len(hits.place), np.float32)
    words = re.findall(WORD, text.lower())
    found = [h for h in map(hits.__getitem__, words) if h]
    x[0] = 1.0
    if found:
        x[1] = np.log1p(len(found))
        x[2] = min(1.0, len(found) / len(words) * 10)
        x[3] = np.log1p(max(map(len, found)))
        count = Counter(k for h in found for k in h)
        x[[DENSE + k for k in count]] = np.log1p(list(count.values()))
    x[4] = min(1.0, np.log1p(text.count("!")) / 5)
    return x


def votes(x: np.ndarray, forms_: list[str]) -> np.ndarray:
    """1 toxic, -1 clean, 0 no opinion: one column per lexicon and pattern voter."""
    from zlib import crc32

    counts = x[:, DENSE:] > 0
    columns = []
    for length in (0, *BEGINNINGS):
        for group in range(GROUPS):
            mine = [
                k for k, f in enumerate(forms_)
                if (len(f) - 1 if f.endswith("*") else 0) == length and crc32(f[:4].encode()) % GROUPS == group
            ]
            if mine:
                columns.append(np.where(counts[:, mine].any(1), 1, 0))
    kinds = counts.sum(1)
    hits = np.expm1(x[:, 1])
    columns.append(np.where(kinds >= 3, 1, np.where(kinds == 0, -1, 0)))  # several entries, or none
    columns.append(np.where(hits >= 3, 1, np.where(hits == 0, -1, 0)))  # repeated hits
    columns.append(np.where(x[:, 2] > 0.15, 1, np.where(x[:, 2] < 0.01, -1, 0)))  # dense hits
    columns.append(np.where(x[:, 3] >= np.log1p(2), 1, 0))  # a word that several entries know
    return np.stack(columns, 1)


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, P(vote | label) per voter, and the voters' weights.

    EM over voters that are independent given the label, but for what they repeat: each
    counts with one over one plus its correlations with the others given the label.
    """
    n, m = v.shape
    onehot = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)
    # To start with, voters that say the same count as one, and each is thought somewhat right.
    centred = v - v.mean(0)
    sd = np.maximum(np.sqrt((centred**2).mean(0)), 1e-9)
    weight = 1 / np.maximum((centred.T @ centred / n / np.outer(sd, sd) > 0.9).sum(1), 1)
    post = sigmoid(np.log(prior / (1 - prior)) + v @ weight)
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        for y, p in enumerate((1 - post, post)):
            table[y] = (np.einsum("n,nmk->mk", p, onehot) + 0.5) / (p.sum() + 1.5)
        residual = np.zeros((m, m))
        for p in (1 - post, post):
            centred = v - (p @ v) / max(p.sum(), 1e-9)
            residual += (centred * p[:, None]).T @ centred / n
        sd = np.sqrt(np.maximum(np.diag(residual), 1e-9))
        rho = np.maximum(residual / np.outer(sd, sd), 0)
        weight = 1 / np.maximum(rho.sum(1), 1.0)
        odds = np.log(table[1] / table[0])
        post = sigmoid(np.log(prior / (1 - prior)) + np.einsum("nmk,mk,m->n", onehot, odds, weight))
    return post, table, weight


def fit(
    docs: DataFrame, labels: DataFrame, labelled: int = MOST_LABELLED, unlabelled: int = MOST_UNLABELLED
) -> tuple[list[str], np.ndarray]:
    """Lexicon and weights. Without documents of both labels every text scores nothing."""
    rows = sample(docs, labels, "toxic", labelled, unlabelled)
    entries = lexicon(rows.where("y IS NOT NULL"))
    if not entries:
        return [], np.array([-5.0, 0, 0, 0, 0])
    place = {f: k for k, f in enumerate(entries)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(place)
        for batch in batches:
            xs = [features(t, hits).astype(np.float16).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(run, "x binary, y int").toPandas().sort_values(["x", "y"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), -1).astype(np.float32)
    y = got["y"].fillna(-1).to_numpy(int)
    known = y >= 0
    post, _, _ = label_model(votes(x, entries), float(np.clip(y[known].mean(), 0.01, 0.99)))
    # What the model is sure of counts most.
    w = logistic(x, post.astype(np.float32), (0.1 + np.abs(2 * post - 1)).astype(np.float32), 1e-3, 300, 0.05)
    scale, shift = calibration(x[known] @ w, y[known])
    w = w * scale
    w[0] += shift
    return entries, w


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``_score``: rows and columns as they are, texts whole."""
    entries, w = model
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits({f: k for k, f in enumerate(entries)})
        for batch in batches:
            scores = [float(sigmoid(features(t or "", hits) @ w)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    labelled: int = MOST_LABELLED,
    unlabelled: int = MOST_UNLABELLED,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts count as empty, a null id is
    not held out, repeated rows score alike, an empty table gives no rows. ``labelled`` and
    ``unlabelled`` bound the rows that the models are fitted on."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, labelled, unlabelled))
    return rows.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
