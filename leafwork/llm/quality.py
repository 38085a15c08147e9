"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model that minimises the
non-negative unbiased risk: pi * R(positives as 1) + max(0, R(unlabelled as 0) -
pi * R(positives as 0)). The class prior pi is estimated from the same two samples: where
a classifier of the one against the other is surest, nearly all of the unlabelled are
positives, so the least ratio of their shares there bounds it. Labels of 0 are never learnt
from. Features describe a text's make, not its language or source: word shapes, character
classes and repetition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import held_out
from leafwork.llm.linear import adam, logistic, sigmoid

SHAPES = 256
DENSE = 16
SIZE = DENSE + SHAPES
#: By default the model is fitted on so many positives and so many unlabelled documents at most.
MOST_LABELLED = 8_000
MOST_UNLABELLED = 8_000
PRIOR_RANGE = (0.05, 0.98)


#: Words that a task remembers the shapes of; a worker outlives its task and keeps the memory.
MOST_WORDS = 64_000


class Shapes(dict):
    """Shape bucket and letter statistics of each word, remembered up to a number."""

    def __missing__(self, word: str):
        from zlib import crc32

        if len(self) >= MOST_WORDS:
            self.clear()
        marks = []
        for c in word:
            mark = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not marks or marks[-1] != mark:
                marks.append(mark)
        shape = "".join(marks)
        letters = sum(c.isalpha() for c in word)
        upper = sum(c.isupper() for c in word)
        digits = sum(c.isdigit() for c in word)
        value = self[word] = (crc32(shape.encode()) % SHAPES, letters, upper, digits, len(word))
        return value


def features(text: str, shapes: Shapes) -> np.ndarray:
    """Numbers of at most about one each; an empty text has the constant and one mark."""
    x = np.zeros(SIZE, np.float32)
    words = text.split()
    n = len(words)
    x[0] = 1.0
    if not n:
        x[1] = 1.0
        return x
    stats = np.array([shapes[w] for w in words], np.int64)
    x[DENSE:] = np.sqrt(np.bincount(stats[:, 0], minlength=SHAPES) / n)
    letters, upper, digits, chars = (int(stats[:, k].sum()) for k in range(1, 5))
    same = sum(a == b for a, b in zip(words, words[1:]))
    count = Counter(words)
    lines = [l for l in text.split("\n") if l.strip()]
    x[2] = upper / max(letters, 1)
    x[3] = digits / chars
    x[4] = (chars - letters - digits) / chars
    x[5] = same / n
    x[6] = min(1.0, same / 5)
    x[7] = len(count) / n
    x[8] = max(count.values()) / n
    x[9] = min(1.0, chars / n / 20)
    x[10] = 1 - len(set(lines)) / max(len(lines), 1)
    x[11] = min(1.0, np.log1p(n) / 10)
    x[12] = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n
    x[13] = sum(1 for w in words if not w[-1].isalnum()) / n
    x[14] = text.count("!") / chars
    x[15] = 1.0 if n < 5 else 0.0
    return x


def sample(docs: DataFrame, labels: DataFrame, label: str, labelled: int, unlabelled: int) -> DataFrame:
    """text, y: bounded samples of labelled and of any rows (y null), neither held out; of
    several rows of one id one, the least text.

    Chosen by a hash of the id, so the same rows on every run and in any partitioning."""
    pick = F.xxhash64("doc_id", F.lit(11))
    known = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id") & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(pick, "doc_id").limit(labelled)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    other = ids.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(unlabelled).withColumn("y", F.lit(None).cast("int"))
    both = chosen.select("doc_id", F.col("y").cast("int")).union(other)
    # Sixteen bytes for each of a bounded number of rows.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(both), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def vectors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (-1: none) of a sample, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            xs = [features(t.as_py(), shapes).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(run, "x binary, y int").toPandas()
    if not len(got):
        return np.zeros((0, SIZE), np.float32), np.zeros(0)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), SIZE)
    y = got["y"].fillna(-1).to_numpy(int)
    order = np.lexsort((y, *x[:, [11, 9, 7, 4]].T))  # the same sums in any order of arrival
    return x[order], y[order]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, kept off 0 and 1: the least ratio of the two
    samples' shares above a threshold, over thresholds that a fifth of the positives or more
    pass. Each half is judged by a classifier fitted on the other."""
    found = []
    for half in (0, 1):
        p, u = np.arange(len(positive)) % 2 == half, np.arange(len(unlabelled)) % 2 == half
        if p.all() or u.all() or not p.any() or not u.any():
            return 0.5
        x = np.concatenate([positive[~p], unlabelled[~u]]).astype(float)
        y = np.r_[np.ones((~p).sum()), np.zeros((~u).sum())]
        weight = np.r_[np.full((~p).sum(), 1 / (~p).sum()), np.full((~u).sum(), 1 / (~u).sum())]
        w = logistic(x, y, weight, 1e-4, 300, 0.05)
        sure, any_ = positive[p] @ w, unlabelled[u] @ w
        least = np.quantile(sure, np.linspace(0, 0.8, 33))
        found.append(min((any_ >= t).mean() / (sure >= t).mean() for t in least))
    return float(np.clip(np.mean(found), *PRIOR_RANGE))


def pu_calibration(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift that make decision values probabilities of label 1: the two numbers of
    least unbiased risk, which is convex in them."""
    spread = max(float(np.std(unlabelled)), 1e-6)
    p, u = (np.stack([g / spread, np.ones(len(g))], 1) for g in (positive, unlabelled))
    pull, small = prior * p.mean(0), np.array([1e-4, 0.0])
    w = adam(lambda v: u.T @ sigmoid(u @ v) / len(u) - pull + small * v, np.zeros(2), 1500, 0.05)
    return float(max(w[0], 0.0) / spread), float(w[1])


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk under the logistic loss."""
    p, u = positive.astype(float), unlabelled.astype(float)

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        as_one = p.T @ (sigmoid(gp) - 1) / len(p)
        pos_zero, un_zero = p.T @ sigmoid(gp) / len(p), u.T @ sigmoid(gu) / len(u)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if negative < 0:  # the risk of negatives cannot be: step back instead of overfitting
            return -(un_zero - prior * pos_zero)
        return prior * as_one + un_zero - prior * pos_zero + l2 * w

    return adam(gradient, np.zeros(p.shape[1]), steps, rate)


def fit(
    docs: DataFrame, labels: DataFrame, labelled: int = MOST_LABELLED, unlabelled: int = MOST_UNLABELLED
) -> tuple[np.ndarray, float, float]:
    """Weights, scale and shift. Without any positives every text scores one half."""
    x, y = vectors(sample(docs, labels.where(F.col("quality") == 1), "quality", labelled, unlabelled))
    positive, other = x[y == 1], x[y < 0]
    if not len(positive) or not len(other):
        return np.zeros(SIZE), 1.0, 0.0
    prior = class_prior(positive, other)
    w = fit_pu(positive, other, prior)
    scale, shift = pu_calibration(positive @ w, other @ w, prior)
    return w, scale, shift


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], text: str = "text") -> DataFrame:
    """``docs`` with ``_score``: rows and columns as they are, texts whole."""
    w, scale, shift = model
    w = w * scale
    w[0] += shift
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            # One text at a time: the batch is held as it came, not once more as strings.
            scores = [float(sigmoid(features(t.as_py() or "", shapes) @ w)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    labelled: int = MOST_LABELLED,
    unlabelled: int = MOST_UNLABELLED,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts count as empty, a null id is
    not held out, repeated rows score alike, an empty table gives no rows. ``labelled`` and
    ``unlabelled`` bound the rows that the model is fitted on."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, labelled, unlabelled))
    return rows.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    return scored(docs, fit(docs, labels)).where(F.col("_score") >= threshold).select(*docs.columns)
