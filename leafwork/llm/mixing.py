"""Mixing sources to target weights: temperature mixing as DataFrame work only.

Source token shares p are raised to an exponent t (one over a temperature) and normalised.
t is bisected between 0, equal weights, and 1, the natural shares: the largest that meets
a target entropy (a part of the largest possible), then raised as far as a limit on
repetition asks. The weights are realised as block permutations: every source is dealt
into sections by a hash, each pass over it orders the sections and the rows in them
anew, and the stream is cut into blocks that hold every source by its weight.
"""

from __future__ import annotations

from math import isqrt, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Exponents tried in one pass over the sources; each pass narrows the range so many times.
GRID = 16
PASSES = 8


def tokens_of(text: str = "text") -> Column:
    """Words and an end mark: even an empty text counts one."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def source_weights(
    sources: DataFrame, entropy: float, max_epochs: float, budget: float | None = None
) -> tuple[DataFrame, float, int]:
    """(source, tokens) -> the same with weight and quota; the exponent; the budget.

    ``entropy``: target as a part of log(number of sources). ``max_epochs``: no source is
    repeated more often on average. ``budget``: tokens of the mix, by default all there are.
    """
    total, n, least = sources.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    if not n:
        return sources.withColumns({"weight": F.lit(0.0), "quota": F.lit(0).cast("long")}), 1.0, 0
    budget = int(total if budget is None else budget)
    share = F.col("tokens") / F.lit(float(total))
    target = entropy * log(n)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """Per exponent: the sum of p**t and of p**t * log p; one row, whatever the sources."""
        row = sources.agg(
            *[F.sum(F.pow(share, F.lit(t))) for t in exponents],
            *[F.sum(F.pow(share, F.lit(t)) * F.log(share)) for t in exponents],
        ).first()
        return list(zip(row[: len(exponents)], row[len(exponents) :]))

    def bisect(met, low: float, high: float) -> float:
        """The least exponent in range from which on ``met`` holds (it is monotone)."""
        for _ in range(PASSES):
            tried = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            flags = [met(t, *s) for t, s in zip(tried, sums(tried))]
            k = flags.index(True) if True in flags else GRID
            if k == 0:
                return low
            low, high = tried[k - 1], tried[k]
        return round(high, 9)

    # The more the exponent, the less the entropy; natural shares that meet the target stay.
    t = bisect(lambda t, z, zl: log(z) - t * zl / z <= target + 1e-12, 0.0, 1.0)
    if t < 1.0:
        # Repetition of the smallest source falls with the exponent up to 1.
        p = least / total
        most = max(max_epochs, budget / total)
        t = bisect(lambda t, z, zl: p ** (t - 1) * budget / total / z <= most + 1e-12, t, 1.0)
    z = sums([t])[0][0]
    weight = F.pow(share, F.lit(t)) / F.lit(z)
    weighted = sources.withColumn("weight", weight)
    return weighted.withColumn("quota", F.floor(F.col("weight") * budget).cast("long")), t, budget


def mix(
    docs: DataFrame,
    entropy: float = 0.98,
    max_epochs: float = 4.0,
    budget: float | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per placed copy: doc_id, source, tokens, epoch, section, start (tokens of the
    source's stream before it), block, position (its place in the block), weight, exponent.

    A null source is a source of its own, a null id and an empty or null text are placed
    like any other row, repeated rows are rows, an empty table gives no rows, and other
    columns are not read. The last copy of a source may pass its quota's end.
    """
    placed = _placed(docs, entropy, max_epochs, budget, block_tokens, seed, id_col, source_col, text_col)
    return placed.drop("text_hash")


def _placed(
    docs: DataFrame, entropy: float = 0.98, max_epochs: float = 4.0, budget: float | None = None,
    block_tokens: int = 1 << 20, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``mix`` with the hash of each row's text. Rows are dealt out by id and text, so that
    neither an id that many rows share nor null ids fill a section."""
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), tokens_of(text_col).alias("tokens"),
            F.xxhash64(text_col).alias("text_hash"),
        ),
        "mix-rows",
    )
    # Sections and rows in a section both grow with the square root of the rows.
    n = rows.count()
    sections = max(1, isqrt(n))
    dealt = rows.withColumn("section", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(sections)).cast("int"))
    dealt = dealt.withColumn("source", F.struct(F.col("source").alias("name")))  # null-safe key
    totals = saved(dealt.groupBy("source", "section").agg(F.sum("tokens").alias("section_tokens")), "mix-sections", n)
    sources = saved(totals.groupBy("source").agg(F.sum("section_tokens").alias("tokens")), "mix-sources", n)
    weighted, exponent, budget = source_weights(sources, entropy, max_epochs, budget)
    plan = weighted.select("source", "weight", "quota", F.col("tokens").alias("source_tokens"))
    epochs = F.ceil(F.col("quota") / F.col("source_tokens")).cast("int")
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("section", "epoch", F.lit(seed)), "section")
    layout = (
        totals.join(plan, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
        .where((F.col("quota") > 0) & (F.col("epoch") >= 0))
        .withColumn(
            "section_start",
            F.col("epoch") * F.col("source_tokens")
            + F.sum("section_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("section_tokens"),
        )
        .where(F.col("section_start") < F.col("quota"))
        .drop("section_tokens", "source_tokens")
    )
    shuffled = F.xxhash64("doc_id", "text_hash", "epoch", F.lit(seed))
    inside = Window.partitionBy("source", "section", "epoch").orderBy(shuffled, "doc_id", "text_hash", "tokens")
    placed = (
        dealt.join(layout, ["source", "section"])
        .withColumn(
            "start",
            F.col("section_start")
            + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("tokens"),
        )
        .where(F.col("start") < F.col("quota"))
    )
    # A block holds weight * block_tokens of each source: any run of blocks has the mix.
    per_block = F.greatest(F.col("weight") * F.lit(float(min(block_tokens, max(budget, 1)))), F.lit(1e-9))
    blocks = placed.withColumn("block", F.floor(F.col("start") / per_block).cast("long"))
    in_block = Window.partitionBy("block").orderBy(F.xxhash64("doc_id", "epoch", "block"), "doc_id", "source", "start")
    return blocks.select(
        "doc_id",
        F.col("source.name").alias("source"),
        "tokens",
        F.col("epoch").cast("int").alias("epoch"),
        "section",
        "start",
        "block",
        F.row_number().over(in_block).alias("position"),
        F.round("weight", 9).alias("weight"),
        F.lit(round(exponent, 9)).alias("exponent"),
        "text_hash",
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix in its order, with their own columns; a document that the
    mix repeats comes as often, and k rows of one id come k times an epoch. Rows without
    an id stay once, at the end."""
    # Rows of one id, source and text stand for each other: each takes one place an epoch.
    alike = ["_id", "_source", "_tokens", "_hash"]
    source = F.struct(F.col("source").alias("name"))  # null-safe key
    names = [
        F.col("doc_id").alias("_id"), source.alias("_source"), F.col("tokens").alias("_tokens"), F.col("text_hash").alias("_hash")
    ]
    turn = Window.partitionBy(*alike, "_epoch").orderBy("_start")
    placed = (
        _placed(docs, **settings)
        .where("doc_id IS NOT NULL")
        .select(*names, *[F.col(c).alias(f"_{c}") for c in ("epoch", "start", "block", "position")])
        .withColumn("_n", F.row_number().over(turn))
        .select(*alike, "_n", "_block", "_position")
    )
    keyed = docs.where("doc_id IS NOT NULL").withColumns(
        {"_id": F.col("doc_id"), "_source": source, "_tokens": tokens_of(), "_hash": F.xxhash64("text")}
    )
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*alike).orderBy("_id")))
    joined = numbered.join(placed, [*alike, "_n"])
    rest = docs.where("doc_id IS NULL").withColumns(
        {"_block": F.lit(1 << 62).cast("long"), "_position": F.lit(0)}
    )
    both = joined.select(*docs.columns, "_block", "_position").union(rest.select(*docs.columns, "_block", "_position"))
    return both.sortWithinPartitions("_block", "_position").select(*docs.columns)
