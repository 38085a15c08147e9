"""Text analytics per document.

All of it is row-local: a document is normalised and tokenised once, in one
projection, and every measure reads that one token array. Nothing is exploded
and nothing is shuffled, so neither a hot source nor a large corpus changes the
shape of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import text as T
from leafwork.session import stored

STATS = ["total_chars", "total_words", "total_lines", "total_pages", "avg_words_per_line"]
FLAGS = ["has_tables", "has_images"]
VOCABULARY_SLICES = 16
#: A document of no more characters and parts is put together in one row.
WHOLE_CHARS, WHOLE_PARTS = 1 << 20, 1 << 13
ANALYTICS = [
    "total_chars", "total_words", "total_lines", "total_pages", "language_hint",
    "avg_words_per_line", "has_tables", "has_images", "top_words",
]


def _prepared(documents: DataFrame, text: str, tokens: bool = True) -> DataFrame:
    body = T.normalize_newlines(F.coalesce(F.col(text), F.lit("")))
    prepared = documents.withColumn("_body", body)
    return prepared.withColumn("_tokens", T.words(F.col("_body"))) if tokens else prepared


def _with_stats(prepared: DataFrame) -> DataFrame:
    body, tokens = F.col("_body"), F.col("_tokens")
    counted = prepared.withColumns(
        {
            "total_chars": F.char_length(body).cast("long"),
            "total_words": F.size(tokens).cast("long"),
            "total_lines": T.count_lines(body),
            "total_pages": T.count_page_markers(body),
        }
    )
    return counted.withColumn(
        "avg_words_per_line", T.average(F.col("total_words"), F.col("total_lines"))
    )


def text_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Characters, words, lines, page markers and words per line."""
    return _with_stats(_prepared(documents, text)).drop("_body", "_tokens")


def top_words(
    documents: DataFrame,
    text: str = "text",
    limit: int = C.TOP_WORDS,
    stop_words: list[str] = C.STOP_WORDS,
) -> DataFrame:
    """Add ``top_words``: most frequent non-stop words, first met first on ties."""
    ranked = T.ranked_words(F.col("_tokens"), limit, stop_words)
    return (
        _prepared(documents, text)
        .withColumn("top_words", F.transform(ranked, lambda r: r["word"]))
        .drop("_body", "_tokens")
    )


def language_hint(documents: DataFrame, text: str = "text", mode: str = "compat") -> DataFrame:
    return (
        _prepared(documents, text)
        .withColumn("language_hint", T.language_hint(F.col("_tokens"), mode))
        .drop("_body", "_tokens")
    )


def structure_flags(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumns(
        {"has_tables": T.has_tables(F.col(text)), "has_images": T.has_images(F.col(text))}
    )


def images_extracted(
    documents: DataFrame, text: str = "text", document_type: str = "document_type"
) -> DataFrame:
    """Embedded-image lines of page-type documents; zero for other types."""
    return documents.withColumn(
        "images_extracted",
        F.when(
            F.col(document_type) == "pdf", T.count_substring(F.col(text), C.IMAGE_MARKER)
        ).otherwise(F.lit(0).cast("long")),
    )


def analyze_text(
    documents: DataFrame, text: str = "text", language_mode: str = "compat"
) -> DataFrame:
    """Add all nine measures in one pass over the text."""
    measured = _with_stats(_prepared(documents, text))
    body, tokens = F.col("_body"), F.col("_tokens")
    return measured.withColumns(
        {
            "language_hint": T.language_hint(tokens, language_mode),
            "has_tables": T.has_tables(body),
            "has_images": T.has_images(body),
            "top_words": F.transform(T.ranked_words(tokens), lambda r: r["word"]),
        }
    ).drop("_body", "_tokens")


# --- documents stored in several parts --------------------------------------


def analyze_parts(
    parts: DataFrame,
    doc_id: str = "doc_id",
    part_no: str = "part_no",
    text: str = "text",
    language_mode: str = "compat",
) -> DataFrame:
    """``analyze_text`` for documents whose text spans several rows.

    Parts must be cut at line ends. A first, narrow pass finds the long documents. The parts
    of any other are put together, so its text moves once and its words never do; those of
    long documents are analysed where they lie (``_spread_parts``).
    """
    sizes = parts.groupBy(doc_id).agg(
        F.sum(F.char_length(text)).alias("_chars"), F.count(F.lit(1)).alias("_parts")
    )
    long_ids = sizes.where((F.col("_chars") > WHOLE_CHARS) | (F.col("_parts") > WHOLE_PARTS))
    long_ids = stored(long_ids.select(F.col(doc_id).alias("_long")), "analyze-long")
    if not long_ids.limit(1).count():
        return _gathered_parts(parts, doc_id, part_no, text, language_mode)
    is_long = F.col(doc_id).eqNullSafe(F.col("_long"))
    few, many = (parts.join(long_ids, is_long, how) for how in ("left_anti", "left_semi"))
    return _gathered_parts(few, doc_id, part_no, text, language_mode).unionByName(
        _spread_parts(many, doc_id, part_no, text, language_mode)
    )


def _gathered_parts(parts: DataFrame, doc_id: str, part_no: str, text: str, language_mode: str) -> DataFrame:
    """Documents whose parts fit one row: measured part by part, their words in order."""
    piece = F.struct(F.col(part_no).alias("no"), F.coalesce(text, F.lit("")).alias("text"))
    whole = parts.groupBy(doc_id).agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
    bodies = F.transform("_pieces", lambda p: T.normalize_newlines(p["text"]))
    whole = whole.select(doc_id, bodies.alias("_bodies"))

    def total(measure) -> Column:
        return F.aggregate("_bodies", F.lit(0).cast("long"), lambda n, b: n + measure(b).cast("long"))

    tokens = F.col("_tokens")
    measured = whole.withColumn("_tokens", F.flatten(F.transform("_bodies", T.words))).withColumns(
        {
            "total_chars": total(F.char_length),
            "total_words": F.size(tokens).cast("long"),
            "total_lines": total(T.count_lines),
            "total_pages": total(T.count_page_markers),
            "has_tables": F.exists("_bodies", T.has_tables),
            "has_images": F.exists("_bodies", T.has_images),
        }
    )
    return measured.select(
        doc_id,
        *STATS[:4],
        T.average(F.col("total_words"), F.col("total_lines")).alias("avg_words_per_line"),
        T.language_hint(tokens, language_mode).alias("language_hint"),
        *FLAGS,
        F.transform(T.ranked_words(tokens), lambda r: r["word"]).alias("top_words"),
    )


def _spread_parts(parts: DataFrame, doc_id: str, part_no: str, text: str, language_mode: str) -> DataFrame:
    """Documents of any length. The text is read once: each part shrinks to
    entries (word, count, first position) where it lies, plus one entry with an
    empty word that carries the part's counters and entries of count zero for
    the language markers seen. Entries are summed per (document, word), which
    combines before the shuffle and spreads a document that holds a third of
    all parts; only the leaders of its vocabulary meet in one task.
    """
    local = _with_stats(_prepared(parts, text)).withColumns(
        {"has_tables": T.has_tables(F.col("_body")), "has_images": T.has_images(F.col("_body"))}
    )
    counters, flags = STATS[:4], FLAGS
    every_marker = sorted({w for ws in C.LANGUAGE_MARKERS.values() for w in ws})

    def entry(word, n, pos):
        return F.struct(
            n.cast("long").alias("n"), pos.cast("long").alias("first_pos"), word.alias("word")
        )

    zero = F.lit(0)
    entries = F.concat(
        F.array(entry(F.lit(""), zero, zero)),
        T.ranked_words(F.col("_tokens"), 2**31 - 1),
        F.transform(
            F.array_intersect(F.col("_tokens"), T.literal_array(every_marker)),
            lambda m: entry(m, zero, zero),
        ),
    )
    # The outer form keeps the optimizer from copying ``entries`` into a filter;
    # there always is at least the counter entry.
    rows = local.select(
        doc_id, part_no, *counters, *flags, F.explode_outer(entries).alias("w")
    )
    carrier = F.col("w.word") == ""
    # (part, position) as one number: fixed-width buffers let Spark aggregate by
    # hash, where a struct would make it sort every row first.
    place = F.col(part_no).cast("decimal(20,0)") * F.lit(2**31) + F.col("w.first_pos")
    per_word = rows.groupBy(doc_id, F.col("w.word").alias("word")).agg(
        F.sum("w.n").alias("n"),
        F.min(F.when(F.col("w.n") > 0, place)).alias("first"),
        *[F.sum(F.when(carrier, F.col(c))).alias(c) for c in counters],
        *[F.max(F.when(carrier, F.col(c))).alias(c) for c in flags],
    )
    # Leaders are picked per slice of a document's vocabulary first, so that not
    # even one enormous vocabulary has to pass through a single task.
    order = [F.col("n").desc(), F.col("first").asc_nulls_last()]
    vocabulary = F.pmod(F.xxhash64("word"), F.lit(VOCABULARY_SLICES))
    in_slice = F.row_number().over(Window.partitionBy(doc_id, "slice").orderBy(*order))
    finalists = (
        per_word.withColumn("slice", vocabulary)
        .withColumn("rank", in_slice)
        .where(
            (F.col("rank") <= C.TOP_WORDS) | (F.col("n") == 0) | F.col("word").isin(every_marker)
        )
    )
    rank = F.row_number().over(Window.partitionBy(doc_id).orderBy(*order))
    leading = (F.col("rank") <= C.TOP_WORDS) & (F.col("n") > 0)
    merged = (
        finalists.withColumn("rank", rank)
        .groupBy(doc_id)
        .agg(
            *[F.max(c).alias(c) for c in counters],
            *[F.max(c).alias(c) for c in flags],
            F.sort_array(F.collect_list(F.when(leading, F.struct("rank", "word")))).alias("top"),
            F.collect_list(F.when(F.col("word").isin(every_marker), F.col("word"))).alias("found"),
        )
        .withColumn("avg_words_per_line", T.average(F.col("total_words"), F.col("total_lines")))
    )
    return merged.select(
        doc_id,
        *STATS,
        T.language_hint(F.col("found"), language_mode).alias("language_hint"),
        *flags,
        F.col("top.word").alias("top_words"),
    )
