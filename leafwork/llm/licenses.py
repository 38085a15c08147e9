"""License scan: an exact similarity join of text blocks with license templates.

Every text is cut into overlapping blocks of words. A block and a template join where the
block holds enough of the template's distinct words. Words are ordered by their frequency
in all documents, rarest first; a block can only pass if it holds one of a template's
first words (prefix filter), has enough words (length filter) and enough of them after the
first that is shared (position filter). Blocks that pass are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block has to hold, as a fraction.
CONTAINED, OF = 4, 5
#: Templates are told to every task: at most so many words of them.
MOST_TEMPLATE_WORDS = 1 << 20
#: Bytes of a text whose words are in memory at a time.
SLICE = 1 << 20

#: Fixed: phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed: passages of public licenses and the notices that name them. Variants that differ
#: in a word or two share a label, as the threshold does not tell them apart.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]

_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: A-Z lowered, every other ASCII character but letters and digits a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, a slice of it at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        part = data[at:end].translate(_PLAIN)
        if end < len(data):
            # Not inside a word, however long the word is.
            while end < len(data) and part[-1] != 32:
                more = data[end : end + SLICE].translate(_PLAIN)
                gap = more.find(b" ")
                part += more if gap < 0 else more[: gap + 1]
                end += len(more) if gap < 0 else gap + 1
        yield part.split()
        at = end


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]

    @cached_property
    def distinct(self) -> frozenset[bytes]:
        return frozenset(self.words)

    @cached_property
    def needed(self) -> int:
        return -(-len(self.distinct) * CONTAINED // OF)

    @cached_property
    def block(self) -> int:
        """Words of a block: a power of two, at least twice the template's words; blocks
        start at every half, so that any passage as long as the template lies in one."""
        return 1 << max(2 * len(self.words) - 1, 1).bit_length()


def templates_of(pairs: list[tuple[str, str]]) -> list[Template]:
    """Templates from (label, text); of a text without words there is nothing to find."""
    made = [Template(label, tuple(w for part in words_of(text) for w in part)) for label, text in pairs]
    made = [t for t in made if t.words]
    if sum(len(t.words) for t in made) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words in all")
    return made


class Words:
    """Numbers of the words that templates and phrases are made of; -1 for any other."""

    def __init__(self, vocabulary: list[bytes]):
        self.number = {w: k for k, w in enumerate(vocabulary)}

    def of(self, text: str | None) -> np.ndarray:
        get = self.number.get
        parts = [np.fromiter(map(get, part, repeat(-1)), np.int32, len(part)) for part in words_of(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def word_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many rows of ``docs`` (text) each word of the vocabulary stands. A task sends as
    many rows as the vocabulary has words, no more reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = Words(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = np.unique(words.of(text.as_py()))
                count[ids[ids >= 0]] += 1
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(count[found])], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {vocabulary[r.word]: r.n for r in counted.collect()}


class Scanner:
    """Finds phrases and templates in the numbered words of a text; a word's number is its
    rank in the global order, rarest first."""

    def __init__(self, vocabulary: list[bytes], templates: list[Template], phrases: dict[str, str]):
        self.words = Words(vocabulary)
        rank = self.words.number
        self.phrases = [
            (np.array([rank[w] for w in part], np.int32), label)
            for text, label in phrases.items() if (part := [w for p in words_of(text) for w in p])
        ]
        self.templates = [(t, np.array(sorted(rank[w] for w in t.distinct), np.int32)) for t in templates]
        self.sizes = sorted({t.block for t in templates})
        #: Per block size: which templates a word starts a comparison with.
        self.prefixes: dict[int, dict[int, list[int]]] = {size: {} for size in self.sizes}
        for k, (t, ranks) in enumerate(self.templates):
            for word in ranks[: len(ranks) - t.needed + 1].tolist():
                self.prefixes[t.block].setdefault(word, []).append(k)
        self.rare = {
            size: np.isin(np.arange(len(vocabulary)), list(found)) for size, found in self.prefixes.items()
        }

    def places(self, ids: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """(label, where a phrase of that label starts)."""
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids[: max(len(ids) - len(phrase) + 1, 0)] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[ids[at + k] == phrase[k]]
            yield label, at

    def joined(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, words of the block, shared words) of every pair of a block
        and a template that meets the containment threshold."""
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return
        for size in self.sizes:
            step = size // 2
            rare = known[self.rare[size][ids[known]]]
            blocks = np.unique(np.concatenate([rare // step, rare // step - 1]))
            for block in blocks[blocks >= 0].tolist():
                start = block * step
                if block and start + step >= len(ids):
                    continue  # the block before reaches the end of the text too
                low, high = np.searchsorted(known, [start, start + size])
                mine = np.unique(ids[known[low:high]])
                starts = mine[self.rare[size][mine]].tolist()
                for k in sorted({k for word in starts for k in self.prefixes[size][word]}):
                    template, ranks = self.templates[k]
                    if len(mine) < template.needed:
                        continue
                    # First shared word: what can follow it, here and in the template, bounds the overlap.
                    at = int(np.flatnonzero(np.isin(ranks, mine, assume_unique=True))[0])
                    here = int(np.searchsorted(mine, ranks[at]))
                    if 1 + min(len(ranks) - at - 1, len(mine) - here - 1) < template.needed:
                        continue
                    shared = len(np.intersect1d(ranks, mine, assume_unique=True))
                    if shared >= template.needed:
                        yield k, start, min(size, len(ids) - start), shared


BLOCKS = "doc_id long, label string, template int, first_word long, block_words long, shared long, template_words long"
SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def _scanner(docs: DataFrame, templates: list[tuple[str, str]], phrases: dict[str, str]) -> tuple:
    made = templates_of(templates)
    vocabulary = {w for t in made for w in t.distinct} | {w for p in phrases for part in words_of(p) for w in part}
    frequency = word_frequencies(docs, sorted(vocabulary)) if vocabulary else {}
    return sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)), made, dict(phrases)


def license_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The join itself: a row per block of ``docs`` (doc_id, text) and template (its place in
    the list) of which the block holds at least four fifths of the distinct words.

    Words are runs of letters, digits and anything beyond ASCII, A-Z lowered. Null and empty
    texts have no blocks; null and repeated ids are rows like any other; an empty table or
    an empty list gives no rows; other columns are not read.
    """
    made = _scanner(docs, templates, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*made)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, start, size, shared in scanner.joined(scanner.words.of(text.as_py())):
                    t, ranks = scanner.templates[k]
                    out.append((doc, t.label, k, start, size, shared, len(ranks)))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licenses per row of ``docs`` (doc_id, text): places of the phrases (how many, the first
    and the last, in words from 0), their labels, all labels with those of templates that a
    block holds, and a score: 1 where a phrase stands, else the largest share of a template's
    distinct words in a block that holds enough of them, else 0.

    Nulls, empty texts and tables, and repeated rows as in ``license_blocks``; a text without
    words has zeros, null places and empty labels.
    """
    made = _scanner(docs, templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*made)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = scanner.words.of(text.as_py())
                places = [(label, at) for label, at in scanner.places(ids) if len(at)]
                base, labels, score = {label for label, _ in places}, {label for label, _ in places}, float(bool(places))
                for k, _, _, shared in scanner.joined(ids):
                    t, ranks = scanner.templates[k]
                    labels.add(t.label)
                    score = max(score, shared / len(ranks))
                out.append((
                    doc, len(ids), sum(len(at) for _, at in places),
                    min((int(at[0]) for _, at in places), default=None), max((int(at[-1]) for _, at in places), default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), score,
                ))
            cols = list(zip(*out)) or [()] * 8
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64())
            names = [x.split()[0] for x in SCAN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN)
