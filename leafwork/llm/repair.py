"""Conversation repair: weighted CYK parsing of role sequences over spans.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. The repair
grammar is in Chomsky normal form: a nonterminal is a pair of states of that pattern and
derives what leads from the one to the other, ``pq -> pr rq``; a terminal is a row under
one edit (keep, rerole, delete); insertions derive nothing of the input, so that their
closure is worked into every cell. A span's cell holds, per nonterminal, the cheapest
(cost, audit), audits being the edits' initials. In this grammar every cut of a span gives
the same cell (a derivation can be cut at any row), so spans are combined bottom-up by
length, each from two halves, and pieces of one conversation can be parsed in many tasks.

Rows are range-partitioned and sorted by (conversation, turn): a conversation inside one
task is repaired there. Those at the edges of tasks, so also any that is larger than a
task, are parsed in pieces; their cells are combined and the edits meet the rows again in
one sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import lookup, partitions, saved

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Start, after the system turn, after a user turn, after an assistant turn.
STATES = (0, 1, 2, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
MOST = 2**63 - 1

Cell = dict[tuple[int, int], tuple[int, str]]


def _closure() -> Cell:
    """The cell of an empty span: cheapest insertions from state to state."""
    best: Cell = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (cost, audit) in list(best.items()):
            for (state, letter), after in STEPS.items():
                if state == q and letter != "s":
                    found = (cost + INSERT, audit + "I")
                    best[p, after] = min(best.get((p, after), found), found)
    return best


EMPTY = _closure()
#: pq -> pr rq, for every nonterminal that derives anything.
PAIRS = tuple(sorted({(p, q) for p, q in EMPTY} | {(p, q) for (p, _), q in STEPS.items()}))
RULES = {(p, q): tuple(((p, r), (r, q)) for r in STATES if (p, r) in PAIRS and (r, q) in PAIRS) for p, q in PAIRS}


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans: all binary rules, cheapest derivation of each."""
    out = {}
    for pair, cuts in RULES.items():
        best = None
        for a, b in cuts:
            if a in left and b in right:
                (x, s), (y, t) = left[a], right[b]
                if best is None or x + y <= best[0]:
                    found = (x + y, s + t)
                    best = found if best is None else min(best, found)
        if best is not None:
            out[pair] = best
    return out


@lru_cache(maxsize=None)
def terminal(kind: str) -> Cell:
    """The cell of one row. ``kind``: d for a row that has to go, else its role's initial
    (x for any that is not s, u or a), in upper case where the text is truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if kind != "d":
        extra, role = (TRUNCATED if kind.isupper() else 0), kind.lower()
        for (p, letter), q in STEPS.items():
            edits = [(extra, "K")] if letter == role else []
            edits += [(extra + RETYPE, "R")] if letter != "s" else []
            if edits:
                cell[p, q] = min([*edits, *([cell[p, q]] if (p, q) in cell else [])])
    return combine(combine(EMPTY, cell), EMPTY)


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> Cell:
    return terminal(kinds) if len(kinds) == 1 else combine(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def parse(kinds: str) -> Cell:
    """The cell of a whole sequence of rows, spans of 1, 2, 4, ... rows at a time (the
    cells of spans of up to eight rows are remembered)."""
    spans = [_short(kinds[k : k + 8]) for k in range(0, len(kinds), 8)]
    while len(spans) > 1:
        spans = [combine(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0] if spans else EMPTY


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


def kind_of(role: str, blank: bool, again: bool, truncated: bool) -> str:
    if blank or again:
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if truncated else initial


class Edited:
    """Applies an audit to rows as they come: rows in, repaired (edit, role, text) out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2  # only a leading system turn makes it odd

    def _role(self) -> str:
        return "user" if (self.out - self.odd) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", self._role(), ""
            self.at, self.out = self.at + 1, self.out + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, role if edit == "K" else self._role(), text
            self.out += 1


#: What is known of a run of rows beside its cell; runs add up in order.
class Run:
    def __init__(self):
        self.kinds: list[str] = []
        self.first = self.last = None  # initials
        self.least = self.most = self.turn = None
        self.turns = self.blank = self.again = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, blank: bool, again: bool, truncated: bool) -> None:
        self.kinds.append(kind_of(role, blank, again, truncated))
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        self.blank += blank
        self.again += again and not blank
        self.truncated += truncated and not blank and not again

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, MOST)


LEGAL = ("su", "ua", "au")
REPORT = (
    "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)
TURNS = "conv_id long, position long, edit string, role string, text string"


def _prepared(turns: DataFrame, copies: str | None) -> DataFrame:
    """Rows with nulls as one space, facts of their texts, and keys to sort by."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    # A row that is not there (0 copies) only keeps its conversation's id.
    here = F.lit(1) if copies is None else F.coalesce(F.col(copies), F.lit(1)).cast("int")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"),
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), F.when(here > 0, text).otherwise("").alias("text"), here.alias("copies"),
    )
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.withColumns({
        "digest": F.unhex(F.sha2("text", 256)),
        "blank": last == "",
        "cut": ~last.isin("", ".", "!", "?"),
    })


SORT = ("key", "turn", "role", "digest", "salt")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in order of (conversation, turn), a conversation of any size over as many tasks
    as it needs; equal rows differ in salt, so that they can be parted too."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    return salted.repartitionByRange(partitions(rows.sparkSession), *SORT).sortWithinPartitions(*SORT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    from itertools import groupby

    yield from groupby(_rows(batches), key=lambda r: r["key"])


def _emit(rows: list[dict] | Iterator[dict], schema: pa.Schema, at_once: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("text") or "") + len(row.get("audit") or "")
        if size > at_once:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _told(run: Run, cell: Cell) -> dict:
    cost, audit = best(cell)
    return {
        "gaps": run.gaps(), "blank": run.blank, "duplicate": run.again, "truncated": run.truncated,
        "illegal": run.illegal, "cost": cost, "audit": audit,
    }


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations inside a task; of those at its two ends only the key."""

    def reports() -> Iterator[dict]:
        waiting = None
        for n, (key, group) in enumerate(_by_key(batches)):
            if n == 0:
                yield {"key": key}
                continue
            if waiting is not None:
                yield report(*waiting)
            # The rows of the last conversation seen are held: at most what one task holds.
            waiting = key, list(group)
        if waiting is not None:
            yield {"key": waiting[0]}

    def report(key: str, rows: list[dict]) -> dict:
        run, seen = Run(), set()
        for r in rows:
            for _ in range(r["copies"]):
                mine = r["role"], r["digest"]
                run.add(r["turn"], r["role"], r["blank"], mine in seen, r["cut"])
                seen.add(mine)
        told = _told(run, parse("".join(run.kinds)))
        edited, digest = Edited(told["audit"]), _Joined()
        for r in rows:
            for _ in range(r["copies"]):
                digest.add(edited.row(r["role"], r["text"]))
        digest.add(edited.inserted())
        return told | {"key": key, "conv_id": rows[0]["conv_id"], "repaired_sha256": digest.hex()}

    yield from _emit(reports(), _arrow(REPORT))


class _Joined:
    """SHA-256 of ``role:text`` joined by newlines, a turn in memory at a time."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True

    def hex(self) -> str:
        return self.hash.hexdigest()


PIECE = (
    "key string, conv_id long, start long, rows long, first string, last string, least long, most long, "
    "last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "costs array<long>, audits array<string>"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a task: the cell and counts of its rows there."""

    def pieces() -> Iterator[dict]:
        for key, group in _by_key(batches):
            run, start, conv = Run(), None, None
            for r in group:
                start, conv = r["seq"] if start is None else start, r["conv_id"]
                for copy in range(r["copies"]):
                    run.add(r["turn"], r["role"], r["blank"], copy > 0 or r["seq"] > r["first"], r["cut"])
            cell = parse("".join(run.kinds))
            yield {
                "key": key, "conv_id": conv, "start": start, "rows": len(run.kinds), "first": run.first, "last": run.last,
                "least": run.least, "most": run.most, "last_turn": run.turn, "turns": run.turns, "blank": run.blank,
                "duplicate": run.again, "truncated": run.truncated, "illegal": run.illegal,
                "costs": [cell[p][0] if p in cell else None for p in PAIRS],
                "audits": [cell[p][1] if p in cell else None for p in PAIRS],
            }

    yield from _emit(pieces(), _arrow(PIECE))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, one conversation after the other, to reports without a hash."""

    def reports() -> Iterator[dict]:
        for key, group in _by_key(batches):
            whole, cells, conv = Run(), [], None
            for r in group:
                conv = r["conv_id"]
                if not r["rows"]:
                    continue
                cells.append({p: (c, a) for p, c, a in zip(PAIRS, r["costs"], r["audits"]) if c is not None})
                if whole.last is not None:
                    whole.illegal += whole.last + r["first"] not in LEGAL
                whole.last = r["last"]
                if r["least"] is not None:
                    whole.turns += r["turns"] - (whole.turn == r["least"])
                    whole.least = r["least"] if whole.least is None else whole.least
                    whole.most, whole.turn = r["most"], r["last_turn"]
                whole.blank += r["blank"]
                whole.again += r["duplicate"]
                whole.truncated += r["truncated"]
                whole.illegal += r["illegal"]
            while len(cells) > 1:
                cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
            yield _told(whole, cells[0] if cells else EMPTY) | {"key": key, "conv_id": conv}

    yield from _emit(reports(), _arrow(REPORT))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A report, then its conversation's rows in order: the report with its hash."""

    def reports() -> Iterator[dict]:
        names = [x.split()[0] for x in REPORT.split(", ")]
        for _, group in _by_key(batches):
            told = next(group)
            edited, digest = Edited(told["audit"]), _Joined()
            for r in group:
                for _ in range(r["copies"]):
                    digest.add(edited.row(r["role"], r["text"]))
            digest.add(edited.inserted())
            yield {n: told[n] for n in names} | {"repaired_sha256": digest.hex()}

    yield from _emit(reports(), _arrow(REPORT))


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Report per conversation of ``turns`` (conv_id, turn, role, text): gaps in the turns, rows
    that are blank, repeated or truncated (the first of these counts), illegal neighbours, and
    the cheapest repair: its cost, its edits (K keep, R rerole, D delete, I insert; of equal cost
    the ASCII-least) and the SHA-256 of the repaired ``role:text`` lines.

    Rows are ordered by turn, nulls first, then role and text digest. Null roles and texts are
    one space, null ids a conversation of their own. ``copies`` may name a column that tells how
    often a row stands here; 0 keeps only the conversation's id, and one without rows has zeros,
    an empty audit and the hash of nothing. Blank rows and repetitions of role and text have to
    go. Repeated rows are repetitions, an empty table gives no rows, other columns are not read.

    A conversation may hold any share of the rows: what one task has to hold is a task's share of
    rows, or one conversation's audits; its texts pass through one task as a stream, since a
    SHA-256 is sequential.
    """
    spark = turns.sparkSession
    rows = _prepared(turns, copies)
    inside = saved(_sorted(rows).mapInArrow(_whole, REPORT), "repair-inside")
    done = inside.where("audit IS NOT NULL")
    # At most two conversations per task lie at an edge: told to all, whatever the input.
    edges = inside.where("audit IS NULL").select("key").distinct()
    rest = rows.join(F.broadcast(edges), "key", "left_semi")
    numbered = saved(_sorted(rest).drop("salt").withColumn("seq", F.monotonically_increasing_id()), "repair-edges")
    marked = numbered.select(
        "seq", "key", "conv_id", "turn", "role", "copies", "blank", "cut",
        F.sha2(F.concat(F.encode(F.concat("key", F.lit("\n"), "role", F.lit("\n")), "utf-8"), "digest"), 256).alias("again"),
    )
    firsts = saved(
        marked.where("copies > 0").groupBy("again").agg(F.min("seq").alias("first"), F.count("*").alias("n")), "repair-firsts"
    )
    known = lookup(marked, firsts.select("again", "first", "n"), "again", "n", ["seq"])
    parts = partitions(spark)
    pieces = known.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(_pieces, PIECE)
    parsed = saved(
        pieces.repartition(parts, "key").sortWithinPartitions("key", "start").mapInArrow(_combined, REPORT), "repair-parsed"
    )
    texts = numbered.select("key", "seq", "role", "text", "copies")
    both = parsed.withColumn("seq", F.lit(-1).cast("long")).unionByName(texts, allowMissingColumns=True)
    streamed = both.repartition(parts, "key").sortWithinPartitions("key", "seq").mapInArrow(_hashed, REPORT)
    return done.unionByName(streamed).drop("key")


def repaired_turns(turns: DataFrame, reports: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, position, edit, role, text, by the audits
    of ``reports`` (as ``repair`` gives them for the same rows). A conversation passes through a
    task as a sorted stream, of which a row and the audit are held; ids, nulls, order and empty
    tables as in ``repair``."""
    parts = partitions(turns.sparkSession)
    rows = _prepared(turns, copies)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    told = reports.select(key.alias("key"), "conv_id", "audit", F.lit(False).alias("row"))
    columns = ["key", "conv_id", "turn", "role", "text", "copies", "digest", "audit", "row"]
    both = told.unionByName(rows.withColumn("row", F.lit(True)), allowMissingColumns=True).select(*columns)
    ordered = both.repartition(parts, "key").sortWithinPartitions("key", "row", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for _, group in _by_key(batches):
                told = next(group)
                edited, at = Edited(told["audit"]), 0

                def steps() -> Iterator[tuple[str, str, str]]:
                    for r in group:
                        for _ in range(r["copies"]):
                            yield from edited.row(r["role"], r["text"])
                    yield from edited.inserted()

                for edit, role, text in steps():
                    yield {"conv_id": told["conv_id"], "position": at, "edit": edit, "role": role, "text": text}
                    at += 1

        yield from _emit(out(), _arrow(TURNS))

    return ordered.mapInArrow(run, TURNS)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults, chosen by the CRC-32 of ``conv_id:turn`` (nulls as one
    space) modulo 20: 0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it,
    4 sets its role to user. ``copies`` tells how often a row stands there, 0 for dropped ones."""
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    fault: Column = F.crc32(name) % 20
    return turns.select("conv_id", "turn", "role", "text", fault.alias("fault")).select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )
