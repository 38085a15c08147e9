"""Documents kept in parts that are cut anywhere.

A text too long for one cell is rows ``(doc_id, part_no, text)`` whose texts in order are
the document. An operator that reads a whole text meets two questions at a cut: in what
state does a part begin (inside a quoted cell, a comment, a page marker), and what at its
front still belongs to the part before. Both are answered by all parts at once:

* each part tells, for every state it may begin in, the state it ends in and how much of
  its front belongs to the part before. The mappings are strings, compose by ``translate``
  and are composed block by block, then over the blocks, so that every part learns its
  state (``carried_states``);
* the front of each part moves to the last part before it that is longer than its own front
  (``aligned``). Parts then hold whole records, tags or markers, and the operators for whole
  texts apply to each of them.

All but the last step works on narrow rows, a few numbers per part, which are written to the
shared folder. Texts move once, by (document, part), to meet the fronts that they gain, and
not at all where the fronts are few enough to be broadcast. Blocks hold a bounded number of
parts, so a document may have any number of them. What is never cut, one record or one
element whose text is not shown, has to fit a cell. Ids are not null; part numbers need to
rise, not to be dense.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import content as B
from leafwork.functions import text as T
from leafwork.functions.csv import csv_records
from leafwork.functions.html import text_nodes, visible_html
from leafwork.operators.extract import batch_rows, explode_once
from leafwork.session import stored

PARTS_PER_BLOCK = 1_000
#: Rows of a part each that a join may broadcast, some 100 bytes each in memory.
BROADCAST_PARTS = 200_000


def _block(no: str, size: int) -> Column:
    return F.floor(F.col(no) / F.lit(int(size))).cast("long")


def _then(state: Column, step: Column, states: str) -> Column:
    """The state (or mapping) after ``step``, whose n-th character follows the n-th state."""
    return F.call_function("translate", state, F.lit(states), step)


def carried_states(
    steps: DataFrame, doc_id: str, part_no: str, states: str, block_size: int = PARTS_PER_BLOCK
) -> DataFrame:
    """(doc_id, part_no, state) each part begins in, from ``step`` per part; the first state
    of ``states`` is the one a document begins in."""
    entry = F.struct(F.col(part_no).alias("no"), "step")
    blocks = (
        steps.groupBy(doc_id, _block(part_no, block_size).alias("_block"))
        .agg(F.sort_array(F.collect_list(entry)).alias("_run"))
        .withColumn("_step", F.aggregate("_run", F.lit(states), lambda done, r: _then(done, r["step"], states)))
    )

    def begun(run: Column, first: Column) -> Column:
        """Entries of a run with the state each begins in."""
        start = F.struct(first.alias("state"), F.array().cast("array<struct<no:bigint,state:string>>").alias("seen"))
        return F.aggregate(
            run,
            start,
            lambda acc, r: F.struct(
                _then(acc["state"], r["step"], states).alias("state"),
                F.concat(
                    acc["seen"], F.array(F.struct(r["no"].cast("long").alias("no"), acc["state"].alias("state")))
                ).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )

    runs = blocks.groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_block").alias("no"), F.col("_step").alias("step")))).alias("_blocks")
    )
    firsts = runs.select(doc_id, F.inline(begun(F.col("_blocks"), F.lit(states[0])))).select(
        doc_id, F.col("no").alias("_block"), F.col("state").alias("_first")
    )
    return blocks.join(firsts, [doc_id, "_block"]).select(
        doc_id, F.inline(begun(F.col("_run"), F.col("_first"))).alias(part_no, "state")
    )


def running(
    rows: DataFrame,
    doc_id: str,
    no: str,
    value: str,
    how: Callable[[Column], Column] = F.sum,
    name: str = "before",
    block_size: int = PARTS_PER_BLOCK,
) -> DataFrame:
    """``rows`` with ``how`` of ``value`` over the document's earlier rows (null: none), summed
    up in blocks and then over the blocks, so no window holds more than a block or a
    document's blocks."""
    up_to = (Window.unboundedPreceding, -1)
    blocked = rows.withColumn("_block", _block(no, block_size))
    totals = blocked.groupBy(doc_id, "_block").agg(how(F.col(value)).alias("_total"))
    over_blocks = Window.partitionBy(doc_id).orderBy("_block").rowsBetween(*up_to)
    earlier = totals.select(doc_id, "_block", how(F.col("_total")).over(over_blocks).alias("_earlier"))
    inside = how(F.col(value)).over(Window.partitionBy(doc_id, "_block").orderBy(no).rowsBetween(*up_to))
    both = blocked.withColumn("_inside", inside).join(earlier, [doc_id, "_block"])
    pair = F.array("_earlier", "_inside")
    added = {F.max: F.greatest, F.min: F.least}.get(how, lambda a, b: a + b)
    combined = F.aggregate(
        F.filter(pair, lambda v: v.isNotNull()),
        F.lit(None).cast("long" if how is F.sum else dict(rows.dtypes)[value]),
        lambda a, b: F.coalesce(F.when(a.isNotNull(), added(a, b)), b),
    )
    return both.select(*rows.columns, combined.alias(name))


def _per_part(rows: DataFrame, name: str) -> DataFrame:
    """``stored`` rows, one per part. Their files are so much smaller than the rows are in memory
    that a join would broadcast millions of them, so more than a few are merged by key."""
    kept = stored(rows, name)
    return kept.hint("merge") if kept.count() > BROADCAST_PARTS else kept


def aligned(
    parts: DataFrame,
    states: str,
    step: Column,
    fronts: list[Column],
    doc_id: str = "doc_id",
    part_no: str = "part_no",
    text: str = "text",
) -> DataFrame:
    """Parts cut anew, where the state machine allows it.

    ``step`` maps ``states`` to what follows them, ``fronts`` tells for each of them how many
    characters (bytes, if that is what parts are made of) belong to the part before. They go
    to the last earlier part that is longer than its own front, else to the first, which
    keeps its own. Parts of which nothing is left have no row.
    """
    kind = dict(parts.dtypes)[text]
    nothing = F.lit("").cast(kind)
    names = [c for c in parts.columns if c not in (doc_id, part_no, text)]
    rows = parts.select(doc_id, F.col(part_no).cast("long").alias(part_no), F.coalesce(text, nothing).alias(text), *names)
    size = F.char_length(text) if kind == "string" else F.octet_length(text)
    facts = _per_part(
        rows.select(doc_id, part_no, step.alias("step"), F.array(*fronts).alias("_fronts"), size.alias("_size")), "parts-facts"
    )
    front = F.get("_fronts", F.instr(F.lit(states), F.col("state")) - 1)
    known = facts.join(carried_states(facts.select(doc_id, part_no, "step"), doc_id, part_no, states), [doc_id, part_no])
    cut = running(known.select(doc_id, part_no, front.alias("_front"), "_size"), doc_id, part_no, part_no, F.min, "_first")
    first = F.col("_first").isNull()
    cut = cut.select(
        doc_id, part_no, "_first", F.when(first, 0).otherwise(F.col("_front")).alias("_front"),
        F.when(first | (F.col("_front") < F.col("_size")), F.col(part_no)).alias("_mine"),
    )
    owned = running(cut, doc_id, part_no, "_mine", F.max, "_before").withColumn("_owner", F.coalesce("_before", "_first"))
    cut = _per_part(owned.select(doc_id, part_no, "_front", "_mine", "_owner"), "parts-cuts")

    both = rows.select(doc_id, part_no, text).join(cut, [doc_id, part_no])
    head = F.substr(text, F.lit(1), F.col("_front"))
    moved = both.where("_front > 0").groupBy(doc_id, F.col("_owner").alias(part_no)).agg(
        F.sort_array(F.collect_list(F.struct(F.col(part_no).alias("no"), head.alias("head")))).alias("_heads")
    )
    joined = (
        F.array_join("_heads.head", "") if kind == "string" else F.aggregate("_heads.head", nothing, lambda a, b: F.concat(a, b))
    )
    tails = moved.select(doc_id, part_no, joined.alias("_tail"))
    bodies = both.where("_mine IS NOT NULL").select(doc_id, part_no, F.substr(text, F.col("_front") + 1).alias("_body"))
    # The left side stays where the first join has put it.
    whole = bodies.join(tails, [doc_id, part_no], "left").select(
        doc_id, part_no, F.concat("_body", F.coalesce("_tail", nothing)).alias(text)
    )
    return whole.where(F.col(text) != nothing)


# --- bytes ----------------------------------------------------------------------------

#: At the front of a part, in hex: up to three bytes that go on a character of UTF-8, then a
#: line feed (it may follow a carriage return); the same for UTF-16 by its byte order.
_UTF8_FRONT = r"\A(?:[89AB][0-9A-F]){0,3}(?:0A)?"
_UTF16_FRONTS = {"FFFE": r"\A(?:..D[C-F])?(?:0A00)?", "FEFF": r"\A(?:D[C-F]..)?(?:000A)?"}


def decode_parts(
    parts: DataFrame, doc_id: str = "doc_id", part_no: str = "part_no", content: str = "content"
) -> DataFrame:
    """``decode_text`` for files in byte parts: (doc_id, part_no, text), texts that in order
    make up the file's text.

    Parts, numbered without gaps, may be cut inside a character or a line end; those of UTF-16
    at even places. The character set is one for all parts of a file: by its mark, else UTF-8 if all of it is
    valid, else Windows-1252.
    """
    no = F.col(part_no).cast("long")
    rows = parts.select(doc_id, no.alias(part_no), F.coalesce(content, F.lit(b"")).alias(content))
    # A mark may itself be cut: the first bytes of a file's first parts.
    fronts = rows.where(F.octet_length(content) > 0).select(doc_id, part_no, F.hex(F.substring(content, 1, 3)).alias("hex"))
    leading = fronts.groupBy(doc_id).agg(F.min(part_no).alias("_least")).join(fronts, doc_id)
    leading = leading.where(F.col(part_no) < F.col("_least") + 3).groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col(part_no).alias("no"), "hex"))).alias("_f")
    )
    marks = stored(leading.select(doc_id, F.array_join("_f.hex", "").alias("_mark")), "parts-marks")
    marked = rows.join(marks, doc_id, "left").withColumn("_mark", F.coalesce("_mark", F.lit("")))
    hexed = F.hex(F.substring(content, 1, 4))
    pattern = F.regexp_extract(hexed, _UTF8_FRONT, 0)
    for mark, fronts in _UTF16_FRONTS.items():
        pattern = F.when(F.startswith("_mark", F.lit(mark)), F.regexp_extract(hexed, fronts, 0)).otherwise(pattern)
    front = (F.char_length(pattern) / 2).cast("int")
    whole = stored(aligned(marked, "N", F.lit("N"), [front], doc_id, part_no, content), "parts-bytes")
    facts = whole.groupBy(doc_id).agg(
        F.bool_and(F.is_valid_utf8(F.col(content).cast("string"))).alias("_valid"), F.min(part_no).alias("_least")
    )
    known = whole.join(facts, doc_id).join(marks, doc_id)
    first = F.col(part_no) == F.col("_least")

    def unmarked(n: int) -> Column:
        return F.when(first, F.substring(content, n + 1, 2**31 - 1)).otherwise(F.col(content))

    text = (
        F.when(F.startswith("_mark", F.lit("EFBBBF")), B.utf8_text(unmarked(3)))
        .when(F.startswith("_mark", F.lit("FFFE")), F.try_validate_utf8(F.decode(unmarked(2), "UTF-16LE")))
        .when(F.startswith("_mark", F.lit("FEFF")), F.try_validate_utf8(F.decode(unmarked(2), "UTF-16BE")))
        .when(F.col("_valid"), F.col(content).cast("string"))
        .otherwise(B.windows_1252_text(F.col(content)))
    )
    return known.select(doc_id, part_no, T.normalize_newlines(text).alias("text"))


# --- CSV ----------------------------------------------------------------------------

# States at a cut: Record start, Field start, Unquoted cell (or what follows a closing quote),
# Quoted cell, after a quote in a quoted cell (it may be doubled: E), after a Carriage return.
CSV_STATES = "RFUQEC"
#: What brings a reader from a record's start into the state.
_CSV_LEAD = {"R": "", "F": "", "U": "x", "Q": '"', "E": '"x"', "C": ""}
_CSV_CELL = r"(?:\"(?:[^\"]++|\"\")*+\"|(?!\"))[^,\r\n]*+"
_CSV_DONE = rf"\A(?:{_CSV_CELL}(?:,|\r\n|\r|\n))*+"
_CSV_RECORD = rf"\A(?:{_CSV_CELL},)*+{_CSV_CELL}(?:\r\n|\r|\n)"


def _csv_end(text: Column, lead: str) -> Column:
    """The state after ``lead`` and ``text``, read from a record's start."""
    led = F.concat(F.lit(lead), text) if lead else text

    def state(rest: Column) -> Column:
        open_cell = F.when(rest.rlike(r"\A\"(?:[^\"]++|\"\")*+\z"), "Q").when(
            rest.rlike(r"\A\"(?:[^\"]++|\"\")*+\"\z"), "E"
        ).otherwise("U")
        after = F.when(F.endswith(text, F.lit(",")), "F").when(F.endswith(text, F.lit("\r")), "C").otherwise("R")
        return F.when(rest == "", after).when(F.startswith(rest, F.lit('"')), open_cell).otherwise("U")

    return T.let(F.regexp_replace(led, _CSV_DONE, ""), state)


def csv_step(text: Column) -> Column:
    """For each of ``CSV_STATES`` the state after ``text``. Two readings do for most parts:
    from outside and from inside a quoted cell; only a quote at the very front needs more."""
    quote_first = F.startswith(text, F.lit('"'))

    def steps(outside: Column) -> Column:
        bare = F.when(quote_first, _csv_end(text, _CSV_LEAD["U"])).otherwise(outside)
        doubled = F.when(quote_first, _csv_end(text, _CSV_LEAD["E"])).otherwise(outside)
        return F.concat(outside, outside, bare, _csv_end(text, _CSV_LEAD["Q"]), doubled, outside)

    return F.when(text == "", CSV_STATES).otherwise(T.let(_csv_end(text, ""), steps))


def csv_fronts(text: Column) -> list[Column]:
    """For each of ``CSV_STATES`` the characters before the first record that begins in the text."""

    def up_to_record(lead: str) -> Column:
        led = F.concat(F.lit(lead), text) if lead else text
        found = F.char_length(F.regexp_extract(led, _CSV_RECORD, 0))
        return F.when(found > 0, found - len(lead)).otherwise(F.char_length(text))

    fronts = {name: up_to_record(_CSV_LEAD[name]) for name in "FUQE"}
    fronts |= {"R": F.lit(0), "C": F.startswith(text, F.lit("\n")).cast("int")}
    return [fronts[name] for name in CSV_STATES]


def csv_aligned(parts: DataFrame, doc_id: str = "doc_id", part_no: str = "part_no", text: str = "text") -> DataFrame:
    """Parts of CSV files, cut anywhere, to parts that hold whole records."""
    return aligned(parts, CSV_STATES, csv_step(F.col(text)), csv_fronts(F.col(text)), doc_id, part_no, text)


def csv_part_rows(parts: DataFrame, doc_id: str = "doc_id", part_no: str = "part_no", text: str = "text") -> DataFrame:
    """``csv_rows`` for files in parts, cut anywhere: (doc_id, row_no, text) per record,
    numbered from 1 through all parts of a file."""
    whole = csv_aligned(parts, doc_id, part_no, text)
    # Read twice, to number and to tell them: parsed once.
    records = stored(whole.select(doc_id, part_no, csv_records(F.col(text)).alias(text)), "parts-records")
    counts = records.select(doc_id, part_no, F.size(text).cast("long").alias("_n"))
    before = running(counts, doc_id, part_no, "_n").select(doc_id, part_no, F.coalesce("before", F.lit(0)).alias("_before"))
    numbered = explode_once(records.join(before, [doc_id, part_no]), F.col(text), "_no", text, 1)
    return numbered.select(doc_id, (F.col("_before") + F.col("_no")).alias("row_no"), text)


def csv_parts_to_text(
    parts: DataFrame,
    rows_per_chunk: int = C.SHEET_ROWS_PER_CHUNK,
    doc_id: str = "doc_id",
    part_no: str = "part_no",
    text: str = "text",
) -> DataFrame:
    """``csv_to_text`` for files in parts: the same chunks of records, whatever the cuts."""
    return batch_rows(csv_part_rows(parts, doc_id, part_no, text), rows_per_chunk, doc_id, "row_no", text)


# --- pages ---------------------------------------------------------------------------

#: A page marker as far as it may be read at a cut, its digits as one: each is a state.
_MARK = C.PAGE_MARKER_PREFIX + "1 ---"
_MARK_SO_FAR = [_MARK[:k] for k in range(len(_MARK))]
PAGE_STATES = "abcdefghijklmnopqrstuvwxyz"[: len(_MARK)]
_DIGIT = r"\p{Nd}"
_WHOLE_MARK = rf"{C.PAGE_MARKER_PREFIX}{_DIGIT}++ ---"


def _begun(rest: str) -> str:
    """A pattern for any beginning of ``rest``."""
    return "".join(f"(?:{_DIGIT + '++' if c == '1' else c}" for c in rest) + ")?" * len(rest)


#: The end of a text from where a marker may have begun.
_BEGUN_MARK = "-" + _begun(_MARK[1:-1]) + r"\z"
#: One attempt at a marker from its dashes on, as far as it goes; and attempts that end in
#: the dashes of the next, then the marker that is whole or the attempt that breaks off.
_ATTEMPT = rf"(?:-++(?<=---){_begun(_MARK[3:-1])}|-++)"
_FULL = rf"-++(?<=---){_WHOLE_MARK[3:]}"
_ATTEMPTS = rf"\A(?:(?!{_FULL}){_ATTEMPT}(?=-))*+(?:{_FULL}|{_ATTEMPT})"


def _page_end(text: Column, lead: str) -> Column:
    led = F.concat(F.lit(lead), text) if lead else text
    rest = F.element_at(F.split(led, _WHOLE_MARK, -1), -1)
    begun = F.regexp_replace(F.regexp_extract(rest, _BEGUN_MARK, 0), rf"{_DIGIT}+", "1")
    return F.substr(F.lit(PAGE_STATES), F.char_length(begun) + 1, F.lit(1))


def _may_go_on(text: Column, so_far: str) -> Column:
    """Whether the text's first character goes on with a marker read ``so_far``."""
    first = {_MARK[len(so_far)]} | ({"-"} if so_far == "---" else set()) | ({"1"} if so_far[-1] == "1" else set())
    rule = F.lit(False)
    for c in sorted(first):
        rule = rule | (text.rlike(rf"\A{_DIGIT}") if c == "1" else F.startswith(text, F.lit(c)))
    return rule


def page_step(text: Column) -> Column:
    """For each of ``PAGE_STATES`` the state after ``text``: one reading, and another for a
    state whose marker the first character goes on with."""

    def steps(plain: Column) -> Column:
        ends = [F.when(_may_go_on(text, lead), _page_end(text, lead)).otherwise(plain) for lead in _MARK_SO_FAR[1:]]
        return F.concat(plain, *ends)

    return F.when(text == "", PAGE_STATES).otherwise(T.let(_page_end(text, ""), steps))


def page_fronts(text: Column) -> list[Column]:
    """For each of ``PAGE_STATES`` the characters up to where the marker under way is whole or
    broken off."""

    def up_to_end(lead: str) -> Column:
        taken = F.char_length(F.regexp_extract(F.concat(F.lit(lead), text), _ATTEMPTS, 0)) - len(lead)
        return F.when(_may_go_on(text, lead), F.greatest(F.lit(0), taken)).otherwise(0)

    return [F.lit(0), *map(up_to_end, _MARK_SO_FAR[1:])]


def part_pages(parts: DataFrame, doc_id: str = "doc_id", part_no: str = "part_no", text: str = "text") -> DataFrame:
    """``split_pages`` for documents in parts, cut anywhere: (doc_id, page_no, text).

    A page may lie across parts; its pieces meet by (document, markers before them), so a
    document's pages spread over tasks, and a page has to fit a cell.
    """
    whole = aligned(parts, PAGE_STATES, page_step(F.col(text)), page_fronts(F.col(text)), doc_id, part_no, text)
    split = whole.select(doc_id, part_no, F.split(text, C.PAGE_MARKER_PATTERN, -1).alias(text))
    marks = split.select(doc_id, part_no, (F.size(text) - 1).cast("long").alias("_n"))
    before = running(marks, doc_id, part_no, "_n").select(doc_id, part_no, F.coalesce("before", F.lit(0)).alias("_before"))
    pieces = split.join(before, [doc_id, part_no]).select(
        doc_id, part_no, "_before", F.posexplode(text).alias("_at", text)
    )
    pages = pieces.groupBy(doc_id, (F.col("_before") + F.col("_at")).alias("_page")).agg(
        T.strip(F.array_join(F.sort_array(F.collect_list(F.struct(part_no, text)))[text], "")).alias(text)
    )
    pages = stored(pages.where(F.col(text) != ""), "parts-pages")
    order = running(pages.select(doc_id, "_page", F.lit(1).cast("long").alias("_one")), doc_id, "_page", "_one")
    numbered = pages.join(order.select(doc_id, "_page", "before"), [doc_id, "_page"])
    return numbered.select(doc_id, (F.coalesce("before", F.lit(0)) + 1).alias("page_no"), text)


# --- HTML -----------------------------------------------------------------------------

# States before a "<", where HTML parts are cut: None, in a comment, in an element that is
# not shown (lower case), in the start tag of one (upper case).
_UNSHOWN = {"s": "script", "t": "style", "o": "noscript", "p": "template", "r": "rt"}
HIDDEN_STATES = "Nc" + "".join(_UNSHOWN) + "".join(_UNSHOWN).upper()
_RUBY_END = r"(?:</r[tp]\s*+>|(?=<r[tp][\s/>])|(?=</?(?:ruby|rtc)[\s/>]))"
_HIDDEN_OPEN = r"<!--|<(?:script|style|noscript|template|r[tp])(?=[\s/>])"
_HIDDEN_DONE = (
    r"<!--.*?-->|<(script|style|noscript|template)(?=[\s/>])[^>]*+>.*?</\1\s*+>"
    rf"|<r[tp](?=[\s/>])[^>]*+>.*?{_RUBY_END}"
)
_TO_HIDDEN = rf"(?is)\A(?:[^<]++|{_HIDDEN_DONE}|(?!{_HIDDEN_OPEN})<)*+"


def _closing(name: str) -> str:
    return _RUBY_END if name == "rt" else rf"</{name}\s*+>"


def _hidden_end(text: Column, lead: str) -> Column:
    led = F.concat(F.lit(lead), text) if lead else text

    def state(rest: Column) -> Column:
        rule = F.when(rest == "", "N").when(F.startswith(rest, F.lit("<!--")), "c")
        shown = rest.rlike(r"\A<[^>]*+>")
        for letter, name in _UNSHOWN.items():
            named = rest.rlike(rf"(?i)\A<(?:{'r[tp]' if name == 'rt' else name})[\s/>]")
            rule = rule.when(named & shown, letter).when(named, letter.upper())
        return rule

    return T.let(F.regexp_replace(led, _TO_HIDDEN, ""), state)


def hidden_step(text: Column) -> Column:
    """For each of ``HIDDEN_STATES`` the state after ``text``; a state whose end the part does
    not hold is not read."""
    ends = [_hidden_end(text, ""), F.when(F.contains(text, F.lit("-->")), _hidden_end(text, "<!--")).otherwise("c")]
    inside, starting = [], []
    for letter, name in _UNSHOWN.items():
        closed = text.rlike(rf"(?is){_closing(name)}")
        inside.append(F.when(closed, _hidden_end(text, f"<{name}>")).otherwise(letter))
        starting.append(
            F.when(~F.contains(text, F.lit(">")), letter.upper())
            .when(closed, _hidden_end(text, f"<{name} "))
            .otherwise(letter)
        )
    return F.when(text == "", HIDDEN_STATES).otherwise(F.concat(*ends, *inside, *starting))


def _up_to(text: Column, front: str) -> Column:
    """Characters up to the end of ``front``, all where the text does not hold it."""
    return F.when(text.rlike(front), F.char_length(F.regexp_extract(text, front, 0))).otherwise(F.char_length(text))


def hidden_fronts(text: Column) -> list[Column]:
    """For each of ``HIDDEN_STATES`` the characters up to where text is shown again."""
    inside = [_up_to(text, rf"(?is)\A.*?{_closing(name)}") for name in _UNSHOWN.values()]
    starting = [_up_to(text, rf"(?is)\A[^>]*+>.*?{_closing(name)}") for name in _UNSHOWN.values()]
    return [F.lit(0), _up_to(text, r"(?s)\A.*?-->"), *inside, *starting]


# States of what is left: Data, in a tag (Bare, in a double or an apostrophe quoted value), in
# a declaration to be skipped (G), in a doctype (Y; what follows it stays in its part).
TAG_STATES = "DBqaGY"
_IN_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAG_OPEN = r"</?[a-zA-Z]|<[!?]"
_TAG_DONE = (
    rf"</?[a-zA-Z]{_IN_TAG}>"
    r"|<!(?i:doctype)(?:[^>\[\"']++|\"[^\"]*+\"|'[^']*+'|\[(?:[^\]\"']++|\"[^\"]*+\"|'[^']*+')*+\])*+>"
    r"|<(?:!(?!(?i:doctype))|\?)[^>]*+>"
)
_TO_TAG = rf"\A(?:[^<]++|{_TAG_DONE}|(?!{_TAG_OPEN})<)*+"


def _tag_end(text: Column, lead: str) -> Column:
    led = F.concat(F.lit(lead), text) if lead else text

    def state(rest: Column) -> Column:
        value = F.regexp_replace(rest, rf"\A</?[a-zA-Z]{_IN_TAG}", "")
        return (
            F.when(rest == "", "D")
            .when(rest.rlike(r"(?i)\A<!doctype"), "Y")
            .when(rest.rlike(r"\A<[!?]"), "G")
            .when(F.startswith(value, F.lit('"')), "q")
            .when(F.startswith(value, F.lit("'")), "a")
            .otherwise("B")
        )

    return T.let(F.regexp_replace(led, _TO_TAG, ""), state)


def tag_step(text: Column) -> Column:
    """For each of ``TAG_STATES`` the state after ``text``."""

    def if_held(char: str, lead: str, state: str) -> Column:
        return F.when(F.contains(text, F.lit(char)), _tag_end(text, lead)).otherwise(state)

    ends = [_tag_end(text, ""), _tag_end(text, "<a "), if_held('"', '<a "', "q"), if_held("'", "<a '", "a"), if_held(">", "<!", "G")]
    return F.when(text == "", TAG_STATES).otherwise(F.concat(*ends, F.lit("Y")))


def tag_fronts(text: Column) -> list[Column]:
    """For each of ``TAG_STATES`` the characters up to the end of the tag, or of the text node."""
    # A part starts with its first tag if it holds that tag's end; one without an end is text.
    node = rf"\A(?:[^<]++|(?!{_TAG_OPEN})<)*+"
    first = F.when(
        text.rlike(rf"{node}(?:{_TAG_DONE})"), F.char_length(F.regexp_extract(text, node, 0))
    ).otherwise(F.char_length(text))
    ends = [rf"\A{_IN_TAG}>", rf"\A[^\"]*+\"{_IN_TAG}>", rf"\A[^']*+'{_IN_TAG}>", r"\A[^>]*+>"]
    return [first, *[_up_to(text, end) for end in ends], F.char_length(text)]


def html_part_texts(parts: DataFrame, doc_id: str = "doc_id", part_no: str = "part_no", text: str = "text") -> DataFrame:
    """``html_text`` for pages in parts, cut anywhere: (doc_id, part_no, text), texts that in
    order make up the page's text.

    Cuts first move to a "<", then out of comments and elements that are not shown, then out
    of tags and text nodes; what is left in a part is read as if it were a page. A tag that
    is never closed keeps all that follows it in its part, as it hides it from the reader.
    """
    keys, t = (doc_id, part_no, text), F.col(text)
    before_tag = F.instr(t, "<") - 1
    up_to_tag = F.when(before_tag < 0, F.char_length(t)).otherwise(before_tag)
    at_tags = stored(aligned(parts, "N", F.lit("N"), [up_to_tag], *keys), "parts-tags")
    unhidden = aligned(at_tags, HIDDEN_STATES, hidden_step(t), hidden_fronts(t), *keys)
    visible = stored(unhidden.withColumn(text, visible_html(t)), "parts-visible")
    whole = aligned(visible, TAG_STATES, tag_step(t), tag_fronts(t), *keys)
    lines = stored(whole.select(doc_id, part_no, text_nodes(F.col(text)).alias(text)), "parts-texts").where(F.col(text) != "")
    order = running(lines.select(doc_id, part_no, F.lit(1).cast("long").alias("_one")), doc_id, part_no, "_one")
    joined = lines.join(order.select(doc_id, part_no, "before"), [doc_id, part_no])
    return joined.select(
        doc_id, part_no, F.when(F.col("before").isNull(), F.col(text)).otherwise(F.concat(F.lit("\n"), text)).alias(text)
    )
