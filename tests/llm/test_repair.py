import hashlib
import heapq
import random
import re
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest

from leafwork.llm import oracles, repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seq long"
GOOD = re.compile("(s?(ua)+)?").fullmatch


def cheapest(rows):
    """Cheapest (cost, audit, repaired) by searching all edits, by cost and then letters."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and GOOD(roles):
            return cost, audit, out
        # Of two ways to the same rest the first to be reached is the cheaper, then the less.
        state = at, 0 if not roles else 1 if roles == "s" else 2 if roles[-1] == "u" else 3
        if (state, roles[:1] == "s") in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((state, roles[:1] == "s"))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, roles + name[0], (*out, (name, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, out))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + (role[:1] or "?"), (*out, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, roles + name[0], (*out, (name, text))))


def report(rows):
    """What the contract asks for, of one conversation's (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, judged = set(), []
    for _, role, text in rows:
        seen_before = (role, text) in seen
        seen.add((role, text))
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body else "duplicate" if seen_before else "" if body[-1] in ".!?" else "truncated"
        judged.append((role, text, fault))
    cost, audit, out = cheapest(judged)
    turns = [t for t, *_ in rows if t is not None]
    counts = [sum(f == name for *_, f in judged) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit, sha), out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def as_tuple(row):
    return tuple(row[c] for c in COLUMNS)


def test_every_cut_of_a_span_gives_its_cell():
    rng = random.Random(5)
    for _ in range(60):
        kinds = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randrange(1, 11)))
        # The full chart: all spans by length, all cuts of each.
        chart = {(k, k + 1): repair.terminal(c) for k, c in enumerate(kinds)}
        for length in range(2, len(kinds) + 1):
            for start in range(len(kinds) - length + 1):
                end = start + length
                cells = [repair.combine(chart[start, cut], chart[cut, end]) for cut in range(start + 1, end)]
                assert all(c == cells[0] for c in cells)
                chart[start, end] = cells[0]
        assert repair.parse(kinds) == chart[0, len(kinds)]


def test_cells_hold_the_cheapest_edits():
    rng = random.Random(6)
    kinds = {"d": ("user", "blank"), "s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "x": ("tool", "")}
    kinds |= {k.upper(): (role, "truncated") for k, (role, _) in kinds.items() if k != "d"}
    for _ in range(300):
        chosen = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randrange(0, 9)))
        rows = [(kinds[k][0], f"t{n}", kinds[k][1]) for n, k in enumerate(chosen)]
        cost, audit, out = cheapest(rows)
        assert repair.best(repair.parse(chosen)) == (cost, audit)
        edited = repair.Edited(audit)
        got = [x for role, text, _ in rows for x in edited.row(role, text)] + list(edited.inserted())
        assert [x[1:] for x in got] == list(out)


def odd_turns():
    rng = random.Random(7)
    roles, texts = ["system", "user", "assistant", None, "", "tool", "User"], ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "Ünï。"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randrange(1, 9))]
    rows += rows[:5]  # repeated rows
    # One conversation with a third of all rows, with turns that many rows share.
    rows += [(77, rng.randrange(40), rng.choice(roles[:3]), rng.choice([*texts, *map(str, range(50))])) for _ in range(90)]
    return rows + [(78, 2**62, "user", "a" * 40_000 + "."), (78, -(2**62), "assistant", "b.")]


def check(rows, got):
    by = defaultdict(list)
    for c, *row in rows:
        by[c].append(tuple(row))
    assert sorted(map(repr, by)) == sorted(repr(r.conv_id) for r in got)
    for r in got:
        want = report(by[r.conv_id])[0]
        assert as_tuple(r) == (min(want[0], 2**63 - 1), *want[1:]), r.conv_id
    return by


def test_repair_of_odd_conversations(spark):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = repair.repair(turns)
    by = check(rows, got.collect())
    out = defaultdict(list)
    for r in sorted(repair.repaired_turns(turns, got).collect(), key=lambda r: r.position):
        out[r.conv_id].append((r.role, r.text))
    assert {c: tuple(v) for c, v in out.items()} == {c: o for c in by if (o := report(by[c])[1])}
    assert repair.repair(turns.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_a_conversation_over_many_tasks(spark, parts):
    rng = random.Random(parts)
    rows = [(5, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", f"{k}.", ""])) for k in range(300)]
    rows += [(5, 9, "user", "same.")] * 100 + [(6, 1, "user", "x.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        check(rows, repair.repair(turns).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_rows_left_and_damage(spark):
    rows = [(c, t, "user" if t else None, "Hm. Yes!") for c in [None, *range(60)] for t in (None, 1, 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hurt = []
    for c, t, role, text in rows:
        fault = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = "" if fault == 1 else text.replace(".", "").replace("!", "") if fault == 2 else text, "user" if fault == 4 else role
        hurt += [(c, t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    damaged = repair.damage(turns)
    assert sorted(map(repr, hurt)) == sorted(
        repr((r.conv_id, r.turn, r.role, r.text)) for r in damaged.collect() for _ in range(r.copies)
    )
    gone = spark.createDataFrame([(500, 1, "user", "x.", 0)], "conv_id long, turn long, role string, text string, copies int")
    got = repair.repair(damaged.unionByName(gone), copies="copies").collect()
    empty = next(r for r in got if r.conv_id == 500)
    assert as_tuple(empty) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    check(hurt + [(500, None, None, None)] * 0, [r for r in got if r.conv_id != 500])


def test_check_sql_on_odd_rows(spark):
    rows = [r for r in odd_turns() if r[0] != 78]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    result = con.sql(oracles.REPAIR)
    want = sorted(repr(dict(zip(result.columns, r))) for r in result.fetchall())
    got = repair.repair(repair.damage(turns), copies="copies").select(*result.columns).collect()
    assert sorted(repr(r.asDict()) for r in got) == want
