"""Repairs against the least (cost, edits) of every state, turn by turn."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellframe.llm import queries, repair

SF_DIR = "/root/testdata/sf0.001"
SHAPE = re.compile("(s?(ua)+)?")


def brute_conversation(rows):
    """``rows``: (turn, role, text) in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # Best edits by the roles given so far, as a state of the shape.
    after = {"": "", "s": "s", "u": "u", "a": "a"}
    leads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def insertions(table):
        table = dict(table)
        for _ in range(2):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in leads:
                        better(table, leads[state, role[0]], (cost + 3, audit + "I", (*lines, f"{role}:")))
        return table

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in insertions(best).items():
            better(new, after[state], (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if (state, role[:1]) in leads:
                better(new, leads[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if (state, other[0]) in leads:
                    better(new, leads[state, other[0]], (cost + more + 3, audit + "R", (*lines, f"{other}:{text}")))
        best = new
    cost, audit, lines = min(value for state, value in insertions(best).items() if state in ("", "a"))
    assert SHAPE.fullmatch("".join(line[:1] for line in lines))
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(conversations, rows):
    return sorted(
        ((str(c), *brute_conversation([r[1:] for r in rows if r[0] == c])) for c in {r[0] for r in conversations}),
    )


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else x
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def found(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_conversation_repair(spark, SF_DIR)) == brute(rows, damage(rows))


def hard_rows():
    rng = random.Random(5)
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Unknown", "sage"])
    text = lambda: rng.choice(["Yes.", "No", "why?", "", " \n", None, "same.", f"t{rng.random()}.", "a.\x1f", "é!\t"])
    rows = [(c, rng.choice([None, *range(30)]), role(), text()) for c in range(60) for _ in range(rng.randrange(9))]
    # A long one, with long runs; ties, repeated rows, a conversation without id or turns.
    rows += [(100, i, "user" if i % 60 < 50 else "assistant", f"t{i}" + "." * (i % 7 > 1)) for i in range(400)]
    rows += [(101, 3, "user", "hi.")] * 40 + [(102, None, role(), text()) for _ in range(20)]
    rows += [(None, i, role(), text()) for i in range(12)] + [(103, 0, "user", "x. " * 50_000)]
    return rows


@pytest.mark.parametrize(("block", "fan"), [(11, 9), (2, 1)])
def test_hard_rows(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK_BITS", block)
    monkeypatch.setattr(repair, "FAN_BITS", fan)
    rows = hard_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    more = df.select(*[F.lit(i).alias(name) for i, name in enumerate(["key", "place", "word", "_copy", "number"])], "*")
    assert found(repair.repair_report(more, more)) == brute(rows, rows)
    damaged = damage(rows)
    assert found(repair.repair_report(df, repair.damaged(df))) == brute(rows, damaged)


def test_powers_equal_single_turns():
    rng = random.Random(1)
    for _ in range(50):
        word = "".join(rng.choice(list(repair.SYMBOLS.values())) * rng.choice([1, 1, 2, 9, 300]) for _ in range(4))
        single = np.full((4, 4), repair.FAR)
        np.fill_diagonal(single, 0)
        for symbol in word:
            single = np.minimum(repair.times(single, repair.transition(symbol.translate(repair._ALIKE))), repair.FAR)
        assert (repair.word_transition(word) == single).all()


def test_repaired_turns(spark):
    """The edits applied to the turns give the repaired ones."""
    rows = [(1, 0, "system", "be kind."), (1, 1, "assistant", "hello."), (1, 2, "assistant", "hello."), (1, 3, "user", "ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = repair.written(repair.ordered_turns(df), "test-turns")
    found, edits, after = repair.repaired(turns)
    assert [(r.cost, r.audit) for r in found.collect()] == [(11, "KIKDD")]
    assert [r.edit for r in edits.orderBy("place").collect()] == list("KKDD")
    lines = [(r.role, r.text) for r in after.orderBy("place", "nth").collect()]
    assert lines == [("system", "be kind."), ("user", ""), ("assistant", "hello.")]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found(repair.repair_report(df, repair.damaged(df))) == []
