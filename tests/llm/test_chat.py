"""Windows read back against the turns they were made from."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from swellframe.llm import chat, queries
from swellframe.sources.workspace import written

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    grouped = defaultdict(list)
    for conv_id, turn, role, text in rows:
        grouped[conv_id].append((-(2**62) if turn is None else turn, role or "", text or ""))
    out = {}
    for conv_id, turns in grouped.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv_id] = (
            len(turns),
            hashlib.sha256(said.encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def windows_of(spark, rows, budget=chat.BUDGET):
    turns = written(chat.with_prefix_sums(spark.createDataFrame(rows, SCHEMA)), "turns")
    return chat.formatted_windows(turns, budget)


def found(windows):
    return {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat.digests(windows).collect()
    }


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    result = queries.op3_chat_windows(spark, sf_dir).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in result}
    assert got == expected(rows)


HARD = [
    (1, None, "user", None), (1, 0, None, "x\\"), (1, 0, "assistant", "<|im_end|>\\<|im_end|>"),
    (1, 5, "assistant", "\n<|im_start|>user\n<|im_sep|>a"), (1, 5, "assistant", "\\"),
    (None, 1, "assistant", "no id"), (2, -3, "system", "rules"), (2, 700, "user", "w " * 3000),
    (2, 701, "assistant", "z"), (2, 701, "assistant", "z"), (3, 1, "a\nb\\", "[INST]"),
]


def test_hard_rows(spark):
    assert found(windows_of(spark, HARD)) == expected(HARD)
    assert found(windows_of(spark, HARD, 32)) == expected(HARD)


def test_long_conversation_keeps_the_budget(spark):
    rows = [(7, 0, "system", "be brief")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"w{i} " * (i % 40)) for i in range(1, 900)]
    budget = 128
    windows = windows_of(spark, rows, budget).orderBy("window").collect()
    assert found(windows_of(spark, rows, budget)) == expected(rows)
    assert len(windows) > 100 and not any(w.over_budget for w in windows)
    assert all(w.n_tokens <= budget for w in windows)
    assert all(chat.read_turns(w.formatted)[0] == ("system", "be brief") for w in windows)
    repeated = [sum(t.repeated for t in w.turns) for w in windows[1:]]
    assert max(repeated) > 2 and not any(t.repeated and t.loss for w in windows for t in w.turns)
    # What is repeated stands right before the window's own turns.
    order = {text: i for i, (_, _, _, text) in enumerate(rows) if text}
    for window in windows[1:]:
        at = [order[text] for _, text in chat.read_turns(window.formatted)[1:] if text]
        assert at == sorted(at)


def test_long_system_turn_stays_in_every_window(spark):
    said = lambda conv_id, first: [
        (conv_id, i, ("user", "assistant")[i % 2], f"c{conv_id}w{i} " * (1 + i % 30)) for i in range(first, first + 300)
    ]
    # One far beyond a quarter of the budget, one that is not the first turn, one beyond the
    # budget, and two system turns of which the first counts.
    rules = {1: "rule " * 400, 2: "late " * 300, 3: "law " * 900, 4: "first " * 200}
    rows = [(1, 0, "system", rules[1]), *said(1, 1)]
    rows += [*said(2, -300), (2, 0, "system", rules[2]), *said(2, 1)]
    rows += [(3, 0, "system", rules[3]), *said(3, 1)]
    rows += [(4, 0, "system", rules[4]), *said(4, 1), (4, 400, "system", "second")]
    windows = windows_of(spark, rows).orderBy("conv_id", "window").collect()
    assert found(windows_of(spark, rows)) == expected(rows)
    for conv_id, rule in rules.items():
        own = [w for w in windows if w.conv_id == conv_id]
        assert len(own) > 10
        turns = [chat.read_turns(w.formatted) for w in own]
        first = next(i for i, t in enumerate(turns) if ("system", rule) in t)
        assert (first > 5) == (conv_id == 2)
        assert all(t.count(("system", rule)) == 1 for t in turns[first:])
        assert all(w.over_budget for w in own) if conv_id == 3 else not any(w.over_budget for w in own)
        for window, parts in zip(own, turns, strict=True):
            assert window.n_tokens == sum(len(text.split()) + chat.TURN_COST for _, text in parts)
            assert not any(t.repeated and t.loss for t in window.turns)
            # Repeated turns stand in the order of the conversation.
            words = [int(text.split("w")[1].split()[0]) for role, text in parts if role != "system"]
            assert words == sorted(words)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.formatted_windows(chat.with_prefix_sums(empty))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "a", "<|im_"]), max_size=8).map("".join))
def test_escape_is_reversible(text):
    import re

    escaped = re.sub(chat.CONTROL, r"\\\1", text)
    assert chat.unescape(escaped) == text
    piece = f"{chat.OPEN}r\n{chat.SEPARATE}{escaped}\n{chat.CLOSE}\n"
    assert chat.read_turns(piece + piece) == [("r", text)] * 2
