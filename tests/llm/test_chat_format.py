"""Chat formatting: exact round trips, the order of roles, and digests against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm.chat_format import BROKEN, INSTRUCTIONS, Format, Template, Turn, format_turns, read_back

STYLE = Format(INSTRUCTIONS)
SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = st.lists(st.sampled_from([*INSTRUCTIONS.marks, "\\", "<", "[", "/", "s>", "INST]", " ", "é", "x", "\n"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), PARTS), PARTS), max_size=6))
@settings(max_examples=400, deadline=None)
def test_round_trip(turns):
    written = [STYLE.segments(role, text) for role, text in turns]
    whole = "".join(t for parts in written for t, _ in parts)
    assert list(STYLE.read(whole)) == turns
    learned = "".join(t for parts in written for t, flag in parts if flag)
    assert STYLE.unescape(learned) == "".join(text for role, text in turns if role == "assistant")


@given(PARTS)
def test_escaped_texts_have_no_marks(text):
    escaped = STYLE.escape(text)
    assert not any(mark in escaped for mark in INSTRUCTIONS.marks) and STYLE.unescape(escaped) == text


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], hashlib.sha256(t[3].encode()).hexdigest()))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        state, broken = INSTRUCTIONS.start, None
        for i, t in enumerate(turns):
            state = INSTRUCTIONS.step(state, t[2])
            broken = i if state == BROKEN and broken is None else broken
        formatted = sum(len(s) for t in turns for s, _ in STYLE.segments(t[2], t[3]))
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest(), formatted, state == "answered", broken)
    return out


def rows_of(n):
    marks = INSTRUCTIONS.marks
    out = [(c, t, ["user", "assistant"][t % 2], f"{marks[(c + t) % len(marks)]} text \\ {c} {t} é") for c in range(n) for t in range(c % 5 + 1)]
    # One conversation has most of the rows, another one very long turns, and ties, nulls and odd roles occur.
    out += [(7, t, ["user", "assistant"][t % 2], "again") for t in range(100, 400)]
    out += [(3, 50 + t, "assistant", "long " * 9000 + str(t)) for t in range(3)]
    out += [(n, 0, "user", "tie"), (n, 0, "user", "tie"), (n, 0, "user", None), (n, None, "[ROLE]", "</s>"), (n, 1, None, "")]
    return out + [(None, 0, "user", "no id"), (None, 1, "assistant", "</s>[INST] ok [/INST]")]


@pytest.mark.parametrize("together", [40, 1 << 20])
def test_digests_are_those_of_plain_python(spark, together):
    rows = rows_of(40)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        table = spark.createDataFrame(rows[::-1], SCHEMA).repartition(6)
        got = read_back(format_turns(table), together=together).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(brute(rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_segments_have_flags(spark):
    table = spark.createDataFrame([(1, 0, "user", "a[INST]"), (1, 1, "assistant", "b")], SCHEMA)
    got = [[tuple(s) for s in r.segments] for r in format_turns(table).collect()]
    assert got == [[("[INST]", False), ("a[\\INST]", False), ("[/INST]", False)], [("<s>", False), ("b", True), ("</s>", False)]]


def test_order_of_roles(spark):
    orders = {0: "sua", 1: "uaua", 2: "u", 3: "au", 4: "uua", 5: "uas", 6: "ut"}
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    table = spark.createDataFrame([(c, t, names[x], "") for c, order in orders.items() for t, x in enumerate(order)], SCHEMA)
    got = {r.conv_id: (r.valid, r.first_broken) for r in read_back(format_turns(table)).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, None), 3: (False, 0), 4: (False, 1), 5: (False, 2), 6: (False, 1)}


def test_empty_table_clashing_columns_and_other_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert read_back(format_turns(empty)).count() == 0
    table = spark.createDataFrame([("x", 0, "user", "hi", "no"), ("y", 0, "user", "hi", "no")], "conv string, turn long, role string, text string, part string")
    clash = table.selectExpr("*", "'?' as id", "'?' as digest", "'?' as row", "'?' as segments", "'?' as n_turns")
    got = read_back(format_turns(clash, id_column="conv"), id_column="conv").collect()
    assert sorted((r.conv, r.n_turns) for r in got) == [("x", 1), ("y", 1)]


@pytest.mark.parametrize("turns,other", [
    ({"user": Turn("aXa", "b")}, ("r", "s", "t")), ({"user": Turn("", "b")}, ("r", "s", "t")), ({"user": Turn("\\a", "b")}, ("r", "s", "t")),
    ({"user": Turn("a", "b"), "bot": Turn("ac", "d")}, ("r", "s", "t"))])
def test_templates_that_cannot_be_read_back_are_refused(turns, other):
    with pytest.raises(ValueError):
        Template(turns, other, "new", {"new": {"user": "new"}}, frozenset({"new"}))
