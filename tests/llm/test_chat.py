import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamlearn.llm import chat as C

texts = st.text(max_size=60) | st.lists(st.sampled_from([*C.CONTROL, "\\", "\n", "<", "|", "a", "</", "s>"]), max_size=10).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x\ny", "", "\\", "<|im_end|>"]), texts), max_size=6))
@settings(max_examples=400, deadline=None)
def test_round_trip(turns):
    out, spans = C.format_turns(turns)
    assert C.parse_turns(out) == turns
    assert [C.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert out.count(C.START) == out.count(C.END) == len(turns)            # only the template's own marks are left
    assert not any(c in out.replace(C.START, "").replace(C.END, "") for c in C.CONTROL)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, [("system", "s"), ("user", "q")]),
    ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "a", "source": {"deep": 1}}, [("user", "i\n\nx"), ("assistant", "a")]),
    ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"question": "q", "context": "c", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ({"system": None, "prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"mapping": {"messages": [{"author": {"role": "model"}, "content": {"parts": ["a", "b"]}}]}}, [("assistant", "ab")]),
    ({"turns": [{"turn": 2, "role": "gpt", "text": "b"}, {"turn": 1, "role": "user", "text": None}]}, [("user", ""), ("gpt", "b")]),
]


@pytest.mark.parametrize("record,turns", LAYOUTS)
def test_layouts(record, turns):
    m = C.registry()[C.fingerprint(C.field_paths(record))]
    assert C.turns_of(record, m) == turns


QA = [("user", "q"), ("assistant", "a")]
OPTIONAL = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "tools": [{"name": "f", "args": {"x": 1}}]}, QA),
    ({"messages": [{"role": "user", "content": "q", "name": "bo"}, {"role": "assistant", "content": "a"}], "text": "q a"}, QA),
    ({"system": "s", "tools": None, "messages": []}, [("system", "s")]),
    ({"messages": []}, []), ({"conversations": [], "text": ""}, []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}]},
     [("user", "q"), ("assistant", "ab")]),
    ({"instruction": "i", "input": "x", "output": "a", "text": "whole"}, [("user", "i\n\nx"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a", "tools": []}, QA),
]
UNKNOWN = [{"text": "alone"}, {"tools": []}, {}, {"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}]}]},
           {"messages": [{"role": "user", "content": "q", "tool_calls": [{"f": 1}]}]}, {"toolset": 1, "prompt": "q", "response": "a"}]


@pytest.mark.parametrize("record,turns", OPTIONAL)
def test_optional_paths(record, turns):
    m = C.selector()(C.field_paths(record))
    assert C.turns_of(record, m) == turns


def test_optional_paths_choose_no_other_layout(spark):
    select = C.selector()
    assert [select(C.field_paths(r)) for r in UNKNOWN] == [None] * len(UNKNOWN)
    assert all(select(m.paths()) is m for m in C.MAPPINGS)
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(OPTIONAL)]
    got = {r["id"]: r["formatted"] for r in C.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert [C.parse_turns(got[i]) for i in range(len(OPTIONAL))] == [t for _, t in OPTIONAL]


def test_fingerprints_ignore_order_and_counts_but_not_names():
    f = lambda r: C.fingerprint(C.field_paths(r))
    a = {"x": [{"p": 1, "q": 2}], "y": 0}
    assert f(a) == f({"y": "t", "x": [{"q": None}, {"p": 3}]}) != f({"y": 0, "x": [{"p": 1, "r": 2}]})
    assert len(C.registry()) == len(C.MAPPINGS)


def test_records_in_a_table(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(90, json.dumps({"strange": 1})), (91, "no json"), (92, None), (93, "[1]"), (94, "")]
    df = spark.createDataFrame(rows, "id long, record string").selectExpr("*", "1 as layout", "2 as n_turns")
    got = {r["id"]: r for r in C.format_records(df).collect()}
    for i, (_, turns) in enumerate(LAYOUTS):
        assert C.parse_turns(got[i]["formatted"]) == turns
    assert got[90]["formatted"] is None and got[90]["fingerprint"] and all(got[i]["fingerprint"] is None for i in (91, 92, 93, 94))
    counts = {r["layout"]: r["count"] for r in C.layouts(df).groupBy("layout").sum("count").withColumnRenamed("sum(count)", "count").collect()}
    assert counts[None] == 5 and counts["instruction, input and output"] == 2


def test_awkward_turn_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, None, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"),
            (None, 0, "assistant", "</s>"), (3, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as record", "'z' as turns")
    rec = C.turn_rows_as_records(df.select("conv_id", "turn", "role", "text", "record"))
    got = {r["conv_id"]: r for r in C.digests(C.format_records(rec)).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0 and got[2]["n_turns"] == 4 and got[3]["loss_chars"] == 200_000
    assert got[None]["loss_chars"] == 4 and got[None]["formatted_chars"] == len("<|im_start|>assistant\n<|im_end|>\n") + 5
    two = {r["conv_id"]: r["formatted"] for r in C.format_records(rec).collect()}[2]
    assert C.parse_turns(two) == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_records(C.turn_rows_as_records(none))).count() == 0
