"""op2_chat_formatting: arguments are held against the tools that a conversation declares, which shows in its rows."""

import json

import pytest

from cadenza.llm import queries

ADD = {"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "s": {"type": ["string", "null"]}}, "required": ["x", "y"]}}
NOW = {"type": "function", "function": {"name": "now"}}


def linked(spark, folder, system, name, arguments):
    call = json.dumps({"content": "", "tool_calls": [{"id": "a", "name": name, "arguments": arguments}]})
    rows = [(turn, *row) for turn, row in enumerate([*(("system", json.dumps(x) if isinstance(x, dict) else x) for x in system), ("assistant", call), ("tool", json.dumps({"tool_call_id": "a", "content": "r"}))])]
    rows = [(conv, *row) for conv in (1, None) for row in rows] + [(2, 0, "assistant", call), (2, 1, "tool", rows[-1][-1])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    found = queries.op2_chat_formatting(spark, str(folder)).collect()
    assert len(found) == len(rows) and sum(r["n_calls"] for r in found) == 3
    by = {r["conv_id"]: r["n_linked"] for r in found if r["n_calls"]}
    assert by[2] == 1 and by[1] == by[None]  # the second conversation declares no tools
    return by[1]


@pytest.mark.parametrize(
    ("system", "name", "arguments", "wanted"),
    [
        ([{"tools": [ADD, NOW]}], "add", {"x": 1, "y": "any"}, 1),
        ([{"tools": [ADD, NOW]}], "add", json.dumps({"x": 1, "y": 2, "s": None}), 1),
        ([{"tools": [ADD, NOW]}], "add", {"x": "1", "y": 2}, 0),
        ([{"tools": [ADD, NOW]}], "add", {"x": 1}, 0),
        ([{"tools": [ADD, NOW]}], "add", {"x": 1, "y": 2, "z": 3}, 0),
        ([{"tools": [ADD, NOW]}], "now", {}, 1),
        ([{"tools": [ADD, NOW]}], "now", "no JSON", 0),
        ([{"tools": [ADD]}], "now", {}, 0),
        (["Be kind.", {"tools": [NOW]}, {"tools": [ADD, {"name": "now", "parameters": {"required": ["t"]}}]}], "now", {}, 1),
        (["Be kind.", '{"tools":[{"name":"add"}],"tools":[]}'], "now", {}, 1),
    ],
)
def test_arguments_fit_the_tools_declared(spark, tmp_path, system, name, arguments, wanted):
    assert linked(spark, tmp_path, system, name, arguments) == wanted
