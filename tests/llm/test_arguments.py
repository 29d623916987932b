"""Arguments of tool calls against schemas: the type of a property is that of its own value."""

import json

import pytest

from cadenza.llm import toolcalls

TYPES = {"n": "integer", "s": "string", "o": "object", "f": "number", "b": "boolean", "a": "array", "we'ird": "integer", 'q"x': "string"}


@pytest.mark.parametrize(
    ("arguments", "wanted"),
    [
        ({"o": {"n": "x"}, "n": 5}, ""),
        ({"o": {"s": "x"}, "s": 5}, "type:s"),
        ({"we'ird": 7}, ""),
        ({"we'ird": "7"}, "type:we'ird"),
        ({'q"x': "y"}, ""),
        ({"n": 5.5, "f": 5.5}, "type:n"),
        ({"n": -3, "f": 4, "b": True, "a": [{"n": "x"}], "s": ""}, ""),
        ({"n": "5", "f": "1", "b": "true", "a": "[1]", "o": "{}"}, "type:a,type:b,type:f,type:n,type:o"),
        ({"n": None, "s": None}, "type:n,type:s"),
        ({"n": 123456789012345678901234567890, "f": 1e300}, ""),
        ({"x": 1}, "unknown:x"),
        ({}, ""),
    ],
)
def test_types_are_those_of_the_top_level(spark, arguments, wanted):
    text = json.dumps({"content": "", "tool_calls": [{"id": "c", "name": "f", "arguments": arguments}]})
    messages = spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame([("f", k, v, False) for k, v in TYPES.items()], "name string, property string, type string, required boolean")
    (row,) = toolcalls.linked_calls(messages, schemas).collect()
    assert row["problems"] == wanted
