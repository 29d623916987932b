"""op2_chat_formatting: every step of it shows in its rows."""

import json

from cadenza.llm import queries, toolcalls


def test_links_show_in_the_rows(spark, tmp_path):
    def made(*calls):
        return json.dumps({"content": "", "tool_calls": [{"id": i, "name": "f", "arguments": "{}", "after": after} for i, after in calls]})

    def answer(i):
        return json.dumps({"tool_call_id": i, "content": "r"})

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", made(("a", []), ("b", ["a"]), ("c", ["d"]), ("d", ["c"]))), (1, 2, "tool", answer("a")), (1, 3, "tool", answer("c")), (2, 0, "assistant", made(("a", []))), (2, 1, "tool", answer("a"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["conv_id"], r["turn"]): (r["kind"], r["n_calls"], r["n_linked"]) for r in queries.op2_chat_formatting(spark, str(tmp_path)).collect()}
    assert found == {(1, 0): ("text", 0, 0), (1, 1): ("calls", 4, 1), (1, 2): ("result", 0, 0), (1, 3): ("result", 0, 0), (2, 0): ("calls", 1, 1), (2, 1): ("result", 0, 0)}


def test_arguments_are_not_checked_to_no_end(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    checked = []
    monkeypatch.setattr(toolcalls, "invalid_arguments", lambda *given: checked.append(given))
    assert queries.op2_chat_formatting(spark, str(tmp_path)).count() == 1 and not checked
