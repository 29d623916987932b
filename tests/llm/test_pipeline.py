"""The pipeline as a whole, tool calls with odd keys, and decontamination without a broadcast."""

import random
import re

import pytest

import corpus_pipeline
from cadenza.llm import decontam, toolcalls

from .fixtures import SCHEMA, documents, texts, words
from .test_corpus import ASCII_LOW, reference_ids


def corpus(spark, folder, rows, toxic, benchmark):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), i, "x", "y", "z", "g") for i, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, words(rng, 40) + (" you idiot " if bad else " you there ") + words(rng, 40)))
        labels.append((i, 1, int(bad)))
    item = words(rng, 14)
    clean = words(rng, 120)
    rows += [(500, clean), (501, clean), (502, clean + " more"), (None, clean), (510, f"intro {item} outro"), (520, "say password: hunter22 now"), (530, None), (531, ""), (532, None), (540, clean), (540, clean)]
    corpus(spark, tmp_path, rows, labels, [(1, item), (2, None), (3, "")])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r["length"])
    kept = [i for i in range(240) if i % 3]
    assert set(pieces) == {*kept, 500, 520, 530}  # toxic, copies (that without an id, too) and leaks are gone
    texts_of = dict(rows)
    for i in (*kept, 500, 530):
        assert sum(pieces[i]) == len(reference_ids(texts_of[i])) + 1
    assert sum(pieces[520]) == len(reference_ids("say [SECRET] now")) + 1
    per = {}
    for r in found:
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + r["length"]
    assert max(per.values()) <= 2048


def test_stages_in_order_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    corpus(spark, tmp_path, [], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_without_broadcast_is_the_same(spark):
    rng = random.Random(22)
    items = [words(rng, 30), words(rng, 10), "short one here", None]
    rows = [*texts()[:12], "a " + items[0], "b " + items[1] + " c short ONE here", items[0] + " " + items[0], None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, rows).unionByName(spark.createDataFrame([(None, items[1], *[None] * 8)] * 2, SCHEMA))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"])
    one, two = (sorted(decontam.hit_words(docs, bench, broadcast_rows=n).collect(), key=key) for n in (1000, 0))
    assert one == two and sum(len(r["hits"]) > 0 for r in one) == 4
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert all(r["n_words"] == len(word.findall((rows[r["doc_id"]] or "").translate(ASCII_LOW))) for r in two if r["doc_id"] is not None)


@pytest.mark.parametrize("conv", [1, None])
def test_tool_calls_with_odd_keys(spark, conv):
    def call(*made):
        return '{"content":"","tool_calls":[' + ",".join(made) + "]}"

    chain = [f'{{"id":"k{i}","name":"f","arguments":{{}},"after":["k{i - 1}","k{i - 1}","none"]}}' for i in range(1, 6)]
    rows = [
        (conv, 1, "assistant", call('{"id":"k0","name":"f","arguments":{}}', *chain)),
        (conv, 2, "tool", '{"tool_call_id":"k0","content":"done"}'),
        (conv, 3, "tool", '{"tool_call_id":"k0","content":"again"}'),
        (conv, 4, "assistant", call('{"id":"k0","name":"f","arguments":{"x":2}}', '{"name":"f","arguments":"no json"}', '{"id":"self","name":"f","arguments":{},"after":["self"]}', '{"id":"behind","name":"f","arguments":{},"after":["self"]}')),
        (conv, 5, "assistant", '{"content":"a","content":"b","tool_calls":[]}'),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame([("f", "x", "integer", False)], "name string, property string, type string, required boolean")
    found = {r["call_id"]: r for r in toolcalls.linked_calls(messages, schemas).collect()}
    assert [found[f"k{i}"]["level"] for i in range(6)] == list(range(6))
    assert found["k0"]["status"] == "linked" and found["k0"]["result"] == "done" and found["k0"]["repeated"] and found["k0"]["arguments"] == "{}"
    assert found["self"]["status"] == found["behind"]["status"] == "cycle" and found[None]["problems"] == "not JSON" and len(found) == 9
    json = {r["turn"]: (r["kind"], r["json"]) for r in toolcalls.formatted(messages).collect()}
    assert len(json) == 5 and json[5][0] == "text" and "tool_calls" in json[5][1]
