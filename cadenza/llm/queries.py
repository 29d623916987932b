"""The corpus queries, one opN_<name> per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontam, extraction, fingerprint, merkle, neardup, packing, quality, secrets, tokencounts, toolcalls, toxicity, variants, warc
from cadenza.llm.sql import SQL
from cadenza.session import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as canonical JSON, with how many calls it makes and how many of them are linked, with arguments that fit."""
    messages = table(spark, sf_dir, "conversations")
    made = toolcalls.links_per_message(messages).withColumnsRenamed({"conv_id": "conv", "turn": "at"})
    rows = toolcalls.formatted(messages).join(made, F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("turn").eqNullSafe(F.col("at")), "left")
    return rows.select("conv_id", "turn", "role", "kind", "json", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_calls", "n_linked")])


def tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call of conversations that call tools, with its level, result and problems.

    The given conversations call none, so each assistant message is read as a call that
    follows the call two turns before (those of turn 5 wait for each other and one more)
    and each later user message as the result of the turn before it.
    """
    given = table(spark, sf_dir, "conversations")
    turn, size = F.col("turn"), F.char_length(F.coalesce("text", F.lit("")))
    call_id = F.concat(F.lit("c"), turn)
    after = F.array(F.concat(F.lit("c"), turn + F.when(turn % 6 == 5, 0).otherwise(-2)))
    arguments = F.struct(F.when(size % 3 > 0, size).alias("chars"), F.when(size % 5 > 0, turn.cast("string")).alias("label"), F.when(size % 7 == 0, F.lit(True)).alias("odd"))
    call = F.to_json(F.struct(F.lit("").alias("content"), F.array(F.struct(call_id.alias("id"), F.when(turn % 4 == 1, "count").otherwise("name").alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls")))
    answer = F.to_json(F.struct(F.concat(F.lit("c"), turn - 1).alias("tool_call_id"), F.concat(F.lit("r"), size).alias("content")))
    role = F.when((F.col("role") == "user") & (turn > 0), "tool").otherwise(F.col("role"))
    messages = given.select("conv_id", "turn", role.alias("role"), F.when(role == "assistant", call).when(role == "tool", answer).otherwise(F.col("text")).alias("text"))
    schemas = spark.sql("select * from values ('count', 'chars', 'integer', true), ('count', 'label', 'string', false), ('name', 'label', 'string', true), ('name', 'chars', 'string', false) as t(name, property, type, required)")
    found = toolcalls.linked_calls(messages, schemas)
    return found.select("conv_id", "call_id", "turn", F.col("level").cast("long").alias("level"), "name", "arguments", "result_turn", "result", "problems", "status")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, radius=2)
    return found.select("doc_id", neardup.unsigned_hex("fp").alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.prints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        tool_call_links,
        op1_best_fit_packing,
        op2_chat_formatting,
        op3_token_counts,
        op4_secret_scans,
        op5_simhash_near_dedup,
        op6_html_extraction,
        op7_benchmark_decontamination,
        op8_quality_classifier,
        op9_document_fingerprints,
        op10_toxicity,
        op11_warc,
        op12_merkle_manifest,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Equivalent DuckDB SQL; tests hold the other queries against brute force."""
    return dict(SQL)
