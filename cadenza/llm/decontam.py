"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Method: test items are cut into windows of ``window`` words (an item of fewer
words is one window) and hashed; the windows of each training text are hashed
the same way and looked up in the broadcast set; each hit is verified word by
word; then documents, or the hit spans, are removed.  DataFrame functions only.

Plan: one pass over the texts.  A row's window hashes are exploded straight into
the broadcast hash join, inside one generated stage, so that only hits and one
marker row per document are shuffled.  The outer explode keeps the optimizer from
adding a size filter, which would compute the hashes twice.  The set is broadcast while it has at most
``broadcast_rows`` windows of ``BROADCAST_BYTES`` in all.  Beyond that only hashes and positions of the
texts' windows are shuffled (adaptive execution splits a hash that very many texts hold), and the texts'
words meet the hits alone, for verification.

Edge cases: null texts and items have no words.  Rows are told apart by document
id and text, so rows that share an id keep their own results, and repeated rows
come back as often as they occur.  Windows that occur in several items count for
each.  A null item id marks words as hit but names no item.  Empty tables give
empty results or no hits.  Extra columns are ignored, except by the removals,
which return the columns of ``docs``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialise

WINDOW = 10
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # over lower-cased text
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def window_hashes(items: Column, n: Column, length: int) -> Column:
    starts = F.sequence(F.lit(1), n - length + 1)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(items, i, length)))
    return F.when(n >= length, hashed).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, win (the words) and h (their hash) of each distinct window."""
    cut = items.select(F.col("item_id"), words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    sized = cut.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("len"))
    each = sized.select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    wins = each.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("win"))
    return wins.distinct().withColumn("h", F.xxhash64("win"))


def hit_words(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, copies, n_words, items (sorted item ids as strings), hits (sorted (pos, len) from 0)."""
    wins = materialise(benchmark_windows(items, window), "benchmark-windows")
    lengths = [r[0] for r in wins.select("len").distinct().orderBy(F.desc("len")).collect()] or [window]  # at most ``window`` values
    n, size = wins.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("win", " ")) + 100), F.lit(0))).first()
    few = n <= broadcast_rows and size <= BROADCAST_BYTES
    text = F.col("text").cast("string")
    cut = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    sized = cut.withColumn("n_words", F.size("w"))
    marker = F.array(F.lit(None).cast("bigint"))
    hashed = sized.withColumn("hs", F.concat(marker, *[window_hashes(F.col("w"), F.col("n_words"), k) for k in lengths]))
    each = hashed.select("doc_id", "text_hash", "n_words", "w", F.posexplode_outer("hs").alias("at", "h"))
    before, total = F.lit(0), F.lit(0)  # how many windows of other lengths stand before those of this length
    for k in lengths:
        before = F.when(F.col("len") == k, total).otherwise(before)
        total = total + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    pos = F.greatest(F.col("at") - 1 - before, F.lit(0))
    if few:
        joined = each.join(F.broadcast(wins), "h", "left").filter((F.col("at") == 0) | F.col("len").isNotNull())
    else:
        placed = each.select("doc_id", "text_hash", "n_words", "at", "h").filter("h is not null").join(wins, "h").drop("h")
        same = F.struct("doc_id", "text_hash")  # null ids are equal within a struct
        words_of = sized.withColumn("_row", same).select("_row", "w").join(placed.select(same.alias("_row")).distinct(), "_row", "left_semi").dropDuplicates(["_row"])
        hit = placed.withColumn("_row", same).join(words_of, "_row").drop("_row")
        joined = sized.select("doc_id", "text_hash", "n_words", F.lit(0).alias("at")).unionByName(hit, allowMissingColumns=True)
    kept = joined.select("doc_id", "text_hash", "n_words", "at", "item_id", "len", pos.alias("pos"), (F.slice("w", pos + 1, F.col("len")) == F.col("win")).alias("same"))
    hits = kept.filter((F.col("at") == 0) | F.col("same"))
    hit = F.when(F.col("len").isNotNull(), F.struct("pos", "len"))
    return hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum((F.col("at") == 0).cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
    )


def covered(hits: Column) -> Column:
    """How many positions sorted (pos, len) intervals cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        new = F.greatest(end - F.greatest(acc["end"], x["pos"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).cast("long").alias("n"))

    return F.aggregate(hits, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hit_words(docs, items, window)
    each = found.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _hit_rows(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    found = hit_words(docs, items, window).filter(F.size("hits") > 0)
    return found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("hits").alias("_hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    bad = _hit_rows(docs, items, window)
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_hash"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with each hit word, and what separates hit words, cut from the text."""
    bad = _hit_rows(docs, items, window)
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_hash"])
    text = docs["text"].cast("string")
    found, gaps = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), 0), F.split(text, WORD_ANY_CASE, -1)

    def inside(i: Column) -> Column:
        return F.exists(bad["_hits"], lambda x: (x["pos"] <= i) & (i < x["pos"] + x["len"]))

    def piece(word: Column, i: Column) -> Column:
        gap = F.when(inside(i) & inside(i + 1), F.lit("")).otherwise(F.get(gaps, i + 1))
        return F.concat(F.when(inside(i), F.lit("")).otherwise(word), gap)

    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(found, piece), ""))
    joined = docs.join(bad, same, "left")
    return joined.select(*[F.when(bad["_hits"].isNotNull(), cut).otherwise(docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])
