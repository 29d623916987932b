"""Token counts of documents in flat, unindexed token files.

Method: separator scan.  A token file is a run of identifiers with an
end-of-document identifier after each document and no index.  Files are read in
blocks cut without regard to documents; each block is searched for separators
with one vectorised comparison, and a prefix scan over the blocks' small
summaries (how many separators, where the last one is) stitches the documents
that cross blocks.

Plan: blocks are rows, so that a long file is many tasks; only summaries (one
row per block) and counts (one row per document) are shuffled.  A file written here
holds at most ``FILE_DOCS`` documents, which bounds the prefix scan's groups; raw files
of others are read by byte ranges at any length, and the scan of one such file goes
over its blocks' summaries in one task, four bytes a document.

The separator's own string in a text is ordinary text here, as the identifier is the
separator; operator 1 makes it one identifier (``a<|endoftext|>b``: 9 here, 3 there).

Edge cases: null text counts as empty and has no tokens.  Tokens after a file's
last separator are no document.  Repeated rows keep their rows.  Empty tables
give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.packing import default_vocabulary, encoder
from cadenza.llm.warc import opened
from cadenza.session import materialise

SEPARATOR = 50256  # no text gives this identifier
BLOCK_TOKENS = 1 << 16
FILE_DOCS = 20_000
RANGE_BLOCKS = 64  # blocks that a task reads from a raw file in one go
MOST_TASKS = 20_000
DTYPE = "<u2"  # holds every identifier of a vocabulary of 50,257


def token_files(docs: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Flat files of the documents as rows: (file, block, tokens) and, apart, (file, ordinal, doc_id)."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special=False)
        file, ordinal, block = TaskContext.get().partitionId() << 24, 0, 0
        held: list[np.ndarray] = []
        size = 0

        def rows(blocks: list[bytes], first: int, ids: list, ordinals: list) -> pa.RecordBatch:
            n, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (n + m), pa.int64()),
                    pa.array([*range(first, first + n), *[None] * m], pa.int32()),
                    pa.array([*blocks, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *ordinals], pa.int64()),
                    pa.array([*[None] * n, *ids], pa.int64()),
                ],
                names=["file", "block", "tokens", "ordinal", "doc_id"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(np.append(encode(text or ""), SEPARATOR).astype(DTYPE))
                size += len(held[-1])
                full: list[bytes] = []
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    cut = size - size % block_tokens
                    full = [flat[i : i + block_tokens].tobytes() for i in range(0, cut, block_tokens)]
                    held, size = [flat[cut:]], size - cut
                yield rows(full, block, [doc_id], [ordinal])
                block, ordinal = block + len(full), ordinal + 1
                if ordinal == file_docs:  # the next file
                    if size:
                        yield rows([np.concatenate(held).tobytes()], block, [], [])
                    file, ordinal, block, held, size = file + 1, 0, 0, [], 0
        if size:
            yield rows([np.concatenate(held).tobytes()], block, [], [])

    schema = "file long, block int, tokens binary, ordinal long, doc_id long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = DTYPE, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """(file, block, tokens) of raw binary token files of any length.

    Spark lists the files without their content; each range of ``range_blocks`` blocks
    is a row, and the task that has it opens the file and reads that range only.
    """
    width = np.dtype(dtype).itemsize * block_tokens
    span = width * range_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inside = opened(name)
                with store.open_input_file(inside) as f:
                    held = f.read_at(span, first * span)
                cut = [held[i : i + width] for i in range(0, len(held), width)] or [b""]
                blocks = range(first * range_blocks, first * range_blocks + len(cut))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(cut), pa.int64()), pa.array(blocks, pa.int32()), pa.array(cut, pa.binary())], names=["file", "block", "tokens"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    pieces = F.greatest(F.ceil(F.col("length") / span), F.lit(1).cast("long"))
    ranges = files.select(pieces.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    each = files.select("path", F.xxhash64("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("first"))
    spread = each.repartition(min(ranges, MOST_TASKS), "file", "first")  # a stated number, as rows this small would be put into one task
    return spread.mapInArrow(run, "file long, block int, tokens binary")


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """file, ordinal and n_tokens (without the separator) of each document in (file, block, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = [], []
            for tokens in batch.column(2).to_pylist():
                ids = np.frombuffer(tokens, dtype)
                size.append(len(ids))
                at.append(np.flatnonzero(ids == separator).astype(np.int32))
            flat = pa.array(np.concatenate(at) if at else np.zeros(0, np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int32))
            found = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), found], names=["file", "block", "size", "at"])

    found = blocks.select("file", "block", "tokens").mapInArrow(run, "file long, block int, size long, at array<int>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = found.withColumn("start", start)
    last = F.when(F.size("at") > 0, F.col("start") + F.element_at("at", -1))
    placed = placed.withColumn("last", last).withColumn("ordinal", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)))
    placed = placed.withColumn("previous", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1).cast("long")))
    each = placed.select("file", "start", "previous", "ordinal", "at", F.posexplode("at").alias("k", "p"))
    left = F.when(F.col("k") > 0, F.col("start") + F.get("at", F.col("k") - 1)).otherwise(F.col("previous"))
    return each.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), (F.col("start") + F.col("p") - left - 1).alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens per document, by way of flat token files."""
    files = materialise(token_files(docs, vocabulary), "token-files", compression="zstd")
    counts = separator_scan(files.filter("tokens is not null"))
    names = files.filter("tokens is null").select("file", "ordinal", "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
