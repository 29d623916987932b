"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: bounded-space online best fit.  Each packing group keeps a fixed number
of open bins, found through a bitset keyed by free space; a piece goes to the
open bin whose free space is the smallest that still holds it, and when every
open bin is in use the fullest one closes first.

Plan: tokenising is a map over the scan (no shuffle of text).  Only the piece
rows (about 40 bytes each) are dealt to groups by a hash of document and piece,
so groups are even whatever the sources look like, and each is packed alone.
The number of groups grows with the number of documents.

Edge cases: null text counts as empty, and an empty document is the separator
alone (one token).  Repeated rows are packed as often as they occur.  An empty
table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 4096
GROUP_DOCS = 25_000
SEPARATOR = 0
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rank_file(vocabulary: str) -> str:
    """The ranks that hold the same vocabulary beside a byte-level BPE file."""
    return vocabulary.removesuffix(".json") + ".tiktoken"


@lru_cache(maxsize=4)
def encoder(vocabulary: str, special: bool = True):
    """text -> uint32 ids, equal to what ``tokenizers`` gives for ``vocabulary``.

    The rank file of the same vocabulary is read by tiktoken, about four times
    as fast; a text holding the special token's own string goes to
    ``tokenizers``, which treats that string as one token (unless ``special`` is
    false, when it is ordinary text).
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_file(vocabulary)) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list = []

    def encode(text: str) -> np.ndarray:
        if special and SPECIAL in text:
            if not exact:
                exact.append(Tokenizer.from_file(vocabulary))
            return np.array(exact[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(separator)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(rows, (doc_id, k, start, length, crc), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, open_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length in order of arrival, with bounded open bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = opened = held = 0  # bit f is set while an open bin has f tokens free
    for i, n in enumerate(lengths.tolist()):
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if held == open_bins:
                full = (bits & -bits).bit_length() - 1
                by_free[full].pop()
                if not by_free[full]:
                    bits ^= 1 << full
                held -= 1
            b, free = opened, capacity
            opened, held = opened + 1, held + 1
        bins[i], offsets[i] = b, capacity - free
        free -= n
        if free:
            by_free[free].append(b)
            bits |= 1 << free
        else:
            held -= 1
    return bins, offsets


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        # longest first within the group, so that the short ones fill the gaps
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, open_bins)
        rows = rows.drop_columns(["_group"])
        rows = rows.append_column("sequence_id", pa.array(bins + (group[0].as_py() << 40), pa.int64()))
        return rows.append_column("offset", pa.array(offsets, pa.int64()))

    kept = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return kept.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    ``docs.count()`` sizes the groups; on Parquet it reads footers only.
    """
    groups = max(1, -(-docs.count() // group_docs))
    return pack(tokenised_pieces(docs, vocabulary, capacity), groups, capacity, open_bins)
