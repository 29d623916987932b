"""Quality classifier: supervised subword embeddings.

Method: each word, each pair of adjacent words, a word that follows itself (one
shared entry beside its pair's), and each run of three and of four bytes of a word,
its edges included, is hashed to a learned vector; a document is the average of its
vectors, and a softmax layer classifies it.
Vectors and layer are trained together by stochastic gradient descent in numpy.

Plan: the sample (at most ``MOST`` texts per label value, chosen by a hash of the
id) is the only data that meets the driver.  For scoring, the softmax over two
classes needs each vector's product with the difference of the two output rows
only, so the model folds into one table of 2^18 numbers; scoring is one map over
the scan with array operations on each whole text.  No shuffle.

Edge cases: null text counts as empty; an empty text scores by the output bias
alone.  Without labels of both kinds every score is 0.5.  Repeated rows keep
their rows.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.toxicity import fold, labelled_sample

BITS = 18
REPEAT = 0  # the entry of a word that follows itself
DIMENSIONS = 8
MOST = 2500
EPOCHS = 6
RATE = 2.0
THRESHOLD = 0.3
POWERS = np.cumprod(np.full(1 << 12, 0x01000193, np.uint32), dtype=np.uint32)


def buckets(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int32)


def entries(text: str | None) -> list[np.ndarray]:
    """Table entries of a whole text: words, word pairs, repeats, byte runs of three and four within a word and its edges."""
    raw = (text or "").encode("utf-8", "replace")
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if not len(x):
        return []
    out = []
    inside = (x > 32).astype(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        letters = np.flatnonzero(inside)
        lengths = ends - starts
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        words = np.add.reduceat(x[letters] * POWERS[place & 0xFFF], first, dtype=np.uint32)
        again = int((words[1:] == words[:-1]).sum())
        pairs = words[:-1] * np.uint32(0x85EBCA6B) ^ words[1:]
        out += [buckets(words, 1), buckets(pairs, 2), np.full(again, REPEAT, np.int32)]
    space = x <= 32
    x = np.where(space, np.uint32(32), x)  # any white space is an edge
    for n in (3, 4):
        if len(x) >= n:
            h = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ x[k : len(x) - n + 1 + k]
            across = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                across |= space[k : len(x) - n + 1 + k]
            out.append(buckets(h[~across], n))
    return out


@dataclass
class Model:
    table: np.ndarray  # float32, one number per entry
    bias: float

    def score(self, text: str | None) -> float:
        found = entries(text)
        n = sum(map(len, found))
        logit = self.bias + (sum(float(self.table[e].sum(dtype=np.float64)) for e in found) / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model | None:
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (1 << BITS, DIMENSIONS)) / DIMENSIONS
    layer, bias = rng.normal(0, 0.3, (2, DIMENSIONS)), np.zeros(2)
    rows = []
    for text in texts:
        found = entries(text)
        ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    share = np.where(y == 1, (y == 0).mean(), (y == 1).mean()) * 2  # both kinds count the same
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, weight = rows[i]
            eta = rate * (1 - step / steps) * share[i]
            step += 1
            own = vectors[ids]
            hidden = weight @ own
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[y[i]] -= 1
            back = error @ layer
            layer -= eta * np.outer(error, hidden) * 0.1
            bias -= eta * error * 0.01
            scale = min(1.0, 1 / max(1e-9, float(weight @ weight)) / 50)  # short texts have few, heavy entries
            vectors[ids] = own - (eta * 20 * scale) * weight[:, None] * back
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model | None:
    """Train on labelled rows outside the held-out fold (crc32 of the id mod 5 is 0)."""
    usable = fold(F.col("doc_id"), 5) != 0
    return train(*labelled_sample(docs, labels, "quality", usable, {1: most, 0: most}))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.score(t) if model else 0.5 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return rated.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
