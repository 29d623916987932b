"""Recurrences over long series, computed in time blocks.

A series has the columns track, frame (dense, from 0) and numbers.  A recurrence cannot be
cut at will, but what a block does to the state that enters it can be summed up without
knowing that state: an affine map for a linear filter, a max-plus matrix for a best
path, a table of exits for a walk back.  ``carried`` therefore runs in three steps: sum up every
block by itself, carry the state over the summaries of a track (one row per block, in order),
and run every block again from the state that enters it.  Only the middle step is sequential
and it never sees the series itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
DIGITS = 9  # sums that agree so far are equal

Summary = list[float]


def in_blocks(series: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with the block that they belong to, and once more for each block whose first or last frames they are near."""
    if before == after == 0:
        return series.withColumn("block", F.floor(F.col("frame") / size).cast("long"))
    low = F.floor((F.col("frame") - after) / size).cast("long")
    high = F.floor((F.col("frame") + before) / size).cast("long")
    return series.withColumn("block", F.explode(F.sequence(low, high)))


def by_block(series: DataFrame, size: int, before: int, after: int, run: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """``run(rows, first, last)`` on each block with the frames around it; first and last bound the block's own frames."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values("frame"), int(key[1]) * size, int(key[1] + 1) * size)

    return in_blocks(series, size, before, after).groupBy("track", "block").applyInPandas(one, schema)


def carried(
    series: DataFrame, summarise: Callable[[pd.DataFrame], Summary], start: Callable[[np.ndarray], Any], step: Callable[[Any, np.ndarray], Any],
    replay: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, size: int = BLOCK, backward: bool = False,
) -> DataFrame:
    """A recurrence in blocks.

    summarise: a block's rows, in order of the walk, to numbers; start: the first block's summary to
    the state that enters it; step: a state and the summary of the block that it enters to the
    state that leaves it; replay: a block's rows and the state that enters it to rows of
    ``schema``.  Backward, rows and blocks come last first.
    """
    blocks = in_blocks(series, size)
    kind = series.schema["track"].dataType.simpleString()

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("frame", ascending=not backward)

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track": [key[0]], "block": [key[1]], "summary": [list(map(float, summarise(ordered(rows))))]})

    def carry(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ascending=not backward)
        states, state = [], None
        for k, found in enumerate(rows["summary"]):
            found = np.asarray(found, float)
            state = start(found) if k == 0 else state
            states.append(np.asarray(state, float).tolist())
            if k + 1 < len(rows):
                state = step(state, found)
        return pd.DataFrame({"track": rows["track"], "block": rows["block"], "state": states})

    def again(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        return replay(ordered(rows), np.asarray(states["state"].iloc[0], float))

    sums = blocks.groupBy("track", "block").applyInPandas(summed, f"track {kind}, block long, summary array<double>")
    states = sums.groupBy("track").applyInPandas(carry, f"track {kind}, block long, state array<double>")
    return blocks.groupBy("track", "block").cogroup(states.groupBy("track", "block")).applyInPandas(again, schema)


# ---- linear recurrences


def highpass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth high-pass; ``cutoff`` as a share of half the sampling rate."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    analog = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    poles = warped / analog  # the low-pass prototype turned over; its zeros at infinity come to 0
    gain = np.real(1 / np.prod(-analog)) * np.real(4.0**order / np.prod(4 - poles))
    return gain * np.real(np.poly(np.ones(order))), np.real(np.poly((4 + poles) / (4 - poles)))


class Linear:
    """A recurrence ``y = b0 x + z[0]``, ``z' = A z + B x``, and what a block of it does."""

    def __init__(self, b: np.ndarray, a: np.ndarray, size: int):
        n = len(a) - 1
        self.a = np.eye(n, k=1)
        self.a[:, 0] -= a[1:]
        self.b = b[1:] - a[1:] * b[0]
        self.steady = np.linalg.solve(np.eye(n) - self.a, self.b)  # the state under a constant 1
        self.powers = np.empty((size + 1, n))  # A ** k B
        self.reach = np.empty((size + 1, n))  # first row of A ** k
        column, row = self.b, np.eye(n)[0]
        for k in range(size + 1):
            self.powers[k], self.reach[k] = column, row
            column, row = self.a @ column, row @ self.a
        self.impulse = np.concatenate([[b[0]], self.powers[:-1, 0]])

    def left(self, x: np.ndarray) -> np.ndarray:
        """The state after a block that was entered with state 0."""
        return x[::-1] @ self.powers[: len(x)]

    def after(self, state: np.ndarray, n: int, left: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n) @ state + left

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.convolve(x, self.impulse[: len(x)])[: len(x)] + self.reach[: len(x)] @ state


def filtered(series: DataFrame, b: np.ndarray, a: np.ndarray, size: int = BLOCK, backward: bool = False) -> DataFrame:
    """track, frame and x after the recurrence, entered with the steady state of its first value.

    The affine map of a block is its length and the state that it leaves when entered with 0.
    """
    rule = Linear(np.asarray(b, float), np.asarray(a, float), size)

    def replay(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"track": rows["track"], "frame": rows["frame"], "x": rule.run(rows["x"].to_numpy(), state)})

    def summarise(rows: pd.DataFrame) -> Summary:
        x = rows["x"].to_numpy()
        return [len(x), x[0], *rule.left(x)]

    kind = series.schema["track"].dataType.simpleString()
    return carried(
        series.select("track", F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x")),
        summarise, lambda s: rule.steady * s[1], lambda state, s: rule.after(np.asarray(state), int(s[0]), s[2:]), replay, f"track {kind}, frame long, x double", size, backward,
    )


def both_ways(series: DataFrame, b: np.ndarray, a: np.ndarray, size: int = BLOCK) -> DataFrame:
    """The recurrence forward and then backward, so that nothing is delayed.

    The ends are continued by their own values turned about them, over three times the
    recurrence's length (less where a track is shorter).
    """
    pad = 3 * max(len(a), len(b))
    ends = series.groupBy("track").agg(F.count("*").alias("_n"), F.min_by("x", "frame").alias("_x0"), F.max_by("x", "frame").alias("_x1"))
    rows = series.select("track", F.col("frame").cast("long").alias("frame"), "x").join(ends, "track").withColumn("_p", F.least(F.lit(pad), F.col("_n") - 1))
    head = rows.filter(F.col("frame").between(1, F.col("_p"))).select("track", (F.col("_p") - F.col("frame")).alias("frame"), (2 * F.col("_x0") - F.col("x")).alias("x"))
    tail = rows.filter(F.col("frame").between(F.col("_n") - 1 - F.col("_p"), F.col("_n") - 2)).select("track", (2 * (F.col("_n") - 1) - F.col("frame") + F.col("_p")).alias("frame"), (2 * F.col("_x1") - F.col("x")).alias("x"))
    long = head.unionByName(rows.select("track", (F.col("frame") + F.col("_p")).alias("frame"), "x")).unionByName(tail)
    out = filtered(filtered(long, b, a, size), b, a, size, backward=True).join(ends.select("track", "_n"), "track")
    at = F.col("frame") - F.least(F.lit(pad), F.col("_n") - 1)
    return out.withColumn("frame", at).filter((F.col("frame") >= 0) & (F.col("frame") < F.col("_n"))).select("track", "frame", "x")


# ---- best paths


def times(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A state through a max-plus matrix (a row per entry)."""
    return (np.asarray(state)[:, None] + matrix).max(axis=0)


def best_path(scores: DataFrame, penalty: float, size: int = BLOCK) -> DataFrame:
    """track, frame, state and total: the path with the highest sum of scores less ``penalty`` per unit that the state moves.

    ``scores``: track, frame, v (an array with a number per state).  Of paths as good, at each frame
    the lower state is kept.  Tracks of one block are many and short: they are walked one after another, without the
    grouping and the summaries that longer ones need.
    """
    kind = scores.schema["track"].dataType.simpleString()
    scores = scores.select("track", F.col("frame").cast("long").alias("frame"), "v")
    ends = scores.groupBy(F.col("track").alias("_track")).agg(F.max("frame").alias("_last"))
    ended = scores.join(ends, F.col("track").eqNullSafe(F.col("_track")))
    short, scores = (ended.filter(keep).select("track", "frame", "v") for keep in (F.col("_last") < size, F.col("_last") >= size))

    def costs(n: int) -> np.ndarray:
        at = np.arange(n)
        return -penalty * np.abs(at[:, None] - at[None, :])

    def summarise(rows: pd.DataFrame) -> Summary:
        v = np.stack(rows["v"].to_numpy())
        n = v.shape[1]
        if len(v) < size:  # the last block: nothing enters another one from it
            return [n]
        move, m = costs(n), None
        for row in v:
            one = move + row[None, :]
            m = one if m is None else (m[:, :, None] + one[None, :, :]).max(axis=1)
        return [n, *m.ravel()]

    def start(s: np.ndarray) -> np.ndarray:
        return np.zeros(int(s[0]))  # any state may come first; the move into it costs nothing from itself

    def step(state: np.ndarray, s: np.ndarray) -> np.ndarray:
        return times(state, s[1:].reshape(int(s[0]), -1))

    def forward(v: np.ndarray, state: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        totals, links = np.empty(v.shape), np.empty(v.shape, np.int64)
        for k, row in enumerate(v):
            ways = state[:, None] + move
            links[k] = np.round(ways, DIGITS).argmax(axis=0)
            state = totals[k] = ways.max(axis=0) + row
        return totals, links

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            totals, links = forward(v, np.zeros(v.shape[1]), costs(v.shape[1]))
            path = np.empty(len(v), np.int64)
            now = int(np.argmax(np.round(totals[-1], DIGITS)))
            for k in range(len(v) - 1, -1, -1):
                path[k], now = now, int(links[k, now])
            columns = [rows["track"].combine_chunks(), rows["frame"].combine_chunks(), pa.array(path), pa.array(totals[np.arange(len(v)), path])]
            return pa.RecordBatch.from_arrays(columns, names=["track", "frame", "state", "total"])

        held, last = [], -1
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.column("frame").to_numpy()
            cuts = np.flatnonzero(np.diff(frame, prepend=last) <= 0)  # a track's frames rise from 0
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frame)], strict=True):
                if b > a and held and (a or (len(cuts) and cuts[0] == 0)):
                    yield solved(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            last = int(frame[-1])
        if held:
            yield solved(held)

    def replay(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy())
        totals, links = forward(v, state, costs(v.shape[1]))
        return pd.DataFrame({"track": rows["track"], "frame": rows["frame"], "totals": totals.tolist(), "links": links.tolist()})

    tables = carried(scores, summarise, start, step, replay, f"track {kind}, frame long, totals array<double>, links array<long>", size)

    # backwards a block is a table: the state that its first frame's link names, for each state of its last frame
    def table(rows: pd.DataFrame) -> Summary:
        now = np.arange(len(rows["links"].iloc[0]))
        for link in rows["links"]:
            now = np.asarray(link)[now]
        return [int(np.argmax(np.round(rows["totals"].iloc[0], DIGITS))), *now]

    def walk(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        now, out, total = int(state[0]), [], []
        for links, totals in zip(rows["links"], rows["totals"], strict=True):
            out.append(now)
            total.append(totals[now])
            now = int(links[now])
        return pd.DataFrame({"track": rows["track"], "frame": rows["frame"], "state": out, "total": total})

    found = carried(tables, table, lambda s: [s[0]], lambda state, s: [s[1 + int(state[0])]], walk, f"track {kind}, frame long, state long, total double", size, backward=True)
    found = found.unionByName(short.repartition("track").sortWithinPartitions("track", "frame").mapInArrow(whole, f"track {kind}, frame long, state long, total double"))
    return found.withColumn("total", F.coalesce("total", F.lit(float("nan"))))  # pandas hands NaN over as null
