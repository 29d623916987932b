"""Primitives over ordered series: moving averages, windows, matching, islands, n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def over(track: str | list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*([track] if isinstance(track, str) else track)).orderBy(*order)


def moving_average(df: DataFrame, value: str, half: int, track: str | list[str], *order: str) -> DataFrame:
    """Centred mean over ``half`` rows to either side, truncated at the ends."""
    return df.withColumn("smoothed", F.avg(value).over(over(track, *order).rowsBetween(-half, half)))


def hop_windows(df: DataFrame, index: str, size: int, step: int, track: str) -> DataFrame:
    """Each row once per window [start, start + size) that holds it; full windows only."""
    lengths = df.groupBy(track).agg((F.max(index) + 1).alias("_n"))
    last = F.floor((F.col("_n") - size) / step)  # number of the last full window
    low = F.greatest(F.lit(0), F.ceil((F.col(index) - size + 1) / step))
    high = F.least(last, F.floor(F.col(index) / step))
    rows = df.join(lengths, track).filter((last >= 0) & (low <= high))
    return rows.withColumn("window", F.explode(F.sequence(low, high))).withColumn("start", F.col("window") * step).drop("_n")


def nearest(left: DataFrame, right: DataFrame, track: str = "track", at: str = "t") -> DataFrame:
    """Left rows with right_t, the nearest time of ``right`` in the track; of two as near the earlier.

    Both sides meet in one series; one pass in each direction carries the last right
    time seen (a frame that grows from the first row is linear, one that shrinks is not).
    """
    both = left.withColumn("_r", F.lit(None).cast("double")).unionByName(right.select(track, at).withColumn("_r", F.col(at)), allowMissingColumns=True)
    w = Window.partitionBy(track).orderBy(at, F.col("_r").isNull())
    both = both.withColumn("_back", F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(track).orderBy(F.desc(at), F.col("_r").isNull())
    both = both.withColumn("_next", F.last("_r", True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    back, ahead = F.col(at) - F.col("_back"), F.col("_next") - F.col(at)
    right_t = F.when(F.col("_next").isNull() | (back <= ahead), F.col("_back")).otherwise(F.col("_next"))
    return both.filter("_r is null").withColumn("right_t", right_t).drop("_r", "_back", "_next")


def backward(left: DataFrame, right: DataFrame, track: str = "track", at: str = "t") -> DataFrame:
    """Left rows with the bounds [right_t, right_next) of the right interval that holds them."""
    w = Window.partitionBy(track).orderBy(at)
    bounds = right.select(track, F.col(at).alias("_r"), F.lead(at).over(w).alias("_n"), at)
    both = left.withColumn("_r", F.lit(None).cast("double")).withColumn("_n", F.lit(None).cast("double")).unionByName(bounds, allowMissingColumns=True)
    order = Window.partitionBy(track).orderBy(at, F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_r").isNotNull(), F.struct("_r", "_n")), True).over(order)
    both = both.withColumn("_held", held).filter("_r is null")
    return both.withColumn("right_t", F.col("_held._r")).withColumn("right_next", F.col("_held._n")).drop("_r", "_n", "_held")


def islands(df: DataFrame, breaks: Column, track: str, *order: str) -> DataFrame:
    """Number the runs of rows: ``breaks`` says where a new one begins."""
    flagged = df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("_b").over(over(track, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def indexed(df: DataFrame, track: str = "track", *order: str) -> DataFrame:
    """Number the rows of a track from 0."""
    return df.withColumn("idx", F.row_number().over(over(track, *(order or ("t", "event_id")))) - 1)


def thinned(at: np.ndarray, x: np.ndarray, distance: int) -> np.ndarray:
    """Indices of those kept of peaks at rising, distinct places ``at``: the highest first (of equals the earlier), each ``distance`` from all before.

    A kept place rules out the few places around it, so that none is compared with all that are kept.
    """
    low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    free, kept = np.ones(len(at), bool), []
    for i in np.lexsort((at, -x)).tolist():
        if free[i]:
            kept.append(i)
            free[low[i] : high[i]] = False
    return np.array(sorted(kept), np.int64)


def entropy(weights: Column) -> Column:
    """Natural-log entropy of an array of weights that need not add up to one."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    positive = F.filter(weights, lambda x: x > 0)
    return F.aggregate(positive, F.lit(0.0), lambda a, x: a - x / total * F.ln(x / total))


def round6(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]
