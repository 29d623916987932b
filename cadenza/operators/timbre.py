"""Timbre of a track from its frames: warmth, density and the eight scores of texture.

``frames``: track, rms, flatness, bandwidth; ``mfcc``: track, k, v; ``chroma``: track, pc, v; ``contrast``: track, v.
All are one aggregation each, with partial sums; the tables of a track need not have equally many frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of warmth, and what the scores are measured by.
LOW_COEFFICIENTS, MID_COEFFICIENTS, MID_LEAST, MID_BOOST = (1, 3), (4, 7), -5.0, 0.2
BANDWIDTH, CONTRAST, LEVEL, SPREAD, CHROMA = 5000.0, 30.0, 10.0, 10.0, 2.0


def _most(x: Column) -> Column:
    return F.when(x > 1, 1.0).otherwise(x)  # null stays null


def warmth(mfcc: DataFrame) -> DataFrame:
    """track and warmth (0 to 1): a sigmoid of the low coefficients, raised by the middle ones; low values are lifted, 0.5 is unknown."""
    rows = mfcc.groupBy("track").agg(*[F.avg(F.when(F.col("k").between(*b), F.col("v"))).alias(n) for n, b in (("low", LOW_COEFFICIENTS), ("mid", MID_COEFFICIENTS))])
    base = _most(1 / (1 + F.exp(-F.col("low"))) + F.when(F.col("mid") > MID_LEAST, MID_BOOST).otherwise(0.0))
    return rows.select("track", F.coalesce(F.when(base < 0.3, 0.3 + base * 0.4).otherwise(base), F.lit(0.5)).alias("warmth"))


def density(frames: DataFrame) -> DataFrame:
    """track and density (0 to 1): mean of flatness and of five times the level."""
    rows = frames.groupBy("track").agg(F.avg("flatness").alias("f"), F.avg("rms").alias("r"))
    return rows.select("track", F.coalesce(_most((F.col("f") + _most(F.col("r") * 5)) / 2), F.lit(0.0)).alias("density"))


def texture(frames: DataFrame, mfcc: DataFrame, chroma: DataFrame, contrast: DataFrame) -> DataFrame:
    """track and its eight scores; what a track has no frames for is 0, and stability and consistency are then 1."""
    level = frames.groupBy("track").agg(F.avg("flatness").alias("f"), F.avg("bandwidth").alias("b"), F.avg("rms").alias("r"), F.stddev_pop("rms").alias("s"), F.count("rms").alias("n"))
    each = mfcc.groupBy("track", "k").agg(F.count("v").alias("n"), F.sum("v").alias("x"), F.sum(F.col("v") * F.col("v")).alias("xx"), F.stddev_pop("v").alias("s"))
    mean = F.sum("x") / F.sum("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("xx") / F.sum("n") - mean * mean))
    coefficients = each.groupBy("track").agg(spread.alias("ms"), F.avg("s").alias("me"))
    classes = chroma.groupBy("track").agg(F.stddev_pop("v").alias("cs"))
    bands = contrast.groupBy("track").agg(F.avg("v").alias("k"))
    rows = reduce(lambda a, b: a.join(b, "track", "full"), (level, coefficients, classes, bands))
    zero, one = F.lit(0.0), F.lit(1.0)
    return rows.select(
        "track", F.coalesce(1 - F.col("f"), zero).alias("smoothness"), F.coalesce(_most(F.col("b") / BANDWIDTH), zero).alias("richness"),
        F.coalesce(_most(F.col("k") / CONTRAST), zero).alias("clarity"), F.coalesce(_most(F.col("r") * LEVEL), zero).alias("fullness"),
        F.coalesce(_most(F.col("ms") / SPREAD), zero).alias("spectral_complexity"), F.coalesce(_most(F.col("cs") / CHROMA), zero).alias("harmonic_richness"),
        F.coalesce(F.when(F.col("n") > 1, 1 - _most(F.col("s") / (F.col("r") + 1e-8))), one).alias("temporal_stability"), F.coalesce(1 - _most(F.col("me") / SPREAD), one).alias("timbral_consistency"),
    )
