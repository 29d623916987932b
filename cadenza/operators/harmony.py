"""Harmony measures over pitch-class frames (track, frame, pc, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators.keys import fixed


def complexity(frames: DataFrame) -> DataFrame:
    """Entropy of the mean vector over its maximum, mean variance of the classes, and both together."""
    means = frames.groupBy("track", "pc").agg(F.avg("v").alias("v"), F.var_pop("v").alias("var"))
    totals = means.withColumn("total", F.sum("v").over(Window.partitionBy("track")))
    p = F.col("v") / (F.col("total") + 1e-8) + 1e-8
    totals = totals.withColumn("p", p)
    scaled = F.col("p") / F.sum("p").over(Window.partitionBy("track"))
    rows = totals.withColumn("q", scaled).groupBy("track").agg((F.sum(-F.col("q") * F.ln("q")) / F.ln(F.lit(12.0))).alias("entropy"), F.avg("var").alias("variance"), F.max("total").alias("total"))
    both = (F.col("entropy") + F.least(F.lit(1.0), F.col("variance"))) / 2
    return rows.select("track", "entropy", "variance", F.when(F.col("total") < 1e-6, 0.0).otherwise(both).alias("complexity"))


def frame_consonance(frames: DataFrame) -> DataFrame:
    """Weighted consonance of the active notes of each frame."""
    stats = frames.groupBy("track", "frame").agg(F.sum("v").alias("energy"), F.max("v").alias("peak"))
    active = frames.join(stats, ["track", "frame"]).filter(F.col("v") > F.col("peak") * 0.2)
    ratings = fixed(frames, list(enumerate(K.CONSONANCE)), "interval int, rating double")
    other = active.select("track", "frame", F.col("pc").alias("pc2"), F.col("v").alias("v2"))  # at most 66 pairs a frame
    pairs = active.join(other, ["track", "frame"]).filter("pc < pc2").withColumn("interval", F.col("pc2") - F.col("pc")).join(ratings, "interval")
    weight = F.sqrt(F.col("v") * F.col("v2"))
    scored = pairs.groupBy("track", "frame").agg((F.sum(F.col("rating") * weight) / F.sum(weight)).alias("score"))
    rows = stats.join(scored, ["track", "frame"], "left")
    return rows.select("track", "frame", F.when(F.col("energy") < 0.1, 0.3).otherwise(F.coalesce("score", F.lit(0.9))).alias("score"))


def consonance(frames: DataFrame) -> DataFrame:
    rows = frame_consonance(frames).groupBy("track").agg(F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.count("*").alias("n"), F.stddev_pop("score").alias("tension"))
    noisy = (F.col("var") > 0.05) | ((F.col("n") > 10) & (F.col("mean") < 0.4))
    level = F.when(noisy, F.least(F.lit(0.4), F.col("mean") * 0.5)).otherwise(F.least(F.lit(1.0), F.col("mean") * 1.1 + 0.1))
    return rows.select("track", level.alias("consonance"), (1 - level).alias("dissonance"), "tension")


def rhythm(frames: DataFrame) -> DataFrame:
    """Rate of large frame-to-frame changes, stability, and regularity of change peaks."""
    before = F.lag("v").over(Window.partitionBy("track", "pc").orderBy("frame"))
    moved = frames.withColumn("d", F.col("v") - before).filter("d is not null").groupBy("track", "frame").agg(F.round(F.sqrt(F.sum(F.col("d") * F.col("d"))), 9).alias("m"))  # rounded, so that equal changes compare equal
    w = Window.partitionBy("track").orderBy("frame")
    stats = moved.groupBy("track").agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var"), F.stddev_pop("m").alias("sd"), F.count("*").alias("n"))
    rows = moved.withColumn("i", F.row_number().over(w)).withColumn("p", F.lag("m").over(w)).withColumn("q", F.lead("m").over(w)).join(stats, "track")
    peaks = rows.filter((F.col("m") > F.col("p")) & (F.col("m") > F.col("q")) & (F.col("m") >= F.col("mean")))
    gaps = peaks.withColumn("gap", F.col("i") - F.lag("i").over(w)).groupBy("track").agg(F.stddev_pop("gap").alias("gsd"), F.avg("gap").alias("gmean"), F.count("*").alias("k"))
    rate = rows.groupBy("track").agg(F.count_if(F.col("m") > F.col("sd")).alias("c"))
    out = stats.join(rate, "track").join(gaps, "track", "left")
    stable = 1 / (1 + F.col("var") * F.when(F.col("mean") > 0.5, 2.0).otherwise(1.0))
    regular = F.when((F.col("n") > 4) & (F.coalesce("k", F.lit(0)) > 2), 1 / (1 + F.col("gsd") / (F.col("gmean") + 1e-8))).otherwise(0.0)
    return out.select("track", (F.col("c") / (F.col("n") + 1)).alias("rate"), stable.alias("stability"), regular.alias("regularity"))
