"""Tempo: histogram votes, harmonic clusters and the choice among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K


def histogram_topk(votes: DataFrame, low: float = 40.0, high: float = 300.0, width: float = 0.5, k: int = 10) -> DataFrame:
    """The k bins with most votes per track, by left edge; ties go to the higher bin, empty bins count as 0."""
    bins = int((high - low) / width)
    # the last bin [high, high + width] also holds its right edge
    bucket = F.least(F.floor((F.col("bpm") - low) / width), F.lit(bins))
    counted = votes.groupBy("track", bucket.alias("bin")).agg(F.count("*").alias("votes"))
    every = votes.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    rows = every.join(counted, ["track", "bin"], "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("votes"), F.desc("bin")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("track", (F.lit(low) + F.col("bin") * width).alias("bpm"), "votes", "rank")


def harmonic(ratio: Column, tolerance: float = 0.05) -> Column:
    tests = [(F.abs(ratio - k) < tolerance) | (F.abs(ratio - 1 / k) < tolerance) for k in K.HARMONIC_RATIOS]
    return reduce(lambda a, b: a | b, tests)


def harmonic_clusters(candidates: DataFrame) -> DataFrame:
    """track, bpm, votes, rank and base: the cluster that each candidate joins, greedily by rank.

    At most k candidates per track: the fold over them is one array expression.
    """
    rows = candidates.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("rank", "bpm", "votes"))).alias("c"))
    start = F.array().cast("array<struct<rank:int,bpm:double,votes:bigint,base:double>>")

    def join(acc: Column, x: Column) -> Column:
        bases = F.array_distinct(F.transform(acc, lambda a: a["base"]))
        fits = F.filter(bases, lambda b: harmonic(x["bpm"] / b))
        base = F.when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(x["bpm"])
        one = F.struct(x["rank"].cast("int").alias("rank"), x["bpm"].alias("bpm"), x["votes"].alias("votes"), base.alias("base"))
        return F.concat(acc, F.array(one))

    return rows.select("track", F.inline(F.aggregate("c", start, join)))


def smart_choice(clusters: DataFrame, share: float = 0.15) -> DataFrame:
    """The strongest cluster above the base one if it has enough votes, else the base's most-voted tempo."""
    w = Window.partitionBy("track")
    sums = clusters.groupBy("track", "base").agg(F.sum("votes").alias("total"), F.min("rank").alias("first"), F.max(F.struct("votes", -F.col("rank"), "bpm")).alias("top"))
    ranked = sums.withColumn("all", F.sum("total").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("total"), "first")))
    base = F.max(F.when(F.col("place") == 1, F.col("base"))).over(w)
    ranked = ranked.withColumn("chosen", base)
    above = F.row_number().over(Window.partitionBy("track", F.col("base") > F.col("chosen")).orderBy(F.desc("total"), "first"))
    ranked = ranked.withColumn("above", F.when(F.col("base") > F.col("chosen"), above))
    out = ranked.groupBy("track").agg(
        F.max(F.when(F.col("above") == 1, F.struct("total", "base"))).alias("high"),
        F.max(F.when(F.col("place") == 1, F.struct("total", F.col("top.bpm").alias("bpm")))).alias("low"),
        F.max("all").alias("all"),
    )
    take = F.coalesce(F.try_divide("high.total", "all") >= share, F.lit(False))
    bpm = F.when(take, F.col("high.base")).otherwise(F.col("low.bpm"))
    votes = F.when(take, F.col("high.total")).otherwise(F.col("low.total"))
    return out.select("track", bpm.alias("bpm"), F.coalesce(F.try_divide(100 * votes, F.col("all")), F.lit(0.0)).alias("confidence"))
