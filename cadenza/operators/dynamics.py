"""Dynamics of loudness series (track, t, event_id, rms), spectra and effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.series import entropy, indexed, islands, thinned

# The 11-point cubic Savitzky-Golay smoothing weights.
SG_11 = [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]
# Bands in Hz; both edges of low and mid, and the lower edge of high, belong to a band.
BANDS = [("low", 20.0, 250.0), ("mid", 250.0, 4000.0), ("high", 4000.0, 1e9)]


def decibel(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x + 1e-8, F.lit(1e-5)))


def dynamic_range(series: DataFrame) -> DataFrame:
    """Range, variance and spread of the level in dB, crest and peak-to-mean ratios per track."""
    found = series.withColumn("db", decibel(F.col("rms"))).groupBy("track").agg(
        (F.max("db") - F.min("db")).alias("range_db"), F.var_pop("db").alias("variance"), F.stddev_pop("db").alias("spread"),
        F.try_divide(F.max("rms"), F.avg("rms")).alias("peak_to_mean"), F.try_divide(F.max("rms"), F.sqrt(F.avg(F.col("rms") * F.col("rms")))).alias("crest"),
        (F.avg("db") + 60).alias("mean_loudness"), (F.max("db") + 60).alias("peak_loudness"),
    )
    return found


def energy_profile(series: DataFrame, width: int = 10) -> DataFrame:
    """Means of tumbling windows over the highest of them, three-tap sums over three, and their gradient."""
    rows = indexed(series).groupBy("track", F.floor(F.col("idx") / width).alias("w")).agg(F.avg("rms").alias("e"), F.count("*").alias("n"))
    rows = rows.filter(F.col("n") == width)
    by = Window.partitionBy("track").orderBy("w")
    rows = rows.withColumn("e", F.try_divide("e", F.max("e").over(Window.partitionBy("track"))))
    rows = rows.withColumn("s", F.sum("e").over(by.rowsBetween(-1, 1)) / 3)
    before, after = F.lag("s").over(by), F.lead("s").over(by)
    slope = F.when(before.isNull(), after - F.col("s")).when(after.isNull(), F.col("s") - before).otherwise((after - before) / 2)
    return rows.select("track", "w", "e", "s", F.coalesce(slope, F.lit(0.0)).alias("gradient"))


def band_distribution(spectrum: DataFrame) -> DataFrame:
    """Share of power per band and the entropy of the shares over its maximum."""
    sums = [F.sum(F.when((F.col("freq") >= lo) & (F.col("freq") <= hi), F.col("power")).otherwise(0.0)).alias(n) for n, lo, hi in BANDS]
    rows = spectrum.groupBy("track").agg(*sums)
    total = reduce(lambda a, b: a + b, [F.col(n) for n, _, _ in BANDS])
    shares = F.array(*[F.coalesce(F.try_divide(n, total), F.lit(0.0)) for n, _, _ in BANDS])
    return rows.select("track", *[F.get(shares, F.lit(i)).alias(n) for i, (n, _, _) in enumerate(BANDS)], (F.when(total > 0, entropy(shares)).otherwise(0.0) / F.ln(F.lit(3.0))).alias("balance"))


def smoothed(series: DataFrame) -> DataFrame:
    """Interior rows of a track with idx and the Savitzky-Golay mean of 11 rows."""
    w = Window.partitionBy("track").orderBy("t", "event_id")
    parts = [F.lag("rms", 5 - i).over(w) * c if i < 5 else F.lead("rms", i - 5).over(w) * c for i, c in enumerate(SG_11)]
    return indexed(series).withColumn("s", reduce(lambda a, b: a + b, parts) / 429).filter("s is not null").select("track", "idx", "s")


def sudden_changes(series: DataFrame, factor: float = 2.0) -> DataFrame:
    """Steps of the smoothed level beyond ``factor`` standard deviations of the track's steps."""
    rows = smoothed(series)
    rows = rows.withColumn("d", F.lead("s").over(Window.partitionBy("track").orderBy("idx")) - F.col("s")).filter("d is not null")
    spread = rows.groupBy("track").agg(F.stddev_pop("d").alias("sd"))
    rows = rows.join(spread, "track")
    kind = F.when(F.col("d") > factor * F.col("sd"), "increase").when(F.col("d") < -factor * F.col("sd"), "decrease")
    return rows.select("track", "idx", kind.alias("kind"), (F.abs("d") / (F.col("sd") + 1e-8)).alias("magnitude")).filter("kind is not null")


def sustained_runs(series: DataFrame, gap: int = 5, least: int = 10) -> DataFrame:
    """Runs of at least ``least`` rows above mean + sd (peak) or below mean - sd (quiet), with gaps up to ``gap``."""
    rows = smoothed(series)
    levels = rows.groupBy("track").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"))
    kind = F.when(F.col("s") > F.col("mean") + F.col("sd"), "peak").when(F.col("s") < F.col("mean") - F.col("sd"), "quiet")
    marked = rows.join(levels, "track").withColumn("kind", kind).filter("kind is not null").withColumn("key", F.concat_ws("|", "track", "kind"))
    w = Window.partitionBy("key").orderBy("idx")
    runs = islands(marked, (F.col("idx") - F.lag("idx").over(w)) > gap, "key", "idx")
    found = runs.groupBy("track", "kind", "island").agg(F.min("idx").alias("start"), F.count("*").alias("n"), F.avg("s").alias("magnitude"))
    return found.filter(F.col("n") >= least).drop("island")


def effects(series: DataFrame) -> DataFrame:
    """Chorus, compression and density scores from the level's mean and spread."""
    rows = series.groupBy("track").agg(F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("sd"))
    cv = F.coalesce(F.try_divide("sd", "mean"), F.lit(0.0))
    return rows.select("track", F.least(F.lit(1.0), cv * 5).alias("chorus"), (1 - F.least(F.lit(1.0), cv * 2)).alias("compression"), F.least(F.lit(1.0), F.col("mean") / 500 * 5).alias("density"))


def roughness(series: DataFrame, value: str = "x") -> DataFrame:
    """Capped moment scores of a contrast series, weighted."""
    stats = series.groupBy("track").agg(
        F.var_pop(value).alias("var"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"), F.avg(value).alias("mean"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    )
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0)
    shrink = F.try_divide("sd", F.col("sd") + 1e-8)  # deviations are divided by sd + 1e-8
    skew, kurt = F.abs(F.col("skew")) * shrink**3, (F.col("kurt") + 3) * shrink**4

    def cap(x: Column) -> Column:
        return F.least(F.lit(0.6), x)

    raw = cap(F.col("var") / 2) * 0.25 + cap(F.col("sd") / 3.5) * 0.2 + cap(F.col("range") / 12) * 0.15 + cap(cv / 1.8) * 0.15 + cap(skew / 3) * 0.15 + cap((kurt - 3) / 10) * 0.1
    return stats.select("track", F.least(F.lit(0.85), F.coalesce(raw * F.when(F.col("var") > 5, 1.3).otherwise(1.0), F.lit(0.0))).alias("roughness"))


def instrument_bands(spectrum: DataFrame, most: int = 5, least: float = 0.15) -> DataFrame:
    """Instruments by mean power in their band over the mean power; similar instruments exclude each other."""
    from cadenza.functions import constants as K
    from cadenza.operators.keys import fixed

    groups = {"guitar": "guitars", "electric_guitar": "guitars", "violin": "bowed", "strings": "bowed", "cello": "bowed"}
    table = fixed(spectrum, [(i, n, lo, hi, groups.get(n, n)) for i, (n, lo, hi) in enumerate(K.INSTRUMENTS)], "ord int, instrument string, lo double, hi double, family string")
    totals = spectrum.groupBy("track").agg(F.avg("power").alias("mean"))
    # Spark aggregates (frequency band by track) before anything is shuffled
    bands = spectrum.join(table, (F.col("freq") >= F.col("lo")) & (F.col("freq") <= F.col("hi"))).groupBy("track", "ord", "instrument", "family").agg(F.avg("power").alias("band"))
    scored = bands.join(totals, "track").withColumn("confidence", F.least(F.lit(1.0), F.try_divide("band", "mean") * 0.9)).filter(F.col("confidence") > least)
    first = F.row_number().over(Window.partitionBy("track", "family").orderBy("ord"))
    kept = scored.withColumn("first", first).filter("first = 1")
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc(F.round("confidence", 9)), "ord"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= most).select("track", "rank", "instrument", "confidence")


def tension_curve(series: DataFrame) -> DataFrame:
    """Smoothed level over the track's highest, cut to 0..1, with its strict peaks and valleys."""
    rows = smoothed(series)
    top = F.max("s").over(Window.partitionBy("track"))
    w = Window.partitionBy("track").orderBy("idx")
    rows = rows.withColumn("tension", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("s", top))), 9))
    before, after = F.lag("tension").over(w), F.lead("tension").over(w)
    kind = F.when((F.col("tension") > before) & (F.col("tension") > after), "peak").when((F.col("tension") < before) & (F.col("tension") < after), "valley")
    return rows.select("track", "idx", "tension", kind.alias("kind"))


def climax(series: DataFrame, distance: int = 5) -> DataFrame:
    """Peaks of the smoothed level above mean + sd, of close ones the highest, and which is the main one."""
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        s, idx = rows["s"].to_numpy(), rows["idx"].to_numpy()
        high = s.mean() + s.std()
        peaks = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] > s[2:]) & (s[1:-1] > high)) + 1
        kept = thinned(idx[peaks], s[peaks], distance)
        kept = peaks[kept]
        best = kept[s[kept].argmax()] if len(kept) else -1
        return pd.DataFrame({"track": rows["track"].iloc[0], "idx": idx[kept].astype(np.int64), "intensity": s[kept] / s.max(), "main": kept == best})

    kind = dict(series.dtypes)["track"]
    return smoothed(series).groupBy("track").applyInPandas(pick, f"track {kind}, idx long, intensity double, main boolean")


def texture(series: DataFrame) -> DataFrame:
    """Fullness, evenness and activity of a level series."""
    rows = series.groupBy("track").agg(F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("sd"), F.max("rms").alias("top"))
    scaled = F.try_divide("mean", "top")
    return rows.select("track", F.least(F.lit(1.0), scaled * 10).alias("fullness"), (1 - scaled).alias("smoothness"), F.least(F.lit(1.0), F.try_divide("sd", "mean")).alias("activity"))


# Frequency limits of the loudness weights, and steps and factors of brightness.
LOUDNESS_LOW, LOUDNESS_HIGH, LOUDNESS_SCALE = 1000.0, 8000.0, 5.0
BRIGHT_FROM, BRIGHT_FACTOR, PLAIN_FACTOR, HIGHS_FROM, HIGHS_LEAST = 0.15, 2.5, 1.5, 0.1, 0.4


def perceived_loudness(spectrum: DataFrame, peaks: DataFrame | None = None) -> DataFrame:
    """Share of the power that is left after weighting by frequency, times five and by the square of
    the track's ``peaks`` (track, peak) where given; from 0.01 to 1, and 0.01 without power."""
    low = F.pow(F.col("freq") / LOUDNESS_LOW, 2)
    weight = F.when(F.col("freq") < LOUDNESS_LOW, low).when(F.col("freq") > LOUDNESS_HIGH, 0.5).otherwise(1.0)
    rows = spectrum.groupBy("track").agg(F.sum(F.col("power") * weight).alias("heard"), F.sum("power").alias("power"))
    square = F.lit(1.0)
    if peaks is not None:
        rows = rows.join(peaks, "track", "left")
        square = F.when(F.col("peak") > 0, F.col("peak") * F.col("peak")).otherwise(1.0)
    share = F.when(F.col("power") > 0, F.col("heard") * square / F.col("power") * LOUDNESS_SCALE).otherwise(0.0)
    return rows.select("track", F.greatest(F.lit(0.01), F.least(F.lit(1.0), share)).alias("perceived"))


def brightness(centroids: DataFrame, nyquist: float) -> DataFrame:
    """Mean spectral centroid ``x`` of a track over the highest frequency, raised in steps; 0.5 without any."""
    rows = centroids.groupBy("track").agg((F.avg("x") / nyquist).alias("share"))
    raised = F.least(F.lit(1.0), F.col("share") * F.when(F.col("share") > BRIGHT_FROM, BRIGHT_FACTOR).otherwise(PLAIN_FACTOR))
    least = F.when(F.col("share") > HIGHS_FROM, F.greatest(F.lit(HIGHS_LEAST), raised)).otherwise(raised)
    return rows.select("track", F.when(F.col("share").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), least)).alias("brightness"))
