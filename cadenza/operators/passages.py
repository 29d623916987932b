"""What sections sound like: characteristics from the frames within them, fades and resolutions of endings.

``sections``: track, seq, start, end and further columns; ``frames``: track, t, frame (an order within
equal times) and numbers.  Frames meet their section by time buckets that both sides name, so neither a
long track nor a long section is one task; means are partial sums, and what looks at neighbouring
frames is summed up per bucket first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 16.0  # seconds

# Ranges of the rules for voice, speech and endings.
FADE_DB, FADE_WINDOW, VOICED_ZCR, LEAST_VOICED = -6.0, 10.0, 0.1, 0.15
LAST_SHARE, FINAL_SHARE, DOMINANCE, STRENGTH = 0.85, 0.3, 1.5, 0.5


def within(sections: DataFrame, frames: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Frames with seq, start and end of the section (start <= t < end) that holds them; others go."""
    low, high = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    bounds = sections.filter(F.col("end") > F.col("start")).select("track", "seq", "start", "end", F.explode(F.sequence(low, high)).alias("bucket"))
    rows = frames.withColumn("bucket", F.floor(F.col("t") / bucket))
    return rows.join(bounds, ["track", "bucket"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))


def _graded(x: Column, *steps: tuple[Column, float]) -> Column:
    """The value of the first condition that holds, else 0."""
    return reduce(lambda otherwise, s: F.when(s[0], s[1]).otherwise(otherwise), reversed(steps), F.lit(0.0))


def jump_rates(held: DataFrame, least: float = 2.0) -> DataFrame:
    """track, seq, jump_rate: share of steps between voiced frames of a section (f0 not null) over ``least`` semitones.

    A bucket gives its steps and its first and last pitch; steps between buckets come from these.
    """
    rows = held.filter("f0 > 0").withColumn("st", 12 * F.log2(F.col("f0") / 440.0))
    w = Window.partitionBy("track", "seq", "bucket").orderBy("t", "frame")
    rows = rows.withColumn("step", F.abs(F.col("st") - F.lag("st").over(w)))
    place = F.struct("t", "frame")
    parts = rows.groupBy("track", "seq", "bucket").agg(F.count("step").alias("n"), F.count_if(F.col("step") > least).alias("jumps"), F.min_by("st", place).alias("head"), F.max_by("st", place).alias("tail"))
    by = Window.partitionBy("track", "seq").orderBy("bucket")  # a row per bucket
    parts = parts.withColumn("step", F.abs(F.col("head") - F.lag("tail").over(by)))
    sums = parts.groupBy("track", "seq").agg((F.sum("n") + F.count("step")).alias("n"), (F.sum("jumps") + F.count_if(F.col("step") > least)).alias("jumps"))
    return sums.select("track", "seq", F.coalesce(F.try_divide("jumps", "n"), F.lit(0.0)).alias("jump_rate"))


def characteristics(sections: DataFrame, frames: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """track, seq and the means, shares and flags that describe a section.

    ``frames``: rms, zcr, centroid, rolloff, bandwidth, f0 (null where unvoiced), harmonic (power of the harmonic
    part), onset (whether one falls on the frame).  A section without frames has zeros and no flags.  Energy
    is mean square level; speech is quiet, of middle brightness and busy; voice is harmonic and of middle brightness.
    """
    held = within(sections, frames, bucket)
    means = held.groupBy("track", "seq").agg(
        F.avg(F.col("rms") * F.col("rms")).alias("energy"), *[F.avg(c).alias(c) for c in ("centroid", "rolloff", "zcr", "bandwidth", "harmonic")], F.count_if("onset").alias("onsets")
    )
    rows = sections.select("track", "seq", "start", "end").join(means, ["track", "seq"], "left").join(jump_rates(held), ["track", "seq"], "left")
    names = ("energy", "centroid", "rolloff", "zcr", "bandwidth", "harmonic", "jump_rate")
    some, long = F.col("energy").isNotNull(), F.col("end") - F.col("start")
    e, c, z = (F.col(n) for n in ("energy", "centroid", "zcr"))
    complexity = F.col("bandwidth") / (c + 1e-8)
    harmonic = F.col("harmonic") / (e + 1e-8)
    voiced = (
        _graded(harmonic, (harmonic > 0.3, 0.4), (harmonic > 0.1, 0.2))
        + _graded(c, (c.between(1000, 3000), 0.3), (c.between(500, 5000), 0.1))
        + _graded(z, (z < 0.1, 0.3), (z < 0.2, 0.1))
    )
    found = {
        "complexity": complexity,
        "harmonic_content": harmonic,
        "rhythm_density": F.least(F.lit(1.0), F.coalesce(F.try_divide("onsets", long), F.lit(0.0)) / 10),
        "voiced_ratio": F.least(F.lit(1.0), voiced),
    }
    flags = {"is_spoken": (e < 0.02) & (c > 1000) & (c < 3000) & (z > 0.1) & (complexity < 0.5), "vocal_presence": (harmonic > 0.3) & (c > 1000) & (c < 4000)}
    numbers = [F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names] + [F.when(some, x).otherwise(0.0).alias(k) for k, x in found.items()]
    peak = F.col("start") + long * F.when(F.coalesce(e, F.lit(0.0)) > 0.5, 0.3).otherwise(0.5)
    return rows.select("track", "seq", *numbers, *[F.coalesce(x, F.lit(False)).alias(k) for k, x in flags.items()], peak.alias("first_peak"))


def endings(sections: DataFrame, frames: DataFrame, chroma: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """track, seq, fade, resolves, label and confidence of sections that begin in the last 15 % of their track.

    A fade drops by over 6 dB from the first to the last seconds of a section, or has almost no frames of few zero
    crossings.  A section resolves where one pitch class leads its last 30 % by half.  Fades, and quiet
    sections that resolve, are outros.  Sections under a second do neither.
    """
    total = sections.groupBy("track").agg(F.max("end").alias("_all"))
    late = sections.join(total, "track").filter(F.col("start") >= F.col("_all") * LAST_SHARE).drop("_all")
    long = F.col("end") - F.col("start")
    held = within(late, frames, bucket)
    window = F.least(F.lit(FADE_WINDOW), long / 2)
    power = F.col("rms") * F.col("rms")
    levels = held.groupBy("track", "seq").agg(
        F.avg(F.when(F.col("t") < F.col("start") + window, power)).alias("head"), F.avg(F.when(F.col("t") >= F.col("end") - window, power)).alias("tail"),
        F.avg((F.col("zcr") < VOICED_ZCR).cast("double")).alias("voiced"),
    )
    final = within(late, chroma, bucket).filter(F.col("t") >= F.col("end") - FINAL_SHARE * long)
    notes = final.groupBy("track", "seq", "pc").agg(F.avg("v").alias("v")).groupBy("track", "seq").agg(F.sort_array(F.collect_list("v"), asc=False).alias("v"))  # twelve entries
    leads = (F.get("v", F.lit(0)) / (F.coalesce(F.get("v", F.lit(1)), F.lit(0.0)) + 1e-8) > DOMINANCE) & (F.get("v", F.lit(0)) > STRENGTH)
    drop = F.when((F.col("head") > 0) & (F.col("tail") > 0), 10 * F.log10(F.col("tail") / F.col("head")))
    rows = late.join(levels, ["track", "seq"], "left").join(notes.select("track", "seq", leads.alias("_leads")), ["track", "seq"], "left")
    fade = (long >= 1) & (F.coalesce(drop < FADE_DB, F.lit(False)) | (F.coalesce("voiced", F.lit(0.0)) < LEAST_VOICED))
    rows = rows.withColumn("fade", fade).withColumn("resolves", (long >= 1) & F.coalesce("_leads", F.lit(False)))
    outro = F.col("fade") | (F.col("resolves") & (F.col("energy") < 0.5))
    return rows.select("track", "seq", "fade", "resolves", F.when(outro, "outro").otherwise(F.col("type")).alias("label"), F.when(F.col("fade"), 0.8).when(outro, 0.6).alias("confidence"))
