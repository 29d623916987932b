"""Melody measures over voiced notes (track, t, event_id, midi, f0, voiced)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators.series import indexed


def note_name(midi: Column) -> Column:
    n = F.rint(midi).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in K.NOTES]), F.pmod(n, F.lit(12)) + 1)
    return F.concat(name, (F.floor(n / 12) - 1).cast("string"))


def vocal_class(low: Column, high: Column) -> Column:
    """Voice by lowest and highest note: nearest range centre among those overlapped by more than 0.3."""
    wide = high - low
    centre = (low + high) / 2

    def nearest(names: list[str], default: str) -> Column:
        options = []
        for order, (name, lo, hi) in enumerate(K.VOCAL_RANGES):
            if name in names:
                overlap = F.greatest(F.lit(0.0), F.least(high, F.lit(float(hi))) - F.greatest(low, F.lit(float(lo)))) / wide
                options.append(F.when(overlap > 0.3, F.struct(F.abs(centre - (lo + hi) / 2).alias("d"), F.lit(order).alias("o"), F.lit(name).alias("n"))))
        return F.coalesce(F.array_min(F.array_compact(F.array(*options)))["n"], F.lit(default))

    single = F.when(low < 50, "Tenor").otherwise("Alto")
    male, female = nearest(["Bass", "Baritone", "Tenor"], "Unknown"), nearest(["Alto", "Mezzo-Soprano", "Soprano"], "Alto")
    return (
        F.when(wide < 0.1, single).when(wide > 36, "Instrumental (Wide Range)").when((low < 36) | (high > 96), "Instrumental (Extreme Range)").when(low < 50, male).otherwise(female)
    )


def pitch_range(notes: DataFrame) -> DataFrame:
    found = notes.filter("voiced").groupBy("track").agg(F.min("midi").alias("low"), F.max("midi").alias("high"), F.avg("midi").alias("mean"), F.stddev_pop("midi").alias("sd"))
    width = F.col("high") - F.col("low")
    return found.select("track", "low", "high", width.alias("width"), (width / 12).alias("octaves"), "mean", "sd", note_name(F.col("low")).alias("low_name"), note_name(F.col("high")).alias("high_name"), vocal_class(F.col("low"), F.col("high")).alias("voice"))


def vocal_notes(notes: DataFrame) -> DataFrame:
    """Notes likely to be sung: a fixed range, the modal cluster, outliers trimmed, else the middle 80 percent."""
    voiced = notes.filter("voiced").select("track", "event_id", F.col("midi").alias("x"))
    cand = voiced.filter("x between 48 and 84")
    spread = cand.groupBy("track").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("x") >= 55).alias("n_high"), F.expr("percentile(case when x >= 55 then x end, 0.5)").alias("median_high"), F.expr("percentile(x, array(0.1, 0.9))").alias("p"))
    rows = cand.join(spread, "track")
    flat = F.col("hi") == F.col("lo")
    lo, width = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, 1.0).otherwise(F.col("hi") - F.col("lo")) / 15
    bins = rows.groupBy("track", F.least(F.floor((F.col("x") - lo) / width), F.lit(14)).alias("bin")).agg(F.count("*").alias("votes"))
    mode = bins.groupBy("track").agg(F.max(F.struct("votes", -F.col("bin"))).alias("m")).select("track", (-F.col("m").getField("col2")).alias("bin"))
    rows = rows.join(mode, "track").withColumn("centre", lo + (F.col("bin") + 0.5) * width)
    rows = rows.withColumn("centre", F.when((F.col("centre") < 55) & (F.col("n_high") > 0.2 * F.col("n")), F.col("median_high")).otherwise(F.col("centre")))
    near = rows.withColumn("near", F.abs(F.col("x") - F.col("centre")) <= 18)
    stats = near.filter("near").groupBy("track").agg(F.count("*").alias("m"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    rows = near.join(stats, "track").withColumn("kept", F.col("near") & ((F.col("m") <= 10) | (F.abs(F.col("x") - F.col("mean")) <= 2.5 * F.col("sd"))))
    left = rows.groupBy("track").agg(F.count_if("kept").alias("k"))
    rows = rows.join(left, "track")
    back = (F.col("m") > 10) & (F.col("k") < 0.3 * F.col("n"))
    middle = F.col("x").between(F.get("p", F.lit(0)), F.get("p", F.lit(1)))
    return rows.filter(F.when(back, middle).otherwise(F.col("kept"))).select("track", "event_id", F.col("x").alias("midi"))


def steps(notes: DataFrame) -> DataFrame:
    """Voiced notes in order with d, the step from the one before."""
    rows = indexed(notes.filter("voiced"))
    return rows.withColumn("d", F.col("midi") - F.lag("midi").over(Window.partitionBy("track").orderBy("idx"))).filter("d is not null")


def direction(notes: DataFrame) -> DataFrame:
    rows = steps(notes)
    before = F.lag("d").over(Window.partitionBy("track").orderBy("idx"))
    rows = rows.withColumn("turn", F.coalesce(((before > 0) != (F.col("d") > 0)).cast("int"), F.lit(0)))
    size = F.abs("d")
    found = rows.groupBy("track").agg(
        F.avg((F.col("d") > 0.5).cast("int")).alias("up"), F.avg((F.col("d") < -0.5).cast("int")).alias("down"), F.sum("turn").alias("turns"), F.count("*").alias("n"),
        F.avg(size).alias("mean_step"), F.avg((size <= 2).cast("int")).alias("small"), F.avg(((size > 2) & (size <= 7)).cast("int")).alias("medium"), F.avg((size > 7).cast("int")).alias("large"),
    )
    tendency = F.when(F.col("up") > F.col("down") + 0.1, "ascending").when(F.col("down") > F.col("up") + 0.1, "descending").otherwise("balanced")
    return found.withColumn("tendency", tendency).withColumn("complexity", F.col("turns") / F.col("n"))


def intervals(notes: DataFrame) -> DataFrame:
    """Share of each interval (semitones mod 12) among the steps of a track."""
    rows = steps(notes).withColumn("semitone", (F.rint(F.abs("d")).cast("int") % 12))
    counted = rows.groupBy("track", "semitone").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("track"))
    return counted.select("track", F.element_at(F.array(*[F.lit(x) for x in K.INTERVALS]), F.col("semitone") + 1).alias("interval"), "n", share.alias("share"))


def stability(notes: DataFrame) -> DataFrame:
    """1 / (1 + cv) of the voiced pitch, and its drift: slope over mean in percent, at most 1."""
    rows = indexed(notes.filter("voiced"))
    found = rows.groupBy("track").agg(F.count("*").alias("n"), F.avg("f0").alias("mean"), F.stddev_pop("f0").alias("sd"), F.regr_slope("f0", F.col("idx")).alias("slope"))
    steady = F.try_divide(F.lit(1.0), 1 + F.try_divide("sd", "mean"))
    drift = F.least(F.lit(1.0), F.abs(F.try_divide("slope", "mean")) * 100)
    few = F.col("n") < 10
    return found.select("track", F.when(few, 0.0).otherwise(steady).alias("stability"), F.when(few, 0.0).otherwise(F.coalesce(drift, F.lit(0.0))).alias("drift"))


def tracked_pitch(pitch: DataFrame, low: int = 36, states: int = 61, penalty: float = 0.2, octave: float = 0.5) -> DataFrame:
    """track, frame, midi and f0 of a pitch curve (f0; null or 0 where unvoiced) after octave jumps are taken out.

    Hidden states are the semitones from ``low`` on.  A frame speaks for its own semitone with 1 and, as
    autocorrelation errs by octaves, for those an octave off with ``octave``; the path with the highest sum less
    ``penalty`` per semitone moved is taken.  Unvoiced frames are null, and hold the path in between.
    """
    from cadenza.operators.scan import best_path

    midi = F.rint(69 + 12 * F.log2(F.when(F.col("f0") > 0, F.col("f0")) / 440.0))
    rows = pitch.select("track", F.col("frame").cast("long").alias("frame"), midi.alias("m"))
    off = lambda k: F.abs(F.col("m") - low - k)
    heard = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: F.coalesce(F.when(off(k) == 0, 1.0).when(off(k) == 12, octave), F.lit(0.0)))
    found = best_path(rows.select("track", "frame", heard.alias("v")), penalty).join(rows, ["track", "frame"])
    note = F.when(F.col("m").isNotNull(), F.col("state") + low)
    return found.select("track", "frame", note.cast("long").alias("midi"), (440.0 * F.pow(F.lit(2.0), (note - 69) / 12)).alias("f0"))
