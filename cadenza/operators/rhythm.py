"""Rhythm measures over onset and beat series (track, event_id, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators.keys import fixed
from cadenza.operators.series import backward, nearest


def ordered(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("track").orderBy("t", "event_id")
    return rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("next_t", F.lead("t").over(w))


def matched(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    """Onsets with the nearest beat: its time, its place and the next beat's time."""
    near = nearest(onsets, beats.select("track", "t"))
    places = ordered(beats).select("track", F.col("t").alias("right_t"), F.col("idx").alias("beat"), "next_t")
    return near.filter("right_t is not null").join(places, ["track", "right_t"])


def counts(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    both = onsets.select("track", "t", F.lit(1).alias("o")).unionByName(beats.select("track", "t", F.lit(0).alias("o")))
    beat = F.when(F.col("o") == 0, F.col("t"))
    return both.groupBy("track").agg(F.sum("o").alias("n_onsets"), F.sum(1 - F.col("o")).alias("n_beats"), F.min(beat).alias("first_beat"), F.max(beat).alias("last_beat"))


def complexity(onsets: DataFrame, beats: DataFrame, bins: int = 8) -> DataFrame:
    """Mean of onset density and of the entropy of onset positions within beats."""
    position = F.when(F.col("next_t").isNull(), F.lit(0.0)).otherwise((F.col("t") - F.col("right_t")) / (F.col("next_t") - F.col("right_t")))
    rows = matched(onsets, beats).withColumn("p", position).filter("p between 0 and 1")
    binned = rows.groupBy("track", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total") + 1e-8
    totals = binned.withColumn("total", F.sum("n").over(Window.partitionBy("track")))
    # empty bins weigh 1e-8 each; the weights add up to 1 + bins * 1e-8
    scale = 1 + bins * 1e-8
    part = -share / scale * F.ln(share / scale)
    empty = -(1e-8 / scale) * F.ln(F.lit(1e-8 / scale))
    entropy = totals.groupBy("track").agg((F.sum(part) + (bins - F.count("*")) * empty).alias("entropy"))
    rows = counts(onsets, beats).filter("n_beats >= 2 and n_onsets >= 1").join(entropy, "track", "left")
    span = F.col("last_beat") - F.col("first_beat")
    density = F.when(span > 0, F.col("n_onsets") / span).otherwise(0.0)
    return rows.select("track", ((F.least(F.lit(1.0), density / 10) + F.coalesce("entropy", F.lit(0.0)) / F.ln(F.lit(float(bins)))) / 2).alias("complexity"))


def syncopation(onsets: DataFrame, beats: DataFrame, beats_per_measure: int = 4, strong: tuple[int, ...] = (0,), tolerance: float = 0.1) -> DataFrame:
    """Counts of onsets on strong, on weak and off the beats, and the share that is not on strong ones."""
    rows = matched(onsets, beats)
    on = F.abs(F.col("t") - F.col("right_t")) < tolerance
    heavy = (F.col("beat") % beats_per_measure).isin(*strong)
    found = rows.groupBy("track").agg(F.count_if(on & heavy).alias("strong"), F.count_if(on & ~heavy).alias("weak"), F.count_if(~on).alias("off"))
    return found.withColumn("ratio", (F.col("off") + F.col("weak")) / (F.col("strong") + F.col("weak") + F.col("off")))


def regularity(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    """exp(-2 cv) of the intervals between onsets; 0 for fewer than four onsets or beats."""
    gaps = ordered(onsets).withColumn("gap", F.col("next_t") - F.col("t")).groupBy("track").agg(F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
    rows = counts(onsets, beats).join(gaps, "track", "left")
    value = F.least(F.lit(1.0), F.exp(-2 * F.try_divide("sd", "mean")))
    return rows.select("track", F.when((F.col("n_onsets") < 4) | (F.col("n_beats") < 4), 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("regularity"))


def subdivision(onsets: DataFrame, beats: DataFrame, most: int = 8) -> DataFrame:
    rows = counts(onsets, beats)
    return rows.select("track", F.when(F.col("n_beats") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide("n_onsets", "n_beats") / most)).alias("density"))


def swing(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    """Balance of onsets near swung and near straight positions of their beat; 0.5 without evidence."""
    held = backward(onsets, beats.select("track", "t")).filter("right_t is not null and right_next is not null")
    p = (F.col("t") - F.col("right_t")) / (F.col("right_next") - F.col("right_t"))

    def near(*places: float):
        tests = [F.abs(p - x) < 0.1 for x in places]
        return tests[0] | tests[1] if len(tests) == 2 else tests[0] | tests[1] | tests[2]

    swung, straight = near(0.33, 0.67), near(0.25, 0.5, 0.75)
    found = held.groupBy("track").agg(F.count("*").alias("n"), F.count_if(swung).alias("sw"), F.count_if(~swung & straight).alias("st"))
    ratio = 0.5 + F.try_divide(F.col("sw") - F.col("st"), (F.col("sw") + F.col("st")) * 2)
    rows = counts(onsets, beats).join(found, "track", "left")
    return rows.select("track", "n_onsets", "n_beats", F.when(F.coalesce("n", F.lit(0)) < 4, 0.5).otherwise(F.coalesce(ratio, F.lit(0.5))).alias("swing"))


def groove(onsets: DataFrame, beats: DataFrame) -> DataFrame:
    rows = swing(onsets, beats)
    s = F.col("swing")
    few = (F.col("n_beats") < 4) | (F.col("n_onsets") < 8)
    kind = F.when(few, "straight").when(s > 0.6, "swing").when(s > 0.55, "shuffle").otherwise("straight")
    sure = F.when(few, 0.0).when(s > 0.6, (s - 0.6) / 0.3).when(s > 0.55, (s - 0.55) / 0.1).otherwise((0.55 - s) / 0.05)
    return rows.select("track", kind.alias("groove"), F.least(F.lit(1.0), sure).alias("confidence"))


def time_signature(beats: DataFrame) -> DataFrame:
    """The signature whose measures are most even and whose strong beats are loudest; 4/4 has a head start."""
    flat = [(o, name, m, i, i in strong) for o, (name, m, strong) in enumerate(K.TIME_SIGNATURES) for i in range(m)]
    table = fixed(beats, flat, "ord int, signature string, measure int, place int, strong boolean")
    rows = ordered(beats).withColumn("gap", F.col("next_t") - F.col("t"))
    sizes = rows.groupBy("track").agg(F.count("*").alias("n"))
    each = rows.join(sizes, "track").join(table, F.col("idx") % F.col("measure") == F.col("place"))
    whole = F.floor(F.col("idx") / F.col("measure"))
    in_gaps = F.col("gap").isNotNull() & (whole < F.floor((F.col("n") - 1) / F.col("measure")))
    in_beats = whole < F.floor(F.col("n") / F.col("measure"))
    places = each.groupBy("track", "n", "ord", "signature", "measure", "place", "strong").agg(
        F.var_pop(F.when(in_gaps, F.col("gap"))).alias("var"), F.sum(F.when(in_beats, F.col("value"))).alias("loud"), F.count(F.when(in_beats, F.lit(1))).alias("m")
    )
    found = places.groupBy("track", "n", "ord", "signature", "measure").agg(
        F.avg("var").alias("var"),
        F.try_divide(F.sum(F.when(F.col("strong"), F.col("loud"))), F.sum(F.when(F.col("strong"), F.col("m")))).alias("strong"),
        F.try_divide(F.sum(F.when(~F.col("strong"), F.col("loud"))), F.sum(F.when(~F.col("strong"), F.col("m")))).alias("weak"),
    )
    ratio = F.try_divide("strong", "weak")
    emphasis = F.when(F.floor(F.col("n") / F.col("measure")) < 2, 0.0).when(F.col("strong").isNull() | F.col("weak").isNull(), 0.0).when(F.col("weak") == 0, (F.col("strong") > 0).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio - 1) / 2 + 0.5)))
    even = F.when(F.floor((F.col("n") - 1) / F.col("measure")) < 2, 0.0).otherwise(F.least(F.lit(1.0), (F.exp(-10 * F.col("var")) + emphasis) / 2))
    scored = found.withColumn("score", even + F.when(F.col("ord") == 0, 0.3).otherwise(0.0))
    floor = F.when(F.col("ord") == 0, 0.6).when(F.col("signature").isin("3/4", "2/4"), 0.8).otherwise(0.9)
    able = scored.filter(F.col("score") > floor)
    best = able.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("score"), "ord"))).filter("rank = 1")
    rows = sizes.join(best.select("track", "signature", "score"), "track", "left")
    few = F.col("n") < 8
    return rows.select(
        "track",
        F.when(few, "4/4").otherwise(F.coalesce("signature", F.lit("4/4"))).alias("signature"),
        F.when(few, 0.5).otherwise(F.least(F.lit(1.0), F.coalesce("score", F.lit(0.6)))).alias("confidence"),
    )
