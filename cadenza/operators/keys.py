"""Key detection on pitch-class vectors: correlation with key profiles and its refinements.

Vectors are long rows (track, pc, v); lookup tables of a few hundred rows are
broadcast, and everything groups by (track, key), so no track is one task's job.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators.series import hop_windows


def fixed(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small constant table, broadcast; from pandas it is a local relation of the plan."""
    names = [part.split()[0] for part in schema.split(",")]
    return F.broadcast(df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=names), schema))


def chroma_mean(frames: DataFrame, *by: str) -> DataFrame:
    return frames.groupBy(*(by or ("track",)), "pc").agg(F.avg("v").alias("v"))


def smoothing_taps() -> list[tuple[int, int, float]]:
    """(pc, src, w) of the five-tap Gaussian; edges mirror, the edge included."""
    def mirror(i: int) -> int:
        return -i - 1 if i < 0 else 23 - i if i > 11 else i

    return [(pc, mirror(pc + k - 2), w) for pc in range(12) for k, w in enumerate(K.GAUSS_5)]


def gaussian_smooth(chroma: DataFrame, *by: str) -> DataFrame:
    by = by or ("track",)
    taps = fixed(chroma, smoothing_taps(), "to int, pc int, w double")
    return chroma.join(taps, "pc").groupBy(*by, F.col("to").alias("pc")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def key_correlation(chroma: DataFrame, *by: str) -> DataFrame:
    """Pearson r of each vector with the 24 profiles; 0 where it is undefined."""
    by = by or ("track",)
    profiles = fixed(chroma, K.key_profiles(), "key_idx int, key string, mode string, pc int, w double")
    x, y = F.col("v"), F.col("w")
    sums = chroma.join(profiles, "pc").groupBy(*by, "key_idx", "key", "mode").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)))
    r = F.coalesce(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), spread), F.lit(0.0))
    return sums.select(*by, "key_idx", "key", "mode", r.alias("r"))


def key_best(scores: DataFrame, *by: str, boost: float = 0.8) -> DataFrame:
    """The best key with a confidence raised by its lead over the second."""
    by = by or ("track",)
    w = Window.partitionBy(*by).orderBy(F.desc("r"), "key_idx")
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("r").over(w)).filter("rank = 1")
    confidence = F.least(F.lit(1.0), F.col("r") + boost * (F.col("r") - F.coalesce("second", "r")))
    return ranked.select(*by, "key_idx", "key", "mode", "r", confidence.alias("confidence"))


def chroma_map(chroma: DataFrame) -> DataFrame:
    """track and c, the vector as an array of 12."""
    pairs = F.array_sort(F.collect_list(F.struct("pc", "v")))  # twelve entries per track
    return chroma.groupBy("track").agg(F.transform(pairs, lambda p: p["v"]).alias("c"))


def at(offset: int, root: Column) -> Column:
    return F.element_at("c", F.pmod(root + offset, F.lit(12)) + 1)


def tendency(third: int, root: Column) -> Column:
    return (at(0, root) + at(third, root) * 1.2 + at(7, root)) / 3.2


def note(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in K.NOTES]), F.pmod(index, F.lit(12)) + 1)


def relative_validation(best: DataFrame, scores: DataFrame, chroma: DataFrame, close: float = 0.10) -> DataFrame:
    """Switch to the relative key where it correlates better, or where close and its triad is stronger."""
    root, major = F.floor(F.col("key_idx") / 2).cast("int"), F.col("mode") == "Major"
    rel_root = F.pmod(root + F.when(major, F.lit(9)).otherwise(F.lit(3)), F.lit(12))
    rel_idx = (2 * rel_root + major.cast("int")).cast("int")
    combined = (F.col("r") + F.col("confidence")) / 2
    rows = best.withColumn("rel_idx", rel_idx).withColumn("base", combined)
    other = scores.select("track", F.col("key_idx").alias("rel_idx"), F.col("r").alias("rel_r"))
    rows = rows.join(other, ["track", "rel_idx"]).join(chroma_map(chroma), "track")
    diff = F.col("rel_r") - F.col("r")
    up, down = tendency(4, root), tendency(3, root)
    factor = (
        F.when((F.abs(diff) < close) & major & (down > up + 0.2), 0.9)
        .when((F.abs(diff) < close) & ~major & (up > down + 0.2), 1.1)
        .when(diff > close, 1.1)
    )
    rel_mode = F.when(major, "Minor").otherwise("Major")
    return rows.select(
        "track",
        F.when(factor.isNotNull(), note(rel_root)).otherwise(F.col("key")).alias("key"),
        F.when(factor.isNotNull(), rel_mode).otherwise(F.col("mode")).alias("mode"),
        (F.col("base") * F.coalesce(factor, F.lit(1.0))).alias("confidence"),
        F.col("base").alias("key_strength"),
    )


CHORD_WEIGHTS = {"Minor": ({0: 3.0, 7: 2.5, 3: 2.0, 5: 1.5, 10: 1.2}, 3, 1.2), "Major": ({0: 3.0, 7: 2.5, 5: 2.0, 9: 1.5}, 4, 1.1)}


def chord_driven(chroma: DataFrame) -> DataFrame:
    """The key whose typical chord roots are strongest; minor before major in ties."""
    rows = chroma_map(chroma)

    def strength(root: int, mode: str) -> Column:
        weights, third, boost = CHORD_WEIGHTS[mode]
        total = reduce(lambda a, b: a + b, [at(k, F.lit(root)) * w for k, w in weights.items()]) / sum(weights.values())
        return F.least(F.lit(1.0), total * F.when(at(third, F.lit(root)) > 0.3, boost).otherwise(1.0))

    options = [F.struct(strength(r, m).alias("s"), F.lit(-(2 * r + k)).alias("o"), F.lit(K.NOTES[r]).alias("key"), F.lit(m).alias("mode")) for r in range(12) for k, m in enumerate(("Minor", "Major"))]
    best = rows.select("track", F.array_max(F.array(*options)).alias("b"))
    none = F.col("b.s") <= 0
    return best.select("track", F.when(none, "None").otherwise(F.col("b.key")).alias("key"), F.when(none, "Unknown").otherwise(F.col("b.mode")).alias("mode"), F.greatest(F.col("b.s"), F.lit(0.0)).alias("confidence"))


def special_boost(scores: DataFrame, chroma: DataFrame) -> DataFrame:
    """The strongest of six fixed keys: mean of its triad's strength and its correlation."""
    rows = chroma_map(chroma)
    wide = scores.groupBy("track").agg(*[F.max(F.when(F.col("key_idx") == i, F.col("r"))).alias(f"r{i}") for i in range(24)])
    rows = rows.join(wide, "track")

    def strength(name: str, mode: str) -> Column:
        root = F.lit(K.NOTES.index(name))
        if mode == "Major":
            return (at(0, root) + at(4, root) * 1.1 + at(7, root)) / 3.1
        plain = tendency(3, root)
        if name != "G#":
            return plain
        zero = F.lit(0)
        pattern = (at(8, zero) * 1.5 + at(6, zero) * 1.2 + at(4, zero) * 1.1 + at(1, zero)) / 4.8
        return F.when(pattern > 0.15, pattern * 1.5).otherwise(plain) * 1.2

    options = []
    for order, (name, mode) in enumerate(K.SPECIAL_KEYS):
        r = F.col(f"r{2 * K.NOTES.index(name) + (mode == 'Minor')}")
        options.append(F.struct(((strength(name, mode) + r) / 2).alias("s"), F.lit(-order).alias("o"), F.lit(name).alias("key"), F.lit(mode).alias("mode")))
    best = rows.select("track", F.array_max(F.array(*options)).alias("b"))
    none = F.col("b.s") <= 0
    return best.select("track", F.when(none, "None").otherwise(F.col("b.key")).alias("key"), F.when(none, "Unknown").otherwise(F.col("b.mode")).alias("mode"), F.greatest(F.col("b.s"), F.lit(0.0)).alias("confidence"))


def final_ladder(chroma: DataFrame) -> DataFrame:
    """The whole decision: correlation, relative key, chords, fixed keys, relative major, unknown."""
    scores = key_correlation(chroma)
    first = relative_validation(key_best(scores), scores, chroma)
    chords = chord_driven(chroma).select("track", F.struct("key", "mode", "confidence").alias("chords"))
    special = special_boost(scores, chroma).select("track", F.struct("key", "mode", "confidence").alias("special"))
    rows = first.select("track", "key_strength", F.struct("key", "mode", "confidence").alias("a")).join(chords, "track").join(special, "track")
    rows = rows.withColumn("a", F.when((F.col("chords.confidence") > 0.5) & (F.col("chords.confidence") > F.col("a.confidence")), F.col("chords")).otherwise(F.col("a")))
    rows = rows.withColumn("a", F.when((F.col("special.confidence") > 0.25) | (F.col("special.confidence") > F.col("a.confidence") * 0.8), F.col("special")).otherwise(F.col("a")))
    names = fixed(chroma, [(n, K.NOTES[(i + 3) % 12], 2 * ((i + 3) % 12)) for i, n in enumerate(K.NOTES)], "minor_key string, rel_key string, key_idx int")
    rel = F.col("rel_key")
    flat = F.when(rel == "D#", "Eb").when(rel == "G#", "Ab").when(rel == "A#", "Bb").otherwise(rel)
    rows = rows.join(names, F.col("a.key") == F.col("minor_key"), "left").join(scores.select("track", "key_idx", F.col("r").alias("rel_r")), ["track", "key_idx"], "left")
    prefer = (F.col("a.mode") == "Minor") & (F.col("rel_r") > 0) & (F.abs(F.col("a.confidence") - F.col("rel_r")) < 0.08)
    major = F.struct(flat.alias("key"), F.lit("Major").alias("mode"), F.col("rel_r").alias("confidence"))
    rows = rows.withColumn("a", F.when(F.coalesce(prefer, F.lit(False)), major).otherwise(F.col("a")))
    unknown = F.col("a.confidence") < 0.15
    return rows.select(
        "track",
        F.when(unknown, F.concat(F.lit("Unknown("), F.col("a.key"), F.lit("?)"))).otherwise(F.col("a.key")).alias("key"),
        F.when(unknown, "Unknown").otherwise(F.col("a.mode")).alias("mode"),
        (F.col("a.confidence") * 100).alias("confidence"),
        "key_strength",
    )


def modulation_windows(frames: DataFrame, size: int = 16, step: int = 8) -> DataFrame:
    """Changes of the best key from one hop window to the next. ``frames`` has idx."""
    windows = hop_windows(frames, "idx", size, step, "track")
    best = key_best(key_correlation(chroma_mean(windows, "track", "window"), "track", "window"), "track", "window")
    w = Window.partitionBy("track").orderBy("window")
    name = F.concat_ws(" ", "key", "mode")
    rows = best.withColumn("to_key", name).withColumn("from_key", F.lag(name).over(w))
    return rows.filter("from_key <> to_key").select("track", "window", "from_key", "to_key", F.col("r").alias("r"))


def key_hints(hints: DataFrame) -> DataFrame:
    """Key and mode of written hints (track, hint), null where none is meant."""
    common = ["C", "G", "D", "A", "E", "B", "F#", "Db", "Ab", "Eb", "Bb", "F"]
    rows = []
    for note_name in [*common, *[n for n in K.NOTES if n not in common]]:
        low = note_name.lower()
        rows += [(low + s, note_name, "Major") for s in ("", "major", "maj")] + [(low + s, note_name, "Minor") for s in ("minor", "min", "m", "-minor", "-min", "-m")]
    table = fixed(hints, rows, "norm string, key string, mode string")
    norm = F.replace(F.replace(F.replace(F.lower("hint"), F.lit(" "), F.lit("")), F.lit("♭"), F.lit("b")), F.lit("♯"), F.lit("#"))
    return hints.withColumn("norm", norm).join(table, "norm", "left").select("track", "hint", "key", "mode")


def sophistication(melody: DataFrame, harmony: DataFrame) -> DataFrame:
    """Balance, overall complexity and sophistication of tracks from their melody and harmony measures.

    ``melody``: track, h (the harmony's track), contour, variety, octaves, coverage;
    ``harmony``: h, complexity, consonance, rate, key_confidence (0 to 1).
    """
    rows = melody.join(harmony, "h")
    low, high = F.least("contour", "complexity"), F.greatest("contour", "complexity")
    balance = F.coalesce(F.try_divide(low, high), F.lit(0.5))
    overall = F.least(F.lit(1.0), F.col("contour") * 0.4 + F.col("complexity") * 0.4 + F.col("variety") * 0.2)
    terms = (
        F.col("octaves") * 0.15 + F.col("contour") * 0.2 + F.col("variety") * 0.15 + F.col("complexity") * 0.2
        + F.abs(0.5 - F.col("consonance")) * 0.1 + F.least(F.lit(1.0), F.col("rate") / 5) * 0.1 + F.col("key_confidence") * 0.1
    )
    poor = (F.col("coverage") < 0.3) | (F.col("key_confidence") < 0.3)
    full = F.least(F.lit(1.0), terms * F.least(F.lit(1.0), (F.col("coverage") + F.col("key_confidence")) / 2))
    score = F.when(poor, F.least(F.lit(0.3), F.col("coverage") * F.col("key_confidence"))).otherwise(full)
    return rows.select("track", balance.alias("balance"), overall.alias("overall"), score.alias("sophistication"))
