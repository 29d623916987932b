"""Chord matching, merging, progressions and their analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators.keys import fixed
from cadenza.operators.series import islands


def template_match(frames: DataFrame, *by: str) -> DataFrame:
    """Best triad by cosine, or the best tetrad where it leads by more than 0.15; then the cluster override.

    ``frames``: by..., pc, v.  The cluster is read from the notes of rank two to four.
    """
    templates = fixed(frames, K.chord_templates(), "ord int, chord string, kind string, pc int")
    norms = frames.groupBy(*by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = frames.join(templates, "pc").groupBy(*by, "ord", "chord", "kind").agg((F.sum("v") / F.sqrt(F.count("*"))).alias("dot"))
    sims = dots.join(norms, list(by)).withColumn("sim", F.coalesce(F.try_divide("dot", "norm"), F.lit(0.0)))
    best = Window.partitionBy(*by, "kind").orderBy(F.desc("sim"), "ord")
    top = sims.withColumn("rank", F.row_number().over(best)).filter("rank = 1").groupBy(*by).agg(
        *[F.max(F.when(F.col("kind") == k, F.struct("sim", "chord"))).alias(k) for k in ("triad", "tetrad")]
    )
    picked = F.when(F.col("tetrad.sim") > F.col("triad.sim") + 0.15, F.col("tetrad")).otherwise(F.col("triad"))
    rank = Window.partitionBy(*by).orderBy(F.desc("v"), F.desc("pc"))
    ranked = frames.withColumn("rank", F.row_number().over(rank)).filter("rank <= 4")
    cluster = ranked.groupBy(*by).agg(
        F.max("v").alias("peak"),
        F.avg(F.when(F.col("rank") > 1, F.col("v"))).alias("strength"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "pc")))), lambda x: x["pc"]).alias("pcs"),  # three notes
    )

    def chord(root: Column) -> Column:
        def has(offset: int) -> Column:
            return F.array_contains("pcs", F.pmod(root + offset, F.lit(12)).cast("int"))

        name = F.element_at(F.array(*[F.lit(n) for n in K.NOTES]), root + 1)
        return F.when(has(4) & has(7), name).when(has(3) & has(7), F.concat(name, F.lit("m")))

    named = F.coalesce(*[chord(F.element_at("pcs", i)) for i in (1, 2, 3)])
    rows = top.withColumn("best", picked).join(cluster.withColumn("cluster", named), list(by))
    override = F.col("cluster").isNotNull() & (F.col("strength") > F.col("best.sim") * 0.8)
    quiet = F.col("peak") < 0.1
    return rows.select(
        *by,
        F.when(quiet, "N").when(override, F.col("cluster")).otherwise(F.col("best.chord")).alias("chord"),
        F.when(quiet, 0.0).when(override, F.col("strength")).otherwise(F.greatest(F.lit(0.0), F.col("best.sim"))).alias("confidence"),
        "peak",
    )


def confident(matches: DataFrame) -> DataFrame:
    """Rows above the adaptive threshold."""
    return matches.filter(F.col("confidence") > F.greatest(F.lit(0.3), 0.55 - (1 - F.col("peak")) * 0.2))


def merged_runs(chords: DataFrame, least: float = 0.5, gap: int = 0) -> DataFrame:
    """Consecutive equal chords within ``gap`` as one, where both confidences exceed ``least``.

    ``chords``: track, seq, chord, confidence, start, end.
    """
    w = Window.partitionBy("track").orderBy("seq")
    same = (F.col("chord") == F.lag("chord").over(w)) & (F.col("start") <= F.lag("end").over(w) + gap)
    joined = same & (F.least(F.col("confidence"), F.lag("confidence").over(w)) > least)
    runs = islands(chords, ~F.coalesce(joined, F.lit(False)), "track", "seq")
    return runs.groupBy("track", "island").agg(
        F.first("chord").alias("chord"), F.max("confidence").alias("confidence"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")
    )


def progression_stats(chords: DataFrame) -> DataFrame:
    """Harmonic rhythm, complexity, distinct chords and changes per track."""
    w = Window.partitionBy("track").orderBy("seq")
    changed = (F.col("chord") != F.lag("chord").over(w)).cast("int")
    rows = chords.withColumn("changed", F.coalesce(changed, F.lit(0)))
    return rows.groupBy("track").agg(
        F.try_divide(F.count("*"), F.sum(F.col("end") - F.col("start"))).alias("harmonic_rhythm"),
        F.least(F.lit(1.0), F.count_distinct("chord") / 12).alias("complexity"),
        F.count_distinct("chord").alias("n_distinct"),
        F.sum("changed").alias("n_changes"),
    )


def main_progression(chords: DataFrame, n: int = 4) -> DataFrame:
    """The n-gram with the highest score: count plus twice its distinct chords; the first seen wins ties."""
    w = Window.partitionBy("track").orderBy("seq")
    parts = [F.lead("chord", k).over(w) for k in range(n)]
    grams = chords.select("track", "seq", F.array(*parts).alias("gram"), F.lead("chord", n - 1).over(w).alias("_last")).filter("_last is not null")
    counted = grams.groupBy("track", "gram").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    kinds = F.size(F.array_distinct("gram"))
    scored = counted.withColumn("score", F.when(kinds >= 2, F.col("n") + 2 * kinds).otherwise(F.floor(F.col("n") * 0.01)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("score"), "first"))).filter("rank = 1")
    return best.select("track", F.array_join("gram", " ").alias("progression"), "n", F.col("score").cast("long").alias("score"))


def root_of(chord: Column) -> Column:
    name = F.regexp_extract(chord, r"^([A-G]#?)", 1)
    return (F.array_position(F.array(*[F.lit(n) for n in K.NOTES]), name) - 1).cast("int")


def roman(chord: Column, key_root: Column, mode: Column) -> Column:
    """Roman numeral of a chord in a key; N stays, unknown roots give ?."""
    root = root_of(chord)
    base = F.element_at(F.array(*[F.lit(n) for n in K.NUMERALS]), F.pmod(root - key_root, F.lit(12)) + 1)
    minor = chord.contains("m")
    shaped = F.when((mode == "Major") & minor, F.lower(base)).when((mode == "Minor") & ~minor, F.upper(base))
    lowered = F.when(base == "I", "i").when(base == "IV", "iv").otherwise(base)
    return F.when(chord == "N", "N").when(root < 0, "?").otherwise(F.coalesce(shaped, F.when(mode == "Minor", lowered).otherwise(base)))


SCALES = {"Major": ["i", "ii", "iii", "iv", "v", "vi"], "Minor": ["i", "iii", "iv", "v", "vi", "vii"]}


def local_key(chords: DataFrame, *by: str, least: float = 0.5) -> DataFrame:
    """The key whose scale holds the largest share of a group's chords; null up to ``least``."""
    keys = fixed(chords, [(2 * r + k, r, m, f"{K.NOTES[r]} {m}") for r in range(12) for k, m in enumerate(("Major", "Minor"))], "key_idx int, key_root int, mode string, key string")
    named = chords.filter("chord <> 'N'").groupBy(*by, "chord").agg(F.count("*").alias("n"))  # pre-aggregated: few distinct chords
    numeral = F.lower(roman(F.col("chord"), F.col("key_root"), F.col("mode")))
    fits = F.when(F.col("mode") == "Major", numeral.isin(SCALES["Major"])).otherwise(numeral.isin(SCALES["Minor"]))
    scored = named.join(keys).groupBy(*by, "key_idx", "key").agg((F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("fit"), F.sum("n").alias("n"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fit"), "key_idx"))).filter("rank = 1")
    return best.select(*by, F.when(F.col("fit") > least, F.col("key")).alias("key"), "fit", "n")


def modulations(chords: DataFrame, first_key: str = "C Major", size: int = 8, step: int = 4, least_chords: int = 4) -> DataFrame:
    """Windows whose local key differs from the last one found. ``chords`` has seq from 0."""
    from cadenza.operators.series import hop_windows

    windows = hop_windows(chords, "seq", size, step, "track")
    found = local_key(windows, "track", "window").filter((F.col("n") >= least_chords) & F.col("key").isNotNull())
    w = Window.partitionBy("track").orderBy("window")
    rows = found.withColumn("from_key", F.coalesce(F.lag("key").over(w), F.lit(first_key)))
    return rows.filter("key <> from_key").select("track", "window", "from_key", F.col("key").alias("to_key"))


def substitute_ratio(chords: DataFrame) -> DataFrame:
    """Share of extended or altered chord names per track."""
    return chords.groupBy("track").agg(F.avg(F.col("chord").rlike("7|9|11|13|sus|add|dim|aug").cast("int")).alias("ratio"))
