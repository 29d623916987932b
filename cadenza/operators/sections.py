"""Sections with bounds: refinement, merging, endings, hooks, text and chords; key changes with hysteresis.

``sections`` have the columns track, seq, start, end, type, energy, complexity, and further
ones where a function says so.  A section that lacks a number takes 0.5 for it, as the rules'
defaults say.  All but ``key_changes`` are projections, windows over one track's sections or
aggregates; ``key_changes`` folds the windows of one track inside one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.series import backward, islands

# The type of two merged neighbours, read in both directions.
MERGED = [
    ("verse", "pre_chorus", "verse"), ("pre_chorus", "chorus", "chorus"), ("chorus", "instrumental", "chorus"), ("verse", "bridge", "bridge"),
    ("instrumental", "break", "instrumental"), ("intro", "verse", "verse"), ("verse", "outro", "outro"),
]
# Display names of the types.
LABELS = {
    "intro": "Intro", "verse": "A-melo", "pre_chorus": "B-melo", "chorus": "Sabi", "bridge": "C-melo", "instrumental": "Kansou",
    "break": "Break", "interlude": "Interlude", "solo": "Solo", "spoken": "Serifu", "outro": "Outro",
}
# The energy scale of a track without sound.
SILENT = {"low": 0.0, "high": 0.05, "mean": 0.025, "range": 0.05}
# The key of a track in which none is found.
NO_KEY = ("C", "Major", 5.0, 0.1)
UNKNOWN, NO_NAME = "Unknown", "None"


def _duration() -> Column:
    return F.col("end") - F.col("start")


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.5))


def refined(sections: DataFrame) -> DataFrame:
    """Types after a look at spectral change (``flux``) and onset ``density``.

    A busy outro becomes a chorus, bridge or verse, a plain bridge a verse, and an instrumental
    part a breakdown, solo, interlude or buildup.
    """
    e, c, long = _given("energy"), _given("complexity"), _duration()
    kind = (
        F.when((e < 0.4) & (c < 0.4) & (long < 15), "breakdown")
        .when((e > 0.6) & (c > 0.7) & (long > 10) & (long < 30), "solo")
        .when(e.between(0.4, 0.7) & (c > 0.5) & (long > 15), "interlude")
        .when((e > 0.7) & (_given("density") > 0.8), "buildup")
        .otherwise("solo")
    )
    busy = F.when(e > 0.5, "chorus").when(c > 0.6, "bridge").otherwise("verse")
    label = (
        F.when((F.col("type") == "outro") & (F.col("flux") > 0.1), busy)
        .when((F.col("type") == "bridge") & (c < 0.4), "verse")
        .when(F.col("type") == "instrumental", kind)
        .otherwise(F.col("type"))
    )
    return sections.withColumn("label", label)


def chorus_hooks(sections: DataFrame) -> DataFrame:
    """Strong verses, bridges and pre-choruses of 6 to 10 seconds are choruses; where ``brightness`` is known it must be over 0.6."""
    bright = F.coalesce(F.col("brightness"), F.lit(0.0))
    hook = (F.col("energy") > 0.65) & _duration().between(6, 10) & F.col("type").isin("verse", "bridge", "pre_chorus") & ((bright <= 0) | (bright > 0.6))
    return sections.withColumn("label", F.when(hook, "chorus").otherwise(F.col("type")))


def endings(sections: DataFrame, bpm: float = 130.0) -> DataFrame:
    """Bridges under 12 bars or of complexity up to 0.7 are pre-choruses or verses; a last instrumental or verse of at most 8 bars is the outro."""
    bar = 240.0 / bpm
    plain = (F.col("type") == "bridge") & ((_duration() < 12 * bar) | (F.coalesce(F.col("complexity"), F.lit(0.0)) <= 0.7))
    label = F.when(plain, F.when(F.col("energy") > 0.55, "pre_chorus").otherwise("verse")).otherwise(F.col("type"))
    last = F.lead("seq").over(Window.partitionBy("track").orderBy("seq")).isNull()
    rows = sections.withColumn("label", label).withColumn("_last", last)
    closing = F.col("_last") & F.col("label").isin("instrumental", "verse") & (_duration() <= 8 * bar)
    return rows.withColumn("label", F.when(closing, "outro").otherwise(F.col("label"))).drop("_last")


def merged_type(first: Column, second: Column, long1: Column, long2: Column) -> Column:
    """The type of two neighbours in one: that of one twice as long, not that of a short instrumental, else by ``MERGED``, else the first."""
    out = first
    for a, b, kind in reversed(MERGED):
        out = F.when(((first == a) & (second == b)) | ((first == b) & (second == a)), kind).otherwise(out)
    return (
        F.when(long1 > long2 * 2, first).when(long2 > long1 * 2, second)
        .when((second == "instrumental") & (long2 < 8), first).when((first == "instrumental") & (long1 < 8), second)
        .otherwise(out)
    )


def neighbours(sections: DataFrame) -> DataFrame:
    """Each section but the first of its track with the type that it and the one before would have in one."""
    w = Window.partitionBy("track").orderBy("seq")
    rows = sections.withColumn("before", F.lag("type").over(w)).withColumn("_d", F.lag(_duration()).over(w)).filter("before is not null")
    return rows.withColumn("label", merged_type(F.col("before"), F.col("type"), F.col("_d"), _duration())).drop("_d")


def same_type_runs(sections: DataFrame) -> DataFrame:
    """Adjacent sections of one type in one, from the first's start to the last's end; energy and complexity are means by duration."""
    w = Window.partitionBy("track").orderBy("seq")
    rows = islands(sections, ~F.col("type").eqNullSafe(F.lag("type").over(w)) | F.lag("seq").over(w).isNull(), "track", "seq")

    def mean(name: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(name) * _duration()), F.sum(_duration())), F.avg(name)).alias(name)

    found = rows.groupBy("track", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("type").alias("type"), F.count("*").alias("n"), mean("energy"), mean("complexity"))
    return found.withColumn("seq", F.col("island") - 1).drop("island")


def section_chords(sections: DataFrame, chords: DataFrame, most: int = 4, least: float = 1.0) -> DataFrame:
    """The first ``most`` chords of each section, with arrows between; ``Unknown`` without chords or up to ``least`` seconds.

    ``chords``: track, t, chord.  A chord falls in at most one section: a backward match.  Only
    ``most`` chords of a section are gathered.
    """
    bounds = sections.select("track", F.col("start").alias("t"))
    held = backward(chords.select("track", "t", "chord"), bounds).filter("right_t is not null")
    rank = F.row_number().over(Window.partitionBy("track", "right_t").orderBy("t", "chord"))
    first = held.withColumn("_k", rank).filter(F.col("_k") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_k", "chord"))), lambda x: x["chord"])
    texts = first.groupBy("track", F.col("right_t").alias("start")).agg(F.array_join(names, " → ").alias("chords"))
    rows = sections.join(texts, ["track", "start"], "left")
    return rows.withColumn("chords", F.when(_duration() > least, F.coalesce("chords", F.lit("Unknown"))).otherwise("Unknown"))


def _tenth(x: Column) -> Column:
    return F.rint(x * 10) / 10


def summary(sections: DataFrame) -> DataFrame:
    """A list of a track's sections as text: number, type, display name, start, end and duration in seconds."""
    pairs = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    shown = F.coalesce(F.element_at(pairs, F.col("type")), F.col("type"))
    name = F.concat(F.upper(F.substring("type", 1, 1)), F.lower(F.expr("substring(type, 2)")))
    line = F.format_string("  %2d. %-8s(%s) %6.1fs - %6.1fs (%5.1fs)", F.col("seq") + 1, name, shown, _tenth(F.col("start")), _tenth(F.col("end")), _tenth(_duration()))
    rows = sections.withColumn("_line", line).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("seq", "_line"))).alias("c"))  # sections of one track
    head = F.format_string("Section List (Estimated %d sections)", F.size("c"))
    return rows.select("track", F.concat_ws("\n", head, F.transform("c", lambda x: x["_line"])).alias("summary"))


def energy_scale(series: DataFrame) -> DataFrame:
    """The 10th and 90th percentile, mean and range of a track's levels above 0; fixed values for a silent track."""
    heard = F.when(F.col("rms") > 0, F.col("rms"))
    rows = series.withColumn("x", heard).groupBy("track").agg(F.percentile("x", [0.1, 0.9]).alias("p"), F.avg("x").alias("mean"))
    low, high = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    found = {"low": low, "high": high, "mean": F.col("mean"), "range": high - low}
    return rows.select("track", *[F.coalesce(x, F.lit(SILENT[k])).alias(k) for k, x in found.items()])


def distortion(spectrum: DataFrame, nyquist: float) -> DataFrame:
    """Mean power of the upper three quarters of the bins over that of the lowest quarter, at most 1; 0 without the latter."""
    low = F.col("freq") < nyquist / 4
    rows = spectrum.groupBy("track").agg(F.avg(F.when(low, F.col("power"))).alias("a"), F.avg(F.when(~low, F.col("power"))).alias("b"))
    return rows.select("track", F.least(F.lit(1.0), F.coalesce(F.try_divide("b", "a"), F.lit(0.0))).alias("distortion"))


def trimmed(series: DataFrame, most: float = 180.0) -> DataFrame:
    """Of tracks longer than ``most`` seconds the part of that length that begins at a quarter (``t`` from 0)."""
    length = F.max("t").over(Window.partitionBy("track"))
    rows = series.withColumn("_l", length)
    return rows.filter((F.col("_l") <= most) | ((F.col("t") >= F.col("_l") / 4) & (F.col("t") < F.col("_l") / 4 + most))).drop("_l")


def dynamic_events(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Sudden changes and sustained runs as one table of events: track, idx, type and magnitude."""
    names = F.create_map(*[F.lit(x) for x in ("increase", "sudden_increase", "decrease", "sudden_decrease", "peak", "sustained_peak", "quiet", "quiet_section")])
    both = changes.select("track", "idx", "kind", "magnitude").unionByName(runs.select("track", F.col("start").alias("idx"), "kind", "magnitude"))
    return both.select("track", "idx", F.element_at(names, F.col("kind")).alias("type"), "magnitude")


def beat_means(frames: DataFrame, beats: DataFrame) -> DataFrame:
    """Mean of each pitch class from one beat to the next, and before the first: track, start, pc, v.

    ``frames``: track, t, pc, v; ``beats``: track, t.  The part before the first beat starts at -1.
    """
    held = backward(frames, beats.select("track", "t").distinct())
    return held.groupBy("track", F.coalesce("right_t", F.lit(-1.0)).alias("start"), "pc").agg(F.avg("v").alias("v"))


def key_or_default(tracks: DataFrame, found: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """A key for every track: that found, else that of ``other``, else C Major with little confidence.

    A key that is null or starts with Unknown is none.

    ``found`` and ``other``: track, key, mode, confidence, key_strength.
    """
    names = ["key", "mode", "confidence", "key_strength"]
    rows = tracks.select("track").join(found.select("track", F.struct(*names).alias("_a")), "track", "left")
    tries = [F.when(~F.startswith(F.col("_a.key"), F.lit(UNKNOWN)), F.col("_a"))]
    if other is not None:
        rows = rows.join(other.select("track", F.struct(*names).alias("_b")), "track", "left")
        tries.append(F.when(~F.startswith(F.col("_b.key"), F.lit(UNKNOWN)), F.col("_b")))
    default = F.struct(*[F.lit(x).alias(n) for x, n in zip(NO_KEY, names, strict=True)])
    return rows.select("track", F.coalesce(*tries, default).alias("_k")).select("track", "_k.*")


def key_names(found: DataFrame) -> DataFrame:
    """Key and mode as one name (track, key, confidence): C Major where the key is null, None or Unknown.

    The confidence stays that of what was found.
    """
    none = F.col("key").isNull() | (F.col("key") == NO_NAME) | F.startswith("key", F.lit(UNKNOWN))
    key, mode = NO_KEY[:2]
    return found.select("track", F.when(none, f"{key} {mode}").otherwise(F.concat_ws(" ", "key", "mode")).alias("key"), "confidence")


def key_changes(windows: DataFrame, least: float = 15.0, stay: int = 2) -> DataFrame:
    """Changes of key between windows, with hysteresis: the old key must have been seen ``stay`` times, the new be sure.

    ``windows``: track, seq, key, confidence (0 to 100).  The fold runs over the windows of one
    track (some dozens).  Returns track, seq, from_key, to_key, confidence (0 to 1), difference
    from the window before.
    """
    rows = windows.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("seq", "key", "confidence"))).alias("c"))
    kind = "array<struct<seq:bigint,from_key:string,to_key:string,confidence:double,difference:double>>"
    zero = F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("n"), F.lit(0.0).alias("last"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh, same = acc["key"].isNull(), acc["key"] == x["key"]
        moves = ~fresh & ~same & (x["confidence"] > least) & (acc["n"] >= stay)
        one = F.struct(x["seq"].cast("long").alias("seq"), acc["key"].alias("from_key"), x["key"].alias("to_key"), (x["confidence"] / 100).alias("confidence"), F.abs(x["confidence"] - acc["last"]).alias("difference"))
        count = F.when(fresh | moves, 1).when(same, acc["n"] + 1).otherwise(acc["n"])
        key = F.when(fresh | moves, x["key"]).otherwise(acc["key"])
        return F.struct(key.alias("key"), count.alias("n"), x["confidence"].alias("last"), F.when(moves, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return rows.select("track", F.inline(F.aggregate("c", zero, step, lambda acc: acc["out"])))
