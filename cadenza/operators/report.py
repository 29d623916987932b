"""Decision tables: reference tags, production notes and display scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_tags(tracks: DataFrame) -> DataFrame:
    """Tags in order, comma-joined. Columns: track, bpm, key, signature, groove, syncopation, complexity, instruments, brightness, energy."""
    def band(x: str, high: str, low: str) -> Column:
        return F.when(F.col(x) > 0.7, high).when(F.col(x) < 0.3, low)

    bpm = F.col("bpm")
    tags = [
        F.when(bpm < 80, "slow-tempo").when(bpm < 120, "mid-tempo").when(bpm < 140, "upbeat").otherwise("fast-tempo"),
        F.when(F.col("key").contains("Major"), "major-key").when(F.col("key").contains("Minor"), "minor-key"),
        F.when(F.col("signature") != "4/4", F.concat(F.lit("time-sig-"), F.replace("signature", F.lit("/"), F.lit("-")))),
        F.when(F.col("groove") != "straight", F.col("groove")),
        F.when(F.col("syncopation") > 0.5, "syncopated"),
        band("complexity", "complex-structure", "simple-structure"),
        *[F.concat(F.get("instruments", F.lit(i)), F.lit("-driven")) for i in range(3)],
        band("brightness", "bright", "dark"),
        band("energy", "high-energy", "low-energy"),
    ]
    return tracks.select("track", F.concat_ws(",", *tags).alias("tags"))


def production_notes(tracks: DataFrame) -> DataFrame:
    """Density, style and mix. Columns: track, density, instruments, range_db, brightness."""
    density = F.when(F.col("density") > 0.7, "dense").when(F.col("density") > 0.4, "medium").otherwise("sparse")

    def has(name: str) -> Column:
        return F.array_contains("instruments", name)

    style = F.when(has("guitar") & has("drums"), F.when(has("piano"), "rock_pop").otherwise("rock")).when(has("piano"), "piano_driven").otherwise("modern_pop")
    mix = F.concat_ws(",", F.when(F.col("range_db") > 20, "wide_dynamic_range").when(F.col("range_db") < 10, "compressed"), F.when(F.col("brightness") > 0.7, "bright_mix").when(F.col("brightness") < 0.3, "warm_mix"))
    return tracks.select("track", density.alias("density"), style.alias("style"), mix.alias("mix"))


def clock(seconds: Column) -> Column:
    """m:ss, seconds cut off."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def bars(seconds: Column, bpm: Column) -> Column:
    return F.rint(seconds / (240 / bpm)).cast("long")


def level(x: Column) -> Column:
    return F.when(x < 0.33, "low").when(x < 0.67, "mid").otherwise("high")
