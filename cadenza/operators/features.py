"""The feature vector of a track: 81 numbers from whatever measures are known of it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import constants as K

# Position, divisor and default of each number; what is not known has its default.
SCALARS: list[tuple[str, float, float]] = [
    ("bpm", 200, 120), ("key_number", 1, 0), ("duration", 300, 180),
    ("harmonic_rhythm", 5, 0), ("chord_complexity", 1, 0), ("substitute_ratio", 1, 0), ("n_modulations", 5, 0),
    ("harmonic_complexity", 1, 0), ("harmonic_entropy", 1, 0), ("consonance", 1, 0), ("harmonic_tension", 1, 0),
    ("signature_number", 1, 0), ("rhythmic_complexity", 1, 0), ("syncopation", 1, 0), ("regularity", 1, 0), ("subdivision", 1, 0), ("swing", 1, 0.5), ("polyrhythm", 1, 0), ("groove_number", 1, 0),
    ("brightness", 1, 0), ("roughness", 1, 0), ("warmth", 1, 0), ("density", 1, 0),
    *[(f"instrument{i}_{x}", 1, 0) for i in range(1, 6) for x in ("confidence", "prominence")],
    ("reverb", 1, 0), ("distortion", 1, 0), ("chorus", 1, 0), ("compression", 1, 0), ("smoothness", 1, 0), ("richness", 1, 0), ("clarity", 1, 0), ("fullness", 1, 0),
    ("repetition", 1, 0), ("structural_complexity", 1, 0), ("n_sections", 10, 0), ("n_types", 6, 0),
    *[(f"share_{x}", 1, 0) for x in ("intro", "verse", "chorus", "bridge", "instrumental", "outro")],
    ("octaves", 4, 0), ("pitch_sd", 12, 0), ("ascending", 1, 0), ("descending", 1, 0), ("contour", 1, 0), ("mean_step", 5, 0),
    *[(f"interval_{x}", 1, 0) for x in ("unison", "major_second", "major_third", "perfect_fourth", "perfect_fifth")],
    ("pitch_stability", 1, 0), ("vibrato_rate", 10, 0), ("vibrato_extent", 1, 0), ("melody_present", 1, 0), ("melody_coverage", 1, 0),
    ("range_db", 60, 0), ("peak_to_mean", 10, 0), ("crest", 10, 0), ("db_variance", 100, 0), ("loudness_above_60", 60, 30), ("perceived_loudness", 1, 0),
    ("energy", 1, 0), ("energy_variance", 1, 0), ("low_share", 1, 0), ("mid_share", 1, 0), ("high_share", 1, 0), ("band_balance", 1, 0), ("n_climaxes", 5, 0), ("climax_intensity", 1, 0),
]
SIGNATURE_NUMBERS = {"4/4": 0.0, "3/4": 0.2, "2/4": 0.4, "6/8": 0.6, "9/8": 0.7, "12/8": 0.8, "5/4": 0.9, "7/8": 1.0}
GROOVE_NUMBERS = {"straight": 0.0, "shuffle": 0.5, "swing": 1.0}


def looked_up(value: Column, table: dict[str, float]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(0.0))


def key_number(key: Column) -> Column:
    """(pitch class + 12 for minor) / 24 of "C# Minor"; unknown notes count as C, other texts as 0."""
    note, mode = F.split_part(key, F.lit(" "), F.lit(1)), F.lower(F.split_part(key, F.lit(" "), F.lit(2)))
    root = looked_up(note, {n: float(i) for i, n in enumerate(K.NOTES)})
    return F.when(F.coalesce(F.size(F.split(key, " ")) == 2, F.lit(False)), (root + F.when(mode == "major", 0.0).otherwise(12.0)) / 24).otherwise(0.0)


def feature_vector(measures: DataFrame) -> DataFrame:
    """track and v; ``measures`` has the columns that are known, by the names of SCALARS, or key, signature and groove."""
    have = set(measures.columns)
    derived = {"key_number": ("key", key_number), "signature_number": ("signature", lambda c: looked_up(c, SIGNATURE_NUMBERS)), "groove_number": ("groove", lambda c: looked_up(c, GROOVE_NUMBERS))}

    def number(name: str, divisor: float, default: float) -> Column:
        if name in have:
            found = F.coalesce(F.col(name).cast("double"), F.lit(float(default)))
        elif name in derived and derived[name][0] in have:
            found = derived[name][1](F.col(derived[name][0]))
        else:
            found = F.lit(float(default))
        return found / float(divisor)

    return measures.select("track", F.array(*[number(*s) for s in SCALARS]).alias("v"))


def exported(vectors: DataFrame, version: str = "1.0") -> DataFrame:
    """Each vector as a JSON document with its length and version."""
    return vectors.select("track", F.to_json(F.struct(F.col("v").alias("vector"), F.size("v").alias("length"), F.lit(version).alias("version"))).alias("json"))


def imported(documents: DataFrame) -> DataFrame:
    """The inverse of ``exported``; rows that are no such document have a null vector."""
    return documents.select("track", F.from_json("json", "vector array<double>, length int, version string")["vector"].alias("v"))


def layout() -> str:
    """The positions of the numbers, as JSON."""
    return json.dumps({name: i for i, (name, _, _) in enumerate(SCALARS)})
