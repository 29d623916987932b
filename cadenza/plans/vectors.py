"""The feature-vector query: measures of several families joined per track."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cadenza.operators import features as V
from cadenza.plans import keys, rhythm, sound, structures


def measures(spark, sf_dir):
    rhythms = [
        rhythm.rhythm_complexity(spark, sf_dir).withColumnRenamed("complexity", "rhythmic_complexity"),
        rhythm.rhythm_syncopation(spark, sf_dir).select("track", F.col("ratio").alias("syncopation")),
        rhythm.rhythm_regularity(spark, sf_dir),
        rhythm.rhythm_subdivision(spark, sf_dir).withColumnRenamed("density", "subdivision"),
        rhythm.rhythm_swing(spark, sf_dir),
        rhythm.rhythm_groove(spark, sf_dir).select("track", "groove"),
        rhythm.rhythm_time_signature(spark, sf_dir).select("track", "signature"),
    ]
    others = [
        structures.section_form(spark, sf_dir).select("track", "repetition", F.col("n").alias("n_sections"), "n_types"),
        sound.melody_range(spark, sf_dir).select("track", "octaves", F.col("sd").alias("pitch_sd")),
        sound.melody_direction(spark, sf_dir).select("track", F.col("up").alias("ascending"), F.col("down").alias("descending"), F.col("complexity").alias("contour"), "mean_step"),
        sound.melody_stability(spark, sf_dir).select("track", F.col("stability").alias("pitch_stability")),
        sound.dynamics_range(spark, sf_dir).select("track", "range_db", "peak_to_mean", "crest", F.col("variance").alias("db_variance"), F.col("mean_loudness").alias("loudness_above_60")),
        sound.effects_scores(spark, sf_dir).select("track", "chorus", "compression", "density"),
    ]
    best = keys.key_best(spark, sf_dir).select(F.col("track").alias("h"), F.concat_ws(" ", "key", "mode").alias("key"))
    rows = reduce(lambda a, b: a.join(b, "track", "left"), rhythms + others)
    return rows.withColumn("h", F.pmod("track", F.lit(10)).cast("int")).join(best, "h")


def feature_vector(spark, sf_dir):
    found = V.feature_vector(measures(spark, sf_dir))
    return found.select("track", F.posexplode("v").alias("dim", "x")).select("track", "dim", F.round("x", 6).alias("x"))


QUERIES = [feature_vector]

_SOURCES = {
    "a": rhythm.SQL["rhythm_complexity"], "b": rhythm.SQL["rhythm_syncopation"], "c": rhythm.SQL["rhythm_regularity"], "d": rhythm.SQL["rhythm_subdivision"],
    "e": rhythm.SQL["rhythm_swing"], "f": rhythm.SQL["rhythm_groove"], "g": rhythm.SQL["rhythm_time_signature"], "h": structures.SQL["section_form"],
    "i": sound.SQL["melody_range"], "j": sound.SQL["melody_direction"], "k": sound.SQL["melody_stability"], "l": sound.SQL["dynamics_range"], "m": sound.SQL["effects_scores"],
}
_GIVEN = {
    "rhythmic_complexity": "a.complexity", "syncopation": "b.ratio", "regularity": "c.regularity", "subdivision": "d.density", "swing": "e.swing",
    "groove_number": "case f.groove when 'swing' then 1.0 when 'shuffle' then 0.5 else 0.0 end", "repetition": "h.repetition", "n_sections": "h.n", "n_types": "h.n_types",
    "octaves": "i.octaves", "pitch_sd": "i.sd", "ascending": "j.up", "descending": "j.down", "contour": "j.complexity", "mean_step": "j.mean_step", "pitch_stability": "k.stability",
    "range_db": "l.range_db", "peak_to_mean": "l.peak_to_mean", "crest": "l.crest", "db_variance": "l.variance", "loudness_above_60": "l.mean_loudness",
    "chorus": "m.chorus", "compression": "m.compression", "density": "m.density",
    "key_number": "(list_position(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], z.key) - 1 + case z.mode when 'Major' then 0 else 12 end) / 24",
}
_GIVEN["signature_number"] = "case g.signature " + " ".join(f"when '{k}' then {v}" for k, v in V.SIGNATURE_NUMBERS.items()) + " else 0.0 end"
_LIST = ", ".join(f"coalesce({_GIVEN[n]}, {d})::double / {q}" if n in _GIVEN else f"{d}::double / {q}" for n, q, d in V.SCALARS)
SQL = {
    "feature_vector": "with " + ", ".join(f"{k} as ({sql})" for k, sql in _SOURCES.items()) + f""", z as ({keys.SQL['key_best']}),
v as (select a.track, [{_LIST}] as v from a {' '.join(f'left join {k} on {k}.track = a.track' for k in _SOURCES if k != 'a')} join z on z.track = a.track % 10)
select track, (d - 1)::int as dim, round(v[d], 6) as x from v, range(1, {len(V.SCALARS) + 1}) as r(d)"""
}
