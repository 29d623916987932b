"""Small known cases and invariants of the operators."""

import numpy as np
import pytest

from cadenza.functions import constants as K
from cadenza.operators import chords, dynamics, keys, melody, rhythm, series, similarity, structure, tempo


def chroma(spark, values, track=0):
    return spark.createDataFrame([(track, i, float(v)) for i, v in enumerate(values)], "track int, pc int, v double")


@pytest.mark.parametrize("turn", [0, 3, 7, 11])
def test_rotating_a_profile_rotates_its_key(spark, turn):
    best = keys.key_best(keys.key_correlation(chroma(spark, np.roll(K.profile("Major"), turn)))).first()
    assert (best["key"], best["mode"]) == (K.NOTES[turn], "Major")
    assert best["r"] == pytest.approx(1.0)


def test_flat_vector_has_no_correlation(spark):
    assert {r["r"] for r in keys.key_correlation(chroma(spark, [1.0] * 12)).collect()} == {0.0}


def test_roman_numerals(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("C",), ("Am",), ("F",), ("G",), ("N",), ("x",)], "chord string")
    found = [r[0] for r in rows.select(chords.roman(F.col("chord"), F.lit(0), F.lit("Major"))).collect()]
    assert found == ["I", "vi", "IV", "V", "N", "?"]


def test_merge_needs_confidence(spark):
    rows = [(0, 0, "C", 0.8, 0, 10), (0, 1, "C", 0.7, 10, 20), (0, 2, "C", 0.4, 20, 30), (0, 3, "G", 0.9, 30, 40)]
    df = spark.createDataFrame(rows, "track int, seq int, chord string, confidence double, start int, end int")
    found = sorted((r["start"], r["end"], r["chord"]) for r in chords.merged_runs(df).collect())
    assert found == [(0, 20, "C"), (20, 30, "C"), (30, 40, "G")]


def test_tempo_clusters_join_octaves(spark):
    rows = [(0, 1, 120.0, 45), (0, 2, 240.0, 23), (0, 3, 101.0, 18)]
    df = spark.createDataFrame(rows, "track int, rank int, bpm double, votes long")
    found = {r["bpm"]: r["base"] for r in tempo.harmonic_clusters(df).collect()}
    assert found == {120.0: 120.0, 240.0: 120.0, 101.0: 101.0}


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(0, 1, 1.5), (0, 2, 0.1), (0, 3, 9.0), (1, 4, 1.0)], "track int, event_id int, t double")
    right = spark.createDataFrame([(0, 1.0), (0, 2.0)], "track int, t double")
    found = {r["event_id"]: r["right_t"] for r in series.nearest(left, right).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 2.0, 4: None}


def test_hop_windows_are_full_windows(spark):
    df = spark.createDataFrame([(0, i) for i in range(10)], "track int, idx int")
    found = {}
    for r in series.hop_windows(df, "idx", 4, 3, "track").collect():
        found.setdefault(r["start"], []).append(r["idx"])
    assert {k: sorted(v) for k, v in found.items()} == {0: [0, 1, 2, 3], 3: [3, 4, 5, 6], 6: [6, 7, 8, 9]}


def test_vocal_classes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(60.0, 84.0), (41.0, 65.0), (55.0, 55.0), (30.0, 60.0), (20.0, 90.0)], "lo double, hi double")
    found = [r[0] for r in df.select(melody.vocal_class(F.col("lo"), F.col("hi"))).collect()]
    assert found == ["Soprano", "Bass", "Alto", "Instrumental (Extreme Range)", "Instrumental (Wide Range)"]


def test_scaling_levels_keeps_effects(spark):
    rows = [(0, float(i), i, 1.0 + (i * 7 % 5)) for i in range(50)]
    one = spark.createDataFrame(rows, "track int, t double, event_id int, rms double")
    two = one.withColumn("rms", one["rms"] * 3)
    a, b = dynamics.effects(one).first(), dynamics.effects(two).first()
    assert a["compression"] == pytest.approx(b["compression"])


def test_even_onsets_are_regular(spark):
    df = spark.createDataFrame([(0, i, float(i), 1.0) for i in range(20)], "track int, event_id int, t double, value double")
    assert rhythm.regularity(df, df).first()["regularity"] == pytest.approx(1.0)
    assert rhythm.time_signature(df).first()["signature"] == "4/4"


def test_prechorus_runs(spark):
    kinds = ["verse", "pre_chorus", "pre_chorus", "chorus", "pre_chorus", "pre_chorus", "pre_chorus"]
    df = spark.createDataFrame([(0, float(i), i, k, 0.5) for i, k in enumerate(kinds)], "track int, t double, event_id int, type string, energy double")
    found = [r["label"] for r in structure.suppress_prechorus(df).orderBy("seq").collect()]
    assert found == ["verse", "pre_chorus", "verse", "chorus", "verse", "pre_chorus", "chorus"]


def test_novelty_equals_dense_matrix(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(30, 12)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "track int, idx int, v array<double>")
    found = {r["at"]: r["novelty"] for r in structure.novelty(df, 5).collect()}
    s = np.clip(x @ x.T, 0, 1)
    wanted = {i: abs(s[i - 5 : i, i - 5 : i].mean() - s[i : i + 5, i : i + 5].mean()) for i in range(5, 25)}
    top = max(wanted.values())
    assert found == pytest.approx({k: v / top for k, v in wanted.items()})


def test_matrix_blocks_agree_with_one_block(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "vec_id long, v array<double>")
    one = {(r["a"], r["b"]): r["similarity"] for r in similarity.similarity_matrix(df, 100).collect()}
    many = {(r["a"], r["b"]): r["similarity"] for r in similarity.similarity_matrix(df, 7).collect()}
    assert len(one) == 780 and many == pytest.approx(one)


def test_components_are_uncorrelated(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, (rng.normal(size=5) * [5, 3, 1, 1, 1]).tolist()) for i in range(200)], "vec_id long, v array<double>")
    x = np.array([r["scores"] for r in similarity.principal_components(df, 2).collect()])
    assert abs(np.corrcoef(x.T)[0, 1]) < 1e-6 and x[:, 0].std() > x[:, 1].std()


def test_many_targets_agree_with_few(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(60)], "vec_id long, v array<double>")
    one, many = (sorted(map(tuple, similarity.top_k(df, df, similarity.cosine, 3, few).select("target", "rank", "vec_id").collect())) for few in (1000, 7))
    assert one == many and len(one) == 180
