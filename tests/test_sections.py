"""Passes over bounded sections on small cases: nulls, ties, one section, empty tables, extra columns."""

import pytest

from cadenza.operators import sections as S

KIND = "track string, seq long, start double, end double, type string, energy double, complexity double, density double, flux double, brightness double, label_old string"


def make(spark, *rows):
    full = [("a", i, float(s), float(e), kind, energy, complexity, None, flux, bright, "x") for i, (s, e, kind, energy, complexity, flux, bright) in enumerate(rows)]
    return spark.createDataFrame(full, KIND)


def labels(df):
    return [r["label"] for r in sorted(df.collect(), key=lambda r: r["seq"])]


def test_refined(spark):
    df = make(spark, (0, 9, "outro", 0.9, 0.1, 0.2, 0.0), (9, 20, "outro", 0.2, 0.7, 0.2, 0.0), (20, 30, "outro", 0.2, 0.1, 0.2, 0.0), (30, 40, "outro", 0.9, 0.1, None, 0.0),
              (40, 50, "bridge", 0.5, 0.3, 0.0, 0.0), (50, 60, "instrumental", 0.3, 0.3, 0.0, 0.0), (60, 80, "instrumental", 0.5, 0.6, 0.0, 0.0), (80, 90, "instrumental", None, None, None, None), (90, 99, None, 0.1, 0.1, 0.0, 0.0))
    assert labels(S.refined(df)) == ["chorus", "bridge", "verse", "outro", "verse", "breakdown", "interlude", "solo", None]


def test_hooks_need_brightness_only_where_known(spark):
    df = make(spark, (0, 8, "verse", 0.7, 0.5, 0.0, None), (8, 16, "verse", 0.7, 0.5, 0.0, 0.5), (16, 22, "bridge", 0.7, 0.5, 0.0, 0.7), (22, 33, "verse", 0.7, 0.5, 0.0, 0.0), (33, 40, "outro", 0.7, 0.5, 0.0, 0.0))
    assert labels(S.chorus_hooks(df)) == ["chorus", "verse", "chorus", "verse", "outro"]


def test_endings(spark):
    df = make(spark, (0, 30, "bridge", 0.6, 0.9, 0.0, 0.0), (30, 40, "bridge", 0.6, 0.9, 0.0, 0.0), (40, 80, "bridge", 0.5, 0.7, 0.0, 0.0), (80, 85, "bridge", 0.1, None, 0.0, 0.0))
    assert labels(S.endings(df, 120.0)) == ["bridge", "pre_chorus", "verse", "outro"]


def test_merged_types(spark):
    df = make(spark, (0, 10, "verse", 0.5, 0.5, 0.0, 0.0), (10, 20, "bridge", 0.5, 0.5, 0.0, 0.0), (20, 50, "intro", 0.5, 0.5, 0.0, 0.0), (50, 55, "instrumental", 0.5, 0.5, 0.0, 0.0), (55, 62, "chorus", 0.5, 0.5, 0.0, 0.0), (62, 70, "spoken", 0.5, 0.5, 0.0, 0.0))
    assert labels(S.neighbours(df)) == ["bridge", "intro", "intro", "chorus", "chorus"]


def test_same_type_runs(spark):
    df = make(spark, (0, 10, "verse", 0.2, 0.5, 0.0, 0.0), (10, 40, "verse", 0.6, 0.5, 0.0, 0.0), (40, 40, None, 0.5, 0.5, 0.0, 0.0), (40, 40, None, 0.7, 0.5, 0.0, 0.0), (40, 50, "verse", 0.5, 0.5, 0.0, 0.0))
    rows = sorted(S.same_type_runs(df).collect(), key=lambda r: r["seq"])
    assert [(r["seq"], r["type"], r["n"], r["start"], r["end"], round(r["energy"], 6)) for r in rows] == [(0, "verse", 2, 0.0, 40.0, 0.5), (1, None, 2, 40.0, 40.0, 0.6), (2, "verse", 1, 40.0, 50.0, 0.5)]


def test_chords_and_summary(spark):
    df = make(spark, (0, 10, "verse", 0.5, 0.5, 0.0, 0.0), (10, 10.5, "chorus", 0.5, 0.5, 0.0, 0.0), (10.5, 20, "odd", 0.5, 0.5, 0.0, 0.0))
    chords = spark.createDataFrame([("a", float(t), c) for t, c in enumerate("CGAFD")] + [("a", 10.2, "C"), ("b", 1.0, "C")], "track string, t double, chord string")
    assert [r["chords"] for r in S.section_chords(df, chords).orderBy("seq").collect()] == ["C → G → A → F", "Unknown", "Unknown"]
    text = S.summary(df).collect()[0]["summary"].split("\n")
    assert text[0] == "Section List (Estimated 3 sections)"
    assert text[1:] == ["   1. Verse   (A-melo)    0.0s -   10.0s ( 10.0s)", "   2. Chorus  (Sabi)   10.0s -   10.5s (  0.5s)", "   3. Odd     (odd)   10.5s -   20.0s (  9.5s)"]


def test_scale_trim_and_defaults(spark):
    silent = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, None)], "track string, t double, rms double")
    assert tuple(S.energy_scale(silent).collect()[0])[1:] == (0.0, 0.05, 0.025, 0.05)
    long = spark.createDataFrame([("a", float(t), 1.0) for t in range(401)] + [("b", 0.0, 1.0), ("b", 180.0, 1.0)], "track string, t double, rms double")
    kept = {k: sorted(r["t"] for r in S.trimmed(long).filter(f"track = '{k}'").collect()) for k in "ab"}
    assert (min(kept["a"]), max(kept["a"]), kept["b"]) == (100.0, 279.0, [0.0, 180.0])
    tracks = spark.createDataFrame([("a",), ("b",), ("c",)], "track string")
    kind = "track string, key string, mode string, confidence double, key_strength double"
    found, other = spark.createDataFrame([("a", "D", "Minor", 70.0, 0.5), ("b", None, None, 1.0, 0.0)], kind), spark.createDataFrame([("b", "E", "Major", 30.0, 0.4)], kind)
    assert [tuple(r) for r in S.key_or_default(tracks, found, other).orderBy("track").collect()] == [("a", "D", "Minor", 70.0, 0.5), ("b", "E", "Major", 30.0, 0.4), ("c", "C", "Major", 5.0, 0.1)]


def test_unknown_keys_give_way(spark):
    kind = "track string, key string, mode string, confidence double, key_strength double"
    found = spark.createDataFrame([(t, "Unknown(D?)", "Unknown", 9.0, 0.2) for t in "ab"] + [("c", "A", "Minor", 80.0, 0.6)], kind)
    other = spark.createDataFrame([("a", "E", "Major", 30.0, 0.4), ("b", "Unknown(F?)", "Unknown", 3.0, 0.1), ("c", "G", "Major", 99.0, 0.9)], kind)
    assert [tuple(r) for r in S.key_or_default(found, found, other).orderBy("track").collect()] == [("a", "E", "Major", 30.0, 0.4), ("b", "C", "Major", 5.0, 0.1), ("c", "A", "Minor", 80.0, 0.6)]


def test_key_names(spark):
    rows = [("a", "Unknown(D?)", "Unknown", 9.0), ("b", "None", "Unknown", 0.0), ("c", None, None, 1.0), ("d", "F#", "Minor", 70.0)]
    named = S.key_names(spark.createDataFrame(rows, "track string, key string, mode string, confidence double"))
    assert [tuple(r) for r in named.orderBy("track").collect()] == [("a", "C Major", 9.0), ("b", "C Major", 0.0), ("c", "C Major", 1.0), ("d", "F# Minor", 70.0)]


def test_key_changes_need_a_settled_key_and_a_sure_one(spark):
    seen = [("C", 50.0), ("G", 90.0), ("C", 50.0), ("G", 10.0), ("G", 40.0), ("D", 80.0), ("G", 30.0), ("D", 80.0)]
    df = spark.createDataFrame([("a", i, k, c) for i, (k, c) in enumerate(seen)], "track string, seq long, key string, confidence double")
    rows = sorted(S.key_changes(df).collect(), key=lambda r: r["seq"])
    assert [(r["seq"], r["from_key"], r["to_key"], r["confidence"], r["difference"]) for r in rows] == [(4, "C", "G", 0.4, 30.0), (7, "G", "D", 0.8, 50.0)]


@pytest.mark.parametrize("run", [S.refined, S.chorus_hooks, S.endings, S.neighbours, S.same_type_runs, S.summary])
def test_empty_sections(spark, run):
    assert run(spark.createDataFrame([], KIND)).count() == 0
