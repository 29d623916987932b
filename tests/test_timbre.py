"""Timbre scores against numpy on whole matrices, and pitch curves without octave jumps."""

import numpy as np
import pytest

from cadenza.operators import melody, timbre


def test_scores_equal_whole_matrices(spark):
    rng = np.random.default_rng(1)
    rms, flat, band = rng.random(40) / 10, rng.random(40), rng.random(40) * 4000
    mfcc, chroma, contrast = rng.normal(size=(13, 40)) * 5 - 3, rng.random((12, 40)), rng.random((7, 40)) * 40
    frames = spark.createDataFrame([("a", *map(float, r)) for r in zip(rms, flat, band, strict=True)] + [("one", 0.5, 0.1, 100.0)], "track string, rms double, flatness double, bandwidth double")
    table = lambda m, name: spark.createDataFrame([("a", k, float(v)) for k, row in enumerate(m) for v in row], f"track string, {name} int, v double")
    m, c, b = table(mfcc, "k"), table(chroma, "pc"), table(contrast, "band")
    found = {r.track: r for r in timbre.texture(frames, m, c, b).collect()}
    a = found["a"]
    assert a.smoothness == pytest.approx(1 - flat.mean()) and a.richness == pytest.approx(band.mean() / 5000) and a.clarity == pytest.approx(min(1, contrast.mean() / 30))
    assert a.fullness == pytest.approx(min(1, rms.mean() * 10)) and a.spectral_complexity == pytest.approx(min(1, mfcc.std() / 10)) and a.harmonic_richness == pytest.approx(chroma.std() / 2)
    assert a.temporal_stability == pytest.approx(1 - rms.std() / (rms.mean() + 1e-8)) and a.timbral_consistency == pytest.approx(1 - mfcc.std(axis=1).mean() / 10)
    assert found["one"].temporal_stability == found["one"].timbral_consistency == 1 and found["one"].clarity == 0
    low = mfcc[1:4].mean()
    base = min(1, 1 / (1 + np.exp(-low)) + (0.2 if mfcc[4:8].mean() > -5 else 0))
    assert timbre.warmth(m).first().warmth == pytest.approx(0.3 + base * 0.4 if base < 0.3 else base)
    assert {r.track: r.density for r in timbre.density(frames).collect()}["a"] == pytest.approx((flat.mean() + min(1, rms.mean() * 5)) / 2)
    assert timbre.texture(frames.limit(0), m.limit(0), c.limit(0), b.limit(0)).count() == 0


def test_octave_jumps_and_rests(spark):
    midi = [60] * 20 + [48] + [60] * 5 + [None] * 3 + [62] * 10 + [74] + [62] * 10
    rows = [("a", i, None if m is None else 440 * 2 ** ((m - 69) / 12)) for i, m in enumerate(midi)]
    found = sorted(melody.tracked_pitch(spark.createDataFrame(rows, "track string, frame long, f0 double")).collect(), key=lambda r: r.frame)
    wanted = [60] * 26 + [None] * 3 + [62] * 21
    assert [r.midi for r in found] == wanted and found[-1].f0 == pytest.approx(440 * 2 ** (-7 / 12))
