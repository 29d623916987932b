"""Signals: block recurrences against plain loops, and known sounds."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import scan
from cadenza.operators import signal as G
from cadenza.sources import audio

RATE = 22_050
FRAME_RATE = RATE / 512


def series(spark, tracks):
    return spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track string, frame long, x double")


def values(df, column="x"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.track, r.frame)):
        out.setdefault(r.track, []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def loop(b, a, x):
    z, out = list(scan.Linear(b, a, 1).steady * x[0]), []
    for v in x:
        y = b[0] * v + z[0]
        z = [(z[i + 1] if i + 1 < len(z) else 0) + b[i + 1] * v - a[i + 1] * y for i in range(len(z))]
        out.append(y)
    return np.array(out)


def test_highpass_equals_a_loop_over_block_edges(spark):
    b, a = scan.highpass(4, 0.05)
    assert sum(b) == pytest.approx(0, abs=1e-12)  # nothing constant passes
    assert abs(np.polyval(b, -1) / np.polyval(a, -1)) == pytest.approx(1)  # the highest frequency does
    w = np.exp(1j * np.pi * 0.05)
    assert abs(np.polyval(b, w) / np.polyval(a, w)) == pytest.approx(0.5**0.5)
    rng = np.random.default_rng(1)
    tracks = {"a": rng.normal(size=1000), "b": rng.normal(size=333), "c": [1.0], "d": rng.normal(size=8), "e": np.full(200, 3.0)}
    found = values(scan.both_ways(series(spark, tracks), b, a, size=64))
    for t, x in tracks.items():
        x, p = np.asarray(x), min(15, len(x) - 1)
        long = np.concatenate([2 * x[0] - x[1 : p + 1][::-1], x, 2 * x[-1] - x[len(x) - 1 - p : len(x) - 1][::-1]])
        wanted = loop(b, a, loop(b, a, long)[::-1])[::-1][p : len(long) - p]
        assert np.abs(found[t] - wanted).max() < 1e-9
    assert np.abs(found["e"]).max() < 1e-9
    low, high = (np.sin(2 * np.pi * f * np.arange(4000) / RATE) for f in (20, 1000))
    b, a = scan.highpass(4, 80 / (RATE / 2))
    kept = values(scan.both_ways(series(spark, {"low": low, "high": high}), b, a))
    assert np.abs(kept["low"])[600:-600].max() < 0.02 and np.abs(kept["high"] - high)[600:-600].max() < 0.02


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_best_path_equals_every_path(spark, size):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(5, 3))
    ways = np.stack(np.meshgrid(*[range(3)] * 5, indexing="ij"), -1).reshape(-1, 5)
    total = v[np.arange(5), ways].sum(axis=1) - 0.7 * np.abs(np.diff(ways, axis=1)).sum(axis=1)
    df = spark.createDataFrame([("a", i, v[i].tolist()) for i in range(5)] + [("b", 0, [0.0, 2.0, 1.0])], "track string, frame long, v array<double>")
    found = values(scan.best_path(df, 0.7, size), "state")
    assert found["a"].tolist() == ways[total.argmax()].tolist() and found["b"].tolist() == [1]


def test_octave_jumps_of_a_pitch_vanish(spark):
    rng = np.random.default_rng(3)
    true = np.repeat([20, 22, 24, 20], 50)
    heard = np.where(rng.random(200) < 0.15, true - 12, true)  # an octave below now and then
    v = [(np.where(np.arange(36) == h, 1.0, 0.0) + np.where(np.arange(36) == t, 0.5, 0.0)).tolist() for h, t in zip(heard, true, strict=True)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "track string, frame long, v array<double>")
    assert (heard != true).sum() > 20
    assert values(scan.best_path(df, 0.2, 64), "state")["a"].tolist() == true.tolist()


def burst_curve(bpm, seconds, rate, low=0.0):
    x = np.full(int(seconds * rate), low)
    x[np.rint(np.arange(0.25, seconds - 0.1, 60 / bpm) * rate).astype(int)] = 1.0
    return x


@pytest.mark.parametrize("size", [128, 4096])
def test_beats_of_bursts(spark, size):
    rng = np.random.default_rng(4)
    tracks = {"plain": burst_curve(120, 20, 100), "noise": burst_curve(120, 20, 100) + 0.2 * rng.random(2000), "still": np.zeros(500), "one": [1.0]}
    gap = burst_curve(120, 20, 100)
    gap[800:1000] = 0  # four bursts are missing
    tracks["gap"] = gap
    df = series(spark, tracks)
    found = values(G.beats(df, df.select("track").distinct().withColumn("bpm", F.lit(120.0)), 100.0, size=size), "t")
    assert set(found) == {"plain", "noise", "gap"}
    for t in found:
        assert len(found[t]) == 40 and np.abs(found[t] - np.arange(0.25, 19.9, 0.5)).max() <= 0.02


def test_blocks_do_not_change_beats(spark):
    rng = np.random.default_rng(5)
    df = series(spark, {"a": rng.random(700) ** 4, "b": rng.random(90)})
    tempi = spark.createDataFrame([("a", 130.0), ("b", 95.0)], "track string, bpm double")
    one, other = ({(r.track, r.frame) for r in G.beats(df, tempi, 43.0, size=s).collect()} for s in (50, 4096))
    assert one == other and one


def test_frame_tempi_do_not_depend_on_blocks(spark):
    x = burst_curve(120, 30, 43.0664, 0.01)
    df = series(spark, {"a": x, "b": x[:200], "c": [0.0, 0.0], "d": [1.0]})
    one, other = (sorted(map(tuple, G.frame_tempi(df, 43.0664, size=s).collect())) for s in (100, 4096))
    assert one == other and len(one) == len(x) + 203
    middle = [b for t, f, b in one if t == "a" and 300 < f < 900]
    assert abs(np.median(middle) - 120) < 4


def test_tempo_and_beats_of_a_file(spark, tmp_path):
    x = np.zeros(20 * RATE)
    for k in range(40):
        at = k * RATE // 2
        x[at : at + 1100] = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(1100) / RATE) * np.hanning(1100)
    with io.BytesIO() as out:
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(RATE)
            f.writeframes((x * 32767).astype("<i2").tobytes())
        (tmp_path / "bursts.wav").write_bytes(out.getvalue())
    onsets = audio.frames(spark, str(tmp_path)).select(F.col("path").alias("track"), F.col("frame").cast("long").alias("frame"), F.col("onset").alias("x"))
    found = G.detected_tempo(onsets, FRAME_RATE).first()
    assert min(abs(found.bpm - m * 120) for m in (0.5, 1, 2)) < 8 and found.confidence > 50
    tempi = onsets.select("track").distinct().withColumn("bpm", F.lit(120.0))
    times = sorted(r.t for r in G.beats(onsets, tempi, FRAME_RATE).collect())
    assert len(times) >= 36 and abs(np.diff(times).mean() - 0.5) < 0.01 and max(abs(t - round(t * 2) / 2) for t in times) < 0.06


@pytest.mark.parametrize("size", [7, 4096])
def test_autocorrelation_equals_numpy(spark, size):
    rng = np.random.default_rng(6)
    tracks = {"a": rng.normal(size=100), "b": rng.normal(size=30), "c": [2.0]}
    every = {(r.track, r.lag): r.r for r in G.autocorrelation(series(spark, tracks), size=size).collect()}
    some = {(r.track, r.lag): r.r for r in G.autocorrelation(series(spark, tracks), most=9, size=size).collect()}
    for t, x in tracks.items():
        wanted = np.correlate(x, x, "full")[len(x) - 1 :]
        assert [every[t, k] for k in range(len(x))] == pytest.approx(list(wanted))
    assert some == pytest.approx({k: v for k, v in every.items() if k[1] <= 9})


def test_peaks_are_thinned_from_the_highest(spark):
    y = [0, 5, 0, 9, 0, 6, 0, 0, 0, 2, 0, 7, 0, 7, 0]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "track string, at long, y double")
    for size in (4, 4096):
        assert sorted(r["at"] for r in G.peaks(df, "at", "y", 0.3, 3, size).collect()) == [3, 13]
        assert sorted(r["at"] for r in G.peaks(df, "at", "y", 0.0, 2, size).collect()) == [1, 3, 5, 9, 11, 13]


def test_vibrato(spark):
    t = np.arange(100) / 50
    tracks = {"five": 440 * (1 + 0.02 * np.sin(2 * np.pi * 5 * t)), "flat": np.full(100, 440.0), "short": 440 + np.arange(19.0)}
    found = {r.track: r for r in G.vibrato(series(spark, tracks)).collect()}
    assert found["five"].rate == pytest.approx(5, abs=0.5) and found["five"].extent == pytest.approx(0.02 / 2**0.5, abs=0.002)
    assert found["flat"].rate == found["short"].rate == found["short"].extent == 0


def test_polyrhythm_and_reverb(spark):
    three_four = np.zeros(600)
    three_four[::16] += 1
    three_four[::12] += 1
    plain = np.zeros(600)
    plain[::200] = 1
    dry, wet = np.zeros(400), np.zeros(400)
    dry[::100] = 1
    wet = np.convolve(dry, np.exp(-np.arange(400) / 60))[:400] + 0.1
    found = {r.track: r for r in G.polyrhythm(series(spark, {"3:4": three_four, "plain": plain, "short": [1.0] * 50})).collect()}
    assert found["3:4"].polyrhythm and not found["plain"].polyrhythm and not found["short"].polyrhythm
    room = {r.track: r.reverb for r in G.reverb(series(spark, {"dry": dry, "wet": wet, "short": [1.0] * 9, "silent": [0.0] * 50})).collect()}
    assert room["wet"] > room["dry"] and room["short"] == room["silent"] == 0.2


def test_a_click_and_a_tone_part(spark):
    s = np.full((60, 48), 0.01)
    s[:, 10] = 5.0  # a tone lasts
    s[30, :] = 5.0  # a click spreads
    df = spark.createDataFrame([("a", i, j, float(s[i, j])) for i in range(60) for j in range(48)], "track string, frame long, bin long, power double")
    for size in (25, 4096):
        h, p = np.zeros_like(s), np.zeros_like(s)
        for r in G.parted(df, size=size).collect():
            h[r.frame, r.bin], p[r.frame, r.bin] = r.harmonic, r.percussive
        assert h[5, 10] > 4.9 and p[5, 10] < 0.1 and p[30, 40] > 4.9 and h[30, 40] < 0.1
    tiny = spark.createDataFrame([("a", i, j, 1.0) for i in range(2) for j in range(3)], "track string, frame long, bin long, power double")
    assert {round(r.harmonic, 6) for r in G.parted(tiny).collect()} == {0.1}  # lines shorter than the kernel are turned over as often as needed


def test_contrast_and_tonnetz(spark):
    s = np.ones((2, 128))
    s[1, ::8] = 100.0
    df = spark.createDataFrame([("a", i, j, float(s[i, j])) for i in range(2) for j in range(128)], "track string, frame long, bin long, power double")
    found = {(r.frame, r.band): r.contrast for r in G.spectral_contrast(df, 128, 11025.0).collect()}
    assert {k[1] for k in found} == set(range(7)) and all(v == 0 for k, v in found.items() if k[0] == 0) and found[1, 6] == pytest.approx(20)
    chroma = spark.createDataFrame([("a", 0, pc, 1.0 if pc == 7 else 0.0) for pc in range(12)] + [("a", 1, pc, 0.0) for pc in range(12)] + [("a", 2, pc, 1.0) for pc in range(12)], "track string, frame long, pc int, v double")
    axes = {(r.frame, r.axis): r.v for r in G.tonnetz(chroma).collect()}
    assert [axes[0, k] for k in range(6)] == pytest.approx([np.sin(7 * np.pi * 7 / 6), np.cos(7 * np.pi * 7 / 6), np.sin(7 * np.pi * 1.5), np.cos(7 * np.pi * 1.5), 0.5 * np.sin(7 * np.pi * 2 / 3), 0.5 * np.cos(7 * np.pi * 2 / 3)])
    assert all(axes[f, k] == pytest.approx(0, abs=1e-12) for f in (1, 2) for k in range(6))


def test_no_rows(spark):
    none = series(spark, {"a": [1.0]}).limit(0)
    b, a = scan.highpass(2, 0.1)
    tempi = spark.createDataFrame([], "track string, bpm double")
    for df in (scan.both_ways(none, b, a), G.autocorrelation(none), G.frame_tempi(none, 40.0), G.beats(none, tempi, 40.0), G.polyrhythm(none), G.reverb(none), G.vibrato(none)):
        assert df.count() == 0
