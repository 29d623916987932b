"""Characteristics and endings of sections, and novelty against dense matrices."""

import numpy as np
import pytest

from cadenza.operators import passages as A
from cadenza.operators import structure as T

FRAMES = "track string, t double, frame long, rms double, zcr double, centroid double, rolloff double, bandwidth double, f0 double, harmonic double, onset boolean"


def frames(spark, rows):
    base = {"rms": 0.5, "zcr": 0.05, "centroid": 2000.0, "rolloff": 4000.0, "bandwidth": 900.0, "f0": None, "harmonic": 0.2, "onset": False}
    return spark.createDataFrame([("a", float(t), i, *(float(v) if isinstance(v, np.floating) else v for v in (base | r).values())) for i, (t, r) in enumerate(rows)], FRAMES)


def sections(spark, *rows):
    return spark.createDataFrame([("a", i, float(s), float(e), kind, float(x)) for i, (s, e, kind, x) in enumerate(rows)], "track string, seq long, start double, end double, type string, energy double")


@pytest.mark.parametrize("bucket", [0.7, 4.0, 1000.0])
def test_jumps_do_not_depend_on_buckets(spark, bucket):
    rng = np.random.default_rng(1)
    st = rng.integers(-12, 12, 300) * 0.9
    voiced = rng.random(300) < 0.6
    rows = [(i * 0.1, {"f0": float(440 * 2 ** (s / 12)) if v else None}) for i, (s, v) in enumerate(zip(st, voiced, strict=True))]
    held = A.within(sections(spark, (0, 10, "verse", 0), (10, 30, "chorus", 0)), frames(spark, rows), bucket)
    found = {r.seq: r.jump_rate for r in A.jump_rates(held).collect()}
    for seq, part in enumerate((slice(0, 100), slice(100, 300))):
        kept = st[part][voiced[part]]
        assert found[seq] == pytest.approx((np.abs(np.diff(kept)) > 2).mean())


def test_characteristics(spark):
    quiet = {"rms": 0.1, "zcr": 0.25, "bandwidth": 500.0, "harmonic": 0.0}
    rows = [(i, {"onset": i % 2 == 0}) for i in range(10)] + [(10 + i, quiet) for i in range(10)]
    found = A.characteristics(sections(spark, (0, 10, "chorus", 0), (10, 20, "verse", 0), (50, 60, "outro", 0), (70, 70, "outro", 0)), frames(spark, rows))
    one, two, none, empty = sorted(found.collect(), key=lambda r: r.seq)
    assert one.energy == pytest.approx(0.25) and one.rhythm_density == pytest.approx(0.05) and one.vocal_presence and not one.is_spoken
    assert one.voiced_ratio == pytest.approx(1.0) and one.harmonic_content == pytest.approx(0.8) and one.complexity == pytest.approx(0.45) and one.first_peak == 5
    assert two.is_spoken and not two.vocal_presence and two.voiced_ratio == pytest.approx(0.3)
    assert none.energy == empty.energy == 0 and not none.is_spoken and none.rhythm_density == 0


def test_fades_and_resolutions(spark):
    parts = sections(spark, (0, 86, "verse", 0.8), (86, 100, "verse", 0.8), (100, 100.5, "verse", 0.1))
    fading = frames(spark, [(t, {"rms": 0.5 * 10 ** (-(t - 85) / 10) if t >= 85 else 0.5}) for t in np.arange(0, 100, 0.5)])
    steady = frames(spark, [(t, {}) for t in np.arange(0, 100, 0.5)])
    busy = frames(spark, [(t, {"zcr": 0.3}) for t in np.arange(0, 100, 0.5)])
    tonic, spread = ([("a", float(t), t, pc, 1.0 if pc == 0 else other) for t in range(100) for pc in range(12)] for other in (0.3, 0.9))
    tonic, spread = (spark.createDataFrame(x, "track string, t double, frame long, pc int, v double") for x in (tonic, spread))

    def found(f, c, s=parts):
        return {r.seq: (r.fade, r.resolves, r.label, r.confidence) for r in A.endings(s, f, c).collect()}

    assert found(fading, spread) == {1: (True, False, "outro", 0.8), 2: (False, False, "verse", None)}
    assert found(steady, spread)[1] == (False, False, "verse", None)
    assert found(busy, spread)[1][0]  # almost nothing voiced
    assert found(steady, tonic)[1] == (False, True, "verse", None)  # too loud to close
    soft = sections(spark, (0, 86, "verse", 0.8), (86, 100, "verse", 0.3))
    assert found(steady, tonic, soft) == {1: (False, True, "outro", 0.6)}


def unit(rng, n, d=6):
    v = np.abs(rng.normal(size=(n, d)))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("size", [7, 256])
def test_novelty_equals_the_dense_matrix(spark, size):
    rng = np.random.default_rng(2)
    tracks = {"a": unit(rng, 70), "b": unit(rng, 9), "c": unit(rng, 1)}
    df = spark.createDataFrame([(t, i, x.tolist()) for t, v in tracks.items() for i, x in enumerate(v)], "track string, frame long, v array<double>")
    k = 5
    found = {(r.track, r.frame): (r.change, r.board) for r in T.block_contrast(df, k, size).collect()}
    for t, v in tracks.items():
        s = np.clip(v @ v.T, 0, 1)
        for i in range(len(v)):
            change = board = 0.0
            if k <= i < len(v) - k:
                before, after, cross = s[i - k : i, i - k : i], s[i : i + k, i : i + k], s[i - k : i, i : i + k]
                change, board = abs(before.mean() - after.mean()), (before.sum() + after.sum() - 2 * cross.sum()) / (4 * k * k)
            assert found[t, i] == pytest.approx((change, board), abs=1e-9)


def test_a_change_of_material_is_a_peak(spark):
    v = np.zeros((80, 4))
    v[:40, 0] = 1
    v[40:, 1:] = np.random.default_rng(3).random((40, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], "track string, frame long, v array<double>")
    board = {r.frame: r.novelty for r in T.board_novelty(df, 8).collect()}
    assert max(board, key=board.get) == 40 and board[40] == 1
    both = {r.frame: r.novelty for r in T.multi_scale_novelty(df).collect()}
    assert max(both.values()) == 1 and len(both) == 80


def test_gaussian_turns_ends_over(spark):
    x = np.random.default_rng(4).random(12)
    df = spark.createDataFrame([("a", i, float(y)) for i, y in enumerate(x)] + [("b", 0, 2.0)], "track string, frame long, x double")
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    wanted = np.convolve(np.pad(x, 8, mode="symmetric"), w / w.sum(), "valid")
    found = {(r.track, r.frame): r.x for r in T.gaussian(df, "x").collect()}
    assert [found["a", i] for i in range(12)] == pytest.approx(list(wanted)) and found["b", 0] == pytest.approx(2.0)
