"""Repetitions by blocks of time: the same rows as one pair of places at a time, and no row for each cell or list of a track's pairs."""

import numpy as np
import pytest

from cadenza.operators import structure as T


def tracks():
    rng = np.random.default_rng(5)
    out = {1: rng.normal(size=(40, 12)).clip(0), 2: np.tile(rng.normal(size=(9, 12)).clip(0), (4, 1)), 3: np.ones((29, 12)), 4: rng.normal(size=(6, 12)), 5: rng.normal(size=(7, 12))}
    out = {track: v / np.linalg.norm(v, axis=1, keepdims=True) for track, v in out.items()}
    out[1][11] = np.nan
    return out


def wanted(v, length, stride, points, least):
    n, step = len(v), max(1, length // points)
    for i in range(0, n - length, stride):
        for j in range(i + length, min(n - length - 1, i + n // 2) + 1, stride):
            sims = [v[i + k] @ v[j + k] for k in range(0, length, step)]
            mean = np.mean([1.0 if np.isnan(s) else min(1.0, max(0.0, s)) for s in sims])
            if mean > least:
                yield i, j, round(float(mean), 9)


def frames(spark):
    rows = [(track, idx, row.tolist()) for track, v in tracks().items() for idx, row in enumerate(v)]
    return spark.createDataFrame(rows[::-1], "track int, idx int, v array<double>")


@pytest.mark.parametrize(("length", "stride", "points"), [(6, 1, 6), (5, 2, 2)])
def test_pairs_of_blocks_are_pairs_of_places(spark, length, stride, points):
    every = sorted((track, *row) for track, v in tracks().items() for row in wanted(v, length, stride, points, 0.45))
    assert len(every) > 50
    for size in (7, 512):
        found = T.repetition_pairs(frames(spark), length, stride, points, 0.45, size)
        assert found.dtypes == [("track", "int"), ("i", "int"), ("j", "int"), ("similarity", "double")]
        assert sorted((r["track"], r["i"], r["j"], round(r["similarity"], 9)) for r in found.collect()) == every


def test_kept_ones_are_those_of_a_loop(spark):
    kept = []
    for track, v in tracks().items():
        used = set()
        for i, j, s in sorted(wanted(v, 6, 1, 6, 0.45), key=lambda x: (-x[2], x[0], x[1])):
            if all(abs(u - at) >= 6 for u in used for at in (i, j)):
                kept.append((track, i, j, s))
                used |= {i, j}
    found = T.without_overlap(T.repetition_pairs(frames(spark), 6, 1, 6, 0.45, 7), 6)
    assert sorted((r["track"], r["i"], r["j"], round(r["similarity"], 9)) for r in found.collect()) == sorted(kept)


def test_no_row_for_a_cell_and_no_list_of_pairs(spark):
    pairs = T.repetition_pairs(frames(spark), 6, 1, 6, 0.45)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence(0, 5" not in plan
    given = spark.createDataFrame([(1, 0, 9, 0.5)], pairs.schema)
    assert "collect_list" not in T.without_overlap(given, 6)._jdf.queryExecution().executedPlan().toString()


def test_no_frames(spark):
    none = frames(spark).filter("track is null")
    assert T.without_overlap(T.repetition_pairs(none, 6, 1, 6, 0.45), 6).collect() == []
