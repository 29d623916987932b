"""Thinning of peaks: as comparing each with all kept ones, in a time that grows with the peaks."""

import time

import numpy as np

from cadenza.operators.series import thinned


def test_thinning_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        at = np.sort(rng.choice(300, 80, replace=False))
        x = rng.integers(0, 12, 80).astype(float)
        kept = []
        for i in sorted(range(80), key=lambda i: (-x[i], at[i])):
            if all(abs(at[i] - at[j]) >= 5 for j in kept):
                kept.append(i)
        assert thinned(at, x, 5).tolist() == sorted(kept)
    assert thinned(np.zeros(0, int), np.zeros(0), 5).tolist() == []


def test_many_peaks_take_linear_time():
    at = np.arange(0, 2_000_000, 4)
    began = time.monotonic()
    assert len(thinned(at, np.random.default_rng(1).random(len(at)), 5)) > 100_000
    assert time.monotonic() - began < 20
