"""Weighted likeness of feature vectors by category; loudness and brightness of known spectra."""

import math

from pyspark.sql import functions as F

from cadenza.operators import dynamics as D
from cadenza.operators import similarity as S

RANGES = [(0, 3, 0.05), (3, 11, 0.25), (11, 19, 0.20), (19, 41, 0.20), (41, 51, 0.15), (51, 65, 0.10), (65, 77, 0.10)]


def expected(a, b):
    total = 0.0
    for lo, hi, weight in RANGES:
        if hi > len(a) or hi > len(b):
            continue
        x, y = a[lo:hi], b[lo:hi]
        nx, ny = (math.sqrt(sum(v * v for v in z)) for z in (x, y))
        if nx > 0 and ny > 0:
            total += weight * sum(p * q for p, q in zip(x, y, strict=True)) / (nx * ny)
        else:
            total += weight * all(abs(p - q) <= 1e-8 + 1e-5 * abs(q) for p, q in zip(x, y, strict=True))
    return total


def test_weighted_has_seven_categories(spark):
    one = [math.sin(i) + 1 for i in range(81)]
    two = [math.cos(3 * i) + 1 for i in range(81)]
    gone = [0.0 if 51 <= i < 65 else x for i, x in enumerate(one)]
    pairs = [(one, one), (one, two), (gone, gone), (gone, one), (one[:64], two[:64]), (one, two[:64]), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    found = [r["s"] for r in df.select("i", S.weighted(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert all(abs(x - expected(a, b)) < 1e-9 for x, (a, b) in zip(found, pairs, strict=True)) and abs(found[0] - 1.05) < 1e-9


def test_perceived_loudness(spark):
    rows = [(1, 100.0, 4.0), (2, 2000.0, 4.0), (3, 9000.0, 1.0), (3, 100.0, 9.0), (4, 50.0, 0.0)]
    spectrum = spark.createDataFrame(rows, "track int, freq double, power double")
    found = {r["track"]: r["perceived"] for r in D.perceived_loudness(spectrum).collect()}
    assert abs(found[1] - 0.05) < 1e-9 and found[2] == 1.0 and abs(found[3] - (0.5 + 0.09) / 10 * 5) < 1e-9 and found[4] == 0.01
    peaks = spark.createDataFrame([(1, 0.5), (2, 0.1)], "track int, peak double")
    soft = {r["track"]: r["perceived"] for r in D.perceived_loudness(spectrum, peaks).collect()}
    assert abs(soft[1] - 0.0125) < 1e-9 and abs(soft[2] - 0.05) < 1e-9 and soft[3] == found[3]


def test_brightness(spark):
    rows = [(1, 1000.0), (1, 1000.0), (2, 2400.0), (3, 4000.0), (4, 20000.0), (5, None)]
    found = {r["track"]: r["brightness"] for r in D.brightness(spark.createDataFrame(rows, "track int, x double"), 20000.0).collect()}
    assert abs(found[1] - 0.075) < 1e-9 and found[2] == 0.4 and abs(found[3] - 0.5) < 1e-9 and found[4] == 1.0 and found[5] == 0.5
