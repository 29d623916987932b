"""Best paths of many short tracks: as with blocks, and without a group of the plan per track."""

import numpy as np

from cadenza.operators import scan


def test_short_tracks_equal_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(t, f, rng.integers(0, 4, 7).astype(float).tolist()) for t in [*range(40), None] for f in range(1 + (t or 3) % 9)]
    df = spark.createDataFrame(rows, "track long, frame long, v array<double>").repartition(5)
    one, many = (sorted(map(str, scan.best_path(df, 0.5, size).collect())) for size in (4096, 2))
    assert one == many and len(one) == len(rows)


def test_short_tracks_are_not_groups(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0])], "track long, frame long, v array<double>")
    assert "MapInArrow" in scan.best_path(df, 0.5)._jdf.queryExecution().executedPlan().toString()
