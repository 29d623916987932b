"""The shared folder and the tables written there."""

from types import SimpleNamespace

import pytest

from cadenza import session


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_scratch_tables_are_deleted(spark, tmp_path):
    kept = session.materialise(spark.range(3), "kept")
    with session.scratch(spark):
        session.materialise(spark.range(5), "gone").write.parquet(f"{tmp_path}/out")
        gone = session._written[-1]
    assert kept.count() == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)
