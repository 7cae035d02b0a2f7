"""Scratch folder rules."""

import os

import pytest

from wattlane import session


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return _Conf()


class _Session:
    sparkContext = _Context()


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(_Session())


@pytest.mark.parametrize("master,local", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_local_masters(master, local):
    assert session.is_local(master) is local


def test_staged_tables_can_be_dropped(spark):
    session.drop_staged(spark)
    df = session.materialize(spark.range(5), "drop-me")
    path = session.local_path(df.inputFiles()[0])
    assert df.count() == 5 and os.path.exists(path)
    assert session.drop_staged(spark) == 1 and not os.path.exists(path)
    assert session.drop_staged(spark) == 0
