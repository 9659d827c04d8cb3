"""Scratch-folder policy: the session's spark.checkpoint.dir, never a
machine-local folder on a cluster."""

import pytest

from sluice import session


class _Conf:
    def __init__(self, d):
        self.d = d

    def get(self, k, default=None):
        return self.d.get(k, default)

    def set(self, k, v):
        self.d[k] = v


class _SC:
    def __init__(self):
        self.dir = None

    def getConf(self):
        return _Conf({})

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, conf):
        self.conf = _Conf(dict(conf))
        self.sparkContext = _SC()


def test_uses_the_configured_shared_folder():
    s = _Spark({"spark.checkpoint.dir": "hdfs://nn/shared/ckpt/", "spark.master": "yarn"})
    assert session.ensure_checkpoint_dir(s) == "hdfs://nn/shared/ckpt"
    assert session.scratch_path(s, "x").startswith("hdfs://nn/shared/ckpt/sluice/x-")


def test_cluster_without_setting_fails():
    with pytest.raises(RuntimeError, match="shared storage"):
        session.ensure_checkpoint_dir(_Spark({"spark.master": "k8s://api"}))


def test_local_run_gets_its_own_folder():
    s = _Spark({"spark.master": "local[2]"})
    d = session.ensure_checkpoint_dir(s)
    assert d and s.sparkContext.dir == d and session.ensure_checkpoint_dir(s) == d
