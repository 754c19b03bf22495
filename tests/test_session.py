"""The shared scratch folder: named by the session, private only for a local master."""

import pytest

from annspark import session


class _Context:
    def __init__(self, current=None):
        self.current = current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class _Session:
    def __init__(self, **conf):
        self.settings = {k.replace("__", "."): v for k, v in conf.items()}
        self.sparkContext = _Context()
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_cluster_without_shared_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(_Session(spark__master=master))


def test_cluster_with_shared_folder_uses_it():
    s = _Session(spark__master="yarn", spark__checkpoint__dir="hdfs:///ckpt")
    assert session.checkpoint_dir(s) == "hdfs:///ckpt"


def test_local_master_gets_a_private_folder():
    assert session.checkpoint_dir(_Session(spark__master="local[2]"))
