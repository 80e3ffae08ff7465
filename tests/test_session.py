"""The shared folder: refused where it would be one machine's, emptied at the end."""

import os
from types import SimpleNamespace

import pytest

from lexmill import session


def _fake(master, named=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: named, set=lambda k, v: None),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)),
    )


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            session.shared_dir(_fake(master))
        assert session.shared_dir(_fake(master, "/shared")) == "/shared"
    for master in ("local", "local[*]", "local[4]"):
        assert os.path.isdir(session.shared_dir(_fake(master)))


def test_tables_are_deleted(spark):
    t = session.materialise(spark.range(5), "numbers")
    assert t.count() == 5
    own = session.own_dir(spark)
    assert os.listdir(own)
    session.release(spark)
    assert not os.path.exists(own)
