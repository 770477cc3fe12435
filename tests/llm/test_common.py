from types import SimpleNamespace

import pytest

from grainmill.llm import _common


def test_no_machine_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError):
            _common.shared_folder(SimpleNamespace(sparkContext=sc))


def test_tables_are_discarded(spark):
    work = _common.Workspace(spark)
    a, b = work.stored(spark.range(5), "a"), work.stored(spark.range(7), "b")
    work.discard("a", "nothing")
    assert b.count() == 7
    with pytest.raises(Exception):
        a.count()
