"""The folder for written tables."""

from types import SimpleNamespace

import pytest

from readweave import session


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    fake = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        session.shared_folder(fake)


def test_written_tables_can_be_removed(spark):
    table = session.written(spark.range(5), "test")
    assert table.count() == 5
    session.remove(table)
    assert not list(spark.sparkContext._jvm.java.io.File(table.written_to.removeprefix("file:")).list() or [])
    session.remove(spark.range(1))  # not ours: nothing happens
