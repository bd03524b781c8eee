from types import SimpleNamespace

import pytest

from fathomline import session


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_written_tables_lie_below_the_application(spark):
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.applicationId in df.inputFiles()[0]


def test_broadcast_is_bounded_by_bytes(spark):
    df = session.materialize(spark.createDataFrame([(1, "a" * 1000), (2, None)], "id int, text string"))
    assert session.broadcast_below(df, 900) is df and session.broadcast_below(df, 100_000) is not df
    empty = df.where("false")
    assert session.broadcast_below(empty, 0) is not empty
