from types import SimpleNamespace

import pytest

from codestrata import session


def fake(master, settings):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn", {}))
    assert session.shared_dir(fake("yarn", {"spark.checkpoint.dir": "hdfs:///work"})) == "hdfs:///work"
    assert session.work_path(fake("yarn", {"spark.checkpoint.dir": "hdfs:///work/"}), "x").startswith("hdfs:///work/x-")


def test_a_local_session_uses_a_folder_beside_the_warehouse():
    assert session.shared_dir(fake("local[2]", {"spark.sql.warehouse.dir": "file:/w/house/"})) == "file:/w/house-work"


def test_stored_keeps_rows_and_types(spark, rows):
    df = spark.createDataFrame([("a", 1, None), (None, 2, [1.5])], "s string, n bigint, v array<double>")
    again = session.stored(df)
    assert again.dtypes == df.dtypes and rows(again) == rows(df)
