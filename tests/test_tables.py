"""Tables in the shared folder."""

from types import SimpleNamespace

import pytest

from millrace import tables


def session(master, known=None):
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master=master, applicationId="app-1"), conf=SimpleNamespace(get=lambda name, other: known or other))


def test_a_cluster_has_to_name_its_folder():
    assert tables.shared_dir(session("spark://h:7077", "hdfs://x/check/")) == "hdfs://x/check/millrace-app-1"
    assert tables.shared_dir(session("local[8]")).startswith("file:///tmp/")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://https://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))


def test_tables_are_written_and_cleared(spark):
    df = tables.written(spark.range(5), "five")
    root = tables.shared_dir(spark)
    assert df.count() == 5 and root in tables._ROOTS
    path = f"{root}/apart"
    assert tables.written(spark.range(3).selectExpr("id", "id % 2 as k"), path=path, by="k").where("k = 0").count() == 2
    tables.clear(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    assert df.count() == 5
