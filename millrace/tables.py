"""Tables in the folder that the driver and the executors share, where lineage is cut."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of spark.checkpoint.dir. Only one machine's own session may do without."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
    return f"{(known or 'file:///tmp/checkpoints').rstrip('/')}/millrace-{sc.applicationId}"


def clear(root: str) -> None:
    """Remove a session's tables; nothing reads them once it ends."""
    gateway = SparkContext._gateway
    if gateway is None:
        return
    try:
        path = gateway.jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):  # the JVM has gone; the folder is left to whoever clears checkpoints
        pass


_ROOTS: set[str] = set()


def written(df: DataFrame, name: str = "table", path: str | None = None, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lost executors then cost a read, not the work before it.

    The table stays until the driver's process ends. by: a column whose values get folders of their own.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(clear, root)
    path = path or f"{root}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
