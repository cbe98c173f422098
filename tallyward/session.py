"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyward", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    cores = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made up for local sessions, and tables written so far, by application.
_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    That setting cannot be changed in a running session. Where it is missing,
    a session in local mode gets a folder on this machine; on a cluster the
    executors could not see that one, so the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is not None:
        return root
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach before the session starts")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="tallyward-", dir="/tmp")
    return _LOCAL_ROOTS[context.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one written table or stream."""
    path = f"{shared_root(spark)}/tallyward/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables this session has written to the shared folder; how many there were.

    To be called when the results that read them have been consumed. Only
    paths that ``scratch`` has handed out are deleted.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    The copy is Parquet, so what reads it takes only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read from fewer files than there are cores.

    A small table may come in one file that one task reads; work on every
    character of it then wants a shuffle first. Tables of many files stay as
    they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
