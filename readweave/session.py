"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the engine asks of a session that it builds itself.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "readweave", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def reachable(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` of a session and more, with the folder of this package on the path of Python workers wherever the session was started."""

    @functools.wraps(query)
    def run(spark: SparkSession, *more) -> DataFrame:
        environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
        paths = environment.get("PYTHONPATH", "").split(os.pathsep)
        if here not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
        return query(spark, *more)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='readweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/readweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends, and lost executors cost nothing. ``remove`` deletes the table."""
    folder = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are cores (few small files); else as it is, unmoved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remove(table: DataFrame) -> None:
    """Delete the table that ``written`` gave, once nothing reads it any more; other DataFrames are left alone."""
    if folder := getattr(table, "written_to", None):
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
