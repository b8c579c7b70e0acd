"""Tables that cut a job's lineage: written to the folder that all executors
share, so a lost executor costs no earlier work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset a temporary folder
    serves in local mode; on a cluster that is an error, since no folder is then
    known to be shared."""
    context = spark.sparkContext
    set_to = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    known = context.getCheckpointDir()
    if known is None:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        known = context.getCheckpointDir()
    return known


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder; what is there goes when the JVM ends."""
    path = f"{folder(spark).rstrip('/')}/tidemark-{name}{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet and read it back; the files go when the JVM ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more, so that
    the shared folder holds what is still needed only."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
