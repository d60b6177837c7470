"""Tables that outlive executors: written to the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this machine, in local mode only: elsewhere executors wouldn't see it."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="tidepool-shared-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there, and sizes are known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidepool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path, system = _path(df.sparkSession, file)
            if path.getParent().getName().startswith("tidepool-"):
                system.delete(path.getParent(), True)


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def delete_at_end(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.deleteOnExit(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that have run; it learns of them when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()
