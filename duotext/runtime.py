"""Where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a temporary folder of its own;
    a cluster without it is a configuration error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="duotext-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the table to the shared folder and go on from there.

    What is read back is a plain columnar scan: executor loss costs no recomputation
    of earlier steps, and later steps still prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _delete_on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables go when the session ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist on its (Hadoop) file system?"""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(target))
