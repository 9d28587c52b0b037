"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; without that setting only a local session has one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="termlake-")  # driver and executors are one process
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *partitions: str) -> tuple[DataFrame, str]:
    """``df`` written to a fresh path and read back, with that path; lineage ends there."""
    path = shared_path(df.sparkSession, label)
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    order = [c for c in df.columns if c not in partitions] + list(partitions)
    return df.sparkSession.read.schema(df.select(*order).schema).parquet(path), path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _hadoop(spark, path)
    return files.exists(hadoop)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table, or one folder of it."""
    files, hadoop = _hadoop(spark, path)
    files.delete(hadoop, True)
