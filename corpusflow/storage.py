"""Cuts of lineage: tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where none is set, a folder of this machine if Spark
    runs in this process only, as in tests; on a cluster that is an error, since executors couldn't read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="corpusflow-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there,
    and a lost executor costs only the tasks that it ran."""
    path = f"{shared_dir(df.sparkSession)}/corpusflow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of frames that stored() gave, once nothing reads them any more."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "stored_at", None)
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
