"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the options that results depend on (time zone) or that skewed joins need.

    Python workers get rows in small batches, as they need several times a batch's bytes.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="gristmill-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path in the shared folder."""
    _FOLDERS.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def release(spark: SparkSession) -> int:
    """Delete what ``new_folder`` and ``stage`` have made so far; the number of folders.

    For when results are written or counted: DataFrames that read these folders end with them.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        gone += path.getFileSystem(hadoop).delete(path, True)
    return gone


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the files.

    Cuts the lineage, survives lost executors, and later readers prune columns.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
