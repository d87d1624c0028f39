"""Session helpers: the checkpoint folder and materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that intermediate tables are written to.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder: a machine-local folder would
    not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
            folder = tempfile.mkdtemp(prefix="reviewlens-")
            context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`shared_folder`."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where a small derived table feeds several later steps, so that the
    scan of the reviews behind it runs once and a lost executor does not
    bring it back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
