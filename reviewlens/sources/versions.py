"""Tables that are written anew, version by version, while readers use the last whole one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "log"
_LOG_TYPE = "version bigint"


def last_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last whole version; none if nothing was written yet."""
    try:
        return spark.read.schema(_LOG_TYPE).parquet(f"{path}/{_LOG}").agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the table, the last one by default; none if there is none."""
    version = last_version(spark, path) if version is None else version
    return None if version is None else spark.read.parquet(f"{path}/version={version}")


def write_version(df: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """Write a new version, then name it in the log, which is what makes it the last one.

    ``df`` may read earlier versions. A version whose writer failed is not in
    the log; the next attempt at its number replaces it. A number that is in
    the log already is left as it is: a batch that a stream runs again changes
    nothing. One writer at a time.
    """
    spark = df.sparkSession
    last = last_version(spark, path)
    if version is None:
        version = 0 if last is None else last + 1
    if last is None or version > last:
        df.write.mode("overwrite").parquet(f"{path}/version={version}")
        spark.range(version, version + 1, 1, 1).toDF("version").write.mode("append").parquet(f"{path}/{_LOG}")
    return spark.read.schema(df.schema).parquet(f"{path}/version={version}")
