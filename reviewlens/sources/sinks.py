"""Sinks: CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as types


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays become ``"a | b"`` strings, since CSV has no arrays."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, types.ArrayType)]
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " | ") for c in arrays}) if arrays else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 CSV files with a header, one per partition."""
    writer = flat_for_csv(df).write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
