"""Joins, limits and ranks that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import shared_folder

# A lookup table of at most so many rows is broadcast whole.
BROADCAST_ROWS = 100_000
# Otherwise keys with more than 1/2000 of all rows are broadcast: there are at most 2000 of them.
HOT_KEYS = 2_000
# Ranking up to so many rows is one sorted task; above, ranges are ranked in parallel.
SINGLE_TASK_ROWS = 100_000
# Parts that a group's rows are limited in before they meet.
PARTS = 256
_ROW_BITS = 33


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join of rows to a materialised table with one row per ``key``.

    ``weight`` is the column of ``right`` with the number of left rows of the
    key. A small ``right`` is broadcast. From a large one only the heavy keys
    are; rows of heavy and of missing keys then skip the shuffle join: they get
    a filler key made from ``spread`` (a unique column), which matches nothing
    and scatters them over all tasks.
    """
    totals = right.agg(F.count("*").alias("rows"), F.sum(weight).alias("weight")).first()
    if totals["rows"] <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), key, "left")

    values = [c for c in right.columns if c not in (key, weight)]
    packed = right.select(
        F.col(key), F.struct(*values).alias("_found"), (F.col(weight) * HOT_KEYS >= totals["weight"]).alias("_hot")
    )
    hot = packed.where("_hot").select(F.col(key), F.col("_found").alias("_hot_found"))
    cold = packed.where(~F.col("_hot")).select(F.col(key).alias("_key"), F.col("_found"))
    joined = left.join(F.broadcast(hot), key, "left")
    settled = F.col("_hot_found").isNotNull() | F.col(key).isNull()
    filler = F.concat(F.lit("\u0000"), spread.cast("string"))
    joined = joined.withColumn("_key", F.when(settled, filler).otherwise(F.col(key)))
    joined = joined.join(cold, "_key", "left")
    found = F.coalesce(F.col("_hot_found"), F.col("_found"))
    return joined.select(*left.columns, *[found[v].alias(v) for v in values])


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int, unique: str) -> DataFrame:
    """The first ``most`` rows of every group, with ``_rank``.

    Spark limits ranks before it shuffles: every task keeps the first rows of its
    own part of a group (up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    of them). What is left is limited in some hundred parts of a group, each fed
    by some tasks, and then as a whole: a group of any size sends few rows to
    its last task, and only these are sorted again.
    """
    df = df.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for groups in ([*keys, "_task"], keys):
        window = Window.partitionBy(*groups).orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= most)
    return df.drop("_task")


def with_rank(df: DataFrame, order: list[Column], rows: int, column: str = "rank") -> DataFrame:
    """Add positions 1..n in the given order (which must be unique).

    ``rows`` is the known size of ``df``. A large table is sorted by range; a
    row's rank is then the size of all ranges before its own plus its position
    inside the range, so no task sees more than one range.
    """
    if rows <= SINGLE_TASK_ROWS:
        return df.withColumn(column, F.row_number().over(Window.orderBy(*order)))

    shared_folder(df.sparkSession)
    ordered = df.orderBy(*order).checkpoint()
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_range", F.shiftright("_id", _ROW_BITS))
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    position = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranked = numbered.join(F.broadcast(starts), "_range")
    ranked = ranked.withColumn(column, (F.col("_start") + position + 1).cast("int"))
    return ranked.drop("_id", "_range", "_start")
