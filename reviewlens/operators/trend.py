"""Scores over time on a dense calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from reviewlens.functions.grades import exact_avg
from reviewlens.sources.reviews import lenient_timestamp

# Period ends by frequency, and the step from one period to the next.
FREQUENCIES = ("D", "W", "ME", "QE", "YE")


def period_end(date: Column, frequency: str) -> Column:
    """Last day of the period of a date; weeks end on Sunday."""
    if frequency == "D":
        return date
    if frequency == "W":
        return F.next_day(F.date_sub(date, 1), "Sunday")
    if frequency == "ME":
        return F.last_day(date)
    if frequency == "QE":
        return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))
    if frequency == "YE":
        return F.make_date(F.year(date), F.lit(12), F.lit(31))
    raise ValueError(f"Unknown frequency {frequency!r}; one of {', '.join(FREQUENCIES)}.")


def _gap(start: Column, following: Column, frequency: str) -> Column:
    """Period ends from ``start`` up to, not including, ``following``."""
    if frequency in ("D", "W"):
        days = 1 if frequency == "D" else 7
        ends = F.sequence(start, F.date_sub(following, 1), F.expr(f"interval {days} day"))
    else:
        months = {"ME": 1, "QE": 3, "YE": 12}[frequency]
        firsts = F.sequence(F.trunc(start, "month"), F.trunc(following, "month"), F.expr(f"interval {months} month"))
        ends = F.transform(F.slice(firsts, 1, F.size(firsts) - 1), F.last_day)
    return F.when(following.isNull(), F.array(start)).otherwise(ends)


def trend(df: DataFrame, date: str, score: str, frequency: str = "ME", by: str | None = None) -> DataFrame:
    """Mean score (two decimals) and count per period; periods without rows appear with count 0.

    The calendar runs from the first to the last period (of each group, with
    ``by``). Text dates may have any spelling that ``lenient_timestamp`` reads;
    rows with another date or a score that is no number do not count. Gaps are filled from the aggregated periods, which are few, so the
    rows themselves are read once.
    """
    text = isinstance(df.schema[date].dataType, types.StringType)
    day = F.to_date(lenient_timestamp(F.col(date)) if text else F.col(date))
    known = df.withColumn("_day", day).where(F.col("_day").isNotNull())
    value = F.col(score).try_cast("double")
    known = known.where(value.isNotNull() & ~F.isnan(value))
    keys = [by] if by else []
    periods = known.groupBy(*keys, period_end(F.col("_day"), frequency).alias("_end")).agg(
        F.round(exact_avg(value), 2).alias("mean_score"), F.count("*").alias("count")
    )
    following = F.lead("_end").over(Window.partitionBy(*keys).orderBy("_end"))
    periods = periods.withColumn("_next", following)
    filled = periods.withColumn("date", F.explode(_gap(F.col("_end"), F.col("_next"), frequency)))
    own = F.col("date") == F.col("_end")
    return filled.select(
        *keys,
        "date",
        F.when(own, F.col("mean_score")).alias("mean_score"),
        F.when(own, F.col("count")).otherwise(F.lit(0)).cast("bigint").alias("count"),
    )
