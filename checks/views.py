"""Review tables derived from the given ones, for the registered queries.

The given prose holds few words of the word lists. Each document therefore
becomes one review: its whole text between two sentences that are chosen by
its length, so that exact copies of a document stay exact copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.functions.literals import string_array
from reviewlens.sources.reviews import load_parquet, semester

# Sample sentences plus some with student mentions, negations and accents.
SENTENCES = (
    K.SAMPLE_POSITIVE
    + K.SAMPLE_NEUTRAL
    + K.SAMPLE_NEGATIVE
    + (
        "A student noted that the pace is fine. In my opinion we liked the labs.",
        "One student says my students ask too much; I think the workload is harsh.",
        "Not very good, never late.",
        "Student B commented that office hours help me a lot.",
        "I would like more quizzes, and I enjoyed the discussion. For me it was fun.",
        "Café talks were éxcellent, truly good—not boring.",
    )
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table, its rows dealt to all cores where it has fewer files than there are cores.

    The given files have one row group each, which one task reads; scoring in that task would leave the others idle.
    """
    rows = load_parquet(spark, f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _sentence(position: Column) -> Column:
    return F.get(string_array(SENTENCES), position.cast("int"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as reviews, and a blank review for every label marked toxic."""
    n = len(SENTENCES)
    documents = spread_table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.concat_ws(
            " ", _sentence(F.col("n_chars") % n), "text", _sentence(F.expr(f"n_chars div {n}") % n)
        ).alias("feedback_text"),
        F.concat_ws("-", "source", "lang").alias("teacher_name"),
        F.col("lang").alias("subject"),
        F.date_add(F.lit("2023-01-10").cast("date"), (F.col("doc_id") % 710).cast("int")).alias("date"),
        (1 + (F.col("doc_id") * 7 % 41) / F.lit(10.0)).alias("rating"),
    )
    labels = table(spark, sf, "labels")
    blank = labels.where("toxic = 1").select(
        (-1 - F.col("doc_id")).alias("review_id"),
        F.when(F.col("quality") == 1, "").otherwise("   ").alias("feedback_text"),
        F.when(F.col("quality") == 1, "src1-en").alias("teacher_name"),
        F.lit("en").alias("subject"),
        F.lit("2023-07-01").cast("date").alias("date"),
        F.lit(None).cast("double").alias("rating"),
    )
    return documents.unionByName(blank).withColumn("semester", semester(F.col("date")))


REVIEWS_SQL = """
  select d.doc_id as review_id,
    concat_ws(' ', a.txt, d.text, b.txt) as feedback_text,
    concat_ws('-', d.source, d.lang) as teacher_name,
    d.lang as subject,
    date '2023-01-10' + cast(d.doc_id % 710 as int) as date,
    cast(1 + (d.doc_id * 7 % 41) / 10.0 as double) as rating
  from documents d
  join pool a on a.pid = d.n_chars % {n}
  join pool b on b.pid = (d.n_chars // {n}) % {n}
  union all
  select -1 - doc_id, case when quality = 1 then '' else '   ' end,
    case when quality = 1 then 'src1-en' end, 'en', date '2023-07-01', null
  from labels where toxic = 1
""".format(n=len(SENTENCES))


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    return score_lines(table(spark, sf, "lineitem"))


def score_lines(lines: DataFrame) -> DataFrame:
    """Every order line as a scored review of its supplier."""
    c = F.col
    return lines.select(
        c("l_suppkey").cast("string").alias("teacher_name"),
        c("l_returnflag").alias("subject"),
        (c("l_quantity") / 5).alias("communication_score"),
        (c("l_discount") * 100).alias("subject_knowledge_score"),
        (c("l_tax") * 125).alias("engagement_score"),
        (c("l_linenumber") * 10 / F.lit(7.0)).alias("responsiveness_score"),
        F.least(F.lit(10.0), c("l_extendedprice") / 10500).alias("assignment_quality_score"),
        (0.5 + c("l_discount") * 5).alias("confidence"),
        F.when(c("l_returnflag") == "A", "Positive")
        .when(c("l_returnflag") == "N", "Neutral")
        .otherwise("Negative")
        .alias("sentiment_label"),
        (c("l_linestatus") == "O").alias("is_mixed"),
        c("l_shipdate").alias("date"),
    )


SCORED_LINES_SQL = """
  select cast(l_suppkey as varchar) as teacher_name, l_returnflag as subject, null as semester,
    l_quantity / 5 as communication_score, l_discount * 100 as subject_knowledge_score,
    l_tax * 125 as engagement_score, l_linenumber * 10 / 7.0::double as responsiveness_score,
    least(10.0::double, l_extendedprice / 10500) as assignment_quality_score,
    0.5::double + l_discount * 5 as confidence,
    case l_returnflag when 'A' then 'Positive' when 'N' then 'Neutral' else 'Negative' end as sentiment_label,
    l_linestatus = 'O' as is_mixed, l_shipdate as date
  from lineitem
"""
