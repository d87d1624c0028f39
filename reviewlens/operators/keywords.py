"""Most frequent content words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.functions.text import keyword_tokens


def keyword_counts(df: DataFrame, text: str = "feedback_text", stop_words: tuple[str, ...] = K.STOP_WORDS) -> DataFrame:
    """Occurrences of every word of four letters or more that is no stop word."""
    occurrences = df.select(F.explode(keyword_tokens(F.lower(F.col(text)))).alias("word"))
    kept = occurrences.where(~F.col("word").isin(list(stop_words)))
    return kept.groupBy("word").agg(F.count("*").alias("count"))


def extract_keywords(df: DataFrame, text: str = "feedback_text", top_n: int = 20) -> DataFrame:
    """The ``top_n`` most frequent words (120 for a word cloud), ties in alphabetical order."""
    return keyword_counts(df, text).orderBy(F.desc("count"), "word").limit(top_n)
