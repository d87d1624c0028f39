"""Helpers shared by the operators on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import materialise

#: Characters that separate words in the contracts that name no other class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(df: DataFrame, rest: str | None = None, **columns: str) -> DataFrame:
    """The columns of ``df`` called by the values, renamed to the keywords.

    They are chosen by place, so other columns may have any name, one that
    differs in case only too. ``rest`` names a struct of the whole row to add,
    its fields ``c0``, ``c1`` … by place.
    """
    whole = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def place(name: str) -> int:
        if name in df.columns:
            return df.columns.index(name)
        return [column.lower() for column in df.columns].index(name.lower())

    chosen = [F.col(f"c{place(name)}").alias(alias) for alias, name in columns.items()]
    return whole.select(*chosen, *([F.struct(*whole.columns).alias(rest)] if rest else []))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node that every node of ``edges`` (a, b) reaches: ``(node, component)``.

    Labels fall along the edges until a round changes nothing; from the fourth
    round on they also jump to the label of the label, so that long chains take
    few rounds. Each round is written to the shared folder, so a lost executor
    never replays earlier rounds; only whether something changed comes to the
    driver. Self-links are fine, nodes without a link are not part of the
    result, null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    labels = materialise(labels.select("node", F.least("node", "component").alias("component")), f"{name}-labels")
    rounds = 0
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        heard = heard.select(F.col("a").alias("node"), "component", F.lit(None).cast("bigint").alias("old"))
        kept = labels.select("node", "component", F.col("component").alias("old"))
        lowest = heard.union(kept).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        if rounds >= 3:
            jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            lowest = lowest.join(jump, "component", "left").select("node", F.least("component", "_next").alias("component"), "old")
        marked = materialise(lowest, f"{name}-labels")
        labels = marked.select("node", "component")
        rounds += 1
        if marked.where("component <> old").isEmpty():
            return labels
