"""Mixing sources to target weights by hash thresholds. DataFrame functions only.

Every document has a fixed hash. A source's words are summed by hash bucket; the
bucket in which the running sum passes the source's budget is cut again by the
next bits, until one hash value is left. Documents below that threshold are
taken: nothing is sorted, and smaller budgets take subsets of larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import materialise, pick, table
from reviewlens.llm.quality import words

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"
#: Bits of the hash, and of one level of the histogram.
BITS, LEVEL = 60, 15


def document_hash(key: Column, seed: str = SEED) -> Column:
    """60 bits of the key's digest; null keys share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def source_targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, shares: Sequence[float] = (1.0,), repeats: int = REPEATS
) -> DataFrame:
    """source, source_size, share, target of every source and share; ``totals`` has source and source_size.

    Sources in code point order, null last, have the weights in turn. A target
    is ``least(repeats * source_size, level * weight)``; the level at which the
    targets add up to the share of all words is the largest of those found by
    filling up the sources in the order of ``repeats * source_size / weight``.
    There is one row per source, and these windows see all of them.
    """
    order = [F.col("source").asc_nulls_last()]
    place = F.row_number().over(Window.orderBy(*order)) - 1
    named = totals.withColumn(
        "weight", F.get(F.array(*(F.lit(w).cast("bigint") for w in weights)), place % len(weights))
    ).withColumn("most", F.col("source_size") * repeats)
    filling = Window.orderBy((F.col("most") / F.col("weight")).asc(), *order)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    named = named.withColumns(
        {
            "filled": F.coalesce(F.sum("most").over(before), F.lit(0)),
            "open_weight": F.sum("weight").over(rest),
            "all_words": F.sum("source_size").over(everything),
        }
    )
    named = named.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    level = (F.col("share") * F.col("all_words") - F.col("filled")) / F.col("open_weight")
    named = named.withColumn("level", F.max(level).over(Window.partitionBy("share")))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return named.select("source", "source_size", "share", F.greatest(target, F.lit(0.0)).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``whole`` (times that all documents are taken) and ``below`` (hashes taken once more).

    ``sized`` is a written table of source, size, hash. Each level sums the
    words of one more run of hash bits, of the boundary buckets only.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("whole", whole.cast("bigint"))
    state = state.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plain = state
    state = state.select(
        F.col("source").alias("of"), "share", "budget",
        F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("smaller"),
    )
    rows = sized
    for used in range(0, BITS, LEVEL):
        state = materialise(state, "mix-state")
        inside = rows.join(
            state,
            F.col("source").eqNullSafe(F.col("of"))
            & (F.shiftright("hash", BITS - used) == F.col("prefix")),
        )
        bucket = F.shiftright("hash", BITS - used - LEVEL).alias("prefix")
        sums = inside.groupBy("of", "share", bucket).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("smaller").alias("smaller")
        )
        running = Window.partitionBy("of", "share").orderBy("prefix")
        sums = sums.withColumn("until", F.col("smaller") + F.sum("words").over(running))
        state = sums.where(F.col("until") > F.col("budget")).groupBy("of", "share").agg(
            F.first("budget").alias("budget"), F.min("prefix").alias("prefix"),
            F.min_by(F.col("until") - F.col("words"), "prefix").alias("smaller"), F.min_by("words", "prefix").alias("words"),
        )
        if not used:
            boundary = materialise(state.select("of", "share", "budget", "prefix", "smaller"), "mix-state")
            keys = boundary.select(F.col("of").alias("_of"), F.col("prefix").alias("_prefix")).distinct()
            narrowed = rows.join(
                keys,
                F.col("source").eqNullSafe(F.col("_of")) & (F.shiftright("hash", BITS - LEVEL) == F.col("_prefix")),
                "left_semi",
            )
            rows, state = materialise(narrowed, "mix-boundary"), boundary
        elif used + LEVEL < BITS:
            state = state.drop("words")
    nearest = F.col("smaller") + F.col("words") / 2 <= F.col("budget")
    cut = state.select(
        F.col("of"), F.col("share").alias("_share"), (F.col("prefix") + F.when(nearest, 1).otherwise(0)).alias("below")
    )
    joined = plain.join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("share") == F.col("_share")), "left")
    # Without a boundary the budget is all that the source has.
    below = F.when(F.col("source_size") == 0, 0).otherwise(F.coalesce("below", F.lit(1 << BITS)))
    return joined.select("source", "source_size", "share", "target", "whole", below.cast("bigint").alias("below"))


def sized_documents(docs: DataFrame, key: str, text: str, source: str, seed: str = SEED) -> DataFrame:
    return pick(docs, doc_id=key, source=source, text=text).select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"),
        document_hash(F.col("doc_id"), seed).alias("hash"),
    )


def mixing_plan(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, shares: Sequence[float] = (1.0,), repeats: int = REPEATS
) -> DataFrame:
    """One row per source and share with its target and thresholds; written, as small as the number of sources."""
    totals = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    return materialise(thresholds(sized, source_targets(totals, weights, shares, repeats)), "mix-plan")


def times_taken(whole: Column, below: Column, hashed: Column) -> Column:
    return whole + F.when(hashed < below, 1).otherwise(0)


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    shares: Sequence[float] = (1.0,),
    repeats: int = REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """Per row and share: doc_id, source, share, size, source_size, target, times, taken.

    A source's taken words miss its target by half a document at most. Rows
    with one key (or without) are taken together. A null source is a source; a
    null text has no words; a source without words has the target 0.
    """
    sized = materialise(sized_documents(docs, key, text, source, seed), "mix-sizes")
    plan = mixing_plan(sized, weights, shares, repeats).withColumnRenamed("source", "of")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("times", times_taken(F.col("whole"), F.col("below"), F.col("hash")))
    return joined.select(
        "doc_id", "source", "share", "size", "source_size", "target", "times",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def mixed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, seed: str = SEED
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts are not shuffled unless the plan is large."""
    sized = materialise(sized_documents(docs, key, text, source, seed), "mix-sizes")
    plan = mixing_plan(sized, shares=(share,))
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    of, at = f"c{names.index(source)}", f"c{names.index(key)}"
    joined = renamed.join(plan, F.col(of).eqNullSafe(F.col("source")))
    times = times_taken(F.col("whole"), F.col("below"), document_hash(F.col(at), seed)).cast("int")
    repeated = joined.withColumn("_time", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*renamed.columns).toDF(*names)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The mix of a table ``docs`` (doc_id, text, source) as SQL, by sorting; gives ``mixed`` with a row per document.
MIXED_SQL = f"""
  sizes as (
    select *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
      ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, {BITS // 4}))::bigint as hash
    from docs),
  totals as (select source, sum(size)::bigint as source_size from sizes group by source),
  weighed as (
    select *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] as weight
    from totals),
  levels as (
    select *, (sum(source_size) over () - coalesce(sum({REPEATS} * source_size) over (
        order by {REPEATS} * source_size / weight::double, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
      / sum(weight) over (
        order by {REPEATS} * source_size / weight::double, source nulls last rows between current row and unbounded following) as level
    from weighed),
  targets as (
    select source, source_size, greatest(least(({REPEATS} * source_size)::double, max(level) over () * weight), 0) as target
    from levels),
  grouped as (select source, hash, sum(size) as words from sizes group by source, hash),
  running as (select *, sum(words) over (partition by source order by hash) - words as smaller from grouped),
  mixed as (
    select s.* exclude (hash), t.source_size, t.target,
      case when t.source_size = 0 then 0 else floor(t.target / t.source_size) + case when
        r.smaller + r.words / 2 <= t.target - floor(t.target / t.source_size) * t.source_size then 1 else 0 end end::bigint as times
    from sizes s join targets t on s.source is not distinct from t.source
      join running r on r.source is not distinct from s.source and r.hash = s.hash)
"""

ORACLE = f"""
  with docs as (select doc_id, text, source from documents), {MIXED_SQL}
  select doc_id, size::bigint as size, source_size, target, (size * times)::bigint as taken from mixed
"""
