"""Filter interaction audit: what each of several document filters removes, alone and in every order.

Each document gets a bit mask of the filters it fails. The masks are counted per
part, and from the counts the removals of every coalition of filters follow (32
for five filters). Everything else is arithmetic on these few numbers: steps of an
order are differences of two coalitions, and Shapley values are the solution of
the kernel-weighted least squares whose sum is the removal of all filters.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import pick, table
from reviewlens.llm.quality import words

LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of the filters: short, repetitive, shouting, symbols, exact copies.
LETTERS = "ABCDE"
#: Rows without a key are dealt by their text; so many ways.
SALTS = 4096


def shapley_weights(n: int) -> list[list[int]]:
    """``n!`` times the share of each coalition's value in each player's Shapley value, exact.

    Row i, column S (a bit mask). Least squares over the proper coalitions with
    the weights (n-1) / (C(n,s) s (n-s)), subject to the values' sum being that of
    the grand coalition; the empty one is worth nothing. The normal equations with
    the multiplier are solved for all unit right sides at once in fractions.
    """
    size, everyone = 1 << n, (1 << n) - 1
    system = [[Fraction(0)] * (n + 1 + size) for _ in range(n + 1)]
    for s in range(1, everyone):
        members = [i for i in range(n) if s >> i & 1]
        weight = Fraction(n - 1, comb(n, len(members)) * len(members) * (n - len(members)))
        for i in members:
            system[i][n + 1 + s] += weight
            for j in members:
                system[i][j] += weight
    for i in range(n):
        system[i][n] = system[n][i] = Fraction(1)
    system[n][n + 1 + everyone] = Fraction(1)
    for at in range(n + 1):
        pivot = next(r for r in range(at, n + 1) if system[r][at])
        system[at], system[pivot] = system[pivot], system[at]
        system[at] = [value / system[at][at] for value in system[at]]
        for r in range(n + 1):
            if r != at and system[r][at]:
                factor = system[r][at]
                system[r] = [a - factor * b for a, b in zip(system[r], system[at], strict=True)]
    found = [[factorial(n) * value for value in row[n + 1 :]] for row in system[:n]]
    assert all(value.denominator == 1 for row in found for value in row)
    return [[int(value) for value in row] for row in found]


def failures(text: Column, tokens: Column) -> list[Column]:
    """The conditions that a text alone decides; ``tokens`` are its words."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [
        F.size(tokens) < LEAST_WORDS,
        100 * F.size(F.array_distinct(tokens)) < DISTINCT_PERCENT * F.size(tokens),
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def failure_counts(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """How many documents of each part fail which filters: ``part, mask, good, toxic, n``.

    A null text is empty, a null part the empty string. The last filter fails
    documents whose text one with a smaller key has as well, in any part; a null
    key is neither smaller nor larger and has no label. Repeated rows count
    repeatedly, as do rows with one key and several texts. A key with several
    labels is good (``quality`` 1) or toxic if any of them says so.

    Only keys, digests and masks are shuffled. Copies of one text shrink in the
    map tasks: all count as copies at first, and per digest one entry, that with
    the smallest key, is set right afterwards.
    """
    rows = pick(docs, doc=key, part=part, text=text)
    rows = rows.withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("part", "text")})
    rows = rows.withColumn("words", words(F.col("text")))
    own = failures(F.col("text"), F.col("words"))
    copy = 1 << len(own)
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(own)), F.lit(0))
    rows = rows.select("doc", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    salt = F.when(F.col("doc").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(0)
    marks = pick(labels, doc=key, quality="quality", toxic="toxic").where("doc is not null")
    marks = marks.groupBy("doc", F.lit(0).alias("salt")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = rows.withColumn("salt", salt).join(marks, ["doc", "salt"], "left")
    rows = rows.withColumns({name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")})
    keys = ["doc", "salt", "digest", "mask", "good", "toxic"]
    rows = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    rows = rows.groupBy(*keys).agg(F.collect_list(F.struct("part", "n")).alias("parts"), F.sum("n").alias("n"))

    first = F.struct("doc", "mask", "good", "toxic", "parts")
    entry = "struct<digest:binary,part:string,mask:int,good:boolean,toxic:boolean,n:bigint,first:{}>".format(
        rows.select(first.alias("first")).schema["first"].dataType.simpleString()
    )
    counted = F.transform(
        "parts",
        lambda p: F.struct(
            F.lit(None).alias("digest"), p["part"].alias("part"),
            F.when(F.col("doc").isNull(), F.col("mask")).otherwise(F.col("mask") + copy).alias("mask"),
            "good", "toxic", p["n"].alias("n"), F.lit(None).alias("first"),
        ).cast(entry),
    )
    none = [F.lit(None).alias(name) for name in ("part", "mask", "good", "toxic", "n")]
    named = F.when(F.col("doc").isNotNull(), F.array(F.struct("digest", *none, first.alias("first")).cast(entry)))
    rows = rows.select(F.explode(F.concat(counted, F.coalesce(named, F.array().cast(f"array<{entry}>")))).alias("e")).select("e.*")
    rows = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    settled = F.flatten(F.transform(
        "first.parts",
        lambda p: F.array(*(
            F.struct(p["part"].alias("part"), (F.col("first.mask") + more).alias("mask"), F.col("first.good").alias("good"),
                     F.col("first.toxic").alias("toxic"), (sign * p["n"]).alias("n"))
            for more, sign in ((0, 1), (copy, -1))
        )),
    ))
    plain = F.array(F.struct("part", "mask", "good", "toxic", "n"))
    rows = rows.select(F.explode(F.when(F.col("digest").isNull(), plain).otherwise(settled)).alias("e")).select("e.*")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n > 0")


def coalition_removals(counts: DataFrame, filters: int) -> DataFrame:
    """Per part: ``n`` documents, and by coalition (0 to 2^filters - 1) how many of all, good and toxic ones it removes."""
    rows = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))).alias("coalition"))
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(0)
    rows = rows.groupBy("part", "coalition").agg(
        F.sum("n").alias("n"),
        F.sum(hit).alias("all"),
        F.sum(F.when(F.col("good"), hit).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), hit).otherwise(0)).alias("toxic"),
    )
    values = F.sort_array(F.collect_list(F.struct("coalition", "all", "good", "toxic")))
    rows = rows.groupBy("part").agg(F.max("n").alias("n"), values.alias("values"))
    return rows.select("part", "n", *(F.col(f"values.{name}").alias(name) for name in ("all", "good", "toxic")))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step; empty for no documents.

    ``counts`` is as by :func:`failure_counts`, bit i of a mask being the filter
    ``letters[i]``. Columns: part, filter_order, step, filter, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    everyone = (1 << len(letters)) - 1
    parts = coalition_removals(counts, len(letters))
    shapley = F.array(*(
        sum((F.lit(w).cast("bigint") * F.get("all", F.lit(s)) for s, w in enumerate(row) if w), F.lit(0).cast("bigint"))
        for row in shapley_weights(len(letters))
    ))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(letters))), " ")
    steps = parts.withColumn("shapley", shapley).select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = steps.withColumn("filter", F.expr("substr(filter_order, step, 1)"))
    place = f"(instr('{letters}', {{}}) - 1)"
    steps = steps.withColumns({
        "i": F.expr(place.format("filter")),
        "before": F.expr(
            "aggregate(filter(split(substr(filter_order, 1, step - 1), ''), l -> l <> ''), 0, "
            f"(m, l) -> m | shiftleft(1, {place.format('l')}))"
        ),
    }).withColumn("after", F.expr("before | shiftleft(1, i)"))
    lost = {name: F.expr(f"get(`{name}`, after) - get(`{name}`, before)") for name in ("all", "good", "toxic")}
    return steps.select(
        "part", "filter_order", "step", "filter",
        (F.col("n") - F.expr("get(`all`, after)")).alias("kept"),
        lost["all"].alias("removed"),
        (F.expr("get(`all`, shiftleft(1, i))") - lost["all"]).alias("redundant"),
        F.expr(f"get(`all`, {everyone}) - get(`all`, {everyone} ^ shiftleft(1, i))").alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.expr("get(shapley, i)").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(failure_counts(table(spark, sf, "documents"), table(spark, sf, "labels")))


ORACLE = f"""
  with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
  marks as (
    select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
    from labels group by doc_id),
  failing as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
      case when len(words) < {LEAST_WORDS} then 1 else 0 end
      + case when 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) then 2 else 0 end
      + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text) then 4 else 0 end
      + case when regexp_matches(text, '{SYMBOLS}') then 8 else 0 end
      + case when texts.doc_id > min(texts.doc_id) over (partition by text) then 16 else 0 end as mask
    from texts left join marks on marks.doc_id = texts.doc_id),
  counts as (
    select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from failing group by part, mask),
  letters as (select unnest(range(0, 5)) as i, unnest(['A', 'B', 'C', 'D', 'E']) as letter),
  orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.i, b.i, c.i, d.i, e.i] as places
    from letters a join letters b on b.i <> a.i join letters c on c.i not in (a.i, b.i)
    join letters d on d.i not in (a.i, b.i, c.i) join letters e on e.i not in (a.i, b.i, c.i, d.i)),
  steps as (
    select filter_order, step::int as step, places[step] as i, filter_order[step] as filter,
      coalesce(list_sum(list_transform(places[1:step - 1], lambda p: 1 << p)), 0)::int as before
    from (select *, unnest(range(1, 6)) as step from orders)),
  counted as (
    select part, filter_order, step, filter,
      sum(n) filter (mask & (before | (1 << i)) = 0) as kept,
      sum(n) filter (mask & before = 0 and mask & (1 << i) <> 0) as removed,
      sum(n) filter (mask & before <> 0 and mask & (1 << i) <> 0) as redundant,
      sum(n) filter (mask = 1 << i) as unique_fails,
      sum(good) filter (mask & before = 0 and mask & (1 << i) <> 0) as good_lost,
      sum(toxic) filter (mask & before = 0 and mask & (1 << i) <> 0) as toxic_lost
    from counts, steps group by part, filter_order, step, filter)
  select part, filter_order, step, filter, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
    coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    coalesce(sum(removed) over (partition by part, filter), 0)::bigint as shapley
  from counted
"""
