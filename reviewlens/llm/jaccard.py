"""Exact Jaccard self-join of shingle sets by partitioning the universe of tokens.

The universe (the hash space) is cut into segments, more of them the larger the
sets of a size band are. Sets that are similar enough differ in fewer tokens
than there are segments, so some segment holds the same tokens in both
(pigeonhole). Two allocations of that budget exist, chosen per band by cost:

* exact segments, somewhat more than the pigeonhole needs: every set gives up
  its most frequent segments, as many as are to spare. The order of frequency is
  one for all sets, so two similar sets still have a segment in common, and text
  that many sets share brings no candidates;
* one-deletion neighbourhoods: half as many segments, each in the index with its
  tokens and with every single token left out, so that a segment in which the
  sets differ by one token is found as well.

Texts with equal sets are one node throughout. Members of a bucket are linked to
a few of them first; what these leave apart is compared pair by pair. Sizes and
parity bitmaps, whose distance is a lower bound, come before whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import connected_components, materialise, pick, table
from reviewlens.llm.shingles import WIDTH, mix, set_key, shingles
from reviewlens.operators.skew import lookup_join

PERCENT = 80
BAND_GROWTH = 1.5
#: Segments in place of each that the pigeonhole needs, so that frequent ones can be left out.
SPARE = 1.15
#: Members of a bucket that all others are compared with first.
CENTRES = 3
#: Members of a bucket's largest component that one task compares with the bucket's others.
DEALT_MEMBERS = 5_000
#: Bits of the parity bitmap of the largest sets.
MOST_BITS = 1 << 17
#: What a thin segment (one token or none) costs in rows, through the false candidates that it may bring.
THIN_COST = 25
#: Above so many rows, texts to verify are joined by a shuffle and not by a broadcast of their 16-byte keys.
BROADCAST_KEYS = 500_000
_SEEN = 200_000


def most_different(a: int, b: int, percent: int) -> int:
    """Tokens that sets of sizes ``a`` and ``b`` may differ in at most and be similar."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.lru_cache(maxsize=4096)
def band(number: int, percent: int, growth: float = BAND_GROWTH) -> tuple[int, int]:
    """Smallest and largest set size of a band; a band is wider than the sizes of similar sets."""
    low = 1 if number == 0 else band(number - 1, percent, growth)[1] + 1
    return low, max(low * 100 // percent, math.ceil(low * growth) - 1)


def band_of(size: int, percent: int) -> int:
    number = 0
    while band(number, percent)[1] < size:
        number += 1
    return number


@functools.lru_cache(maxsize=4096)
def allocation(number: int, percent: int) -> tuple[np.ndarray, bool]:
    """Lower bounds of a band's segments, and whether one-deletion neighbourhoods are indexed."""
    high = band(number, percent)[1]
    budget = most_different(high, high, percent) + 1

    def cost(segments: int, rows: float) -> float:
        mean = high / segments
        return rows + THIN_COST * segments * math.exp(-mean) * (1 + mean)

    exact, halved = max(budget, round(budget * SPARE)), -(-budget // 2)
    deletions = cost(halved, halved + high) < cost(exact, budget)
    segments = halved if deletions else exact
    bounds = np.array([(i << 64) // segments for i in range(segments)], np.uint64)
    return bounds, deletions


def signatures(values: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Index entries of a sorted set, and how many of them can be spared.

    The entries are those of its own band and, if larger partners may be there,
    the next one; the lowest bit of an entry is that of its band's number, and
    the numbers to spare stand at that place.
    """
    size = len(values)
    spare = [0, 0]
    if not size:
        return np.zeros(0, np.int64), spare
    own, found = band_of(size, percent), []
    tokens = mix(values)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens)))
    for number in (own, own + 1):
        low, high = band(number, percent)
        largest = min(high, size * 100 // percent)
        if largest < low or most_different(high, high, percent) == 0:
            continue  # only equal sets are similar, and these are one node
        bounds, deletions = allocation(number, percent)
        places = np.append(np.searchsorted(values, bounds), size)
        segment = np.arange(1, len(bounds) + 1, dtype=np.uint64) + np.uint64(number << 32)
        content = sums[places[1:]] - sums[places[:-1]]
        entries = [mix(content + mix(segment))]
        if deletions:
            of = np.repeat(np.arange(len(bounds)), np.diff(places))
            entries.append(mix(content[of] - tokens + mix(segment[of])))
        else:
            spare[number & 1] = len(bounds) - most_different(size, largest, percent) - 1
        found += [e & ~np.uint64(1) | np.uint64(number & 1) for e in entries]
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64), spare


def parity_bits(values: np.ndarray) -> np.ndarray:
    """A bitmap in which every token flips one bit, as 64-bit words; it has four bits or more per token.

    Two bitmaps differ in at most as many bits as the sets in tokens. One of
    twice the bits folds to the other's by xor of its halves.
    """
    bits = min(MOST_BITS, max(64, 4 << (len(values) - 1).bit_length()))
    flips = np.bincount((mix(values ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


_COLUMNS = {
    "size": (("set_key", pa.int64()), ("n_shingles", pa.int64())),
    "entries": (("set_key", pa.int64()), ("entries", pa.list_(pa.int64())), ("spare0", pa.int32()), ("spare1", pa.int32())),
    "bits": (("set_key", pa.int64()), ("n", pa.int32()), ("bits", pa.list_(pa.int64()))),
    "tokens": (("set_key", pa.int64()), ("tokens", pa.list_(pa.int64()))),
}
_SQL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.list_(pa.int64()): "array<bigint>"}


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sets(docs: DataFrame, keys: list[str], text: str, width: int, kind: str, percent: int = PERCENT) -> DataFrame:
    """``keys`` with what ``kind`` names: the set's key and size, its index entries, its size and bitmap, or its tokens."""
    chosen = docs.select(*keys, F.col(text).alias("_text"))
    kinds = dict(chosen.dtypes)
    columns = _COLUMNS[kind]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} {_SQL_TYPES[t]}" for n, t in columns)])

    def described(values: np.ndarray) -> tuple:
        if kind == "size":
            return (len(values),)
        if kind == "entries":
            entries, spare = signatures(values, percent)
            return (entries, *spare)
        if kind == "bits":
            return (len(values), parity_bits(values)) if len(values) else (0, np.zeros(1, np.int64))
        return (values.view(np.int64),)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, made = [], []
                for row, value in enumerate(part.column("_text").to_pylist()):
                    values = shingles(value, width)
                    key = set_key(values)
                    if kind != "size":  # a copy adds nothing; forgetting some that were seen only adds rows
                        if key in seen:
                            continue
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                    rows.append(row)
                    made.append((key, *described(values)))
                arrays = [part.column(k).take(pa.array(rows, pa.int32())) for k in keys]
                for place, (_, kind_of) in enumerate(columns):
                    column = [m[place] for m in made]
                    arrays.append(_lists(column) if kind_of == pa.list_(pa.int64()) else pa.array(column, kind_of))
                yield pa.RecordBatch.from_arrays(arrays, [*keys, *(n for n, _ in columns)])

    return chosen.mapInArrow(hashed, schema)


def _may_be_similar(percent: int) -> Column:
    """Whether sizes and bitmaps (n and bits of a and b) allow the similarity; false for no similar pair."""
    folded = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    left = f"case when size(bits_a) > size(bits_b) then {folded.format('bits_a')} else bits_a end"
    right = f"case when size(bits_b) > size(bits_a) then {folded.format('bits_b')} else bits_b end"
    return F.expr(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and aggregate("
        f"zip_with({left}, {right}, (x, y) -> bit_count(x ^ y)), 0, (total, c) -> total + c) "
        f"<= {100 - percent} * (n_a + n_b) div {100 + percent}"
    )


class _Texts:
    """Looks up sets again from their texts, so that only those of compared pairs are ever written.

    ``sizes`` holds one row per set: set_key, text_key (a hash of a text with the set).
    """

    def __init__(self, docs: DataFrame, text: str, sizes: DataFrame, percent: int, width: int):
        self.docs, self.text, self.sizes, self.percent, self.width = docs, text, sizes, percent, width

    def of(self, ids: DataFrame, kind: str) -> DataFrame:
        """``kind`` of the sets named by ``ids`` (set_key)."""
        wanted = ids.distinct().join(self.sizes, "set_key").groupBy("set_key").agg(F.min("text_key").alias("_text_key"))
        keys = materialise(wanted.select("_text_key").distinct(), "wanted")
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        texts = self.docs.select(F.col(self.text).alias("_text"))
        texts = texts.join(keys, F.xxhash64("_text") == F.col("_text_key"), "left_semi")
        return materialise(_sets(texts, [], "_text", self.width, kind), kind)

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are similar, by all of their tokens."""
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        tokens = self.of(pairs.select(F.explode(F.array("a", "b")).alias("set_key")), "tokens")
        joined = pairs.join(tokens.toDF("a", "_a"), "a").join(tokens.toDF("b", "_b"), "b")
        joined = joined.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
        union = F.size("_a") + F.size("_b") - F.col("_both")
        return materialise(joined.where(100 * F.col("_both") >= self.percent * union).select("a", "b"), "links")


def _with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    return pairs.join(facts.toDF("a", "n_a", "bits_a"), "a").join(facts.toDF("b", "n_b", "bits_b"), "b")


def shared_entries(docs: DataFrame, text: str, percent: int, width: int) -> DataFrame:
    """(entry, id) of the entries that several sets have, without those that a set can spare."""
    entries = _sets(docs, [], text, width, "entries", percent).select(
        F.explode("entries").alias("entry"), F.col("set_key").alias("id"), "spare0", "spare1"
    )
    odd = F.col("entry").bitwiseAND(F.lit(1)) == 1
    entries = entries.select("entry", "id", F.when(odd, F.col("spare1")).otherwise(F.col("spare0")).alias("spare"))
    bucket = Window.partitionBy("entry")
    entries = entries.withColumns(
        {"members": F.count("*").over(bucket), "first": F.min("id").over(bucket), "last": F.max("id").over(bucket)}
    )
    # Entries of one set only are its rarest; what follows is about the few others.
    shared = entries.where("first <> last").groupBy("entry", "id")
    shared = shared.agg(F.max("members").alias("members"), F.max("spare").alias("spare"))
    frequent_first = Window.partitionBy("id", F.col("entry").bitwiseAND(F.lit(1))).orderBy(F.desc("members"), "entry")
    shared = shared.withColumn("_rank", F.row_number().over(frequent_first))
    return shared.where(F.col("_rank") > F.col("spare")).select("entry", "id")


def similar_sets(docs: DataFrame, text: str, sizes: DataFrame, percent: int, width: int) -> DataFrame:
    """``(node, component)`` of all set keys with a link to another set.

    ``sizes`` holds one row per set: set_key, text_key (a hash of a text with the set).
    """
    shared = shared_entries(docs, text, percent, width)
    bucket = Window.partitionBy("entry")
    centres = F.array_distinct(
        F.array(*(F.min_by("id", F.xxhash64("id", F.lit(j))).over(bucket) for j in range(CENTRES)))
    )
    shared = shared.withColumns({"first": F.min("id").over(bucket), "last": F.max("id").over(bucket), "centres": centres})
    shared = materialise(shared.where("first <> last").select("entry", "id", "centres"), "shared-entries")

    texts = _Texts(docs, text, sizes, percent, width)
    facts = texts.of(shared.select(F.col("id").alias("set_key")), "bits")
    similar = _may_be_similar(percent)

    def with_components(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
        """``rows`` with the component of ``column`` as ``_column``; a set without a link is its own."""
        named = found.select(F.col("node").alias(column), F.col("component").alias(f"_{column}"))
        return rows.join(named, column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))

    stars = shared.select(F.explode("centres").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    stars = materialise(_with_facts(stars, facts).where(similar).select("a", "b"), "stars")
    # One centre for each set, by an order of all centres; then those that are still in another component.
    links = texts.similar(stars.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a")).select("a", "b"))
    found = connected_components(links)
    others = with_components(with_components(stars, "a", found), "b", found).where("_a <> _b")
    more = texts.similar(others.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not more.isEmpty():
        links = links.unionByName(more)
        found = connected_components(links)

    # What the centres left apart: members of a bucket that are in different components. Those of its largest component
    # only meet the others, never each other; of a large one they are dealt to several tasks, and the others go to each.
    placed = with_components(shared.select("entry", "id"), "id", found)
    sizes = placed.groupBy("entry", "_id").agg(F.count("*").alias("members"))
    sizes = sizes.groupBy("entry").agg(F.max(F.struct("members", "_id")).alias("most"), F.count("*").alias("components"))
    sizes = sizes.where("components > 1").select("entry", "most")
    placed = placed.join(sizes, "entry").join(facts.withColumnRenamed("set_key", "id"), "id")
    placed = materialise(placed, "apart")
    parts = F.expr(f"cast(1 + most.members div {DEALT_MEMBERS} as int)")

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        columns = (F.col(c).alias(f"{n}{name}") for c, n in (("id", ""), ("_id", "_"), ("n", "n_"), ("bits", "bits_")))
        return rows.select("entry", *more, *columns)

    large = placed.where("_id = most._id").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    small = placed.where("_id <> most._id")
    each = small.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = side(large, "a", "part").join(side(each, "b", "part"), ["entry", "part"]).where(similar)
    both = side(small, "a").join(side(small, "b"), "entry").where(F.expr("a < b and _a <> _b") & similar)
    pairs = met.select("a", "b").union(both.select("a", "b"))
    more = texts.similar(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found if more.isEmpty() else connected_components(links.unionByName(more))


def _components(docs: DataFrame, key: str, text: str, percent: int, width: int) -> DataFrame:
    """Rows with doc_id, _text_key, set_key (null: empty), n_shingles, and ``first``, the smallest row of their component."""
    chosen = pick(docs, doc_id=key, _text=text)
    chosen = chosen.withColumn("_text_key", F.xxhash64("_text"))
    sizes = materialise(_sets(chosen, ["doc_id", "_text_key"], "_text", width, "size"), "sizes")
    # One row per set, so that no key of the joins below is hot.
    known = sizes.where("n_shingles > 0").groupBy("set_key").agg(F.min("_text_key").alias("text_key"))
    known = materialise(known, "known-sets")
    found = similar_sets(chosen, "_text", known, percent, width)
    # Rows with a null key come last here.
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_text_key")
    smallest = sizes.where("n_shingles > 0").groupBy("set_key").agg(F.min(row).alias("_first"), F.count("*").alias("rows"))
    smallest = smallest.join(found.withColumnRenamed("node", "set_key"), "set_key", "left")
    smallest = materialise(smallest.withColumn("component", F.coalesce("component", "set_key")), "smallest")
    lowest = smallest.groupBy("component").agg(F.min("_first").alias("first"))
    named = smallest.select("set_key", "rows", "component").join(lowest, "component")
    named = materialise(named.select(F.col("set_key").cast("string"), "rows", "first"), "named-sets")
    rows = sizes.withColumn("set_key", F.when(F.col("n_shingles") > 0, F.col("set_key").cast("string")))
    return lookup_join(rows, named, "set_key", "rows", F.concat_ws(":", "doc_id", "_text_key"))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest key reachable by links.

    Two texts are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``width``-word shingles. A text without words (or null) has
    an empty set, is linked with nothing and is its own component; texts with
    equal sets are linked. Repeated rows are rows of the result as well. A null
    key never is a component's smallest unless all its keys are null.
    """
    rows = _components(docs, key, text, percent, width)
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without those that are linked with one of a smaller key; rows without words all stay.

    Of rows with equal key and text one stays. Texts are not shuffled while the
    keys to drop are few.
    """
    judged = _components(docs, key, text, percent, width).where(F.col("set_key").isNotNull())
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_text_key") == F.col("first._text_key"))
    judged = materialise(judged.groupBy("doc_id", "_text_key").agg(F.max(first).alias("first"), F.count("*").alias("n")), "judged")
    names = docs.columns
    whole = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_key, own_text = F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}")

    def among(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_key"), "_text_key")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return rows.join(keys, own_key.eqNullSafe(F.col("_key")) & (F.xxhash64(own_text) == F.col("_text_key")), how)

    kept = among(judged.where(~F.col("first")), "left_anti", whole)
    repeated = judged.where("first and n > 1")
    if not repeated.isEmpty():
        once = among(repeated, "left_semi", kept).dropDuplicates([f"c{names.index(key)}", f"c{names.index(text)}"])
        kept = among(repeated, "left_anti", kept).unionByName(once)
    return kept.toDF(*names)


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"))
