"""SimHash fingerprints of 64 bits and their search. DataFrame functions only.

Every word votes with its weight on the 64 bits of its hash. A vote is counted
in 32 sums with two lanes of 32 bits, so that a text needs 32 numbers and not
64, and these are partial sums before any shuffle.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import materialise, pick, table

BITS, LANES = 64, 32
_LOW_BITS = 0x0000000100000001
_LOW_LANE = 0xFFFFFFFF
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Rows of a block of consecutive keys, and the most blocks (so many keys come to the driver).
BLOCK_ROWS, MOST_BLOCKS = 200, 10_000

#: Radius of the search, and blocks of bits: pairs within the radius agree on all blocks but as many.
RADIUS, BLOCKS = 3, 6


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``fingerprint`` (64 bits) of every text; ``keys`` have to be unique.

    Terms are pairs of neighbouring words (the last word alone as well), and a
    term weighs as many votes as its first word has characters, 16 at most. A
    text without words has the fingerprint 0.
    """
    rows = texts.select(*keys, F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAKS).alias("_words"))
    rows = rows.select(*keys, "_words", F.posexplode("_words").alias("_at", "_word"))
    term = F.xxhash64("_word", F.coalesce(F.get("_words", F.col("_at") + 1), F.lit("")))
    weight = F.least(F.length("_word"), F.lit(16)).cast("bigint")
    rows = rows.select(*keys, term.alias("_term"), weight.alias("_weight"))
    votes = [
        F.sum(F.shiftrightunsigned("_term", k).bitwiseAND(F.lit(_LOW_BITS)) * F.col("_weight")).alias(f"_v{k}")
        for k in range(LANES)
    ]
    sums = rows.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *votes)
    bits = []
    for k in range(LANES):
        low, high = F.col(f"_v{k}").bitwiseAND(F.lit(_LOW_LANE)), F.shiftrightunsigned(f"_v{k}", LANES)
        for lane, count in ((k, low), (k + LANES, high)):
            bits.append(F.when(2 * count > F.col("_all"), F.shiftleft(F.lit(1).cast("bigint"), lane)).otherwise(F.lit(0)))
    value = bits[0]
    for bit in bits[1:]:
        value = value.bitwiseOR(bit)
    return sums.select(*keys, value.cast("bigint").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_bounds(docs: DataFrame, key: str, rows: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> list[int]:
    """Keys that cut ``docs`` into blocks of about ``rows`` rows, ``most`` of them at most."""
    count = docs.count()
    blocks = min(most, max(1, count // rows))
    if blocks == 1:
        return []
    cuts = [i / blocks for i in range(1, blocks)]
    found = docs.select(F.percentile_approx(key, cuts, 10 * blocks)).first()[0]
    return sorted(set(found or []))


def block_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below or at the key, by two short searches; null keys come before all."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda values: F.lit(values) if values else F.array().cast("array<bigint>")
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(literal([p[0] for p in parts]), lambda b: b <= key))
    inside = F.get(F.lit([p[1:] if len(p) > 1 else [] for p in parts]).cast("array<array<bigint>>"), coarse - 1)
    fine = F.size(F.filter(inside, lambda b: b <= key))
    return F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + 1 + fine)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every row with the text of the next one by descending key; after the last comes the first.

    Columns: doc_id, text, block, place (a row's number in its block),
    next_block, next_place, next_text. Rows are dealt out once, by blocks of
    consecutive keys; across blocks only their first rows move. Null keys come
    last, rows of one key by their text.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    bounds = block_bounds(ids, "doc_id")
    rows = rows.withColumn("block", -block_of(F.col("doc_id"), bounds))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumns(
        {"place": F.row_number().over(inside), "next_text": F.lead("text").over(inside)}
    )
    # First rows of the blocks: found by their key, then by their text.
    firsts = ids.withColumn("block", -block_of(F.col("doc_id"), bounds))
    firsts = firsts.groupBy("block").agg(F.max("doc_id").alias("_first"))
    firsts = materialise(firsts, "block-firsts")  # as many rows as there are blocks, a bounded number
    heads = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    heads = heads.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_first")))
    heads = heads.groupBy("block").agg(F.min("text").alias("_head"))
    around = Window.orderBy("block")
    order = firsts.select("block", F.lead("block").over(around).alias("_after"), F.first("block").over(around).alias("_top"))
    order = order.select("block", F.coalesce("_after", "_top").alias("_after"))
    heads = heads.withColumnRenamed("block", "_after").join(order, "_after")
    heads = materialise(heads.select("block", F.col("_after"), "_head"), "block-heads")
    ends = rows.join(heads, "block")
    last = F.col("next_text").isNull()
    return ends.select(
        "doc_id", "text", "block", "place",
        F.when(last, F.col("_after")).otherwise(F.col("block")).alias("next_block"),
        F.when(last, 1).otherwise(F.col("place") + 1).alias("next_place"),
        F.when(last, F.col("_head")).otherwise(F.col("next_text")).alias("next_text"),
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as many code points of ``following``, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def neighbours(
    prints: DataFrame, queries: DataFrame, column: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(query, match, distance) of all fingerprints of ``prints`` within ``radius`` bits of one of ``queries``.

    The 64 bits are cut into ``blocks``. Two fingerprints within the radius
    agree on all bits of some ``blocks - radius`` blocks; each choice of these
    is one table, keyed by the agreeing bits. Both sides are distinct values
    first, so copies do not multiply; nulls match nothing.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius has to be smaller than the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    choices = [signed(sum(c)) for c in itertools.combinations(masks, blocks - radius)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        values = df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = [F.struct(F.lit(n).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(choices)]
        return values.select(name, F.inline(F.array(*keys)))

    pairs = tables(queries, "query").join(tables(prints, "match"), ["table", "bits"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("match"))).cast("int")
    return pairs.withColumn("distance", distance).where(F.col("distance") <= radius).select("query", "match", "distance").distinct()


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one. Rows with a repeated or null key are rows of
    their own; the order among them is that of their texts.
    """
    rows = with_next(pick(docs, doc_id=key, text=text), "doc_id", "text").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    facts = ["doc_id", "block", "place", "next_block", "next_place"]
    rows = rows.select(
        *facts, F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.inline(F.array(*(F.struct(F.lit(v).alias("version"), F.col(c).alias("content")) for v, c in ((0, "text"), (1, "edited"))))),
    )
    keys = [*facts, "n_chars", "edited_sha256", "version"]
    prints = materialise(fingerprints(rows, keys, "content"), "fingerprints")
    own = prints.where("version = 0")
    changed = prints.where("version = 1").select("block", "place", F.col("fingerprint").alias("edited_fingerprint"))
    following = own.select(
        F.col("block").alias("next_block"), F.col("place").alias("next_place"), F.col("fingerprint").alias("_next")
    )
    joined = own.join(changed, ["block", "place"]).join(following, ["next_block", "next_place"])
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents; for those whose id is divisible by 100, the number of documents within the radius."""
    prints = materialise(fingerprint_documents(table(spark, sf, "documents")), "simhash")
    copies = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    asked = prints.where("doc_id % 100 = 0").select("fingerprint")
    near = neighbours(copies, asked).join(copies.withColumnRenamed("fingerprint", "match"), "match")
    near = near.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("copies").alias("n_near"))
    shown = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0").alias(c)
    near = near.withColumnRenamed("fingerprint", "_asked")
    joined = prints.join(near, (F.col("doc_id") % 100 == 0) & (F.col("fingerprint") == F.col("_asked")), "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next",
        "n_near",
    )
