"""Aspect scores from embeddings: similarity to anchor vectors of each aspect and pole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as types

from reviewlens import constants as K
from reviewlens.functions import text as T
from reviewlens.functions.aspects import top_aspects
from reviewlens.operators.skew import with_rank
from reviewlens.session import materialise

# Vectors that meet in one matrix product, and bytes of anchors that are broadcast at a time.
BLOCK_ROWS = 1_024
BROADCAST_BYTES = 64 << 20
_NOTHING = -np.inf
_STATE = {"_best": "array<double>", "_numbers": "array<bigint>", "_names": "array<string>"}


def mean_vectors(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Component-wise mean vector per group."""
    parts = df.select(*by, F.posexplode(vector).alias("position", "value"))
    # Summed as decimals, so that the mean does not depend on the order of the rows.
    value = F.col("value").cast("decimal(38,18)")
    means = parts.groupBy(*by, "position").agg((F.sum(value) / F.count(value)).cast("double").alias("value"))
    rows = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("parts"))
    return rows.select(*by, F.transform("parts", lambda p: p["value"]).alias(vector))


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero, so that their similarity is 0."""
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to rows of up to ``BLOCK_ROWS`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            rows = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["_rows"])


def _highest(similar: np.ndarray, numbers: np.ndarray, names: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """Per row the ``top`` highest similarities with the anchors' numbers and names; the first of equal ones."""
    rows, found = np.arange(len(similar)), []
    for _ in range(min(top, similar.shape[1])):
        place = similar.argmax(axis=1)
        found.append((similar[rows, place], numbers[place], names[place]))
        similar[rows, place] = _NOTHING
    return tuple(np.stack(columns, axis=1) for columns in zip(*found))


def _merge(best: tuple[np.ndarray, ...], found: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` best of two sets of similarities, numbers and names per row; ties by number."""
    both = [np.concatenate(pair, axis=1) for pair in zip(best, found)]
    order = np.lexsort((both[1], -both[0]), axis=1)[:, :top]
    return tuple(np.take_along_axis(column, order, axis=1) for column in both)


def nearest_anchors(
    df: DataFrame, anchors: DataFrame, sizes: list[int], width: int, vector: str, top: int
) -> DataFrame:
    """Add ``_found``: per group of anchors the ``top`` highest cosine similarities, with the anchors' numbers and names.

    ``anchors`` has ``group``, ``number``, ``embedding`` and perhaps ``name``;
    ``sizes`` are the numbers of anchors per group, counted from 0, and
    ``width`` the length of their vectors. A blocked vector product without a shuffle of ``df``: its
    rows are packed as they are read, the anchors into rows of ``BLOCK_ROWS``
    vectors; a packed row meets the anchor rows one after the other and keeps
    the highest similarities so far. Anchors are broadcast, up to
    ``BROADCAST_BYTES`` at a time: more of them take several rounds, each of
    which hands the running result on. ``anchors`` is read in every round, so it should be a stored table. Ties go to the lower number. Entries
    beyond the anchors of a group have number -1. Vectors without length
    have similarity 0 to everything.
    """
    anchors = anchors.select(
        F.col("group").cast("int").alias("group"), F.col("number").cast("bigint").alias("number"),
        (F.col("name") if "name" in anchors.columns else F.lit(None)).cast("string").alias("name"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    # Blocks are numbered by group; a group's anchors are dealt to its blocks by their numbers.
    parts = [-(-size // BLOCK_ROWS) for size in sizes]
    starts = [sum(parts[:i]) for i in range(len(parts))]
    groups, blocks = len(sizes), sum(parts)

    fields = df.schema.fields
    packed_type = types.ArrayType(types.StructType([*fields, types.StructField("_vector", types.ArrayType(types.DoubleType()))]))
    found_type = types.ArrayType(types.ArrayType(types.StructType([types.StructField("similarity", types.DoubleType()), types.StructField("number", types.LongType()), types.StructField("name", types.StringType())])))
    if not blocks:
        return df.withColumn("_found", F.array_repeat(F.array().cast(found_type.elementType), groups))

    packed = df.withColumn("_vector", F.col(vector).cast("array<double>")).mapInArrow(_pack, types.StructType([types.StructField("_rows", packed_type)]))
    packed = packed.withColumns({name: F.lit(None).cast(kind) for name, kind in _STATE.items()})
    start, dealt = (F.get(F.array(*[F.lit(v) for v in values]), F.col("group")) for values in (starts, parts))
    table = anchors.withColumn("_block", start + F.pmod("number", dealt).cast("int"))
    table = table.groupBy("_block").agg(
        F.first("group").alias("_group"), F.array_sort(F.collect_list(F.struct("number", "name", "embedding"))).alias("_anchors")
    )
    each = max(1, BROADCAST_BYTES // (BLOCK_ROWS * 8 * (width + 1)))
    state_schema = packed.schema
    for low in range(0, blocks, each):
        high = min(blocks, low + each)
        spread = packed.withColumn("_block", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        # Only the first anchor row of a round comes with the packed rows.
        carried = {c: F.when(F.col("_block") == low, F.col(c)) for c in ("_rows", *_STATE)}
        met = spread.withColumns(carried).join(F.broadcast(table.where(F.col("_block").between(low, high - 1))), "_block")
        done = high == blocks
        schema = types.StructType([*fields, types.StructField("_found", found_type)]) if done else state_schema
        packed = met.select("_block", "_group", "_anchors", "_rows", *_STATE).mapInArrow(
            _round(low, high - 1, groups, top, len(fields) if done else None), schema
        )
    return packed


def _round(low: int, high: int, groups: int, top: int, columns: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass of the anchor rows ``low`` to ``high`` over every packed row; unpacked at last if ``columns`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = units = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, group = row["_block"][0].as_py(), row["_group"][0].as_py()
                if block == low:
                    rows = row["_rows"].flatten()
                    units = _matrix(rows.flatten()[-1])
                    best = _state_of(row, (groups, len(rows), top))
                numbers, names, vectors = row["_anchors"].flatten().flatten()
                found = _highest(
                    units @ _matrix(vectors).T, numbers.to_numpy(), names.to_numpy(zero_copy_only=False).astype("object"), top
                )
                best[group] = _merge(best[group], found, top)
                if block == high:
                    yield _packed_state(rows, best) if columns is None else _unpacked(rows, best, columns)

    return run


def _state_of(row: pa.RecordBatch, shape: tuple[int, int, int]) -> list[tuple[np.ndarray, ...]]:
    """Per group the best similarities, numbers and names so far; none at first."""
    if row["_best"].null_count:
        return [
            (np.full(shape[1:], _NOTHING), np.full(shape[1:], -1, dtype="int64"), np.full(shape[1:], None, dtype="object"))
            for _ in range(shape[0])
        ]
    columns = [row[c].flatten().to_numpy(zero_copy_only=False).reshape(shape) for c in _STATE]
    return list(zip(*columns))


def _flat(best: list[tuple[np.ndarray, ...]], by_row: bool) -> list[pa.Array]:
    columns = [np.stack(column, axis=1 if by_row else 0).reshape(-1) for column in zip(*best)]
    return [pa.array(column, kind) for column, kind in zip(columns, (pa.float64(), pa.int64(), pa.string()))]


def _lists(values: pa.Array, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), values)


def _packed_state(rows: pa.StructArray, best: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [rows, *_flat(best, False)]
    return pa.RecordBatch.from_arrays([_lists(c, len(c)) for c in columns], ["_rows", *_STATE])


def _unpacked(rows: pa.StructArray, best: list[tuple[np.ndarray, ...]], columns: int) -> pa.RecordBatch:
    entries = pa.StructArray.from_arrays(_flat(best, True), names=["similarity", "number", "name"])
    found = _lists(_lists(entries, best[0][0].shape[1]), len(best))
    names = [rows.type.field(i).name for i in range(columns)]
    return pa.RecordBatch.from_arrays([*rows.flatten()[:columns], found], [*names, "_found"])


def text_chunks(
    df: DataFrame, text: str = "feedback_text", review: str = "review_id", sentence_level: bool = True
) -> DataFrame:
    """What gets an embedding: one row per sentence of more than eight characters, or per whole text."""
    pieces = T.chunks(F.col(text)) if sentence_level else F.array(T.text_trim(F.col(text)))
    kept = df.where(~T.is_blank(F.col(text)))
    return kept.select(review, F.posexplode(pieces).alias("chunk", text))


def score_aspect_vectors(
    chunks: DataFrame,
    anchors: DataFrame,
    review: str = "review_id",
    vector: str = "embedding",
) -> DataFrame:
    """Aspect records per review from the embeddings of its chunks.

    ``anchors`` has ``aspect``, ``pole`` ("positive" or "negative") and
    ``embedding``. Per chunk, each pole scores the mean of its three best
    similarities; the higher pole is the relevance of the chunk and weighs its
    net score. The result has one row per review with a vector and a map
    ``aspect_detail``; reviews without one are left to the rules. Vectors with
    missing entries count as missing. There may be any number of anchors (see
    :func:`nearest_anchors`); aspects become entries of the plan. An aspect with
    anchors of one pole only has similarity 0 to the other.
    """
    anchors = anchors.where(_usable(F.col("embedding"))).withColumn("number", F.monotonically_increasing_id())
    anchors = materialise(anchors.select("aspect", "pole", "number", "embedding"), "aspect-anchors")
    counted = anchors.groupBy("aspect", "pole").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).collect()
    sizes = {(r["aspect"], r["pole"]): r["n"] for r in counted}
    given = {aspect for aspect, _ in sizes}
    names = [a for a in K.ASPECTS if a in given]
    names += sorted(given - set(names))
    groups = [(a, pole) for a in names for pole in ("positive", "negative")]
    chunks = chunks.select(review, vector).where(_usable(F.col(vector)))
    number_of = F
    for i, (aspect, pole) in enumerate(groups):
        number_of = number_of.when((F.col("aspect") == aspect) & (F.col("pole") == pole), i)
    if groups:
        anchors = anchors.withColumn("group", number_of).where(F.col("group").isNotNull())
    else:
        anchors = anchors.withColumn("group", F.lit(0))
    width = max([r["width"] for r in counted], default=0)
    found = nearest_anchors(chunks, anchors, [sizes.get(g, 0) for g in groups], width, vector, K.TOP_SIMILARITIES)
    means = []
    for i, key in enumerate(groups):
        most = min(K.TOP_SIMILARITIES, sizes.get(key, 0))
        total = F.lit(0.0)
        for j in range(most):
            total = total + F.col("_found")[i][j]["similarity"]
        means.append(total / F.lit(float(most)) if most else F.lit(0.0))
    df = found.select(review, F.array(*means).alias("_sims"))
    # Four-decimal values as whole numbers: sums are exact for every order of the chunks.
    columns: dict[str, Column] = {}
    for i in range(len(names)):
        positive, negative = F.col("_sims")[2 * i], F.col("_sims")[2 * i + 1]
        columns[f"_p{i}"] = F.round(F.round(positive, 4) * 10000).cast("bigint")
        columns[f"_n{i}"] = F.round(F.round(negative, 4) * 10000).cast("bigint")
        net = F.round((positive - negative + 1.0) / 2.0 * 10.0, 4)
        columns[f"_s{i}"] = F.round(net * 10000).cast("bigint")
    df = df.select(review, *[v.alias(n) for n, v in columns.items()])
    sums: list[Column] = [F.count("*").alias("_chunks")]
    for i in range(len(names)):
        relevance = F.greatest(F.col(f"_p{i}"), F.col(f"_n{i}"))
        sums += [
            F.sum(f"_p{i}").alias(f"p{i}"),
            F.sum(f"_n{i}").alias(f"n{i}"),
            F.sum(f"_s{i}").alias(f"s{i}"),
            F.sum(F.col(f"_s{i}") * relevance).alias(f"sw{i}"),
            F.sum(relevance).alias(f"w{i}"),
            F.max(relevance).alias(f"r{i}"),
        ]
    totals = df.groupBy(review).agg(*sums)
    entries: list[Column] = []
    unit = F.lit(10000.0)
    for i, name in enumerate(names):
        weighted = F.col(f"sw{i}") / F.col(f"w{i}") / unit
        plain = F.col(f"s{i}") / F.col("_chunks") / unit
        relevance = F.col(f"r{i}") / unit
        record = F.struct(
            F.round(F.when(F.col(f"w{i}") > 0, weighted).otherwise(plain), 4).alias("score_10"),
            F.round(relevance, 4).alias("relevance"),
            F.round(F.col(f"p{i}") / F.col("_chunks") / unit, 4).alias("positive_sim"),
            F.round(F.col(f"n{i}") / F.col("_chunks") / unit, 4).alias("negative_sim"),
            (relevance > K.VECTOR_DETECTED_THRESHOLD).alias("detected"),
        )
        entries += [F.lit(name), record]
    return totals.select(review, F.create_map(*entries).alias("aspect_detail"))


def detect_aspect_vectors(
    texts: DataFrame,
    aspects: DataFrame,
    vector: str = "embedding",
    top_k: int = K.DETECT_TOP_K,
    threshold: float = K.DETECT_THRESHOLD,
) -> DataFrame:
    """Add ``aspects`` (none without a vector): the aspects whose vector is most similar to the text's.

    ``aspects`` has one row per aspect (``aspect``, ``embedding``), for example
    the :func:`mean_vectors` of its phrases. Aspects without a vector are left
    out, ties go by name.
    """
    aspects = materialise(aspects.where(_usable(F.col("embedding"))).select("aspect", "embedding"), "aspects")
    size = aspects.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    numbered = with_rank(aspects, [F.asc("aspect")], size["rows"], "number")
    numbered = numbered.select(F.lit(0).alias("group"), "number", F.col("aspect").alias("name"), "embedding")
    numbered = materialise(numbered, "numbered-aspects")
    known = _usable(F.col(vector))
    rows = texts.withColumn("_row", F.when(known, F.col(vector).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), size["width"])))
    found = nearest_anchors(rows, numbered, [size["rows"]], size["width"], "_row", top_k).drop("_row")
    scored = F.transform(
        F.filter(F.col("_found")[0], lambda a: (a["number"] > 0) & known),
        lambda a: F.struct(a["name"].cast(aspects.schema["aspect"].dataType).alias("aspect"), a["similarity"].alias("score")),
    )
    return found.withColumn("aspects", top_aspects(scored, top_k, threshold)).drop("_found")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; 0 when one of them has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)

    product = total(F.zip_with(a, b, lambda x, y: x * y))
    length = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(length > 0, product / length).otherwise(F.lit(0.0))
