"""Best-fit packing of token sequences: hierarchical residual packing.

Every partition packs its own items best-fit. Nearly full bins are final; the
others become items of the next, smaller set of partitions, until no smaller one
holds them or a round no longer joins bins. A bin is at most ``length`` items, so
a row is bounded, and a task packs at most ``items_per_task`` rows at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import materialise, pick, table

END_ID = 2
LENGTH = 1024
ITEMS_PER_TASK = 200_000
NEARLY_FULL = 0.995
SPECIAL = {"<|endoftext|>": 50256}
#: Fixed value: the published splitting pattern of this vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_PIECE = "piece int, start bigint, length bigint, ids binary, item bigint"
_ENCODERS: dict[str, object] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The byte-level vocabulary at ``path``, loaded once per worker.

    Special strings inside a text become their own id, as by the vocabulary's
    JSON form with its defaults.
    """
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def token_ids(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """Ids of the whole text, then ``end_id``; a null text counts as empty."""
    ids = encoder(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, end_id).astype("<u4")


def pieces(docs: DataFrame, key: str, text: str, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids (little-endian) and a number unique to the row.

    Sequences longer than ``length`` are cut into pieces of ``length`` ids; the
    first one holds the rest and may be shorter. Repeated rows, and rows with a
    null key, are separate items.
    """
    chosen = pick(docs, doc_id=key, text=text)
    schema = f"doc_id {dict(chosen.dtypes)['doc_id']}, {_PIECE}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, owner = [], []
                for row, value in enumerate(part.column("text").to_pylist()):
                    ids = token_ids(value, path, end_id)
                    begins = [0, *range(len(ids) % length or length, len(ids), length)]
                    for n, (begin, stop) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
                        rows.append((n, begin, stop - begin, ids[begin:stop].tobytes(), number))
                        owner.append(row)
                        number += 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner, pa.int32())), *arrays],
                    ["doc_id", "piece", "start", "length", "ids", "item"],
                )

    return chosen.mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of positions in ``sizes``: largest first, each into the fullest bin that still has room."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms = 0
    bins: list[list[int]] = []
    for position in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[position])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
            bins[chosen].append(position)
        else:
            left, chosen = length, len(bins)
            bins.append([position])
        left -= size
        if left:
            room[left].append(chosen)
            open_rooms |= 1 << left
    return bins


def _packer(length: int, tag: int, most: int):
    """Joins the bins of a partition, at most ``most`` at a time; ``fill`` is a bin's size, ``items`` and ``sizes`` its content in order."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        got: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            while batch.num_rows:
                got.append(batch.slice(0, most - held))
                batch = batch.slice(got[-1].num_rows)
                held += got[-1].num_rows
                if held == most:
                    yield pa.Table.from_batches(got).combine_chunks()
                    got, held = [], 0
        if got:
            yield pa.Table.from_batches(got).combine_chunks()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (tag << 56) | (TaskContext.get().partitionId() << 32)
        for whole in parts(batches):
            fills = whole.column("fill").to_numpy()
            packed = best_fit(fills, length)
            order = pa.array(np.fromiter((p for b in packed for p in b), np.int64, len(fills)))
            ends = np.cumsum([0, *(len(b) for b in packed)])
            # Concatenating the lists of a new bin only moves list offsets, as its bins are neighbours after take().
            arrays = []
            for name in ("items", "sizes"):
                lists = whole.column(name).take(order).combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                offsets = np.asarray(lists.offsets)[ends]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.values))
            total = np.add.reduceat(fills[np.asarray(order)], ends[:-1])
            number = pa.array(first + np.arange(len(packed), dtype=np.int64))
            first += len(packed)
            result = pa.Table.from_arrays([number, pa.array(total), *arrays], ["sequence_id", "fill", "items", "sizes"])
            yield from result.to_batches(max_chunksize=4096)

    return pack


def pack(
    items: DataFrame, length: int = LENGTH, items_per_task: int = ITEMS_PER_TASK, nearly_full: float = NEARLY_FULL
) -> DataFrame:
    """Place of every row of ``items`` (item bigint unique, length 1..``length``): item, sequence_id, offset.

    ``items`` has to be a written table: it is read by each first round. An
    empty table gives an empty result.
    """
    spark = items.sparkSession
    schema = "sequence_id bigint, fill bigint, items array<bigint>, sizes array<bigint>"
    full = items.where(F.col("length") >= length).select(
        "item", F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    bins = items.where(F.col("length") < length).select(
        F.col("length").alias("fill"), F.array("item").alias("items"), F.array("length").alias("sizes")
    )
    closed, tag, before, parts = [], 1, None, None
    while True:
        packed = bins if parts is None else bins.repartition(parts)
        packed = materialise(packed.mapInArrow(_packer(length, tag, items_per_task), schema), "packed")
        open_bins = packed.where(F.col("fill") < F.lit(nearly_full * length))
        left = open_bins.count()
        # A quarter of the tasks, but as many as the bins need.
        wanted = -(-left // items_per_task)
        fewer = wanted if parts is None else max(wanted, parts // 4)
        last = left == 0 or (before is not None and (fewer >= parts or left > 0.98 * before))
        closed.append(packed if last else packed.where(F.col("fill") >= F.lit(nearly_full * length)))
        if last:
            break
        bins, before, parts, tag = open_bins.select("fill", "items", "sizes"), left, fewer, tag + 1
    placed = closed[0]
    for more in closed[1:]:
        placed = placed.union(more)
    placed = placed.select(
        "sequence_id", F.posexplode("items").alias("position", "item"), F.col("sizes")
    ).withColumn(
        "offset", F.expr("aggregate(slice(sizes, 1, position), 0L, (total, size) -> total + size)")
    )
    return full.unionByName(placed.select("item", "sequence_id", "offset")).select("item", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``with_ids`` keeps the token ids.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end id alone; repeated rows are packed
    repeatedly; a null key is kept; other columns of ``docs`` do not matter.
    """
    cut = pieces(docs, key, text, path or vocabulary(), length, end_id).withColumn("ids_crc32", F.crc32("ids"))
    cut = materialise(cut if with_ids else cut.drop("ids"), "pieces")
    places = pack(cut.select("item", "length"), length)
    joined = cut.join(places, "item")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return joined.select(*kept, *(["ids"] if with_ids else []))


def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))
