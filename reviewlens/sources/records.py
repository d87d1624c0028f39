"""CSV records that hold line breaks, read in parallel: quote-parity prefix scan.

A split of a file can't tell by itself whether it begins inside a quoted value. Each
split counts its quotes; the parity of all quotes before a split tells. With that
every task cuts its own lines into records, and only the two ends of a split, which
may be parts of one record, are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.session import materialise

# So many splits (some 100 bytes each) are broadcast; more are joined in a shuffle.
BROADCAST_SPLITS = 100_000
_TAIL = 1


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines in the order of their split; a carriage return stays, as it may belong to a value."""
    value: Column = F.col("value")
    if encoding != "UTF-8":
        value = F.decode(value.cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", excepted: list[str] | None = None) -> DataFrame:
    """The records below the header of each file, as text: ``file, record``; blank lines are none.

    Quotes inside quoted values are doubled. Where a file's lines end with a
    carriage return and a line feed, those in values become line feeds, as in
    Spark's reader. ``excepted`` are files under the path to leave out. A quote that is never closed makes the rest of its file
    one record, as it does for a reader of whole files.
    """
    lines = _lines(spark, path, encoding)
    if excepted:
        lines = lines.where(~F.col("file").isin(excepted))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg(
        F.sum(quotes).alias("quotes"), F.min_by(F.col("value").endswith("\r"), "row").alias("returns")
    )
    places = Window.partitionBy("file").orderBy("block")
    inside = F.coalesce(F.sum("quotes").over(places.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    splits = splits.select("file", "block", inside.alias("inside"), F.first("returns").over(places).alias("returns"))
    splits = materialise(splits, "csv-splits")
    known = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    lines = lines.join(known, ["file", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, part, skip, returns = None, [], False, None, False, False
        done: list[tuple] = []

        def end_split() -> None:
            if held:
                done.append((*at, part if part == 0 else _TAIL, returns, "\n".join(held)))
                held.clear()

        for batch in batches:
            odd = [n % 2 == 1 for n in pc.count_substring(batch.column("value"), '"').to_pylist()]
            columns = (batch.column(name).to_pylist() for name in ("file", "block", "value", "inside", "returns"))
            for (file, block, value, begins_inside, ending), turns in zip(zip(*columns, strict=True), odd, strict=True):
                if (file, block) != at:
                    if at:
                        end_split()
                    at, inside, returns = (file, block), begins_inside, ending
                    part, skip = (0 if inside else None), block == 0
                held.append(value)
                inside ^= turns
                if inside:
                    continue
                if skip:
                    skip = False
                else:
                    done.append((file, block, part, returns, "\n".join(held)))
                part = None
                held.clear()
            if len(done) >= 4096:
                yield _rows(done)
                done.clear()
        if at:
            end_split()
        yield _rows(done)

    schema = "file string, block bigint, part int, returns boolean, record string"
    found = lines.select("file", "block", "value", "inside", "returns").mapInArrow(cut, schema)
    whole = found.where("part is null").select("file", "returns", "record")
    # At most two per split: the end of a record begun before, and the beginning of one that goes on.
    ends = materialise(found.where("part is not null"), "csv-ends")
    chain = F.sum("part").over(Window.partitionBy("file").orderBy("block", "part"))
    ends = ends.withColumn("chain", chain).groupBy("file", "returns", "chain").agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("parts")
    )
    ends = ends.select("file", "returns", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    feeds = F.when(F.col("returns"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    records = whole.unionByName(ends).select("file", F.regexp_replace(feeds, r"\r\z", "").alias("record"))
    return records.where(F.trim("record") != "")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = zip(*done, strict=True) if done else ((), (), (), (), ())
    types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["file", "block", "part", "returns", "record"])


def parsed_records(records: DataFrame, names: list[str]) -> DataFrame:
    """The columns of CSV records, all strings."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return records.select(F.from_csv("record", schema, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
