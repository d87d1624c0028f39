"""Review sources: CSV, text lines, cleaning, validation and generated samples."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from reviewlens import constants as K
from reviewlens.functions import text as T
from reviewlens.sources.records import csv_records, parsed_records

# Accepted date spellings, tried in this order after :func:`_plain_date`. Where both readings are possible, the month
# comes before the day.
_TIME = "[ H:m[:s[.SSSSSS][.SSS]]][XXX]"
DATE_FORMATS = (
    f"yyyy-M-d{_TIME}",
    "yyyy-M-d h:m[:s] a",
    f"M/d/yyyy{_TIME}",
    "M/d/yyyy h:m[:s] a",
    f"d/M/yyyy{_TIME}",
    "d/M/yyyy h:m[:s] a",
    "M/d/yy[ H:m[:s]]",
    "M/d/yy h:m[:s] a",
    "d/M/yy[ H:m[:s]]",
    "d/M/yy h:m[:s] a",
    "yyyyMMdd",
    f"d MMM yyyy{_TIME}",
    f"d MMMM yyyy{_TIME}",
    f"MMM d yyyy{_TIME}",
    f"MMMM d yyyy{_TIME}",
    "d MMM yyyy h:m[:s] a",
    "MMM d yyyy h:m[:s] a",
    "MMMM d yyyy h:m[:s] a",
    "d MMM yy",
    "MMM yyyy",
    "MMMM yyyy",
    "yyyy-M",
    "yyyy",
)
_WEEKDAYS = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[.,]? "
_NUMBERS = r"^(\d{1,2})/(\d{1,2})/\d{2,4}(?!\d)"


def load_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A Parquet table as Spark reads it: files are cut by ``spark.sql.files.maxPartitionBytes`` and row groups."""
    return spark.read.parquet(path)


def _header_names(line: str) -> list[str]:
    """Column names of a header line; unnamed ones get their place, repeated ones a number."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    seen: set[str] = set()
    for place, name in enumerate(names):
        name = name or f"_c{place}"
        if name.lower() in seen:
            name = f"{name}{place}"
        seen.add(name.lower())
        names[place] = name
    return names


def _read_csv(
    spark: SparkSession, path: str | list[str], header: str, encoding: str, multi_line: bool, excepted: list[str] | None = None
) -> DataFrame:
    names = _header_names(header)
    if multi_line:
        return parsed_records(csv_records(spark, path, encoding, excepted), names)
    schema = types.StructType([types.StructField(name, types.StringType()) for name in names])
    rows = spark.read.option("header", True).option("escape", '"').option("encoding", encoding).schema(schema).csv(path)
    return rows.where(~F.col("_metadata.file_path").isin(excepted)) if excepted else rows


def csv_layouts(spark: SparkSession, path: str | list[str]) -> list[Row]:
    """The layouts of CSV files: encoding, header, multi_line, the number of files, the most frequent first.

    A file is UTF-8 unless a line is not valid, then Latin-1; it is
    ``multi_line`` if a quoted value may hold a line break. One pass over the
    files; as many rows come back as there are layouts.
    """
    return _file_layouts(spark, path).groupBy("encoding", "header", "multi_line").count().orderBy(
        F.desc("count"), "encoding", "header", "multi_line"
    ).collect()


def _file_layouts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    files = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.bool_or(quotes % 2 == 1).alias("multi_line"),
        F.min_by(F.col("value").cast("binary"), F.struct("block", "row")).alias("first"),
    )
    encoding = F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")
    header = F.when(F.col("valid"), F.decode("first", "UTF-8")).otherwise(F.decode("first", "ISO-8859-1"))
    return files.select("file", encoding.alias("encoding"), F.rtrim(header).alias("header"), "multi_line")


def load_csv(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """Cleaned reviews from CSV files with a header, which may differ in columns, their order and encoding.

    Values are read as text and cast leniently afterwards. A first pass finds
    the layouts (an action). Files of the most frequent one are read by the
    given path, so that only the names of the others come to the driver.
    Large files are cut, those with line breaks in quoted values as well
    (``csv_records``); ``multi_line`` says for all files whether there are any.
    """
    layouts = csv_layouts(spark, path)
    if not layouts:
        raise ValueError(f"No rows in {path}.")
    others: dict[Row, list[str]] = {layout: [] for layout in layouts[1:]}
    if others:
        main = layouts[0]
        same = (
            (F.col("encoding") == main["encoding"])
            & F.col("header").eqNullSafe(main["header"])
            & (F.col("multi_line") == main["multi_line"])
        )
        by_layout = {tuple(layout)[:3]: layout for layout in others}
        for row in _file_layouts(spark, path).where(~same).orderBy("file").toLocalIterator():
            others[by_layout[(row["encoding"], row["header"], row["multi_line"])]].append(row["file"])

    def read(layout: Row, files: str | list[str], excepted: list[str] | None = None) -> DataFrame:
        broken = layout["multi_line"] if multi_line is None else multi_line
        return _read_csv(spark, files, layout["header"], layout["encoding"], broken, excepted)

    df = normalise_columns(read(layouts[0], path, [file for files in others.values() for file in files]))
    for layout, files in others.items():
        df = df.unionByName(normalise_columns(read(layout, files)), allowMissingColumns=True)
    return clean_reviews(_with_written_text(df))


def _with_written_text(df: DataFrame) -> DataFrame:
    """Of columns that are all strings, the first that holds more than numbers and truth values is the text."""
    if "feedback_text" in df.columns:
        return df
    value = lambda name: T.text_trim(F.col(f"`{name}`"))
    plain = [
        F.bool_and(
            (value(name) == "") | value(name).try_cast("double").isNotNull() | F.lower(value(name)).isin("true", "false")
        ).alias(f"c{place}")
        for place, name in enumerate(df.columns)
    ]
    found = df.agg(*plain).first()
    for name, numeric in zip(df.columns, found):
        if numeric is False:
            return df.withColumnRenamed(name, "feedback_text")
    raise ValueError("Dataset must contain a text column for feedback.")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename columns to the canonical names by alias; the first alias of the list wins."""
    by_name = {c.lower().strip(): c for c in df.columns}
    renamed = {}
    for canonical, aliases in K.COLUMN_ALIASES.items():
        if canonical in df.columns:
            continue
        for alias in aliases:
            if alias in by_name:
                renamed[by_name[alias]] = canonical
                break
    return df.withColumnsRenamed(renamed)


def with_text_column(df: DataFrame) -> DataFrame:
    """Without a text column the first string column becomes it."""
    if "feedback_text" in df.columns:
        return df
    for field in df.schema.fields:
        if isinstance(field.dataType, types.StringType):
            return df.withColumnRenamed(field.name, "feedback_text")
    raise ValueError("Dataset must contain a text column for feedback.")


def _plain_date(value: Column) -> Column:
    """One spelling for separators, so that few patterns are left: 2024-1-5, 1/2/2024, 5 Jan 2024."""
    plain = F.regexp_replace(T.text_trim(value), r"\s+", " ")
    plain = F.regexp_replace(plain, _WEEKDAYS, "")
    plain = F.regexp_replace(plain, r"(?i)\b(sep)t\b", "$1")
    plain = F.regexp_replace(plain, r"(?i)^(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    plain = F.regexp_replace(plain, r"(?i)(:\d{2}(?:\.\d+)?) ?(?:utc|gmt)$", "$1Z")
    plain = F.regexp_replace(plain, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3")
    plain = F.regexp_replace(plain, r"^(\d{1,2})[-.](\d{1,2})[-.](\d{2,4})(?!\d)", "$1/$2/$3")
    plain = F.regexp_replace(plain, r"^(\d{1,2})[- ]([A-Za-z]{3,9})\.?[- ,]+(\d{2,4})", "$1 $2 $3")
    plain = F.regexp_replace(plain, r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", "$1 $2 $3")
    plain = F.regexp_replace(plain, r"(?<=\d)[Tt](?=\d)", " ")
    plain = F.regexp_replace(plain, r"(?<=\d) ?([AaPp])\.?[Mm]\.?$", " $1M")
    return F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?) ?([+-]\d{2}):?(\d{2})$", "$1$2:$3")


def lenient_timestamp(value: Column, day_first: Column | bool = False) -> Column:
    """A timestamp from any of the accepted spellings, else NULL.

    ``day_first`` tells how 1/2/2024 is read, see :func:`day_comes_first`; 25/12/2024 has one reading only.
    """
    plain = _plain_date(value)
    parsed = [F.try_to_timestamp(plain, F.lit(pattern)) for pattern in DATE_FORMATS]
    if day_first is not False:
        turned = [F.try_to_timestamp(plain, F.lit(p)) for p in DATE_FORMATS if p.startswith("d/M/")]
        parsed.insert(0, F.when(F.lit(day_first) & plain.rlike(_NUMBERS), F.coalesce(*turned)))
    return F.coalesce(*parsed).cast("timestamp_ntz")


def day_comes_first(date: Column) -> Column:
    """Aggregate: whether a column's dates like 1/2/2024 begin with the day.

    A vote of the values that have one reading only: more of them have a first
    number above 12 than a second one. Without such values the month is first.
    """
    plain = _plain_date(date)
    first, second = (F.regexp_extract(plain, _NUMBERS, group).try_cast("int") for group in (1, 2))
    days, months = (F.count_if((a > 12) & b.between(1, 12)) for a, b in ((first, second), (second, first)))
    return F.coalesce(days > months, F.lit(False))


def date_report(df: DataFrame, date: str = "date") -> DataFrame:
    """One row about a text column of dates: rows, blank ones, dates read and not read, and whether the day comes first."""
    value = F.col(date)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(T.is_blank(value)).alias("n_blank"),
        F.count(lenient_timestamp(value)).alias("n_read"),
        unparsed_dates(value).alias("n_unread"),
        day_comes_first(value).alias("day_first"),
    )


def unparsed_dates(date: Column) -> Column:
    """Aggregate: how many values of a text column are dates in no accepted spelling."""
    return F.count_if((T.text_trim(date) != "") & lenient_timestamp(date).isNull())


def with_normalised_rating(df: DataFrame, highest: float | None = None) -> DataFrame:
    """Ratings as numbers, and on a 0-100 scale when the highest is 10 or less.

    The highest rating is looked up in a first pass over the rows, unless given.
    """
    df = df.withColumn("rating", F.col("rating").try_cast("double"))
    df = df.withColumn("rating", F.when(~F.isnan("rating"), F.col("rating")))
    df = df.withColumn("_highest", df.agg(F.max("rating")).scalar() if highest is None else F.lit(float(highest)))
    scalable = (F.col("_highest") != 0) & (F.col("_highest") <= 10)
    scaled = F.when(scalable, F.round(F.col("rating") / F.col("_highest") * 100, 1)).otherwise(F.col("rating"))
    return df.withColumn("rating_normalized", scaled).drop("_highest")


def clean_reviews(df: DataFrame, highest_rating: float | None = None, day_first: bool | None = None) -> DataFrame:
    """Drop empty rows and texts of five characters or less; parse dates and ratings if present.

    Ratings are scaled by the highest one of the kept rows, and dates read with
    the day or the month first as most of them tell, unless these are given.
    """
    df = with_text_column(normalise_columns(df.na.drop("all")))
    df = df.withColumn("feedback_text", T.text_trim(F.col("feedback_text").cast("string")))
    df = df.where(F.length("feedback_text") > 5)
    if "date" in df.columns and isinstance(df.schema["date"].dataType, types.StringType):
        if day_first is None:
            df = df.withColumn("_day_first", df.agg(day_comes_first(F.col("date"))).scalar())
        else:
            df = df.withColumn("_day_first", F.lit(day_first))
        df = df.withColumn("date", lenient_timestamp(F.col("date"), F.col("_day_first"))).drop("_day_first")
    if "rating" in df.columns:
        df = with_normalised_rating(df, highest_rating)
    return df


def with_review_id(df: DataFrame) -> DataFrame:
    """Add ``review_id`` in reading order. Write the table afterwards, so that the ids stay."""
    return df if "review_id" in df.columns else df.withColumn("review_id", F.monotonically_increasing_id())


def reviews_from_lines(df: DataFrame, block: str, entity: str) -> DataFrame:
    """One review per non-empty line of each text block, with the line's position."""
    lines = F.split(block, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    spread = df.select(*[c for c in df.columns if c != block], F.posexplode(lines).alias("line", "feedback_text"))
    spread = spread.withColumn("feedback_text", T.text_trim(F.col("feedback_text")))
    named = F.when(F.col(entity) != "", F.col(entity)).otherwise("Teacher A")
    return spread.where(F.col("feedback_text") != "").withColumn("teacher_name", named)


def load_lines(spark: SparkSession, path: str | list[str], entity: str) -> DataFrame:
    """One review per non-empty line of text files, all about one entity."""
    blocks = spark.read.text(path).withColumn("_entity", F.lit(entity))
    return reviews_from_lines(blocks, "value", "_entity").select("teacher_name", "feedback_text")


def semester(date: Column) -> Column:
    """``Spring YYYY`` until June, then ``Fall YYYY``."""
    season = F.when(F.month(date) <= 6, "Spring ").otherwise("Fall ")
    return F.concat(season, F.year(date).cast("string"))


def validate(df: DataFrame) -> DataFrame:
    """One row: validity, row count, which columns exist, share of missing texts, warnings."""
    has = {c: c in df.columns for c in ("feedback_text", "teacher_name", "date", "rating")}
    missing = F.lit(0)
    if has["feedback_text"]:
        missing = F.count_if(F.col("feedback_text").isNull() | (F.col("feedback_text") == ""))
    unparsed, undated = F.lit(0), F.lit(0)
    if has["date"] and isinstance(df.schema["date"].dataType, types.StringType):
        unparsed = unparsed_dates(F.col("date"))
    elif has["date"]:
        undated = F.count_if(F.col("date").isNull())
    stats = df.agg(
        F.count("*").alias("n_rows"), missing.cast("bigint").alias("_missing"), unparsed.cast("bigint").alias("_unparsed"),
        undated.cast("bigint").alias("_undated"),
    )
    percent = F.when(F.col("n_rows") > 0, F.round(F.col("_missing") / F.col("n_rows") * 100, 2)).otherwise(F.lit(0.0))
    stats = stats.withColumn("missing_pct", percent)
    pct = F.col("missing_pct")
    warnings: list[Column] = []
    if not has["feedback_text"]:
        warnings.append(F.lit("Missing required column: feedback_text"))
    warnings.append(
        F.when(pct > 20, F.concat(pct.cast("string"), F.lit("% of feedback entries are empty or missing.")))
    )
    if not has["teacher_name"]:
        warnings.append(F.lit("No 'teacher_name' column found — analysis will be aggregated."))
    if not has["date"]:
        warnings.append(F.lit("No 'date' column found — trend analysis will be unavailable."))
    dates = F.concat(F.col("_unparsed").cast("string"), F.lit(" dates could not be read."))
    warnings.append(F.when(F.col("_unparsed") > 0, dates))
    warnings.append(F.when(F.col("_undated") > 0, F.concat(F.col("_undated").cast("string"), F.lit(" rows have no date."))))
    return stats.select(
        F.lit(has["feedback_text"]).alias("is_valid"),
        "n_rows",
        F.lit(has["teacher_name"]).alias("has_teacher_col"),
        F.lit(has["date"]).alias("has_date_col"),
        F.lit(has["rating"]).alias("has_rating_col"),
        "missing_pct",
        F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def _draw(salt: str, seed: int, choices: int) -> Column:
    """A number from 0 to ``choices`` - 1 that depends on the row id, the seed and the salt only."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(choices)).cast("int")


def _pick(values: Sequence[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def sample_reviews(spark: SparkSession, rows: int = 150, entities: int = 5, seed: int = 42) -> DataFrame:
    """Generated reviews: five parts positive, three neutral, two negative, with matching ratings.

    Rows are drawn by hashing their number, so they are the same for every partitioning.
    """
    chosen = K.SAMPLE_ENTITIES[: max(1, min(entities, len(K.SAMPLE_ENTITIES)))]
    tickets = [(t, low, high) for pool, weight, low, high in K.SAMPLE_POOLS for t in pool * weight]
    ticket = _draw("text", seed, len(tickets))
    who = _draw("entity", seed, len(chosen))
    low = F.get(F.array(*[F.lit(t[1]) for t in tickets]), ticket)
    high = F.get(F.array(*[F.lit(t[2]) for t in tickets]), ticket)
    part = _draw("rating", seed, 10_001) / F.lit(10_000.0)
    df = spark.range(rows).select(
        F.col("id").alias("review_id"),
        _pick([t[0] for t in tickets], ticket).alias("feedback_text"),
        _pick([e for e, _ in chosen], who).alias("teacher_name"),
        _pick([s for _, s in chosen], who).alias("subject"),
        F.round(low + (high - low) * part, 1).alias("rating"),
        F.date_add(F.lit("2024-01-01").cast("date"), _draw("date", seed, 366)).cast("string").alias("date"),
    )
    return clean_reviews(df)


def sample_corpus(
    spark: SparkSession,
    rows: int,
    positive: Sequence[str],
    negative: Sequence[str],
    neutral: Sequence[str],
    entities: Sequence[tuple[str, str]],
    seed: int = 42,
) -> DataFrame:
    """A generated corpus of distinct texts from sentence pools, in date order.

    45 of 100 draws are positive, 30 negative, 15 neutral and 10 join a
    positive and a negative sentence. Repeated texts are dropped, so there may
    be fewer than ``rows``.
    """
    share = _draw("class", seed, 100)
    kinds, bound = F, 0
    for kind, weight in K.CORPUS_SHARES:
        bound += weight
        kinds = kinds.when(share < bound, kind)
    good = _pick(positive, _draw("positive", seed, len(positive)))
    bad = _pick(negative, _draw("negative", seed, len(negative)))
    plain = _pick(neutral, _draw("neutral", seed, len(neutral)))
    mixed = _pick(K.MIXED_PATTERNS, _draw("pattern", seed, len(K.MIXED_PATTERNS)))
    mixed = F.replace(mixed, F.lit("{pos}"), F.rtrim(good, F.lit(".")))
    mixed = F.replace(mixed, F.lit("{neg}"), F.lower(F.rtrim(bad, F.lit("."))))
    who = _draw("entity", seed, len(entities))
    df = spark.range(rows).select(
        "id",
        _pick([e for e, _ in entities], who).alias("teacher_name"),
        _pick([s for _, s in entities], who).alias("subject"),
        F.when(kinds == "pos", good)
        .when(kinds == "neg", bad)
        .when(kinds == "neu", plain)
        .otherwise(F.concat(mixed, F.lit(".")))
        .alias("feedback_text"),
        F.date_add(F.lit("2023-01-10").cast("date"), _draw("date", seed, 711)).alias("date"),
    )
    first = df.groupBy("feedback_text").agg(F.min("id").alias("id"))
    unique = df.join(first, ["id", "feedback_text"], "left_semi").withColumn("semester", semester(F.col("date")))
    columns = ("teacher_name", "subject", "feedback_text", "semester", F.col("date").cast("string").alias("date"))
    return unique.orderBy("date", "id").select(*columns)
