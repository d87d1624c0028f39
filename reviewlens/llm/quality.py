"""Quality rules: counts per document, and lines that too many documents of a host share.

DataFrame functions only. The line rule shuffles a hash per distinct line of a
document. The texts stay where they were read as long as the common lines fit a
broadcast; beyond that the documents are joined with the lines that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import materialise, pick, table
from reviewlens.operators.skew import lookup_join

SPACES = " \t\n\x0b\f\r"
#: A line is common if more than so many distinct texts of a host hold it, and more than so many square roots of the
#: number of its distinct texts: 5 of 16, 32 of 1,000, 1,001 of 1,000,000.
LINE_TEXTS, LINE_ROOTS = 4, 1
#: A document is depleted if fewer than this share of its words are left.
WORDS_LEFT = 0.5
#: Common lines (24 bytes each) that are broadcast: of all hosts, and of one host. Beyond, rows are joined in a shuffle.
BROADCAST_LINES, HOST_LINES = 200_000, 2_000

_WORDS = r"[ \t-\r]+"
_SYMBOLS = "[#*$%&|<>]+"


def words(text: Column) -> Column:
    """Words between ASCII white space; none for an empty or a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WORDS))


def line_hashes(text: Column) -> Column:
    """A hash per line of a text, in order: case and white space do not count; null for a line without a word."""
    lines = F.split(F.regexp_replace(F.lower(text), r"[ \t\x0B\f\r]+", " "), " ?\n ?")
    lines = F.transform(lines, lambda line: F.btrim(line))
    return F.transform(lines, lambda line: F.when(line != "", F.xxhash64(line)))


def text_lines(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, host, text, text_key): each line of each document once, as (host, doc_id, text_key, line)."""
    lines = rows.select("host", "doc_id", "text_key", F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("line"))
    return lines.where("line is not null")


def common_lines(rows: DataFrame, least: int = LINE_TEXTS, roots: float = LINE_ROOTS) -> DataFrame:
    """The lines that too many distinct texts of a host hold: (host, line, texts, first).

    ``rows`` are (doc_id, host, text, text_key), the host not null. ``first`` is
    the smallest key with the line: that document keeps it. Copies of one text
    count once. The limit grows as the square root of the host's texts, so a
    host has at most (mean lines per text) x (square root of its texts) of them.
    """
    holders = text_lines(rows).groupBy("host", "line", "text_key").agg(F.min("doc_id").alias("first"))
    holders = holders.groupBy("host", "line").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    holders = holders.where(F.col("texts") > least)
    hosts = rows.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("all_texts"))
    hosts = materialise(hosts, "host-texts")
    common = lookup_join(holders, hosts.withColumn("weight", F.col("all_texts")), "host", "weight", F.col("line"))
    over = F.col("texts").cast("double") * F.col("texts") > F.col("all_texts") * F.lit(float(roots) ** 2)
    return materialise(common.where(over).select("host", "line", "texts", "first"), "common-lines")


def with_lost_lines(rows: DataFrame, common: DataFrame, most: int = BROADCAST_LINES, per_host: int = HOST_LINES) -> DataFrame:
    """``rows`` (with doc_id, host, text, text_key) and ``lost``: hashes of the common lines that the document loses, or null."""
    sizes = common.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if not sizes["n"]:
        return rows.withColumn("lost", F.lit(None).cast("array<bigint>"))
    if sizes["n"] <= most and sizes["most"] <= per_host:
        entry = F.struct("line", "first")
        sets = common.groupBy("host").agg(F.collect_list("line").alias("_lines"), F.collect_list(entry).alias("_entries"))
        own = F.transform(F.filter("_entries", lambda e: e["first"].eqNullSafe(F.col("doc_id"))), lambda e: e["line"])
        lost = F.array_except(F.array_intersect(line_hashes(F.col("text")), F.col("_lines")), own)
        rows = rows.join(F.broadcast(sets), "host", "left").withColumn("lost", lost)
        return rows.drop("_lines", "_entries")

    # The lines of every distinct text that are common; then the texts get theirs. Hot lines and hot texts are looked up.
    lines = text_lines(rows).groupBy("host", "text_key", "line").agg(F.count("*").alias("copies"))
    lines = lines.withColumn("line_key", F.concat_ws("\u0000", "host", "line"))
    named = common.select(F.concat_ws("\u0000", "host", "line").alias("line_key"), "first", "texts", F.lit(True).alias("found"))
    named = materialise(named, "named-lines")
    spread = F.concat_ws("\u0000", "text_key", "line")
    hits = lookup_join(lines, named, "line_key", "texts", spread).where("found")
    hits = hits.groupBy(F.concat_ws("\u0000", "host", "text_key").alias("_text")).agg(
        F.collect_list(F.struct("line", "first")).alias("_entries"), F.max("copies").alias("_copies")
    )
    hits = materialise(hits, "lost-lines")
    rows = rows.withColumn("_text", F.concat_ws("\u0000", "host", "text_key"))
    rows = lookup_join(rows, hits, "_text", "_copies", F.xxhash64("_text", "doc_id"))
    lost = F.transform(F.filter("_entries", lambda e: ~e["first"].eqNullSafe(F.col("doc_id"))), lambda e: e["line"])
    return rows.withColumn("lost", lost).drop("_text", "_entries")


def left_lines(text: Column, lost: Column) -> Column:
    """The text without its lost lines, the others as written."""
    pairs = F.zip_with(F.split(text, "\n"), line_hashes(text), lambda line, h: F.struct(line.alias("line"), h.alias("h")))
    kept = F.filter(pairs, lambda pair: pair["h"].isNull() | ~F.array_contains(lost, pair["h"]))
    return F.array_join(F.transform(kept, lambda pair: pair["line"]), "\n")


def _repeated_words(words: str) -> tuple[dict[str, Column], Column]:
    """Columns to add, in this order, and the words inside five-word windows that occur twice or more."""
    steps = {
        "_windows": F.expr(
            f"case when size({words}) > 5 then transform(sequence(0, size({words}) - 5), i -> "
            + "xxhash64(" + ", ".join(f"get({words}, i + {k})" for k in range(5)) + ")) else array() end"
        ).cast("array<bigint>"),
        "_order": F.expr(
            "case when size(array_distinct(_windows)) < size(_windows) "
            "then sort_array(transform(_windows, (h, i) -> struct(h, i))) end"
        ),
        "_places": F.expr(
            "sort_array(transform(filter(sequence(0, size(_order) - 1), "
            "j -> get(_order, j).h = get(_order, j - 1).h or get(_order, j).h = get(_order, j + 1).h), "
            "j -> get(_order, j).i))"
        ),
    }
    covered = F.expr(
        "aggregate(zip_with(_places, slice(_places, 2, size(_places)), (a, b) -> least(5, coalesce(b - a, 5))), "
        "0, (total, n) -> total + n)"
    )
    return steps, F.coalesce(covered, F.lit(0)).cast("bigint")


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    least: int = LINE_TEXTS,
    roots: float = LINE_ROOTS,
    words_left: float = WORDS_LEFT,
    with_row: bool = False,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Per row: the key, its counts, base_failed, n_words_left, kept and the text that is left.

    A null text is an empty one and fails by its length. A null host is a host.
    A document is kept if the base rules pass and at least ``words_left`` of its
    words stand in lines that stay. A host of ``least`` distinct texts or fewer
    has no common lines. Repeated rows get equal results; other columns do not
    matter, whatever their names, and an empty table gives an empty result.
    ``with_row`` adds the whole input row as the struct ``row``, its fields by place.
    """
    rows = pick(docs, "row" if with_row else None, doc_id=key, text=text, host=host)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("host", F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("")))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    rows = with_lost_lines(rows, common_lines(rows, least, roots), broadcast_lines)
    rows = rows.withColumn("_words", words(F.col("text")))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    steps, repeated = _repeated_words("_words")
    for name, column in steps.items():
        rows = rows.withColumn(name, column)
    loses = F.coalesce(F.size("lost") > 0, F.lit(False))
    rows = rows.withColumn("left_text", F.when(loses, left_lines(F.col("text"), F.col("lost"))).otherwise(F.col("text")))
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.when(loses, F.size(words(F.col("left_text")))).otherwise(F.size("_words")).cast("bigint").alias("n_words_left"),
        "left_text",
        *(["row"] if with_row else []),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= words_left * F.col("n_words")))


def kept_documents(docs: DataFrame, text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in its columns, without the lines that the rules remove."""
    judged = quality_rules(docs, text=text, with_row=True, **options)
    # Not a filter: one would be pushed below the steps that its columns come from, and evaluate these for every window.
    judged = judged.withColumn("_stays", F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    changed = F.col("n_words_left") < F.col("n_words")
    columns = []
    for place, (name, kind) in enumerate(docs.dtypes):
        column = F.col(f"row.c{place}")
        if name == text:
            column = F.when(changed, F.col("left_text")).otherwise(column)
        elif name == length:
            column = F.when(changed, F.length("left_text").cast(kind)).otherwise(column)
        columns.append(column)
    return judged.select(*columns).toDF(*docs.columns)


OUTPUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "n_words_left", "kept")


def op7_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(table(spark, sf, "documents")).select(*OUTPUT)


#: The rules on a table ``docs`` (row, doc_id, text, source) as SQL; gives ``judged`` with row and left_text as well.
JUDGED_SQL = f"""
  texts as (select row, doc_id, source, coalesce(text, '') as text from docs),
  word_lists as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from texts),
  windows as (
    select row, place, array_to_string(words[place:place + 4], ' ') as words
    from (select row, words, unnest(range(1, len(words) - 3)) as place from word_lists)),
  repeated as (select row, place from windows qualify count(*) over (partition by row, words) > 1),
  covered as (
    select row, count(distinct place + k) as n from repeated, (select unnest(range(0, 5)) as k) group by row),
  raw_lines as (
    select row, doc_id, source, text, place, line,
      trim(regexp_replace(lower(line), '[ \\t\\x0B\\f\\r]+', ' ', 'g')) as normal
    from (select row, doc_id, source, text, unnest(string_split(text, chr(10))) as line,
      generate_subscripts(string_split(text, chr(10)), 1) as place from texts)),
  sources as (select source, count(distinct text) as n from texts group by source),
  common as (
    select l.source, l.normal, min(l.doc_id) as first
    from raw_lines l join sources s on l.source is not distinct from s.source
    where normal <> '' group by l.source, l.normal, s.n
    having count(distinct text) > {LINE_TEXTS} and count(distinct text) ** 2 > {LINE_ROOTS ** 2} * s.n),
  left_texts as (
    select l.row, coalesce(string_agg(l.line, chr(10) order by l.place) filter (
      c.normal is null or c.first is not distinct from l.doc_id), '') as left_text,
      count(*) filter (regexp_matches(l.line, '[^\\x20\\x09-\\x0D]'))
        - count(distinct l.line) filter (regexp_matches(l.line, '[^\\x20\\x09-\\x0D]')) as n_dup_lines
    from raw_lines l left join common c on c.source is not distinct from l.source and c.normal = l.normal
    group by l.row),
  counted as (
    select w.row, w.doc_id, len(w.words) as n_words, coalesce(length(array_to_string(w.words, '')), 0) as word_chars,
      length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      t.n_dup_lines, coalesce(c.n, 0) as n_repeat_words, t.left_text,
      len(regexp_extract_all(t.left_text, '[^\\x20\\x09-\\x0D]+')) as n_words_left
    from word_lists w join left_texts t on t.row = w.row left join covered c on c.row = w.row),
  judged as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
      not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words_left >= {WORDS_LEFT}::double * n_words as kept
    from counted)
"""

ORACLE = f"""
  with docs as (select row_number() over () as row, doc_id, text, source from documents), {JUDGED_SQL}
  select {', '.join(OUTPUT)} from judged
"""
