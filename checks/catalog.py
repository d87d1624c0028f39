"""The registered queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import duck as D
from checks.views import reviews, score_lines, scored_lines, spread_table, table
from reviewlens import constants as K
from reviewlens.config import AggregationConfig, Lexicon, ScoringConfig
from reviewlens.functions import aspects as A
from reviewlens.functions import sentiment as S
from reviewlens.functions import text as T
from reviewlens.operators import cohort, duplicates, entity, keywords, summary, trend, vectors, views
from reviewlens.operators.score import detect_aspects, extract_labels, score_reviews, with_rule_aspects
from reviewlens.operators.skew import lookup_join
from reviewlens.plans.report import summary_report
from reviewlens.session import materialise, scratch_path
from reviewlens.sources import reviews as ingest
from reviewlens.sources import sinks
from reviewlens.sources.versions import read_version
from reviewlens.streaming import reviews as stream
from reviewlens.streaming import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COLS = list(K.SCORE_COLUMNS)
PROSE = Lexicon(("the", "of", "and"), ("to", "that", "der", "les"), ("for", "la"), ("was", "en"))
SCORED = ["overall_score", *COLS, "confidence", "sentiment_label", "is_mixed"]
ENTITY_SQL = ", ".join(["teacher_name", *entity.ENTITY_COLUMNS, "rank"])
FP = f"sha256(lower({D.trim('feedback_text')}))"
SHARES = ["positive_pct", "neutral_pct", "negative_pct"]


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = D.compose(sql, extra)
        return function

    return register


def flat(df: DataFrame) -> DataFrame:
    """Arrays as strings, so that both engines return plain columns."""
    return sinks.flat_for_csv(df)


def scored(spark: SparkSession, sf: str, details: bool = False) -> DataFrame:
    return score_reviews(reviews(spark, sf), details=details)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return entity.aggregate(reviews(spark, sf))


def line_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entity.aggregate_from_scores(scored_lines(spark, sf))


# --- A: sources, ingest, sinks ------------------------------------------------------------

CLEAN_SQL = f"""select *, {D.trim('feedback_text')} as clean from reviews where length({D.trim('feedback_text')}) > 5"""
RATED_SQL = "(case when (select max(rating) from clean) <= 10 then round(rating / (select max(rating) from clean) * 100, 1) else rating end)"


@query(
    "a1_csv_round_trip",
    f"""select review_id, teacher_name, md5(clean) as text_hash, cast(date as varchar) as date, rating,
        {RATED_SQL} as rating_normalized from clean""",
    {"clean": CLEAN_SQL},
)
def a1(spark, sf):
    """Files of two column orders and of two encodings, with line breaks in quoted values, under one folder."""
    path = scratch_path(spark, "csv")
    raw = reviews(spark, sf).select(
        "review_id", F.col("teacher_name").alias("Instructor "), F.col("feedback_text").alias("Comment"),
        F.col("date").alias("created_at"), F.col("rating").alias("Stars"),
    )
    kind = F.when(F.is_valid_utf8("Comment") & (F.pmod("review_id", F.lit(2)) == 0), 0).otherwise(1)
    western = F.col("Instructor ").isNotNull() & ~F.col("Comment").rlike(r"[^\x00-\xFF]")
    raw = raw.withColumn("_kind", F.when(western & (F.pmod("review_id", F.lit(3)) == 0), 2).otherwise(kind))
    sinks.write_csv(raw.where("_kind = 0").drop("_kind"), f"{path}/part=0")
    sinks.write_csv(raw.where("_kind = 1").select("Stars", "Comment", "created_at", "Instructor ", "review_id"), f"{path}/part=1")
    latin = raw.where("_kind = 2").drop("_kind")
    latin.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(f"{path}/part=2")
    loaded = ingest.load_csv(spark, [f"{path}/part={kind}" for kind in range(3)])
    return loaded.select(
        F.col("review_id").cast("bigint").alias("review_id"), "teacher_name", F.md5("feedback_text").alias("text_hash"),
        F.to_date("date").cast("string").alias("date"), "rating", "rating_normalized",
    )


LINES_SQL = rf"""select doc_id, source as teacher_name, generate_subscripts(parts, 1) - 1 as line, unnest(parts) as part
  from (select doc_id, source, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]') as parts from documents)"""


@query(
    "a2_text_lines",
    f"select doc_id, teacher_name, line, {D.trim('part')} as feedback_text from split_lines where {D.trim('part')} <> ''",
    {"split_lines": LINES_SQL},
)
def a2(spark, sf):
    blocks = table(spark, sf, "documents").select("doc_id", "source", "text")
    return ingest.reviews_from_lines(blocks, "text", "source").select(
        "doc_id", "teacher_name", F.col("line").cast("bigint").alias("line"), "feedback_text"
    )


@query(
    "a3_column_aliases",
    f"select conv_id, turn, role, {D.trim('text')} as feedback_text from conversations where length({D.trim('text')}) > 5",
)
def a3(spark, sf):
    return ingest.clean_reviews(table(spark, sf, "conversations"))


@query(
    "a4_drop_empty_rows",
    f"""select feedback_text, rating, round(rating / (select max(rating) from kept) * 100, 1) as rating_normalized from kept""",
    {"kept": f"""select {D.trim('d.text')} as feedback_text, cast(l.quality + 1 as double) as rating from documents d
        join labels l using (doc_id) where length({D.trim('d.text')}) > 5"""},
)
def a4(spark, sf):
    labels = table(spark, sf, "labels").withColumn("known", F.lit(True))
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left")
    return ingest.clean_reviews(
        rows.select(F.when(F.col("known"), F.col("text")).alias("Review"), (F.col("quality") + 1).alias("Score"))
    )


@query("a5_first_text_column", f"""select c_custkey, c_name as feedback_text, c_nationkey, c_acctbal, c_mktsegment
  from customer where length({D.trim('c_name')}) > 5""")
def a5(spark, sf):
    return ingest.clean_reviews(table(spark, sf, "customer"))


@query("a6_clean_text", "select review_id, md5(clean) as text_hash, length(clean) as n from clean", {"clean": CLEAN_SQL})
def a6(spark, sf):
    df = ingest.clean_reviews(reviews(spark, sf).select("review_id", "feedback_text"))
    return df.select("review_id", F.md5("feedback_text").alias("text_hash"), F.length("feedback_text").alias("n"))


# Spellings of a date by event_id % 16, as patterns of both engines' formatters (the last ones are no dates).
DATE_SPELLINGS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy-M-d", "d MMMM yyyy", "MMM d yyyy",
    "yyyy-MM-dd HH:mm:ss'+00:00'", "yyyy.MM.dd", "yyyyMMdd", "d-MMM-yyyy", "MM/dd/yyyy HH:mm", "MMMM d, yyyy", "M/d/yyyy h:mm a",
)


@query(
    "a7_lenient_dates",
    f"""select event_id, case when event_id % 16 = {len(DATE_SPELLINGS)} then null
         when event_id % 16 in (0, 8) then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
         when event_id % 16 in (12, 14) then strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
         else strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') end as parsed from events""",
)
def a7(spark, sf):
    ts, kind = F.col("ts"), F.col("event_id") % 16
    spelled = F.concat(F.lit("day "), F.col("event_id").cast("string"))
    for number, pattern in enumerate(DATE_SPELLINGS):
        spelled = F.when(kind == number, F.date_format(ts, pattern)).otherwise(spelled)
    df = table(spark, sf, "events").select("event_id", ingest.lenient_timestamp(spelled).alias("parsed"))
    return df.withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss"))


# More spellings, by event_id % 12; the last one has two readings, which the column's other dates decide.
MORE_SPELLINGS = (
    "EEE MMM d yyyy", "EEEE, MMMM d, yyyy", "EEE, d MMM yyyy", "yyyy-MM-dd HH:mm:ss' UTC'", "M/d/yy h:mm a", "MMM yyyy", "yyyy-M",
    "yyyy", "MMMM yyyy", "yyyy-MM-dd HH:mm:ss' GMT'", "d'th' MMMM yyyy", "'Sept' d yyyy",
)


@query(
    "a7_more_dates",
    """select event_id, strftime(case when k in (3, 9) then date_trunc('second', ts) when k = 4 then date_trunc('minute', ts)
         when k in (5, 6, 8) then date_trunc('month', ts) when k = 7 then date_trunc('year', ts)
         when k = 11 then make_date(year(ts), 9, least(day(ts), 30)) else date_trunc('day', ts) end, '%Y-%m-%d %H:%M:%S') as parsed
       from (select *, event_id % 12 as k from events)""",
)
def a7_more(spark, sf):
    ts, kind = F.col("ts"), F.col("event_id") % 12
    spelled = F.lit(None).cast("string")
    for number, pattern in enumerate(MORE_SPELLINGS[:-1]):
        spelled = F.when(kind == number, F.date_format(ts, pattern)).otherwise(spelled)
    september = F.concat(F.lit("Sept "), F.least(F.dayofmonth(ts), F.lit(30)).cast("string"), F.lit(" "), F.year(ts).cast("string"))
    df = table(spark, sf, "events").select("event_id", F.coalesce(spelled, september).alias("spelled"))
    return df.select("event_id", F.date_format(ingest.lenient_timestamp(F.col("spelled")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    "a7_day_or_month_first",
    """select event_id, event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as parsed from events""",
)
def a7_voted(spark, sf):
    """Every kind of event has its own spelling, as files of different origin have; each column decides for itself."""
    events = table(spark, sf, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    parts = []
    for number, kind in enumerate(kinds):
        spelled = F.date_format("ts", ("d/M/yyyy", "M/d/yyyy")[number % 2])
        part = events.where(F.col("event_type").eqNullSafe(kind)).select("event_id", "event_type", spelled.alias("date"))
        part = part.withColumn("feedback_text", F.lit("some words"))
        parts.append(ingest.clean_reviews(part).select("event_id", "event_type", F.date_format("date", "yyyy-MM-dd").alias("parsed")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query("a8_rating_scale", """select review_id, rating, round(rating / (select max(rating) from reviews) * 100, 1)
  as rating_normalized from reviews""")
def a8(spark, sf):
    return ingest.with_normalised_rating(reviews(spark, sf).select("review_id", "rating"))


VALIDATE_SQL = """select true as is_valid, n_rows, {teacher} as has_teacher_col, {date} as has_date_col, {rating} as has_rating_col,
  missing_pct, array_to_string(list_filter([case when missing_pct > 20 then missing_pct || '% of feedback entries are empty or missing.' end,
    {warnings}], lambda x: x is not null), ' | ') as warnings
  from (select count(*) as n_rows, round(count(*) filter (where feedback_text is null or feedback_text = '') / count(*) * 100, 2) as missing_pct from {source})"""


@query("a9_validate", VALIDATE_SQL.format(teacher=True, date=True, rating=True, warnings="null", source="reviews"))
def a9(spark, sf):
    return flat(ingest.validate(reviews(spark, sf)))


@query(
    "a9_validate_missing",
    VALIDATE_SQL.format(
        teacher=False, date=False, rating=False, source="labelled",
        warnings="'No ''teacher_name'' column found — analysis will be aggregated.', "
        "'No ''date'' column found — trend analysis will be unavailable.'",
    ),
    {"labelled": "select case when l.quality = 1 then d.text end as feedback_text from documents d left join labels l using (doc_id)"},
)
def a9_missing(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return flat(ingest.validate(rows.select(F.when(F.col("quality") == 1, F.col("text")).alias("feedback_text"))))


@query("a10_head", "select review_id, teacher_name from reviews order by review_id limit 150")
def a10(spark, sf):
    return views.head(reviews(spark, sf), 150).select("review_id", "teacher_name")


@query("a12_csv_export", """select teacher_name, cast(overall_score as varchar) as overall_score, grade,
  nullif(strengths, '') as strengths from entity""")
def a12(spark, sf):
    path = scratch_path(spark, "export")
    sinks.write_csv(entities(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("teacher_name", "overall_score", "grade", "strengths")


REPORT_SQL = """select e.teacher_name as "Teacher Name", e.subject as "Subject", total_reviews as "Total Reviews",
  round(overall_score * 10, 1) as "Overall Score (0-100)", grade as "Grade", descriptor as "Descriptor",
  round(communication_score * 10, 1) as "Communication Score", round(subject_knowledge_score * 10, 1) as "Subject Knowledge Score",
  round(engagement_score * 10, 1) as "Engagement Score", round(responsiveness_score * 10, 1) as "Responsiveness Score",
  round(assignment_quality_score * 10, 1) as "Assignment Quality Score", round(confidence_score, 2) as "Confidence Score",
  confidence_band as "Confidence Band", {summary} from entity e {join}"""


@query(
    "a13_summary_report",
    REPORT_SQL.format(
        summary='s.summary as "AI Summary", s.strengths as "AI Strengths", s.improvements as "AI Improvements"',
        join="join summaries s using (teacher_name)",
    ),
)
def a13(spark, sf):
    return summary_report(scored(spark, sf))


@query(
    "a13_report_without_summaries",
    REPORT_SQL.format(
        summary="""'Summarization disabled.' as "AI Summary", '' as "AI Strengths", '' as "AI Improvements" """, join=""
    ),
)
def a13_plain(spark, sf):
    return summary_report(scored(spark, sf), run_summarizer=False)


@query("a14_semester", """select event_id, case when month(ts) <= 6 then 'Spring ' else 'Fall ' end || year(ts) as semester from events""")
def a14(spark, sf):
    return table(spark, sf, "events").select("event_id", ingest.semester(F.col("ts")).alias("semester"))


# --- B: projections and filters -----------------------------------------------------------

DETAILS_SQL = ", ".join(
    f"case when low <> '' then s{i} end as score_{i}, case when low <> '' then r{i} end as relevance_{i}, "
    f"case when low <> '' then ps{i} end as positive_{i}, case when low <> '' then ns{i} end as negative_{i}, "
    f"case when low <> '' then d{i} else false end as detected_{i}"
    for i in range(5)
)
SCORED_SQL = ", ".join(SCORED) + (
    ", array_to_string(strengths_list, ' | ') as strengths_list, array_to_string(improvements_list, ' | ') as improvements_list"
)


@query(
    "b1_full_record",
    f"""select review_id, {SCORED_SQL}, polarity, p_pos, p_neu, p_neg, {DETAILS_SQL},
      {D.trim('feedback_text')} <> '' and review_id > min(review_id) over (partition by {FP}) as is_duplicate from scored""",
)
def b1(spark, sf):
    df = flat(duplicates.analyze_batch(reviews(spark, sf)))
    detail = []
    for i, aspect in enumerate(K.ASPECTS):
        record = F.col("aspect_detail")[aspect]
        detail += [
            record["score_10"].alias(f"score_{i}"), record["relevance"].alias(f"relevance_{i}"),
            record["positive_sim"].alias(f"positive_{i}"), record["negative_sim"].alias(f"negative_{i}"),
            F.coalesce(record["detected"], F.lit(False)).alias(f"detected_{i}"),
        ]
    probs = [F.col(f"sentiment_probs.{n}").alias(a) for n, a in zip(K.SENTIMENTS, ("p_pos", "p_neu", "p_neg"))]
    return df.select("review_id", *SCORED, "strengths_list", "improvements_list", "polarity", *probs, *detail, "is_duplicate")


@query("b2_blank_reviews", f"select review_id, {SCORED_SQL} from scored where {D.trim('feedback_text')} = ''")
def b2(spark, sf):
    df = reviews(spark, sf).where(T.is_blank(F.col("feedback_text")))
    return flat(score_reviews(df)).select("review_id", *SCORED, "strengths_list", "improvements_list")


@query("b3_filters", """select review_id, overall_score, sentiment_label from scored
  where subject in ('en', 'de') and semester in ('Fall 2023', 'Spring 2024')""")
def b3(spark, sf):
    chosen = {"subject": ["en", "de"], "semester": ["Fall 2023", "Spring 2024"], "teacher_name": [], "campus": ["x"]}
    return views.filter_reviews(scored(spark, sf), chosen).select("review_id", "overall_score", "sentiment_label")


@query("b4_filter_options", "select distinct teacher_name from reviews where teacher_name is not null order by 1")
def b4(spark, sf):
    return views.filter_options(reviews(spark, sf), "teacher_name")


@query("b5_explorer", """select teacher_name, subject, cast(date as varchar) as date, rating, feedback_text, sentiment_label
  from scored order by review_id limit 50""")
def b5(spark, sf):
    return views.explorer(scored(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("b6_first_comments", """select review_id, teacher_name, feedback_text from reviews where teacher_name is not null
  qualify row_number() over (partition by teacher_name order by review_id) <= 8""")
def b6(spark, sf):
    df = reviews(spark, sf).select("review_id", "teacher_name", "feedback_text")
    return views.first_comments(df, 8)


@query("b7_entity_report", f"select {ENTITY_SQL} from entity where teacher_name = 'src3-en'")
def b7(spark, sf):
    return entity.entity_report(entities(spark, sf), "src3-en")


DEFAULTED_SQL = """select 'Unknown Teacher' as teacher_name, null as semester, l_returnflag as subject, l_quantity / 5 as communication_score,
  5.0::double as subject_knowledge_score, 5.0::double as engagement_score, 5.0::double as responsiveness_score,
  5.0::double as assignment_quality_score, 0.5::double as confidence, null::varchar as sentiment_label, false as is_mixed from lineitem"""


@query(
    "b8_defaults",
    "select teacher_name, " + ", ".join(COLS) + ", overall_score, confidence_score, confidence_band, total_reviews, rank from dflt_entity",
    {"dflt": DEFAULTED_SQL, **D.entity_ctes("dflt_", "dflt", False, False)},
)
def b8(spark, sf):
    df = scored_lines(spark, sf).select("communication_score")
    return entity.aggregate_from_scores(df).select(
        "teacher_name", *COLS, "overall_score", "confidence_score", "confidence_band", "total_reviews", "rank"
    )


@query("b9_ranking_table", """select rank as "Rank", teacher_name as "Teacher Name", subject as "Subject", total_reviews as "Total Reviews",
  overall_score as "Overall Score", grade as "Grade", confidence_band as "Confidence Band", strengths as "Strengths",
  improvements as "Improvements" from entity""")
def b9(spark, sf):
    return views.ranking_table(entities(spark, sf))


@query("b10_rescore", f"select review_id, {SCORED_SQL} from scored")
def b10(spark, sf):
    old = reviews(spark, sf).withColumns({"overall_score": F.lit(1.0), "is_mixed": F.lit(True), "confidence": F.lit(0.0)})
    return flat(score_reviews(old)).select("review_id", *SCORED, "strengths_list", "improvements_list")


# --- C: lookups ---------------------------------------------------------------------------


@query("c1_score_distinct_texts", f"select review_id, {SCORED_SQL} from scored")
def c1(spark, sf):
    df = duplicates.score_distinct(reviews(spark, sf))
    return flat(df).select("review_id", *SCORED, "strengths_list", "improvements_list")


SUMMARY_SQL = "select teacher_name, summary, strengths, improvements from summaries"


@query("c2_refresh_summaries", SUMMARY_SQL)
def c2(spark, sf):
    now, scores = reviews(spark, sf), entities(spark, sf)
    earlier = now.where(~T.is_blank(F.col("feedback_text")))
    cache = summary.refresh_summaries(earlier, scores, None, scale=10.0)
    return flat(summary.refresh_summaries(now, scores, cache, scale=10.0)).select(
        "teacher_name", "summary", "strengths", "improvements"
    )


@query(
    "c2_stored_summaries",
    """select teacher_name, summary, strengths, improvements, case when teacher_name in
         (select teacher_name from reviews where teacher_name like '%-en' and review_id % 2 <> 0) then 1 else 0 end as since
       from summaries""",
)
def c2_stored(spark, sf):
    """Some comments arrive after the first version: only their entities are summarised again."""
    now, scores, path = reviews(spark, sf), entities(spark, sf), scratch_path(spark, "summaries")
    late = F.coalesce(F.col("teacher_name").endswith("-en"), F.lit(False)) & (F.col("review_id") % 2 != 0)
    tables.store_summaries(now.where(~late), scores, path, scale=10.0)
    return flat(tables.store_summaries(now, scores, path, scale=10.0)).select(
        "teacher_name", "summary", "strengths", "improvements", "since"
    )


@query(
    "c2_content_keys",
    """select teacher_name, count(*) as n, concat_ws('-', count(*)::varchar,
         sum(('0x' || substr(md5(feedback_text), 1, 15))::bigint)::varchar,
         sum(('0x' || substr(md5(feedback_text), 16, 15))::bigint)::varchar) as content_key
       from reviews where teacher_name is not null group by 1""",
)
def c2_keys(spark, sf):
    return summary.content_keys(reviews(spark, sf))


# --- D: aggregates ------------------------------------------------------------------------


@query("d1_entity_aggregate", f"select {ENTITY_SQL} from entity")
def d1(spark, sf):
    return entities(spark, sf)


@query("d1_merged_state", f"select {ENTITY_SQL} from entity")
def d1_merged(spark, sf):
    """States of three disjoint parts of the reviews, stored one after the other and added up."""
    df, path = scored(spark, sf), scratch_path(spark, "state")
    for part in range(3):
        tables.add_reviews(df.where(F.pmod("review_id", F.lit(3)) == part), path)
    return entity.aggregate_from_state(read_version(spark, path))


@query("d1_entity_aggregate_lines", f"select {ENTITY_SQL} from lsub_entity",
       {"lsub": "select *, row_number() over () as review_id from lines", **D.entity_ctes("lsub_", "lsub", False, False)})
def d1_lines(spark, sf):
    return entity.aggregate_from_scores(scored_lines(spark, sf).drop("subject"))


@query(
    "d8_most_common",
    """select teacher_name, subject from (select teacher_name, subject, count(*) as n from lines group by all)
       qualify row_number() over (partition by teacher_name order by n desc, subject) = 1""",
)
def d8(spark, sf):
    return line_entities(spark, sf).select("teacher_name", "subject")


@query("d9_top_labels", """select teacher_name, coalesce(array_to_string(str.items, ' | '), '') as strengths,
  coalesce(array_to_string(imp.items, ' | '), '') as improvements from mean left join str using (teacher_name) left join imp using (teacher_name)""")
def d9(spark, sf):
    joined = flat(scored(spark, sf))  # label lists as "a | b" strings, the other accepted form
    return flat(entity.summarise_groups(joined, "teacher_name", [])).select("teacher_name", "strengths", "improvements")


@query("d10_without_normalisation", f"select {ENTITY_SQL} from plain_entity")
def d10(spark, sf):
    return entity.aggregate_from_scores(scored(spark, sf), AggregationConfig(normalise=False))


COHORT_SQL = """select count(*) as n_teachers, cast(sum(total_reviews) as bigint) as total_reviews, round({mean}, 2) as mean_overall,
  round(stddev_samp(overall_score), 2) as std_overall, round(median(overall_score), 2) as median_overall,
  arg_min(teacher_name, rank) as top_teacher, max(overall_score) as top_score, arg_max(teacher_name, rank) as bottom_teacher,
  min(overall_score) as bottom_score, count(*) filter (where confidence_band = 'High') as high_confidence_count,
  {grades}, {best} as best_aspect, {worst} as weakest_aspect from {source}"""


def cohort_sql(source: str) -> str:
    means = [D.exact_avg(c) for c in COLS]
    titles = [c.removesuffix("_score").replace("_", " ").title() for c in COLS]

    def pick(function: str) -> str:
        bound = f"{function}({', '.join(means)})"
        return "case " + " ".join(f"when {m} = {bound} then '{t}'" for m, t in zip(means, titles)) + " end"

    grades = ", ".join(f"count(*) filter (where grade = '{row[1]}') as grade_{i}" for i, row in enumerate(K.GRADES))
    return COHORT_SQL.format(
        mean=D.exact_avg("overall_score"), grades=grades, best=pick("greatest"), worst=pick("least"), source=source
    )


def flat_cohort(df: DataFrame) -> DataFrame:
    counts = {
        f"grade_{i}": F.coalesce(F.col("grade_distribution")[row[1]], F.lit(0)) for i, row in enumerate(K.GRADES)
    }
    return df.withColumns(counts).drop("grade_distribution")


@query("d16_cohort_summary", cohort_sql("entity"))
def d16(spark, sf):
    return flat_cohort(cohort.cohort_summary(entities(spark, sf)))


@query("d16_cohort_summary_lines", cohort_sql("line_entity"))
def d16_lines(spark, sf):
    return flat_cohort(cohort.cohort_summary(line_entities(spark, sf)))


def batch_sql(key: str) -> str:
    means = ", ".join(f"round({D.exact_avg(c)}, 2) as {c}" for c in ["overall_score", *COLS, "confidence"])
    shares = ", ".join(
        f"{D.pct(f'count(*) filter (where sentiment_label = {D.lit(s)})', 'count(*)')} as {s.lower()}_pct" for s in K.SENTIMENTS
    )
    score = f"round({D.exact_avg('overall_score')}, 2) * 10"
    return f"""select g.*, coalesce(array_to_string(bs.items, ' | '), '') as strengths,
      coalesce(array_to_string(bi.items, ' | '), '') as improvements from
      (select {key} as k, {means}, {D.grade(score, 1, 100)} as grade, {D.grade(score, 2, 100)} as descriptor,
        count(*) as n_feedback, {shares} from src where {key} is not null group by 1) g
      left join bs on bs.{key} = g.k left join bi on bi.{key} = g.k"""


def batch_ctes(key: str) -> dict[str, str]:
    return {
        "src": "select *, 'all' as everything from scored",
        **D.top_label_ctes("bs", "src", key, "strengths_list"),
        **D.top_label_ctes("bi", "src", key, "improvements_list"),
    }


@query("d17_batch_summary", f"select * exclude (k) from ({batch_sql('everything')})", batch_ctes("everything"))
def d17(spark, sf):
    return flat(cohort.batch_summary(scored(spark, sf)))


@query("d17_batch_summary_by_subject", f"select k as subject, * exclude (k) from ({batch_sql('subject')})", batch_ctes("subject"))
def d17_by(spark, sf):
    return flat(cohort.batch_summary(scored(spark, sf), "subject"))


def entity_score_sql(aspects: bool) -> str:
    means = [f"round({D.exact_avg(f'bl{i} * 10')}, 2)" for i in range(5)]
    weights = [K.REVIEW_WEIGHTS[a] for a in K.ASPECTS]
    overall = "0::double + " + " + ".join(f"{m} * {D.num(w)}" for m, w in zip(means, weights))
    if not aspects:
        overall = f"{D.exact_avg('polarity')} * 10"
    overall = f"round({D.clamp(overall, 0, 100)}, 2)"
    columns = ", ".join(f"{m} as {c}" for m, c in zip(means, COLS)) + ", " if aspects else ""
    shares = ", ".join(
        f"{D.pct(f'count(*) filter (where sentiment_label = {D.lit(s)})', 'count(*)')} as {s.lower()}_pct" for s in K.SENTIMENTS
    )
    return f"""select teacher_name, {overall} as overall_score, {D.grade(overall, 1, 100)} as grade,
      {D.grade(overall, 2, 100)} as descriptor, {columns}{shares} from blends where teacher_name is not null group by teacher_name"""


BLENDS_SQL = "select *, " + ", ".join(
    "case when low <> '' then b{0} else {1} end as bl{0}".format(i, D.blend("polarity", "polarity", "0::double")) for i in range(5)
) + " from scored"


@query("d18_entity_score", entity_score_sql(True), {"blends": BLENDS_SQL})
def d18(spark, sf):
    return cohort.entity_score(scored(spark, sf, details=True))


@query("d18_entity_score_from_polarity", entity_score_sql(False), {"blends": BLENDS_SQL})
def d18_polarity(spark, sf):
    return cohort.entity_score(scored(spark, sf, details=True), use_aspects=False)


@query(
    "d19_sentiment_summary",
    "select "
    + ", ".join(f"count(*) filter (where sentiment_label = '{s}') as {s.lower()}_count" for s in K.SENTIMENTS)
    + ", "
    + ", ".join(
        f"{D.pct(f'count(*) filter (where sentiment_label = {D.lit(s)})', 'count(*)')} as {s.lower()}_pct" for s in K.SENTIMENTS
    )
    + f""", round({D.exact_avg('polarity')}, 4) as avg_polarity, round({D.exact_avg('confidence')}, 4) as avg_confidence,
    count(*) filter (where is_mixed) as mixed_count,
    (select sentiment_label from scored group by 1 order by count(*) desc,
       list_position(['Positive', 'Neutral', 'Negative'], sentiment_label) limit 1) as overall from scored""",
)
def d19(spark, sf):
    return cohort.sentiment_summary(scored(spark, sf, details=True))


DETECTED_SQL = "select review_id, list_filter([" + ", ".join(
    f"{{'m': -round(least(0.95::double, 0.3::double + {D.hits('low', kws)} * 0.15::double), 4), 'i': {i}, 'aspect': {D.lit(a)}, "
    f"'n': {D.hits('low', kws)}}}"
    for i, (a, kws) in enumerate(K.DETECTOR_KEYWORDS.items())
) + "], lambda a: a.n > 0) as all_found from (select review_id, lower(feedback_text) as low from reviews)"
TOP3_SQL = "select review_id, list_sort(all_found)[1:3] as top from detected"


@query(
    "d20_aspect_mentions",
    f"""select aspect, cast(sum(n) as bigint) as mentions from (select unnest({D.strings(K.DASHBOARD_ASPECTS)}) as aspect, 0 as n
      union all select a.aspect, 1 from (select unnest(top, recursive := false) as a from top3)) group by aspect""",
    {"detected": DETECTED_SQL, "top3": TOP3_SQL},
)
def d20(spark, sf):
    return cohort.aspect_frequency(detect_aspects(reviews(spark, sf)))


PERIOD_END = {
    "D": "cast(ts as date)",
    "W": "cast(date_trunc('week', ts) as date) + 6",
    "ME": "last_day(ts)",
    "QE": "cast(date_trunc('quarter', ts) + interval 3 month - interval 1 day as date)",
    "YE": "make_date(year(ts), 12, 31)",
}
STEP = {"D": "1 day", "W": "7 day", "ME": "1 month", "QE": "3 month", "YE": "1 year"}


def trend_sql(source: str, frequency: str, by: str | None) -> tuple[str, dict[str, str]]:
    key = by or "'all'"
    end = PERIOD_END[frequency]
    ctes = {
        "periods": f"""select {key} as k, {end} as d, round({D.exact_avg('score')}, 2) as mean_score, count(*) as n
          from ({source}) where ts is not null and score is not null group by all""",
        "calendar": f"""select distinct k, {end} as d from (select k, unnest(range(cast(date_trunc('month', a) as timestamp),
          b + interval 1 day, interval 1 day)) as ts, a, b from (select k, min(d) as a, max(d) as b from periods group by k))
          where {end} between a and b""",
    }
    first = f"c.k as {by}, " if by else ""
    return (
        f"""select {first}cast(c.d as varchar) as date, mean_score, coalesce(n, 0) as count from calendar c
        left join periods p on p.k = c.k and p.d = c.d""",
        ctes,
    )


EVENT_TREND = "select ts, value as score, user_id, event_type from events"
LINE_TREND = "select l_shipdate as ts, l_extendedprice as score, l_suppkey from lineitem"


def _trend_queries() -> None:
    for frequency in trend.FREQUENCIES:
        source, table_name, date, score = (
            (EVENT_TREND, "events", "ts", "value") if frequency in ("D", "W") else
            (LINE_TREND, "lineitem", "l_shipdate", "l_extendedprice")
        )
        sql, ctes = trend_sql(source, frequency, None)

        def run(spark, sf, t=table_name, d=date, s=score, f=frequency):
            return trend.trend(table(spark, sf, t), d, s, f).withColumn("date", F.col("date").cast("string"))

        query(f"d21_trend_{frequency.lower()}", sql, ctes)(run)


_trend_queries()
_BY_USER = trend_sql(EVENT_TREND, "D", "user_id")


@query(
    "d21_trend_text",
    *trend_sql(
        """select ts, value as score, user_id from events where event_id % 10 < 8""", "D", None
    ),
)
def d21_text(spark, sf):
    """Dates and scores as text, some in other spellings, some unreadable."""
    ts, kind = F.col("ts"), F.col("event_id") % 10
    spelled = F.when(kind == 8, "garbage").when(kind < 4, F.date_format(ts, "M/d/yyyy")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    score = F.when(kind == 9, "n/a").otherwise(F.col("value").cast("string"))
    texts = table(spark, sf, "events").select(spelled.alias("day"), score.alias("points"))
    return trend.trend(texts, "day", "points", "D").withColumn("date", F.col("date").cast("string"))


@query("d21_trend_by_user", *_BY_USER)
def d21_by(spark, sf):
    return trend.trend(table(spark, sf, "events"), "ts", "value", "D", "user_id").withColumn("date", F.col("date").cast("string"))


@query(
    "d22_score_bins",
    """select b as bin, (b - 1) * 10::double as low, b * 10::double as high, count(value) as count from range(1, 11) r(b)
       left join events on value between 0 and 100 and least(floor(value / 10) + 1, 10) = b group by b""",
)
def d22(spark, sf):
    return cohort.score_bins(table(spark, sf, "events"), "value")


@query("d23_review_volume", "select teacher_name, count(*) as feedback_count from reviews where teacher_name is not null group by 1")
def d23(spark, sf):
    return cohort.review_volume(reviews(spark, sf))


@query("d24_sentiment_counts", "select sentiment_label, count(*) as count from scored group by 1")
def d24(spark, sf):
    return cohort.sentiment_counts(scored(spark, sf))


@query("d24_sentiment_counts_by_entity", "select teacher_name, sentiment_label, count(*) as count from scored group by 1, 2")
def d24_by(spark, sf):
    return cohort.sentiment_counts(scored(spark, sf), "teacher_name")


@query(
    "d25_key_figures",
    "select (select count(*) from lines) as total_reviews, "
    + ", ".join(
        f"(select round(count(*) filter (where sentiment_label = '{s}') / count(*) * 100, 2) from lines) as {s.lower()}_pct"
        for s in K.SENTIMENTS
    )
    + f""", round({D.exact_avg('overall_score')}, 2) * 10 as overall_score,
    {D.grade(f"round({D.exact_avg('overall_score')}, 2) * 10", 1, 100)} as grade from line_entity""",
)
def d25(spark, sf):
    return cohort.key_figures(scored_lines(spark, sf), line_entities(spark, sf))


@query(
    "d26_aspect_averages",
    " union all ".join(f"select '{a}' as aspect, {D.exact_avg(c)} * 10 as score from entity" for a, c in K.SCORE_COLUMN.items()),
)
def d26(spark, sf):
    return cohort.aspect_averages(entities(spark, sf))


WORDS_SQL = rf"select unnest(regexp_extract_all({D.fold('lower(feedback_text)')}, '\b[a-z]{{4,}}\b')) as word from reviews"


@query(
    "d27_keywords",
    f"select word, count(*) as count from words where not list_contains({D.strings(K.STOP_WORDS)}, word) group by 1 order by 2 desc, 1 limit 20",
    {"words": WORDS_SQL},
)
def d27(spark, sf):
    return keywords.extract_keywords(reviews(spark, sf))


@query(
    "d27_word_cloud",
    f"select word, count(*) as count from words where not list_contains({D.strings(K.STOP_WORDS)}, word) group by 1 order by 2 desc, 1 limit 120",
    {"words": WORDS_SQL},
)
def d27_cloud(spark, sf):
    return keywords.extract_keywords(reviews(spark, sf), top_n=120)


@query("d28_top_phrases", """select teacher_name, n, coalesce(array_to_string(pstr.items, ' | '), '') as strengths,
  coalesce(array_to_string(pimp.items, ' | '), '') as improvements from volume left join pstr using (teacher_name) left join pimp using (teacher_name)""")
def d28(spark, sf):
    return flat(summary.top_labels(reviews(spark, sf), "teacher_name"))


@query(
    "d29_sentiment_crosstab",
    "select teacher_name, "
    + ", ".join(f"count(*) filter (where sentiment_label = '{s}') as \"{s}\"" for s in K.SENTIMENTS)
    + " from scored where teacher_name is not null group by 1",
)
def d29(spark, sf):
    return cohort.sentiment_crosstab(scored(spark, sf))


# --- E, F, H: ranking, duplicates, reshape ------------------------------------------------


@query(
    "e1_rank",
    """select teacher, score, 'N/A' as grade, '' as descriptor, cast(row_number() over (order by score desc, teacher) as int) as rank
       from (select o_custkey as teacher, round(sum(o_totalprice), 2) as score from orders group by 1)""",
)
def e1(spark, sf):
    totals = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("teacher")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("score")
    )
    return entity.rank_entities(totals)




@query(
    "e2_duplicate_flags",
    f"""select review_id, case when {D.trim('feedback_text')} <> '' then {FP} end as fingerprint,
      {D.trim('feedback_text')} <> '' and review_id > min(review_id) over (partition by {FP}) as is_duplicate from reviews""",
)
def e2(spark, sf):
    return duplicates.mark_duplicates(reviews(spark, sf)).select("review_id", "fingerprint", "is_duplicate")


@query(
    "e4_unpivot_aspects",
    " union all ".join(
        f"select teacher_name, overall_score, grade, rank, {c} as score, '{a}' as aspect from entity" for a, c in K.SCORE_COLUMN.items()
    ),
)
def e4(spark, sf):
    return entity.unpivot_aspects(entities(spark, sf))


@query(
    "f5_aspect_bars",
    " union all ".join(f"select teacher_name, '{a}' as aspect, {c} * 10 as score from entity" for a, c in K.SCORE_COLUMN.items()),
)
def f5(spark, sf):
    return views.aspect_bars(entities(spark, sf))


@query(
    "h2_distinct_texts_exact",
    f"select feedback_text, min(review_id) as review_id, count(*) as copies from reviews where {D.trim('feedback_text')} <> '' group by 1",
)
def h2(spark, sf):
    return duplicates.distinct_texts(reviews(spark, sf), fold_case=False)


@query(
    "h3_distinct_texts",
    f"""select lower({D.trim('feedback_text')}) as feedback_text, min(review_id) as review_id, count(*) as copies
      from reviews where {D.trim('feedback_text')} <> '' group by 1""",
)
def h3(spark, sf):
    return duplicates.distinct_texts(reviews(spark, sf))


# --- I: text ------------------------------------------------------------------------------


@query("i1_fingerprint", f"select doc_id, sha256(lower({D.trim('text')})) as fingerprint from documents")
def i1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "i2_sentences",
    f"""select review_id, generate_subscripts(c, 1) - 1 as chunk, unnest(c) as sentence from (select review_id,
      case when len(s) > 0 then s else [{D.trim('feedback_text')}] end as c
      from (select review_id, feedback_text, {D.sentences('feedback_text', 8)} as s from reviews))""",
)
def i2(spark, sf):
    df = reviews(spark, sf).select("review_id", F.posexplode(T.chunks(F.col("feedback_text"))).alias("chunk", "sentence"))
    return df.withColumn("chunk", F.col("chunk").cast("bigint"))


@query("i3_tokens", "select review_id, generate_subscripts(t, 1) - 1 as position, unnest(t) as token from tok")
def i3(spark, sf):
    df = reviews(spark, sf).select(
        "review_id", F.posexplode(T.tokens(F.lower(T.text_trim(F.col("feedback_text"))))).alias("position", "token")
    )
    return df.withColumn("position", F.col("position").cast("bigint"))


SENT_SQL = "select review_id, label, polarity, confidence, is_mixed, p_pos, p_neu, p_neg from "


def sentiment_columns(df: DataFrame) -> DataFrame:
    probs = [F.col(f"sentiment_probs.{n}").alias(a) for n, a in zip(K.SENTIMENTS, ("p_pos", "p_neu", "p_neg"))]
    return df.select("review_id", F.col("sentiment_label").alias("label"), "polarity", "confidence", "is_mixed", *probs)


@query("i4_rule_sentiment", SENT_SQL + "sent")
def i4(spark, sf):
    df = reviews(spark, sf).select("review_id", F.lower(T.text_trim(F.col("feedback_text"))).alias("low"))
    return sentiment_columns(S.with_rule_sentiment(df, "low"))


@query(
    "i4_custom_lexicon",
    SENT_SQL + "pr_sent",
    {"prose": "select doc_id as review_id, lower(text) as low from documents", **D.token_ctes("pr_", "prose", "low", PROSE)},
)
def i4_custom(spark, sf):
    df = spread_table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.lower("text").alias("low"))
    return sentiment_columns(S.with_rule_sentiment(df, "low", PROSE))


PROBS_SQL = """select doc_id as review_id, a, (1 - a) * (n_chars % 7) / 7::double as b, lang = 'en' as three
  from (select doc_id, lang, n_chars, (n_chars % 97) / 97::double as a from documents)"""
CLASSES_SQL = """select review_id, a as p, b as n, case when three then 1 - a - b when a + b < 0.99::double then 1 - (a + b) else 0 end as u from raw_probs"""


@query(
    "i5_probability_sentiment",
    """select review_id, case when p = t then 'Positive' when u = t then 'Neutral' else 'Negative' end as label,
      round((p - n + 1::double) / 2::double * 10::double, 4) as polarity, round(t, 4) as confidence,
      list_sort([p, u, n])[3] - list_sort([p, u, n])[2] < 0.2::double as is_mixed,
      round(p, 4) as p_pos, round(u, 4) as p_neu, round(n, 4) as p_neg from (select *, greatest(p, u, n) as t from classes)""",
    {"raw_probs": PROBS_SQL, "classes": CLASSES_SQL},
)
def i5(spark, sf):
    a = (F.col("n_chars") % 97) / F.lit(97.0)
    b = (1 - a) * (F.col("n_chars") % 7) / F.lit(7.0)

    def entry(label, score):
        return F.struct(F.lit(label).alias("label"), score.alias("score"))

    three = F.array(entry("LABEL_0", b), entry("LABEL_1", 1 - a - b), entry("LABEL_2", a))
    two = F.array(entry("POSITIVE", a), entry("negative", b))
    df = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.when(F.col("lang") == "en", three).otherwise(two).alias("probabilities")
    )
    return sentiment_columns(S.with_probability_sentiment(df, "probabilities"))


@query("i8_signal_labels", """select review_id, array_to_string(s1, ' | ') as strengths, array_to_string(i1, ' | ') as improvements from found""")
def i8(spark, sf):
    strengths, improvements = K.STRENGTH_SIGNALS, K.IMPROVEMENT_SIGNALS
    keywords = A.table_keywords(strengths) + A.table_keywords(improvements)
    df = reviews(spark, sf).select("review_id", A.found_keywords(F.lower("feedback_text"), keywords).alias("found"))
    found = F.col("found")
    return flat(
        df.select(
            "review_id",
            A.signal_labels(found, strengths).alias("strengths"),
            A.signal_labels(found, improvements).alias("improvements"),
        )
    )


@query("i9_i10_phrase_labels", """select review_id, array_to_string(s, ' | ') as strengths_list, array_to_string(i, ' | ') as improvements_list from phr""")
def i9(spark, sf):
    return flat(extract_labels(reviews(spark, sf).select("review_id", "feedback_text"))).drop("feedback_text")


@query("i11_anonymise", f"select review_id, {D.anonymise('feedback_text')} as anonymous from reviews")
def i11(spark, sf):
    return reviews(spark, sf).select("review_id", T.anonymise(F.col("feedback_text")).alias("anonymous"))


def _extract(text: str) -> str:
    s = D.sentences(text, 20)
    return f"case when len({s}) > 0 then array_to_string(({s})[1:3], ' ') else left({text}, 300) end"


@query("i12_extractive_summary", f"select review_id, {_extract('feedback_text')} as summary from reviews")
def i12(spark, sf):
    return reviews(spark, sf).select("review_id", T.extractive(F.col("feedback_text")).alias("summary"))


@query(
    "i13_summary_per_entity",
    f"select teacher_name, {D.group_summary()} as summary from joined",
    D.joined_ctes("joined", "reviews", "teacher_name"),
)
def i13(spark, sf):
    return summary.summarise_feedback(reviews(spark, sf), "teacher_name")


@query(
    "i13_summary_of_conversations",
    f"select conv_id, {D.group_summary()} as summary from joined",
    {"turns": "select conv_id, turn as review_id, text as feedback_text from conversations", **D.joined_ctes("joined", "turns", "conv_id")},
)
def i13_conversations(spark, sf):
    return summary.summarise_feedback(table(spark, sf, "conversations"), "conv_id", "text", "turn")


@query(
    "i13_summary_of_all",
    f"select {D.group_summary()} as summary from joined",
    {"everything": "select *, 'all' as k from reviews", **D.joined_ctes("joined", "everything", "k")},
)
def i13_all(spark, sf):
    return summary.summarise_feedback(reviews(spark, sf))


@query(
    "i14_summary_by_sentiment",
    f"""select l as sentiment_label, case when sentiment_label is null then 'No ' || lower(l) || ' feedback found.' else {D.group_summary()} end as summary
      from (select unnest(['Positive', 'Neutral', 'Negative']) as l) left join joined on joined.sentiment_label = l""",
    D.joined_ctes("joined", "scored", "sentiment_label"),
)
def i14(spark, sf):
    return summary.summarise_by_sentiment(scored(spark, sf))


@query("i16_entity_summary", SUMMARY_SQL)
def i16(spark, sf):
    return flat(summary.summarise_entities(reviews(spark, sf), entities(spark, sf), scale=10.0))


def _executive_sql() -> str:
    def one(value: str) -> str:
        return f"printf('%.1f', round({value}, 1))"

    def listed(items: str) -> str:
        return f"array_to_string(list_transform({items}, lambda a: a.aspect || ' (' || {one('a.score')} || ')'), ', ')"

    plain = ", ".join(
        f"{{'score': {c}, 'position': {i}, 'aspect': {D.lit(a)}}}" for i, (a, c) in enumerate(K.SCORE_COLUMN.items())
    )
    minus = ", ".join(
        f"{{'m': -{c}, 'position': {i}, 'aspect': {D.lit(a)}, 'score': {c}}}" for i, (a, c) in enumerate(K.SCORE_COLUMN.items())
    )
    line = "=" * 60
    shown = "case when overall_score > 10 then overall_score else overall_score * 10 end"
    pieces = [
        "'EXECUTIVE SUMMARY — '", "upper(e.teacher_name)", f"'\n{line}\n\nOVERALL PERFORMANCE\n  Score        : '", one(shown),
        "' / 100\n  Grade        : '", "grade", "'  ('", "descriptor", "')\n\nSENTIMENT OVERVIEW\n  Positive     : '", one("positive_pct"),
        "'%\n  Neutral      : '", one("neutral_pct"), "'%\n  Negative     : '", one("negative_pct"), "'%\n\nKEY STRENGTHS\n  '",
        listed(f"list_sort([{minus}])[1:3]"), "'\n\nAREAS FOR IMPROVEMENT\n  '", listed(f"list_sort([{plain}])[1:2]"),
        "'\n\nFEEDBACK SUMMARY\n  '", "s.summary", f"'\n\n{line}'",
    ]
    return "select e.teacher_name, " + " || ".join(pieces) + " as report from entity e join summaries s using (teacher_name)"


@query("i18_executive_summary", _executive_sql())
def i18(spark, sf):
    ranked = entities(spark, sf)
    return summary.executive_summary(ranked, summary.summarise_entities(reviews(spark, sf), ranked, scale=10.0))


# --- J: vectors and keyword aspects -------------------------------------------------------

ANCHOR_SQL = """select aspect, pole, k, list(v order by pos) as e from (
  select (label % 5) as aspect, case when label < 5 then 'positive' else 'negative' end as pole, vec_id % 8 as k, pos, avg(x) as v
  from (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all)
  group by all"""
LABEL_MEAN_SQL = """select label, list(v order by pos) as e from (select label, pos, avg(x) as v
  from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all) group by all"""
SIMS_SQL = """select vec_id, aspect, pole, list_reduce(list_prepend(0::double, list_sort(list(list_cosine_similarity(embedding::double[], e)), 'DESC')[1:3]),
  lambda a, b: a + b) / least(3, count(*)) as sim from embeddings, anchors group by vec_id, aspect, pole"""
POLES_SQL = """select vec_id // 4 as review_id, vec_id, aspect, max(sim) filter (where pole = 'positive') as p,
  max(sim) filter (where pole = 'negative') as n from sims group by all"""
CHUNK_SQL = """select review_id, aspect, cast(round(round(p, 4) * 10000) as bigint) as p, cast(round(round(n, 4) * 10000) as bigint) as n,
  cast(round(round((p - n + 1::double) / 2::double * 10::double, 4) * 10000) as bigint) as s from by_pole"""


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Eight anchors per aspect and pole: means of the embeddings of each label in eight groups."""
    labelled = table(spark, sf, "embeddings").select(
        F.element_at(F.array(*[F.lit(a) for a in K.ASPECTS]), (F.col("label") % 5 + 1).cast("int")).alias("aspect"),
        F.when(F.col("label") < 5, "positive").otherwise("negative").alias("pole"),
        (F.col("vec_id") % 8).alias("k"),
        "embedding",
    )
    return vectors.mean_vectors(labelled, ["aspect", "pole", "k"])


@query(
    "j1_cosine_to_label_mean",
    "select vec_id, round(list_cosine_similarity(embedding::double[], e), 4) as similarity from embeddings join label_means using (label)",
    {"label_means": LABEL_MEAN_SQL},
)
def j1(spark, sf):
    df = table(spark, sf, "embeddings")
    means = vectors.mean_vectors(df, ["label"]).withColumnRenamed("embedding", "mean")
    means = means.join(df.groupBy("label").agg(F.count("*").alias("n")), "label")
    joined = lookup_join(df, materialise(means, "label-means"), "label", "n", F.col("vec_id")).where(F.col("mean").isNotNull())
    return joined.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("mean")), 4).alias("similarity"))


@query(
    "j3_aspect_vectors",
    f"""select review_id, aspect_name as aspect, round(case when w > 0 then sw / w / 10000::double else s / c / 10000::double end, 4) as score_10,
      round(r / 10000::double, 4) as relevance, round(p / c / 10000::double, 4) as positive_sim,
      round(n / c / 10000::double, 4) as negative_sim, r / 10000::double > 0.28::double as detected
      from (select review_id, {D.strings(K.ASPECTS)}[aspect + 1] as aspect_name, count(*) as c, sum(p)::double as p, sum(n)::double as n,
        sum(s)::double as s, sum(s * greatest(p, n))::double as sw, sum(greatest(p, n))::double as w, max(greatest(p, n)) as r
        from chunk_scores group by review_id, aspect)""",
    {"anchors": ANCHOR_SQL, "sims": SIMS_SQL, "by_pole": POLES_SQL, "chunk_scores": CHUNK_SQL},
)
def j3(spark, sf):
    chunks = table(spark, sf, "embeddings").select(F.expr("vec_id div 4").alias("review_id"), "embedding")
    scored_vectors = vectors.score_aspect_vectors(chunks, anchors(spark, sf))
    exploded = scored_vectors.select("review_id", F.explode("aspect_detail").alias("aspect", "d"))
    return exploded.select("review_id", "aspect", "d.score_10", "d.relevance", "d.positive_sim", "d.negative_sim", "d.detected")


@query(
    "j4_rule_aspects",
    " union all ".join(
        f"select review_id, '{a}' as aspect, s{i} as score_10, r{i} as relevance, ps{i} as positive_sim, ns{i} as negative_sim, d{i} as detected from aspects"
        for i, a in enumerate(K.ASPECTS)
    ),
)
def j4(spark, sf):
    df = reviews(spark, sf).select(
        "review_id", A.found_keywords(F.lower("feedback_text"), A.rule_keywords()).alias("found")
    )
    exploded = with_rule_aspects(df, "found").select("review_id", F.explode("aspect_detail").alias("aspect", "d"))
    return exploded.select("review_id", "aspect", "d.score_10", "d.relevance", "d.positive_sim", "d.negative_sim", "d.detected")


@query(
    "j5_detect_aspect_vectors",
    """select vec_id, coalesce(array_to_string(list_transform(list_sort(list({'m': -s, 'aspect': label}) filter (where s >= 0.25::double))[1:3],
      lambda a: a.aspect), ' | '), '') as aspects from (select vec_id, list_cosine_similarity(embedding::double[], e) as s, m.label
      from embeddings, label_means m) group by vec_id""",
    {"label_means": LABEL_MEAN_SQL},
)
def j5(spark, sf):
    df = table(spark, sf, "embeddings")
    means = vectors.mean_vectors(df, ["label"]).withColumnRenamed("label", "aspect")
    found = vectors.detect_aspect_vectors(df.select("vec_id", "embedding"), means)
    names = F.transform("aspects", lambda a: a["aspect"].cast("string"))
    return found.select("vec_id", F.coalesce(F.array_join(names, " | "), F.lit("")).alias("aspects"))


@query(
    "j6_detect_aspects",
    """select review_id, array_to_string(list_transform(top, lambda a: a.aspect || '=' || printf('%.2f', -a.m)), ' | ') as aspects from top3""",
    {"detected": DETECTED_SQL, "top3": TOP3_SQL},
)
def j6(spark, sf):
    found = detect_aspects(reviews(spark, sf))
    named = F.transform("aspects", lambda a: F.concat(a["aspect"], F.lit("="), F.format_string("%.2f", a["score"])))
    return found.select("review_id", F.array_join(named, " | ").alias("aspects"))


# --- K: scoring ---------------------------------------------------------------------------


@query("k3_score_reviews", f"select review_id, {SCORED_SQL} from scored")
def k3(spark, sf):
    return flat(scored(spark, sf)).select("review_id", *SCORED, "strengths_list", "improvements_list")


VECTOR_SCORES_SQL = "select vec_id as review_id, " + ", ".join(
    f"max(s) filter (where aspect = {i}) / 10000::double as s{i}, max(greatest(p, n)) filter (where aspect = {i}) / 10000::double as r{i}"
    for i in range(5)
) + f" from (select * from ({CHUNK_SQL.replace('select review_id', 'select vec_id', 1)})) group by vec_id"
VECTOR_BLENDS_SQL = "select l.review_id, l.low, s.label, " + ", ".join(
    D.blend("s.polarity", f"coalesce(v.s{i}, s.polarity)", f"coalesce(v.r{i}, 0::double)") + f" as b{i}" for i in range(5)
) + " from low l join sent s using (review_id) left join vector_scores v using (review_id)"


@query(
    "k2_score_with_vectors",
    "select review_id, case when low <> '' then label else 'Neutral' end as sentiment_label, "
    + ", ".join(f"case when low <> '' then round(b{i}, 2) else 0::double end as {c}" for i, c in enumerate(COLS))
    + ", case when low <> '' then round("
    + D.clamp("0::double + " + " + ".join(f"b{i} * {D.num(K.REVIEW_WEIGHTS[a])}" for i, a in enumerate(K.ASPECTS)), 0, 10)
    + ", 2) else 0::double end as overall_score from vector_blends",
    {"anchors": ANCHOR_SQL, "sims": SIMS_SQL, "by_pole": POLES_SQL, "vector_scores": VECTOR_SCORES_SQL, "vector_blends": VECTOR_BLENDS_SQL},
)
def k2(spark, sf):
    """Embeddings of the documents of the same number; documents without one fall back to the polarity."""
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    details = vectors.score_aspect_vectors(chunks, anchors(spark, sf)).withColumnRenamed("aspect_detail", "found_aspects")
    joined = reviews(spark, sf).join(details, "review_id", "left")
    result = score_reviews(joined, config=ScoringConfig(aspect_details="found_aspects"))
    return result.select("review_id", "sentiment_label", *COLS, "overall_score")


K3_PROSE = {"prose": "select doc_id as review_id, lower(text) as low from documents", **D.token_ctes("pr_", "prose", "low", PROSE)}


@query("k3_score_raw_prose", "select review_id, label as sentiment_label, is_mixed, round(confidence, 4) as confidence from pr_sent", K3_PROSE)
def k3_prose(spark, sf):
    df = spread_table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("feedback_text"))
    result = score_reviews(df, config=ScoringConfig(lexicon=PROSE))
    return result.select("review_id", "sentiment_label", "is_mixed", "confidence")


# --- L: streams ---------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files; a stream takes a file by a pattern only."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def _run(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over what is there, into a Parquet table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, f"{name}-state"))
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("l1_score_stream", "select review_id, label as sentiment_label, is_mixed, round(confidence, 4) as confidence from pr_sent", K3_PROSE)
def l1(spark, sf):
    df = _stream(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("feedback_text"))
    result = stream.score_stream(df, ScoringConfig(lexicon=PROSE))
    return _run(result.select("review_id", "sentiment_label", "is_mixed", "confidence"), "scored-stream")


@query("l2_drop_repeats", f"select distinct sha256(lower({D.trim('text')})) as fingerprint from documents where {D.trim('text')} <> ''")
def l2(spark, sf):
    df = _stream(spark, sf, "documents").select(
        F.col("text").alias("feedback_text"), F.lit("2024-01-01").cast("timestamp").alias("date")
    )
    return _run(stream.drop_repeats(df).select("fingerprint"), "distinct-stream")


WINDOW_SQL = (
    "select strftime(w, '%Y-%m-%d') as window_start, teacher_name, count(*) as total_reviews, "
    + ", ".join(f"round({D.exact_avg(c)}, 2) as {c}" for c in COLS)
    + f", round({D.exact_avg('confidence')}, 4) as confidence, "
    + ", ".join(
        f"{D.pct(f'count(*) filter (where sentiment_label = {D.lit(s)})', 'count(*)')} as {s.lower()}_pct" for s in K.SENTIMENTS
    )
    + """, count(*) filter (where is_mixed) as mixed_count from
      (select *, time_bucket(interval 30 day, date, timestamp '1970-01-01') as w from lines)
      where w + interval 30 day <= (select max(date) - interval 1 day from lines) group by w, teacher_name"""
)


@query("l3_windowed_entities", WINDOW_SQL)
def l3(spark, sf):
    df = score_lines(_stream(spark, sf, "lineitem")).withColumn("date", F.col("date").cast("timestamp"))
    result = _run(stream.windowed_entities(df), "windows")
    return result.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).drop("window_end")


CLOSED_SQL = WINDOW_SQL.replace("      where w + interval 30 day <= (select max(date) - interval 1 day from lines) group by", "      group by")


@query("l3_open_windows", CLOSED_SQL)
def l3_open(spark, sf):
    """All windows, those that are open when the input ends included."""
    df = score_lines(_stream(spark, sf, "lineitem")).withColumn("date", F.col("date").cast("timestamp"))
    path = scratch_path(spark, "open-windows")
    tables.write_windows(stream.windowed_entities(df), path, scratch_path(spark, "open-windows-state")).awaitTermination()
    result = tables.read_windows(spark, path)
    return result.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).drop("window_end")


@query(
    "e2_flag_repeats_stream",
    f"""select doc_id as review_id, fp as fingerprint, coalesce(fp is not null and doc_id > min(doc_id) over (partition by fp), false) as is_duplicate
      from (select doc_id, case when {D.trim('text')} <> '' then sha256(lower({D.trim('text')})) end as fp from documents)""",
)
def e2_stream(spark, sf):
    df = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("feedback_text"), F.lit("2024-01-01").cast("timestamp").alias("date")
    )
    return _run(stream.flag_repeats(df).drop("date"), "flagged-stream")
