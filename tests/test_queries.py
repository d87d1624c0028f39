"""Every registered query against its SQL twin on the smallest tables, and checks of the plans."""

import os

import pytest

import __spark_entry__ as entry
from checks import catalog, views
from checks.compare import compare, connect
from reviewlens.operators import skew
from reviewlens.operators.score import score_reviews

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@needs_tables
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    result = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert result.startswith(("equal", "rows-only")), result


SKEW_QUERIES = (
    "c1_score_distinct_texts", "c2_refresh_summaries", "d1_entity_aggregate", "e1_rank", "e2_duplicate_flags",
    "i13_summary_per_entity", "i16_entity_summary",
)


@needs_tables
@pytest.mark.parametrize("name", SKEW_QUERIES)
def test_large_table_paths_give_the_same(spark, duck, monkeypatch, name):
    """The ways for large lookup tables, large groups and large rankings, forced by tiny limits."""
    for limit, value in {"BROADCAST_ROWS": 3, "HOT_KEYS": 20, "SINGLE_TASK_ROWS": 5, "PARTS": 2}.items():
        monkeypatch.setattr(skew, limit, value)
    result = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert result.startswith("equal"), result


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_scoring_is_one_narrow_pass(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("text", "feedback_text")
    text = plan(score_reviews(df).where("lang = 'en'").select("doc_id", "overall_score"))
    assert "Exchange" not in text and "Python" not in text
    assert "EqualTo(lang,en)" in text
    assert "n_chars" not in text.split("ReadSchema")[1]


@needs_tables
def test_group_summary_needs_no_wide_shuffle(spark):
    from reviewlens.operators.entity import summarise_groups

    text = plan(summarise_groups(catalog.scored(spark, SF), "teacher_name", ["overall_score"]))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Python" not in text
    assert text.count("FileScan parquet") == 2  # documents and labels, once each
    assert "WindowGroupLimit" in text


@needs_tables
def test_no_cross_joins(spark):
    for name in ("d1_entity_aggregate", "a8_rating_scale", "d25_key_figures", "e2_duplicate_flags", "j3_aspect_vectors"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sentences_are_numbered_alike():
    assert len(views.SENTENCES) == 32
