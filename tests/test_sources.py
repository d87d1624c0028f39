import random

import pytest
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.operators import views
from reviewlens.sources import reviews as ingest
from reviewlens.sources import sinks


def test_csv_encodings_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Comment,Instructor,Score\n"Said ""fine"",\nand café",Ann,4\nshort,Bob,2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("Review,Rating\nPas mal, déjà vu\n".replace(",", ";", 1).replace("mal, ", "mal ").replace("Review;Rating", "Review,Rating").encode("latin-1"))
    rows = {r["feedback_text"]: r for r in ingest.load_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {'Said "fine",\nand café', "Pas mal déjà vu"}
    first = rows['Said "fine",\nand café']
    assert (first["teacher_name"], first["rating"], first["rating_normalized"]) == ("Ann", 4.0, 100.0)


def test_aliases_prefer_list_order(spark):
    df = spark.createDataFrame([("a", "b", "c")], "text string, ` Comment ` string, staff string")
    assert ingest.normalise_columns(df).columns == ["text", "feedback_text", "teacher_name"]
    with pytest.raises(ValueError):
        ingest.clean_reviews(spark.createDataFrame([(1,)], "n int"))


def test_clean(spark):
    df = spark.createDataFrame(
        [("  long enough ", "5", "2024-02-30"), ("tiny", "4", "2024-01-01"), (None, None, None), ("also long", "x", "March 3, 2024"),
         ("six ch", "2", "12/31/2024")],
        "comment string, stars string, created_at string",
    )
    rows = sorted(ingest.clean_reviews(df).collect(), key=lambda r: r["feedback_text"])
    assert [(r["feedback_text"], r["rating"], r["rating_normalized"]) for r in rows] == [
        ("also long", None, None), ("long enough", 5.0, 100.0), ("six ch", 2.0, 40.0),
    ]
    assert [str(r["date"]) for r in rows] == ["2024-03-03 00:00:00", "None", "2024-12-31 00:00:00"]
    high = ingest.with_normalised_rating(spark.createDataFrame([(50.0,), (80.0,)], "rating double"))
    assert [r["rating_normalized"] for r in high.orderBy("rating").collect()] == [50.0, 80.0]


def test_validate(spark):
    df = spark.createDataFrame([("x", "t"), ("", "t"), (None, "t")], "feedback_text string, teacher_name string")
    row = ingest.validate(df).first()
    assert row["is_valid"] and row["missing_pct"] == 66.67 and len(row["warnings"]) == 2
    assert not ingest.validate(df.drop("feedback_text")).first()["is_valid"]
    assert ingest.validate(df.limit(0)).first()["missing_pct"] == 0.0


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one line\n\n  two lines \r\nthree", encoding="utf-8")
    rows = ingest.load_lines(spark, str(tmp_path), "").collect()
    assert sorted(r["feedback_text"] for r in rows) == ["one line", "three", "two lines"]
    assert {r["teacher_name"] for r in rows} == {"Teacher A"}


def test_sample_is_the_same_for_every_partitioning(spark):
    rows = ingest.sample_reviews(spark, 2000)
    assert sorted(map(str, rows.collect())) == sorted(map(str, rows.repartition(3).collect()))
    assert rows.count() == 2000 and rows.select("teacher_name").distinct().count() == 5
    positive = rows.where(F.col("feedback_text").isin(list(K.SAMPLE_POSITIVE)))
    # ten positive sentences in five parts, eight neutral in three, eight negative in two
    assert abs(positive.count() / 2000 - 50 / 90) < 0.05
    assert positive.agg(F.min("rating")).first()[0] >= 3.5


def test_corpus(spark):
    good = [f"Good point {i}." for i in range(40)]
    bad = [f"Bad point {i}." for i in range(40)]
    corpus = ingest.sample_corpus(spark, 300, good, bad, ["Plain."], [("A", "Math"), ("B", "Art")])
    rows = corpus.collect()
    assert len({r["feedback_text"] for r in rows}) == len(rows)
    assert [r["date"] for r in rows] == sorted(r["date"] for r in rows)
    assert all(r["semester"] == ("Spring " if int(r["date"][5:7]) <= 6 else "Fall ") + r["date"][:4] for r in rows)
    assert any("However, bad point" in r["feedback_text"] for r in rows)


def test_csv_sink_joins_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, labels array<string>")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {r["id"]: r["labels"] for r in back.collect()} == {"1": "a | b", "2": None}
    sinks.write_parquet(df, str(tmp_path / "p"), ("id",))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_views(spark):
    df = spark.createDataFrame(
        [(i, "ab"[i % 2] if i else None, f"text {i}") for i in range(30)], "review_id bigint, teacher_name string, feedback_text string"
    )
    assert views.filter_reviews(df, {"teacher_name": ["a"], "subject": ["x"]}).count() == 14
    assert [r[0] for r in views.filter_options(df, "teacher_name").collect()] == ["a", "b"]
    assert views.explorer(df, 5).columns == ["teacher_name", "feedback_text"]
    assert sorted(r["review_id"] for r in views.first_comments(df, 2).collect()) == [1, 2, 3, 4]
    assert [r["review_id"] for r in views.head(df, 2).collect()] == [0, 1]


def test_csv_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("teacher,comment\nAnn,all is very well\n")
    (tmp_path / "b.csv").write_text("comment,teacher\nnothing is lost,Bob\n")
    (tmp_path / "c.csv").write_text("id,opinion\n7,a third opinion\n".replace("opinion\n7", "comment\n7"))
    rows = {r["feedback_text"]: r["teacher_name"] for r in ingest.load_csv(spark, str(tmp_path)).collect()}
    assert rows == {"all is very well": "Ann", "nothing is lost": "Bob", "a third opinion": None}


def test_csv_text_column_by_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ok,opinion\n1234567,true,quite good\n1234568,false,not so good\n")
    rows = ingest.load_csv(spark, str(tmp_path)).collect()
    assert sorted(r["feedback_text"] for r in rows) == ["not so good", "quite good"]


def test_date_spellings(spark):
    spelled = {
        "1/2/2024": "2024-01-02 00:00", "2024-1-5": "2024-01-05 00:00", "15 March 2024": "2024-03-15 00:00",
        "Mar 5 2024": "2024-03-05 00:00", "2024-01-05 10:00:00+00:00": "2024-01-05 10:00", "2024.01.05": "2024-01-05 00:00",
        "20240105": "2024-01-05 00:00", "5-Jan-2024": "2024-01-05 00:00", "01/02/2024 10:30": "2024-01-02 10:30",
        "25/12/2024": "2024-12-25 00:00", "2024-01-05T10:30:00Z": "2024-01-05 10:30", "1/2/24": "2024-01-02 00:00",
        "March 5th, 2024": "2024-03-05 00:00", "3/5/2024 4:05 pm": "2024-03-05 16:05", "garbage": None, "99/99/2024": None, "": None,
    }
    spelled |= {
        "Fri Jan 5 2024": "2024-01-05 00:00", "Friday, January 5, 2024": "2024-01-05 00:00", "5th March 2024": "2024-03-05 00:00",
        "Sept 5 2024": "2024-09-05 00:00", "2024-01-05 10:00:00 UTC": "2024-01-05 10:00", "12/31/99 5:00 PM": "2099-12-31 17:00",
        "Jan 2024": "2024-01-01 00:00", "2024-1": "2024-01-01 00:00", "2024": "2024-01-01 00:00", "Sunday": None, "31/12/99 5:00 PM": "2099-12-31 17:00",
    }
    df = spark.createDataFrame([(k,) for k in spelled], "d string")
    got = {r["d"]: r["p"] and f"{r['p']:%Y-%m-%d %H:%M}" for r in df.withColumn("p", ingest.lenient_timestamp(F.col("d"))).collect()}
    assert got == spelled
    dated = df.select(F.lit("some text").alias("feedback_text"), F.lit("t").alias("teacher_name"), F.col("d").alias("date"))
    assert "3 dates could not be read." in ingest.validate(dated).first()["warnings"]


def test_dates_vote_for_day_or_month(spark):
    """Most of the dates with one reading decide on the others; each value that fits only the other order keeps its own."""
    def cleaned(dates, **given):
        df = spark.createDataFrame([("some text", d) for d in dates], "feedback_text string, date string")
        return [r["date"] and f"{r['date']:%Y-%m-%d}" for r in ingest.clean_reviews(df.coalesce(1), **given).collect()]

    assert cleaned(["1/2/2024", "25/12/2024", "13.1.24", "12/31/2024"]) == ["2024-02-01", "2024-12-25", "2024-01-13", "2024-12-31"]
    assert cleaned(["1/2/2024", "25/12/2024", "12/31/2024", "1/30/2024"]) == ["2024-01-02", "2024-12-25", "2024-12-31", "2024-01-30"]
    assert cleaned(["1/2/2024", None, "", "x"]) == ["2024-01-02", None, None, None]
    assert cleaned(["1/2/2024"], day_first=True) == ["2024-02-01"] and cleaned([]) == []
    raw = spark.createDataFrame([("1/2/2024",), ("13/1/2024",), (None,), ("",), ("soon",)], "date string")
    assert ingest.date_report(raw).first().asDict() == {"n_rows": 5, "n_blank": 2, "n_read": 2, "n_unread": 1, "day_first": True}
    clean = ingest.clean_reviews(raw.withColumn("feedback_text", F.lit("some text")))
    assert "3 rows have no date." in ingest.validate(clean).first()["warnings"]


def test_cut_files_with_line_breaks(spark, tmp_path):
    """Files cut at any place, inside quoted values too, give what a reader of whole files gives."""
    rng = random.Random(12)
    def value():
        text = "".join(rng.choice(("a", "é", ",", '"', "\n", "\r\n", " ", "word ")) for _ in range(rng.choice((0, 3, 12, 90))))
        return text if rng.random() < 0.3 and not set(text) & set(',"\r\n') else '"' + text.replace('"', '""') + '"'

    for number, (encoding, end) in enumerate((("utf-8", "\n"), ("latin-1", "\r\n"), ("utf-8", "\r\n"))):
        rows = [",".join([str(i), value(), value()]) for i in range(60)]
        rows[30] = '30,"' + "long line\n" * 300 + '",x'
        (tmp_path / f"{number}.csv").write_bytes(end.join(["id,one,two", *rows, ""]).encode(encoding))
    names = ["id", "one", "two"]
    for files, encoding in ((["0.csv", "2.csv"], "UTF-8"), (["1.csv"], "ISO-8859-1")):
        paths = [str(tmp_path / f) for f in files]
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
        whole = sorted(map(repr, reader.schema("id string, one string, two string").csv(paths).collect()))
        for size in ("150", "2000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                records = ingest.csv_records(spark, paths, encoding)
                found = sorted(map(repr, ingest.parsed_records(records, names).collect()))
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert found == whole and len(found) == 60 * len(files)
