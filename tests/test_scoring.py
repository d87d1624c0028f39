import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import Lexicon, ScoringConfig
from reviewlens.functions import aspects as A
from reviewlens.functions import sentiment as S
from reviewlens.functions import text as T
from reviewlens.operators.duplicates import mark_duplicates, score_distinct
from reviewlens.operators.score import SCORED_COLUMNS, detect_aspects, extract_labels, score_reviews

# Sentences, overall, aspect scores, label, confidence, mixed, strengths, improvements.
GOLDENS = [
    (
        "The teacher is excellent but assignments are excessive.",
        8.82, [9.0, 9.0, 9.0, 9.0, 7.8], "Positive", 0.8, False,
        ["excellent assignment design"], ["assignment workload"],
    ),
    (
        "Not very good, never late.",
        4.11, [4.2, 4.2, 4.2, 3.72, 4.2], "Negative", 0.48, True,
        [], ["responsiveness", "improve punctuality and responsiveness"],
    ),
    ("Teaching.", 5.0, [5.0] * 5, "Neutral", 0.34, False, [], []),
    ("   ", 0.0, [0.0] * 5, "Neutral", 0.0, False, [], []),
]


def reviews_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_id bigint, feedback_text string")


def test_goldens(spark):
    rows = score_reviews(reviews_of(spark, [g[0] for g in GOLDENS])).orderBy("review_id").collect()
    for row, (_, overall, aspects, label, confidence, mixed, strengths, improvements) in zip(rows, GOLDENS):
        assert row["overall_score"] == overall
        assert [row[c] for c in K.SCORE_COLUMNS] == aspects
        assert (row["sentiment_label"], row["confidence"], row["is_mixed"]) == (label, confidence, mixed)
        assert (row["strengths_list"], row["improvements_list"]) == (strengths, improvements)


def brute_sentiment(text, lexicon):
    words = re.findall(r"\b[a-z']+\b", text.lower())
    scores = {"p": 0.0, "n": 0.0}
    for i, word in enumerate(words):
        sign = "p" if word in lexicon.positive else "n" if word in lexicon.negative else None
        if sign is None:
            continue
        window = words[max(0, i - 2) : i]
        if any(w in lexicon.negations for w in window):
            sign = "n" if sign == "p" else "p"
        strong = any(w in lexicon.intensifiers and w not in lexicon.negations for w in window)
        scores[sign] += 1.5 if strong else 1.0
    total = scores["p"] + scores["n"]
    if not total:
        return 0.33, 0.33, False
    p, n = round(scores["p"] / total * 0.8, 4), round(scores["n"] / total * 0.8, 4)
    whole = p + 0.2 + n
    mixed = scores["p"] > 0 and scores["n"] > 0 and abs(scores["p"] - scores["n"]) <= 2
    return round(p / whole, 4), round(n / whole, 4), mixed


TRICKY = [
    "not not very good and really no bad idea, but so good",
    "good9 9good _good good_ 'good' good's o'good",
    "é good égood goodé x́good good́ good",
    "very, 5 good. Not 5 6 slow; no way good",
    "very very very good no never bad",
    "hardly ever boring; incredibly, extremely harsh",
    "İstanbul was great—not dry",
]


@pytest.mark.parametrize("lexicon", [Lexicon(), Lexicon(("good", "not"), ("bad", "very"), ("not", "no"), ("very", "so"))])
def test_rule_sentiment_equals_a_plain_loop(spark, lexicon):
    df = reviews_of(spark, TRICKY).withColumn("low", F.lower("feedback_text"))
    for row in S.with_rule_sentiment(df, "low", lexicon).collect():
        p, n, mixed = brute_sentiment(row["feedback_text"], lexicon)
        assert row["sentiment_probs"]["Positive"] == pytest.approx(p, abs=1e-4)
        assert row["sentiment_probs"]["Negative"] == pytest.approx(n, abs=1e-4)
        assert row["is_mixed"] == mixed


def test_tokens_equal_python(spark):
    for row in reviews_of(spark, TRICKY).select("feedback_text", T.tokens(F.lower("feedback_text")).alias("t")).collect():
        assert row["t"] == re.findall(r"\b[a-z']+\b", row["feedback_text"].lower())


def test_found_keywords_are_substrings(spark):
    texts = TRICKY + [" ".join(A.rule_keywords()), "unclearrors grades delayed grades no feedbackgrading", "", *K.SAMPLE_NEGATIVE]
    keywords = list(dict.fromkeys(A.rule_keywords())) + ["a+b", "(x", "o's"]
    texts += ["a+b (x o's", "aab x oos"]
    df = reviews_of(spark, texts).select("feedback_text", A.found_keywords(F.lower("feedback_text"), keywords).alias("f"))
    for row in df.collect():
        assert sorted(row["f"]) == sorted(k for k in keywords if k in row["feedback_text"].lower())


def test_labels_equal_a_plain_loop(spark):
    texts = list(K.SAMPLE_POSITIVE + K.SAMPLE_NEUTRAL + K.SAMPLE_NEGATIVE)
    texts.append(" ".join(k for k, _ in reversed(K.STRENGTH_PHRASES)))
    df = extract_labels(reviews_of(spark, texts))
    signals = A.found_keywords(F.lower("feedback_text"), A.table_keywords(K.STRENGTH_SIGNALS))
    df = df.withColumn("found", signals).withColumn("s", A.signal_labels(F.col("found"), K.STRENGTH_SIGNALS))
    for row in df.collect():
        low = row["feedback_text"].lower()
        expected = list(dict.fromkeys(label for k, label in K.STRENGTH_PHRASES if k in low))[:5]
        assert row["strengths_list"] == expected
        assert row["s"] == [label for label, ks in K.STRENGTH_SIGNALS.items() if any(k in low for k in ks)]


def test_anonymise_equals_python(spark):
    texts = [
        "Student A says I feel my students think. One student noted that we like it. For me I would like my my we I I.",
        "in my opinion a student feels; SOME  STUDENTS wrote myself weird I'm mya my",
        "students thought I loved I\nbelieve we",
        "émy myé _my my_ my9 ın my opinion",
    ]
    result = {r["t"]: r["a"] for r in reviews_of(spark, texts).select(F.col("feedback_text").alias("t"), T.anonymise(F.col("feedback_text")).alias("a")).collect()}
    for text, ours in result.items():
        for pattern, replacement in T.ANONYMOUS_PATTERNS:
            flags = 0 if pattern in T.CASE_SENSITIVE_PATTERNS else re.IGNORECASE
            text = re.sub(r"\b" + pattern.replace(" ", r"\s+") + r"\b", replacement, text, flags=flags)
        assert ours == text.strip()


def test_fingerprint_and_sentences(spark):
    text = "  First one here. Second!  Third is longer? x. \t"
    row = spark.createDataFrame([(text,)], "t string").select(
        T.fingerprint(F.col("t")).alias("f"), T.sentences(F.col("t"), 8).alias("s"), T.chunks(F.lit("tiny")).alias("c")
    ).first()
    assert row["f"] == hashlib.sha256(text.strip().lower().encode()).hexdigest()
    assert row["s"] == [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if len(s.strip()) > 8]
    assert row["c"] == ["tiny"]


def test_duplicates(spark):
    texts = ["Great teacher!", "great TEACHER! ", "Bad class.", "", "", None, "Great teacher!"]
    df = mark_duplicates(reviews_of(spark, texts)).orderBy("review_id")
    assert [r["is_duplicate"] for r in df.collect()] == [False, True, False, False, False, False, True]


def test_scoring_distinct_texts_is_the_same(spark):
    texts = [g[0] for g in GOLDENS] * 3 + [None, "TEACHING."]
    df = reviews_of(spark, texts)
    direct, reused = score_reviews(df), score_distinct(df)
    columns = sorted(direct.columns)
    assert sorted(map(str, direct.select(*columns).collect())) == sorted(map(str, reused.select(*columns).collect()))


def test_rescoring_replaces_columns(spark):
    once = score_reviews(reviews_of(spark, [g[0] for g in GOLDENS]))
    twice = score_reviews(once.withColumn("overall_score", F.lit(-1.0)))
    assert twice.columns == once.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_missing_text_column(spark):
    with pytest.raises(ValueError):
        score_reviews(spark.createDataFrame([(1,)], "x int"))


def test_probabilities(spark):
    rows = [
        (0, [("LABEL_2", 0.6), ("LABEL_1", 0.3), ("LABEL_0", 0.1)]),
        (1, [("POSITIVE", 0.45), ("negative", 0.4)]),
        (2, [("positive", 0.2), ("neutral", 0.4), ("negative", 0.4)]),
    ]
    df = spark.createDataFrame(rows, "review_id bigint, p array<struct<label:string,score:double>>")
    df = df.withColumn("feedback_text", F.lit("some text"))
    result = S.with_probability_sentiment(df, "p").orderBy("review_id").collect()
    assert [r["sentiment_label"] for r in result] == ["Positive", "Positive", "Neutral"]
    assert [r["is_mixed"] for r in result] == [False, True, True]
    assert result[0]["polarity"] == 7.5
    assert result[1]["sentiment_probs"]["Neutral"] == 0.15
    scored = score_reviews(df, config=ScoringConfig(probabilities="p")).orderBy("review_id").collect()
    assert [r["confidence"] for r in scored] == [0.6, 0.45, 0.4]


def test_detect_aspects(spark):
    df = detect_aspects(reviews_of(spark, ["Clear lectures, fun quiz, boring exams, late email reply", "nothing"]))
    first, second = df.orderBy("review_id").collect()
    assert [(a["aspect"], a["score"]) for a in first["aspects"]] == [
        ("Engagement", 0.75), ("Responsiveness", 0.75), ("Communication", 0.45),
    ]
    assert second["aspects"] == []


def test_full_record_flags_repeats(spark):
    from reviewlens.operators.duplicates import analyze_batch

    rows = [(1, "The teacher is excellent"), (2, " the TEACHER is excellent"), (3, ""), (4, ""), (5, "other words")]
    df = spark.createDataFrame(rows, "review_id bigint, feedback_text string")
    flags = {r["review_id"]: r["is_duplicate"] for r in analyze_batch(df).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False, 5: False}
    plain = analyze_batch(df, config=ScoringConfig(deduplicate=False))
    assert not any(r["is_duplicate"] for r in plain.collect()) and "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_distinct_scores_from_probabilities(spark):
    made = [(i, f"text {i % 3}", [("POSITIVE", 0.2 + (i % 3) / 10), ("NEGATIVE", 0.8 - (i % 3) / 10)]) for i in range(12)]
    df = spark.createDataFrame(made, "review_id bigint, feedback_text string, probs array<struct<label:string,score:double>>")
    config = ScoringConfig(probabilities="probs")
    columns = ("review_id", *SCORED_COLUMNS)
    assert sorted(map(str, score_distinct(df, config=config).select(*columns).collect())) == sorted(
        map(str, score_reviews(df, config=config).select(*columns).collect())
    )


def test_keywords_are_found_by_their_rarest_letters(spark):
    """All keywords of a text, overlapping ones too; only the pieces around keywords are searched for them."""
    rng = random.Random(11)
    lists = [
        A.rule_keywords(), A.table_keywords(K.SENTENCE_KEYWORDS), ["a"], ["ee", "eee", "tee e"], ["no feedback", "feedback late", "late", "back"],
        ["not", "note", "no", "e n", "été", "x.y", "(z"],
    ]
    for words in lists:
        letters = sorted(set("".join(words))) + ["\x00", "\n"]
        draw = lambda: rng.choice([rng.choice(words), rng.choice(words)[1:], rng.choice(words)[:-1], rng.choice(letters), " "])
        texts = ["", "\x00", *words, *("".join(draw() for _ in range(rng.randint(1, 12))) for _ in range(300))]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        found = [A.found_keywords(F.col("t"), words, short).alias(str(short)) for short in (False, True)]
        for row in df.select("t", *found).collect():
            expected = sorted({w for w in words if w in row["t"]})
            assert sorted(row["False"]) == expected and sorted(row["True"]) == expected, row["t"]
    pattern, before = A._windows(A.rule_keywords())
    text = "\x00" * before + "it is the nature of plain words that none of them is in a list. " * 20
    pieces = F.regexp_extract_all(F.lit(text + "never late, " + text), F.lit(pattern), F.lit(1))
    assert [len(p) < 60 and "late" in p for p in spark.range(1).select(pieces).first()[0]] == [True]
