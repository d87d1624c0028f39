import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.operators import vectors


def cosine(a, b):
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / length) if length else 0.0


def test_aspect_vectors_equal_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    anchors = [(a, pole, rng.normal(size=6)) for a in K.ASPECTS for pole in ("positive", "negative") for _ in range(4)]
    chunks = [(i // 3, rng.normal(size=6)) for i in range(12)] + [(9, np.zeros(6))]
    anchor_df = spark.createDataFrame([(a, p, v.tolist()) for a, p, v in anchors], "aspect string, pole string, embedding array<double>")
    chunk_df = spark.createDataFrame([(r, v.tolist()) for r, v in chunks], "review_id bigint, embedding array<double>")
    result = {r["review_id"]: r["aspect_detail"] for r in vectors.score_aspect_vectors(chunk_df, anchor_df).collect()}
    for review in {r for r, _ in chunks}:
        for aspect in K.ASPECTS:
            values = []
            for r, vector in chunks:
                if r == review:
                    sims = {
                        pole: np.mean(sorted((cosine(vector, v) for a, p, v in anchors if a == aspect and p == pole), reverse=True)[:3])
                        for pole in ("positive", "negative")
                    }
                    p, n = round(sims["positive"], 4), round(sims["negative"], 4)
                    values.append((p, n, round((sims["positive"] - sims["negative"] + 1) / 2 * 10, 4), max(p, n)))
            p, n, net, rel = map(np.array, zip(*values))
            score = float(net @ rel / rel.sum()) if rel.sum() > 0 else float(net.mean())
            record = result[review][aspect]
            assert record["score_10"] == pytest.approx(score, abs=2e-4)
            assert record["positive_sim"] == pytest.approx(p.mean(), abs=2e-4)
            assert record["relevance"] == pytest.approx(rel.max(), abs=1e-4)
            assert record["detected"] == (rel.max() > 0.28)


def test_detection_and_cosine(spark):
    aspects = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [-1.0, 0.0])], "aspect string, embedding array<double>")
    texts = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "id int, embedding array<double>")
    found = {r["id"]: [(a["aspect"], a["score"]) for a in r["aspects"]] for r in vectors.detect_aspect_vectors(texts, aspects).collect()}
    assert found == {1: [("x", 0.7071), ("y", 0.7071)], 2: []}
    row = texts.select("id", vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).orderBy("id").collect()
    assert [round(r["c"], 4) for r in row] == [0.7071, 0.0]


def test_many_anchors_equal_one_matrix_product(spark, monkeypatch):
    """50,000 anchors, many of them ties; the first 700 also in blocks of 64 that come in one, four or eleven rounds."""
    rng = np.random.default_rng(1)
    texts = rng.normal(size=(40, 4))
    values = rng.integers(-3, 4, size=(50_000, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(texts)], "id int, embedding array<double>").repartition(3)
    schema = "aspect string, embedding array<double>"

    def found(size):
        rows = [(f"a{i:05}", v.tolist()) for i, v in enumerate(values[:size])]
        result = vectors.detect_aspect_vectors(df, spark.createDataFrame(rows, schema), threshold=-1.0)
        return {r["id"]: [(a["aspect"], a["score"]) for a in r["aspects"]] for r in result.collect()}

    def check(result, size):
        unit = values[:size] / np.maximum(np.linalg.norm(values[:size], axis=1, keepdims=True), 1e-9)
        similar = texts / np.linalg.norm(texts, axis=1, keepdims=True) @ unit.T
        assert len(result) == len(texts)
        for i, best in result.items():
            assert [s for _, s in best] == pytest.approx(-np.sort(-similar[i])[:3], abs=1e-4)
            assert [similar[i][int(a[1:])] for a, _ in best] == pytest.approx([s for _, s in best], abs=1e-4)

    check(found(50_000), 50_000)
    whole = found(700)
    check(whole, 700)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    for blocks in (11, 3, 1):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", blocks * 64 * 8 * 5)
        assert found(700) == whole


def test_ties_between_anchors_go_by_name(spark):
    same = spark.createDataFrame([(c, [1.0, 0.0]) for c in "dbca"], "aspect string, embedding array<double>")
    text = spark.createDataFrame([(1, [2.0, 0.0])], "id int, embedding array<double>")
    assert [a["aspect"] for a in vectors.detect_aspect_vectors(text, same).first()["aspects"]] == ["a", "b", "c"]


def test_no_anchors(spark):
    texts = spark.createDataFrame([(1, [2.0, 0.0], "x"), (2, None, None)], "review_id bigint, embedding array<double>, aspect string")
    aspects = spark.createDataFrame([], "aspect string, embedding array<double>")
    assert [r["aspects"] for r in vectors.detect_aspect_vectors(texts, aspects).collect()] == [[], []]
    anchors = spark.createDataFrame([], "aspect string, pole string, embedding array<double>")
    assert [r["aspect_detail"] for r in vectors.score_aspect_vectors(texts, anchors).collect()] == [{}]


def test_missing_vectors_and_poles(spark):
    anchors = spark.createDataFrame([("Engagement", "positive", [1.0, 0.0]), ("Engagement", "positive", None)], "aspect string, pole string, embedding array<double>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "review_id bigint, embedding array<double>")
    found = vectors.score_aspect_vectors(chunks, anchors).collect()
    assert [r["review_id"] for r in found] == [1] and found[0]["aspect_detail"]["Engagement"]["negative_sim"] == 0.0
    aspects = spark.createDataFrame([("a", [1.0, 0.0])], "aspect string, embedding array<double>")
    rows = {r["review_id"]: r["aspects"] for r in vectors.detect_aspect_vectors(chunks, aspects, threshold=0.0).collect()}
    assert len(rows[1]) == 1 and rows[2] == []


def test_chunks(spark):
    df = spark.createDataFrame([(1, "A first sentence. A second one here."), (2, " ")], "review_id bigint, feedback_text string")
    assert [r["feedback_text"] for r in vectors.text_chunks(df).collect()] == ["A first sentence.", "A second one here."]
    assert vectors.text_chunks(df, sentence_level=False).count() == 1
