"""Sentiment expressions: the word-list rules and the class-probability path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import Lexicon
from reviewlens.functions import text as T
from reviewlens.functions.literals import quoted

# A token becomes one digit: 3 x polarity (0 none, 1 positive, 2 negative) plus
# role (0 none, 1 negation, 2 intensifier). What matters about a text is then a
# short digit string, and the two-word look-back is a look-behind on it.
_POLARITY_DIGITS = {"positive": "[345]", "negative": "[678]"}
_NEGATED = "(?<=[147].?)"
_INTENSIFIED = "(?<=[258].?)"


def token_digits(tokens: str, lexicon: Lexicon) -> Column:
    """The digit string of the token array in column ``tokens``."""
    digits: dict[int, list[str]] = {}
    for word in dict.fromkeys(
        lexicon.positive + lexicon.negative + lexicon.negations + lexicon.intensifiers
    ):
        polarity = 1 if word in lexicon.positive else 2 if word in lexicon.negative else 0
        role = 1 if word in lexicon.negations else 2 if word in lexicon.intensifiers else 0
        digits.setdefault(3 * polarity + role, []).append(word)
    cases = " ".join(
        f"when token in ({', '.join(quoted(w) for w in members)}) then '{digit}'" for digit, members in digits.items()
    )
    words = ", ".join(quoted(w) for members in digits.values() for w in members)
    if not words:
        return F.expr(f"repeat('0', size({tokens}))")
    # Most tokens are in no list: they are looked up once.
    return F.expr(f"array_join(transform({tokens}, token -> case when token in ({words}) then case {cases} end else '0' end), '')")


def _weights(digits: Column, polarity: str) -> tuple[Column, Column]:
    """(weight of plain hits, weight of negated hits); an intensified hit weighs 1.5."""
    hit = _POLARITY_DIGITS[polarity]
    every = F.regexp_count(digits, F.lit(hit))
    strong = F.regexp_count(digits, F.lit(_INTENSIFIED + hit))
    negated = F.regexp_count(digits, F.lit(_NEGATED + hit))
    negated_strong = F.regexp_count(digits, F.lit(_NEGATED + _INTENSIFIED + hit))
    plain_weight = (every - negated) + (strong - negated_strong) * F.lit(0.5)
    negated_weight = negated + negated_strong * F.lit(0.5)
    return plain_weight, negated_weight


def polarity_score(positive: Column, negative: Column) -> Column:
    """Probabilities to a 0-10 polarity; 5 is balanced."""
    return F.round((positive - negative + 1.0) / 2.0 * 10.0, 4)


def with_rule_sentiment(df: DataFrame, lowered: str, lexicon: Lexicon | None = None) -> DataFrame:
    """Add ``sentiment_label``, ``sentiment_probs``, ``polarity``, ``confidence`` and ``is_mixed``."""
    lexicon = lexicon or Lexicon()
    df = df.withColumn("_tokens", T.tokens(F.col(lowered)))
    # Hits look back two words: of more words without a role in a row, two are enough.
    df = df.withColumn("_digits", F.regexp_replace(token_digits("_tokens", lexicon), "0{3,}", "00")).drop("_tokens")
    digits = F.col("_digits")
    positive, negated_positive = _weights(digits, "positive")
    negative, negated_negative = _weights(digits, "negative")
    df = df.withColumns({"_pos": positive + negated_negative, "_neg": negative + negated_positive})
    pos, neg = F.col("_pos"), F.col("_neg")
    total = pos + neg
    df = df.withColumns(
        {
            "_p": F.when(total > 0, F.round(pos / total * 0.8, 4)),
            "_n": F.when(total > 0, F.round(neg / total * 0.8, 4)),
        }
    )
    scale = F.col("_p") + F.lit(0.2) + F.col("_n")
    df = df.withColumn(
        "sentiment_probs",
        F.struct(
            F.coalesce(F.round(F.col("_p") / scale, 4), F.lit(0.33)).alias("Positive"),
            F.coalesce(F.round(F.lit(0.2) / scale, 4), F.lit(0.34)).alias("Neutral"),
            F.coalesce(F.round(F.col("_n") / scale, 4), F.lit(0.33)).alias("Negative"),
        ),
    )
    p, n = F.col("sentiment_probs.Positive"), F.col("sentiment_probs.Negative")
    df = df.withColumns(
        {
            "sentiment_label": F.when(F.abs(p - n) < 0.15, "Neutral")
            .when(p > n, "Positive")
            .otherwise("Negative"),
            "polarity": polarity_score(p, n),
            "is_mixed": (pos > 0) & (neg > 0) & (F.abs(pos - neg) <= 2),
        }
    )
    return df.withColumn("confidence", label_probability()).drop("_digits", "_pos", "_neg", "_p", "_n")


def label_probability() -> Column:
    expression = F
    for label in K.SENTIMENTS:
        expression = expression.when(F.col("sentiment_label") == label, F.col(f"sentiment_probs.{label}"))
    return expression


def canonical_label(label: Column) -> Column:
    """Model label spellings to the three classes; other spellings are capitalised."""
    expression = F
    for spelling, canonical in K.PROBABILITY_LABELS.items():
        expression = expression.when(label == spelling, canonical)
    capitalised = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 2**31 - 1)))
    return expression.otherwise(capitalised)


def with_probability_sentiment(df: DataFrame, probabilities: str) -> DataFrame:
    """The same columns from an ``array<struct<label, score>>`` of class probabilities.

    Scores of one class add up. What is missing to a total of 1 goes to Neutral
    when the total stays under 0.99 (two-class models).
    """
    renamed = F.transform(
        F.col(probabilities),
        lambda item: F.struct(
            canonical_label(item["label"]).alias("label"), item["score"].cast("double").alias("score")
        ),
    )
    df = df.withColumn("_classes", renamed)

    def total_of(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda total, item: total + item["score"])

    def total_for(label: str) -> Column:
        return total_of(F.filter("_classes", lambda item: item["label"] == label))

    total = total_of(F.col("_classes"))
    df = df.withColumn(
        "_raw",
        F.struct(
            total_for("Positive").alias("Positive"),
            (total_for("Neutral") + F.when(total < 0.99, 1.0 - total).otherwise(F.lit(0.0))).alias("Neutral"),
            total_for("Negative").alias("Negative"),
        ),
    )
    raw = [F.col(f"_raw.{label}") for label in K.SENTIMENTS]
    top = F.greatest(*raw)
    ordered = F.sort_array(F.array(*raw), asc=False)
    label = F
    for name, value in zip(K.SENTIMENTS, raw):
        label = label.when(value == top, name)
    return df.withColumns(
        {
            "sentiment_label": label,
            "sentiment_probs": F.struct(*[F.round(v, 4).alias(n) for n, v in zip(K.SENTIMENTS, raw)]),
            "polarity": polarity_score(raw[0], raw[2]),
            "confidence": F.round(top, 4),
            "is_mixed": (F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))) < K.MIXED_THRESHOLD,
        }
    ).drop("_classes", "_raw")
