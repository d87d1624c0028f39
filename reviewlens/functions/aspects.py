"""Keyword expressions: which keywords a text holds, and what follows from that."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from itertools import islice

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.functions.literals import quoted, sql_array, sql_map, string_array, string_map


_HEADS_PER_BRANCH = 6
_LETTERS_AHEAD = 4
# How often a letter stands in English text, in percent; any other character but the blank is rare.
_FREQUENCY = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (
    12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.2, 0.2, 0.1, 0.1,
))) | {" ": 18.0}
_RARE = 0.1
# Stands between pieces of a text; no keyword holds it.
_GAP = "\x00"


def _class(letters: Iterable[str]) -> str:
    return f"[{''.join(re.escape(letter) for letter in letters)}]"


def _pattern(words: set[str]) -> str:
    """Regular expression of the longest of ``words``, with common beginnings factored out."""
    tails: dict[str, set[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], set()).add(word[1:])
    if not tails:
        return ""
    branches = [re.escape(head) + _pattern(rest) for head, rest in sorted(tails.items())]
    if "" in words:
        return f"(?:{'|'.join(branches)})?"
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _anchors(words: Sequence[str]) -> dict[str, int]:
    """A position in every word, so that few and rare letters stand at these positions.

    The last character of a word is none, if there are others: what follows an anchor rules out most of its places.
    """
    weight = lambda letter: _FREQUENCY.get(letter, _RARE)
    usable = {word: set(word[:-1] or word) for word in words}
    chosen: set[str] = set()
    open_words = set(words)
    while open_words:
        holds = lambda letter: sum(letter in usable[word] for word in open_words)
        letters = sorted(set().union(*(usable[word] for word in open_words)))
        chosen.add(min(letters, key=lambda letter: weight(letter) / holds(letter)))
        open_words = {word for word in words if not usable[word] & chosen}
    for letter in sorted(chosen, key=lambda letter: (-weight(letter), letter)):
        if all(usable[word] & (chosen - {letter}) for word in words):
            chosen.remove(letter)
    return {word: word.index(min(sorted(usable[word] & chosen), key=weight)) for word in words}


def _windows(words: Sequence[str]) -> tuple[str, int]:
    """Regular expression of the pieces of a text (group 1) that hold its keywords, and the characters before an anchor.

    Most positions are ruled out by their character and the next one. Where
    the rest of a keyword stands around its anchor, the piece reaches as far
    to both sides as any keyword that holds this one. Keywords that hold others
    need no anchor of their own.
    """
    anchors = _anchors([word for word in words if not any(other != word and other in word for other in words)])
    reach = [(word, word.index(part) + at) for part, at in anchors.items() for word in words if part in word]
    before, after = max(at for _, at in reach), max(len(word) - at for word, at in reach)
    tails: dict[str, dict[str, list[str]]] = {}
    for word, at in sorted(anchors.items()):
        tails.setdefault(word[at], {}).setdefault(word[at + 1 :], []).append(word)

    def rest(ends: dict[str, list[str]], tail: str = "") -> str:
        """What follows an anchor, letter by letter; the start of the word is looked up at its end."""
        whole = ends.get("", [])
        if any(len(word) == len(tail) for word in whole):
            return ""
        branches = [f"(?<={'|'.join(re.escape(word) for word in whole)})"] if whole else []
        for letter in sorted({end[0] for end in ends if end}):
            branches.append(re.escape(letter) + rest({end[1:]: of for end, of in ends.items() if end[:1] == letter}, tail + letter))
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    branches = [f"{re.escape(letter)}(?={rest(ends, letter)})" for letter, ends in sorted(tails.items(), key=lambda t: -_FREQUENCY.get(t[0], _RARE))]
    following = {end[:1] for ends in tails.values() for end in ends}
    second = "" if "" in following else _class(sorted(following))
    first = f"(?={_class(sorted(tails))}{second})"
    piece = f"(?<=(?=([\\s\\S]{{1,{before + after}}}))[\\s\\S]{{{before + 1}}})"
    return f"{first}(?:{'|'.join(branches)}){piece}", before


def found_keywords(lowered: Column, keywords: Iterable[str], short: bool = False) -> Column:
    """The distinct ones of ``keywords`` that are substrings of a lower-case text.

    One pass over the text takes out the pieces around keywords, by their
    rarest letters; ``short`` texts, as single sentences, do without it. In
    the pieces, at every position the longest keyword that starts there is
    taken, then the shorter keywords that it begins with are added ("errors"
    also holds "error"). "unclear" holds "clear", which starts later.
    """
    words = tuple(dict.fromkeys(keywords))
    if not short:
        windows, before = _windows(words)
        pieces = F.regexp_extract_all(F.concat(F.lit(_GAP * before), lowered), F.lit(windows), F.lit(1))
        lowered = F.array_join(pieces, _GAP)
    heads = sorted({word[0] for word in words})
    # A few words per branch: most positions are ruled out by a handful of letter classes, one for each of the first letters.
    branches = []
    for i in range(0, len(heads), _HEADS_PER_BRANCH):
        some = {word for word in words if word[0] in heads[i : i + _HEADS_PER_BRANCH]}
        ahead = "".join(_class(sorted(set(letters))) for letters in islice(zip(*some), _LETTERS_AHEAD))
        branches.append(f"(?={ahead}){_pattern(some)}")
    pattern = f"(?=({'|'.join(branches)})){_class(heads)}"
    longest = F.array_distinct(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1)))
    table = sql_map({word: sql_array(quoted(w) for w in words if word.startswith(w)) for word in words})
    return F.array_distinct(F.flatten(F.transform(longest, lambda word: F.try_element_at(table, word))))


def count_found(found: Column, keywords: Sequence[str]) -> Column:
    return F.size(F.array_intersect(string_array(keywords), found))


def signal_labels(found: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Labels with at least one keyword found, in table order."""
    entries: dict[str, list[str]] = {}
    for i, (label, words) in enumerate(table.items()):
        for word in words:
            entries.setdefault(word, []).append(f"named_struct('position', {i}, 'label', {quoted(label)})")
    by_word = sql_map({word: sql_array(of) for word, of in entries.items()})
    held = F.array_intersect(string_array(entries), found)
    labels = F.array_distinct(F.flatten(F.transform(held, lambda word: F.try_element_at(by_word, word))))
    return F.transform(F.array_sort(labels), lambda entry: entry["label"])


def phrase_labels(found: Column, pairs: Sequence[tuple[str, str]], most: int = K.MAX_LABELS) -> Column:
    """Distinct labels of (keyword, label) pairs, in table order, at most ``most``."""
    by_word = string_map(dict(pairs))
    held = F.array_intersect(string_array(word for word, _ in pairs), found)
    return F.slice(F.array_distinct(F.transform(held, lambda word: F.try_element_at(by_word, word))), 1, most)


def rule_keywords() -> list[str]:
    """All keywords that the rule scoring looks for."""
    keywords: list[str] = []
    for positive, negative in K.ASPECT_KEYWORDS.values():
        keywords += positive + negative
    for table in (K.STRENGTH_SIGNALS, K.IMPROVEMENT_SIGNALS):
        keywords += table_keywords(table)
    return keywords + phrase_keywords()


def table_keywords(table: Mapping[str, Sequence[str]]) -> list[str]:
    return [word for words in table.values() for word in words]


def phrase_keywords() -> list[str]:
    return [word for word, _ in K.STRENGTH_PHRASES + K.IMPROVEMENT_PHRASES]


def aspect_record(positive: str, negative: str) -> str:
    """SQL of the aspect record for columns with the numbers of positive and negative keywords found."""
    found = f"({positive} + {negative})"
    relevance = f"least(1.0D, {found} / 3.0D)"
    return f"""named_struct(
        'score_10', if({found} > 0, greatest(1.0D, least(9.0D, 5.0D + ({positive} - {negative}) * 2.0D)), 5.0D),
        'relevance', round({relevance}, 2),
        'positive_sim', round(least(1.0D, {positive} / 3.0D), 2),
        'negative_sim', round(least(1.0D, {negative} / 3.0D), 2),
        'detected', {relevance} > {K.RULE_DETECTED_THRESHOLD}D)"""


def blended_score(aspect: str, polarity: str, detail: str = "aspect_detail", alpha: float = K.POLARITY_ALPHA) -> Column:
    """Aspect score pulled towards the polarity, the more so the less relevant the aspect is.

    An aspect without a record scores the polarity. ``polarity`` is SQL.
    """
    record = f"{detail}[{quoted(aspect)}]"
    score = f"coalesce({record}.score_10, {polarity})"
    beta = f"least(1.0D, coalesce({record}.relevance, 0.0D) * 2.0D)"
    blended = f"((1.0D - {beta}) * {polarity} + {beta} * {score})"
    final = f"{1.0 - alpha!r}D * {blended} + {alpha!r}D * {polarity}"
    return F.expr(f"round(greatest(0.0D, least(10.0D, {final})), 4)")


def top_aspects(scored: Column, top_k: int, threshold: float) -> Column:
    """The best ``array<struct<aspect, score>>`` entries at or over the threshold; ties in given order."""
    ranked = F.transform(
        scored,
        lambda item, i: F.struct((-item["score"]).alias("minus"), i.alias("position"), item["aspect"].alias("aspect")),
    )
    kept = F.filter(ranked, lambda item: -item["minus"] >= threshold)
    return F.transform(
        F.slice(F.array_sort(kept), 1, top_k),
        lambda item: F.struct(item["aspect"].alias("aspect"), F.round(-item["minus"], 4).alias("score")),
    )


def detect_by_keywords(
    lowered: Column, top_k: int = K.DETECT_TOP_K, threshold: float = K.DETECT_THRESHOLD
) -> Column:
    """Top aspects by the number of keywords found: 0.3 + 0.15 each, at most 0.95."""
    found = found_keywords(lowered, table_keywords(K.DETECTOR_KEYWORDS))
    positions: dict[str, list[str]] = {}
    for i, keywords in enumerate(K.DETECTOR_KEYWORDS.values()):
        for word in keywords:
            positions.setdefault(word, []).append(str(i))
    by_word = sql_map({word: sql_array(of) for word, of in positions.items()})
    mentions = F.flatten(F.transform(found, lambda word: F.try_element_at(by_word, word)))
    matches = F.aggregate(
        mentions,
        F.array_repeat(F.lit(0), len(K.DETECTOR_KEYWORDS)),
        lambda counts, at: F.transform(counts, lambda n, i: n + (i == at).cast("int")),
    )

    def scored(n: Column, i: Column) -> Column:
        score = F.least(F.lit(0.95), F.lit(0.3) + n * F.lit(0.15))
        aspect = F.get(string_array(K.DETECTOR_KEYWORDS), i)
        return F.struct(aspect.alias("aspect"), F.when(n > 0, score).otherwise(F.lit(-1.0)).alias("score"))

    return top_aspects(F.transform(matches, scored), top_k, max(threshold, 0.0))
