"""Text expressions: trimming, folding, tokens, sentences, words, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it for text, plus the four ASCII separators.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACE_RANGES}]"
NOT_SPACE = f"[^{_SPACE_RANGES}]"
_WORD = r"[\p{L}\p{N}_]"
BEFORE_WORD = f"(?<!{_WORD})"
AFTER_WORD = f"(?!{_WORD})"


def text_trim(text: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` alone strips blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return F.coalesce(text_trim(text) == "", F.lit(True))


def fold(lowered: Column) -> Column:
    """Map lower-case text to ASCII so that ``\\b`` and ``\\w`` mean the Unicode word rules.

    Letters and digits outside ASCII become ``0``, everything else outside
    ASCII becomes a blank. Texts that are ASCII already are left alone.
    """
    is_ascii = F.length(lowered) == F.octet_length(lowered)
    spaced = F.regexp_replace(lowered, r"[\x{80}-\x{10FFFF}&&[^\p{L}\p{N}]]", " ")
    return F.when(is_ascii, lowered).otherwise(F.regexp_replace(spaced, r"[\x{80}-\x{10FFFF}]", "0"))


def tokens(lowered: Column) -> Column:
    """Lower-case word tokens, apostrophes included."""
    return F.regexp_extract_all(fold(lowered), F.lit(r"\b[a-z']+\b"), F.lit(0))


def keyword_tokens(lowered: Column) -> Column:
    """Words of four ASCII letters or more."""
    return F.regexp_extract_all(fold(lowered), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))


def _parts(text: Column) -> Column:
    """Sentences of any length; they neither begin nor end with white space."""
    return F.split(text_trim(text), f"(?<=[.!?]){SPACE}+")


def sentences(text: Column, longer_than: int) -> Column:
    """Sentences after ``.``, ``!`` or ``?`` plus white space, trimmed, of more than so many characters."""
    return F.filter(_parts(text), lambda s: F.length(s) > longer_than)


def chunks(text: Column) -> Column:
    """Sentences of more than eight characters, or the whole text when there are none."""
    found = sentences(text, 8)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text_trim(text)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def words_up_to(text: Column, most: int) -> Column:
    """The number of words, or ``most`` if there are as many: a long text is left after that many words."""
    enough = text.rlike(f"^{SPACE}*+(?:{NOT_SPACE}++{SPACE}++){{{most - 1}}}{NOT_SPACE}")
    return F.when(enough, most).otherwise(F.size(words(text)))


def cap_words(text: Column, more_than: int, keep: int) -> Column:
    """Texts of more than ``more_than`` words become their first ``keep`` words and ``...``."""
    found = words(text)
    cut = F.concat(F.array_join(F.slice(found, 1, keep), " "), F.lit("..."))
    return F.when(F.size(found) > more_than, cut).otherwise(text)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased text."""
    return F.sha2(F.lower(text_trim(text)), 256)


_SPEECH = "(says|commented|noted|notices|noticed|feels|feel|thinks|thought|writes|wrote)"

# Patterns and replacements (fixed values, applied in this order). White space is
# written as a blank here and means one or more white-space characters.
ANONYMOUS_PATTERNS = (
    ("Student [A-Z]", "Feedback"),
    (f"(a|one|some) students? {_SPEECH}", "feedback indicates"),
    (f"students? {_SPEECH}", "feedback indicates"),
    ("my students", "the class"),
    ("I (feel|think|believe|found)", "it was noted"),
    ("I would like", "it was suggested"),
    ("I (loved|liked|enjoyed|appreciated)", "feedback appreciated"),
    ("in my opinion", "feedback indicates"),
    ("for me", ""),
    ("I", "feedback"),
    ("my", "the"),
    ("we", "feedback"),
)
CASE_SENSITIVE_PATTERNS = ("I",)
# Every pattern that is not about students holds one of the words "I", "my", "me" and "we" (or "wy"), in any case.
# What follows is looked at before what precedes, plain letters first: few of these letters end a word.
_FIRST_PERSON = (
    f"[iI\u0130\u0131](?![a-z]){AFTER_WORD}(?<!{_WORD}.)|[mMwW][yYeE](?![a-z]){AFTER_WORD}(?<!{_WORD}..)"
)
# Letters that equal an ASCII letter when case is ignored.
_CASE_TWINS = {"i": "\u0130\u0131", "s": "\u017f"}


def _any_case(pattern: str) -> str:
    return f"(?iu:{pattern})".replace(" ", f"{SPACE}+") if pattern else ""


def _whole_words(pattern: str) -> str:
    """The pattern between word boundaries.

    It starts with its possible first letters, and the boundary before them is
    looked up afterwards, since most positions fail on the letter already.
    """
    if pattern in CASE_SENSITIVE_PATTERNS:
        return f"{pattern}(?<!{_WORD}.){AFTER_WORD}"
    starts, rest = [pattern], ""
    if pattern.startswith("("):
        starts, rest = pattern[1 : pattern.index(")")].split("|"), pattern[pattern.index(")") + 1 :]
    branches = []
    for start in starts:
        first = start[0].lower()
        letters = first + first.upper() + _CASE_TWINS.get(first, "")
        branches.append(f"[{letters}](?<!{_WORD}.){_any_case(start[1:])}")
    return f"(?:{'|'.join(branches)}){_any_case(rest)}{AFTER_WORD}"


def anonymise(text: Column) -> Column:
    """Replace mentions of single students and first-person wording.

    The patterns about students come first. They are tried only on texts that
    hold the word, the others only on texts with a word in the first person.
    """

    def replaced(value: Column, about_students: bool) -> Column:
        for pattern, replacement in ANONYMOUS_PATTERNS:
            if ("tudent" in pattern) == about_students:
                value = F.regexp_replace(value, _whole_words(pattern), replacement)
        return value

    mentioned = F.contains(F.lower(text), F.lit("tudent"))
    text = F.when(mentioned, replaced(text, True)).otherwise(text)
    return text_trim(F.when(text.rlike(_FIRST_PERSON), replaced(text, False)).otherwise(text))


def anonymous_sentences(text: Column, longer_than: int) -> Column:
    """The :func:`sentences` of the anonymised text; only sentences with wording to replace are rewritten.

    No pattern reaches over the end of a sentence. A rewritten one is split
    again: "Fine.For me not." ends a sentence where a wording is left out.
    """

    def wording(value: Column) -> Column:
        return F.contains(F.lower(value), F.lit("tudent")) | value.rlike(_FIRST_PERSON)

    def rewritten(part: Column) -> Column:
        return F.when(wording(part), _parts(anonymise(part))).otherwise(F.array(part))

    parts = _parts(text)
    parts = F.when(wording(text), F.flatten(F.transform(parts, rewritten))).otherwise(parts)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def extractive(text: Column, n_sentences: int = 3) -> Column:
    """The first sentences of more than 20 characters; without any, the first 300 characters."""
    chosen = F.slice(sentences(text, 20), 1, n_sentences)
    return F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(F.substring(text, 1, 300))
