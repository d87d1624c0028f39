"""Secret scans: patterns, and sliding-window entropy per character class.

A task holds one small Arrow batch and works on one text at a time; nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import pick, table

MASK = "[SECRET]"

# The patterns of the contract. Letters of the names stand in either case.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", name) for name in _NAMES)
ASSIGN = re.compile(rf"""({_EITHER_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
SHORTEST_VALUE, SHORTEST_ACCESS = 6, 20

#: Strings that may hold a secret: runs of these characters, so long at least.
SHORTEST_CANDIDATE = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST_CANDIDATE},}}")

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Windows of ``width`` characters of ``run`` are secret from ``bits`` of entropy per character on."""

    kind: str
    run: re.Pattern
    width: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
    CharacterClass("entropy_alnum", re.compile(r"[0-9A-Za-z]{20,}"), 20, 3.85),
    CharacterClass("entropy_base64", re.compile(r"[0-9A-Za-z+/_=-]{32,}"), 32, 4.3),
    # As short as the shortest candidate, so that a class scans every candidate.
    CharacterClass("entropy_base64", re.compile(r"[0-9A-Za-z+/_=-]{20,}"), 20, 3.85),
)
#: Words that are no part of a secret; what stands beside them is judged by itself.
PLACEHOLDER = re.compile(r"(?<![a-z])(?:example|placeholder|changeme|dummy|sample)(?![a-z])", re.I)
#: Candidates that are no secrets: identifiers, digest labels, running characters.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"sha(?:1|256|384|512)-.*"),
    re.compile(r"[^0-9]*"),
    re.compile(r"[0-9+/_=-]*"),
    re.compile(r"(.{1,8})\1+"),
    re.compile(r"(?i:0123456789(?:abcdef|abcdefghijklmnopqrstuvwxyz)?)+"),
    re.compile(r"(?:/[A-Za-z_-]+[0-9]{0,4})+/?"),
)


#: Words inside an identifier, and the share of its letters and digits from which on it consists of them: of mixed case
#: or with separators, and otherwise, where chance makes words of letters more often.
WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
WORD_SHARE, PLAIN_WORD_SHARE = 0.6, 0.8
_VOWEL, _CONSONANTS = re.compile("[aeiouy]", re.I), re.compile("[^aeiouy]{5}", re.I)


def is_wordy(span: str) -> bool:
    """Whether a span is made of words, as names in code and slugs are: letters that have vowels and no five consonants."""
    inside = sum(len(w) for w in WORD.findall(span) if _VOWEL.search(w) and not _CONSONANTS.search(w))
    mixed = any(c in "-_/" for c in span) or (span.upper() != span and span.lower() != span)
    return inside >= (WORD_SHARE if mixed else PLAIN_WORD_SHARE) * sum(c.isalnum() for c in span)


def entropy_spans(run: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose Shannon entropy is at least ``bits``.

    Moving the window by one character changes two counts; the sum of
    n * log2(n) over the counts follows from these alone.
    """
    weight = [0.0, *(n * math.log2(n) for n in range(1, width + 2))]
    counts: dict[str, int] = {}
    total, limit, found = 0.0, (math.log2(width) - bits) * width + 1e-9, []
    for at, char in enumerate(run):
        n = counts.get(char, 0)
        total += weight[n + 1] - weight[n]
        counts[char] = n + 1
        if at >= width:
            gone = run[at - width]
            n = counts[gone]
            total += weight[n - 1] - weight[n]
            counts[gone] = n - 1
        begin = at - width + 1
        if begin >= 0 and total <= limit:
            if found and begin <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((begin, at + 1))
    return found


def _joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((begin, end))
    return joined


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Places of the candidates; one with placeholder words gives the parts beside these that are as long."""
    for candidate in CANDIDATE.finditer(text):
        words = list(PLACEHOLDER.finditer(candidate[0]))
        if not words:
            yield candidate.span()
            continue
        begins = [0, *(word.end() for word in words)]
        ends = [*(word.start() for word in words), len(candidate[0])]
        for begin, end in zip(begins, ends, strict=True):
            part = candidate[0][begin:end]
            begin += len(part) - len(part.lstrip("+/_=-"))
            if end < len(candidate[0]):
                end -= len(part) - len(part.rstrip("+/_-"))
            if end - begin >= SHORTEST_CANDIDATE:
                yield candidate.start() + begin, candidate.start() + end


def find_secrets(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret part) of every span, by start, then kind as listed.

    High-entropy spans that consist of words, as identifiers do, are no secrets.

    Positions are code points, ends exclusive. Spans of the base patterns stay
    whatever the allow-list says; those of one kind do not overlap, those of
    different kinds may.
    """
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= SHORTEST_VALUE:
                found.append(("assign", m.start(), m.end(), m.start(2)))
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST_ACCESS]
    found += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    for begin, end in _candidates(text):
        candidate = text[begin:end]
        if any(allowed.fullmatch(candidate) for allowed in ALLOWED):
            continue
        places: dict[str, list[tuple[int, int]]] = {}
        for known in CLASSES:
            for run in known.run.finditer(candidate):
                for first, last in entropy_spans(run[0], known.width, known.bits):
                    places.setdefault(known.kind, []).append((run.start() + first, run.start() + last))
        for kind, spans in places.items():
            for first, last in _joined_spans(spans):
                span = candidate[first:last]
                if not any(allowed.fullmatch(span) for allowed in ALLOWED) and not (kind != "entropy_hex" and is_wordy(span)):
                    found.append((kind, begin + first, begin + last, begin + first))
    order = {kind: at for at, kind in enumerate(dict.fromkeys((*BASE_KINDS, *(known.kind for known in CLASSES))))}
    return sorted(found, key=lambda span: (span[1], order[span[0]], span[2]))


def masked(text: str, spans: list[tuple[str, int, int, int]], mask: str = MASK) -> str:
    """``text`` with the secret part of every span replaced, overlapping ones once."""
    parts, done = [], 0
    for begin, end in sorted((span[3], span[2]) for span in spans):
        if end <= done:
            continue
        if begin >= done:
            parts += [text[done:begin], mask]
        done = end
    return "".join([*parts, text[done:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,secret:bigint>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.int64())])
)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans``. A null text has none; repeated rows are scanned repeatedly; other columns do not matter."""
    chosen = pick(docs, doc_id=key, text=text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans = [
                    [dict(zip(("kind", "start", "end", "secret"), span, strict=True)) for span in find_secrets(value)]
                    for value in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(spans, _ARROW_SPANS)], ["doc_id", "spans"]
                )

    return chosen.mapInArrow(scan, f"doc_id {dict(chosen.dtypes)['doc_id']}, spans {_SPANS}")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked, and the column ``length`` of changed texts set anew."""
    lengths = length if length in docs.columns else None
    columns = docs.columns
    # By place, as column names may repeat those of other columns in another case.
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at_text = columns.index(text)
    at_length = columns.index(lengths) if lengths else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = part.column(at_text).to_pylist()
                spans = [find_secrets(value) for value in values]
                arrays = list(part.columns)
                if any(spans):
                    new = [masked(v, s, mask) if s else v for v, s in zip(values, spans, strict=True)]
                    arrays[at_text] = pa.array(new, part.schema.field(at_text).type)
                    if at_length is not None:
                        old = part.column(at_length).to_pylist()
                        sizes = [len(v) if s else n for v, s, n in zip(new, spans, old, strict=True)]
                        arrays[at_length] = pa.array(sizes, part.schema.field(at_length).type)
                yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in renamed.schema])
    return renamed.mapInArrow(clean, schema).toDF(*columns)


def _joined(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def base_digest(spans: list[tuple[str, int, int, int]]) -> str:
    """The digest of the base spans, as the query derives it."""
    text = ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans if kind in BASE_KINDS)
    return hashlib.sha256(text.encode()).hexdigest()
