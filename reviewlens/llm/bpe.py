"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

Spark deals the documents to tasks; a task holds the merge table in a DuckDB
database of its own process. There every word is a set of rows (word, position,
token). A recursive query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of minimum rank, until no word has a pair left.
Decoding joins ids with the token table and aggregates their bytes in order.
Nothing is shared between tasks, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import base64
import functools
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import pick, table

#: Bytes of text that a task encodes, and tokens that it decodes at once (one document at least).
TEXT_BYTES, TOKENS = 4 << 20, 1 << 19
#: Bytes of new words that one recursive query encodes (one word at least), and of a long word.
QUERY_BYTES, LONG_WORD = 1 << 18, 64
#: Distinct words and tokens that a task remembers; beyond, those that it met once are forgotten.
WORDS_KEPT, TOKENS_KEPT = 300_000, 4_000_000

#: Rounds of whole words: the tokens of all words that were not finished before, with one pair per word contracted.
#: Word and position are one number, so that a single sort brings neighbours together.
ENCODE = """
with recursive state(place, id, step) as (
  select (word::bigint << 32) | pos, id, 0 from portion
  union all
  (with live as (
     select place, id, step, lead(id) over places as next_id, lead(place) over places as next_place,
       lag(place) over places as last_place
     from state window places as (order by place)),
   lowest as (
     select v.place >> 32 as word, min((m.id::bigint << 32) | (v.place & 4294967295)) as best
     from live v join merges m on m.pair = (v.id::bigint << 32) | v.next_id
     where v.place >> 32 = v.next_place >> 32 group by v.place >> 32),
   chosen as (select word, (best >> 32)::int as id, (word << 32) | (best & 4294967295) as place from lowest)
   select v.place, case when v.place = c.place then c.id else v.id end, step + 1
   from live v join chosen c on c.word = v.place >> 32 where v.last_place is distinct from c.place)
),
ends as (select place >> 32 as word, max(step) as step from state group by place >> 32)
select e.word, list(s.id order by s.place) as ids
from state s join ends e on e.word = s.place >> 32 and e.step = s.step group by e.word order by e.word
"""
#: The same for long words, which need many rounds: these change rows in place, and where the order of contractions
#: does not matter ("calm", see _merges), all pairs of the word's minimum rank that do not overlap go in one round.
ENCODE_LONG = """
with recursive state(word, pos, id) using key (word, pos) as (
  select word, pos, id from portion
  union all
  (with live as (
     select word, pos, id, lead(pos) over places as next_pos, lead(id) over places as next_id, row_number() over places as place
     from recurring.state where id >= 0 and word in (select word from state)
     window places as (partition by word order by pos)),
   pairs as (
     select v.word, v.pos, v.next_pos, v.place, m.id, m.calm, min(m.id) over (partition by v.word) as least
     from live v join merges m on m.pair = (v.id::bigint << 32) | v.next_id),
   lowest as (
     select word, pos, next_pos, id, bool_and(calm) over (partition by word) as calm,
       row_number() over (partition by word order by pos) as nth,
       place - row_number() over (partition by word order by pos) as run
     from pairs where id = least),
   chosen as (
     select word, pos, next_pos, id, calm, nth, row_number() over (partition by word, run order by pos) as in_run from lowest
     qualify nth = 1 or (calm and in_run % 2 = 1))
   select word, pos, id from chosen union all select word, next_pos, -1 from chosen)
)
select word, list(id order by pos) as ids from state where id >= 0 group by word order by word
"""

#: Bytes are held as characters of the same number, since only text can be aggregated in order.
DECODE = """
select p.doc, coalesce(string_agg(t.bytes, '' order by p.place), '') as bytes
from portion p join tokens t on t.id = p.id group by p.doc order by p.doc
"""


def _merges(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of tokens whose bytes together are a token: pair (the left one times 2^32 plus the right one), id, calm.

    A merge is calm if its token can't at once be part of another pair of the
    same or a lower rank. For a token x before it such a pair x + (l r) exists
    only where x + l was a pair of higher rank or none, as otherwise that would
    have been contracted first; a token after it likewise.
    """
    pairs: dict[tuple[int, int], int] = {}
    splits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left = ranks.get(token[:k])
            right = ranks.get(token[k:]) if left is not None else None
            if right is not None:
                pairs[left, right] = rank
                splits[rank].append((left, right))
    stirred = set()
    for (left, right), rank in pairs.items():
        for l, r in splits[right] if rank <= right else ():  # noqa: E741
            if pairs.get((left, l), right) >= right:
                stirred.add((l, r))
        for l, r in splits[left] if rank <= left else ():  # noqa: E741
            if pairs.get((r, right), left + 1) > left:
                stirred.add((l, r))
    return pa.table({
        "pair": pa.array([left << 32 | right for left, right in pairs], pa.int64()), "id": pa.array(pairs.values(), pa.int32()),
        "calm": pa.array([pair not in stirred for pair in pairs], pa.bool_()),
    })


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts that hold ``most`` in sum, or one item."""
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start, before = stop, ends[stop - 1]


class Codec:
    """A vocabulary of ranks in a DuckDB database, with the words a task has encoded so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("The vocabulary has to hold every byte.")
        spill = os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": spill})
        self.loaded: set[str] = set()
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self._keep(np.zeros(0, np.int64))

    def _need(self, name: str) -> None:
        """Load the merge table or the token table where a task first uses it."""
        if name in self.loaded:
            return
        if name == "merges":
            rows = _merges(self.ranks)
        else:
            names = [token.decode("latin-1") for token in self.ranks]
            rows = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": names})
        self.connection.register("incoming", rows)
        self.connection.execute(f"create table {name} as select * from incoming")
        self.connection.unregister("incoming")
        self.loaded.add(name)

    def _keep(self, places: np.ndarray) -> None:
        """Remember only the words at these places."""
        words = list(self.index) if len(places) else []
        sizes = np.diff(self.starts)[places]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.starts = np.append(0, ends)
        self.index = defaultdict(None, zip((words[place] for place in places), range(len(places)), strict=True))
        self.index.default_factory = self.index.__len__
        self.uses = np.zeros(len(places), np.int64)

    def _query(self, query: str, **portion) -> pa.Table:
        self.connection.register("portion", pa.table(portion))
        try:
            return self.connection.sql(query).to_arrow_table()
        finally:
            self.connection.unregister("portion")

    def _contract(self, words: list[bytes], query: str) -> pa.ListArray:
        self._need("merges")
        sizes = np.array([len(word) for word in words], np.int64)
        number = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        return self._query(query, word=number, pos=place.astype(np.int32), id=first).column("ids").combine_chunks()

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words; one that is a token as a whole is that token."""
        known = np.array([self.ranks.get(word, -1) for word in words], np.int32)
        sizes = np.array([len(word) for word in words], np.int64)
        lengths, parts = np.ones(len(words), np.int64), []
        for query, rest in ((ENCODE, sizes <= LONG_WORD), (ENCODE_LONG, sizes > LONG_WORD)):
            rest = np.flatnonzero((known < 0) & rest)
            for start, stop in _cuts(sizes[rest], QUERY_BYTES):
                chosen = rest[start:stop]
                found = self._contract([words[i] for i in chosen], query)
                lengths[chosen] = pc.list_value_length(found).to_numpy()
                parts.append((chosen, found.flatten().to_numpy()))
        starts = np.append(0, np.cumsum(lengths))
        ids = np.empty(starts[-1], np.int32)
        ids[starts[:-1]] = known
        for chosen, found in parts:
            size = lengths[chosen]
            ids[np.repeat(starts[chosen] - np.cumsum(size) + size, size) + np.arange(len(found))] = found
        self.starts = np.append(self.starts, self.starts[-1] + starts[1:])
        self.ids = np.append(self.ids, ids)
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of every text."""
        if len(self.index) > WORDS_KEPT or len(self.ids) > TOKENS_KEPT:
            often = np.flatnonzero(self.uses > 1)
            fits = len(often) <= WORDS_KEPT // 2 and np.diff(self.starts)[often].sum() <= TOKENS_KEPT // 2
            self._keep(often if fits else often[:0])
        before, number = len(self.index), self.index.__getitem__
        rows = []
        for text in texts:
            words = self.find(text)
            rows.append(np.fromiter(map(number, words), np.int32, len(words)))
        if len(self.index) > before:
            self._learn([word.encode() for word in islice(self.index, before, None)])
        words = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.uses += np.bincount(words, minlength=len(self.uses))
        sizes = np.diff(self.starts)[words]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[words] - ends + sizes, sizes) + np.arange(sizes.sum())]
        ends = np.append(0, ends)[np.cumsum([0, *map(len, rows)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of every list of ids; an id that is no token is an error."""
        self._need("tokens")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ids = lists.flatten()
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if ids.null_count or (len(ids) and not pc.all(pc.is_in(ids, pa.array(self.ranks.values(), pa.int32()))).as_py()):
            raise ValueError("Unknown token id.")
        found = self._query(DECODE, doc=doc, place=np.arange(len(doc), dtype=np.int32), id=ids)
        whole = [b""] * len(sizes)
        for row, value in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True):
            whole[row] = value.encode("latin-1")
        return pa.array(whole, pa.binary())


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _portions(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    for start, stop in _cuts(pc.fill_null(sizes, 0).to_numpy(), most):
        yield batch.slice(start, stop - start)


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Token ids of whole texts: ``(doc_id, ids array<int>)``, one row per row.

    ``path`` is a vocabulary of base64 tokens with ranks that holds all 256
    bytes, ``pattern`` cuts texts into words. A null text is an empty one and has
    no ids. Keys are carried along: nulls, ties and repeated rows are rows like
    others. Texts of any length are encoded whole.
    """
    path, pattern = path or vocabulary(), pattern or word_pattern()
    chosen = pick(docs, doc_id=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, pc.binary_length(batch.column("text")), TEXT_BYTES):
                ids = codec(path, pattern).encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, ids array<int>")


def decode_documents(
    encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``(doc_id, ids, bytes)`` of lists of token ids; no or null ids are no bytes, an unknown id is an error."""
    path, pattern = path or vocabulary(), pattern or word_pattern()
    chosen = pick(encoded, doc_id=key, ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, pc.list_value_length(batch.column("ids")), TOKENS):
                whole = codec(path, pattern).decode(part.column("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, whole], ["doc_id", "ids", "bytes"])

    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, ids array<int>, bytes binary")


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_documents(encode_documents(table(spark, sf, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
