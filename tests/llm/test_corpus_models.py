"""Byte-level BPE, whitening and the filter audit against brute force."""

import base64
import hashlib
import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import audit, bpe, whitening


# Byte-level BPE.


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(bpe.vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(2)
    runs = ["a" * 3000, " " * 1500 + "x", "\n" * 900, "ab" * 800, "=-" * 500, "0123456789" * 99, "aaa" * 301 + "b"]
    mixed = ["".join(rng.choice("etaoinshrdlu") for _ in range(900)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400))]
    marks = ["", " ", "<|endoftext|>", "it's  'll  done \n\n", "\x00\x1c\x85​ é", "👩‍👩‍👧 🇫🇷", "I'M we'RE \r\n\tx"]
    anything = ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(32, 127)))) for _ in range(80)) for _ in range(60)]
    return [*runs, *mixed, *marks, *anything]


def test_encoding_equals_the_library(spark, library):
    texts = [*hard_texts(), "plain words " * 200]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no key", "x"), (3, texts[3], "x"), (900, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, TEXT string").repartition(3)
    encoded = bpe.encode_documents(docs)
    found = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert found == Counter((key, tuple(library.encode_ordinary(text or ""))) for key, text, _ in rows)
    decoded = Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode_documents(encoded).collect())
    assert decoded == Counter((key, (text or "").encode()) for key, text, _ in rows)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_every_character_is_cut_alike(library):
    codec = bpe.codec(bpe.vocabulary(), bpe.word_pattern())
    rng = random.Random(6)
    marks = [chr(i) for i in range(0x3000)] + [chr(i) for i in rng.sample([*range(0x3000, 0xD800), *range(0xE000, 0x110000)], 3000)]
    texts = ["".join(f"a{c}1 {c}{c} x" for c in marks[i : i + 500]) for i in range(0, len(marks), 500)]
    assert codec.encode(texts).to_pylist() == [library.encode_ordinary(t) for t in texts]


def brute_force(word, ranks):
    """The definition: the leftmost pair of minimum rank, until there is none."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        low = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if low[0] == math.inf:
            break
        parts[low[1] : low[1] + 2] = [parts[low[1]] + parts[low[1] + 1]]
    return [ranks[p] for p in parts]


def test_any_vocabulary(tmp_path, monkeypatch):
    """Vocabularies whose ranks no training would give: inverted ones make some merges depend on their order."""
    rng = random.Random(11)
    for seed in range(12):
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 6))).encode() for _ in range(rng.randint(3, 25))}
        order = [bytes([i]) for i in range(256)] + sorted(tokens, key=lambda t: rng.random())
        ranks = {t: i for i, t in enumerate(order)}
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["a" * 50]
        for long_word in (64, 0):
            monkeypatch.setattr(bpe, "LONG_WORD", long_word)
            codec = bpe.Codec(str(path), ".+")
            assert codec.encode(words).to_pylist() == [brute_force(w.encode(), ranks) for w in words]


def test_memory_of_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 40)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 50)
    codec = bpe.Codec(bpe.vocabulary(), bpe.word_pattern())
    rng = random.Random(3)
    for _ in range(12):
        texts = [" ".join(f"w{rng.randint(0, 60)}xyz" for _ in range(30)) for _ in range(3)]
        assert codec.encode(texts).to_pylist() == [library.encode_ordinary(t) for t in texts]
        assert len(codec.index) < 140


def test_unknown_ids_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1, 999_999])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="Unknown token id"):
        bpe.decode_documents(rows).collect()
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [bytes(r.bytes) for r in bpe.decode_documents(rows).collect()] == [b"", b""]


def test_query_columns(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_byte_bpe(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for key, text in texts.items():
        ids = library.encode_ordinary(text)
        assert found.pop(key) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
    assert not found


# Whitening.


def expected_whitening(vectors, components=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums).astype(float)) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitening(rows, keys, vectors):
    n, deviation, z, explained = expected_whitening(vectors)
    width = z.shape[1]
    # Repeated rows come in any order: compare them by their deviation.
    found = sorted(((r.component, r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in rows))
    order = sorted(range(n), key=lambda i: (keys[i] is None, keys[i] or 0, int(deviation[i])))
    assert len(found) == n * width and {r.n for r in rows} == {n}
    assert [f[3] for f in found] == [int(deviation[i]) for i in order] * width
    got = np.array([f[4] for f in found]).reshape(width, n).T
    signs = np.sign((got * z[order]).sum(axis=0))
    assert np.abs(got - z[order] * signs).max() < 1e-9
    assert np.allclose(sorted({(r.component, r.explained) for r in rows}), list(enumerate(explained, 1)), rtol=1e-9)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_equals_brute_force(spark, monkeypatch):
    """Nulls, holes, infinities, repeated and nameless rows, a shared offset far larger than the spread, many cells."""
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(12, 12)) * np.linspace(0.2, 2, 12)
    vectors = [(rng.normal(size=12) @ spread + 900).tolist() for _ in range(700)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(3, vectors[3], "x"), (3, vectors[3], "x"), (None, vectors[9], "x")]
    bad = [(800, None, "x"), (801, [None, *vectors[0][1:]], "x"), (802, [math.nan, *vectors[0][1:]], "x"), (803, [math.inf, *vectors[0][1:]], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, EMBEDDING string").repartition(5)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "CELL_BLOCKS", 3)
    for entries in (16 * 12, 1 << 16):
        monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
        check_whitening(whitening.whiten(df).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_given_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check_whitening(whitening.op12_embedding_whitening(spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_without_spread(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == []
    one = make([(1, [0.5, 1.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = make([(i, [float(i), 2.0 * i, 7.0]) for i in range(40)])  # one direction has all spread
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert abs(next(r.explained for r in line) - 1) < 1e-12 and next(r.identity_error for r in line) < 1e-9
    with pytest.raises(Exception, match="differ in length"):
        make([(1, [1.0]), (2, [1.0, 2.0])])


def test_large_entries_are_exact(spark):
    vectors = [[3e9 + i, -2e9 * i] for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")).collect()
    x = [[int(1024 * c) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((5 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert {r.vec_id: r.deviation for r in found} == {i: e if e < 1 << 63 else None for i, e in enumerate(exact)}


# Filter audit.


def test_shapley_weights_solve_the_game():
    """The weights are those of marginal contributions over all orders."""
    rng = random.Random(1)
    for n in (1, 2, 3, 5):
        value = [0, *(rng.randint(-9, 99) for _ in range((1 << n) - 1))]
        expected = [0] * n
        for order in itertools.permutations(range(n)):
            before = 0
            for i in order:
                expected[i] += value[before | 1 << i] - value[before]
                before |= 1 << i
        found = [sum(w * v for w, v in zip(row, value, strict=True)) for row in audit.shapley_weights(n)]
        assert found == expected and Fraction(sum(found), math.factorial(n)) == value[-1]


def simulated_audit(docs, labels):
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    parts = {}
    for key, text, lang in docs:
        text = text or ""
        words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": key is not None and key > first[text],
        }
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, key in good, key in toxic))
    found = []
    for part, rows in parts.items():
        removed_by = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                failing = sum(letter in r[0] for r in rows)
                unique = sum(r[0] == {letter} for r in rows)
                removed_by[letter] += len(gone)
                steps.append([part, "".join(order), step, letter, len(left), len(gone), failing - len(gone), unique,
                              sum(r[1] for r in gone), sum(r[2] for r in gone)])
        found += [(*s, removed_by[s[3]]) for s in steps]
    return Counter(found)


def test_audit_equals_simulation(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abXé") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \n", "one", "UPPER CASE", "a#b"]
    texts += [" ".join(word() for _ in range(rng.choice((30, 199, 200, 260)))) + rng.choice(("", " 5% off", "\x0bx")) for _ in range(30)]
    texts += ["ab cd " * 150, "long " * 40_000, "x y " * 200]
    docs = [(i, rng.choice(texts), rng.choice(("en", "fr", "", None))) for i in range(300)]
    docs += [docs[7], docs[7], (docs[7][0], "other text", "en"), (docs[7][0], docs[7][1], "zz")]
    docs += [(None, rng.choice(texts), "en") for _ in range(20)]
    labels = [(rng.randrange(320), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(150)] + [(None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, lang string, LANG int").repartition(4)
    m = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    columns = "part filter_order step filter kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    found = audit.interactions(audit.failure_counts(d, m))
    assert found.columns == columns
    assert Counter(tuple(r) for r in found.collect()) == simulated_audit(docs, labels)
    assert audit.interactions(audit.failure_counts(d.limit(0), m)).count() == 0
    assert audit.interactions(audit.failure_counts(d, m.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_copies_shrink_in_the_map_tasks(spark):
    """A hot text and rows without a key are spread: the digest shuffle gets few rows of them."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "the same words again").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("en").alias("lang"),
    )
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    counts = {r["mask"]: r.n for r in audit.failure_counts(rows, marks).groupBy("mask").agg(F.sum("n").alias("n")).collect()}
    assert counts == {1: 4001, 17: 1999}
