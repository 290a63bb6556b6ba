"""Periodic runs and token counts."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import periods, queries, tokens

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs

def brute_runs(words, least=6, power=4):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def changed(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def op12_row(doc_id, text):
    words = changed(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *top, top[1] * 1000 // top[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts_with_runs(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{draw.randrange(draw.choice([1, 2, 3, 40]))}" for _ in range(draw.randint(0, 160))]
        while words and draw.random() < 0.7:
            a, p = draw.randrange(len(words)), draw.randint(1, max(1, len(words) // 5))
            for i in range(a, min(len(words), a + draw.randint(p, 9 * p))):
                words[i] = words[a + (i - a) % p]
        out.append(draw.choice([" ", "\n", " \t"]).join(words))
    return out


def op12(rows, spark, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("x")).withColumn("a", F.lit(1))
    monkeypatch.setattr(queries, "table", lambda *_: docs.repartition(3))
    got = queries.QUERIES["op12_periodic_runs"](spark, "").drop("n_words")
    return Counter(tuple(r) for r in got.collect())


def test_runs_against_brute_force(spark, monkeypatch):
    rows = [(i if i % 41 else None, t) for i, t in enumerate(texts_with_runs(3, 250))]
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "a"), (-5, "a " * 5), (-6, "a " * 6), (-7, "a b " * 4), (-8, "a b " * 3 + "a b x"),
             (-9, "é " * 7 + "a b a b"), *[(-10, "x y z " * 20)] * 4]
    assert op12(rows, spark, monkeypatch) == Counter(op12_row(*r) for r in rows)


def test_runs_of_long_texts(spark, monkeypatch):
    """Tiles of all octaves: a period of hundreds of words, and one word thousands of times."""
    draw = random.Random(9)
    period = [f"v{draw.randrange(500)}" for _ in range(900)]
    rows = [(2, " ".join(["head"] * 3 + period * 6 + period[:77])), (3, "same " * 30_000), (4, " ".join(f"u{draw.randrange(5000)}" for _ in range(20_000)))]
    got = {r[0]: r for r in op12(rows, spark, monkeypatch)}
    assert (3, 5477, 900) in brute_runs(rows[0][1].split())
    assert got[2] == op12_row(*rows[0])
    assert got[3][:6] == (3, 1, 0, 30_000, 1, 30_000_000) and got[3][7] == sha("same")
    assert got[4][1] == len(brute_runs(rows[2][1].split()[:400])) == 0


def test_runs_of_an_empty_table_and_of_too_low_a_power(spark, monkeypatch):
    assert not op12([], spark, monkeypatch)
    with pytest.raises(ValueError):
        periods.runs(spark.createDataFrame([], "doc_id bigint, text string"), power=3)
    docs = spark.createDataFrame([("x", "a b " * 9), ("y", "a b c")], "doc_id string, text string")
    assert [tuple(r) for r in periods.runs(docs).collect()] == [("x", 0, 18, 2)]


def test_slices_and_portions_do_not_matter(monkeypatch):
    ids = np.array([1, 2, 3] * 9 + [5] * 11 + list(range(40)))
    listed = lambda found: [(*t[1:-1], t[-1].tolist()) for t in found]
    whole = listed(periods.tiles(ids, np.array([0, len(ids)])))
    monkeypatch.setattr(periods, "COMPARED", 1)
    assert whole == listed(periods.tiles(ids, np.array([0, len(ids)])))
    # the same text after another one
    assert whole == listed(t for t in periods.tiles(np.concatenate([ids, ids]), np.array([0, len(ids), 2 * len(ids)])) if t[0] == 1)


def test_tiles_of_any_size_give_the_same_runs(monkeypatch):
    for n, text in enumerate(texts_with_runs(17, 150)):
        words = text.split()
        ids = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, np.int64)
        for size, short in ((1, 0), (16, 16), (512, 2)):
            monkeypatch.setattr(periods, "TILE_WORDS", size)
            monkeypatch.setattr(periods, "SHORT", short)
            places: dict = {}
            for _, *facts, tile in periods.tiles(ids, np.array([0, len(ids)])):
                for q, lo, hi in periods.fragments(*facts, tile.tolist()):
                    places.setdefault(q, set()).update(range(lo, hi))
            for s, length, q in brute_runs(words):
                assert set(range(s, s + length - q)) <= places[q], (n, size)
            assert all(words[i] == words[i + q] for q in places for i in places[q])


@needs_tables
def test_op12_of_the_documents(spark):
    got = Counter(tuple(r)[:-1] for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == Counter(op12_row(*r) for r in docs)


# token counts

def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)


def odd_texts():
    draw = random.Random(4)
    mixed = ["".join(draw.choices("aab<|endoftext|> \n\t'sréx1中🙂\u0085 ", k=draw.randint(0, 80))) + draw.choice(["", "<|endoftext|>", "<|endoftext|><|endoftext|> x"])
             for _ in range(3000)]
    return mixed + ["a" * n for n in range(80)] + ["aaab" * 300, " " * 500 + "x", "<|endoftext|>", "don't WE'LL 'S", "\u0000\u001c ​"]


def test_tokens_as_the_library_counts_them():
    texts = odd_texts()
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert tokens.Counter(tokens.Merges(VOCABULARY)).count(texts).tolist() == want


def test_every_character(monkeypatch):
    texts = [f"a{chr(i)}{chr(i)} b{chr(i)}1 {chr(i)}" for i in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F800)]]
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    counter = tokens.Counter(tokens.Merges(VOCABULARY))
    monkeypatch.setattr(tokens, "CACHED", 100)  # forgets now and then
    assert counter.count(texts).tolist() == want


def test_long_texts_in_portions(monkeypatch):
    draw = random.Random(8)
    texts = ["x" * 5000, " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(3000)) + "<|endoftext|>" + "\n " * 700, "", "a b"]
    counter = tokens.Counter(tokens.Merges(VOCABULARY))
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want
    monkeypatch.setattr(tokens, "LONG", 50)
    monkeypatch.setattr(tokens, "PORTION", 7)
    assert tokens.Counter(counter.merges).count(texts).tolist() == want


def test_token_counts_of_tables(spark, monkeypatch):
    texts = [None, "", *odd_texts()[::40], "word " * 1024, "word " * 1023, "x"]
    rows = [(i if i % 9 else None, t, "n") for i, t in enumerate(texts)] + [(1, "twice", "n")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)
    counted, name = tokens.with_token_counts(docs, VOCABULARY)
    assert counted.columns == ["doc_id", "text", "n_tokens", name] and name != "n_tokens"
    encode = library().encode
    want = Counter((i, t, "n", len(encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert Counter(map(tuple, counted.collect())) == want
    assert tokens.with_token_counts(docs.limit(0), VOCABULARY)[0].count() == 0
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = Counter(map(tuple, queries.QUERIES["op13_token_counts"](spark, "").collect()))
    assert got == Counter((i, len((t or "").encode()), n, n > 1024) for i, t, _, n in want.elements())


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.Merges(public_tokenizers.path("word_bpe_49k.json"))


@needs_tables
def test_op13_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    encode = library().encode_batch
    want = {i: len(e.ids) for (i, _), e in zip(docs, encode([t or "" for _, t in docs], add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op13_token_counts"](spark, SF).collect()} == want
