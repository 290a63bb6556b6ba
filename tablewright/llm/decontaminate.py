"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of normalized words.  An item is leaked
where some window of a text is within ``1 - similarity`` of the item's length in
word edits.  A random walk embeds the words of a window of the item's size: at
step t it writes the word it stands on and moves on by a random bit of (t, word).
Two sequences at a small edit distance walk together again soon, so their
embeddings agree at most places; sampling a few places gives a key that they
share with a probability that is measured on edited items.  The walk is repeated
with new random bits until an item edited to the limit is found with probability
``recall``; leaks with fewer edits, and windows beside the best one, add to that.
Every candidate is verified by its exact edit distance.

Windows that hold too few of the benchmark's word pairs for any item of their
size to be within the limit (the q-gram lemma) are not embedded: no leak is lost.

The benchmark is a stated query set: it is used in blocks of at most ``BLOCK``
words, each held by every task, and the texts are scanned once for each block.

Null texts and items are empty; an empty item is nowhere.  Items so short that the limit
allows no edit (under five words at 0.8) are found where they stand word for word; ``min_words``
leaves shorter ones out, on request.  Items of equal text, and items repeated under one id, give each
their rows.  Very long texts are searched whole, in slices of windows.  Empty tables give none.
"""

from __future__ import annotations

import functools
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Shipped, free_name, mix64, quoted, slices

SIMILARITY = 0.8
RECALL = 0.99
MIN_WORDS = 1
BLOCK = 200_000    # words of the benchmark in a block
SAMPLES = 3        # places in a key
TRIALS = 300       # edited items per band of lengths, to measure the walk
PAIR_BITS = 1 << 24
WINDOWS = 1 << 15  # embedded at once
PAD = np.uint64(0x5BD1E995)
_DROP = (string.punctuation).encode()


def normal(text: str) -> bytes:
    """Lower case, without ASCII punctuation."""
    return text.lower().encode().translate(None, _DROP)


def words_in(text: str | None) -> list[bytes]:
    return normal(text or "").split()


def word_hash(word: bytes) -> int:
    return zlib.crc32(word) << 32 | zlib.adler32(word)


def closest_prefix(item, window) -> tuple[int, int]:
    """(fewest word edits between the item and a prefix of the window, its length)."""
    row = np.arange(len(window) + 1)
    for i, x in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (window != x))])
        # insertions: new[j] = min over j' <= j of new[j'] + j - j'
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    size = int(row.argmin())
    return int(row[size]), size


def walk(windows: np.ndarray, seed: int, places: np.ndarray, known: list[np.ndarray] | None = None):
    """(rows, keys): the embedding's words at ``places`` (rising), hashed.
    ``windows``: word hashes, a row each, ``PAD`` behind the last.  ``known``:
    sorted keys after each place; rows whose key is not among them are given up."""
    rows = np.arange(len(windows))
    width = windows.shape[1]
    flat = windows.reshape(-1)
    at = rows * width
    end = at + width - 1
    key = np.full(len(rows), np.uint64(seed))
    step = 0
    for n, place in enumerate(places):
        while True:
            here = flat[at]
            if step == place:
                break
            at = _moved(here, at, end, seed, step)
            step += 1
        key = mix64(key ^ here)
        if known is not None:
            stay = _among(known[n], key)
            rows, at, end, key = rows[stay], at[stay], end[stay], key[stay]
    return rows, key


def _moved(here, at, end, seed, step):
    bits = (here ^ np.uint64((seed * 1_000_003 + step) * 0x9E3779B1 & (1 << 63) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.minimum(at + (bits >> np.uint64(61) & np.uint64(1)).astype(np.int64), end)


def _among(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(key):
        return np.zeros(0, bool)
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


def edited(item: np.ndarray, edits: int, draw) -> np.ndarray:
    """The item with that many word edits, as the window of its size at its start."""
    out = item.tolist()
    for _ in range(edits):
        kind, at = draw.integers(3), draw.integers(max(1, len(out)))
        new = int(draw.integers(1 << 62))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif out:
            del out[at]
    more = len(item) - len(out)
    return np.array((out + draw.integers(1 << 62, size=max(0, more)).tolist())[:len(item)], np.uint64)


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(rows), width), PAD)
    for i, r in enumerate(rows):
        out[i, :min(len(r), width)] = r[:width]
    return out


class Band:
    """Items of about one length, with the walks that find them."""

    def __init__(self, group: list[tuple[int, np.ndarray]], similarity: float, recall: float, seed: int):
        self.group = group
        sizes = [len(ids) for _, ids in group]
        self.short, self.long = min(sizes), max(sizes)
        self.similarity = similarity
        self.wide = self.long + self.limit(self.long)

    def limit(self, words: int) -> int:
        return int((1 - self.similarity) * words + 1e-9)

    def learn(self, hashes: np.ndarray, recall: float, seed: int) -> None:
        """Add walks until items edited to the limit are found with probability ``recall``."""
        draw = np.random.default_rng(seed)
        source = [hashes[ids] for _, ids in self.group]
        trial = [source[i % len(source)] for i in range(TRIALS)]
        width = self.wide
        whole = padded(trial, width)
        other = padded([edited(t, self.limit(len(t)), draw) for t in trial], width)
        items = padded(source, width)
        missed = np.ones(TRIALS, bool)
        self.walks = []
        reach = max(SAMPLES, int(1.6 * self.short))  # the walk is still inside the shortest item
        while missed.mean() > 1 - recall:
            places = np.sort(draw.choice(reach, SAMPLES, replace=False))
            number = len(self.walks) + 1
            missed &= walk(whole, number, places)[1] != walk(other, number, places)[1]
            known = [np.unique(walk(items, number, places[:n + 1])[1]) for n in range(SAMPLES)]
            owners: dict[int, list[int]] = {}
            for g, key in enumerate(walk(items, number, places)[1].tolist()):
                owners.setdefault(key, []).append(g)
            self.walks.append((number, places, known, owners))

    def candidates(self, windows: np.ndarray) -> set[tuple[int, int]]:
        """(window, item's place in the group) that share a key."""
        out = set()
        for number, places, known, owners in self.walks:
            rows, keys = walk(windows, number, places, known)
            for row, key in zip(rows.tolist(), keys.tolist()):
                out.update((row, g) for g in owners[key])
        return out


class Index:
    """A block of items by bands of length.  ``items``: (number, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float, recall: float, seed: int = 1):
        self.vocabulary = sorted({w for _, ws in items for w in ws})
        self.hashes = np.array([0, *[word_hash(w) for w in self.vocabulary]], np.uint64)
        number = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.width = len(self.vocabulary) + 1
        self.pairs, self.repeats = np.zeros(PAIR_BITS, bool), 1
        coded = sorted(((item, np.array([number[w] for w in ws])) for item, ws in items), key=lambda x: (len(x[1]), x[0]))
        self.bands: list[Band] = []
        group: list = []
        for item, ids in coded:
            codes = ids[:-1] * self.width + ids[1:]
            self.pairs[self._place(codes)] = True
            run = 1
            for x, y in zip(codes[:-1], codes[1:]):
                run = run + 1 if x == y else 1
                self.repeats = max(self.repeats, run)
            if group and len(ids) > 1.25 * len(group[0][1]):
                self.bands.append(Band(group, similarity, recall, seed))
                group = []
            group.append((item, ids))
        if group:
            self.bands.append(Band(group, similarity, recall, seed))
        for n, band in enumerate(self.bands):
            band.learn(self.hashes, recall, seed * 1000 + n)

    @staticmethod
    def _place(codes: np.ndarray) -> np.ndarray:
        return (mix64(codes) % np.uint64(PAIR_BITS)).astype(np.int64)

    def windows(self, ids: np.ndarray, ends: np.ndarray):
        """(band, starts) of the windows with enough of the benchmark's word pairs.
        ``ids``: words of many texts, 0 for words no item has; ``ends``: where the
        text of each word ends."""
        inset = np.zeros(len(ids) + 1, np.int32)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (ends[:-1] == ends[1:]))
        codes = ids[both] * self.width + ids[both + 1]
        # a run of one pair counts as often as any item repeats it
        run = np.ones(len(both), bool)
        for back in range(1, self.repeats + 1):
            run[back:] &= (codes[back:] == codes[:-back]) & (both[back:] - both[:-back] == back)
            run[:back] = False
        inset[both + 1] = self.pairs[self._place(codes)] & ~run
        counts = np.cumsum(inset)  # pairs that begin before a word
        for band in self.bands:
            shortest = band.short - band.limit(band.short)
            least = min(m - 1 - 2 * band.limit(m) for m in range(band.short, band.long + 1)) - self.repeats
            first = np.arange(max(0, len(ids) - shortest + 1))
            if band.limit(band.long) == 0:  # no edits, so the first word is an item's
                first = first[np.isin(ids[first], [item[0] for _, item in band.group])]
            held = counts[np.minimum(first + band.wide, len(ids)) - 1] - counts[first]
            first = first[held >= max(least, 0)]
            stop = np.minimum(first + band.wide, ends[first])
            held = counts[stop - 1] - counts[first]
            yield band, first[(held >= max(least, 0)) & (stop - first >= shortest)]

    def encode(self, texts: pa.Array):
        """(first text, starts of texts, ids, ends) of slices of the texts."""
        vocabulary = pa.array(self.vocabulary, pa.binary())
        for base, part in slices(texts):
            starts, words = _split(pa.array([normal(t) for t in part.to_pylist()], pa.binary()))
            ids = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            if len(ids):
                yield base, starts, ids, np.repeat(starts[1:], np.diff(starts))

    def search(self, texts: pa.Array):
        """Rows (text's place, item, first word, words, distance): of each text and
        item that leaks into it, the window with the fewest edits, then the first."""
        waiting: dict[int, list] = {}
        best: dict = {}
        for base, starts, ids, ends in self.encode(texts):
            for n, (band, first) in enumerate(self.windows(ids, ends)):
                if not len(first):
                    continue
                width = band.wide
                at = first[:, None] + np.arange(width)
                inside = at < ends[first][:, None]
                held = np.where(inside, ids[np.minimum(at, len(ids) - 1)], -1)
                text = np.searchsorted(starts, first, side="right") - 1
                waiting.setdefault(n, []).append((base + text, first - starts[text], held))
                if sum(len(x[0]) for x in waiting[n]) > WINDOWS:
                    self._settle(band, waiting.pop(n), best)
        for n, parts in waiting.items():
            self._settle(self.bands[n], parts, best)
        return [(text, item, *found[1:]) for (text, item), found in best.items() for found in [(None, found[1], found[2], found[0])]]

    def _settle(self, band: Band, parts, best: dict) -> None:
        text, first, held = (np.concatenate(x) for x in zip(*parts))
        hashes = self.hashes[np.maximum(held, 0)]
        # a word that no item has equals none
        strange = held == 0
        hashes[strange] = mix64(np.flatnonzero(strange.reshape(-1))) | np.uint64(1)
        hashes[held < 0] = PAD
        for row, g in sorted(band.candidates(hashes)):
            item, want = band.group[g]
            window = held[row, :len(want) + band.limit(len(want))]
            window = window[window >= 0]
            distance, size = closest_prefix(want, np.where(window == 0, -1, window))
            key = (int(text[row]), item)
            found = (distance, int(first[row]), size)
            if distance <= band.limit(len(want)) and (key not in best or found < best[key]):
                best[key] = found


def _split(texts: pa.Array):
    """Like ``words_of``, for bytes that need not be text after punctuation is cut."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return seen[offsets - offsets[0]], flat.filter(full)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block: int = BLOCK):
    """The benchmark as blocks of (id, text) rows of about ``block`` words each,
    fetched one at a time."""
    rows = benchmark.select(quoted(item_id).alias("item_id"), quoted(text).alias("text")).toLocalIterator()
    held, size = [], 0
    for row in rows:
        n = len(words_in(row.text))
        if held and size + n > block:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance: for every text and item that
    leaks into it, its closest window (in normalized words)."""
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first_word bigint, n_words bigint, distance bigint"
    texts = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"))
    found = None
    for rows in blocks_of(benchmark, item_id, item_text):
        split = [(i, words_in(t)) for i, (_, t) in enumerate(rows)]
        split = [(i, ws) for i, ws in split if len(ws) >= max(1, min_words)]
        if not split:
            continue
        kind_of_item = to_arrow_type(benchmark.schema[item_id].dataType)
        held = Shipped(docs.sparkSession, (Index(split, similarity, recall), pa.array([r[0] for r in rows], kind_of_item)))
        part = texts.mapInArrow(functools.partial(_search, held), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _search(held, batches):
    index, names = held.get()
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        rows = list(index.search(batch["text"]))
        columns = [[ids[r[0]] for r in rows], [names[r[1]].as_py() for r in rows], *[[r[i] for r in rows] for i in (2, 3, 4)]]
        types = [batch.schema.field("doc_id").type, names.type, pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["doc_id", "item_id", "first_word", "n_words", "distance"])


def with_leak(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", **options) -> tuple[DataFrame, str]:
    """``docs`` with the number of items that leak into each row's text; and the name."""
    out = free_name(docs, out)
    total = F.lit(0).cast("bigint")
    item_text = options.pop("item_text", "text")
    for rows in blocks_of(benchmark, options.pop("item_id", "item_id"), item_text):
        split = [(i, words_in(t)) for i, (_, t) in enumerate(rows)]
        split = [(i, ws) for i, ws in split if len(ws) >= max(1, options.get("min_words", MIN_WORDS))]
        if split:
            held = Shipped(docs.sparkSession, Index(split, options.get("similarity", SIMILARITY), options.get("recall", RECALL)))
            total = total + _counter(held)(quoted(text))
    return docs.withColumn(out, total), out


def _counter(held):
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        n = np.zeros(len(texts), np.int64)
        for row, *_ in held.get().search(texts):
            n[row] += 1
        return pa.array(n, pa.int64())

    return count.asNondeterministic()


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows into whose text no item leaks, with their columns."""
    counted, name = with_leak(docs, benchmark, text, **options)
    return counted.filter(quoted(name) == 0).select(*[quoted(c) for c in docs.columns])
