"""Helpers shared by the text operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SLICE_BYTES = 1 << 19


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores, so that no column has the name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_strings(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of at most ``most`` bytes each; a longer text comes alone.
    Bounds the memory of a task whatever the length of the texts."""
    texts = as_strings(texts)
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of all texts in order, and where each text's words begin (one more
    entry than texts).  Words are runs of anything but ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return seen[offsets], flat.filter(full)


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as its place in the list of distinct words, and that list."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Shipped:
    """A value broadcast to the executors, loaded once in each task."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return {"held": self.held}

    def get(self):
        if "loaded" not in self.__dict__:
            self.loaded = pickle.loads(self.held.value)
        return self.loaded


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def struct_array(columns: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    held = _powers.get("up")
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's words begin, with one more entry; 64-bit hash of every
    word; index of every word's first byte in its text).  A word's hash depends on
    its bytes only."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    blank = _BLANK[data]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = mix64((sums[last] - sums[first]) * down[first])
    starts = np.searchsorted(first, edges)
    return starts, hashes, first - edges[np.repeat(np.arange(len(texts)), np.diff(starts))]
