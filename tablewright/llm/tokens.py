"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging.

Texts are cut into pre-tokens.  The distinct ones of a batch are held as one ragged
numpy array of symbols, and in every round each sequence applies its pair of the
lowest rank, all sequences at once, until no pair of any sequence is in the list of
merges.  The symbols that survive are the tokens.  A pair that a merge creates has
a higher rank than the merge, so applying a pair at all its places in a sequence, from
the left and without overlaps, is what merging place by place gives.

Strings of added tokens (end of text) count one token each, as the library takes
them by default; no begin or end tokens are added and nothing is cut or padded.

Null and empty texts have no tokens.  Texts of any length are counted whole: pre-tokens
are passed on in portions of bounded number, and a pre-token of any length is one
sequence.  Equal rows get equal counts, there are no ties, an empty table gives an
empty table, and columns of the table are kept whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Shipped, free_name, quoted, slices

# Fixed value: how byte-level vocabularies of this kind cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NEVER = np.iinfo(np.int32).max
PORTION = 1 << 17  # pre-tokens held at a time
LONG = 1 << 20     # texts of more characters are cut piece by piece
CACHED = 1 << 18   # counts of pre-tokens that a task remembers
CACHED_CHARS = 48  # of at most this length


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 ones
    stand for themselves, the others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merges of a vocabulary: symbols of bytes, and rank and result of each pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, cut = held["model"], held["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                 and not held["normalizer"] and not model.get("ignore_merges") and not model.get("dropout"))
        added = held["added_tokens"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int32)
        for sign, byte in byte_symbols().items():
            self.of_byte[byte] = vocab[sign]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` if it is no merge."""
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32)
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER).astype(np.int32)


def surviving(symbols: np.ndarray, starts: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols left of each sequence ``symbols[starts[i]:starts[i + 1]]``; none is empty."""
    out = np.zeros(len(starts) - 1, np.int64)
    alive, lengths = np.arange(len(out)), np.diff(starts)
    last = starts[1:] - 1
    rank = np.full(len(symbols), NEVER, np.int32)
    rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
    rank[last] = NEVER  # a pair does not cross sequences
    while len(alive):
        first = np.cumsum(lengths) - lengths
        best = np.minimum.reduceat(rank, first)
        open_ = best != NEVER
        if not open_.all():
            out[alive[~open_]] = lengths[~open_]
            inside = np.repeat(open_, lengths)
            symbols, rank = symbols[inside], rank[inside]
            alive, lengths, best = alive[open_], lengths[open_], best[open_]
            if not len(alive):
                break
        hit = rank == np.repeat(best, lengths)
        # of places that overlap (a pair of equal symbols) every other one counts
        at = np.flatnonzero(hit)
        begins = np.concatenate([[True], np.diff(at) > 1])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        symbols[at] = merges.made[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        ends = np.cumsum(lengths)
        rank[at] = rank[at + 1]  # what stands after the merged pair, to be looked up anew
        seen = np.concatenate([[0], np.cumsum(keep)])
        symbols, rank, lengths = symbols[keep], rank[keep], np.diff(np.concatenate([[0], seen[ends]]))
        ends = np.cumsum(lengths)
        final = np.zeros(len(symbols), bool)
        final[ends - 1] = True
        changed = np.unique(np.concatenate([seen[at], np.maximum(seen[at] - 1, 0)]))
        changed = changed[~final[changed]]
        rank[changed] = merges.rank(symbols[changed], symbols[changed + 1])
        rank[final] = NEVER
    return out


def counts_of(pieces: pa.Array, merges: Merges) -> np.ndarray:
    """Tokens of each pre-token, none of them empty."""
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    starts = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    return surviving(merges.of_byte[data[starts[0]:starts[-1]]], starts - starts[0], merges)


class Counter:
    """Counts of texts; remembers those of short pre-tokens."""

    def __init__(self, merges: Merges):
        import regex

        self.merges, self.known = merges, {}
        self.cut = regex.compile(PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, merges.added))) if merges.added else None

    def portions(self, texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, int]], list[int]]]:
        """Pre-tokens of at most about ``PORTION`` at a time, (text, its last place
        among them + 1) in order, and the texts of which an added token was met."""
        pieces, upto, met = [], [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.added and self.added.search(text):
                parts = self.added.split(text)
                met += [i] * (len(parts) - 1)
            for part in parts:
                if len(part) <= LONG:
                    pieces += self.cut.findall(part)
                else:
                    each = (m.group() for m in self.cut.finditer(part))
                    while more := list(islice(each, PORTION)):
                        pieces += more
                        yield pieces, [*upto, (i, len(pieces))], []
                        pieces, upto = [], []
            upto.append((i, len(pieces)))
            if len(pieces) >= PORTION:
                yield pieces, upto, met
                pieces, upto, met = [], [], []
        yield pieces, upto, met

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for pieces, upto, met in self.portions(texts):
            if pieces:
                coded = pa.array(pieces, pa.large_string() if sum(map(len, pieces)) > 1 << 28 else pa.string()).dictionary_encode()
                n = self._distinct(coded.dictionary)[coded.indices.to_numpy()]
                total = np.concatenate([[0], np.cumsum(n)])
                who, ends = (np.array(x) for x in zip(*upto))
                np.add.at(out, who, np.diff(total[np.concatenate([[0], ends])]))
            np.add.at(out, met, 1)
        return out

    def _distinct(self, pieces: pa.Array) -> np.ndarray:
        names = pieces.to_pylist()
        out = np.array([self.known.get(p, 0) for p in names], np.int64)
        new = np.flatnonzero(out == 0)
        if len(new):
            out[new] = counts_of(pieces.take(pa.array(new)).cast(pa.string()), self.merges)
            if len(self.known) + len(new) > CACHED:
                self.known.clear()
            for i in new[:CACHED].tolist():
                if len(names[i]) <= CACHED_CHARS:
                    self.known[names[i]] = int(out[i])
        return out


def with_token_counts(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> tuple[DataFrame, str]:
    """``docs`` with the number of tokens of each text, and the column's name (``out``,
    or the next free name).  ``vocabulary``: the vocabulary's file, read by the driver;
    its merges, which have the size of the vocabulary, are sent to the tasks."""
    shipped = Shipped(docs.sparkSession, Merges(vocabulary))

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shipped.get())
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *[counter.count(part.to_pylist()) for _, part in slices(texts)]]))

    out = free_name(docs, out)
    return docs.withColumn(out, count.asNondeterministic()(quoted(text))), out
