"""Periodic runs of words: stretches that repeat with a period, found tile by tile.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
equal), of at least ``max(LEAST, POWER * q)`` words, which no neighbouring word extends.
The places whose word equals the one q further on form an interval of at least
``(POWER - 1) * q`` places; runs are found by these intervals:

1. *Tiles.*  For every octave of periods [s, 2s) a text is cut at every s-th word.  What
   is looked at around a cut are s words before it and 4s after it.  Cuts that can't belong
   to a run are left out: in a run the s words after a cut stand once more at a distance
   within the octave, and so do those after the cut before or the cut behind (rolling hashes;
   they only leave out, they decide nothing); and where 3s words have a period below s, none
   of the octave is the smallest (checked for periods up to ``SHORT``).  A tile holds up to
   ``TILE_WORDS`` words of cuts in succession, or four cuts, and overlaps the next.
2. *Fragments.*  Each tile is solved alone, after a shuffle that deals tiles evenly: the
   Z-function of the words after a cut gives how far they agree with those q further
   on, that of the words before it read backwards how far back.  Where the q words after the
   cut are a shorter piece repeated, q is not the smallest period and nothing is passed on.
3. *Stitching.*  Fragments are shuffled by text and period, and those that overlap are
   joined.  A stretch that also has a smaller period has it from end to end, so of equal
   stretches of a text the least period stays.

An interval of 3q places or more holds at least two cuts whose s words agree, any two of
its fragments in succession overlap, and the outer ones reach its ends, so nothing is lost.

Words are runs of anything but ASCII white space; equal words are told by their number in
the text, not by a hash.  Only texts that have tiles are stored beside them and joined with
their runs; the others are read again and need nothing of other tasks.  Null and empty texts have no words and no runs.  Long texts are cut
like short ones; only tiles that may belong to a run travel.  Equal rows get equal results, ties are resolved
as stated, an empty table gives an empty table, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.session import stage

from .common import mix64, quoted, slices, word_ids, words_of

LEAST = 6   # words of a run, at least
POWER = 4   # times that a run's period fits into it, at least (3 and more are found)
HELD_ROWS, HELD_BYTES = 1 << 14, 4 << 20  # rows held before they are passed on
COMPARED = 1 << 20  # hashes compared at a time
SHORT = 16          # periods up to which higher octaves are left out
TILE_WORDS = 512    # words of a tile's cuts

TASK_BYTES = 4 << 20  # of tiles for one task

# a tile, or, where step is 0, a text that has tiles
TILE = "seed bigint, a bigint, b bigint, step bigint, cut bigint, n_cuts bigint, before bigint, words binary"
FRAGMENT = "a bigint, b bigint, period bigint, lo bigint, hi bigint"

_ODD = 0x9E3779B97F4A7C15 | 1


def doubled(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` words from those of every ``width // 2``."""
    half = width // 2
    with np.errstate(over="ignore"):
        return codes[:-half] * np.uint64(pow(_ODD, half, 1 << 64)) + codes[half:]


def cuts(codes: np.ndarray, starts: np.ndarray, step: int, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The cuts of one octave whose tiles may belong to a run, and the text of each.
    ``codes``: rolling hashes of ``step`` words, of all texts in a row."""
    words = np.diff(starts)
    number = np.where(words >= max(least, power * step), words // step - 1, 0)  # a cut has two steps after it
    text = np.repeat(np.arange(len(words)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    at = starts[text] + step * nth
    matched = np.zeros(len(at), bool)
    codes = np.concatenate([codes, np.zeros(2 * step, np.uint64)])
    rows = max(COMPARED // step, 2)
    for lo in range(0, len(at), rows):
        # the cut before and the one behind may agree at the same distance
        part = at[max(lo - 1, 0):lo + rows + 1]
        same = codes[part[:, None] + np.arange(step, 2 * step)] == codes[part][:, None]
        near = np.zeros_like(same)
        near[1:] |= same[:-1]
        near[:-1] |= same[1:]
        hit = (same & near).any(axis=1)
        matched[lo:lo + rows] = hit[min(lo, 1):][:rows]
    return at[matched], text[matched]


def reach_at(ids: np.ndarray, period: int) -> np.ndarray:
    """For each place the end of the stretch from there on that has the period."""
    n = len(ids)
    if period >= n:
        return np.arange(n) + 1
    differs = np.where(ids[:-period] != ids[period:], np.arange(n - period), n - period)
    first = np.minimum.accumulate(differs[::-1])[::-1]
    return np.concatenate([first + period, np.full(period, n)])


def tiles(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, power: int = POWER) -> Iterator[tuple]:
    """(text, step, first cut, number of cuts, words before the first cut, words) of all
    tiles that may belong to a run.  ``ids``: the words of all texts in a row, text i from
    ``starts[i]`` on."""
    if not len(ids):
        return
    # words of different texts are never equal
    own = ids + np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * (int(ids.max()) + 1)
    codes = mix64(own)
    step, longest, reach = 1, int(np.diff(starts).max()), np.zeros(len(ids), np.int64)
    while power * step <= longest:
        cut, text = cuts(codes, starts, step, least, power)
        below = reach[cut] >= np.minimum(cut + 3 * step, starts[text + 1])
        cut, text = cut[~below], text[~below]
        if len(cut):
            most = max(TILE_WORDS // step, 4)
            opens = np.concatenate([[True], (np.diff(cut) != step) | (np.diff(text) != 0)])
            place = np.arange(len(cut))
            place -= np.maximum.accumulate(np.where(opens, place, 0))
            heads = np.flatnonzero(place % most == 0)
            for head, end in zip(heads.tolist(), [*heads[1:].tolist(), len(cut)]):
                t, at, last = int(text[head]), int(cut[head]), int(cut[end - 1])
                begin = int(starts[t])
                first = max(at - step, begin)
                yield t, step, at - begin, end - head, at - first, ids[first:min(last + 4 * step, int(starts[t + 1]))]
        for period in range(step, min(2 * step, SHORT + 1)):
            reach = np.maximum(reach, reach_at(own, period))
        step *= 2
        codes = doubled(codes, step)


def z_function(s: list) -> list[int]:
    """How many of its first elements each suffix begins with."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def around(step: int, before: int, words: list) -> Iterator[tuple[int, int, int]]:
    """(period, back, ahead): how many words before the cut and from it on equal those a
    period further on, for the periods of the octave that hold for ``step`` words."""
    ahead = words[before:]
    forward = z_function(ahead)
    found = [q for q in range(step, min(2 * step, len(ahead))) if forward[q] >= step]
    if not found:
        return
    pieces = [d for d in range(1, step) if forward[d] >= step - d]
    # the words before the cut, read backwards, then the two steps after it, read backwards
    near = ahead[:2 * step]
    back = z_function(words[:before][::-1] + [-1] + near[::-1])
    for q in found:
        if not any(q % d == 0 and forward[d] >= q - d for d in pieces):
            yield q, back[before + 1 + len(near) - q], forward[q]


def fragments(step: int, cut: int, n_cuts: int, before: int, words: list) -> list[tuple[int, int, int]]:
    """(period, lo, hi): the places lo <= i < hi around the cuts of a tile whose word
    equals the one a period further on; those of successive cuts that meet are one."""
    out, last = [], {}
    for j in range(n_cuts):
        at = before + j * step
        first = max(at - step, 0)
        for q, back, ahead in around(step, at - first, words[first:at + 4 * step]):
            lo, hi = cut + j * step - back, cut + j * step + ahead
            if q in last and lo <= out[last[q]][2]:
                out[last[q]] = (q, out[last[q]][1], max(hi, out[last[q]][2]))
            else:
                last[q] = len(out)
                out.append((q, lo, hi))
    return out


def numbered(texts: pa.Array, change, seeds: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Slice by slice: (its first text, where each text's words begin, the place whose
    word each word is, all words)."""
    for first, part in slices(texts):
        starts, words = words_of(part)
        place = np.concatenate([np.zeros(0, np.int64), *[
            lo + change(int(hi - lo), seeds[first + i].as_py()) for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:]))]])
        yield first, starts, place, words


def _schema(fields: str, **others: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([*others.items(), *[(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], (bytes, str)) else 0
        if len(held) >= HELD_ROWS or size >= HELD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def as_it_is(n: int, seed) -> np.ndarray:
    """Every place holds its own word."""
    return np.arange(n)


def _exploded(docs: DataFrame, change, least: int, power: int) -> DataFrame:
    """The tiles of all texts, and the texts that have any, as a stored table."""
    if power < 4:
        raise ValueError("Runs of fewer than four periods are not found.")

    def explode(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield from _batches(rows(batch, packer), _schema(TILE, doc=batch.schema.field("doc").type))

    def rows(batch, packer):
        doc, seed, a, b = (batch[n] for n in ("doc", "seed", "a", "b"))
        for first, starts, place, words in numbered(batch["text"], change, seed):
            last = -1
            for t, *facts, tile in sorted(tiles(word_ids(words)[0][place], starts, least, power), key=lambda x: x[0]):
                keys = seed[first + t].as_py(), a[first + t].as_py(), b[first + t].as_py()
                if t != last:
                    last = t
                    yield doc[first + t].as_py(), *keys, 0, 0, 0, 0, packer.compress(batch["text"][first + t].as_py().encode())
                yield None, *keys, *facts, tile.astype(np.int32).tobytes()

    kind = docs.schema["doc"].dataType.simpleString()
    return stage(docs.mapInArrow(explode, f"doc {kind}, {TILE}"), "period-tiles")


def _stitched(held: DataFrame, least: int, power: int) -> DataFrame:
    def solve(batches):
        def rows():
            for batch in batches:
                for a, b, *facts, words in zip(*batch.columns):
                    for found in fragments(*(x.as_py() for x in facts), np.frombuffer(words.as_py(), np.int32).tolist()):
                        yield a.as_py(), b.as_py(), *found
        yield from _batches(rows(), _schema(FRAGMENT))

    tiled = held.filter("step > 0").select("a", "b", "step", "cut", "n_cuts", "before", "words")
    size = tiled.agg(F.sum(F.octet_length("words").cast("bigint"))).first()[0] or 0
    dealt = tiled.repartition(max(1, -(-size // TASK_BYTES)), "a", "b", "step", "cut")
    # repeated rows give equal fragments, which merge before the shuffle
    each = stage(dealt.mapInArrow(solve, FRAGMENT).distinct(), "period-fragments")
    order = Window.partitionBy("a", "b", "period").orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("opens", (reach.isNull() | (F.col("lo") > reach)).cast("int"))
    each = each.withColumn("interval", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = each.groupBy("a", "b", "period", "interval").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") + F.col("period") - F.col("start")
    whole = whole.withColumn("length", length).filter(F.col("length") >= F.greatest(F.lit(least), F.lit(power) * F.col("period")))
    return whole.groupBy("a", "b", "start", "length").agg(F.min("period").alias("period"))


def _keyed(docs: DataFrame, key: str, text: str, seed) -> DataFrame:
    """Rows of equal keys a and b are equal."""
    seed = F.lit(None) if seed is None else seed
    docs = docs.select(quoted(key).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text"), seed.cast("bigint").alias("seed"))
    return docs.withColumn("a", F.xxhash64("doc", "seed")).withColumn("b", F.xxhash64("text", "doc", "seed"))


def kept_places(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: of every run (start, length, period) its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:-1] == 0


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exponent; of equals that of the least start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


RESULT = ("n_words bigint, runs array<struct<start: bigint, period: bigint, length: bigint>>, "
          "top struct<start: bigint, length: bigint, period: bigint>, collapsed string")


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", seed=None, change=as_it_is,
              least: int = LEAST, power: int = POWER) -> DataFrame:
    """Per row of ``docs``: its key; ``n_words``; ``runs``, by start, then period (null
    without runs); ``top``, the run of the greatest exponent (ties: the least start, then
    period; null without runs); ``collapsed``, the words joined by one space without those
    that a run contains after its first period.  ``change`` gives, for a number of words and
    the row's ``seed``, the place whose word stands at each place (as a rule the place itself)."""
    docs = _keyed(docs, key, text, seed)
    held = _exploded(docs, change, least, power)
    found = _stitched(held, least, power)
    found = stage(found.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "period-runs")
    triple = lambda *names: pa.struct([(n, pa.int64()) for n in names])
    result = [("n_words", pa.int64()), ("runs", pa.list_(triple("start", "period", "length"))),
              ("top", triple("start", "length", "period")), ("collapsed", pa.string())]

    def without(batches):
        """Texts that have no tiles: nothing repeats."""
        for batch in batches:
            for first, starts, place, words in numbered(batch["text"], change, batch["seed"]):
                tiled = {t for t, *_ in tiles(word_ids(words)[0][place], starts, least, power)}
                rest = pa.array([t for t in range(len(starts) - 1) if t not in tiled], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.take(pa.array(place)))
                n = len(rest)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"].slice(first, len(starts) - 1).take(rest), pa.array(np.diff(starts), pa.int64()).take(rest),
                     *[pa.nulls(n, k) for _, k in result[1:3]], pc.binary_join(lists.take(rest), " ")],
                    names=["doc", *[name for name, _ in result]])

    def collapse(batches):
        unzip = zstandard.ZstdDecompressor()

        def rows(batch):
            for doc, seed, data, given in zip(*batch.columns):
                starts, words = words_of(pa.array([unzip.decompress(data.as_py()).decode()]))
                runs = [(r["start"], r["length"], r["period"]) for r in given.as_py() or ()]
                kept = change(len(words), seed.as_py())[kept_places(len(words), runs)]
                top = dict(zip(("start", "length", "period"), best(runs))) if runs else None
                yield doc.as_py(), len(words), given.as_py(), top, " ".join(words.take(pa.array(kept)).to_pylist())

        for batch in batches:
            yield from _batches(rows(batch), pa.schema([("doc", batch.schema.field("doc").type), *result]))

    schema = f"doc {docs.schema['doc'].dataType.simpleString()}, {RESULT}"
    tiled = held.filter("step = 0").select("doc", "seed", "a", "b", "words").join(found, ["a", "b"], "left")
    alone = docs.select("doc", "text", "seed").mapInArrow(without, schema)
    return alone.unionAll(tiled.select("doc", "seed", "words", "runs").mapInArrow(collapse, schema)).withColumnRenamed("doc", key)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """(key, start, length, period) of all runs, a row each."""
    found = with_runs(docs, key, text, least=least, power=power)
    return found.select(key, F.explode("runs").alias("run")).select(key, "run.start", "run.length", "run.period")
