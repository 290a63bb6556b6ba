"""Repeated passages: every byte covered by a 400-byte string that also starts
anywhere else, found by refining buckets of suffixes.

Suffixes are bucketed by a q-gram and buckets are refined by what stands at later
offsets, until a bucket holds equal strings of the full length or a single suffix.
Two things keep this to a few rows for each kilobyte of text:

- Only anchors are bucketed at first.  The anchor of a 400-byte string is the
  place of the least hash among its first places, so equal strings have their
  anchors at equal offsets.  An anchor stands for the run of strings that share it.
- A bucket is refined for a run of strings at once.  If two anchors agree over the
  whole stretch that a run covers, all its strings repeat; if no two agree on the
  core that its strings share, none does.  Only runs in between, at the edges of
  repeated passages, are cut into shorter runs, whose buckets refine those before,
  and in the end into single strings.

Bucket identifiers are 64-bit hashes of the bytes (with the bucket refined, so at
least 128 bits tell strings apart).  Counts merge before the shuffle, and joins
are on stored tables, so passages that a third of all texts share are split.

Texts are UTF-8 bytes; null text is an empty one.  Matches never cross texts.
Repeated rows repeat each other: all their strings of full length are removed.
Texts shorter than the length keep all.  An empty table gives an empty table.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablewright.session import stage

from .common import as_strings, mix64, slices

LENGTH = 400
GRAM = 100      # bytes of the first bucket
STEP = 25       # strings in a shorter run

REF = ["a", "b", "at"]


def least_places(data: np.ndarray, width: int) -> np.ndarray:
    """For every start, the place of the least 8-gram hash among ``width`` places,
    the first of equals."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    x = mix64(x) >> np.uint64(32) << np.uint64(32) | np.arange(len(x), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[:len(x) - (width - size)], x[width - size:])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(texts: pa.Array, length: int = LENGTH, gram: int = GRAM):
    """(text, anchor, first string, last string, data, base) for runs of strings with
    one anchor; places count from the text's start, data[base:] is the text."""
    for first, part in slices(texts):
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset:part.offset + len(part) + 1].astype(np.int64)
        data, ends = data[ends[0]:ends[-1]], ends - ends[0]
        if len(data) < length:
            continue
        place = least_places(data, length - gram + 1)[:len(data) - length + 1]
        text = np.repeat(np.arange(len(part)), np.diff(ends))[:len(place)]
        valid = np.arange(len(place)) + length <= ends[text + 1]
        start = np.flatnonzero(valid & np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1]]))
        stop = np.flatnonzero(valid & np.concatenate([(place[1:] != place[:-1]) | ~valid[1:], [True]]))
        raw = data.tobytes()
        for t, p, lo, hi in zip(text[start].tolist(), place[start].tolist(), start.tolist(), stop.tolist()):
            yield first + t, p, lo, hi, raw, int(ends[t])


def packed(p: int, far: int, near: int) -> int:
    """Anchor place, and the largest and smallest distance of a string's start before it."""
    return p << 20 | far << 10 | near


def unpacked(at: int) -> tuple[int, int, int]:
    return at >> 20, at >> 10 & 1023, at & 1023


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ROWS, BYTES = 1 << 16, 4 << 20  # what a task holds before it passes it on


class Sink:
    """Rows on their way out of a task, passed on in batches of bounded size."""

    def __init__(self, schema: str):
        kinds = {"bigint": pa.int64(), "binary": pa.binary()}
        self.names, self.types = zip(*[(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int = 0):
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= ROWS or self.size >= BYTES:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(self.names)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=list(self.names))


def _each(batch: pa.RecordBatch, *names: str):
    """The rows one by one: only one row's texts are Python objects at a time."""
    columns = [batch[n] for n in names]
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in columns]


BUCKET, KEYED = "k bigint", "k bigint, u bigint, a bigint, b bigint, at bigint"
CONTEXT = "k bigint, n bigint, a bigint, b bigint, at bigint, text binary"
RUN = "a bigint, b bigint, at bigint, n bigint, run bigint, core bigint, whole bigint"
STRING = "a bigint, b bigint, at bigint, n bigint, d bigint, own bigint"


def _buckets(length, gram, refs):
    """Rows k, u (and a, b, at if ``refs``) of all anchors: bucket of the anchor's
    q-gram, and of the stretch that its run covers."""
    def run(batches):
        digest, out = xxhash.xxh3_64_intdigest, Sink(KEYED if refs else BUCKET)
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            for t, p, lo, hi, raw, base in anchors(batch["text"], length, gram):
                k = signed(digest(raw[p:p + gram]))
                if refs:
                    u = signed(digest(raw[lo:hi + length], p - lo))
                    yield from out.add((k, u, a[t], b[t], packed(p - base, p - lo, p - hi)))
                else:
                    yield from out.add((k,))
        yield out.batch()
    return run


def _contexts(length):
    """Rows k, n, a, b, at, text: the stretch of each wanted anchor."""
    def run(batches):
        unzip, out = zstandard.ZstdDecompressor(), Sink(CONTEXT)
        for batch in batches:
            for a, b, data, wanted in _each(batch, "a", "b", "data", "wanted"):
                raw = unzip.decompress(data)
                for w in wanted:
                    p, far, near = unpacked(w["at"])
                    around = raw[p - far:p - near + length]
                    yield from out.add((w["k"], w["n"], a, b, w["at"], around), len(around))
        yield out.batch()
    return run


def _shorter_runs(length, step):
    """Rows a, b, at, n, run, core, whole: buckets of the runs of ``step`` distances."""
    def run(batches):
        digest, out = xxhash.xxh3_64_intdigest, Sink(RUN)
        for batch in batches:
            for k, n, a, b, at, text in _each(batch, "k", "n", "a", "b", "at", "text"):
                _, far, near = unpacked(at)
                salt = k.to_bytes(8, "little", signed=True)
                for c in range(near // step, far // step + 1):
                    # text[0] is the place ``far`` before the anchor
                    begin, end = max(step * c, near), min(step * c + step - 1, far)
                    core = text[far - step * c:far - step * c - step + 1 + length]
                    whole = text[far - end:far - begin + length]
                    yield from out.add((a, b, at, n, c, signed(digest(salt + core, c)),
                                        signed(digest(salt + whole, c << 20 | begin << 10 | end))))
        yield out.batch()
    return run


def _strings(length, step):
    """Rows a, b, at, n, d, own: the bucket of every single string of the wanted runs."""
    def run(batches):
        digest, out = xxhash.xxh3_64_intdigest, Sink(STRING)
        for batch in batches:
            for k, n, a, b, at, text, runs in _each(batch, "k", "n", "a", "b", "at", "text", "runs"):
                _, far, near = unpacked(at)
                salt = k.to_bytes(8, "little", signed=True)
                for c in runs:
                    for d in range(max(step * c, near), min(step * c + step - 1, far) + 1):
                        yield from out.add((a, b, at, n, d, signed(digest(salt + text[far - d:far - d + length], d))))
        yield out.batch()
    return run


def repeated(rows: DataFrame, bucket: str, weight=None) -> DataFrame:
    """Buckets that hold more than one suffix, as a stored table."""
    n = F.count("*") if weight is None else F.sum(weight)
    return stage(rows.groupBy(bucket).agg(n.alias("in_bucket")).filter("in_bucket > 1").select(bucket), f"repeats-{bucket}")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """a, b, lo, hi: stretches of repeated strings, by the keys of ``_keyed``."""
    texts = docs.select("a", "b", "text")
    shared = repeated(texts.mapInArrow(_buckets(length, gram, False), BUCKET), "k")
    found = texts.mapInArrow(_buckets(length, gram, True), KEYED)
    found = stage(found.join(shared, "k"), "repeats-anchors")
    groups = stage(found.groupBy("k", "u").agg(F.count("*").alias("n"), F.min(F.struct(*REF)).alias("ref")), "repeats-groups")
    again = stage(groups.filter("n > 1").select("k", "u"), "repeats-whole")
    place, far, near = F.shiftright("at", 20), F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    out = found.join(again, ["k", "u"]).select("a", "b", (place - far).alias("lo"), (place - near + length).alias("hi"))

    # buckets in which some run is alone with its stretch, but not with its q-gram
    open_ = groups.groupBy("k").agg(F.count("*").alias("groups"), F.min("n").alias("least")).filter("groups > 1 AND least = 1").select("k")
    wanted = groups.join(stage(open_, "repeats-open"), "k").select("k", "n", "ref.*")
    wanted = stage(wanted.groupBy("a", "b").agg(F.collect_list(F.struct("at", "k", "n")).alias("wanted")), "repeats-wanted")
    texts = docs.select("a", "b", _zipped("text").alias("data"))
    around = stage(texts.join(wanted, ["a", "b"]).mapInArrow(_contexts(length), CONTEXT), "repeats-contexts")
    runs = stage(around.mapInArrow(_shorter_runs(length, step), RUN), "repeats-runs")
    whole = repeated(runs, "whole", "n")
    runs = stage(runs.join(repeated(runs, "core", "n"), "core").join(whole.withColumn("done", F.lit(True)), "whole", "left"), "repeats-shorter")
    begin, end = F.greatest(F.col("run") * step, near), F.least(F.col("run") * step + step - 1, far)
    out = out.union(runs.filter("done AND n = 1").select("a", "b", (place - end).alias("lo"), (place - begin + length).alias("hi")))

    edges = stage(runs.filter("done IS NULL AND n = 1").select("core").distinct(), "repeats-edges")
    wanted = runs.join(edges, "core").groupBy(*REF).agg(F.collect_list("run").alias("runs"))
    single = around.join(stage(wanted, "repeats-single"), REF).mapInArrow(_strings(length, step), STRING)
    single = stage(single, "repeats-strings")
    single = single.filter("n = 1").join(repeated(single, "own", "n"), "own")
    return out.union(single.select("a", "b", (place - F.col("d")).alias("lo"), (place - F.col("d") + length).alias("hi")))


def _zipped(text: str):
    """The text as compressed bytes: less to shuffle."""
    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=3)
        return pa.array([packer.compress(t.as_py().encode()) for t in as_strings(texts)], pa.binary())

    return pack(text)


def merged(pairs) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept (the remaining bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("doc_id").alias("a"), F.xxhash64("text", "doc_id").alias("b"))
    found = spans(docs, length, gram, step)
    lists = stage(found.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "repeats-spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out, first = Sink("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"), 0
            for i, (data, pairs) in enumerate(_each(batch, "data", "spans")):
                raw = unzip.decompress(data)
                runs, kept, upto = merged((x["lo"], x["hi"]) for x in pairs or ()), [], 0
                for lo, hi in runs:
                    kept.append(raw[upto:lo])
                    upto = hi
                row = (len(raw), sum(hi - lo for lo, hi in runs), len(runs), b"".join(kept) + raw[upto:])
                for part in out.add(row, len(row[3])):
                    yield with_ids(batch["doc_id"].slice(first, i + 1 - first), part)
                    first = i + 1
            yield with_ids(batch["doc_id"].slice(first), out.batch())

    def with_ids(ids, part):
        return pa.RecordBatch.from_arrays([ids, *part.columns], names=["doc_id", *part.schema.names])

    zipped = docs.select("doc_id", "a", "b", _zipped("text").alias("data"))
    return (zipped.join(lists, ["a", "b"], "left").select("doc_id", "data", "spans")
            .mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


