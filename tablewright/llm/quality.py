"""Quality rules: compression bands, with a few countable base rules.

A text is compressed with zstandard as a whole and in fixed chunks.  Repetitive
text compresses to far less than prose of its length, random text (keys, encoded
data) to far more.  Encoded text of few characters (hex, digits) compresses well
for that reason alone, so the density, the ratio in bits against the entropy of the
text's bytes, is rated apart.

The limits come from the table itself: from the ratios and densities of all its
texts that pass the base rules, by length, and of all their chunks.  A length class is
a quarter of a doubling.  To its texts come ``PRIOR`` made-up ones that stand for the fixed limits
``BANDS`` (chunks: ``CHUNK_BAND``): spread evenly, so that their quartiles belong to these limits, for
densities at twice the ratios (8 bits to 4 bits of entropy).
So there is one rule for every size: a class without texts has the fixed limits, and the more texts
it has the more they decide.  With the quartiles q1 and q3 of a class, ratios must lie
within q1 - ``FENCE`` * (q3 - q1) and q3 + ``FENCE`` * (q3 - q1), densities below the
upper one of these; q3 - q1 counts as ``LEAST_SPREAD`` at least.  The quartiles are
those of a histogram in steps of 1/``STEPS``, so they do not depend on the order or
the partitions of the rows, and hold as long as under a quarter of a class is junk
on one side.

Null text is an empty text: no words, so it fails the base rules.  Repeated rows
are judged each for itself; other columns are passed on.  A very long text is measured whole, by
the task that holds it; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import byte_lengths, free_name, quoted, slices, struct_array, word_ids, words_of

# (texts of at most this many bytes, smallest ratio, largest ratio) of compressed to plain bytes;
# a fourth number is the largest density
BANDS = ((128, 0.60, 9.0), (256, 0.42, 1.05), (512, 0.40, 0.90), (1024, 0.40, 0.82), (2048, 0.38, 0.74),
         (4096, 0.37, 0.68), (8192, 0.35, 0.64), (65536, 0.32, 0.62), (1 << 62, 0.25, 0.60))
CHUNK_BYTES = 4096
CHUNK_BAND = (0.30, 0.66)
CHUNK_SHARE = 0.25  # of chunks that may lie outside the band
CLASSES = 4  # of length, for each doubling
PRIOR = 16  # texts that the fixed limits count as, spread evenly over PARTS places
PARTS = 64
FENCE = 2.5
LEAST_SPREAD = 0.005
STEPS = 4096
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, ratio double, bad_chunks double, kept boolean")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def ratio(packer, data: bytes) -> float:
    return len(packer.compress(data)) / len(data) if data else 1.0


def density(packed: float, data: bytes) -> float:
    """``packed`` (a ratio) in bits a byte, against the entropy of the bytes of ``data``."""
    counts = np.bincount(np.frombuffer(data, np.uint8))
    share = counts[counts > 0] / max(len(data), 1)
    entropy = float(-(share * np.log2(share)).sum())
    return 8 * packed / entropy if entropy > 0 else 0.0


def within(packed: float, data: bytes, low: float, high: float, dense: float = math.inf) -> bool:
    return low <= packed <= high and (dense == math.inf or density(packed, data) <= dense)


def chunks_of(data: bytes, chunk: int) -> list[bytes]:
    """Chunks of full size that cover the text: the last one ends with it and may overlap the
    one before.  A text shorter than a chunk has none, it is rated as a whole."""
    starts = list(range(0, len(data) - chunk + 1, chunk))
    if starts and starts[-1] + chunk < len(data):
        starts.append(len(data) - chunk)
    return [data[i:i + chunk] for i in starts]


def compression(packer, data: bytes, bands=BANDS, chunk=CHUNK_BYTES, chunk_band=CHUNK_BAND, share=CHUNK_SHARE):
    """(ratio of the whole, share of chunks outside their band, verdict)."""
    whole = ratio(packer, data)
    band = next(limits for most, *limits in bands if len(data) <= most)
    parts = chunks_of(data, chunk)
    bad = sum(not within(ratio(packer, part), part, *chunk_band) for part in parts) / len(parts) if parts else 0.0
    return whole, bad, within(whole, data, *band) and bad <= share


def length_class(n_bytes: int) -> int:
    return math.floor(CLASSES * math.log2(n_bytes))


_CHUNKS = -1  # in place of a length class


def _points(packer, data: bytes, chunk: int) -> list[tuple[int, int, int]]:
    """(length class, ratio, density) of a text and of its chunks, the last two in steps."""
    out = []
    for kind, part in [(length_class(len(data)), data), *[(_CHUNKS, x) for x in chunks_of(data, chunk)]]:
        packed = ratio(packer, part)
        out.append((kind, int(packed * STEPS), int(density(packed, part) * STEPS)))
    return out


def quartiles(counts: dict[int, float]) -> tuple[int, int]:
    order, total = sorted(counts), sum(counts.values())
    upto = np.cumsum([counts[k] for k in order])
    return tuple(order[int(np.searchsorted(upto, part * total))] for part in (0.25, 0.75))


def fences(counts: dict[int, float]) -> tuple[float, float]:
    """Limits of a measure counted in steps: the rule stands above."""
    first, third = (q / STEPS for q in quartiles(counts))
    reach = FENCE * max(third - first, LEAST_SPREAD)
    return first - reach, third + 1 / STEPS + reach


def prior(low: float, high: float) -> tuple[Counter, Counter]:
    """What ``PRIOR`` texts with these limits would count: (ratios, densities)."""
    spread = (high - low) / (1 + 2 * FENCE)  # between the quartiles
    first = low + (FENCE - 0.5) * spread
    at = [first + 2 * spread * (i + 0.5) / PARTS for i in range(PARTS)]
    return tuple(Counter({int(by * x * STEPS): PRIOR / PARTS for x in at}) for by in (1, 2))


def limits_from(rows) -> dict:
    """``bands`` and ``chunk_band`` from (measure, length class, step, count) rows,
    measure 0 the ratio and 1 the density."""
    held: dict[int, tuple[Counter, Counter]] = {}
    for measure_, kind, step, n in rows:
        held.setdefault(kind, (Counter(), Counter()))[measure_][step] += n
    both = prior(*CHUNK_BAND)
    for all_, own in zip(both, held.pop(_CHUNKS, (Counter(), Counter()))):
        all_.update(own)
    out = {"chunk_band": (*fences(both[0]), fences(both[1])[1])}
    bands = []
    for kind in sorted(held):
        most = math.ceil(2 ** ((kind + 1) / CLASSES)) - 1
        both = prior(*next(limits for longest, *limits in BANDS if most <= longest))
        for all_, own in zip(both, held[kind]):
            all_.update(own)
        bands.append((most, *fences(both[0]), fences(both[1])[1]))
    if bands:  # the last holds for all that are longer
        bands[-1] = (1 << 62, *bands[-1][1:])
    return out | {"bands": tuple(bands) or BANDS}


def limits_of(docs: DataFrame, text: str = "text", chunk: int = CHUNK_BYTES) -> dict:
    """The limits of a table, by one aggregate over all its texts; the driver gets a
    histogram of at most a row per class and step."""
    @F.arrow_udf("array<struct<kind: int, ratio: int, density: int>>")
    def points(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        row = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "ratio", "density")]))
        out = [pa.array([], row)]
        for _, part in slices(texts):
            failed = base_rules(part)["base_failed"].to_pylist()
            out.append(pa.array([[] if bad else [dict(zip(("kind", "ratio", "density"), p)) for p in _points(packer, t.encode(), chunk)]
                                 for t, bad in zip(part.to_pylist(), failed)], row))
        return pa.concat_arrays(out)

    each = docs.select(F.explode(points.asNondeterministic()(quoted(text))).alias("p")).select("p.*")
    steps = each.select("kind", F.posexplode(F.array("ratio", "density")).alias("measure", "step"))
    return limits_from(steps.groupBy("measure", "kind", "step").count().collect())


def repeat_words(ids: np.ndarray, width: int) -> int:
    """Words inside three-word windows that occur at least twice in the text.
    ``width``: more than any id; up to 2^31, so any text that fits a task."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * width + ids[1:-1]
    if width >= 1 << 21:  # three ids no longer fit 63 bits, the number of a pair and an id do
        pairs = np.unique(pairs, return_inverse=True)[1]
    code = pairs * width + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(ids), bool)
    for at in (order[1:][same], order[:-1][same]):
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def base_rules(part: pa.Array) -> dict[str, pa.Array]:
    """The countable columns of ``SCHEMA`` for a slice of texts."""
    starts, words = words_of(part)
    ids, distinct = word_ids(words)
    n_words = np.diff(starts)
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
    data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset:part.offset + len(part) + 1]
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data[ends[0]:ends[-1]]])])
    repeats = np.array([repeat_words(ids[a:b], len(distinct)) for a, b in zip(starts[:-1], starts[1:])], np.int64)
    return {
        "n_words": pa.array(n_words, pa.int64()), "word_chars": pa.array(np.diff(chars[starts]), pa.int64()),
        "n_symbols": pa.array(np.diff(marks[ends - ends[0]]), pa.int64()),
        "n_dup_lines": pa.array([dup_lines(t.as_py()) for t in part], pa.int64()),
        "n_repeat_words": pa.array(repeats, pa.int64()),
        "base_failed": pa.array((n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)),
    }


def measure(texts: pa.Array, **limits) -> pa.Array:
    """The columns of ``SCHEMA`` for a column of texts."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    parts = []
    for _, part in slices(texts):
        base = base_rules(part)
        packed = [compression(packer, t.encode(), **limits) for t in part.to_pylist()]
        parts.append(struct_array(base | {
            "ratio": pa.array([p[0] for p in packed], pa.float64()),
            "bad_chunks": pa.array([p[1] for p in packed], pa.float64()),
            "kept": pa.array([bool(p[2] and not f) for p, f in zip(packed, base["base_failed"].to_pylist())]),
        }))
    return pa.concat_arrays(parts) if parts else pa.array([], _struct_type())


def _struct_type():
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.struct([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def with_quality(docs: DataFrame, text: str = "text", out: str = "quality", **limits) -> tuple[DataFrame, str]:
    """``docs`` with a struct of the columns in ``SCHEMA``, and the struct's name
    (``out``, or the next free name).  ``limits``: bands, chunk, chunk_band, share;
    the bands not given are derived from all rows of ``docs``, which reads them once."""
    if "bands" not in limits or "chunk_band" not in limits:
        limits = limits_of(docs, text, limits.get("chunk", CHUNK_BYTES)) | limits

    @F.arrow_udf(SCHEMA)
    def judge(texts: pa.Array) -> pa.Array:
        return measure(texts, **limits)

    out = free_name(docs, out)
    return docs.withColumn(out, judge.asNondeterministic()(quoted(text))), out


def kept_documents(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows whose text passes, with their columns."""
    judged, name = with_quality(docs, text, **limits)
    return judged.filter(quoted(name).kept).select(*[quoted(c) for c in docs.columns])
