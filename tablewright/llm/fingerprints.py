"""64-bit SimHash fingerprints of four-word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import as_strings

SHINGLE = 4
SEED = 42
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half the XXH64 hashes of the shingles, repeats
    included; 0 for a text without words."""
    data = b" ".join(text.encode().lower().split())  # both know ASCII only
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= shingle:
        return xxhash.xxh64_intdigest(data, SEED)
    starts = [0, *(gaps[:n - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1:].tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(texts: pa.Array) -> pa.Array:
    """As signed 64-bit numbers with the same bits."""
    values = [fingerprint(t.as_py()) for t in as_strings(texts)]
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
