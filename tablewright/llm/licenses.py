"""License scans: MinHash bands over overlapping windows, then exact containment.

A text's word shingles (five words) are cut into overlapping windows sized by the
template sought.  A window and a template that share enough shingles agree in the
least hashes of some band with a probability set beforehand: the number of bands
follows from the smallest Jaccard similarity that a window around a sufficient
copy can have.  Windows that agree in a band are compared shingle by shingle, and
kept where they contain ``CONTAINMENT`` of the template's shingles.  Templates of
up to four shingles must be there in full; their windows have exactly their size,
so they always agree.

Words are compared in lower case without ASCII punctuation.  Null text has no
words and no matches, nor has a template under five words.  Overlapping matches of
one template are one match; repeated rows have matches each; an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Shipped, mix64, quoted, slices, word_hashes
from .decontaminate import normal

SHINGLE = 5
CONTAINMENT = 0.8
ROWS = 2            # least hashes in a band
PROBABILITY = 0.995
BLOCK = 2_000       # templates held by a task at once

# Fixed texts: notices of common licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
}


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = mix64(out ^ words[j:j + n])
    return out


def shuffled(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The seed's own order of hashes, as 32-bit numbers."""
    multiplier = np.uint64(2 * (seed * 0x9E3779B97F4A7C15 % (1 << 62)) + 1)
    return ((hashes * multiplier) >> np.uint64(32)).astype(np.uint32)


class Size:
    """Templates of about one number of shingles, and the bands that find them."""

    def __init__(self, group: list[tuple[int, np.ndarray]], containment: float, probability: float):
        self.group = group
        sizes = [len(np.unique(h)) for _, h in group]
        short, long = min(sizes), max(len(h) for _, h in group)
        self.step = max(1, short // 8)
        need = math.ceil(containment * short - 1e-9)
        whole = need == short and long == short
        self.step = 1 if whole else self.step
        # a copy of any template lies inside some window of this many shingles
        self.window = long if whole else long + self.step
        self.least = need / (self.window + short - need)  # shared over united shingles
        agree = self.least ** ROWS
        self.bands = 1 if whole else max(1, math.ceil(math.log(1 - probability) / math.log(1 - agree)))
        self.keys = []
        for band in range(self.bands):
            mins = [tuple(int(shuffled(h, band * ROWS + r).min()) for r in range(ROWS)) for _, h in group]
            first = np.zeros(1 << 16, bool)
            first[[m[0] >> 16 for m in mins]] = True
            owners: dict = {}
            for g, m in enumerate(mins):
                owners.setdefault(m, []).append(g)
            self.keys.append((first, owners))

    def windows(self, hashes: np.ndarray, seed: int) -> np.ndarray:
        """Least hash in every window, at each multiple of the step; windows run
        over the end of the slice."""
        x = shuffled(hashes, seed)
        x = np.concatenate([x, np.full(-len(x) % self.step + self.window, np.uint32(0xFFFFFFFF))])
        x = x[:len(x) // self.step * self.step].reshape(-1, self.step).min(axis=1)
        blocks = -(-self.window // self.step)
        size = 1
        while 2 * size <= blocks:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        if size < blocks:
            x = np.minimum(x[:len(x) - (blocks - size)], x[blocks - size:])
        return x

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(window's first shingle, template's place in the group) that agree in a band."""
        out = set()
        for band, (first, owners) in enumerate(self.keys):
            x = self.windows(hashes, band * ROWS)
            at = np.flatnonzero(first[x >> np.uint32(16)])
            if len(at):
                rest = [x[at].tolist(), *[self.windows(hashes, band * ROWS + r)[at].tolist() for r in range(1, ROWS)]]
                for place, key in zip((at * self.step).tolist(), zip(*rest)):
                    out.update((place, g) for g in owners.get(key, ()))
        return out


class Templates:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, probability: float = PROBABILITY):
        self.names, self.containment = list(templates), containment
        rows = []
        for number, text in enumerate(templates.values()):
            _, words, _ = word_hashes([normal(text)])
            hashes = shingle_hashes(words)
            if len(hashes):
                rows.append((number, hashes))
        rows.sort(key=lambda r: (len(r[1]), r[0]))
        self.sizes: list[Size] = []
        group: list = []
        for row in rows:
            few = len(row[1]) <= 4  # must be there in full, so sizes are kept apart
            if group and (len(row[1]) > 1.2 * len(group[0][1]) or few and len(row[1]) != len(group[0][1])):
                self.sizes.append(Size(group, containment, probability))
                group = []
            group.append(row)
        if group:
            self.sizes.append(Size(group, containment, probability))
        self.sets = {number: np.unique(h) for number, h in rows}

    def search(self, texts: pa.Array):
        """(text, template, first word, word after the last, containment) of matches."""
        for base, part in slices(texts):
            starts, words, _ = word_hashes([normal(t) for t in part.to_pylist()])
            hashes = shingle_hashes(words)
            # shingles that begin in one text and end in another match nothing
            text = np.repeat(np.arange(len(part)), np.diff(starts))[:len(hashes)]
            ends = starts[1:][text] if len(hashes) else starts[:0]
            crossing = np.flatnonzero(np.arange(len(hashes)) + SHINGLE > ends)
            hashes[crossing] = mix64(crossing + (base + 1 << 40))
            found: dict = {}
            for size in self.sizes:
                for place, g in size.candidates(hashes):
                    number, _ = size.group[g]
                    want = self.sets[number]
                    # shingles of a text that begins inside the window are another's
                    for t in range(text[min(place, len(text) - 1)], text[min(place + size.window, len(text)) - 1] + 1):
                        lo, hi = max(place, int(starts[t])), min(place + size.window, max(int(starts[t]), int(starts[t + 1]) - SHINGLE + 1))
                        if hi > lo:
                            inside = np.flatnonzero(np.isin(hashes[lo:hi], want))
                            share = len(np.unique(hashes[lo:hi][inside])) / len(want)
                            if share >= self.containment - 1e-9:
                                found.setdefault((t, number), []).append((lo + int(inside[0]), lo + int(inside[-1]) + SHINGLE, share))
            for (t, number), matches in sorted(found.items()):
                offset, run = int(starts[t]), None
                for lo, hi, share in sorted(matches):
                    if run and lo < run[1]:
                        run = (run[0], max(run[1], hi), max(run[2], share))
                    else:
                        if run:
                            yield base + t, number, run[0] - offset, run[1] - offset, run[2]
                        run = (lo, hi, share)
                yield base + t, number, run[0] - offset, run[1] - offset, run[2]


def matches(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text",
            containment: float = CONTAINMENT, probability: float = PROBABILITY) -> DataFrame:
    """doc_id, license, first_word, last_word (after the last), containment.
    Templates beyond ``BLOCK`` are searched in blocks, with a scan for each."""
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, license string, first_word bigint, last_word bigint, containment double"
    rows = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"))
    names, found = list(templates), None
    for at in range(0, max(1, len(names)), BLOCK):
        held = Shipped(docs.sparkSession, Templates({n: templates[n] for n in names[at:at + BLOCK]}, containment, probability))

        def search(batches, held=held):
            index = held.get()
            for batch in batches:
                ids, out = batch["doc_id"], list(index.search(batch["text"]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in out], pa.int64())), pa.array([index.names[r[1]] for r in out], pa.string()),
                     *[pa.array([r[i] for r in out], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]],
                    names=["doc_id", "license", "first_word", "last_word", "containment"])

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    return found
