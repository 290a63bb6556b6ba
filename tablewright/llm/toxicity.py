"""Toxicity: a convolutional text classifier, trained in numpy by Spark tasks.

Words are hashed to embeddings; filters of several widths slide over them, each
gives its largest value in the text, and a logistic unit weighs those.  The first
embedding coordinate starts as how much more often a bucket's words occur in toxic
training texts than their share; the rest starts at random; all is trained.

Training takes every labelled row, but never rows whose crc32(doc_id as text) is
divisible by ``FOLDS``.  Rows are dealt by a hash of their id into shards of about
``SHARD`` (fewer if texts are long), stored once as word buckets.  In each epoch every
shard trains from the common parameters; a parameter then moves by the mean over the
shards that moved it, summed by Spark as whole numbers, so that no order of shards
matters.  The driver holds the parameters, whose number is fixed, and no row.

A fifth of the rows, not trained on, sets the decision points, searched among all
their values: the score is shifted so that 0.5 is the best overall, and each language
gets the threshold that is best for its rows (0.5 where it has too few).  Language
picks a threshold; it never enters a score.

Null text is an empty text and has a score like any other.  Null labels are not
trained on; of repeated labels of a document the largest counts, of repeated rows of a
document the smallest text.  Repeated rows are scored each for itself.  With no
labelled rows of one class every score is that class's share (0.5 without any rows).
A task holds the words of one shard at a time; one very long text is held whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import Shipped, as_strings, free_name, quoted, slices, word_hashes
from .decontaminate import normal

FOLDS = 5
SHARD = 4096        # labelled rows in a shard, about; four fifths are trained on
SHARD_BYTES = 1 << 25   # of their texts, about, where these are long
BUCKETS = 1 << 17
SIZE = 8            # of an embedding
WIDTHS = (1, 2, 3)
FILTERS = 8         # of each width
EPOCHS = 4
BATCH = 32
SCALE = 2.0 ** 32   # of moves of parameters as whole numbers
BINS = 16           # of calibration values, for each unit of a logit
STORED = "held boolean, shard bigint, labels binary, langs array<string>, ends binary, ids binary"
PRIOR = 20          # calibration rows of each class that the common threshold counts as


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids): words as buckets 1.., and where each text's begin, with one more entry."""
    starts, hashes, _ = word_hashes([normal(t) for t in texts])
    return starts, (hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def padded(starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text followed by padding 0."""
    pad = max(WIDTHS) - 1
    n = len(starts) - 1
    out = np.zeros(len(ids) + pad * n, np.int64)
    out[np.arange(len(ids)) + pad * np.repeat(np.arange(n), np.diff(starts))] = ids
    return starts + pad * np.arange(n + 1), out


def pooled(tables: dict[int, list[np.ndarray]], biases: dict[int, np.ndarray], starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Largest filter values of every text; 0 for texts without words."""
    pad = max(WIDTHS) - 1
    n = len(starts) - 1
    begin, end = starts[:-1], starts[1:] - pad
    full = np.flatnonzero(end > begin)
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    if not len(full):
        return out
    edges = np.stack([begin[full], end[full]], axis=1).reshape(-1)
    for w, width in enumerate(WIDTHS):
        size = len(ids) - width + 1
        value = tables[width][0][ids[:size]]
        for j in range(1, width):
            value += tables[width][j][ids[j:j + size]]
        most = np.maximum.reduceat(np.concatenate([value, np.zeros((width, FILTERS), np.float32)]), edges, axis=0)[::2]
        out[full, w * FILTERS:(w + 1) * FILTERS] = np.maximum(most + biases[width], 0)
    return out


def presence(words: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each bucket, and toxic ones; entry 0 counts all texts."""
    total, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for ids, label in zip(words, y):
        seen = np.append(np.unique(ids), 0)
        total[seen] += 1
        toxic[seen] += int(label)
    return total, toxic


class Classifier:
    """Trained on the texts given, as one shard; ``train`` trains on the shards of a table."""

    def __init__(self, texts: list[str], labels, seed: int = 5, epochs: int = EPOCHS):
        y = np.asarray(labels, np.float32)
        starts, ids = word_buckets(texts)
        words = np.split(ids, starts[1:-1]) if len(texts) else []
        self.begin(*presence(words, y), seed)
        for epoch in range(epochs):
            self.epoch(words, y, np.random.default_rng([seed, epoch, 0]))

    def begin(self, total: np.ndarray, toxic: np.ndarray, seed: int) -> None:
        """Parameters before training, from ``presence`` of all texts."""
        self.share = float(toxic[0] / total[0]) if total[0] else 0.5
        self.constant = int(toxic[0]) in (0, int(total[0]))
        self.shift = 0.0
        if self.constant:
            return
        draw = np.random.default_rng(seed)
        self.embed = draw.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.embed[:, 0] = self._contrast(total, toxic)
        self.embed[0] = 0
        self.filters = {w: draw.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.filters[w][:, 0, :FILTERS // 2] += 1 / w
        self.biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = np.concatenate([np.repeat([0.5, 0.1], [FILTERS // 2, FILTERS - FILTERS // 2]) for _ in WIDTHS]).astype(np.float32)
        self.bias = np.full(1, -1.0, np.float32)
        self._squares = {k: np.zeros_like(v) for k, v in self._parameters().items()}

    def _parameters(self) -> dict:
        return ({"embed": self.embed, "out": self.out, "one": self.bias}
                | {("filter", w): self.filters[w] for w in WIDTHS} | {("bias", w): self.biases[w] for w in WIDTHS})

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """All parameters and the roots of their summed squares, in rows of ``SIZE``."""
        parts = []
        for held in (self._parameters(), {k: np.sqrt(v) for k, v in self._squares.items()}):
            flat = np.concatenate([v.ravel() for v in held.values()])
            parts.append(np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE))
        return parts[0], parts[1]

    def restore(self, values: np.ndarray, roots: np.ndarray) -> None:
        for held, flat in ((self._parameters(), values.ravel()), (self._squares, np.square(roots).ravel())):
            at = 0
            for v in held.values():
                v[...] = flat[at:at + v.size].reshape(v.shape)
                at += v.size

    def epoch(self, words: list[np.ndarray], y: np.ndarray, draw: np.random.Generator) -> None:
        if self.constant:
            return
        weight = np.where(y > 0, 0.5 / self.share, 0.5 / (1 - self.share))
        order = draw.permutation(len(y))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            self._step([words[i] for i in part], y[part], weight[part], 0.05)

    @staticmethod
    def _contrast(total: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """How far the toxic texts with a bucket exceed their share, in standard deviations, bounded."""
        share = toxic[0] / total[0]
        z = (toxic - total * share) / np.sqrt(total * share * (1 - share) + 1)
        return np.clip(z / 4, -1, 2).astype(np.float32)

    def _adapt(self, name, value, grad, rate, at=slice(None)):
        held = self._squares[name]
        held[at] += grad * grad
        value[at] -= rate * grad / (np.sqrt(held[at]) + 1e-6)

    def _step(self, words, y, weight, rate):
        features, places = [], []
        for ids in words:
            row, spots = [], []
            for w in WIDTHS:
                spread = np.concatenate([ids, np.zeros(w - 1, ids.dtype)])
                if not len(ids):
                    row.append(np.zeros(FILTERS, np.float32))
                    spots.append(None)
                    continue
                x = self.embed[spread]
                value = sum(x[j:j + len(ids)] @ self.filters[w][j] for j in range(w))
                best = value.argmax(axis=0)
                row.append(value[best, np.arange(FILTERS)] + self.biases[w])
                spots.append((spread, best))
            features.append(np.concatenate(row))
            places.append(spots)
        features = np.array(features)
        active = np.maximum(features, 0)
        p = 1 / (1 + np.exp(-(active @ self.out + self.bias)))
        error = ((p - y) * weight / len(y)).astype(np.float32)
        back = (error[:, None] * self.out) * (features > 0)
        self._adapt("out", self.out, active.T @ error, rate)
        self.bias -= np.float32(rate * error.sum())
        rows, grads = [], []
        for k, w in enumerate(WIDTHS):
            part = back[:, k * FILTERS:(k + 1) * FILTERS]
            grad = np.zeros_like(self.filters[w])
            for i, spots in enumerate(places):
                if spots[k] is None:
                    continue
                spread, best = spots[k]
                for f in np.flatnonzero(part[i]):
                    at = spread[best[f]:best[f] + w]
                    grad[:, :, f] += part[i, f] * self.embed[at]
                    rows.append(at)
                    grads.append(part[i, f] * self.filters[w][:, :, f])
            self._adapt(("filter", w), self.filters[w], grad, rate)
            self._adapt(("bias", w), self.biases[w], part.sum(axis=0), rate)
        if rows:
            rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            total[rows == 0] = 0  # padding stays 0
            self._adapt("embed", self.embed, total, rate, rows)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def trained(self) -> None:
        """Drops what only training needs."""
        self.__dict__.pop("_squares", None)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What a filter adds for each bucket at each of its places."""
        if "_tables" not in self.__dict__:
            self._tables = {w: [self.embed @ self.filters[w][j] for j in range(w)] for w in WIDTHS}
        return self._tables

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.logits_of(*word_buckets(texts))

    def logits_of(self, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(starts) - 1, np.log((self.share + 1e-3) / (1 - self.share + 1e-3)))
        return (pooled(self.tables(), self.biases, *padded(starts, ids)) @ self.out + self.bias).astype(float)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - self.shift, -40, 40)))


def _stored_ids(texts: pa.Array) -> pa.Array:
    """The words of each text as buckets, 32 bits each."""
    parts = [pa.array([], pa.binary())]
    for _, part in slices(as_strings(texts)):
        starts, ids = word_buckets(part.to_pylist())
        parts.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(ids)]))
    return pa.concat_arrays(parts)


def _gather(table: pa.Table) -> pa.Table:
    """A shard as one row."""
    table = table.sort_by("place")
    ids = table["ids"].to_pylist()
    return pa.table({
        "held": table["held"][:1], "shard": table["shard"][:1],
        "labels": pa.array([np.array(table["label"], np.int8).tobytes()], pa.binary()),
        "langs": pa.array([table["lang"].to_pylist()], pa.list_(pa.string())),
        "ends": pa.array([(np.cumsum([len(x) for x in ids]) // 4).astype(np.int64).tobytes()], pa.binary()),
        "ids": pa.array([b"".join(ids)], pa.binary())})


def _shards(batches):
    """(shard, starts, ids, labels, langs) of each stored row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            starts = np.concatenate([[0], np.frombuffer(row["ends"][0].as_buffer(), np.int64)])
            yield (row["shard"][0].as_py(), starts, np.frombuffer(row["ids"][0].as_buffer(), np.int32),
                   np.frombuffer(row["labels"][0].as_buffer(), np.int8).astype(np.float32), row["langs"][0].values)


def _count(batches):
    for _, starts, ids, y, _ in _shards(batches):
        total, toxic = presence(np.split(ids, starts[1:-1]), y)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "total": total[at], "toxic": toxic[at]})


def _moves(held: Shipped, seed: int, epoch: int, batches):
    """How far an epoch on a shard moves each row of the parameters."""
    begin = None
    for shard, starts, ids, y, _ in _shards(batches):
        model = held.get()
        begin = model.state() if begin is None else begin
        model.restore(*begin)
        model.epoch(np.split(ids, starts[1:-1]), y, np.random.default_rng([seed, epoch, shard]))
        end = model.state()
        for at in range(0, len(end[0]), 10_000):
            cut = slice(at, at + 10_000)
            steps = np.concatenate([np.rint((after[cut].astype(float) - before[cut]) * SCALE) for after, before in zip(end, begin)], axis=1).astype(np.int64)
            moved = np.flatnonzero(steps.any(axis=1))
            yield pa.RecordBatch.from_pydict({"place": at + moved} | {f"m{i}": steps[moved, i] for i in range(2 * SIZE)})


def _logits(held: Shipped, batches):
    for _, starts, ids, y, langs in _shards(batches):
        at = 0
        while at < len(y):  # texts of a hundred thousand words, or a longer one
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 100_000, side="right")) - 1)
            values = held.get().logits_of(starts[at:to + 1] - starts[at], ids[starts[at]:starts[to]])
            yield pa.RecordBatch.from_pydict({"lang": langs[at:to], "label": y[at:to].astype(np.int64), "value": values})
            at = to


def best_thresholds(values: DataFrame) -> DataFrame:
    """For each ``part`` of (part, value, label): the threshold halfway between two values at which the
    F1 of ``value >= it`` is best, the upper of equally good ones; and its numbers of labels 1 and 0.

    Running sums have two levels: over bins of values, and over the values in a bin."""
    same = (values.groupBy("part", "value").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
            .withColumn("bin", F.floor(F.least(F.greatest(F.col("value"), F.lit(-100.0)), F.lit(100.0)) * BINS)))
    down, whole = Window.partitionBy("part").orderBy(F.desc("bin")), Window.partitionBy("part")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    bins = (same.groupBy("part", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("value").alias("top"))
            .select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                    F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"), F.lead("top").over(down).alias("below"),
                    F.sum("n").over(whole).alias("n_all"), F.sum("hits").over(whole).alias("hits_all")))
    inside = Window.partitionBy("part", "bin").orderBy(F.desc("value"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n_before") + F.sum("n").over(upto)
    hits = F.col("hits_before") + F.sum("hits").over(upto)
    each = same.join(bins, ["part", "bin"]).select(
        "part", "n_all", "hits_all", (2 * hits / (n + F.col("hits_all"))).alias("f1"), "value",
        F.coalesce(F.lead("value").over(inside), F.col("below"), F.col("value") - 1).alias("next"))
    best = each.groupBy("part").agg(F.max(F.struct("f1", "value", "next")).alias("b"), F.max("n_all").alias("n"), F.max("hits_all").alias("ones"))
    return best.select("part", ((F.col("b.value") + F.col("b.next")) / 2).alias("threshold"), "ones", (F.col("n") - F.col("ones")).alias("zeros"))


def stored_shards(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """All labelled rows of the training folds, a row for each shard."""
    known = (labels.select("doc_id", F.col(label).alias("label")).filter("label IN (0, 1)")
             .filter(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label")))
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id", "left_semi")
    found = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    shards = max(1, round(found.n / SHARD), round((found.size or 0) / SHARD_BYTES))
    rows = (docs.select("doc_id", "text", "lang").join(known, "doc_id")
            .groupBy("doc_id").agg(F.min(F.struct("text", "lang", "label")).alias("r")))
    rows = rows.select((F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).alias("held"),
                       F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"),
                       F.xxhash64("doc_id", F.lit("place")).alias("place"), F.col("r.label").cast("int").alias("label"),
                       "r.lang", F.arrow_udf(_stored_ids, "binary")(F.col("r.text")).alias("ids"))
    # a file for nearly every shard, so that epochs spread over all cores
    dealt = rows.repartition(2 * shards, "held", "shard")
    return stage(dealt.groupBy("held", "shard").applyInArrow(_gather, STORED), "toxicity-shards")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 5):
    """(classifier, thresholds by language) from all labelled rows of the training folds."""
    spark = docs.sparkSession
    stored = stored_shards(docs, labels, label)
    fit = stored.filter("NOT held")
    # one row for each bucket, and one number for each parameter: as many whatever the tables
    counts = (fit.mapInArrow(_count, "bucket bigint, total bigint, toxic bigint").groupBy("bucket")
              .agg(F.sum("total").alias("total"), F.sum("toxic").alias("toxic")).toArrow())
    total, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    total[counts["bucket"]], toxic[counts["bucket"]] = counts["total"], counts["toxic"]
    model = Classifier([], [])
    model.begin(total, toxic, seed)
    if model.constant:
        return model, {}
    names = [f"m{i}" for i in range(2 * SIZE)]
    schema = ", ".join(["place bigint"] + [f"{m} bigint" for m in names])
    for epoch in range(EPOCHS):
        moves = fit.mapInArrow(functools.partial(_moves, Shipped(spark, model), seed, epoch), schema)
        mean = moves.groupBy("place").agg(*[(F.sum(m) / F.count("*") / SCALE).cast("float").alias(m) for m in names]).toArrow()
        values, roots = model.state()
        at = mean["place"].to_numpy()
        for i in range(SIZE):
            values[at, i] += mean[names[i]].to_numpy()
            roots[at, i] += mean[names[SIZE + i]].to_numpy()
        model.restore(values, roots)
    model.trained()
    scored = stored.filter("held").mapInArrow(functools.partial(_logits, Shipped(spark, model)), "lang string, label bigint, value double")
    everywhere = F.struct(F.lit(True).alias("common"), F.lit("").alias("lang"))
    own = F.struct(F.lit(False).alias("common"), F.col("lang").alias("lang"))
    parts = F.when(F.col("lang").isNull(), F.array(everywhere)).otherwise(F.array(everywhere, own))
    # a row for each language, and one for all
    best = {(r.common, r.lang): r for r in best_thresholds(scored.select(F.explode(parts).alias("part"), "value", "label"))
            .select("part.*", "threshold", "ones", "zeros").collect()}
    common = best.pop((True, ""), None)
    thresholds: dict = {}
    if common and common.ones and common.zeros:
        model.shift = common.threshold
        for (_, lang), r in sorted(best.items()):
            n = min(r.ones, r.zeros)
            if n:  # the fewer rows a language has, the nearer it stays to the common threshold
                own_best = 1 / (1 + np.exp(-np.clip(r.threshold - model.shift, -40, 40)))
                thresholds[lang] = float((n * own_best + PRIOR * 0.5) / (n + PRIOR))
    return model, thresholds


def with_toxicity(docs: DataFrame, model: Classifier, thresholds: dict, text: str = "text", lang: str = "lang",
                  out: str = "toxicity") -> tuple[DataFrame, str]:
    """``docs`` with a struct score, threshold (the language's), flagged; and its name."""
    held = Shipped(docs.sparkSession, model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [held.get().scores(part.to_pylist()) for _, part in slices(as_strings(texts))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    out = free_name(docs, out)
    limit = F.lit(0.5)
    for name, value in thresholds.items():
        limit = F.when(quoted(lang) == name, F.lit(value)).otherwise(limit)
    scored = docs.withColumn(out, score.asNondeterministic()(quoted(text)))
    return scored.withColumn(out, F.struct(quoted(out).alias("score"), limit.alias("threshold"),
                                           (quoted(out) >= limit).alias("flagged"))), out
