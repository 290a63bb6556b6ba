"""Operators over many rows: WARC, mixing, SimHash, repeated passages, the pipeline."""

import hashlib
import os
import random
import re
import sys
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright.llm import fingerprints, mixing, queries, simhash, substrings, warc

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
import check_oracle

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n))


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    assert check_oracle.compare(queries.QUERIES[name](spark, SF), check_oracle.duck(SF), queries.ORACLE[name]).startswith("ok")


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


# WARC

def b32(payload):
    import base64
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_rows():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    same = "<p>same</p>" * 50
    texts = [None, "", "x", same, same, same, fake, "<b>" + fake * 3 + "</b>", "WARC/1.1\r\n", "\r\n\r\n", "é" * 500, "tail\r\n\r\nWARC/1.1\r\n",
             "WARC/1.1\r\nContent-Length: 999999\r\n\r\nz", same + " ", fake] + [prose(60, i) for i in range(40)]
    return [(i * 7 % 101, f"http://h/{i}\r\nX: y" if i % 9 == 0 else None if i % 10 == 1 else f"http://h/{i}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_warc_round_trip(spark, split):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit(1)).repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows)
    largest: dict = {}
    for i, _, t in rows:
        largest[t or ""] = max(i, largest.get(t or "", -1))
    for i, url, t in rows:
        data, r, first = (t or "").encode(), got[i], largest[t or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), b32(data))
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert bytes(r.payload) == (data if i == first else b"")
        assert r.target_uri == re.sub("[\r\n]", " ", url or "")


def test_warc_false_records_do_not_chain(spark):
    """A payload of whole false records, one of them naming a successor that is real."""
    path = warc.scratch_path(spark, "warc-test")
    rows = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    warc.write_warc(warc.records(rows).coalesce(1), path)
    lines = warc._lines(spark, path)
    assert lines.count() > len(page_rows()) + 5
    assert warc.read_warc(spark, path).count() == len(page_rows())


def test_warc_nulls_repeats_and_small_payloads(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (5, "u", "a"), (5, "u", "a"), (3, None, "a"), (None, None, None)], "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_round_trip(pages).collect()), key=str)
    assert got == sorted([(None, "revisit", 5, 1), (5, "response", None, 1), (5, "response", None, 1), (3, "revisit", 5, 1), (None, "response", None, 0)], key=str)
    alone = warc.records(pages, min_bytes=2).filter("record_type = 'revisit'")
    assert alone.count() == 0
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# mixing

def waterfill(sizes, weights, budget, passes):
    level = dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes if sizes[s] > 0}
    left = budget
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total >= passes * sizes[s]}
        if not over:
            for s in open_:
                level[s] = left * weights[s] / total
            break
        for s in over:
            level[s] = passes * sizes[s]
            left -= level[s]
        open_ -= over
    return level


def test_mixing_targets_and_takes(spark):
    draw = random.Random(5)
    sources = ["hot"] * 300 + ["b"] * 40 + ["é"] * 80 + [None] * 30 + ["tiny"] * 2 + ["none"] * 3
    rows = [(i if i % 50 else None, prose(draw.randint(0, 60), i) if s != "none" else None, s, "q") for i, s in enumerate(sources)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken string").withColumn("row", F.lit(1)).withColumn("size", F.lit("s"))
    got = mixing.mix(docs.drop("size").withColumn("src", F.lit(0))).collect()
    assert len(got) == len(rows)
    size: dict = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2, 3, 1, 2]))
    want = waterfill(size, weights, 1.5 * sum(size.values()), 2)
    taken: dict = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        taken[r.source] += r.taken
    assert sum(taken.values()) == int(sum(want.values()) + 1e-6)
    assert all(abs(taken[s] - want[s]) <= 120 for s in size)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == Counter((r.doc_id, r.source, r.size, r.taken) for r in again)
    kept = mixing.mixed(docs)
    assert kept.columns == [*docs.columns, "taken_"]
    assert sum(r.taken_ for r in kept.collect()) == sum(taken.values()) and kept.count() == sum(r.taken > 0 for r in got)


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, "", "a")], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_mixing_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id bigint, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(simhash, "stage", lambda df, name, keep=simhash.stage: stored.append(name) or keep(df, name))
    chain = list(range(200))
    random.Random(3).shuffle(chain)
    orders = {"in order": list(range(200)), "shuffled": chain}
    for name, nodes in orders.items():
        stored.clear()
        edges = spark.createDataFrame(list(zip(nodes[:-1], nodes[1:])), "a bigint, b bigint")
        got = simhash.components(edges).collect()
        assert {r.component for r in got} == {0} and len(got) == 200
        rounds = stored.count("renamed") + stored.count("followed")
        assert rounds <= (12 if name == "in order" else 24), (name, rounds)


def brute_components(values):
    """Smallest index reachable over links, for every value's index."""
    name = list(range(len(values)))
    changed = True
    pairs = [(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4]
    while changed:
        changed = False
        for i, j in pairs:
            least = min(name[i], name[j])
            if (name[i], name[j]) != (least, least):
                name[i] = name[j] = least
                changed = True
    return name


def test_fingerprints(spark):
    texts = [None, "", "  ", "One", "a b c d", "A B C D e", "É é x \x0b y z", "w " * 500, prose(70000, 1), "a b c"]
    for t in texts[:-2] + [texts[-1]]:
        assert fingerprints.fingerprint(t or "") == brute_fingerprint(t)
    native = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert fingerprints.fingerprint("a b c d") == native % (1 << 64)


def test_triples_cover_every_four_places():
    chosen = simhash.triples()
    assert len(chosen) == 20
    assert all(any(set(t) <= set(four) for t in chosen) for four in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [4096, 16])
def test_links_have_the_closure_of_all_pairs(spark, limit):
    draw = random.Random(7)
    centres = [draw.getrandbits(64) for _ in range(12)]
    values = {0, (1 << 64) - 1} | set(centres)
    for c in centres[:6]:
        for _ in range(60):
            v = c
            for _ in range(draw.randint(1, 6)):
                v ^= 1 << draw.randrange(64)
            values.add(v)
    values |= {draw.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    links = simhash.links(nodes, limit=limit)
    named = {r.node: r.component for r in simhash.components(links).collect()}
    want = brute_components(values)
    got = [named.get(s, s) for s in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_near_duplicates(spark):
    texts = [prose(120, i) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 5] + (" extra" if i % 2 else "")) for i in range(30)]
    rows += [(200, None), (201, ""), (None, "\n"), (None, "only null ids here"), (300, texts[7]), (300, texts[7]), (7, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("fingerprint", F.lit(1)).withColumn("row", F.lit(2))
    got = simhash.near_duplicates(docs).collect()
    values = [brute_fingerprint(t) for _, t in rows]
    name = brute_components(values)
    want = Counter()
    for (i, _), v, n in zip(rows, values, name):
        ids = [rows[j][0] for j in range(len(rows)) if name[j] == n and rows[j][0] is not None]
        want[i, f"{v:016x}", min(ids, default=None)] += 1
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(name))
    least = Counter(min((rows[j][0] for j in range(len(rows)) if name[j] == n and rows[j][0] is not None), default=None) for n in set(name))
    assert Counter(r.doc_id for r in kept.collect()) == least
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


# repeated passages

def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(seed):
    draw = random.Random(seed)
    passage = [prose(draw.randint(20, 150), seed * 100 + i) for i in range(6)]
    texts = [None, "", "short", "ab" * 400, "ab" * 400 + "c", "é" * 350, "x" * 401, "z" * 400]
    for n in range(60):
        parts = [prose(draw.randint(0, 60), seed * 1000 + n)]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passage)
            a, b = sorted(draw.choices(range(len(p) + 1), k=2))
            parts += [p[a:b] if draw.random() < 0.6 else p, prose(draw.randint(0, 30), draw.randrange(10 ** 6))]
        texts.append("".join(parts) if n % 2 else " ".join(parts))
    return texts + texts[10:14]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    texts = repeat_texts(seed)
    docs = spark.createDataFrame([(i if i % 11 else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, a int")
    docs = docs.withColumn("k", F.lit("k")).withColumn("spans", F.lit(0))
    got = substrings.without_repeats(docs).collect()
    want = Counter((i if i % 11 else None, *r) for i, r in enumerate(brute_repeats(texts, 400)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    assert sum(r[2] > 0 for r in want) >= 20


def test_repeats_small_parameters_and_empty(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab", k=draw.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in substrings.without_repeats(docs, length=20, gram=9, step=4).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 20)
    assert substrings.without_repeats(docs.limit(0)).count() == 0


# the pipeline

@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [docs.count()], docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans",
                                                      "mixing sources to target weights"]
    for n, (_, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, SF), f"test-{n}")
        seen.append(docs.count())
        if n < 4:
            assert docs.columns == columns
        if n == 1:
            prints = [brute_fingerprint(r.text) for r in before.collect()]
            assert seen[2] == len(set(brute_components(prints)))
        if n == 3:
            assert seen[4] == seen[3]
            assert not docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count()
    assert docs.columns == [*columns, "taken"] and seen[1] < seen[0] and seen[5] <= seen[4]
    total = before.select(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n
    assert docs.agg(F.sum("taken").alias("n")).first().n == total * 3 // 2
    assert corpus_pipeline.run(spark, SF).exceptAll(docs).count() == 0


def test_pipeline_empty(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, step in corpus_pipeline.STAGES:
        if step is not corpus_pipeline.benchmark_decontamination:
            docs = step(spark, docs, SF)
            assert docs.count() == 0
