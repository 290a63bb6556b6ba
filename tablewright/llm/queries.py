"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import decontaminate, hardnegs, licenses, mixing, periods, quality, secrets, simhash, substrings, tokens, toxicity, urls, warc
from .common import quoted

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_secret_scan")
def op1(spark, sf):
    found, name = secrets.with_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    s = quoted(name)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def count(kind):
        return F.size(F.filter(s.base, lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")

    # base and added spans never overlap, so the order is that of their starts
    order = F.array_sort(F.concat(s.base, s.added), lambda x, y: F.when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
                         .when(kind_order(x.kind) < kind_order(y.kind), -1).when(kind_order(x.kind) > kind_order(y.kind), 1).otherwise(0))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(s.base), 256).alias("base_sha256"), listed(order).alias("spans"))


def kind_order(kind):
    return F.array_position(F.array(*[F.lit(k) for k in secrets.KINDS]), kind)


@query("op2_decontaminate")
def op2(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_toxicity")
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model, thresholds = toxicity.train(docs, table(spark, sf, "labels"))
    scored, name = toxicity.with_toxicity(docs, model, thresholds)
    t = quoted(name)
    return scored.select("doc_id", (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"), t.score.alias("score"),
                         (t.score >= 0.5).cast("int").alias("predicted"), t.threshold.alias("lang_threshold"), t.flagged.alias("flagged"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(digest, 5 * (i // 4) + 1, 5) AS BIGINT)
    >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""


@query("op4_warc", OP4_SQL)
def op4(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_url_filter")
def op5(spark, sf):
    judged, name = urls.with_verdict(table(spark, sf, "pages").select("page_id", "url"))
    u = quoted(name)
    return judged.select("page_id", u.host.alias("host"), u.path.alias("path"), u.rule.alias("rule"), u.verdict.alias("verdict"))


@query("op6_quality_rules")
def op6(spark, sf):
    judged, name = quality.with_quality(table(spark, sf, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")
    return judged.select("doc_id", *[quoted(name)[f].alias(f) for f in fields])


OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src FROM documents),
t AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || src) AS turn FROM d),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  2 * CAST(source_size AS DOUBLE) AS cap, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS budget FROM s),
fill AS (
  SELECT 0 AS round, src, source_size, weight, cap, budget, false AS capped, 0.0::DOUBLE AS share FROM w
  UNION ALL
  SELECT round + 1, src, source_size, weight, cap, budget, capped OR share >= cap AND round > 0,
    (budget - coalesce(sum(cap) FILTER (WHERE capped OR share >= cap AND round > 0) OVER (), 0))
      * weight / sum(weight) FILTER (WHERE NOT (capped OR share >= cap AND round > 0)) OVER ()
  FROM fill WHERE round < 200),
targets AS (SELECT src, source_size, CASE WHEN capped OR share >= cap THEN cap ELSE share END AS target FROM fill WHERE round = 200),
c AS (SELECT t.*, source_size, target, sum(size) OVER (PARTITION BY t.src ORDER BY turn, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM t JOIN targets USING (src)),
passes AS (SELECT *, (upto + pass * source_size) / target AS finish FROM c, (VALUES (0), (1)) v(pass) WHERE size > 0),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, src, turn, upto, pass ROWS UNBOUNDED PRECEDING) AS spent FROM passes),
taken AS (SELECT turn, src, upto, CAST(sum(greatest(0, least(size, (SELECT floor(round(sum(target), 3)) FROM targets) - (spent - size)))) AS BIGINT) AS taken
  FROM served GROUP BY ALL)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target, coalesce(taken, 0) AS taken
FROM c LEFT JOIN taken ON c.turn = taken.turn AND c.src = taken.src AND c.upto = taken.upto AND size > 0"""


@query("op8_mixing", OP8_SQL)
def op8(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op9_simhash")
def op9(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op10_repeated_passages")
def op10(spark, sf):
    kept = substrings.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_license_scan")
def op7(spark, sf):
    return licenses.matches(table(spark, sf, "documents"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score
  FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark, sf):
    vectors, key = table(spark, sf, "embeddings"), F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegs.hard_negatives(vectors, anchors=key % 100 == 0, label=label)


def planted(n, h):
    """Where ``h``, the checksum of the id, ends in 0, a tail of the text repeats its
    beginning: the place whose word stands at each of n places."""
    place = np.arange(n)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


@query("op12_periodic_runs")
def op12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = periods.with_runs(docs, seed=F.crc32(F.col("doc_id").cast("string").cast("binary")), change=planted)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select("doc_id", F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
                        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                        F.sha2(F.coalesce(F.array_join(line, ""), F.lit("")), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


@query("op13_token_counts")
def op13(spark, sf):
    import public_tokenizers

    counted, name = tokens.with_token_counts(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                          quoted(name).alias("n_tokens"), (quoted(name) > 1024).alias("over_limit"))


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
