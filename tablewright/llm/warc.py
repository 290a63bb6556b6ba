"""WARC archives: write pages as records, read archives back by boundary chains.

Writing.  A page is a ``response`` record; of pages with equal payloads the one
with the largest id is, and the others are ``revisit`` records that name it and
carry no payload.  Records are text rows that end as WARC records end, so Spark's
own writer makes the files.

Reading.  Files are split at every occurrence of the version line, wherever it
stands, so large files are read by many tasks.  Each piece is a candidate record:
its offset is the sum of the bytes before it, and its Content-Length says where
its successor begins.  Only pieces that pointer jumping reaches from the start of
their file are records; a version line inside a payload is not, and its bytes
are given back to the record they belong to.

Null html is an empty payload.  Repeated rows are records of their own: of rows
with one id the digest's largest id is response for all of them.  A null id is
written as an empty one and read back as null; it counts as the smallest.  An
empty table gives no archive and no rows.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tablewright.session import scratch_path, stage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_BYTES = 0      # payloads smaller than this are never revisits
LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*([0-9]{1,15})[ \t]*\r\n", re.IGNORECASE)
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("bytes", pa.int64()),
                    ("succ", pa.int64()), ("leave", pa.int64())])
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: 160 bits are 32 letters."""
    hexed = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    pages = (pages.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
             .withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))))
    # equal payloads are counted before any payload moves; only digests that repeat
    # are looked up, by broadcast if Spark finds the stored table small enough
    first = stage(pages.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
                  .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
                  .filter("n > 1 AND first_id IS NOT NULL").drop("n"), "warc-repeated")
    joined = pages.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (joined.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_warc(recs: DataFrame, path: str, max_records: int = 50_000) -> None:
    """Write the rows of ``records`` as uncompressed WARC files in the folder ``path``."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    # header values hold no line ends
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    header = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html")), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    (recs.select(header.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max_records)
     .mode("error").text(path))


PIECE = "file string, block bigint, rel bigint, bytes bigint, succ bigint, leave bigint"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _succ(value: bytes, rel: int):
    """Where the record that a version line at ``rel`` opens ends, by its header."""
    head = value.find(END.encode())
    found = LENGTH.search(value, 0, head + 2) if head >= 0 else None
    return rel + len(MAGIC) + head + len(END) + int(found[1]) + len(END) if found else None


def pieces(lines: DataFrame) -> DataFrame:
    """Candidate records, a row per piece: block and place in it, successor, and
    where the chain from the piece leaves the block (``leave``; null: nowhere).
    Each task follows the links within its own blocks."""
    def follow(batches):
        open_block, rows, upto = None, [], 0

        def close():
            leave = {}
            for rel, size, succ in reversed(rows):
                leave[rel] = leave[succ] if succ in leave else succ
            # a successor inside the block that is no candidate ends the chain
            at = {rel for rel, _, _ in rows}
            dead = {rel for rel, out in leave.items() if out is not None and out < upto - len(MAGIC) and out not in at}
            return pa.RecordBatch.from_pydict({
                "file": [open_block[0]] * len(rows), "block": [open_block[1]] * len(rows), "rel": [r[0] for r in rows],
                "bytes": [r[1] for r in rows], "succ": [r[2] for r in rows],
                "leave": [None if r[0] in dead else leave[r[0]] for r in rows]}, schema=_PIECE)

        for batch in batches:
            for value, file, block in zip(batch["value"], batch["file"].to_pylist(), batch["block"].to_pylist()):
                if (file, block) != open_block:
                    if rows:
                        yield close()
                    open_block, rows, upto = (file, block), [], 0
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                rel = upto - len(MAGIC)
                upto += len(data) + len(MAGIC)
                rows.append((rel, len(data) + len(MAGIC), _succ(data, rel)))
        if rows:
            yield close()

    return lines.mapInArrow(follow, PIECE)


def placed_pieces(found: DataFrame) -> DataFrame:
    """``pieces`` with offsets in the file: a block's bytes add to those before it."""
    blocks = found.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))


def entries(chain: DataFrame) -> DataFrame:
    """file, start of the pieces by which the chain from a file's start enters each
    block.  Pointer jumping: every round doubles the number of blocks jumped."""
    jumps = chain.filter("leave IS NOT NULL").select("file", "start", "leave")
    found = stage(chain.filter("start = 0").select("file", "start"), "warc-entries")
    known = found.count()
    while known:
        step = (found.join(jumps, ["file", "start"]).select("file", F.col("leave").alias("start"))
                .join(chain.select("file", "start"), ["file", "start"], "left_semi"))
        found = stage(found.union(step).distinct(), "warc-entries")
        n = found.count()
        if n == known:
            break
        known = n
        far = jumps.select("file", F.col("start").alias("leave"), F.col("leave").alias("far"))
        jumps = stage(jumps.join(far, ["file", "leave"]).select("file", "start", F.col("far").alias("leave")), "warc-jumps")
    return found


def owners(chain: DataFrame, entry: DataFrame) -> DataFrame:
    """file, start, owner: pieces that are no records, with the record whose bytes
    they are (null: of none), and the records that own such pieces."""
    marked = chain.join(entry.withColumn("entry", F.col("start")), ["file", "start"], "left")

    def walk(rows):
        rows = rows.sort_values("start")
        chain_from, own, last = rows["entry"].dropna().tolist(), [], None
        at = int(chain_from[0]) if chain_from else None
        for start, succ in zip(rows["start"], rows["succ"]):
            if at is not None and start == at:
                last, at = int(start), None if pd.isna(succ) else int(succ)
            own.append(last)
        return rows[["file", "block", "start"]].assign(owner=pd.array(own, "Int64"))

    walked = marked.groupBy("file", "block").applyInPandas(walk, "file string, block bigint, start bigint, owner bigint")
    walked = stage(walked, "warc-owners")
    # what stands before a block's first record belongs to the last record before the block
    last = walked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("file", "block", F.max("last").over(before).alias("carried"))
    walked = walked.join(last, ["file", "block"]).select("file", "start", F.coalesce("owner", "carried").alias("owner"))
    stray = stage(walked.filter("owner IS NULL OR owner <> start"), "warc-stray")
    keep = stray.filter("owner IS NOT NULL").select("file", F.col("owner").alias("start"), "owner").distinct()
    return stage(stray.union(keep), "warc-special")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target_uri, payload (binary), and the headers
    payload_digest, payload_length, refers_to of every record in the archives."""
    lines = _lines(spark, path)
    found = stage(pieces(lines), "warc-pieces")
    base = stage(placed_pieces(found), "warc-blocks")
    chain = stage(found.join(base, ["file", "block"]).select(
        "file", "block", (F.col("rel") + F.col("base")).alias("start"), (F.col("succ") + F.col("base")).alias("succ"),
        (F.col("leave") + F.col("base")).alias("leave")), "warc-chain")
    special = owners(chain, entries(chain))

    def number(batches):
        at, upto = None, 0
        for batch in batches:
            rel = []
            for size, file, block in zip(pc.binary_length(batch["value"]).to_pylist(), batch["file"].to_pylist(), batch["block"].to_pylist()):
                if (file, block) != at:
                    at, upto = (file, block), 0
                rel.append(upto - len(MAGIC))
                upto += (size or 0) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())], names=["value", "file", "block", "rel"])

    bodies = (lines.mapInArrow(number, "value string, file string, block bigint, rel bigint").join(base, ["file", "block"])
              .select("file", (F.col("rel") + F.col("base")).alias("start"), F.col("value").cast("binary").alias("body"))
              .join(special.withColumn("touched", F.lit(True)), ["file", "start"], "left"))
    whole = bodies.filter("touched IS NULL").select("body")
    joined = (bodies.filter("touched AND owner IS NOT NULL").groupBy("file", "owner")
              .agg(F.sort_array(F.collect_list(F.struct("start", "body"))).alias("parts"))
              .select(F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].body, (a, p) -> a || encode('{_escaped(MAGIC)}', 'utf-8') || p.body)").alias("body")))
    return _parsed(whole.union(joined))


def _escaped(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def _parsed(bodies: DataFrame) -> DataFrame:
    text = F.col("body").cast("string")
    at = F.locate(END, text)
    # header values are ASCII but for the target, so the header is measured in bytes
    head = F.substring(text, F.lit(1), at + 1)
    rows = bodies.select("body", head.alias("head"), F.octet_length(head).alias("size"))

    def field(name):
        return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)

    page = r"<urn:page:(-?[0-9]*)>"
    none = lambda c: F.when(c != "", c)
    return rows.select(
        none(F.regexp_extract(field("WARC-Record-ID"), page, 1)).alias("record_id"), field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        F.substring(F.col("body"), F.col("size") + 3, field("Content-Length").cast("int")).alias("payload"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"),
        field("X-Payload-Length").cast("bigint").alias("payload_length"),
        none(F.regexp_extract(field("WARC-Refers-To"), page, 1)).alias("refers_to"))


def archive_round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives in the folder ``path`` (a new shared one), read
    them back.  Digests and sizes of responses are those of the payloads read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(records(pages, **columns), path)
    read = read_warc(spark, path)
    revisit = F.col("record_type") == "revisit"
    return read.select(
        F.col("record_id").cast("bigint").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "target_uri", "payload")
