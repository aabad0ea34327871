"""WARC records, and a Merkle audit that locates where replicas of an archive differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, ship

DATE = "2026-01-01T00:00:00Z"
#: Leaves of the tree are ranges of so many bytes of a file; each node above covers FAN_OUT below.
SPAN, FAN_OUT = 65536, 16
#: Records a file holds at most, on average.
RECORDS_PER_FILE = 1000


class WarcError(ValueError):
    """Bytes that are no sequence of WARC records."""


@dataclass(frozen=True)
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


def parse_warc(data: bytes) -> Iterator[Record]:
    """The records of an uncompressed WARC file, with their offsets; a payload digest that is given is tested."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise WarcError(f"no record at offset {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["Content-Length"])
        payload, stop = data[end + 4 : end + 4 + size], end + 8 + size
        if data[stop - 4 : stop] != b"\r\n\r\n":
            raise WarcError(f"the record at offset {at} does not end where its length says")
        kind, _, digest = headers.get("WARC-Payload-Digest", "").partition(":")
        if kind == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError(f"the payload at offset {at} does not have its digest")
        yield Record(at, stop - at, headers, payload)
        at = stop


def warc_record(key: Column, url: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record; nulls count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    name = F.md5(F.concat_ws("|", text(key), text(url)).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = text(payload)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, url, digest (SHA-256 of the record's bytes) and payload of uncompressed WARC files. A file is
    read by one task, so files should be of usual WARC size (about 1 GB at most)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "length", "url", "digest", "payload"]
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                for r in parse_warc(data):
                    row = [name.as_py(), r.offset, r.length, r.headers.get("WARC-Target-URI"), hashlib.sha256(data[r.offset : r.offset + r.length]).hexdigest(), r.payload]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, url string, digest string, payload binary")


def lay_out(records: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(record_key, digest, length) to a manifest: file, offset, length, record_key, copies, digest.

    Records are dealt to files by the first hex digits of their digest and lie in digest order, so files stay even whatever
    the keys are; equal records lie side by side and are one row with their number of copies.
    """
    one = materialize(records.groupBy("record_key", "digest", "length").agg(F.count(F.lit(1)).alias("copies")))
    n = one.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    digits = 0
    while 16**digits * per_file < n:
        digits += 1
    before = Window.partitionBy("file").orderBy("digest", F.col("record_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = one.withColumn("file", F.concat(F.lit("part-"), F.substring("digest", 1, digits)))
    offset = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0))
    return placed.select("file", offset.alias("offset"), "length", "record_key", "copies", "digest")


@dataclass
class Tree:
    """Merkle levels of the files of a replica, each a table (file, node, hash): ranges of SPAN bytes first, roots last."""

    records: DataFrame
    levels: list[DataFrame]


def build_tree(records: DataFrame, span: int = SPAN, fan_out: int = FAN_OUT, depth: int | None = None) -> Tree:
    """From (file, offset, length, digest, ...). A range hashes its records in order of offset, a node its children in
    order of number; a record belongs to the range that it begins in. Groups hold the records that begin within `span`
    bytes, or `fan_out` nodes: no file is gathered in one task. A digest may be null (unreadable); a row may stand for several
    `copies` side by side, which then count in its hash."""
    line = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("digest", F.lit("")))
    if "copies" in records.columns:
        line = F.concat_ws(":", line, F.when(F.col("copies") != 1, F.col("copies").cast("string")))

    def fold(nodes: DataFrame, item: Column, order: Column) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"])
        return materialize(nodes.groupBy("file", "parent").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("hash")).select("file", F.col("parent").alias("node"), "hash"))

    levels = [fold(records.withColumn("parent", F.floor(F.col("offset") / span)), line, F.col("offset"))]
    while len(levels) < depth if depth else levels[-1].agg(F.coalesce(F.max("node"), F.lit(0)).alias("n")).first().n > 0:
        below = levels[-1].withColumn("parent", F.floor(F.col("node") / fan_out))
        levels.append(fold(below, F.concat_ws(":", F.col("node").cast("string"), "hash"), F.col("node")))
    return Tree(records, levels)


def audit(expected: DataFrame, found: DataFrame, *, span: int = SPAN, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[DataFrame]]:
    """Where replica `found` differs from `expected`, both (file, offset, length, digest): rows of the records concerned
    with kind changed, missing (not there, or its digest null) or extra; and the differing nodes of each level, roots first.

    Roots are compared for all files; below, only children of nodes that differ. Equal replicas cost one comparison of
    roots. Null digests on both sides are equal. A column `copies` (1 without it) says how many equal records lie side by side;
    another number is a change. Empty tables are replicas without files.
    """
    given = "copies" in expected.columns
    expected, found = (x if "copies" in x.columns else x.withColumn("copies", F.lit(1).cast("long")) for x in (expected, found))
    good, bad = (build_tree(x, span, fan_out) for x in (expected, found))
    depth = max(len(good.levels), len(bad.levels))
    good, bad = (t if len(t.levels) == depth else build_tree(t.records, span, fan_out, depth) for t in (good, bad))
    trail, above = [], None
    for level in reversed(range(depth)):
        a, b = (t.levels[level] for t in (good, bad))
        if above is not None:
            parents = above.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fan_out)).join(parents, ["file", "parent"], "left_semi") for x in (a, b))
        both = a.select("file", "node", F.col("hash").alias("x")).join(b.select("file", "node", F.col("hash").alias("y")), ["file", "node"], "full")
        above = materialize(both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node"))
        trail.append(above)
    spans = above.withColumnRenamed("node", "range")
    a, b = (x.withColumn("range", F.floor(F.col("offset") / span)).join(spans, ["file", "range"], "left_semi").drop("range") for x in (expected, found))
    b = b.select("file", "offset", F.col("length").alias("found_length"), F.col("digest").alias("found_digest"), F.col("copies").alias("found_copies"), F.lit(True).alias("there"))
    both = a.withColumn("wanted", F.lit(True)).join(b, ["file", "offset"], "full")
    differs = F.col("wanted").isNull() | F.col("there").isNull() | ~F.col("digest").eqNullSafe(F.col("found_digest")) | ~F.col("length").eqNullSafe(F.col("found_length")) | ~F.col("copies").eqNullSafe(F.col("found_copies"))
    kind = F.when(F.col("wanted").isNull(), "extra").when(F.col("there").isNull() | F.col("found_digest").isNull(), "missing").otherwise("changed")
    return both.filter(differs).withColumn("kind", kind).drop("wanted", "there", "found_length", "found_copies", *([] if given else ["copies"])), trail


#: The replica that op5 audits: of pages whose id leaves these remainders, one was overwritten in its first byte, one cannot be read.
CHANGED, LOST = (97, 11), (193, 7)


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages in which a damaged replica differs. Null columns count as empty in a record's bytes, null keys are
    a key of their own and are not damaged, repeated pages are one row with their copies, no pages are no files."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = pages.withColumn("raw", warc_record(F.col("page_id"), F.col("url"), F.col("html")))
    hashed = pages.select(F.col("page_id").alias("record_key"), F.octet_length("raw").cast("long").alias("length"), F.sha2("raw", 256).alias("digest"))
    manifest = materialize(lay_out(hashed))
    # The replica: every record's bytes, the damage done to them, and their own hashes; the manifest only says where a record lies.
    hit = lambda rule: F.coalesce(F.col("page_id") % rule[0] == rule[1], F.lit(False))
    held = F.when(~hit(LOST), F.when(hit(CHANGED), F.concat(F.lit("#"), F.expr("substring(raw, 2)"))).otherwise(F.col("raw")))
    held = pages.withColumn("held", held).select(F.col("page_id").alias("k"), F.sha2("raw", 256).alias("d"), F.octet_length("held").cast("long").alias("size"), F.sha2("held", 256).alias("hash"))
    held = materialize(held.distinct())
    there = manifest.join(held, F.col("record_key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    replica = materialize(there.select("file", "offset", F.coalesce("size", "length").alias("length"), "copies", F.col("hash").alias("digest")))
    found, _ = audit(manifest, replica)
    return found.select("file", "offset", "length", F.col("record_key").alias("page_id"), "copies", "digest", "found_digest", "kind")


OP5_SQL = f"""
WITH named AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS body, md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS m FROM pages
), raw AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)
    || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(body) || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM named
), hashed AS (
  SELECT page_id, CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS digest,
    CASE WHEN page_id % {LOST[0]} = {LOST[1]} THEN NULL WHEN page_id % {CHANGED[0]} = {CHANGED[1]} THEN sha256('#' || substr(r, 2)) ELSE sha256(r) END AS found_digest
  FROM raw
), one AS (SELECT page_id, digest, length, any_value(found_digest) AS found_digest, count(*) AS copies FROM hashed GROUP BY page_id, digest, length
), total AS (SELECT greatest(0, CAST(ceil(log(greatest(count(*), 1) / {RECORDS_PER_FILE}.0) / log(16)) AS INTEGER)) AS digits FROM pages
), placed AS (SELECT *, 'part-' || substr(digest, 1, digits) AS file FROM one, total
), laid AS (
  SELECT *, CAST(coalesce(sum(length * copies) OVER (PARTITION BY file ORDER BY digest, page_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM placed
)
SELECT file, "offset", length, page_id, copies, digest, found_digest, CASE WHEN found_digest IS NULL THEN 'missing' ELSE 'changed' END AS kind
FROM laid WHERE digest IS DISTINCT FROM found_digest
"""
