"""WARC archives with a two-level capture index.

`write_archive` writes one record per page with Spark's text writer: the record is the line, and the blank
lines that end a WARC record are the line separator, so files go to any store Spark writes to.
Pages whose payload another page already holds become revisit records without a payload.

`build_index` sorts captures by reversed-host URL key into compressed blocks (level two) and keeps
the first and last key of each block as a sparse directory (level one). `lookup` finds blocks by
binary search over part bounds and directory, then lines by binary search in the block. `records`
reads captures by byte range.

Defined cases: a null payload is empty; a null URL has the key "-"; a payload of fewer than `least`
bytes is never a revisit; of equal payloads the largest page_id is the response, and rows that
repeat it are responses too; a page without page_id can be no target of a revisit unless all its
equals lack one; white space and control characters in URLs are percent-encoded or dropped; an
empty table gives an archive and an index without records; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poledger.plans.staging import settle

LEAST = 1000  # bytes from which equal payloads are written once
PER_FILE = 10_000  # records in a file, at most
PER_BLOCK = 256  # captures in a block of the index
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, file string, offset long, length long, page_id long, record_type string"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, then path and query: org,example,www)/a?b=1."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^#]*", 0)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail)), F.lit("-"))


def _clean(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("-")), F.lit("|"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST, page_id: str = "page_id",
    url: str = "url", html: str = "html",
) -> None:
    payload = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"), _clean(F.col(url)).alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    equal = own.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("target"), F.count("*").alias("copies"))
    # only digests that repeat: a small table, so that pages are joined where they are read when it allows
    equal = settle(equal.where("copies > 1").select("digest", "bytes", "target"), "equal-payloads")
    found = own.join(equal, ["digest", "bytes"], "left")
    again = F.coalesce(~F.col("target").eqNullSafe(F.col("page_id")) & F.col("target").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("again"), F.col("http")).otherwise(F.concat("http", "payload"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")), F.coalesce(line("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("target"), F.col("digest"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit(END), F.col("block"),
    )
    out = found.withColumn("again", again).withColumn("http", http).withColumn("block", block).select(record.alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return {p[0]: p[1] if len(p) > 1 else "" for p in pairs}


def _parse(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Header fields, where the block starts, where the record ends."""
    stop = data.index(END.encode(), at)
    if data[at : at + 9] != b"WARC/1.1\r":
        raise ValueError(f"no record at byte {at}")
    head = _fields(data[at:stop])
    start = stop + len(END)
    return head, start, start + int(head["Content-Length"])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All captures of an archive by reading its files from start to end."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                file, data, at = b.column(0)[i].as_py(), b.column(1)[i].as_py(), 0
                out = []
                while at < len(data):
                    head, _, end = _parse(data, at)
                    page = head.get("WARC-Page-ID")
                    out.append((head.get("WARC-Target-URI"), file, at, end - at, None if page is None else int(page), head["WARC-Type"]))
                    at = end + len(END)
                yield _table(out, ("url", *_NAMES[1:]))

    raw = files.mapInArrow(read, CAPTURE.replace("urlkey", "url"))
    return raw.select(url_key(F.col("url")).alias("urlkey"), *_NAMES[1:])


_NAMES = ("urlkey", "file", "offset", "length", "page_id", "record_type")
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def _table(rows: list[tuple], names=_NAMES) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=list(names))


@dataclass(frozen=True)
class CaptureIndex:
    """blocks: part, block, data. directory: part, block, first_key, last_key."""

    blocks: DataFrame
    directory: DataFrame


def build_index(captures: DataFrame) -> CaptureIndex:
    """Captures in key order over all parts, in compressed blocks, and the sparse directory."""
    ordered = captures.repartitionByRange("urlkey", "page_id", "file", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    dealt = ordered.select(*_NAMES).withColumn("part", F.spark_partition_id())

    def pack(batches):
        held: list[tuple] = []
        part, number = 0, 0

        def block():
            text = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in held)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "first_key": [held[0][0]], "last_key": [held[-1][0]],
                "data": pa.array([zlib.compress(text.encode())], pa.binary()),
            })

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = row[-1]
                held.append(row[:-1])
                if len(held) == PER_BLOCK:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    packed = settle(dealt.mapInArrow(pack, "part int, block int, first_key string, last_key string, data binary"), "capture-blocks")
    return CaptureIndex(packed.select("part", "block", "data"), packed.select("part", "block", "first_key", "last_key"))


def _unpack(data: bytes) -> list[tuple]:
    rows = (x.split("\t") for x in zlib.decompress(data).decode().split("\n"))
    return [(r[0], r[1], int(r[2]), int(r[3]), int(r[4]) if r[4] else None, r[5]) for r in rows]


def captures_of(index: CaptureIndex) -> DataFrame:
    """All captures, out of the blocks."""

    def read(batches):
        for b in batches:
            for data in b.column(0):
                yield _table(_unpack(data.as_py()))

    return index.blocks.select("data").mapInArrow(read, CAPTURE)


def lookup(index: CaptureIndex, urls: Sequence[str]) -> DataFrame:
    """Captures of the given URLs. Only the bounds of the parts and the URLs are held in one place."""
    spark = index.blocks.sparkSession
    asked = spark.createDataFrame([(u,) for u in urls], "url string").select(url_key(_clean(F.col("url"))).alias("k"))
    keys = sorted({r.k for r in asked.collect()})
    bounds = sorted((r.low, r.high, r.part) for r in index.directory.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
    parts = sorted({bounds[i][2] for k in keys for i in range(bisect_left(highs, k), bisect_right(lows, k))})
    wanted = spark.sparkContext.broadcast(keys)

    def search(batches: Iterator[pa.RecordBatch]):
        ks = wanted.value
        for b in batches:
            first, last = b.column(2).to_pylist(), b.column(3).to_pylist()
            hit = [bisect_left(ks, a) < bisect_right(ks, z) for a, z in zip(first, last, strict=True)]
            yield b.filter(pa.array(hit, pa.bool_())).select(["part", "block"])

    def read(batches):
        ks = wanted.value
        for b in batches:
            for data in b.column(0):
                rows = _unpack(data.as_py())
                names = [r[0] for r in rows]
                spans = ((bisect_left(names, k), bisect_right(names, k)) for k in ks[bisect_left(ks, names[0]) : bisect_right(ks, names[-1])])
                yield _table([rows[i] for a, z in spans for i in range(a, z)])

    near = index.directory.where(F.col("part").isin(parts)).select("part", "block", "first_key", "last_key").mapInArrow(search, "part int, block int")
    return index.blocks.where(F.col("part").isin(parts)).join(near, ["part", "block"]).select("data").mapInArrow(read, CAPTURE)


def records(captures: DataFrame) -> DataFrame:
    """Reads each capture by its byte range: page_id, record_id, refers_to_id, record_type,
    payload, payload_digest (of the payload, or as a revisit states it). A payload that does not
    have the digest its record states raises ValueError."""
    ordered = captures.select("file", "offset", "length", "page_id").repartition("file").sortWithinPartitions("file", "offset")

    def read(batches):
        opened, name = None, None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
        names = ["page_id", "record_id", "refers_to_id", "record_type", "payload", "payload_digest"]
        for b in batches:
            out, size = [], 0
            for file, offset, length, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    store, place = fs.FileSystem.from_uri(file)
                    opened, name = store.open_input_file(place), file
                opened.seek(offset)
                head, start, end = _parse(data := opened.read(length), 0)
                stated, body = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                if head["WARC-Type"] == "response":
                    body = data[data.index(END.encode(), start) + len(END) : end]
                    if hashlib.sha1(body).hexdigest() != stated:
                        raise ValueError(f"{file}, byte {offset}: the payload does not have the digest {stated}")
                out.append((page, head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Type"], body, stated))
                size += len(body or b"")
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(read, "page_id long, record_id string, refers_to_id string, record_type string, payload binary, payload_digest string")


def resolved(found: DataFrame) -> DataFrame:
    """Records with the size of their full payload, and for a revisit the page_id it refers to.
    A revisit whose target is not in the archive has neither."""
    rows = settle(found.select("page_id", "record_id", "refers_to_id", "record_type", F.octet_length("payload").cast("long").alias("size"), "payload_digest"), "records")
    targets = rows.where("record_type = 'response'").groupBy("record_id", "payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("size").alias("full"))
    again = rows.where("record_type = 'revisit'").drop("record_id").join(
        targets.withColumnRenamed("record_id", "refers_to_id"), ["refers_to_id", "payload_digest"], "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).withColumnRenamed("size", "payload_bytes")
    return first.select(*columns).unionByName(again.withColumnRenamed("full", "payload_bytes").select(*columns))
