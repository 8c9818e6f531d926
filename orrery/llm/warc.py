"""WARC archives with revisit records, written and read through Spark.

Headers alone (key, digest, length, url) are shuffled by payload digest, and
revisits joined to the original response. What comes back to the payloads is
the keys of rows that are no response of their own; they are broadcast if few
when counted, so payloads stay in the task that read them. Revisits are made
from headers. Every record is a gzip member of its own, so a reader can start
at any; files are cut by bytes, begin with a warcinfo record and end in
.warc.gz. Spark's text writer writes them, to any store that it writes to: its
line separator is the last byte of each record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.columns import by_keys, numbered, place, row_key
from orrery.llm.words import raw, slices
from orrery.plans.durable import bounded_batches, cut

#: Payloads of fewer bytes are always written.
MIN_BYTES = 100
#: A task begins another file when one has so many bytes: a reader holds one in memory.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_BATCH_BYTES = 4 << 20


def _record_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h.substr(1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends inside a value are escaped."""
    value = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def warc_records(pages: DataFrame, date: str | None = None) -> DataFrame:
    """Each row of pages (page_id, url, html) as a record: page_id, record_type, record (without the closing line ends).

    Of rows with equal payloads of at least MIN_BYTES bytes, the one of the
    smallest (page_id, url), nulls last, is a response and the others revisit
    it; of rows that repeat it, one. Smaller payloads, a null payload being
    empty, are all responses. Further columns, of whatever names, are left
    out. An empty table gives no record.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    column = lambda name: F.col(place(pages, name))
    rows = numbered(pages).select(column("page_id").cast("long").alias("page_id"), column("url").cast("string").alias("url"), F.coalesce(column("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("key", row_key("page_id", "url", "digest"))
    headers = cut(rows.where(F.col("size") >= MIN_BYTES).groupBy("key", "digest", "page_id", "url", "size").agg(F.count("*").alias("n")))
    order = F.struct(F.col("page_id").isNull().alias("m"), F.col("page_id"), F.col("url").isNull().alias("u"), F.col("url"), F.col("key"))
    first = headers.groupBy("digest").agg(F.min(order).alias("o"), F.sum("n").alias("times")).where("times > 1").select("digest", "o")
    roles = cut(headers.join(first, "digest").withColumn("original", F.col("key") == F.col("o.key")))
    # responses that nothing repeats need no role
    told = cut(roles.where("not original or n > 1").select("key", "original"))
    joined = by_keys(rows, told, "key", "left")
    nothing = F.lit(None).cast("struct<page_id: bigint, url: string, key: binary>")
    whole = joined.where("original is null").withColumn("nth", F.when(F.col("size") < MIN_BYTES, F.monotonically_increasing_id()).otherwise(0))
    if told.where("original").limit(1).count():
        whole = whole.unionAll(joined.where("original").dropDuplicates(["key"]).withColumn("nth", F.lit(0).cast("long")))
    since = F.when(F.col("original"), 1).otherwise(0).cast("long")
    again = roles.where("not original or n > 1").withColumn("nth", F.explode(F.sequence(since, F.col("n") - 1)))
    again = again.select("page_id", "url", F.lit("").alias("html"), "digest", "size", "key", "nth", F.struct("o.page_id", "o.url", "o.key").alias("o"))
    whole = whole.select("page_id", "url", "html", "digest", "size", "key", "nth", nothing.alias("o"))
    return _records(whole, False, date).unionAll(_records(again, True, date))


def _records(rows: DataFrame, revisit: bool, date: str) -> DataFrame:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    block = F.octet_length(http) if revisit else F.col("size") + F.octet_length(http)
    kind = "revisit" if revisit else "response"
    refers = (
        _field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", _record_id(F.hex("o.key"), F.lit(0))),
        _field("WARC-Refers-To-Target-URI", F.col("o.url")), _field("WARC-Refers-To-Date", F.lit(date)), _field("X-Refers-To-Page", F.col("o.page_id")),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: {kind}{_CRLF}"),
        _field("WARC-Record-ID", _record_id(F.hex("key"), F.col("nth"))), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _field("X-Page-Id", F.col("page_id")),
        *(refers if revisit else ()),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), block.cast("string"), F.lit(_CRLF * 2), http,
    )
    return rows.select("page_id", F.lit(kind).alias("record_type"), F.concat(head, F.col("html")).alias("record"))


def _packed(compressed: bool):
    """Records as bytes without their last, which the writer's line separator gives, by file."""
    about = f"software: orrery{_CRLF}format: WARC File Format 1.1{_CRLF}".encode()

    def info(task: int, volume: int) -> bytes:
        # a record of the archive itself, known by its place
        told = hashlib.sha256(f"{task} {volume}".encode()).hexdigest()
        name = f"<urn:uuid:{told[:8]}-{told[8:12]}-5{told[13:16]}-8{told[17:20]}-{told[20:32]}>"
        day = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return f"WARC/1.1{_CRLF}WARC-Type: warcinfo{_CRLF}WARC-Record-ID: {name}{_CRLF}WARC-Date: {day}{_CRLF}Content-Type: application/warc-fields{_CRLF}Content-Length: {len(about)}{_CRLF * 2}".encode() + about

    def member(record: bytes) -> bytes:
        data = record + (_CRLF * 2).encode()
        if not compressed:
            return data[:-1]
        data = gzip.compress(data, 6, mtime=0)
        # the last byte is the length's highest: zero but for large records, which an empty member follows
        return (data if data[-1] == 0 else data + gzip.compress(b"", mtime=0))[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, volume, held = TaskContext.get().partitionId(), -1, FILE_BYTES
        for batch in batches:
            for part in slices(iter([batch]), "record", _BATCH_BYTES):
                out = []
                for record in raw(part.column("record")):
                    if held >= FILE_BYTES:
                        volume, held = volume + 1, 0
                        out.append((volume, member(info(task, volume))))
                    out.append((volume, member(record)))
                    held += len(out[-1][1])
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], names=["volume", "member"])

    return run


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Files volume=*/*.warc.gz (or .warc, for compression "none") of whole records."""
    spark, compressed = records.sparkSession, compression == "gzip"
    bounded_batches(spark)
    packed = records.select("record").mapInArrow(_packed(compressed), "volume int, member binary")
    lines = packed.select("volume", F.col("member").cast("string").alias("value"))
    lines.write.partitionBy("volume").option("lineSep", "\0" if compressed else "\n").option("compression", "none").text(folder)
    jvm, of = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = of.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "volume=*/part-*.txt")) or ()
    for path in [f.getPath() for f in found]:
        files.rename(path, jvm.org.apache.hadoop.fs.Path(path.getParent(), path.getName().removesuffix(".txt") + (".warc.gz" if compressed else ".warc")))


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record of a file, compressed or not; names in lower case."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))

    def fields(read) -> dict[str, str]:
        out = {}
        while line := read.readline().strip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            out[name.lower()] = value.strip(" ")
        return out

    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {version[:40]!r}")
        warc = fields(stream)
        n = int(warc["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut off")
        inner = io.BytesIO(block)
        inner.readline()
        yield warc, fields(inner), inner.read()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an archive folder: page_id, url, record_type, payload_bytes and payload_digest (of the full payload), refers_to, payload (null for revisits).

    Files are read whole and may be compressed or not; a payload that does not
    match its digest and a record that is cut off raise. A folder without
    records gives no rows; records that repeat are rows each; a record without
    a page or url has null there.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    names = [n for n, _ in kinds]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column("content"):
                rows, held = [], 0
                for warc, http, payload in parse_warc(content.as_py()):
                    if warc["warc-type"] == "warcinfo":
                        continue
                    again = warc["warc-type"] == "revisit"
                    number = lambda name, warc=warc: int(warc[name]) if name in warc else None
                    told = warc["warc-payload-digest"].removeprefix("sha256:")
                    if not again and hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
                    size = int(http["content-length"]) if again else len(payload)
                    rows.append((number("x-page-id"), warc.get("warc-target-uri"), warc["warc-type"], size, told, number("x-refers-to-page"), None if again else payload))
                    held += len(payload)
                    if held > _BATCH_BYTES or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("content")
    return found.mapInArrow(run, schema)


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS n, sha256(html) AS digest FROM p),
r AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
    first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS original
  FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN original END AS refers_to
FROM r
"""
