"""WARC archives: writing captures as records, reading records, and assembling them into transactions.

A capture is written as a response (or a revisit of an equal payload), its request and its metadata; the latter two
name the first in WARC-Concurrent-To.  Archives are plain WARC/1.1 inside gzip, of about ARCHIVE_BYTES before
compression, so reading one takes bounded memory.  Spark's own writer and reader move the files, so they can be in
any store that it reaches, and a lost task's files are never seen.

Assembly joins on the identifiers: a record belongs to the capture that its concurrent-to names, over a request if
that is what it names, and one nested row is given for each capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shelf import bounded_batches

#: Payloads below this are never written as revisits.
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_FIELDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def record_id(*parts: object) -> str:
    h = hashlib.md5("|".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, name: str, uri: str, block: bytes, content: str, **headers: str) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {uri}"] * bool(uri)
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    lines += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return b"".join((b"WARC/1.1\r\n", "\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


def _one_line(text: str) -> str:
    """A URL as it may stand in a header."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-4]], pa.binary())], names=["value"])  # the writer ends it

    for batch in batches:
        for page, url, payload, digest, turn, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            uri = _one_line(url or "")
            own = record_id("response", page, url, digest, turn)
            said = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            revisit = first is not None and (first, first_url, 1) != (page, url, turn)
            if not revisit:
                new = [record("response", own, uri, http + payload, "application/http;msgtype=response", WARC_Payload_Digest=said)]
            else:
                to = record_id("response", first, first_url, digest, 1)
                new = [record("revisit", own, uri, http, "application/http;msgtype=response", WARC_Payload_Digest=said, WARC_Profile=PROFILE, WARC_Refers_To=to)]
            host, _, path = uri.partition("://")[2].partition("/")
            ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
            new.append(record("request", record_id("request", own), uri, ask, "application/http;msgtype=request", WARC_Concurrent_To=own))
            fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page), ("refers-to-page-id", first if revisit else None)) if v is not None)
            new.append(record("metadata", record_id("metadata", own), uri, fields.encode(), "application/warc-fields", WARC_Concurrent_To=own))
            parts += new
            size += sum(map(len, new))
            if size >= ARCHIVE_BYTES:
                yield archive()
                parts, size = [], 0
    if parts:
        yield archive()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes every row as a capture into archives in the folder ``path``.

    A null payload or URL is empty.  Of captures with equal payloads of LEAST_REVISIT bytes or more, that with the
    largest id (then the largest URL) is the response and the others revisit it; where all their ids are null, all
    are responses.  Rows that repeat id, URL and payload are captures of their own, the first of which stands for them
    where another would be revisited.  An empty table writes no archive.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.where((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page").isNotNull()).groupBy("digest").agg(F.max(F.struct("page", "url")).alias("first"))
    again = rows.groupBy("page", "url", "digest").count().where("count > 1").drop("count")
    rows = rows.withColumn("turn", F.lit(1))
    if not again.isEmpty():  # rows that are all the same are counted, and so numbered without meeting in a task
        same = reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in again.columns))
        one = rows.alias("r").join(again.alias("a"), same, "left_semi").groupBy("page", "url", "payload", "digest").count()
        one = one.select("page", "url", "payload", "digest", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("turn"))
        rows = rows.alias("r").join(again.alias("a"), same, "left_anti").union(one)
    # a frequent payload is a hot key of this join, which adaptive execution splits; its other side has a row a payload
    rows = rows.join(first, "digest", "left").select("page", "url", "payload", "digest", "turn", "first.page", "first.url")
    rows = rows.toDF("page", "url", "payload", "digest", "turn", "first", "first_url")
    values = rows.mapInArrow(_archives, "value binary").select(F.col("value").cast("string"))
    values.write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not.

    An archive that is cut off or damaged gives the records before that place: one without the end of its headers, with
    no valid Content-Length or with fewer bytes than that is not given, nor is what follows it.
    """
    while data[:2] == b"\x1f\x8b":
        out, rest = [], data
        while rest[:2] == b"\x1f\x8b":  # one member or many
            z = zlib.decompressobj(31)
            try:
                out.append(z.decompress(rest))
            except zlib.error:
                break
            rest = z.unused_data
        data = b"".join(out)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or end + 4 + int(size) > len(data):
            return
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if c}


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type")
    fields, payload, size, digest = {}, None, None, None
    if "application/http" in headers.get("content-type", ""):
        head, _, body = block.partition(b"\r\n\r\n")
        first, _, rest = head.partition(b"\r\n")
        fields = {"": first.decode("utf-8", "replace")} | _fields(rest)
        if kind in ("response", "revisit"):
            said = headers.get("warc-payload-digest", "").partition(":")[2]
            if kind == "response":
                payload, size, digest = body, len(body), hashlib.sha1(body).hexdigest()
            else:
                size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
                digest = base64.b32decode(said).hex() if len(said) == 32 else said.lower() or None
    elif "application/warc-fields" in headers.get("content-type", ""):
        fields = _fields(block)
    else:
        payload, size = block, len(block)
    get = headers.get
    return (get("warc-record-id"), kind, get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), digest, size, list(fields.items()), payload)


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, as RECORD_FIELDS.

    payload is what a response holds after its HTTP head; payload_bytes and payload_digest (hexadecimal) are counted on
    it, and for a revisit taken from its heads, as its payload is not there.
    """
    bounded_batches(spark)
    names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(data.as_py()):
                    rows.append(_row(headers, block))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD_FIELDS)


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture_id, response, requests, metadata``, of rows with the columns of records().

    Columns may be left out (say the payload), but for record_id, type and concurrent_to.  A record that is there
    repeatedly counts once; requests and metadata are arrays in order of their identifiers; response is null where
    only records that name it are there.  Records of other types (warcinfo and the like) take no part.
    """
    rows = rows.where(F.col("type").isin("response", "revisit", "request", "metadata") & F.col("record_id").isNotNull())
    requests = rows.where("type = 'request' and concurrent_to is not null").select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("over")).distinct()
    metadata = rows.where("type = 'metadata'").join(requests, "concurrent_to", "left")
    others = rows.where("type <> 'metadata'").withColumn("over", F.lit(None).cast("string"))
    every = others.unionByName(metadata).withColumn("capture_id", F.coalesce("over", "concurrent_to", "record_id"))
    nested = F.struct(*[c for c in rows.columns if c != "concurrent_to"])
    every = every.select("capture_id", "type", nested.alias("r"))
    is_main = F.col("type").isin("response", "revisit")

    def several(kind: str):
        got = F.collect_list(F.when(F.col("type") == kind, F.col("r")))
        ids = F.transform(got, lambda x: x["record_id"])
        # a map keeps one of each identifier
        return F.map_from_arrays(F.array_sort(F.array_distinct(ids)), F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.get(got, F.array_position(ids, i).cast("int") - 1)))

    return every.groupBy("capture_id").agg(
        F.first(F.when(is_main, F.col("r")), ignorenulls=True).alias("response"),
        F.map_values(several("request")).alias("requests"),
        F.map_values(several("metadata")).alias("metadata"),
    )
