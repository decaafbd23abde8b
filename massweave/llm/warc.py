"""WARC archives: one transaction for each page, written, read back and assembled.

A capture is a request, a response (or a revisit of an equal payload) and a metadata
record.  Request and metadata name the response in WARC-Concurrent-To, a revisit
names the response that it repeats in WARC-Refers-To.  Archives are written by
Spark's text writer with the record terminator as line separator, so they can be in
any store that Spark writes, and are read by Spark's binary reader, record by record
along their Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, drop, few, materialise, new_path, ship

END = "\r\n\r\n"
#: Pages in one archive file at most, and bytes of the payloads of pages that share a file with so many others: a reader
#: holds a file, which so has some 256 MB at most (a larger page alone has one of its own).
FILE_PAGES, SHORT_PAGE = 1000, 1 << 18
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_head string, fields string, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _staged(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """_id, _url, _html, _digest, _bytes and the number _row of each page, as a written table: all uses see the same numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_buffer() or b"") if x.is_valid else b"" for x in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(x) for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64())], ["_id", "_url", "_html", "_digest", "_bytes"])

    kind = pages.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html")]
    out = pages.select(*cols).mapInArrow(run, f"_id {kind}, _url string, _html string, _digest string, _bytes bigint")
    return materialise(out.withColumn("_row", F.monotonically_increasing_id()), "staged")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Write the archives of ``pages`` under ``path``.

    Of the pages with equal payloads of at least ``min_bytes`` bytes that with the
    smallest id is a response and the others are revisits; a null payload is empty.  Null
    ids come after all others, and of rows that repeat the smallest id one is the response.
    """
    spark = pages.sparkSession
    ship(spark)
    a = _staged(pages, id_col, url_col, html_col)
    first = a.where(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_row")).alias("f"))
    # Only payloads that occur twice need their first page; the others are responses.
    first = materialise(first.join(a.groupBy("_digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "_digest").select("_digest", F.col("f._id").alias("_first"), F.col("f._row").alias("_frow")), "first")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [transaction(*x) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    long = a.agg(F.max("_bytes")).first()[0] or 0
    for k, (which, n) in enumerate(((F.col("_bytes") <= SHORT_PAGE, FILE_PAGES), (F.col("_bytes") > SHORT_PAGE, max(1, FILE_PAGES * SHORT_PAGE // max(long, 1))))):
        if k and long <= SHORT_PAGE:
            break
        rows = a.where(which).join(few(first), "_digest", "left")
        repeats = F.col("_frow").isNotNull() & (F.col("_frow") != F.col("_row")) & (F.col("_bytes") >= min_bytes)
        rows = rows.select("_id", "_row", "_url", "_html", "_bytes", "_digest", F.when(repeats, F.col("_first")).alias("_first"), F.when(repeats, F.col("_frow")).alias("_frow"))
        (
            rows.mapInArrow(records, "value string").write.mode("append").option("lineSep", END)
            .option("compression", "gzip")
            .option("zlib.compress.level", "BEST_SPEED")
            .option("maxRecordsPerFile", n)
            .text(path)
        )
    drop(a, first)


def record_id(kind: str, page: object, row: int) -> str:
    """A stable record id: a name-based UUID of record type, page id and number of the row."""
    h = hashlib.sha1(f"{kind}/{row}/{page}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _line(text: str | None) -> str:
    """A header value: control characters would end the line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text or "")


def transaction(page: object, row: int, url: str | None, body: str | None, size: int, dig: str, first: object, first_row: int | None) -> str:
    """The three records of a page, joined by the record terminator; a ``first_row`` makes it a revisit."""
    date, uri, body = "2024-01-01T00:00:00Z", _line(url), body or ""
    resp, req, meta = (record_id(k, page, row) for k in ("response", "request", "metadata"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    common = f"WARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\n"
    n_http = len(http)
    if first_row is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        main = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {resp}\r\n{common}WARC-Profile: {profile}\r\nWARC-Refers-To: {record_id('response', first, first_row)}\r\nWARC-Payload-Digest: sha1:{dig}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {n_http}\r\n\r\n{http}"
    else:
        main = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {resp}\r\n{common}WARC-Payload-Digest: sha1:{dig}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {n_http + size}\r\n\r\n{http}{body}"
    ask = f"GET {uri} HTTP/1.1\r\n\r\n"
    fields = ("" if page is None else f"page-id: {quote(str(page), safe='')}\r\n") + f"fetch-bytes: {size}\r\n"
    request = f"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: {req}\r\n{common}WARC-Concurrent-To: {resp}\r\nContent-Type: application/http;msgtype=request\r\nContent-Length: {len(ask.encode('utf-8', 'surrogatepass'))}\r\n\r\n{ask}"
    metadata = f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: {meta}\r\n{common}WARC-Concurrent-To: {resp}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n{fields}"
    return END.join((request, main, metadata))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record, along the Content-Length headers."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        for line in iter(stream.readline, b""):
            if line in (b"\r\n", b"\n"):
                break
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield head, block


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path`` (plain or gzip); schema ``RECORD`` plus payload_bytes.

    Without ``payloads`` only the lengths and digests of the payloads leave the reader.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 8 + [pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(cols[:9], kinds, strict=True)] + [pa.array(cols[9], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [*names, "payload_bytes"])

        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                stream = io.BytesIO(raw)
                if bytes(raw[:2]) == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                rows, held = [], 0
                for h, block in parse(stream):
                    kind, http, fields, body = h["warc-type"], None, None, None
                    if kind in ("response", "revisit", "request"):
                        top, _, body = block.partition(b"\r\n\r\n")
                        http = top.decode("utf-8", "replace")
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    dig = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    if kind == "response":
                        found = digest(body)
                        if dig is not None and found != dig:
                            raise ValueError(f"payload of {h.get('warc-record-id')} differs from its digest")
                        dig = found
                    n = len(body) if kind == "response" else None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), dig, http, fields, body if payloads and kind == "response" else None, n))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload_bytes bigint")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response or revisit, with request and metadata that are concurrent to it.

    Records that name no response of the archives, and responses without a partner,
    give rows with nulls for what is missing only on the side of the partners.
    """
    main = records.where(F.col("warc_type").isin("response", "revisit")).select(
        F.col("record_id").alias("_r"), F.struct("warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "http_head", "payload").alias("capture")
    )
    # Partners carry small fields only; each kind occurs once per capture.
    part = lambda kind, *cols: F.max(F.when(F.col("warc_type") == kind, F.struct(*cols)))
    near = (
        records.where(F.col("warc_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("_c"))
        .agg(part("request", "record_id", "target_uri", "http_head").alias("request"), part("metadata", "record_id", "fields").alias("metadata"))
    )
    return main.join(near, F.col("_r") == F.col("_c"), "left").select("capture", "request", "metadata")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back, and report each capture.

    Per page: id, payload_bytes, payload_digest, record_type, refers_to (id of the
    response that a revisit repeats), n_records.  Every row gives one row, with its id, also
    where ids are null or repeated.  Null and empty payloads are equal.  Jobs run when this is called.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col, min_bytes)
    kind = pages.schema[id_col].dataType.simpleString()
    # A written table: the captures are read twice, the archives once.
    page = F.regexp_extract("metadata.fields", r"page-id: ([^\r]*)\r", 1)
    page = F.when(F.contains("metadata.fields", F.lit("page-id: ")), F.url_decode(page)).try_cast(kind)
    size = F.regexp_extract("metadata.fields", r"fetch-bytes: (\d+)", 1).cast("long")
    got = assemble(read(spark, path, payloads=False)).select(
        page.alias("_id"),
        F.col("capture.warc_type").alias("_type"),
        F.col("capture.record_id").alias("_rid"),
        F.col("capture.refers_to").alias("_ref"),
        F.col("capture.payload_digest").alias("_digest"),
        F.col("capture.payload_bytes").alias("_bytes"),
        size.alias("_said"),
        (F.lit(1) + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")).cast("long").alias("_n"),
    )
    got = materialise(got, "captures")
    delete(spark, path)
    orig = got.where(F.col("_type") == "response").select(F.col("_rid").alias("_o"), F.col("_id").alias("_oid"), F.col("_bytes").alias("_obytes"))
    out = got.join(orig, F.col("_ref") == F.col("_o"), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("_bytes", "_obytes").alias("payload_bytes"),
        F.col("_digest").alias("payload_digest"),
        F.col("_type").alias("record_type"),
        F.col("_oid").alias("refers_to"),
        F.col("_n").alias("n_records"),
    )
