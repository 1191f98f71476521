"""Web archives: writing, reading, and putting segmented records together again."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelfold.llm.shared import flipped

VERSION = "WARC/1.1"
END = "\r\n\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 5000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, record_type string, headers map<string,string>, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked framing."""
    out = bytearray()
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += b"%x\r\n" % len(part) + part + b"\r\n"
    return bytes(out + b"0\r\n\r\n")


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, a broken frame is an error."""
    out, at = bytearray(), 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return bytes(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out += body[at:at + size]
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, without its framing."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no end of the HTTP head")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block


def _line(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.split())


def page_records(page_id: int | None, url: str | None, payload: bytes, original: int | None, record_id: str,
                 segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """Records of one page: a revisit if ``original`` names another page, else a response in as many segments as it needs."""
    name = f"<{record_id}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _line(url or "")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if page_id is not None:
        common.append(("Page-Id", str(page_id)))
    if original is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE),
                         ("Page-Refers-To", str(original)), ("Content-Type", "application/http; msgtype=response")], block)]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(payload, chunk_bytes))
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    out = []
    for n, i in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[i:i + segment_bytes]
        if n == 1:
            fields = [*first, ("WARC-Segment-Number", "1")]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{n}')}>"),
                      ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n))]
            if i + segment_bytes >= len(block):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(fields, part))
    return out


def _records(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, payload, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{n}/{page_id}/{url}')}"
                n += 1
                out += page_records(page_id, url, payload, original, record_id, segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return run


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, original): original is the page to refer to, null for responses.

    Of equal payloads of at least ``least_bytes`` the largest identifier is the
    response.  A null payload is empty; a page without an identifier is always
    a response, and rows that repeat the response's identifier are responses
    too.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    sums = rows.withColumn("sha", F.sha1("payload"))
    kind = sums.schema["sha"].dataType
    # only payloads that occur more than once have a row; combined before the shuffle
    shared = (sums.where(F.octet_length("payload") >= least_bytes).groupBy("sha")
              .agg(F.max("page_id").alias("largest"), F.min("page_id").alias("least")).where("least < largest")
              .select(flipped("sha", kind).alias("k"), "largest"))
    return sums.withColumn("k", flipped("sha", kind)).join(shared, "k", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("original"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one WARC record per row, long ones in segments, as compressed archives below ``path``.

    Spark's committed text output writes the records, with their closing line
    ends as the separator, to any store that Spark writes; a lost executor
    leaves no half file behind.  An empty table leaves archives without records.
    Other columns are not looked at.
    """
    rows = with_originals(pages, id_col, url_col, body_col, least_bytes)
    records = rows.mapInArrow(_records(segment_bytes, chunk_bytes), "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END)
     .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _lines(stream: io.BufferedReader) -> Iterator[str]:
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        yield line.decode("utf-8", "replace").rstrip("\r\n")


class _Inflate(io.RawIOBase):
    """A gzip stream of one or more members, inflated piece by piece."""

    def __init__(self, content: bytes):
        self.content, self.at, self.ready = memoryview(content), 0, b""
        self.inflater = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.ready and self.at < len(self.content):
            self.ready = self.inflater.decompress(self.content[self.at:self.at + (1 << 16)])
            self.at += 1 << 16
            if self.inflater.eof:
                self.at -= len(self.inflater.unused_data) + max(0, self.at - len(self.content))
                self.inflater = zlib.decompressobj(31)
        n = min(len(out), len(self.ready))
        out[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record; a cut-off record is an error."""
    raw = _Inflate(content) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    stream = io.BufferedReader(raw, 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        fields = dict(h.split(":", 1) for h in _lines(stream) if ":" in h)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("record is cut off")
        yield fields, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["record_id", "record_type", "headers", "block"])

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for fields, block in parse_archive(content.as_py()):
                rows.append((fields.get("warc-record-id"), fields.get("warc-type"), list(fields.items()), block))
                size += len(block)
                if size > 8 << 20 or len(rows) >= 2000:
                    yield emit(rows)
                    rows, size = [], 0
            if rows:
                yield emit(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: (record_id, record_type, headers, block), read by their content lengths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: (record_id, record_type, headers, block, complete).

    Records without a segment number pass as they are.  Continuations are
    grouped by the identifier of their origin and ordered by number; a number
    that repeats counts once.  A record is complete if the numbers run from 1
    without a gap, the last segment states the total length, and the lengths
    add up to it; otherwise, also where the first segment is missing, ``block``
    is null.  No records give no rows.
    """
    number = F.try_element_at("headers", F.lit("warc-segment-number")).cast("int")
    total = F.try_element_at("headers", F.lit("warc-segment-total-length")).cast("long")
    origin = F.coalesce(F.try_element_at("headers", F.lit("warc-segment-origin-id")), F.col("record_id"))
    whole = records.where(number.isNull()).select("record_id", "record_type", "headers", "block", F.lit(True).alias("complete"))
    parts = records.where(number.isNotNull()).select(
        origin.alias("origin"), number.alias("n"), total.alias("total"), "record_type", "headers", "block")
    once = parts.groupBy("origin", "n").agg(F.max("total").alias("total"), F.min_by(F.struct(
        "record_type", F.map_entries("headers").alias("headers"), "block"), "record_type").alias("p"))
    joined = once.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("n", "total", "p"))).alias("s"))
    last = F.element_at("s", -1)
    blocks = F.col("s.p.block")
    size = F.aggregate(F.transform(blocks, F.octet_length), F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.element_at("s", 1)
    complete = ((first["n"] == 1) & (last["n"] == F.size("s")) & (F.coalesce(last["total"], F.lit(-1)) == size))
    # ordered segments joined as hexadecimal text, which is the one built-in concatenation of an array of bytes
    body = F.unhex(F.array_join(F.transform(blocks, F.hex), ""))
    return whole.union(joined.select(
        F.col("origin").alias("record_id"),
        F.when(first["n"] == 1, first["p"]["record_type"]).alias("record_type"),
        F.map_from_entries(first["p"]["headers"]).alias("headers"),
        F.when(complete, body).alias("block"), complete.alias("complete")))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, sums, bodies = [], [], []
        for kind, block in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            body = http_payload(block) if block is not None and kind in ("response", "revisit") else None
            if kind == "revisit" and body is not None:
                fields = dict(h.split(b":", 1) for h in block.lower().split(b"\r\n") if b":" in h)
                size.append(int(fields[b"content-length"]))
                sums.append(None)
                bodies.append(None)
            else:
                size.append(None if body is None else len(body))
                sums.append(None if body is None else digest(body))
                bodies.append(body)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(bodies, pa.binary()), pa.array(size, pa.int64()),
             pa.array(sums, pa.string())], names=["record_id", "record_type", "headers", "payload", "bytes", "sum"])


def payloads(records: DataFrame) -> DataFrame:
    """Decoded payloads of whole records: (record_id, record_type, headers, payload, payload_bytes, payload_digest).

    Transfer framing is removed.  A revisit has no payload of its own; its size
    and digest are those its record states.  A response whose payload does not
    have the digest that its record states is an error.  An incomplete record has
    no payload, and neither size nor digest, whatever it states.
    """
    kind = "record_id string, record_type string, headers map<string,string>, payload binary, bytes long, sum string"
    rows = records.select("record_id", "record_type", "headers", "block").mapInArrow(_payloads, kind)
    stated = F.substring_index(F.try_element_at("headers", F.lit("warc-payload-digest")), ":", -1)
    checked = F.when(F.col("sum") != stated, F.raise_error(F.concat(F.lit("payload digest differs: "), "record_id"))).when(
        F.col("bytes").isNotNull(), F.coalesce("sum", stated))
    return rows.select("record_id", "record_type", "headers", "payload", F.col("bytes").alias("payload_bytes"),
                       checked.alias("payload_digest"))


def header(name: str, kind: str = "long"):
    return F.try_element_at("headers", F.lit(name)).cast(kind)
