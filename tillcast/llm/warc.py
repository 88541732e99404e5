"""WARC archives: a writer, and a sequential reader that verifies what it reads.

Every record is one gzip member.  Archives are written with Spark's text writer, so they go to any store that
Spark reaches and a lost task leaves nothing behind; they are plain files of gzip members (part files named
.txt).  The writer ends each row with a line separator of one zero byte; a gzip member ends with its length in
little-endian order, whose last byte is zero below 16 MiB, so the separator stands in for that byte (a longer
record is followed by an empty member).  Archives are cut at ARCHIVE_CHUNKS chunks of CHUNK_BYTES.

The reader decompresses incrementally, takes each block by its Content-Length, and checks block and payload
digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.common import materialize
from tillcast.session import shared_folder

CHUNK_BYTES = 4 << 20
ARCHIVE_CHUNKS = 4
#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 1000
LEVEL = 4
FEED = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of ``refers_to`` without it."""
    digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url) if url else 'urn:x-unknown'}", f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


_EMPTY_MEMBER = (lambda z: z.flush())(zlib.compressobj(LEVEL, zlib.DEFLATED, 31))


def _chunk(members: list[bytes]) -> bytes:
    data = b"".join(members)
    return (data if data[-1] == 0 else data + _EMPTY_MEMBER)[:-1]


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): null payloads are empty; refers_to is set for revisits.

    Among equal payloads of at least REVISIT_BYTES bytes the largest id is written in full and the others
    revisit it.  A null id is below all others; if ids repeat, every row with the largest one is written in
    full.  Payloads are compared by SHA-1, length and a second hash.  The table of repeated payloads is
    counted with map-side combining; Spark broadcasts it only below its size threshold."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    key = ["sha1", "len", "xx"]
    p = p.withColumns({"sha1": F.sha1("payload"), "len": F.octet_length("payload"), "xx": F.xxhash64("payload")})
    full = (p.where(F.col("len") >= REVISIT_BYTES).groupBy(*key)
            .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL").drop("n"))
    full = materialize(full, "repeated")
    revisit = F.when(F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))), F.col("last"))
    return p.join(full, key, "left").select("page_id", "url", "payload", revisit.alias("refers_to"))


def write(recs: DataFrame, path: str) -> str:
    """Write (page_id, url, payload, refers_to) as archives into the new folder ``path``; an empty table gives none."""

    def pack(batches):
        todo, size = [], 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(i).to_pylist() for i in range(4))):
                todo.append(member(page_id, url, payload, refers_to))
                size += len(todo[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([_chunk(todo)], pa.binary())], ["chunk"])
                    todo, size = [], 0
        if todo:
            yield pa.RecordBatch.from_arrays([pa.array([_chunk(todo)], pa.binary())], ["chunk"])

    chunks = recs.select("page_id", "url", "payload", "refers_to").mapInArrow(pack, "chunk binary")
    (chunks.select(F.col("chunk").cast("string").alias("value")).write
     .option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", ARCHIVE_CHUNKS).text(path))
    return path


class Reader:
    """Records of one archive, in order: (headers, block).  Holds one record and FEED bytes of input at a time."""

    def __init__(self, data):
        self._data, self._at = memoryview(data), 0

    def _member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if self._at >= len(self._data):
                raise ValueError("archive ends inside a gzip member")
            feed = self._data[self._at : self._at + FEED]
            out = z.decompress(feed)
            self._at += len(feed) - len(z.unused_data)
            if out:
                yield out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self._at < len(self._data):
            start, parts, buf = self._at, self._member(), bytearray()
            for out in parts:
                buf += out
                if b"\r\n\r\n" in buf:
                    break
            if not buf:
                continue  # an empty member
            head, found, rest = bytes(buf).partition(b"\r\n\r\n")
            if not found or not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC header in the member at byte {start}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            length = int(headers["content-length"])
            block = bytearray(rest)
            for out in parts:
                block += out
                if len(block) > length + 4:
                    raise ValueError(f"the record at byte {start} is longer than its Content-Length")
            if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {start} does not end where its Content-Length says")
            yield headers, bytes(block[:length])


def _same(stated: str | None, data: bytes) -> bool:
    return stated is None or stated == _sha1(data)


SCHEMA = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, verified boolean")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``path`` (see SCHEMA); an empty folder gives no rows.

    ``payload`` is null for revisits and where ``payloads`` is False.  A response's length and digest are those of
    the body that was read; a revisit has none, so they are what it states (see ``resolved``).  ``verified`` says
    that all stated lengths and digests hold.  Broken framing raises."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for h, block in Reader(b.column(0)[i].as_buffer()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    revisit = h["warc-type"] == "revisit"
                    ok = _same(h.get("warc-block-digest"), block) and (revisit or _same(h.get("warc-payload-digest"), body))
                    stated = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    digest, length = (stated, int(lengths[0]) if lengths else 0) if revisit else (hashlib.sha1(body).hexdigest(), len(body))
                    ok = ok and (revisit or not lengths or int(lengths[0]) == len(body))
                    page, to = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    rows.append((page and int(page), h.get("warc-target-uri"), body if payloads and not revisit else None,
                                 length, digest, h["warc-type"], to and int(to), ok))
                    size += len(body) if payloads else 0
                    if size > CHUNK_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, SCHEMA)


def resolved(rows: DataFrame) -> DataFrame:
    """``rows`` (written, see ``read``) where revisits take length and digest from the response that they refer to.

    A revisit is verified only if a verified response of that page has the digest that it states.  Only
    responses that are referred to meet the revisits; Spark broadcasts them below its size threshold."""
    revisit = F.col("record_type") == "revisit"
    wanted = rows.where(revisit).select(F.col("refers_to").alias("page_id")).distinct()
    full = rows.where(~revisit).join(wanted, "page_id", "left_semi").where("verified").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    full = full.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "_bytes")
    back = rows.where(revisit).join(full, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    back = back.withColumns({"verified": F.col("verified") & F.col("_bytes").isNotNull() & (F.col("payload_bytes") == F.coalesce("_bytes", F.lit(-1))),
                             "payload_bytes": F.coalesce("_bytes", "payload_bytes"), "payload_digest": F.coalesce("_digest", "payload_digest")})
    return rows.where(~revisit).unionByName(back.select(rows.columns))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back (see ``read``, without payloads)."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
    return resolved(materialize(read(spark, write(records(pages), path), payloads=False).drop("payload"), "warc-rows"))


OP10_SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < last THEN last END AS refers_to, TRUE AS verified
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
