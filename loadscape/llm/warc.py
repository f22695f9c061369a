"""WARC archives written and read by Spark tasks.

Writing: each task appends gzip members, one a record, to an archive of its own in the shared folder; a file counts
only if its task was committed, so a task that runs again leaves nothing to be read twice. A payload that repeats
is stored once, as a response; the others are revisits that refer to it.

Reading is splittable: a task gets a byte range, looks for the gzip magic from its start, takes a candidate for a
member only if it inflates to a WARC header and to its end with a right checksum, and then goes on from member to
member. It owns the records that start inside its range and reads past the range's end to finish the last.

Defined results: a null html is an empty payload; payloads under MIN_BYTES are always responses; rows that share
page_id and payload are each written, and those with the largest page_id of a group are all responses; a null
page_id is never the largest, and a group that has no other is all responses; a null url is a record without a target;
blanks and control characters leave a url, as a header line can't hold them; a payload of any length is one record, held
by one task; a response whose payload does not have the length and digest of its header is an error; no pages give no
archives and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.llm.common import kept, shared_dir

MIN_BYTES, RANGE_BYTES, LEVEL = 1000, 4 << 20, 4
DATE = "2024-01-01T00:00:00Z"
MAGIC, _READ, _STEP = b"\x1f\x8b\x08", 1 << 18, 1 << 15
FILES = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(place: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(place)


def _located(spark: SparkSession, place: str) -> str:
    """The folder with its scheme: what Spark takes a path without one to be, so that its tables and the archives share a file system."""
    if "://" not in place:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        place = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return place.replace("file:/", "file:///", 1) if place.startswith("file:/") and not place.startswith("file://") else place


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """One gzip member. response_id: the page that holds the payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response_id is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {''.join(c for c in url if c > ' ')}")
    if response_id is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response_id)}", f"X-Refers-To-Page-Id: {response_id}"]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def decode_record(raw: bytes) -> tuple:
    """A row of RECORDS from an inflated member."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("X-Refers-To-Page-Id"), length, base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), payload


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and response_id: for a revisit the page that holds its payload."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # The groups are counted before any page is moved, and only the repeated ones are joined to the pages.
    repeated = (
        pages.select("page_id", F.encode(F.col("html"), "UTF-8").alias("payload"))
        .filter(F.octet_length("payload") >= MIN_BYTES)
        .groupBy(F.sha2("payload", 256).alias("same"))
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # small payloads have no key and take no part in the join
    small = F.octet_length("payload") < MIN_BYTES
    revisit = ~F.coalesce(F.col("page_id") == F.col("largest"), F.lit(False))
    joined = rows.filter(~small).withColumn("same", F.sha2("payload", 256)).join(repeated, "same", "left")
    alone = rows.filter(small).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("response_id"))
    return alone.unionByName(joined.select("page_id", "url", "payload", "digest", F.when(F.col("largest").isNotNull() & revisit, F.col("largest")).cast("long").alias("response_id")))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; path, bytes and records of each."""

    folder = _located(pages.sparkSession, folder)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        path = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "response_id"))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                member = encode_record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return with_responses(pages).mapInArrow(archive, FILES)


def _inflated(source, at: int, size: int, held: memoryview) -> tuple[bytes, int] | None:
    """Content and length of the member at an offset of a file, of which the first bytes are held; None if there is none. Nothing is held twice."""
    inflate, out, head, fed = zlib.decompressobj(31), [], b"", 0
    while not inflate.eof:
        piece = held[fed : fed + _STEP]
        if not len(piece):
            source.seek(at + fed)
            piece = source.read(min(_READ, size - at - fed))
            if not piece:
                return None
        try:
            got = inflate.decompress(piece)
        except zlib.error:
            return None
        fed += len(piece)
        out.append(got)
        head += got[: 7 - len(head)]
        if len(head) == 7 and head != b"WARC/1.":
            return None
    return (b"".join(out), fed - len(inflate.unused_data)) if len(head) == 7 else None


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the members that start in [start, end) of an open file."""
    at, base, data = start, start, b""  # data: the file's bytes from base on
    while at < min(end, size - 2):
        if at + 3 > base + len(data):
            source.seek(at)
            data, base = source.read(min(_READ, size - at)), at
        hit = data.find(MAGIC, at - base)
        if hit < 0:
            at = base + max(1, len(data) - 2)
            continue
        at = base + hit
        if at >= end:
            return
        found = _inflated(source, at, size, memoryview(data)[hit:])
        if found:
            yield at, found[0]
        at += found[1] if found else 1


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, end, bytes of the byte ranges that cover the files."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    return files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))


def read(spark: SparkSession, files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives; payload is null unless asked for."""

    folder = _located(spark, folder)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, size, start, end in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "start", "end"))):
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for _, raw in members(source, start, end, size):
                        row = decode_record(raw)
                        if row[2] == "response" and (len(row[6]), sha1_hex(row[6])) != row[4:6]:
                            raise ValueError(f"the payload of page {row[0]} in {path} is not what its header says")
                        rows.append(row if payloads else (*row[:6], None))
                        held += len(raw)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    todo = ranges(files, range_bytes)
    n = max(1, todo.count())
    return todo.repartition(min(n, 100_000)).mapInArrow(scan, RECORDS)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives and return what the archives hold, without the payloads."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = kept(write(pages, folder), "warc-files")
    return read(spark, files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def sha1_hex(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()
