"""WARC archives: written with an index of every record, read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, salt_of, salted, shared_folder, written

REVISIT_BYTES = 1_000  # payloads below are always stored
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10  # unwanted bytes that are cheaper to read than to skip
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema(
    [
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
        ("payload_digest", pa.string()), ("record_type", pa.string()),
    ]
)
_INDEX_DDL = "archive string, offset long, length long, url string, payload_digest string, record_type string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder: local, HDFS or an object store."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _one_line(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the record it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{url}|{digest}')}>")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if key is not None:
        head.append(f"X-Record-Key: {_one_line(key)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {_one_line(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def decode_record(member: bytes) -> tuple[dict[str, str], bytes | None]:
    """Header fields and, for a response, the payload of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "revisit":
        return fields, None
    return fields, block.partition(b"\r\n\r\n")[2]


def _writer(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        files.create_dir(base, recursive=True)
        stream, name, offset = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
                for key, url, digest, refers, payload in zip(*columns, batch.column(2).to_pylist()):
                    if stream is None or offset >= archive_bytes:
                        if stream is not None:
                            stream.close()
                        # A new name for every attempt: only files that the stored index names count.
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = files.open_output_stream(f"{base}/{name}", compression=None)
                    member = encode_record(key, url, payload, digest, refers)
                    stream.write(member)
                    rows.append((name, offset, len(member), url, digest, "response" if refers is None else "revisit"))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), _INDEX.types)]
                    if rows else [pa.array([], kind) for kind in _INDEX.types],
                    schema=_INDEX,
                )
        finally:
            if stream is not None:
                stream.close()

    return run


def write_archives(
    pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row below ``root`` and return the stored index: ``archive, offset,
    length, url, payload_digest, record_type``, one row per record.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads of at least
    ``REVISIT_BYTES``, those with the largest id are responses and the others revisit it; if all ids
    are null, all are responses, and rows that repeat the largest id are all responses. Null URLs have
    no target line; line breaks in URLs are percent-coded. An empty table gives no files.

    Payloads that occur once never meet in a shuffle key; the copies of one payload are spread over
    salted keys, which hold one row each on the other side of the join.
    """
    ready(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    sized = rows.select("id", "digest", F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES)
    copied = (
        sized.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("id").alias("first"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "bytes", "first")
    )
    # Short payloads take part in no pair: their key is null.
    keyed = rows.withColumn("bytes", F.octet_length("payload")).withColumn("salt", salt_of("id", "url"))
    met = keyed.join(salted(copied).hint("shuffle_hash"), ["digest", "bytes", "salt"], "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).cast("string")
    return written(
        met.select(
            F.col("id").cast("string").alias("key"), "url", "payload", "digest",
            F.when(F.col("first").isNotNull(), refers).alias("refers"),
        ).mapInArrow(_writer(root, archive_bytes), _INDEX_DDL),
        "warc-index",
    )


_RECORD_DDL = (
    "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_key string, "
    "intact boolean, payload binary"
)


def _reader(root: str, with_payload: bool):
    def records(files, base, ranges):
        """Members of runs of (archive, offset, length) that are close together, one read for each run."""
        for archive, run in ranges:
            start, stop = run[0][0], run[-1][0] + run[-1][1]
            with files.open_input_file(f"{base}/{archive}") as file:
                data = file.read_at(stop - start, start)
            for offset, length in run:
                yield decode_record(data[offset - start : offset - start + length])

    def coalesced(rows):
        archive, run = None, []
        for name, offset, length in rows:
            end = run[-1][0] + run[-1][1] if run else 0
            if run and (name != archive or offset - end > GAP_BYTES or offset + length - run[0][0] > RANGE_BYTES):
                yield archive, run
                run = []
            archive = name
            run.append((offset, length))
        if run:
            yield archive, run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for one in coalesced(rows):
                out: list[list] = [[] for _ in range(8)]
                for fields, payload in records(files, base, [one]):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields["X-Payload-Length"])
                    intact = True
                    if payload is not None:
                        intact = len(payload) == size and hashlib.sha1(payload).hexdigest() == digest
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    values = (
                        fields.get("X-Record-Key"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"],
                        fields.get("X-Refers-To-Key"), intact, payload if with_payload else None,
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(out, kinds)],
                    [part.split(" ")[0] for part in _RECORD_DDL.split(", ")],
                )

    return run


def read_records(index: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Records of the selected index rows: ``key, url, payload_bytes, payload_digest, record_type,
    refers_key, intact, payload``.

    The selected rows are dealt by stretches of their archives and sorted, and neighbouring records
    come with one read of at most some megabytes. Digest and length of a response are those of the
    payload as read; ``intact`` tells whether they equal the stored ones. A revisit has no payload.
    """
    ready(index.sparkSession)
    placed = index.select("archive", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("stretch"))
    return (
        placed.repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
        .mapInArrow(_reader(root, with_payload), _RECORD_DDL)
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages, read all records back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    kind = dict(pages.select(F.col(id_col).alias("id")).dtypes)["id"]
    root = shared_folder(pages.sparkSession, "warc")
    index = write_archives(pages, root, id_col, url_col, payload_col)
    return read_records(index, root, with_payload=False).select(
        F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_key").cast(kind).alias("refers_to"),
    )
