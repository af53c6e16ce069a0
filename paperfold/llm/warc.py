"""WARC archives: written by many tasks, indexed first, then read by coalesced byte ranges.

``write`` turns page rows into archives, one file a task, each record a gzip member of its
own, and stores an index of (file, offset, length, url, digest, ...) as Parquet. ``read``
takes any selection of index rows, sorts it by file and offset, joins neighbouring ranges
into one read and yields the records.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the smallest
page id carries the payload (response); the others are revisits that name it.

Edge cases: a null html is an empty payload; a null url becomes an empty one; a null page id
never is the one referred to unless all of a group are null, in which case each row is a
response; rows that repeat the smallest page id all are responses; an empty table gives an
empty index; other columns are not read. A file is written under a name of the attempt and
renamed, so a lost or repeated task leaves no half archive in the index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.store import Stages, fresh

REVISIT_BYTES = 0
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
INDEX = ("file string, offset long, length long, url string, digest string, page_id long, "
         "record_type string, refers_to long")
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """The store that a folder's URI names, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record_bytes(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC/1.1 record with the HTTP head of its page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}",
            f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple:
    """(page id, url, payload length, digest, type, page referred to, payload) of a record.
    The payload of a response is checked against its digest."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("X-Page-ID"), fields["WARC-Target-URI"], int(said["Content-Length"]), digest,
            fields["WARC-Type"], number("X-Refers-To-Page-ID"), None if revisit else payload)


def write(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html",
          revisit_bytes: int = REVISIT_BYTES) -> tuple[DataFrame, str]:
    """Writes the archives; returns their index and their folder."""
    spark = pages.sparkSession
    stages = Stages(spark, "warc")
    rows = pages.select(pages[ident].cast("long").alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"),
                        F.coalesce(pages[html], F.lit("")).cast("binary").alias("payload"))
    # Only digests move; the payloads stay with their split.
    sizes = rows.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("bytes"))
    groups = (sizes.where(F.col("bytes") >= revisit_bytes).groupBy("sha")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL"))
    groups = stages.put("groups", groups.select("sha", "first"))
    folder = fresh(spark, "warc-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        store, top = filesystem(folder)
        store.create_dir(top, recursive=True)
        final = f"{top}/{uuid.uuid4().hex}.warc.gz"
        index: list[tuple] = []
        offset = 0
        with store.open_output_stream(f"{final}.part", compression=None) as out:
            while batch is not None:
                for page, target, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = payload or b""
                    digest = sha1_base32(payload)
                    revisit = first is not None and first != page
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = squeeze.compress(record_bytes(page, target, payload, digest, first, revisit)) + squeeze.flush()
                    out.write(data)
                    index.append((final.rpartition("/")[2], offset, len(data), target, digest, page,
                                  "revisit" if revisit else "response", first if revisit else None))
                    offset += len(data)
                batch = next(batches, None)
        store.move(f"{final}.part", final)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in INDEX.split(", ")]
        cols = list(zip(*index, strict=True)) if index else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    marked = (rows.withColumn("sha", F.sha1("payload")).join(groups, "sha", "left")
              .select("page_id", "url", "payload", F.when(F.length("payload") >= revisit_bytes, F.col("first")).alias("first")))
    return stages.put("index", marked.mapInArrow(run, INDEX)), folder


def read(index: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the index rows name. Rows are sorted by file and offset; ranges at
    most ``gap`` bytes apart share a read of at most ``most`` bytes (or one longer record)."""
    spots = index.select("file", "offset", "length")
    parts = max(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spots = spots.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        joined: list[tuple[str, int, int]] = []
        for batch in batches:
            for spot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if joined and (spot[0] != joined[-1][0] or spot[1] - joined[-1][1] - joined[-1][2] > gap
                               or spot[1] + spot[2] - joined[0][1] > most):
                    yield joined
                    joined = []
                joined.append(spot)
        if joined:
            yield joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        name, source = None, None
        for joined in ranges(batches):
            if joined[0][0] != name:
                if source is not None:
                    source.close()
                name = joined[0][0]
                source = store.open_input_file(f"{top}/{name}")
            source.seek(begin := joined[0][1])
            data = source.read(joined[-1][1] + joined[-1][2] - begin)
            found = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n in joined]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    return spots.mapInArrow(run, RECORD)
