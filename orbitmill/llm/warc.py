"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

The dictionary is trained on a bounded sample of the records to be archived
(about ``SAMPLE`` pages chosen by a hash, twice as many at most, of at most
``SAMPLE_BYTES`` each). Every archive begins with a skippable frame (magic 0x184D2A5D) that holds
the dictionary, itself compressed; each record is one frame after it. Pages are
written where they lie: a task writes its pages to archives of about
``ARCHIVE_BYTES`` of payload in the shared scratch folder, under names of its
own attempt, and its rows name them; Spark commits those rows, so what a lost
or repeated attempt has left is never read.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the largest page_id is a response, the others revisit it. Equal payloads are
found by SHA-1 and length.

Defined results: null html is an empty payload; a null URL leaves the target
field out; a null page_id revisits where any equal page has an id, and is a
response otherwise; rows that repeat the largest page_id with the same payload
are all responses; an empty table writes no archive and gives no rows. Other
columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from .shared import Scratch, materialise, utf8

MAGIC = 0x184D2A5D
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE = 256
SAMPLE_BYTES = 1 << 17
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _field(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to given) holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; of a response the payload's own length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    if fields["WARC-Type"] == "response":
        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": whole("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": whole("X-Refers-To-Page-ID"),
    }


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; of too few or too small ones, their bytes as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(dictionary: bytes) -> bytes:
    held = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", MAGIC, len(held)) + held


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there, also by the names that Spark has for object stores."""
    scheme, sep, rest = folder.partition("://")
    name = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gcs": "gs"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{name}{sep}{rest}")


def _write(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root)
        task = TaskContext.get()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        first = leading_frame(dictionary)
        out, size, n, names, counts = None, 0, 0, [], []
        for batch in batches:
            for page_id, url, html, response in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                        counts.append(n)
                    names.append(f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.zst")
                    out, size, n = store.open_output_stream(names[-1], compression=None), 0, 0
                    out.write(first)
                payload, own, to = html.as_py(), page_id.as_py(), response.as_py()
                out.write(pack.compress(record(own, url.as_py(), payload, to if to != own else None)))
                size, n = size + len(payload), n + 1
        if out is not None:
            out.close()
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["path", "n_records"])

    return run


def frames(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive, read in chunks; the dictionary comes from its first frame."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(source.read(size))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = source.read(chunk)
    while data:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else source.read(chunk)
        yield b"".join(parts)
        data = data or source.read(chunk)


def _read(folder: str, batch_rows: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        names = RECORDS.replace(" long", "").replace(" string", "").split(", ")
        kinds = [pa.int64() if " long" in c else pa.string() for c in RECORDS.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    rows = []
                    for data in frames(source):
                        rows.append(parse(data))
                        del rows[-1]["payload"]
                        if len(rows) == batch_rows:
                            yield make(rows)
                            rows = []
                    yield make(rows)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives below ``folder`` and returns their names (path, n_records), committed by Spark."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    n = F.octet_length("html")
    # about SAMPLE pages below a cut of their hashes; the limit holds where many are alike
    cut = F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, own.count()))) < SAMPLE
    sample = own.where((n <= SAMPLE_BYTES) & cut).limit(2 * SAMPLE).collect()
    dictionary = train([record(r["page_id"], r["url"], bytes(r["html"]), None) for r in sample]).as_bytes()
    keyed = own.withColumn("digest", F.when(n >= REVISIT_BYTES, F.concat(F.sha1("html"), n.cast("string"))))
    repeated = keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and response is not null")
    # a table of its own, so that the copies of a page can be split among join tasks
    judged = keyed.join(written(repeated.select("digest", "response"), f"{folder}/repeated"), "digest", "left").select("page_id", "url", "html", "response")
    names = judged.mapInArrow(_write(f"{folder}/archives", dictionary), "path string, n_records long").where("path is not null")
    names.write.parquet(f"{folder}/names")
    return spark.read.schema("path string, n_records long").parquet(f"{folder}/names")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """The records of the archives named: RECORDS."""
    spread = names.select("path").repartition(max(1, min(10_000, names.count())), "path")
    return spread.mapInArrow(_read(folder), RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to as read from the archives written, which are then deleted."""
    with Scratch(pages.sparkSession) as scratch:
        folder = scratch.folder("warc")
        read = read_archives(write_archives(pages, folder), folder)
        return materialise(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")


ORACLE = f"""
WITH r AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, max(page_id) AS response FROM r WHERE strlen(h) >= {REVISIT_BYTES} GROUP BY h HAVING count(*) > 1)
SELECT r.page_id, CAST(strlen(r.h) AS BIGINT) AS payload_bytes, sha1(r.h) AS payload_digest,
       CASE WHEN f.response IS NULL OR f.response = r.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.response <> r.page_id THEN f.response END AS refers_to
FROM r LEFT JOIN f ON r.h = f.h
"""
