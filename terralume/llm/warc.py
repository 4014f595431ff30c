"""WARC archives whose records are Zstandard frames with a dictionary in front.

Each archive file begins with a skippable frame that holds a dictionary built from the file's own
records; every record then is a frame of its own that needs this dictionary, so a record can be
read alone. A payload that was written before becomes a revisit record that refers to the response.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.session import materialize, shared_folder

from .common import dealt, get_file, put_file

SKIPPABLE = 0x184D2A5D  # fixed value: magic number of the frame that carries the dictionary
ARCHIVE_BYTES = 24 << 20  # records of an archive before compression; a longer record has its own archive
SAMPLE_BYTES = 1 << 20  # slices of records that a dictionary is built from, spread evenly over its archive
SLICE_BYTES = 4 << 10
FED_BYTES = 16 << 10  # bytes that a frame is fed at a time
DICTIONARY_BYTES = 48 << 10
LEVEL = 3


def marked(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``payload``, ``payload_sha1`` (hexadecimal) and ``refers_to``, the key of the response for revisits.

    Of rows with equal payloads of at least ``least`` bytes the smallest key is the response; payloads
    are equal when SHA-1 and length are. A row that repeats that key is a response too, as are rows
    with a null key.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.withColumns({"payload": payload, "payload_sha1": F.sha1(payload)})
    known = rows.where(F.octet_length("payload") >= least).select(
        F.col(f"`{key}`").alias("_key"), F.col("payload_sha1").alias("_digest"), F.octet_length("payload").alias("_size")
    )
    first = known.groupBy("_digest", "_size").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = known.join(first, ["_digest", "_size"]).where("_key > _first").select("_key", F.col("_digest").alias("_of"), F.col("_first").alias("refers_to")).distinct()
    found = rows.join(later, (rows[key] == later["_key"]) & (rows["payload_sha1"] == later["_of"]), "left")
    return found.select(*rows.columns, "refers_to")


def record_bytes(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The block is an HTTP answer; a revisit has its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def slices(records: list[bytes], most: int) -> list[bytes]:
    """Slices of about ``most`` bytes in all, evenly spaced over the whole of all records."""
    count = sum(-(-len(r) // SLICE_BYTES) for r in records)
    step = max(1, -(-count * SLICE_BYTES // most))
    cut = (r[k : k + SLICE_BYTES] for r in records for k in range(0, len(r), SLICE_BYTES))
    return list(itertools.islice(cut, 0, None, step))


def archive_bytes(records: list[bytes]) -> Iterator[bytes]:
    """An archive file: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    sample = slices(records, SAMPLE_BYTES)
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8)
    except zstandard.ZstdError:  # too few records to train from: the records themselves
        raw = b"".join(slices(records, DICTIONARY_BYTES))
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = dictionary.as_bytes()
    yield SKIPPABLE.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data
    dictionary.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=True).compress
    for record in records:
        yield compress(record)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive file."""
    import zstandard

    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary in front")
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    engine, rest = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(data)[8 + size :]
    while len(rest):
        # Fed in small runs: what lies behind a frame is copied when it ends.
        frame, parts = engine.decompressobj(), []
        while not frame.eof:
            if not len(rest):
                raise ValueError("a record is cut off")
            parts.append(frame.decompress(rest[:FED_BYTES]))
            rest = rest[min(FED_BYTES, len(rest)) - len(frame.unused_data) :]
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for each row and list the files: ``folder``, ``file``, ``records``, ``bytes``.

    A null payload is empty. Null keys and urls are written as empty. A repeated task writes the same
    files again; an empty table writes none. Other columns are ignored.
    """
    import uuid

    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = marked(pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")), "page", "html", least)
    rows = rows.select("page", "url", "payload", "payload_sha1", "refers_to").sortWithinPartitions("page", "payload_sha1")

    def work(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        number, held, records = 0, 0, []

        def close():
            nonlocal number, held
            size = 0

            def counted():
                nonlocal size
                for part in archive_bytes(records):
                    size += len(part)
                    yield part

            name = put_file(folder, f"{task.partitionId():06d}-{number:06d}.warc.zst", counted(), f"{task.taskAttemptId()}")
            row = dict(folder=folder, file=name, records=len(records), bytes=size)
            records.clear()
            number, held = number + 1, 0
            return row

        for frame in frames:
            done = []
            for row in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                records.append(record_bytes(*row))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    done.append(close())
            yield pa.RecordBatch.from_pylist(done, schema=LISTED)
        if records:
            yield pa.RecordBatch.from_pylist([close()], schema=LISTED)

    import pyarrow as pa

    LISTED = pa.schema([("folder", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return materialize(rows.mapInArrow(work, "folder string, file string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of each record, from the files.

    Size and digest of a response come from its payload, those of a revisit from its headers.
    """

    def number(urn: str) -> int | None:
        digits = urn[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def work(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            for folder, name in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                rows = []
                for fields, block in read_archive(get_file(folder, name)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    response = fields["WARC-Type"] == "response"
                    if response:
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = None if response else number(fields["WARC-Refers-To"])
                    rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt(archives.select("folder", "file"), "file").mapInArrow(
        work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
