"""WARC archives whose records are compressed one by one with a Zstandard dictionary that the file carries."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percepta.shared import freed, fresh_path, lookup_join, written

#: Magic number of the skippable frame that holds the dictionary.
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, path string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(text: str) -> str:
    """A header's value on one line: controls, blanks at the ends and % as percent signs with hex digits."""
    return "".join(c if " " < c and c not in "\x7f%" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _plain(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers: tuple | None, n: int) -> bytes:
    """One WARC record. refers: of a revisit, a tuple with the page_id of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    name = f"{page_id}/{url}/{n}"
    heads = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        heads.append(f"WARC-Target-URI: {_value(url)}")
    if page_id is not None:
        heads.append(f"X-Page-ID: {page_id}")
    heads.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers:
        heads.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        heads += [f"X-Refers-To-Page-ID: {refers[0]}"] * (refers[0] is not None)
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes, trained on samples; of too few or too small ones, their own content."""
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(total // 8, 1024)), samples, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Any bytes can serve; those at the end are the cheapest to refer to. Eight bytes are the least that Zstandard takes.
        return b"".join(samples)[-size:].rjust(8, b"\r")


class ArchiveWriter:
    """Writes records to one file: a skippable frame with the dictionary, then each record compressed on its own."""

    def __init__(self, out, dictionary: bytes, level: int = 3):
        import zstandard

        self.out, self.records, self.written = out, 0, 0
        self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, record: bytes) -> None:
        self.records += 1
        self._put(self.compressor.compress(record))


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive; one record is in memory at a time."""
    import zstandard

    head, trained = file.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        trained = zstandard.ZstdCompressionDict(file.read(struct.unpack("<II", head)[1]))
    else:
        file.seek(0)
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(file, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        heads = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            heads[name] = value
        block = plain.read(int(heads["Content-Length"]))
        if len(block) != int(heads["Content-Length"]) or plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield heads, block


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def _write_part(folder: str, records_per_file: int, dictionary: bytes, level: int):
    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        stream = writer = part = None

        def finish() -> None:
            stream.close()
            # A task that runs again, or twice at once, replaces the file by an equal one.
            name = f"{base}/part-{task.partitionId():06d}-{len(done):04d}.warc.zst"
            files.move(part, name)
            done.append((name, writer.records, writer.written))

        for batch in batches:
            for page_id, url, html, revisit, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    part = f"{base}/.attempt-{task.partitionId()}-{task.taskAttemptId()}-{len(done)}"
                    stream = files.open_output_stream(part)
                    writer = ArchiveWriter(stream, dictionary, level)
                writer.add(record_bytes(page_id, url, html or b"", (refers,) if revisit else None, writer.records))
                if writer.records >= records_per_file:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    return write


def _samples(rows: DataFrame, most: int, sample_bytes: int) -> list[bytes]:
    """About `most` records, spread over all of rows(page_id, url, html); of very long ones slices. They are what the dictionary is trained on."""
    n = rows.count()
    some = rows if n <= most else rows.sample(fraction=min(1.0, 1.1 * most / n), seed=2)
    # Of a page a slice goes into the training; pages themselves are archived whole.
    some = some.select("page_id", "url", F.expr(f"substring(html, 1, {max(sample_bytes // most, 1)})").alias("html")).limit(most).collect()
    return [record_bytes(r.page_id, r.url, bytes(r.html), None, i) for i, r in enumerate(some)]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0, records_per_file: int = 100_000, most_rows: int = 200_000, dictionary_bytes: int = 65_536, samples: int = 512, sample_bytes: int = 8_000_000, level: int = 3) -> DataFrame:
    """Writes a record for every row of pages into archives under folder, which executors and driver share.

    Returns the manifest (path, records, bytes). The payload is html in UTF-8; null counts as empty. Of the rows with
    equal payloads of min_payload bytes or more, the one with the largest page_id is a response and the others are revisits
    that refer to it; smaller payloads are all responses. Rows that share that largest page_id (repeated rows) are all
    responses; null ids are smaller than others, and rows of a payload that has no id at all are all responses. Files are
    named by partition and put in place by renaming, so a task that is run again leaves no second copy.

    One dictionary of dictionary_bytes at most is built from about `samples` records, sample_bytes in all, and leads every
    file in a skippable frame, however few records the file holds. Extra columns are left out; an empty table makes no file.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    dictionary = dictionary_of(_samples(plain, samples, sample_bytes), dictionary_bytes)
    rows = plain.withColumn("digest", F.sha1("html"))
    same = rows.filter(F.octet_length("html") >= min_payload).select("digest", "page_id").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = written(same.filter("n > 1").select("digest", "first"), "equal-payloads")
    marked = lookup_join(rows, same, ["digest"], most_rows=most_rows, spread=[F.col("page_id"), F.col("url")])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = marked.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    manifest = written(out.mapInArrow(_write_part(folder, records_per_file, dictionary, level), MANIFEST), "manifest")
    freed(same)
    return manifest


def _read_parts(with_payload: bool):
    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "path"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def made(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _filesystem(path)
                rows, held = [], 0
                with files.open_input_file(at) as file:
                    for heads, block in read_records(file):
                        top, _, body = block.partition(b"\r\n\r\n")
                        digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(next(x for x in top.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        kind = heads["WARC-Type"]
                        if kind == "response" and (length != len(body) or digest != payload_digest(body)):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        number = lambda k, h=heads: int(h[k]) if k in h else None
                        uri = heads.get("WARC-Target-URI")
                        rows.append((number("X-Page-ID"), None if uri is None else _plain(uri), body if with_payload and kind == "response" else None, length, digest, kind, number("X-Refers-To-Page-ID"), heads["WARC-Record-ID"], path))
                        held += len(body) * with_payload
                        if len(rows) >= 5_000 or held > 8_000_000:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for every record of the archives in manifest(path, …); payloads of responses are checked against their digests."""
    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("path").repartition(n).mapInArrow(_read_parts(with_payload), RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Archives pages in the shared folder and returns the records that are read back."""
    return read_archives(write_archives(pages, fresh_path(spark, "warc"), **options))


__all__ = ["ArchiveWriter", "archive_pages", "dictionary_of", "payload_digest", "read_archives", "read_records", "record_bytes", "write_archives"]
