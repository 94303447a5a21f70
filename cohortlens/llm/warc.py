"""WARC archives whose records are compressed one by one with a dictionary kept in the file."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import one_each, pick
from cohortlens.session import materialize, scratch_path

# Fixed values of the formats: skippable frame that holds the dictionary, and record syntax.
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Compressed bytes after which a task begins a new archive; raw bytes of the records a dictionary is built from.
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
# Parts that the rows of one payload are dealt into when they meet the record they repeat.
SALTS = 32


def base32_digest(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def hex_digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    number = uri.strip("<>").removeprefix("urn:page:") if uri else ""
    return int(number) if number else None


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header, with the payload's length, and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean(url or "") or record_uri(page_id).strip("<>")),
        ("WARC-Payload-Digest", base32_digest(digest)),
        ("WARC-Block-Digest", base32_digest(hashlib.sha1(block).hexdigest())),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Write ``.warc.zst`` files below ``folder``: the dictionary in a leading skippable frame, one frame per record.

    A dictionary is built from the first ``SAMPLE_BYTES`` of an archive's own records (parts of up to 64 KB of
    each); those records wait in memory, all later ones are written as they come. Records too few or too
    alike to build one from get an empty dictionary, that is none.
    """

    def __init__(self, folder: str, level: int = 3):
        self.where, self.folder = fs.FileSystem.from_uri(folder)
        self.level = level
        self.waiting: list[bytes] = []
        self.held = self.written = self.records = 0
        self.out, self.path = None, ""

    def add(self, data: bytes) -> Iterator[tuple[str, int, int]]:
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self.begin()
        else:
            self.put(data)
        if self.written >= ARCHIVE_BYTES:
            yield self.finish()

    def begin(self) -> None:
        import zstandard

        samples = [x[: 64 << 10] for x in self.waiting]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:
            dictionary = zstandard.ZstdCompressionDict(b"")
        content = dictionary.as_bytes()
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary if content else None, write_checksum=True)
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.where.open_output_stream(self.path)
        self.out.write(DICTIONARY_FRAME + len(content).to_bytes(4, "little") + content)
        self.written, self.records = 8 + len(content), 0
        info = f"format: WARC File Format 1.1\r\nsoftware: cohortlens\r\n".encode()
        head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.put(VERSION + head.encode() + info + b"\r\n\r\n")
        self.records = 0
        for x in self.waiting:
            self.put(x)
        self.waiting, self.held = [], 0

    def put(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.written += len(frame)
        self.records += 1

    def finish(self) -> tuple[str, int, int]:
        self.out.close()
        done = (self.path, self.records, self.written)
        self.out, self.written = None, 0
        return done

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.out is None and self.waiting:
            self.begin()
        if self.out is not None:
            yield self.finish()


def read_frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive in turn, one frame in memory at a time."""
    import zstandard

    head = stream.read(8)
    if head[:4] != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start of the archive")
    content = stream.read(int.from_bytes(head[4:], "little"))
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    data = stream.read(chunk)
    while data:
        one, parts = decompressor.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; its length and block digest must hold."""
    if not data.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = data[len(VERSION) :].partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n"))}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length than its header says")
    if "warc-block-digest" in fields and base32_digest(hashlib.sha1(block).hexdigest()) != fields["warc-block-digest"]:
        raise ValueError("record differs from its digest")
    return fields, block


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 1000) -> DataFrame:
    """``key, url, payload, digest, revisit, refers_to``: which rows repeat the payload of another.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest key is kept in full (all of
    them, if rows with that key are repeated, or no row has a key), the others refer to it. A null payload
    is empty. Only digests that occur twice or more take part in the join; a hot payload is dealt into ``SALTS`` parts.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    kept = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("key").alias("last"), F.count("*").alias("n"))
    kept = kept.where("n > 1 AND last IS NOT NULL").select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.coalesce(F.col("key"), F.lit(0))), F.lit(SALTS)).cast("int"))
    joined = salted.join(kept, ["digest", "salt"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select("key", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write one record per row into archives below ``folder`` and return the stored list ``path, records, bytes``.

    ``folder`` must be one that every executor reaches. A task that is run again writes new files; only
    those in the list count, and the list is complete when this returns. An empty table gives an empty list.
    """
    rows = with_revisits(pick(pages, **{"page_id": key, "url": url, "html": payload}), least=least)
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, level)
        names = ["key", "url", "payload", "digest", "revisit", "refers_to"]

        def told(done):
            for file, n, size in done:
                yield pa.RecordBatch.from_pydict({"path": [file], "records": [n], "bytes": [size]})

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                columns = [batch.column(batch.schema.get_field_index(n)).slice(at, 128).to_pylist() for n in names]
                for page_id, target, body, digest, revisit, refers_to in zip(*columns):
                    yield from told(writer.add(record(page_id, target, body, digest, refers_to, revisit, date)))
        yield from told(writer.close())

    return materialize(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Read listed archives back: ``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to``.

    Each archive is read by one task as a stream. Digest and length of a response are computed from the
    payload that was read; those of a revisit, whose payload is elsewhere, come from its record.
    Lengths and digests are checked on the way; a damaged archive fails the job.
    """
    schema = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        names = [part.split()[0] for part in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(path) as stream:
                    for data in read_frames(stream):
                        fields, block = parse(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        revisit = fields["warc-type"] == "revisit"
                        said = int(head.lower().partition(b"content-length:")[2].split()[0])
                        digest = hex_digest(fields["warc-payload-digest"])
                        if not revisit and (len(body) != said or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                        rows.append((
                            page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], None if revisit else body,
                            said, digest, page_of(fields.get("warc-refers-to")),
                        ))
                        held += len(data)
                        if held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return one_each(archives.select("path"), "path").mapInArrow(run, schema)


def archive_folder(spark) -> str:
    """A fresh folder for archives below the shared one."""
    return scratch_path(spark, "warc")
