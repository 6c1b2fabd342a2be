"""WARC archives with a Zstandard dictionary.

Each archive file holds a skippable frame (magic 0x184D2A5D) with a dictionary, and then one Zstandard frame for each WARC record,
compressed on its own with that dictionary, so that a reader can start at any record. The dictionary is built from the
records at the head of the archive, up to `SAMPLE` bytes; where they are too few or too short for one, the frame is left out.

Records with equal payloads of at least `least` bytes: the one with the smallest page id is a response, the others are
revisits that refer to it and carry the HTTP head only. Equal payloads are grouped by their SHA-1. Only digests that occur
more than once are joined back: the hot ones (each over 1/200 of all rows, so at most 200) and, if all are few, the
rest are broadcast, else the rest is shuffled.

Each task writes its rows into archives of about `roll` bytes in the folder given, which driver and executors must share. A
file is written under a name of its own and then moved to its final name, so a task that runs twice leaves whole files only, and the
manifest names one of them. Defined cases: null html is an empty payload; a null url is left out; line breaks in urls are
percent-encoded; a null page id is never referred to while another id has the payload; rows with the same page id and payload are
records each, all of the kind of the first; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SKIPPABLE = 0x184D2A5D
SAMPLE, DICTIONARY, FEW = 4 << 20, 64 << 10, 16
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    """A URN with the id, marks and control characters quoted; a null id has one of its own, an empty one is empty."""
    return "<urn:x-page-null>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe=' ')}>"


def page_of(urn: str) -> str | None:
    urn = urn.strip()
    return None if urn == "<urn:x-page-null>" else unquote(urn[len("<urn:x-page:") : -1])


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A WARC/1.1 record; with refers_to, a revisit without payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated: length"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < FEW:
        return None
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples) if size >= 512 else None
    except zstandard.ZstdError:
        return None


class Archive:
    """Records held until the dictionary is built, then frames one by one."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.fs, self.folder, self.name = fs, folder, f"{uuid.uuid4().hex}.warc.zst"
        self.out = fs.open_output_stream(f"{folder}/.{self.name}.part", compression=None)
        self.held: list[bytes] = []
        self.size = self.n = self.held_bytes = 0
        self.coder: zstandard.ZstdCompressor | None = None

    def add(self, rec: bytes) -> None:
        self.n += 1
        if self.coder:
            self.put(self.coder.compress(rec))
            return
        self.held.append(rec)
        self.held_bytes += len(rec)
        if self.held_bytes >= SAMPLE:
            self.start()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def start(self) -> None:
        own = build_dictionary([r[: 128 << 10] for r in self.held])
        if own:
            raw = own.as_bytes()
            self.put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.coder = zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=True, write_checksum=True)
        for r in self.held:
            self.put(self.coder.compress(r))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.coder:
            self.start()
        self.out.close()
        path = f"{self.folder}/{self.name}"
        self.fs.move(f"{self.folder}/.{self.name}.part", path)
        return path, self.n, self.size


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def with_references(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of every row."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    # One row for each payload that occurs twice or more.
    twice = stored(p.where("sha is not null").groupBy(F.col("sha").alias("r_sha")).agg(F.min("page_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    n_twice = twice.count()
    if n_twice <= 100_000:
        joined = p.join(F.broadcast(twice), F.col("sha") == F.col("r_sha"), "left")
    else:
        # At most 200 digests can each have more than a 200th of the rows.
        hot = twice.where(F.col("n") > F.lit(max(1, pages.count() // 200)))
        mark = p.join(F.broadcast(hot), F.col("sha") == F.col("r_sha"), "left")
        rest = mark.where("r_sha is null").drop("r_sha", "rep", "n").join(twice, F.col("sha") == F.col("r_sha"), "left")
        joined = mark.where("r_sha is not null").unionByName(rest)
    first = F.col("rep").isNull() | F.col("page_id").eqNullSafe(F.col("rep"))
    return joined.select("page_id", "url", "payload", F.when(~first, F.col("rep")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, roll: int = 64 << 20) -> DataFrame:
    """Writes the archives below folder; their manifest: path, n_records, n_bytes."""
    rows = with_references(pages, page_id=page_id, url=url, html=html, least=least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        archive, done = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for r in whole.slice(at, 256).to_pylist():
                    archive = archive or Archive(fs, base)
                    archive.add(record(r["page_id"], r["url"], r["payload"], r["refers_to"]))
                    if archive.size >= roll:
                        done.append(archive.close())
                        archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    return stored(rows.mapInArrow(run, MANIFEST))


def frames(source) -> Iterator[bytes]:
    """The records of an archive, given as a file object, one at a time."""
    head = source.read(8)
    own = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        own = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    data, coder = head, zstandard.ZstdDecompressor(dict_data=own)
    while True:
        data = data or source.read(1 << 20)
        if not data:
            return
        one, parts = coder.decompressobj(), []
        while not one.eof:
            if not data and not (data := source.read(1 << 20)):
                raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parse(rec: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields of the WARC head, the HTTP head and the payload of a record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def read(manifest: DataFrame, folder: str, *, kind: str = "bigint") -> DataFrame:
    """RECORDS of every record in the archives of a manifest. A response's size and digest come from its payload, and must be as its head says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                with fs.open_input_stream(path, compression=None) as source:
                    for rec in frames(source):
                        fields, http, payload = parse(rec)
                        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(http.decode().rpartition("Content-Length: ")[2])
                        if fields["WARC-Type"] == "response" and (digest(payload) != sha or len(payload) != n):
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {path}")
                        out.append((page_of(fields["WARC-Record-ID"]), n, sha, fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None))
                        if len(out) == 4096:
                            yield table(out)
                            out = []
                if out:
                    yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.string())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, manifest.count())
    got = manifest.select("path").repartition(min(n, 10_000)).mapInArrow(run, RECORDS.format(kind="string"))
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
