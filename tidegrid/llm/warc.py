"""WARC archives compressed with a dictionary of their own records.

An archive is a sequence of Zstandard frames. The first is a skippable frame that holds the dictionary, trained
on a bounded sample of the records to be archived; each record then is one frame, compressed with it, so a
record can be read alone. Pages with a payload seen before are written as revisits that name the first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches, new_path, stored

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame and of a trained dictionary.
SKIPPABLE, TRAINED = 0x184D2A5D, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of the sample that the dictionary is trained on (rows in expectation, characters of each from its start), and its size.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 1 << 14, 1 << 16
ROLL_BYTES = 1 << 30  # an archive of this size is closed, and another begun
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 18
MANIFEST = "file string, records bigint, bytes bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = (name or "")[len("<urn:x-page:") : -1]
    return None if found in ("", "none") else int(found)


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, length: int, sha1: bytes) -> bytes:
    """One WARC/1.1 record; without a payload it is a revisit, whose block keeps the HTTP head alone, with the payload's length."""
    revisit = payload is None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int

    def row(self) -> tuple:
        h = self.headers
        url = h.get("warc-target-uri")
        url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        return (_page(h["warc-record-id"]), url, h["warc-type"], _page(h.get("warc-refers-to")), h["warc-payload-digest"].removeprefix("sha1:"), self.payload_bytes)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip(" ") for k, _, v in (line.partition(":") for line in lines)}


def parse(raw: bytes) -> Record:
    """A record from its bytes; its lengths, and a response's digest, must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    if not head.startswith(b"WARC/1.1") or len(block) != int(headers["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_fields(http)["content-length"])
    if headers["warc-type"] == "response" and (len(payload) != length or "sha1:" + digest(payload) != headers["warc-payload-digest"]):
        raise ValueError("a payload that isn't the one its record names")
    return Record(headers, payload, length)


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page's own record."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    return record(page_id, url, payload, None, len(payload), hashlib.sha1(payload).digest())


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of few or short samples, their bytes as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    trained = len(data) >= 4 and struct.unpack("<I", data[:4])[0] == TRAINED
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _write_batches(folder: str, dictionary: bytes, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each attempt of a task writes files of its own; only those of tasks that end are in the manifest.
        out, path, records, size = None, "", 0, 0
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(dictionary), write_content_size=True)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, records = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                    system, place = opened(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    size = 8 + len(dictionary)
                frame = compressor.compress(record(*row))
                out.write(frame)
                records += 1
                size += len(frame)
                if size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to, length, sha1) for every row; the payload is null for revisits: all but the rows of the least page_id.

    Payloads meet with partial aggregation, so those that many pages share move once a task; rows move without them. Only
    rows that are responses are joined to their payload. Null ids come after all others.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "length": F.octet_length("payload").cast("bigint")})
    heads = rows.select("page_id", "url", "sha1", "length")
    first = heads.groupBy("sha1", "length").agg(F.min("page_id").alias("first"))
    known = stored(heads.join(first, ["sha1", "length"]), "warc-roles")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first"))
    revisits = known.where(revisit).select("page_id", "url", F.lit(None).cast("binary").alias("payload"), F.col("first").alias("refers_to"), "length", "sha1")
    bodies = rows.groupBy("sha1", "length").agg(F.first("payload").alias("payload"))
    responses = known.where(~revisit).join(bodies, ["sha1", "length"]).select("page_id", "url", "payload", F.lit(None).cast("bigint").alias("refers_to"), "length", "sha1")
    return responses.unionByName(revisits)


def write_archives(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives all rows of ``pages`` (page_id, url, html); the manifest (file, records, bytes) of what was written.

    ``folder`` must be one that executors and later readers share; the default is in the shared folder. The sample of the
    dictionary is drawn by a hash of (page_id, url), whatever the order of rows; of a long page its beginning is taken.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or new_path(spark, "warc")
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = pages.select("page_id", "url", F.substring(F.col("html").cast("string"), 1, SAMPLE_CHARS).alias("html"))
    drawn = thin.where(share * F.lit(pages.count()) < SAMPLE_ROWS).groupBy("page_id", "url").agg(F.min("html").alias("html"))
    samples = sorted(response(r.page_id, r.url, r.html) for r in drawn.collect())
    made = roles(pages).mapInArrow(_write_batches(folder, build_dictionary(samples), roll_bytes), MANIFEST)
    return stored(made, "warc-manifest")


def frames(stream) -> Iterator[bytes]:
    """The records of an open archive, one decompressed frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("an archive without a leading dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary_of(stream.read(size)))
    data = stream.read(READ_BYTES)
    while data:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data:
                raise ValueError("an archive that ends within a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else stream.read(READ_BYTES)
        yield b"".join(parts)
        data = data or stream.read(READ_BYTES)


def _read_batches(with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *(["payload"] if with_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            system, place = opened(path)
            rows: list[tuple] = []
            with system.open_input_stream(place, compression=None) as stream:
                for raw in frames(stream):
                    found = parse(raw)
                    payload = (found.payload if found.headers["warc-type"] == "response" else None,)
                    rows.append(found.row() + (payload if with_payload else ()))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the manifest's files; with ``payload`` its bytes, null for a revisit."""
    spark: SparkSession = manifest.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    files = manifest.select("file").repartition(parts, "file")
    return files.mapInArrow(_read_batches(with_payload), RECORD + (", payload binary" if with_payload else ""))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of ``pages``, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Defined cases: a null html is an empty payload, and empty payloads revisit the first of them; a null url gives no
    target; repeated rows of the least page_id are responses all, of others revisits; a null page_id comes after all
    others; an empty table writes nothing and gives no rows; a page of any length is one record.
    """
    found = read_archives(write_archives(pages))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
