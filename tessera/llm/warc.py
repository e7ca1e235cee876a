"""WARC archives as a chunked record table.

Writing: a record for each page, a gzip member each; a payload that equals an earlier one becomes a revisit. Reading: a
record's payload comes as rows of record identifier and chunk number, with the digest of all chunks so far, so that no
record has to fit in memory.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, new_path, open_fs, small_batches, utf8

CHUNK = 1 << 18
READ = 1 << 20
#: Payloads of at least so many bytes are deduplicated.
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own: the page of a record, and that of the response which a revisit repeats. The payload's digest, which the
#: profile asks for, finds the response too; several records may be of one page.
PAGE, REFERS_TO = "Page-ID", "Page-Refers-To"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, target_uri string, chunk_no int, last boolean, payload_bytes long, payload_digest string, length_header long, digest_header string, data binary"


def payload_key(body: Column) -> Column:
    """Equal payloads are told by their SHA-256: two of one SHA-1 can be made on purpose."""
    return F.unhex(F.sha2(body, 256))


def revisits(spark: SparkSession, pages: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat a payload: refers_to is the smallest page_id that has it."""
    s = Scratch(spark)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = s.table(pages.select(F.col("page_id").cast("long").alias("page_id"), payload_key(body).alias("digest"), F.length(body).alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= least)).drop("n"), "digests")
    # One row for each payload that more than one page has; in a table, so that a payload of very many pages can be split.
    first = s.table(keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top")).where("top > refers_to").drop("top"), "firsts")
    return s.table(keyed.join(first, "digest").where("page_id > refers_to").distinct(), "revisits")


def header(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def urn(file: str, place: int) -> str:
    """A record's identifier, like no other: of the file's own name and the place in it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{place}')}>"


def put(out, record_id: str, page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None, level: int) -> None:
    """A record as a gzip member; the payload goes through in chunks."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append((PAGE, str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        fields += [(REFERS_TO, str(refers_to)), ("WARC-Profile", PROFILE)]
    body = len(payload) if refers_to is None else 0
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out.write(z.compress(header(fields, len(http) + body) + http))
    for a in range(0, body, CHUNK):
        out.write(z.compress(payload[a : a + CHUNK]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = MIN_BYTES, level: int = 1) -> DataFrame:
    """pages(page_id, url, html, ...): writes a record for each row to archives in the shared folder and returns their
    manifest (path, records), kept as a table there.

    Payload: html in UTF-8; null counts as empty. Of the rows whose payloads are equal and of at least `least` bytes, those
    with the smallest page_id are responses and the others revisit it. A row without page_id is a response. Repeated rows
    each get a record. Each record has an identifier of its own, by which, with chunk numbers, its payload can be put together
    again. page_id must be a whole number, or null. Other columns are ignored. An empty table gives no archive. A task writes files of its own names,
    so those of failed or repeated attempts are in no manifest.
    """
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), body.alias("html"), payload_key(body.cast("binary")).alias("digest"))
    rows = rows.join(revisits(spark, pages, least).hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            if out is None:
                fs, path = open_fs(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
            data, off = utf8(batch.column("html"))
            view = memoryview(data)
            for k, (page_id, url, refers_to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")))):
                put(out, urn(name, n), page_id, url, view[off[k] : off[k + 1]], refers_to, level)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64())})

    return Scratch(spark).table(rows.mapInArrow(archive, "path string, records long"), "archives")


class Inflated(io.RawIOBase):
    """The text of a file of gzip members, read forward in bounded pieces."""

    def __init__(self, file):
        self.file, self.z, self.held = file, None, b""

    def more(self) -> bool:
        """Adds a piece to held; false at the end."""
        while True:
            raw = self.z.unconsumed_tail if self.z is not None and self.z.unconsumed_tail else self.z.unused_data if self.z is not None and self.z.eof and self.z.unused_data else self.file.read(READ)
            if not raw:
                return False
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            if got := self.z.decompress(raw, READ):
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with mark; null at the end."""
        while (k := self.held.find(mark)) < 0:
            if not self.more():
                return None
        got, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        while not self.held:
            if not self.more():
                raise EOFError("the archive ends within a record")
        got, self.held = self.held[:n], self.held[n:]
        return got


def fields_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}


def page_of(field: str | None) -> int | None:
    return int(field) if field and field.lstrip("-").isdigit() else None


def records(file, with_data: bool) -> Iterator[dict]:
    """A row for each chunk of each record's payload; one with chunk 0 for an empty one."""
    src = Inflated(file)
    while (head := src.until(b"\r\n\r\n")) is not None:
        if not head.strip():  # what ends a record
            continue
        h = fields_of(head)
        left = int(h["content-length"])
        http = b""
        if h.get("content-type", "").startswith("application/http"):
            http = src.until(b"\r\n\r\n")
            left -= len(http)
        length = fields_of(http).get("content-length") if http else None
        row = {"record_id": h.get("warc-record-id"), "page_id": page_of(h.get(PAGE.lower())), "record_type": h.get("warc-type"), "refers_to": page_of(h.get(REFERS_TO.lower())), "target_uri": h.get("warc-target-uri"), "length_header": None if length is None else int(length), "digest_header": (h.get("warc-payload-digest") or ":").partition(":")[2] or None}
        sha, seen, k = hashlib.sha1(), 0, 0
        while True:
            piece = b""
            while left and len(piece) < CHUNK:
                got = src.take(min(left, CHUNK - len(piece)))
                piece, left = piece + got, left - len(got)
            sha.update(piece)
            seen += len(piece)
            yield row | {"chunk_no": k, "last": not left, "payload_bytes": seen, "payload_digest": base64.b32encode(sha.copy().digest()).decode(), "data": piece if with_data else None}
            k += 1
            if not left:
                break


def read(spark: SparkSession, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of a manifest's archives: columns as in CHUNKS. payload_bytes and payload_digest are of all chunks
    so far, so the row with last set has those of the whole payload. A revisit has one empty chunk; its full payload's
    size and digest are in length_header and digest_header. without data, the data column is null.
    """
    cols = [(c.split()[0], c.split()[1]) for c in CHUNKS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[t]) for c, t in cols], [c for c, _ in cols])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, path = open_fs(name)
                with fs.open_input_file(path) as file:
                    held, n = [], 0
                    for r in records(file, with_data):
                        held.append(r)
                        n += len(r["data"] or b"")
                        if n > 4 << 20 or len(held) >= 4096:
                            yield batch_of(held)
                            held, n = [], 0
                    yield batch_of(held)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(chunks, CHUNKS)


def report(chunks: DataFrame) -> DataFrame:
    """A row for each record: page_id, size and digest of the full payload, record_type and refers_to."""
    whole = F.col("record_type") == "revisit"
    return chunks.where("last").select("page_id", F.when(whole, F.col("length_header")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(whole, F.col("digest_header")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
