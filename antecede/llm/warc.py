"""WARC archives as seekable Zstandard bundles, and reading single records back."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from antecede.llm.store import shared_folder, stored

#: Fixed values of the seekable format: a skippable frame that ends in the number of frames, a descriptor and a magic.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
ENTRY, ENTRY_BYTES = "<II", 8
FOOTER, FOOTER_BYTES = "<IBI", 9
#: Uncompressed bytes after which a frame is closed; a record is never split.
FRAME_BYTES = 1 << 18
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record with the payload, or a revisit without it."""
    head = [f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head = ["WARC-Type: response", *head, "Content-Type: application/http; msgtype=response"]
    else:
        body = b""
        head = ["WARC-Type: revisit", *head, f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>",
                f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else body


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class BundleWriter:
    """Writes records into independent frames and the seek table behind them."""

    def __init__(self, out) -> None:
        self.out, self.sizes, self.open = out, [], bytearray()
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within the frame's content) of the record."""
        if self.open and len(self.open) + len(record) > FRAME_BYTES:
            self._close_frame()
        at = len(self.sizes), len(self.open)
        self.open += record
        return at

    def _close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def finish(self) -> None:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack(ENTRY, *s) for s in self.sizes) + struct.pack(FOOTER, len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack(ENTRY, SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single frames by the seek table."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        frames, _, magic = struct.unpack(FOOTER, source.read_at(FOOTER_BYTES, end - FOOTER_BYTES))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = source.read_at(frames * ENTRY_BYTES, end - FOOTER_BYTES - frames * ENTRY_BYTES)
        self.sizes = list(struct.iter_unpack(ENTRY, table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(self.sizes[k][0], self.starts[k]), max_output_size=self.sizes[k][1])


def revisits(pages: DataFrame, id_col: str = "page_id", payload: str = "html") -> DataFrame:
    """(id, digest, refers_to) of pages whose payload a page with a smaller id has too.

    Equal payloads are told by SHA-1 and length. Only ids and digests are shuffled, and of payloads that
    occur once nothing is left, so what the writer joins holds repeats only.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")).alias("digest"),
                        F.octet_length(F.coalesce(F.col(payload), F.lit(""))).alias("size"))
    first = rows.groupBy("digest", "size").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["digest", "size"]).where("refers_to IS NOT NULL AND NOT (id <=> refers_to)").select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one record per row, one archive per partition; returns the index, which is stored:

    (id, archive, frame, offset, length): record identifier to offsets relative to the frame's content.

    Of rows with equal payloads those with the smallest id are response (repeated rows of that id all are), the
    others revisit it; a NULL id is no smallest id. NULL payloads are empty ones; payloads of any length are one
    record in a frame of its own size. An empty table writes archives without frames. An archive is written under the
    attempt's name and moved when complete, so a retried or doubled task leaves whole archives.
    """
    again = stored(revisits(pages, id_col, payload), "revisits").withColumnRenamed("id", "again").withColumnRenamed("digest", "same")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("again")) & (F.sha1(F.col("payload").cast("binary")) == F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        archive = f"{task.partitionId():06d}.warc.zst"
        draft = f"{path}/.{archive}.{task.taskAttemptId()}"
        with store.open_output_stream(draft) as out:
            writer = BundleWriter(out)
            for batch in batches:
                places = []
                for page_id, link, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    data = text.encode()
                    record = record_bytes(page_id, link, data, base32_sha1(data), refers_to)
                    places.append((*writer.add(record), len(record)))
                frame, offset, length = zip(*places) if places else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([archive] * len(places), pa.string()), *(pa.array(x, pa.int64()) for x in (frame, offset, length))],
                    ["id", "archive", "frame", "offset", "length"])
            writer.finish()
        store.move(draft, f"{path}/{archive}")

    kind = pages.schema[id_col].dataType.simpleString()
    index = rows.select("id", "url", "payload", "refers_to").mapInArrow(run, f"id {kind}, archive string, frame bigint, offset bigint, length bigint")
    return stored(index, "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(id, record_type, payload, payload_bytes, payload_digest, refers_to) of the records in ``index``.

    Only frames that hold a wanted record are read, each once. Length and digest of a response are
    those of the payload read; a revisit has no payload and gives those that it states of its original.
    """
    frames = index.groupBy("archive", "frame").agg(F.collect_list(F.struct("id", "offset", "length")).alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        for batch in batches:
            for archive, frame, records in sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda x: x[:2]):
                with store.open_input_file(f"{path}/{archive}") as source:
                    content = BundleReader(source).frame(frame)
                out = []
                for r in records:
                    head, payload = parse_record(content[r["offset"]:r["offset"] + r["length"]])
                    if head["WARC-Type"] == "response":
                        out.append((r["id"], "response", payload, len(payload), base32_sha1(payload), None))
                    else:
                        out.append((r["id"], "revisit", None, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                                    head["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">")))
                ids, kinds, payloads, sizes, digests, refs = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("records").type.value_type.field("id").type), pa.array(kinds), pa.array(payloads, pa.binary()),
                     pa.array(sizes, pa.int64()), pa.array(digests), pa.array(refs, pa.string())],
                    ["id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    kind = index.schema["id"].dataType.simpleString()
    out = frames.mapInArrow(run, f"id {kind}, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string")
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))


def bundle(pages: DataFrame) -> tuple[DataFrame, str]:
    """(index, folder) of archives in a new shared folder."""
    folder = shared_folder(pages.sparkSession, "warc")
    return write_archives(pages, folder), folder
