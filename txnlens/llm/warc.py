"""WARC archives in seekable Zstandard bundles.

A bundle is one archive file: records gathered into independent Zstandard frames of about ``FRAME`` bytes, and a footer
(a skippable frame) that tells every frame's sizes, so that any frame can be read alone. An index row per record holds
the archive, the number of the frame, where the frame begins and the record's offset and length inside the frame.

Archives are written by the tasks under the shared folder, each first under a name of its attempt and then renamed, so
a lost or repeated task leaves one whole file; the index lists only the files of the attempts that were kept.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.sources.scratch import fresh_dir, stored

FRAME = 1 << 20
BUNDLE = 64 << 20
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
# The seekable format's skippable frame and footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-records")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """A response with the payload, or a revisit (``refers_to`` is the page it repeats) without it."""
    target = quote(url or f"urn:page:{page_id}", safe="%/:=&?~#+!$,;'@()*[]")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Length", str(len(payload))),
    ]
    body = head + payload
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = head
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and the payload behind the HTTP header (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Frames of records into an open file; ``close`` appends the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.coder = out, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.held, self.size, self.at = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, where it begins in the file, offset in the frame) of the record."""
        if self.held and self.size + len(record) > FRAME:
            self.flush()
        place = (len(self.sizes), self.at, self.size)
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.coder.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.at += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(begin, packed size, size) of every frame, from the footer of an open file."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    source.seek(size - 9 - 8 * count)
    pairs = struct.iter_unpack("<II", source.read(8 * count))
    out, at = [], 0
    for packed, plain in pairs:
        out.append((at, packed, plain))
        at += packed
    return out


def _filesystem(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


INDEX = "page_id bigint, record_id string, archive string, frame int, frame_begin bigint, offset bigint, length bigint"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` rows to bundles below ``folder``; the index, a row per record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, writer, rows = 0, None, []
        name = partial = ""

        def finish():
            writer.close()
            files.move(partial, f"{root}/{name}")

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["refers_to"].astype("Int64"), strict=True):
                if writer is not None and writer.at >= BUNDLE:
                    finish()
                    writer, part = None, part + 1
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{part:04d}-{task.taskAttemptId()}.warc.zst"
                    partial = f"{root}/_{name}"
                    writer = BundleWriter(files.open_output_stream(partial, compression=None))
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                payload = b"" if html is None else html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                record = warc_record(page_id, url, payload, digest, refers_to)
                frame, begin, offset = writer.add(record)
                rows.append((page_id, record_id(page_id, digest), name, frame, begin, offset, len(record)))
            out = pd.DataFrame(rows, columns=["page_id", "record_id", "archive", "frame", "frame_begin", "offset", "length"])
            yield out.astype({"page_id": "Int64"})
            rows = []
        if writer is not None:
            finish()

    return stored(records.select("page_id", "url", "html", "refers_to").mapInPandas(run, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of the indexed records.

    One row of the index per frame decides what a task reads: frames are read alone, through the archive's seek table.
    A revisit's payload is empty here; its size and digest are those of the payload it repeats.
    """
    frames = index.select("archive", "frame").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(folder)
        for batch in batches:
            for archive, group in batch.groupby("archive"):
                size = files.get_file_info(f"{root}/{archive}").size
                with files.open_input_file(f"{root}/{archive}") as source:
                    table = seek_table(source, size)
                    for frame in group["frame"]:
                        begin, packed, plain = table[frame]
                        source.seek(begin)
                        data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)
                        yield pd.DataFrame([_row(raw) for raw in _records(data)], columns=_READ).astype({"page_id": "Int64", "refers_to": "Int64"})

    return frames.mapInPandas(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


_READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _records(data: bytes) -> Iterator[bytes]:
    """The records of a frame, by their own lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        length = next(int(line[16:]) for line in data[at:stop].split(b"\r\n") if line.startswith(b"Content-Length: "))
        yield data[at:stop + length]
        at = stop + length + 4


def _row(raw: bytes) -> tuple:
    fields, payload = parse_record(raw)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["WARC-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page, other = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
    return int(page) if page else None, size, digest, kind, int(other) if other else None, payload


def fetch(index_row, folder: str) -> tuple[dict[str, str], bytes]:
    """One record by its index row: reads its frame and nothing else."""
    files, root = _filesystem(folder)
    path = f"{root}/{index_row['archive']}"
    with files.open_input_file(path) as source:
        begin, packed, plain = seek_table(source, files.get_file_info(path).size)[index_row["frame"]]
        source.seek(begin)
        data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)
    return parse_record(data[index_row["offset"]:index_row["offset"] + index_row["length"]])


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of ``least`` bytes or more, all but the largest id refer to it.

    Equal payloads are found by digests on narrow rows; the pages themselves are joined by page, so that a payload that
    very many pages share makes no large group.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("html"))
    marks = base.where(F.octet_length(text) >= least).select("page_id", F.sha2(text, 256).alias("digest"))
    first = marks.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    repeats = marks.join(first, "digest").where("NOT (page_id <=> first)").select(
        F.col("page_id").alias("id"), F.xxhash64("digest").alias("key"), F.col("first").alias("refers_to")).distinct()
    keyed = base.withColumn("mark", F.xxhash64(F.sha2(text, 256)))
    return keyed.join(repeats, F.expr("page_id <=> id AND mark = key"), "left").select("page_id", "url", "html", "refers_to")


def archive_pages(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write the pages to archives in the shared folder; the index and the folder.

    A null html is an empty payload; a null url becomes ``urn:page:<id>``. A row with a null id is written without one;
    among equal payloads it revisits the largest id there is, and without any id all are responses. Rows that repeat a
    page and its payload are alike: all responses, or all revisits. No pages: an empty index.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    return write_archives(with_revisits(pages), folder), folder
