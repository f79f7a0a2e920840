"""Media columns: texts as 8-bit grey images in archives, read by a data source over byte ranges.

An image is a PNG of 576 samples a row, one sample for each payload byte (filter 0, deflate), with
the unpadded length in a text chunk. Archives are ZIP files with stored members and end in their
directory. The data source lists archive sizes only and plans byte ranges over them, several to a partition where there are very many; each task
opens an archive once and reads the members that start within its range, straight at their offsets; a member that fails is
read again by itself, from a file opened anew.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kgspark.llm.common import byte_rows, in_batches, in_pieces, shared_dir

ROW, PAD = 576, b"\xff"
MEMBERS = "doc_id long, media binary, archive string, offset long"


def payload_of(text: bytes) -> bytes:
    """The text filled up with bytes 255 to a multiple of 576, one row at least."""
    return text + PAD * (-len(text) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(text: bytes, level: int = 1) -> bytes:
    payload = np.frombuffer(payload_of(text), np.uint8).reshape(-1, ROW)
    lines = np.concatenate([np.zeros((len(payload), 1), np.uint8), payload], 1).tobytes()
    head = struct.pack(">IIBBBBB", ROW, len(payload), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[int, bytes]:
    """n_bytes and payload. Raises ValueError where a checksum, the header or the size is wrong."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, n, head = 8, [], -1, None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[0] != ROW or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image of 576 samples a row")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], ROW + 1)
    return n, lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean sample, share of fills and distinct samples, mean step along rows: integers, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    step = np.abs(np.diff(x.reshape(-1, ROW).astype(np.int16), axis=1))
    n = len(x)
    return f"rows={n // ROW};mean={int((hist * np.arange(256)).sum()) * 1000 // n};fill={int(hist[255]) * 1000 // n};levels={int((hist > 0).sum())};step={int(step.sum(dtype=np.int64)) * 1000 // max(1, step.size)}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def write_archives(docs: DataFrame, path: str, at_most: int = 16 << 20) -> str:
    """Store the text of each row as an image in archives of about at_most bytes below path.

    An archive gets its name only when it is complete, and the manifest, written last, names those
    of the tasks that succeeded: a task that is run again leaves nothing that is read twice. The
    driver sees a row for each archive. A null text is empty; a null doc_id is kept.
    """

    def write(batches):
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        state: dict = {"buffer": None}

        def close():
            zipped, buffer, n = state["zip"], state["buffer"], state["n"]
            zipped.close()
            name = f"part-{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{folder}/_{name}") as out:
                out.write(buffer.getbuffer())
            store.move(f"{folder}/_{name}", f"{folder}/{name}")
            state["buffer"] = None
            return pa.RecordBatch.from_pydict({"name": [name], "bytes": [buffer.tell()], "members": [n]}, pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())]))

        for batch in batches:
            for b in in_pieces(batch, "text"):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), byte_rows(b.column("text"))):
                    if state["buffer"] is None:
                        buffer = io.BytesIO()
                        state |= {"buffer": buffer, "zip": zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED), "n": 0}
                    info = zipfile.ZipInfo(f"{state['n']:08d}_{'null' if doc_id is None else doc_id}.png")
                    state["zip"].writestr(info, encode_png(text))
                    state["n"] += 1
                    if state["buffer"].tell() >= at_most or state["n"] >= 60_000:
                        yield close()
        if state["buffer"] is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = in_batches(rows, write, "name string, bytes long, members long").collect()
    store, folder = _open(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/_manifest.json") as out:
        out.write(json.dumps([[r.name, r.bytes] for r in sorted(made)]).encode())
    return path


#: Partitions at most; beyond that a partition holds several ranges.
PARTITIONS = 100_000


class ArchiveRange(InputPartition):
    """Byte ranges (archive, start, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.tries = int(options.get("rangeBytes", 8 << 20)), int(options.get("tries", 3))

    def partitions(self) -> list[ArchiveRange]:
        store, folder = _open(self.path)
        with store.open_input_stream(f"{folder}/_manifest.json") as f:
            archives = json.loads(f.read())
        ranges = [(name, at, min(at + self.range_bytes, size)) for name, size in archives for at in range(0, size, self.range_bytes)]
        each = -(-len(ranges) // PARTITIONS)
        return [ArchiveRange(ranges[k : k + each]) for k in range(0, len(ranges), each)] if ranges else [ArchiveRange([])]

    def read_member(self, store: fs.FileSystem, file: str, f, info: zipfile.ZipInfo) -> bytes:
        """The member's bytes at its offset, from the open file f first; opened anew for each further try."""
        for again in range(self.tries):
            own = None
            try:
                source = f if not again else (own := store.open_input_file(file))
                source.seek(info.header_offset)
                kind, name, extra = struct.unpack("<4s22xHH", source.read(30))
                source.seek(info.header_offset + 30 + name + extra)
                data = source.read(info.compress_size)
                if kind != b"PK\3\4" or zlib.crc32(data) != info.CRC:
                    raise ValueError(f"member {info.filename} of {file}")
                return data
            except (OSError, ValueError, struct.error):
                if again + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**again)
            finally:
                if own is not None:
                    own.close()
        raise AssertionError

    def read(self, partition: ArchiveRange):
        store, folder = _open(self.path)
        for archive, start, end in partition.ranges:
            yield from self.read_range(store, f"{folder}/{archive}", archive, start, end)

    def read_range(self, store: fs.FileSystem, file: str, archive: str, start: int, end: int):
        names, rows, size = ["doc_id", "media", "archive", "offset"], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([archive] * len(rows), pa.string()), pa.array([r[2] for r in rows], pa.int64())], names)
        with store.open_input_file(file) as f:
            for m in (m for m in zipfile.ZipFile(f).infolist() if start <= m.header_offset < end):
                own = m.filename[:-4].partition("_")[2]
                rows.append((None if own == "null" else int(own), self.read_member(store, file, f, m), m.header_offset))
                size += len(rows[-1][1])
                if size >= 4 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """spark.read.format("media_archives").load(folder): doc_id, media, archive, offset."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, range_bytes: int = 8 << 20, tries: int = 3) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").option("rangeBytes", range_bytes).option("tries", tries).load(path)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of the stored images, computed from the bytes that were read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def compute(batches):
        for b in batches:
            rows = []
            for doc_id, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                n, p = decode_png(m)
                rows.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return in_batches(media.select("doc_id", "media"), compute, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    """Write every whole text as an image, read the archives back through the data source, compute features."""
    spark = docs.sparkSession
    return features(read_archives(spark, write_archives(docs, shared_dir(spark))))
