"""Media columns: text payloads as 8-bit images in archives, and a Spark data source that reads them by byte ranges.

Writing: each task puts its documents' payloads (UTF-8, with zero bytes up to a positive multiple of 64) as greyscale PNGs,
64 samples a row, into ZIP archives of about ARCHIVE bytes in the shared folder, named by task, so that a repeated task
writes the same names again.

Reading: the data source `media_archive` lists the archive directory and plans byte ranges of the archives (RANGE bytes);
a partition owns the members whose local header begins in its range. It reads each member by offset, checks its CRC and
retries that member alone (reopening the file) when a read fails or the CRC differs; members stream out in Arrow batches.

Null text is stored as the empty text. Null or repeated ids keep their rows: a member carries its own row's id. An empty
table gives no archive and no rows. store_and_describe deletes the archives once their values are written. Other columns are not read. A text of any length is one
member; memory is bounded by the longest text and by BATCH bytes.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repeatloom.llm import common

ROW = 64  # samples a row, and the multiple that payloads are padded to
ARCHIVE = 32 << 20
RANGE = 8 << 20
BATCH = 4 << 20
TRIES = 4

# Fixed values of the PNG and ZIP formats.
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = struct.Struct("<4sHHHHHIIIHH"), struct.Struct("<4sHHHHHHIIIHHHHHII"), struct.Struct("<4sHHHHIIH")
_END64, _END64_AT = struct.Struct("<4sQHHIIQQQQ"), struct.Struct("<4sIQI")


def padded(data: bytes) -> bytes:
    return data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A lossless 8-bit greyscale PNG whose samples are the payload; its text chunk holds the unpadded length."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples in reading order, and the unpadded length. Every chunk's CRC is checked."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, n, width = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered PNG row")
    return rows[:, 1:].tobytes(), n


class ArchiveWriter:
    """A ZIP archive of stored members, written front to back (64-bit end records where needed)."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        head = _LOCAL.pack(b"PK\3\4", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), 0) + raw
        self.entries.append((raw, crc, len(data), self.at))
        self.out.write(head)
        self.out.write(data)
        self.at += len(head) + len(data)

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            extra = struct.pack("<HHQ", 1, 8, at) if at >= 0xFFFFFFFF else b""
            head = _CENTRAL.pack(b"PK\1\2", 45, 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, min(at, 0xFFFFFFFF)) + raw + extra
            self.out.write(head)
            self.at += len(head)
        n, size = len(self.entries), self.at - start
        if n >= 0xFFFF or start >= 0xFFFFFFFF:
            self.out.write(_END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start) + _END64_AT.pack(b"PK\6\7", 0, self.at, 1))
        self.out.write(_END.pack(b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))
        self.out.close()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def directory(file, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, CRC, size, offset of the local header) of each member, from the archive's directory."""
    tail_at = max(0, size - 4096)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rindex(b"PK\5\6")
    n, length, start = (lambda e: (e[4], e[5], e[6]))(_END.unpack_from(tail, end))
    if n == 0xFFFF or start == 0xFFFFFFFF:
        big = _END64.unpack_from(tail, tail.rindex(b"PK\6\6", 0, end))
        n, length, start = big[7], big[8], big[9]
    raw, at = file.read_at(length, start), 0
    for _ in range(n):
        e = _CENTRAL.unpack_from(raw, at)
        name_at = at + _CENTRAL.size
        offset = e[16]
        if offset == 0xFFFFFFFF:
            (offset,) = struct.unpack_from("<Q", raw, name_at + e[10] + 4)
        yield raw[name_at : name_at + e[10]].decode(), e[7], e[8], offset
        at = name_at + e[10] + e[11] + e[12]


class ArchiveRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[ArchiveRange]:
        from pyarrow import fs

        system, path = _filesystem(self.uri)
        found = [x for x in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.path.endswith(".zip")]
        return [ArchiveRange(x.path, x.size, a, min(a + self.step, x.size)) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.step)] or [ArchiveRange("", 0, 0, 0)]

    @staticmethod
    def retried(what):
        """The result of what(), tried again after a failure."""
        for left in range(TRIES - 1, -1, -1):
            try:
                return what()
            except (OSError, struct.error, ValueError):
                if not left:
                    raise
                time.sleep(0.1 * (TRIES - left))

    def member(self, system, file, part: ArchiveRange, offset: int, size: int, crc: int) -> tuple[bytes, object]:
        """One member by offset; only it is read again after a failure, from a file opened anew."""
        held = [file]

        def once() -> bytes:
            own, held[0] = held[0] or system.open_input_file(part.path), None
            head = _LOCAL.unpack(own.read_at(_LOCAL.size, offset))
            data = own.read_at(size, offset + _LOCAL.size + head[9] + head[10])
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError(f"{part.path}: damaged member at {offset}")
            held[0] = own
            return data

        return self.retried(once), held[0]

    def read(self, part: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        system, _ = _filesystem(self.uri)

        def opened():
            file = system.open_input_file(part.path)
            return file, list(directory(file, part.size))

        file, listed = self.retried(opened)
        rows, held = [], 0
        for name, crc, size, offset in listed:
            if part.start <= offset < part.end:
                data, file = self.member(system, file, part, offset, size, crc)
                rows.append((part.path, name, offset, data))
                held += size
                if held >= BATCH:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        a, n, o, m = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(o, pa.int64()), pa.array(m, pa.binary())], names=["archive", "name", "offset", "media"])


class MediaArchive(DataSource):
    """Options: path (a directory of ZIP archives as a URI), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, name string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def member_name(row: int, key: str | None) -> str:
    """The row's number, and its id in hexadecimal so that any id comes back as it was; without a second part the id is null."""
    return f"{row:010d}.png" if key is None else f"{row:010d}-{key.encode('utf-8', 'surrogatepass').hex()}.png"


def write_archives(df: DataFrame, uri: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Writes the archives when the returned manifest (archive, members, bytes) is read. Members are named by row and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, top = _filesystem(uri)
        system.create_dir(top, recursive=True)
        context, writer, done, row = TaskContext.get(), None, [], 0
        task, attempt = context.partitionId(), context.taskAttemptId()

        def finish() -> None:
            writer.close()
            target = f"{top}/part-{task:06d}-{len(done):04d}.zip"
            system.move(f"{top}/.{attempt}-{len(done)}", target)
            done.append((target, len(writer.entries), writer.at))

        for b in batches:
            for key, text_ in zip(b.column(0).to_pylist(), b.column(1)):
                data = (text_.as_py() or "").encode("utf-8", "surrogatepass")
                if writer is None:
                    writer = ArchiveWriter(system.open_output_stream(f"{top}/.{attempt}-{len(done)}"))
                writer.add(member_name(row, key), to_png(padded(data), len(data)))
                row += 1
                if writer.at >= ARCHIVE:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        cols = list(zip(*done)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "members", "bytes"])

    return df.select(df[id].cast("string"), df[text]).mapInArrow(common.tidy(run), "archive string, members long, bytes long")


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """archive, name, offset, media, and id (string) from the member's name."""
    spark.dataSource.register(MediaArchive)
    out = spark.read.format("media_archive").option("path", uri).load()
    return out.withColumn("id", F.when(F.contains("name", F.lit("-")), F.decode(F.unhex(F.regexp_extract("name", r"^\d+-([0-9a-f]*)\.png$", 1)), "UTF-8")))


def features(payload: bytes) -> str:
    """Number, sum, sum of squares, least, greatest and number of steps up between neighbouring samples."""
    x = np.frombuffer(payload, np.uint8)
    wide = x.astype(np.int64)
    return f"n={len(x)};sum={int(wide.sum())};squares={int((wide * wide).sum())};min={int(x.min())};max={int(x.max())};rises={int((x[1:] > x[:-1]).sum())}"


def describe(media: DataFrame, kind: str = "bigint") -> DataFrame:
    """id (cast to kind) and what is computed from each stored form read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item in b.column(1):
                stored = item.as_py()
                payload, n = from_png(stored)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select(F.col("id").cast(kind), "media").mapInArrow(common.tidy(run), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_describe(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    spark = df.sparkSession
    uri = common.fresh_path(spark, "media")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    write_archives(df, uri, text, id).agg(F.sum("members")).collect()
    out = common.materialise(describe(read_archives(spark, uri), df.schema[id].dataType.simpleString()), "media-values")
    system, top = _filesystem(uri)
    if system.get_file_info(top).type.name == "Directory":  # an empty table makes none
        system.delete_dir(top)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_describe(common.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
