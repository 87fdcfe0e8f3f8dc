"""Media columns: payloads kept as members of zip archives, read by a data source of its own.

`write_media` stores payloads as 8-bit mono sound files, lossless, in archives in a shared folder. The data source
`media_archive` lists the folder and plans one partition per byte range of an archive; a task reads the archive's
directory, takes the members that start in its range, and streams them in Arrow batches of bounded bytes. A member that
can't be read or fails its checksum is read again by its own offset, without the others.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from aeroscope.llm.common import map_arrow, rows_out
from aeroscope.session import scratch

FORMAT = "media_archive"
#: Payloads are padded with spaces to a multiple of this.
UNIT = 192
#: Bytes after which a task begins another archive, of one read range, and of one batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 4 << 20
#: Members at which an archive ends: the writer and each reader of a range hold its directory in memory.
ARCHIVE_MEMBERS = 50_000
ATTEMPTS = 3
RATE = 8000
HEADER = 44


def to_sound(payload: bytes) -> bytes:
    """An 8-bit mono PCM sound file; the payload's length must be even."""
    return struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)
    ) + payload


def from_sound(media: bytes) -> bytes:
    """The samples of `to_sound`."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack_from("<I", media, 40)[0] != len(media) - HEADER:
        raise ValueError("not a sound file of this kind")
    return media[HEADER:]


def feature(payload: bytes) -> str:
    """Lowest and highest sample, their sum, crossings of the middle, and the sum of steps between neighbours."""
    x = np.frombuffer(payload, dtype=np.uint8)
    step = np.abs(np.diff(x.astype(np.int16)))
    return f"{x.min()}:{x.max()}:{int(x.sum(dtype=np.int64))}:{int(np.count_nonzero(np.diff(x >= 128)))}:{int(step.sum(dtype=np.int64))}"


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT)


class ArchiveWriter:
    """One task's archives. A finished one is moved to a name that only its partition decides, so that a task that runs
    again replaces its files by equal ones; input that is read from files comes in the same order each time."""

    def __init__(self, folder: str, partition: int):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.partition, self.n, self.out, self.zip, self.bytes, self.members = partition, 0, None, None, 0, 0

    def add(self, name: str, note: str, media: bytes) -> None:
        if self.zip is None:
            self.temporary = f"{self.base}/_{self.partition}-{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary)
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
            self.bytes = self.members = 0
        info = zipfile.ZipInfo(name)
        info.compress_type, info.comment = zipfile.ZIP_DEFLATED, note.encode()
        self.zip.writestr(info, media)
        self.bytes += info.compress_size
        self.members += 1

    def full(self) -> bool:
        return self.zip is not None and (self.bytes >= ARCHIVE_BYTES or self.members >= ARCHIVE_MEMBERS)

    def close(self) -> tuple[str, int] | None:
        """Path and members of the archive that this ends."""
        if self.zip is None:
            return None
        self.zip.close()
        self.out.close()
        path = f"{self.base}/part-{self.partition:06d}-{self.n:04d}.zip"
        self.store.move(self.temporary, path)
        self.n, self.zip = self.n + 1, None
        return path, self.members


def write_media(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Stores the padded UTF-8 of every text in archives in `folder`; returns how many. A null text counts as empty.

    `folder` is a URI that the driver and all executors reach (file:, s3:, gs:, hdfs: and others that Arrow knows).
    The member's name is the id, its note the unpadded length; ids may be null or repeat.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def write(batches):
        writer = ArchiveWriter(folder, TaskContext.get().partitionId())
        done = []
        for batch in batches:
            for id_, data in zip(*map(pa.Array.to_pylist, batch.columns)):
                writer.add("null" if id_ is None else f"={id_}", str(len(data)), to_sound(pad(data)))
                if writer.full():
                    done.append(writer.close())
        done.append(writer.close())
        yield rows_out([x for x in done if x], pa.schema([("path", pa.string()), ("members", pa.int64())]))

    written = map_arrow(rows, write, "path string, members bigint").agg(F.sum("members")).first()[0]
    return written or 0


@dataclass
class ByteRange(InputPartition):
    """Members of an archive whose entry begins at start or later, but before end."""

    path: str
    start: int
    end: int


class MediaArchives(DataSource):
    """spark.read.format("media_archive").load(folder): archive, offset, name, note, media."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, offset bigint, name string, note string, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[InputPartition]:
        """Byte ranges from the sizes of the archives: names starting with _ are unfinished."""
        store, base = fs.FileSystem.from_uri(self.folder)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".zip"))
        return [ByteRange(p, a, min(a + self.range_bytes, n)) for p, n in found for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("note", pa.string()), ("media", pa.binary())])
        store = fs.FileSystem.from_uri(self.folder)[0]
        out, held = [], 0
        for info in members(store, partition) if partition.path else ():
            media = read_member(store, partition.path, info)
            out.append((partition.path, info.header_offset, info.filename, info.comment.decode(), media))
            held += len(media)
            if held >= BATCH_BYTES:
                yield rows_out(out, schema)
                out, held = [], 0
        if out:
            yield rows_out(out, schema)


def members(store: fs.FileSystem, part: ByteRange) -> list[zipfile.ZipInfo]:
    """Entries of the archive's directory that begin in the range."""
    with store.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
        return [i for i in z.infolist() if part.start <= i.header_offset < part.end]


#: The open archive of this process: members are read by offset, one after the other.
_open: dict[str, pa.NativeFile] = {}


def read_member(store: fs.FileSystem, path: str, info: zipfile.ZipInfo, attempts: int = ATTEMPTS) -> bytes:
    """One member by its offset; opened anew and read again if that fails or the checksum is wrong."""
    for left in range(attempts - 1, -1, -1):
        try:
            if path not in _open:
                for f in _open.values():
                    f.close()
                _open.clear()
                _open[path] = store.open_input_file(path)
            return decode(_open[path], info)
        except (OSError, ValueError, zlib.error, zipfile.BadZipFile):
            _open.pop(path, None)
            if not left:
                raise
    raise AssertionError


def decode(f: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
    # the local entry repeats the name and may have another extra field than the directory: read a little more at first
    guess = 30 + len(info.orig_filename.encode()) + info.compress_size
    raw = f.read_at(guess, info.header_offset)
    name, extra = struct.unpack_from("<HH", raw, 26) if raw[:4] == b"PK\x03\x04" else (None, None)
    if name is None:
        raise zipfile.BadZipFile(f"no entry at {info.header_offset}")
    begin = 30 + name + extra
    if len(raw) < begin + info.compress_size:
        raw = f.read_at(begin + info.compress_size, info.header_offset)
    data = raw[begin : begin + info.compress_size]
    media = zlib.decompress(data, -15) if info.compress_type == zipfile.ZIP_DEFLATED else data
    if zlib.crc32(media) != info.CRC or len(media) != info.file_size:
        raise zipfile.BadZipFile(f"checksum of the entry at {info.header_offset}")
    return media


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """archive, offset, name, note, media of every member in the folder's archives."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored members."""

    def each(batches):
        for batch in batches:
            out = []
            for name, note, stored in zip(*map(pa.Array.to_pylist, batch.columns)):
                payload = from_sound(stored)
                out.append((
                    name[1:] if name[0] == "=" else None, int(note), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), feature(payload),
                ))
            yield rows_out(out, pa.schema([
                ("id", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
            ]))

    return map_arrow(
        media.select("name", "note", "media"), each,
        "id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )


def through_archives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored and read back: doc_id and what `describe` finds.

    Null and empty texts become one unit of spaces. Rows that repeat, or share an id, are members of their own. Equal
    texts give equal values. An empty table gives no rows. Other columns of `df` are not read.
    """
    folder = scratch(df.sparkSession, "media")
    write_media(df, folder, id_col, text_col)
    found = describe(read_media(df.sparkSession, folder))
    return found.select(F.col("id").cast(df.schema[id_col].dataType).alias("doc_id"), *found.columns[1:])
