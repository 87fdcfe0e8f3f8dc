"""Token ids of a table in binary files, coded by static range asymmetric numeral systems.

Texts are dealt into ranges of ids and sorted; each task tokenizes its range and spools the ids, and how often each id
occurs in all texts gives the one frequency table that all blocks share. Then every spool becomes a file of its own:
independent blocks with checkpoints, an index of the documents, a directory of the blocks with their checksums. A
reader needs the table, the directory and the blocks that hold its documents, from the last checkpoint before them.
Files get new names with every attempt and count only if the manifest names them, so a task may run again at any time.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroscope.llm import rans
from aeroscope.llm.common import discard, early_cleanup, map_arrow, rows_out, saved
from aeroscope.llm.tokens import encoder
from aeroscope.session import scratch

MAGIC = b"RANS-IDS"
#: Offset and length of the documents' index and of the block directory, their checksums, the table's checksum.
FOOT = struct.Struct("<QQQQIII8s")
#: Ids that are coded or decoded at once in a task.
AT_ONCE = 32 * rans.BLOCK
#: Ids of a unit of reading: it has the documents that begin in it.
UNIT = 1 << 22
DIRECTORY = pa.schema([("offset", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())])


def pack_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def documents(ids: list, lengths: list[int], kind: pa.DataType) -> pa.Table:
    """The index of a file's documents: doc_id, first, tokens."""
    n = np.array(lengths, dtype=np.int64)
    return pa.table({"doc_id": pa.array(ids, kind), "first": pa.array(np.cumsum(n) - n), "tokens": pa.array(n)})


class TokenFile:
    """One file: its index, its directory, and the ids of any stretch of it."""

    def __init__(self, store: fs.FileSystem, path: str, table: rans.Table, table_crc: int):
        self.table, self.path, self.file = table, path, store.open_input_file(path)
        size = self.file.size()
        self.a, self.na, self.b, self.nb, crc_a, crc_b, crc_t, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or crc_t != table_crc:
            raise ValueError(f"{path} isn't a token file of this table")
        self.documents, self.directory = self.section(self.a, self.na, crc_a), self.section(self.b, self.nb, crc_b)
        self.first = self.documents.column("first").to_numpy()
        self.blocks = [x.to_numpy() for x in self.directory.columns]

    def section(self, at: int, n: int, crc: int) -> pa.Table:
        raw = self.file.read_at(n, at)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"checksum at {at} in {self.path}")
        return pa.ipc.open_stream(raw).read_all()

    def block(self, i: int) -> rans.Block:
        offset, n, crc = (int(x[i]) for x in self.blocks)
        raw = self.file.read_at(n, offset)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"checksum of block {i} in {self.path}")
        return rans.Block.of(raw)

    def ids(self, start: int, end: int) -> Iterator[np.ndarray]:
        """Ids from start up to end, from the last checkpoint before start, a bounded number at a time."""
        per = rans.BLOCK // rans.CHECK
        at = start // rans.CHECK * rans.CHECK
        while at < end:
            stop = min(end, at + AT_ONCE)
            segments = range(at // rans.CHECK, -(-stop // rans.CHECK))
            blocks = {b: self.block(b) for b in range(segments[0] // per, segments[-1] // per + 1)}
            for i, found in zip(segments, rans.decode(self.table, [(blocks[i // per], i % per) for i in segments])):
                here = i * rans.CHECK
                yield found[max(0, start - here) : end - here]
            at = segments[-1] * rans.CHECK + rans.CHECK


def write_file(store: fs.FileSystem, path: str, table: rans.Table, batches: Iterator[pa.RecordBatch]) -> tuple[int, int, int]:
    """Codes spooled batches (doc_id, ids) in their order; returns documents, ids and bytes."""
    held, waiting, directory, keys, lengths, kind = [], 0, [], [], [], pa.int64()
    with store.open_output_stream(path) as out:
        out.write(MAGIC)
        at = len(MAGIC)

        def flush(last: bool) -> None:
            nonlocal at, waiting
            ids = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
            whole = len(ids) if last else len(ids) // rans.BLOCK * rans.BLOCK
            for raw in rans.encode(table, ids[:whole]):
                out.write(raw)
                directory.append((at, len(raw), zlib.crc32(raw)))
                at += len(raw)
            held[:] = [ids[whole:]]
            waiting = len(ids) - whole

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            keys += batch.column("doc_id").to_pylist()
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), dtype=batch.schema.metadata[b"width"].decode())
                lengths.append(len(ids))
                for a in range(0, len(ids), AT_ONCE):
                    held.append(ids[a : a + AT_ONCE])
                    waiting += len(held[-1])
                    if waiting >= AT_ONCE:
                        flush(False)
        flush(True)
        a = pack_ipc(documents(keys, lengths, kind))
        b = pack_ipc(pa.Table.from_batches([rows_out(directory, DIRECTORY)]))
        out.write(a + b + FOOT.pack(at, len(a), at + len(a), len(b), zlib.crc32(a), zlib.crc32(b), zlib.crc32(table.to_bytes()), MAGIC))
    return len(keys), sum(lengths), at + len(a) + len(b) + FOOT.size


def spool(df: DataFrame, folder: str, vocabulary: str, id_col: str, text_col: str, end_id: int) -> tuple[DataFrame, str]:
    """Sorted ids of each range of documents in a file; returns part, path, documents, tokens, counts of the ids, and the id's type."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal ids are ordered by their text; the last key only spreads rows that are equal in both
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "nth"]
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        encode, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path = f"{base}/{part:08d}-{uuid.uuid4().hex}.arrow"
        out = writer = None
        docs, tokens, counts = 0, 0, np.zeros(1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [ids + end for ids in encode(batch.column("text"))]
            n = np.bincount(np.frombuffer(b"".join(raw), dtype="<u4"))
            if len(n) > len(counts):
                counts = np.pad(counts, (0, len(n) - len(counts)))
            counts[: len(n)] += n
            docs, tokens = docs + len(raw), tokens + int(n.sum())
            ids = pa.array(raw, pa.large_binary())
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("ids", ids.type)], metadata={"width": "<u4"})
            if writer is None:
                out = store.open_output_stream(path)
                writer = pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            writer.write_batch(pa.record_batch([batch.column("doc_id"), ids], schema=schema))
        if writer is not None:
            writer.close()
            out.close()
            seen = np.flatnonzero(counts)
            yield pa.record_batch({
                "part": pa.array([part]), "path": pa.array([path]), "documents": pa.array([docs]), "tokens": pa.array([tokens]),
                "ids": pa.array([seen]), "counts": pa.array([counts[seen]]),
            })

    return map_arrow(rows.select("doc_id", "text"), write, "part bigint, path string, documents bigint, tokens bigint, ids array<bigint>, counts array<bigint>"), kind


def merged(tables: pa.Table) -> pa.Table:
    """Sum of the counts of some parts, as one part."""
    ids = pc.list_flatten(tables.column("ids")).to_numpy()
    counts = pc.list_flatten(tables.column("counts")).to_numpy()
    found, to = np.unique(ids, return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, to, counts)
    return pa.table({"part": tables.column("part")[:1], "ids": pa.array([found], pa.list_(pa.int64())), "counts": pa.array([total], pa.list_(pa.int64()))})


def total_counts(counts: DataFrame, parts: int, fan: int = 16) -> list[tuple[int, int]]:
    """(id, how often) over all parts: they are summed by `fan` at a time, so at most `fan` vocabularies come to the driver."""
    step = 1
    while parts > fan:
        step, parts = step * fan, -(-parts // fan)
        counts = counts.groupBy(F.floor(F.col("part") / step)).applyInArrow(merged, "part bigint, ids array<bigint>, counts array<bigint>")
    rows = counts.toArrow()
    if not rows.num_rows:
        return []
    (row,) = merged(rows).to_pylist()
    return list(zip(row["ids"], row["counts"]))


def write_tokens(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Writes the ids of every text, with the end id behind it, to files in `folder`, in ascending order of the ids.

    `folder` is a URI that the driver and all executors reach. Null and empty texts have the end id alone. Ids may be
    null (they come last) or repeat (then by a hash of the text); rows that repeat are written each for itself. A text
    of any length stays one document over as many blocks as it needs. An empty table gives a manifest without files.
    Other columns of `df` are not read. To the driver come counts per vocabulary entry and one row a file.
    """
    spark = df.sparkSession
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/spool", recursive=True)
    with early_cleanup(spark):
        rows, kind = spool(df, f"{folder}/spool", vocabulary, id_col, text_col, end_id)
        spools = saved(rows, "token-spools")
    table = rans.Table.of_counts(total_counts(spools.select("part", "ids", "counts"), spools.count()))
    raw = table.to_bytes()
    with store.open_output_stream(f"{base}/frequencies") as out:
        out.write(raw)
    shared = spark.sparkContext.broadcast(raw)

    def code(batches):
        store, base = fs.FileSystem.from_uri(folder)
        table = rans.Table.from_bytes(shared.value)
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist()):
                name = f"{part:08d}-{uuid.uuid4().hex}.ids"
                with store.open_input_stream(path) as f:
                    done = write_file(store, f"{base}/{name}", table, iter(pa.ipc.open_stream(f)))
                yield rows_out([(part, name, *done)], pa.schema([
                    ("part", pa.int64()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()),
                ]))

    n = max(1, spools.count())
    files = spools.select("part", "path").repartitionByRange(n, "part")
    written = map_arrow(files, code, "part bigint, name string, documents bigint, tokens bigint, bytes bigint").collect()  # a row a file
    manifest, start = [], 0
    for r in sorted(written):
        manifest.append({"name": r["name"], "documents": r["documents"], "start": start, "tokens": r["tokens"], "bytes": r["bytes"]})
        start += r["tokens"]
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"id_type": kind, "tokens": start, "files": manifest}).encode())
    discard(spark, f"{folder}/spool")


@lru_cache(4)
def _open(folder: str, name: str) -> TokenFile:
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/frequencies") as f:
        raw = f.read()
    return TokenFile(store, f"{base}/{name}", rans.Table.from_bytes(raw), zlib.crc32(raw))


def unit_documents(file: TokenFile, unit: int) -> Iterator[tuple[object, int, list[np.ndarray]]]:
    """doc_id, first and ids (in pieces) of the documents that begin in a unit of the file."""
    lo, hi = np.searchsorted(file.first, [unit * UNIT, (unit + 1) * UNIT])
    if lo == hi:
        return
    rows = file.documents.slice(lo, hi - lo)
    firsts, sizes = rows.column("first").to_numpy(), rows.column("tokens").to_numpy()
    parts, left = file.ids(int(firsts[0]), int(firsts[-1] + sizes[-1])), np.zeros(0, dtype=np.uint32)
    for key, first, n in zip(rows.column("doc_id").to_pylist(), firsts.tolist(), sizes.tolist()):
        pieces, need = [], n
        while need > len(left):
            pieces.append(left)
            need -= len(left)
            left = next(parts)
        pieces.append(left[:need])
        left = left[need:]
        yield key, first, pieces


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as little-endian bytes) of each document, decoded from the files."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = f"doc_id {manifest['id_type']}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    rows = [(x["name"], x["start"], k) for x in manifest["files"] for k in range(-(-x["tokens"] // UNIT))]
    if not rows:
        return spark.createDataFrame([], schema)
    units = spark.createDataFrame(rows, "name string, start bigint, unit bigint").repartitionByRange(min(len(rows), 10_000), "start", "unit")

    def read(batches):
        for batch in batches:
            for name, start, unit in zip(*map(pa.Array.to_pylist, batch.columns)):
                file = _open(folder, name)
                kinds = [file.documents.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
                out, held = [], 0
                for key, first, pieces in unit_documents(file, unit):
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.astype("<u4", copy=False), crc)
                    n = sum(map(len, pieces))
                    out.append((key, start + first, n, crc, *([b"".join(p.astype("<u4").tobytes() for p in pieces)] if with_ids else [])))
                    held += 64 + (4 * n if with_ids else 0)
                    if held > 4 << 20:
                        yield rows_out(out, pa.schema(list(zip(schema_names, kinds))))
                        out, held = [], 0
                yield rows_out(out, pa.schema(list(zip(schema_names, kinds))))

    schema_names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    return map_arrow(units, read, schema)


def through_files(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Ids written and read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    folder = scratch(df.sparkSession, "token-files")
    write_tokens(df, folder, vocabulary, id_col, text_col, end_id)
    return read_tokens(df.sparkSession, folder)
