"""Repeated substrings with a logarithmic family of sampled suffix arrays.

Of every window of `least` bytes one suffix is sampled: the one whose first GRAM bytes have the smallest hash (the last
of equals). Equal windows sample the same suffix of theirs, so any long match has a sampled suffix in both places. An entry stands for
a sampled suffix and the run of windows that chose it. It carries the hash of the suffix's first bytes and the hash of
all that its windows cover; entries sorted by these are the suffix array, in which equal suffixes are neighbours.

New batches get a suffix array each. It is merge-scanned with the arrays that exist: entries that have an equal
neighbour are matches. Arrays of about equal size become one in the same scan, so a family has logarithmically many.
A neighbour that is equal in all its windows settles them. Where neighbours are equal only in the first bytes, both sides
of each such border are compared further, in scans of the same kind: first by blocks of windows, of which those with
another common core are compared window by window. An entry equal to all that it hides stands at each border.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeroscope.llm.common import discard, early_cleanup, map_arrow, row_hash, saved
from aeroscope.session import scratch

LEAST = 200
GRAM = 32
#: Batches in which a whole table is added.
BATCHES = 2
#: Windows of one block.
BLOCK = 8
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
PLACE = np.uint64(PIECE * 2 - 1)

ENTRY = "a bigint, cell bigint, doc_id {id}, row bigint, s bigint, n int, o int, kind int"
KEYS = ["a", "cell", "doc_id", "row", "s"]
NAMES = [*KEYS, "n", "o", "kind"]
MARK = ["doc_id", "row", "s", "n", "o", "kind"]
#: Kinds add up: a neighbour equal in the first bytes only, and one equal in all windows.
SAME_START, SAME_WINDOWS = 1, 2


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Sampler:
    """Entries of a text's sampled suffixes, by rolling hashes modulo 2^64."""

    def __init__(self, least: int, gram: int):
        self.least, self.gram, self.size = least, min(gram, least), 0
        self.byte = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) | 1 for b in range(256)], dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.up = _powers(BASE, self.size)
            self.down = _powers(pow(BASE, -1, 1 << 64), self.size)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Of each GRAM bytes."""
        n, k = len(data), self.gram
        self.grow(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        return h

    def entries(self, text: bytes):
        """Yields (a, cell, s, n, o): hash of the suffix's start, hash of the windows' bytes, first window, how many, and
        where the suffix starts in the first. A run that goes on in the next piece is one entry."""
        for a, p, s, e in self.runs(text):
            yield a, signed(xxhash.xxh3_64_intdigest(text[s : e - 1 + self.least], p - s)), s, e - s, p - s

    def runs(self, text: bytes):
        """Yields (a, p, s, e): hash of the suffix's start, where it stands, first window and the one after the last."""
        held = None
        for at in range(0, len(text) - self.least + 1, PIECE):
            raw = text[at : at + PIECE + self.least - 1]
            h = self.hashes(np.frombuffer(raw, dtype=np.uint8))
            place = np.arange(len(h), dtype=np.uint64)
            low = (h & ~PLACE) | (PLACE - (place & PLACE))
            width, m = self.least - self.gram + 1, 1
            while 2 * m <= width:
                low = np.minimum(low[:-m], low[m:])
                m *= 2
            if m < width:
                low = np.minimum(low[: len(low) - (width - m)], low[width - m :])
            first = np.arange(len(low), dtype=np.uint64)
            chosen = first + ((PLACE - (low & PLACE) - first) & PLACE)
            turn = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
            starts = np.concatenate([[0], turn])
            ends = np.concatenate([turn, [len(low)]])
            anchors = chosen[starts].astype(np.int64)
            for a, p, s, e in zip(h[anchors].view(np.int64).tolist(), (at + anchors).tolist(), (at + starts).tolist(), (at + ends).tolist()):
                if held and held[1] == p:
                    s = held[2]
                elif held:
                    yield held
                held = a, p, s, e
        if held:
            yield held


def to_arrow(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def entries_of(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ENTRY, with the id's type as in a batch."""
    return to_arrow(rows, [pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], NAMES)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (tells rows with equal ids apart), text as bytes."""
    return df.select(
        F.col(id_col).alias("doc_id"), row_hash(df).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )


def suffixes(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Entries of all texts, with kind 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        sampler = Sampler(least, gram)
        for batch in batches:
            out = []
            for doc_id, row, text in zip(*map(pa.Array.to_pylist, batch.columns)):
                out += [(a, c, doc_id, row, s, n, o, 0) for a, c, s, n, o in sampler.entries(text)]
                if len(out) > 100_000:
                    yield entries_of(out, batch)
                    out = []
            yield entries_of(out, batch)

    return map_arrow(docs, each, ENTRY.format(id=kind))


def merge_scan(entries: DataFrame) -> DataFrame:
    """Sorts entries (with src) and adds to the kind of those with an equal neighbour; src 2 repeats each task's ends.

    The sort is by ranges of all keys, so a suffix that stands very often is spread over many tasks. Rows with src 1
    are returned only where their kind changes.
    """
    kind = entries.schema["doc_id"].dataType.simpleString()
    dealt = entries.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)

    def scan(batches):
        held = None
        begun = False

        def renewed(rows: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
            columns = [values if f.name == name else c for f, c in zip(rows.schema, rows.columns)]
            return pa.RecordBatch.from_arrays(columns, rows.schema.names)

        def settled(rows: pa.RecordBatch, old: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
            rows = renewed(rows, "kind", pa.array(new, pa.int32()))
            return rows.filter(pa.array((rows.column("src").to_numpy(zero_copy_only=False) != 1) | (new > old)))

        def edge(row: pa.RecordBatch) -> pa.RecordBatch:
            return renewed(row, "src", pa.array([2], pa.int32()))

        before = after = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                begun = True
                yield edge(batch.slice(0, 1))
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            a, cell = (table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "cell"))
            old = table.column("kind").to_numpy(zero_copy_only=False)
            if held is not None:
                old = np.r_[before, old[1:]].astype(np.int32)
            same = np.where(a[1:] == a[:-1], np.where(cell[1:] == cell[:-1], SAME_WINDOWS, SAME_START), 0).astype(np.int32)
            new = old.copy()
            if held is not None:
                new[0] = after
            new[1:] |= same
            new[:-1] |= same
            done = table.num_rows - 1
            if done:
                yield settled(table.slice(0, done), old[:done], new[:done])
            held, before, after, only = table.slice(done, 1), old[done:], new[done], table.num_rows == 1
        if held is not None:
            yield settled(held, before, np.array([after], dtype=np.int32))
            if not only:
                yield edge(held)

    return map_arrow(dealt.select("src", *NAMES), scan, f"src int, {ENTRY.format(id=kind)}")


def edge_marks(scanned: DataFrame) -> DataFrame:
    """Marks of entries whose equal neighbour lies in another task: two rows a task are compared."""
    order = Window.orderBy(*KEYS)
    rows = scanned.where("src = 2")
    kind = F.lit(0)
    for step in (F.lag, F.lead):
        same = (step("a").over(order) == F.col("a"))
        equal = same & (step("cell").over(order) == F.col("cell"))
        kind = kind.bitwiseOR(F.when(equal, SAME_WINDOWS).when(same, SAME_START).otherwise(0))
    return rows.withColumn("kind", kind).where("kind > 0").select(*MARK)


@dataclass
class Level:
    size: int
    path: str


@dataclass
class SuffixFamily:
    """Suffix arrays of geometrically growing sizes, and the matches found so far."""

    spark: SparkSession
    schema: str
    levels: list[Level] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, src int").parquet(path)

    def add(self, batch: DataFrame) -> None:
        """Merge-scans a batch of entries with all levels; levels not much larger than what is being merged join it."""
        size, merged = batch.count(), []
        if not size:
            return
        total = size
        for level in sorted(self.levels, key=lambda x: x.size):
            if level.size > 2 * total:
                break
            merged.append(level)
            total += level.size
        rows = batch.withColumn("src", F.lit(0))
        for level in self.levels:
            rows = rows.unionByName(self.read(level.path).where("src = 0").withColumn("src", F.lit(0 if level in merged else 1)))
        path = scratch(self.spark, "suffix-level")
        merge_scan(rows).write.partitionBy("src").parquet(path)
        self.found += [self.read(path).where("src = 1").select(*MARK), edge_marks(self.read(path))]
        for level in merged:
            self.retire(level)
        self.levels = [x for x in self.levels if x not in merged] + [Level(total, path)]

    def retire(self, level: Level) -> None:
        """Drops a merged level's entries; its matches stay."""
        discard(self.spark, f"{level.path}/src=0")

    def matches(self) -> DataFrame:
        """MARK of entries with an equal neighbour anywhere; an entry may come more than once."""
        out = self.found[0] if self.found else self.spark.createDataFrame([], self.schema).select(*MARK)
        for rows in [*self.found[1:], *[self.read(x.path).where("src = 0 AND kind > 0").select(*MARK) for x in self.levels]]:
            out = out.unionByName(rows)
        return out


def join_rows(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    l, r = docs.alias("l"), marks.alias("r")
    rest = [F.col(f"r.{c}") for c in marks.columns if c not in ("doc_id", "row")]
    return l.join(r, (F.col("l.row") == F.col("r.row")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), how).select("l.*", *rest)


def blocks_of(text: bytes, s: int, n: int, o: int, least: int):
    """Blocks of a run's windows, cut at multiples of BLOCK from where its suffix starts: (core, cover, s, n, o).

    The core lies in every window of the block, whatever part of it the run has; the cover holds them all.
    """
    start = s + o  # of the suffix
    for j in range((o - n + 1) // BLOCK, o // BLOCK + 1):
        far, near = min(o, j * BLOCK + BLOCK - 1), max(o - n + 1, j * BLOCK)
        first, last = start - j * BLOCK - BLOCK + 1, start - j * BLOCK
        core = xxhash.xxh3_64_intdigest(text[last : first + least], j)
        whole = first >= 0 and last + least <= len(text)
        # a block that the text cuts has no cover: its windows are compared one by one
        cover = xxhash.xxh3_64_intdigest(text[first : last + least], j) if whole else xxhash.xxh3_64_intdigest(text, start)
        yield signed(core), signed(cover), start - far, far - near + 1, far


def windows_of(text: bytes, s: int, n: int, o: int, least: int):
    """Each window of a run as an entry of its own, by 128 bits of its hash."""
    for i in range(s, s + n):
        h = xxhash.xxh3_128_intdigest(text[i : i + least])
        yield signed(h >> 64), signed(h & (1 << 64) - 1), i, 1, 0


def refine(docs: DataFrame, marks: DataFrame, least: int, parts) -> DataFrame:
    """Compares the parts of marked runs that are equal to a neighbour in the first bytes only; the marks of the parts."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = marks.where(F.col("kind").bitwiseAND(SAME_START) > 0).groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "n", "o")).alias("runs"))

    def each(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row, text, found in zip(*map(pa.Array.to_pylist, batch.columns)):
                for x in found:
                    out += [(a, c, doc_id, row, s, n, o, 0) for a, c, s, n, o in parts(text, x["s"], x["n"], x["o"], least)]
                    if len(out) > 100_000:
                        yield entries_of(out, batch)
                        out = []
            yield entries_of(out, batch)

    entries = map_arrow(join_rows(docs, runs, "inner").select("doc_id", "row", "text", "runs"), each, ENTRY.format(id=kind))
    before, after = scratch(spark, "suffix-parts"), scratch(spark, "suffix-parts")
    entries.write.parquet(before)
    merge_scan(spark.read.schema(ENTRY.format(id=kind)).parquet(before).withColumn("src", F.lit(0))).write.partitionBy("src").parquet(after)
    discard(spark, before)
    scanned = spark.read.schema(f"{ENTRY.format(id=kind)}, src int").parquet(after)
    out = saved(scanned.where("src = 0 AND kind > 0").select(*MARK).unionByName(edge_marks(scanned)), "suffix-marks")
    discard(spark, after)
    return out


def cover(runs: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that the windows of runs (first, how many) cover."""
    out: list[list[int]] = []
    for s, n in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + least)
        else:
            out.append([s, s + n - 1 + least])
    return [tuple(x) for x in out]


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, batches: int = BATCHES
) -> DataFrame:
    """One row per row of `df`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of removed bytes).

    A byte is removed if a string of `least` bytes that covers it also starts anywhere else, in the same text or
    another; texts are UTF-8, null ones empty, matches never cross texts and all are judged on the input. Rows that are
    equal in all columns are texts of their own, so both lose what they share. An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    with early_cleanup(spark):
        path = scratch(spark, "suffixes")
        entries = suffixes(docs, least, gram)
        entries.withColumn("batch", F.pmod(F.col("row"), F.lit(batches))).write.partitionBy("batch").parquet(path)
        family = SuffixFamily(spark, ENTRY.format(id=kind))
        for i in range(batches):
            family.add(spark.read.schema(f"{ENTRY.format(id=kind)}, batch int").parquet(path).where(f"batch = {i}").drop("batch"))
            discard(spark, f"{path}/batch={i}")
        marks = saved(family.matches(), "suffix-marks")
        for level in family.levels:
            family.retire(level)
        blocks = refine(docs, marks, least, blocks_of)
        singles = refine(docs, blocks, least, windows_of)
        equal = marks.unionByName(blocks).unionByName(singles).where(F.col("kind").bitwiseAND(SAME_WINDOWS) > 0)
        runs = saved(equal.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "n")).alias("runs")), "suffix-runs")

    def each(arrow):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in arrow:
            out = []
            for doc_id, _, text, found in zip(*map(pa.Array.to_pylist, batch.columns)):
                spans = cover([(x["s"], x["n"]) for x in found or ()], least)
                keep, at = hashlib.sha256(), 0
                for a, b in spans:
                    keep.update(text[at:a])
                    at = b
                keep.update(text[at:])
                out.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), keep.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            yield to_arrow(out, [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), span], names)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return map_arrow(join_rows(docs, runs, "left"), each, schema)
