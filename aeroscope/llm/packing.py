"""Packing by best-fit decreasing.

Overlong documents are first cut into full windows. The rest goes, longest first, each piece into the tightest
open window, which a segment tree indexed by remaining capacity finds. Pieces of one length are alike, so the
tree works on the histogram of lengths: at most one entry per possible length, whatever the number of documents.
Its plan says, for each length, which ranks go to which windows; Spark ranks the pieces and looks them up.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.idioms import running
from aeroscope.llm import mixing
from aeroscope.llm.common import map_arrow, quoted, rows_out, saved
from aeroscope.llm.tokens import encoder

#: Pieces of a length that one rank group holds on average: a length has as many groups as its pieces ask for.
RANK_GROUP = 128
#: Slots of the mix that are packed together.
SLOTS = 1024


class CapacityTree:
    """Counts of open windows by remaining capacity; `tightest(n)` is the smallest capacity >= n in use."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = [False] * (2 * self.leaves)

    def mark(self, capacity: int, used: bool) -> None:
        i = self.leaves + capacity
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = self.leaves + need
        while not self.used[i]:
            while i & 1:  # climb while there is nothing to the right below the same parent
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.leaves


def plan_windows(histogram: Mapping[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first rank, first window, pieces per window, offset).

    A row holds from its first rank up to that of the next row of the same length. Equal pieces go on filling one
    window while it takes them, as it stays the tightest, so a row says how many each window of the range gets.
    """
    tree, windows = CapacityTree(size), {}  # remaining capacity: ranges (first window, how many)
    plan, opened = [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            windows.setdefault(capacity, deque()).append((first, count))
            tree.mark(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = size // length
                first, count, room = opened, -(-left // each), size
                opened += count
            else:
                first, count = windows[room].popleft()
                if not windows[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(count, left // each)
            for start, n, per in ((first, full, each), (first + full, min(1, count - full), left - full * each)):
                if n and 0 < per <= each and left:
                    plan.append((length, rank, start, per, size - room))
                    put(room - per * length, start, n)
                    rank, left, first, count = rank + n * per, left - n * per, first + n, count - n
            put(room, first, count)
    return plan


def tokenize(df: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most `size` tokens: id, start, length, ids_crc32, doc_tokens. A null text counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    step = 4 * size

    def cut(batches):
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                raw += end
                tokens = len(raw) // 4
                for at in range(0, len(raw), step):
                    piece = raw[at : at + step]
                    out.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), tokens))
            yield rows_out(out, pa.schema([
                ("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()),
                ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
            ]))

    return map_arrow(source, cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def assign(pieces: DataFrame, size: int, group: int = RANK_GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1 to `size`. Equal pieces are interchangeable."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_windows(histogram, size)  # at most `size` lengths come to the driver
    spread = spark.createDataFrame([(n, max(1, c // group)) for n, c in histogram.items()], "length bigint, parts bigint")
    columns = [c for c in pieces.columns if c != "length"]
    dealt = pieces.join(F.broadcast(spread), "length")  # a row per length
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts"))).drop("parts")
    same = ["length", "part"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(*same).agg(F.count("*").alias("n")).select(
        *same, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy(*same).orderBy(*columns)
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(first, same)
    ranked = ranked.select(*pieces.columns, (F.col("first") + F.col("place")).alias("rank"))
    shared = spark.sparkContext.broadcast(np.array(sorted(plan), dtype=np.int64).reshape(-1, 5))

    def place(batches):
        lengths, ranks, windows, each, offsets = shared.value.T
        starts = (lengths << 48) + ranks
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(starts, (length << 48) + rank, side="right") - 1
            nth = rank - ranks[row]
            window, offset = windows[row] + nth // each[row], offsets[row] + nth % each[row] * length
            names = [f.name for f in batch.schema][:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(window), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return map_arrow(ranked, place, f"{schema}, sequence_id bigint, offset bigint")


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have one token, the end id. Rows that repeat, or share an id, are packed each for itself;
    an id may be null. An empty table gives no rows. Other columns of `df` are not read.
    """
    return assign(saved(tokenize(df, id_col, text_col, vocabulary, size, end_id), "pieces"), size)


def tokenize_whole(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """One row per document: doc_id, source, pieces (start, length, ids_crc32), doc_tokens."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source_kind = rows.schema["source"].dataType.simpleString()
    piece = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def cut(batches):
        encode = encoder(vocabulary)
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * size
        for batch in batches:
            pieces, tokens = [], []
            for raw in encode(batch.column("text")):
                raw += end
                parts = [(at, raw[at : at + step]) for at in range(0, len(raw), step)]
                pieces.append([{"start": at // 4, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for at, p in parts])
                tokens.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(pieces, piece), pa.array(tokens, pa.int64())], ["doc_id", "source", "pieces", "doc_tokens"]
            )

    schema = f"doc_id {kind}, source {source_kind}, pieces array<struct<start:bigint,length:bigint,ids_crc32:bigint>>, doc_tokens bigint"
    return map_arrow(rows, cut, schema)


def assign_in_ranges(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `range` (bigint from 0): sequences of a range follow those of the one before.

    Each range is planned by best-fit decreasing in a task of its own, from its histogram of lengths.
    """

    def plan(table: pa.Table) -> pa.Table:
        histogram = dict(zip(table.column("length").to_pylist(), table.column("n").to_pylist()))
        found = sorted(plan_windows(histogram, size))
        ends = [b[1] if a[0] == b[0] else histogram[a[0]] for a, b in zip(found, [*found[1:], (0, 0)])]
        windows = max((w + -(-(end - first) // each) for (_, first, w, each, _), end in zip(found, ends)), default=0)
        rows = [(n, first, end, w, each, offset) for (n, first, w, each, offset), end in zip(found, ends)] + [(0, 0, 0, windows, 1, 0)]
        names = ["length", "first", "end", "window", "each", "at"]
        columns = {k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows))}
        return pa.table({"range": pa.array([table.column("range")[0].as_py()] * len(rows), pa.int64()), **columns})

    histogram = pieces.groupBy("range", "length").agg(F.count("*").alias("n"))
    plans = saved(
        histogram.groupBy("range").applyInArrow(plan, "range bigint, length bigint, first bigint, end bigint, window bigint, each bigint, at bigint"), "packing-plans"
    )
    opened = running(plans.where("length = 0").select("range", "window"), [], "range", {"until": F.col("window")}, block=4096)
    opened = opened.select("range", (F.col("until") - F.col("window")).alias("begin"))
    plans = plans.where("length > 0").join(opened, "range")
    columns = [c for c in pieces.columns if c != "range"]
    inside = Window.partitionBy("range", "length").orderBy(*[c for c in columns if c != "length"])
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1)
    placed = ranked.join(plans, ["range", "length"]).where("rank >= first AND rank < end")  # a plan has few rows a length
    nth = F.col("rank") - F.col("first")
    window = F.col("begin") + F.col("window") + F.floor(nth / F.col("each"))
    return placed.select(*columns, window.cast("bigint").alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).cast("bigint").alias("offset"))


def pack_mixed(
    df: DataFrame,
    shares: Mapping[str, int],
    block: int,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: int = 2048,
    end_id: int = 1,
    slots: int = SLOTS,
) -> DataFrame:
    """`pack`, with sequences in the order of the mix: each `slots` slots of the schedule are packed together.

    So every stretch of sequences has the sources by their weights, as far as the schedule can hold them (see
    `mixing.mix`). Rows without a slot, whose source has no share, come behind all others. Nulls, repeats, the empty
    table and other columns as in `pack`.
    """
    documents = saved(tokenize_whole(df, id_col, text_col, source_col, vocabulary, size, end_id), "tokenized")
    mixed = mixing.mix(documents, shares, block, columns=["doc_id", "pieces", "doc_tokens"])
    last = F.lit(1 << 40) + F.pmod(F.xxhash64("row.doc_id", "row.pieces"), F.lit(1 << 20))  # no order among those without a slot
    rows = mixed.select(F.coalesce(F.floor(F.col("slot") / slots).cast("bigint"), last).alias("range"), "row.doc_id", "row.doc_tokens", F.explode("row.pieces").alias("p"))
    pieces = saved(rows.select("range", "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens"), "pieces")
    return assign_in_ranges(pieces, size)


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row, ascending in the order of part files and rows in which a table was written as Parquet.

    `df` is such a table as read; any other one is written first.
    """
    try:
        df.select("_metadata.row_index").schema
    except AnalysisException:
        df = saved(df, "ordered")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    number = lambda pattern: F.regexp_extract(F.substring_index("file", "/", -1), pattern, 1).try_cast("bigint")
    ends = df.select(file.alias("file"), row.alias("row")).groupBy("file").agg((F.max("row") + 1).alias("n"))
    w = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)"), "file").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("begin"))  # a row per file
    rows = df.select("*", file.alias("file"), row.alias("row"))
    return rows.join(begins, "file").select(*[quoted(c) for c in df.columns], (F.col("begin") + F.col("row")).alias(name))


def pack_ordered(
    df: DataFrame, vocabulary: str, documents: int, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
) -> DataFrame:
    """`pack`, with sequences in the order in which the table lies in its files: every `documents` rows are packed together.

    The order is that of `in_file_order`. Nulls, repeats, the empty table and other columns as in `pack`.
    """
    placed = in_file_order(df.select(quoted(id_col), quoted(text_col)), "place")
    tokens = tokenize_whole(placed, id_col, text_col, "place", vocabulary, size, end_id)
    rows = tokens.select(F.floor(F.col("source") / documents).cast("bigint").alias("range"), "doc_id", "doc_tokens", F.explode("pieces").alias("p"))
    pieces = saved(rows.select("range", "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens"), "pieces")
    return assign_in_ranges(pieces, size)
