"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most r of 64 bits agree on all bits of some choice of blocks, if the bits are cut into
more than r blocks. So fingerprints meet in one group per choice. In a group they are stored as bit planes: word w of
plane p holds bit p of 64 fingerprints. A query's differences to all of them are counted plane by plane in carry-save
counters, 64 at a time, and words in which every lane has passed the radius are left out from then on.
Groups larger than a tile are cut into tiles that are compared pairwise, each pair in a task of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.llm.common import map_arrow, row_hash, saved, unused
from aeroscope.llm.graph import components

BITS = 64
#: Fingerprints of one tile: bounds what a task holds.
TILE = 4096
#: Words of one step: queries times words of a plane.
STEP = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """SimHash of the word shingles, repeats included; a bit is set if more than half of the hashes have it."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    line, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    first = [0, *ends[: len(last) - 1].tolist()]
    hashes = np.array([hash_of(line[a:b], seed) for a, b in zip(first, last)], dtype="<u8")
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Vertical storage: [bit, word] of uint64; unused lanes of the last word are zero."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def count_up(planes, masks, order, counters):
    """Adds planes[p] ^ masks[p] for each p of `order` to the counters (ones, twos, fours, eight or more), in place."""
    ones, twos, fours, more = counters
    for p in order:
        carry = planes[p] ^ masks[p]
        for c in (ones, twos, fours):
            c ^= carry
            carry &= ~c  # a lane overflows where it was set before and is clear now
        more |= carry


def passed(counters, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius (0 to 7)."""
    ones, twos, fours, more = counters
    over, equal = more.copy(), np.full_like(more, ALL)
    for c, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= c
        else:
            over |= equal & c
            equal &= ~c
    return over


def near(queries: np.ndarray, prints: np.ndarray, radius: int, skip: frozenset[int] = frozenset()):
    """Yields (query positions, print positions) of all pairs within the radius; `skip` holds bits known to be equal."""
    planes = planes_of(prints)
    words = planes.shape[1]
    order = [p for p in range(BITS) if p not in skip]
    tail = ALL if len(prints) % 64 == 0 else np.uint64((1 << len(prints) % 64) - 1)
    per = max(1, STEP // words)
    for at in range(0, len(queries), per):
        chunk = queries[at : at + per]
        bits = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64)
        masks = (np.uint64(0) - bits)[:, :, None]  # all ones where the query's bit is set
        counters = [np.zeros((len(chunk), words), dtype=np.uint64) for _ in range(4)]
        count_up(planes[:, None, :], masks, order[:24], counters)
        alive_q, alive_w = np.nonzero(passed(counters, radius) != ALL)
        counters = [c[alive_q, alive_w] for c in counters]
        masks = masks[:, :, 0]
        for i in range(24, len(order), 8):
            step = order[i : i + 8]
            count_up({p: planes[p][alive_w] for p in step}, {p: masks[p][alive_q] for p in step}, step, counters)
            left = np.flatnonzero(passed(counters, radius) != ALL)
            if len(left) < len(alive_q):  # abandoned: every lane is over the radius
                alive_q, alive_w, counters = alive_q[left], alive_w[left], [c[left] for c in counters]
        close = ~passed(counters, radius)
        close[alive_w == words - 1] &= tail
        rows, lanes = np.nonzero(np.unpackbits(close.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield at + alive_q[rows], alive_w[rows] * 64 + lanes


class Forest:
    """Keeps of a stream of links only those that join two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        while len(a):
            la, lb = self.label[a], self.label[b]
            new = la != lb
            a, b, la, lb = a[new], b[new], la[new], lb[new]
            if not len(a):
                break
            # each tree's link to its smallest linked tree: no cycles, and every tree with links is joined
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.r_[True, high[1:] != high[:-1]]
            high, low = high[first], low[first]
            out += zip(low.tolist(), high.tolist())
            to = np.arange(len(self.label))
            to[high] = low
            while not np.array_equal(to, to[to]):
                to = to[to]
            self.label = to[self.label]
        return out


def tables_for(count: int, radius: int, size: int) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """Choices of equal blocks, and the bits of each block: the fewest blocks with groups of about `size` at most."""
    blocks = radius + 1
    while count > size << (BITS // blocks * (blocks - radius)) and blocks < 2 * radius + 2:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return list(combinations(range(blocks), blocks - radius)), [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp): enough of them to keep every component whole."""
    choices, blocks = tables_for(prints.count(), radius, 4 * tile)
    masks = [sum(1 << p for b in choice for p in blocks[b]) for choice in choices]
    signed = [m - (1 << BITS if m >> 63 else 0) for m in masks]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])
    rows = prints.select("fp", F.posexplode(keys).alias("choice", "key"))
    big = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select(
        "choice", "key", F.ceil(F.col("n") / tile * 1.25).cast("int").alias("tiles")
    )
    rows = rows.join(big, ["choice", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    at = ["choice", "key", "low", "high"]
    rows = rows.select("choice", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")
    dealt = rows.repartition(*at).sortWithinPartitions(*at)

    def compare(choice: int, fp: np.ndarray, own: np.ndarray, low: int, high: int):
        left = fp[own == low] if low != high else fp
        right = fp[own == high] if low != high else fp
        both = fp if low == high else np.concatenate([left, right])
        shift = 0 if low == high else len(left)
        if not len(left) or not len(right) or len(both) < 2:
            return
        skip = frozenset(p for b in choices[choice] for p in blocks[b])
        block_masks = [np.uint64(sum(1 << p for p in b)) for b in blocks]
        forest = Forest(len(both))
        for q, c in near(left, right, radius, skip):
            keep = q < c if low == high else np.ones(len(q), dtype=bool)
            q, c = q[keep], c[keep]
            # a pair is the business of the first choice that has it
            diff = left[q] ^ right[c]
            same = [(diff & m) == 0 for m in block_masks]
            for earlier in choices[:choice]:
                seen = np.ones(len(q), dtype=bool)
                for b in earlier:
                    seen &= same[b]
                q, c, same = q[~seen], c[~seen], [s[~seen] for s in same]
            for a, b in forest.add(q, c + shift):
                yield both[a], both[b]

    def scan(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        held: tuple | None = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def finish():
            fp = np.concatenate([p[0] for p in parts]).view(np.uint64)
            found = list(compare(held[0], fp, np.concatenate([p[1] for p in parts]), held[2], held[3]))
            if found:
                u, v = (np.array(x, dtype=np.uint64).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in (*at, "own", "fp")]
            if not batch.num_rows:
                continue
            turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows]):
                key = tuple(int(c[a]) for c in cols[:4])
                if held is not None and key != held:
                    yield from finish()
                    parts.clear()
                held = key
                parts.append((cols[5][a:b], cols[4][a:b]))
        if parts:
            yield from finish()

    return map_arrow(dealt, scan, "u bigint, v bigint")


def fingerprints(df: DataFrame, text_col: str, columns: list[Column], width: int, seed: int) -> DataFrame:
    """`columns` and fp (bigint, the unsigned value's bits); a null text counts as empty."""
    rows = df.select(*columns, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def each(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return map_arrow(rows, each, f"{schema}, fp bigint")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4, tile: int = TILE
) -> DataFrame:
    """One row per row of `df`: doc_id, row_hash, fp, component_id, keeper.

    component_id is the smallest id reachable over links, null only if the component has no id at all. row_hash covers
    all columns; (component_id, keeper) names the one row of the component that a filter keeps, equal rows being one.
    Null and empty texts have the fingerprint zero and are linked like any other. An empty table gives no rows.
    """
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold radii from 0 to 7")
    rows = saved(fingerprints(df, text_col, [F.col(id_col).alias("doc_id"), row_hash(df).alias("row_hash")], width, seed), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first")
    prints = saved(rows.groupBy("fp").agg(first), "prints")
    found = components(links(prints.select("fp"), radius, tile))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = saved(named, "named")
    low = named.groupBy("root").agg(F.min("first").alias("low"))
    classes = saved(named.join(low, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.row_hash").alias("keeper")), "classes")
    return rows.join(classes, "fp").select("doc_id", "row_hash", "fp", "component_id", "keeper")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of `df`, one of each near-duplicate group: that with the smallest id; equal rows count as one."""
    found = near_duplicates(df, id_col, text_col, **options).where("doc_id <=> component_id AND row_hash = keeper")
    kept = found.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    own = unused(df, "_row")
    rows = df.withColumn(own, row_hash(df))
    rows = rows.join(kept, (rows[own] == kept["_hash"]) & rows[id_col].eqNullSafe(kept["_id"]), "left_semi")
    return rows.dropDuplicates([id_col, own]).drop(own)
