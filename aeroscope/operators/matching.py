"""Greedy one-to-one matching by score, exact for groups of any size.

A pair's score is at most what the two texts' character counts allow. A group is decided best first: candidates wait in
order of that bound, a text pair is scored only when its bound comes up, and a scored pair is final when no bound is
above it. As matched texts drop out, most pairs are never scored. Equal texts are one entry with many ids, so copies
that tie cost one step each. Groups whose pairs would not fit into a task's memory go in rounds over the whole cluster.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.functions.fuzzy import _places, indel_ratio, ratio_of
from aeroscope.idioms import running, salted
from aeroscope.session import cut, scratch

SMALL_GROUP = 50_000
#: Pairs of rows up to which one task holds the bounds of a group (8 bytes each).
HELD_PAIRS = 8_000_000


def _twins(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equal texts score 1 and come first: the n-th left copy goes with the n-th right copy.

    Ranks are counted in blocks, so a text that fills a third of the table stays splittable."""
    one = {"nth": F.lit(1)}
    l = running(left.select(*keys, "i", "txt"), [*keys, "txt"], "i", one)
    r = running(right.select(*keys, "j", "txt"), [*keys, "txt"], "j", one)
    return l.join(r, [*keys, "txt", "nth"]).select(*keys, "i", "j", F.lit(1.0).alias("score"))


def scored_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float, salts: int = 4
) -> DataFrame:
    """Pairs of different texts at or above the threshold.

    Each distinct text pair of a group is scored once. The length bound 2 * min / (la + lb) >= threshold drops
    pairs before scoring; a big group is split by salt; pairs below the threshold never leave the task.
    """
    keys = list(keys)
    a = left.select(*keys, F.col("txt").alias("a")).distinct().withColumn("la", F.length("a"))
    b = right.select(*keys, F.col("txt").alias("b")).distinct().withColumn("lb", F.length("b"))
    a, b = salted(a, b, salts, ["a"])
    bound = 2 * F.least("la", "lb") >= threshold * (F.col("la") + F.col("lb"))
    texts = (
        a.join(b, [*keys, "salt"])
        .where(bound & (F.col("a") != F.col("b")))
        .select(*keys, "a", "b", indel_ratio("a", "b").alias("score"))
        .where(F.col("score") >= threshold)
    )
    l = left.select(*keys, "i", F.col("txt").alias("a"))
    r = right.select(*keys, "j", F.col("txt").alias("b"))
    return texts.join(l, [*keys, "a"]).join(r, [*keys, "b"]).select(*keys, "i", "j", "score")


def _choose(keys: list[str]):
    """Pass over pairs sorted by keys and rank; only the ids taken in the group at hand are kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used_i, used_j = None, set(), set()
        for batch in batches:
            keep = []
            for g, i, j in zip(zip(*[batch[k] for k in keys]), batch["i"], batch["j"]):
                if g != group:
                    group, used_i, used_j = g, set(), set()
                ok = i not in used_i and j not in used_j
                if ok:
                    used_i.add(i)
                    used_j.add(j)
                keep.append(ok)
            yield batch[keep]

    return run


def greedy_pairs(pairs: DataFrame, keys: Sequence[str], small: int = SMALL_GROUP) -> DataFrame:
    """One-to-one choice by score desc, then i, then j.

    Groups of a checked size are decided in one task each. Larger groups run in rounds over the whole
    cluster: a pair that is the best of both its ends is final, its rivals are dropped, until none is left.
    """
    keys = list(keys)
    pairs = cut(pairs)
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("size"))
    big_keys = sizes.where(F.col("size") > small).select(*keys)
    few = pairs.join(big_keys, keys, "left_anti")
    ranked = few.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), "i", "j")
    done = ranked.mapInPandas(_choose(keys), pairs.schema)
    rest = cut(pairs.join(big_keys, keys, "left_semi"))
    while not rest.isEmpty():
        order = F.struct((-F.col("score")).alias("s"), "i", "j")
        best_i = rest.groupBy(*keys, "i").agg(F.min(order).alias("bi"))
        best_j = rest.groupBy(*keys, "j").agg(F.min(order).alias("bj"))
        final = cut(
            rest.join(best_i, [*keys, "i"])
            .join(best_j, [*keys, "j"])
            .where((F.col("bi") == order) & (F.col("bj") == order))
            .select(*pairs.columns)
        )
        done = done.unionByName(final)
        rest = cut(
            rest.join(final.select(*keys, "i"), [*keys, "i"], "left_anti").join(
                final.select(*keys, "j"), [*keys, "j"], "left_anti"
            )
        )
    return done


class Side:
    """Distinct texts of one side of a group, each with its ids in order."""

    def __init__(self, ids: list[int], texts: list[str]):
        found: dict[str, list[int]] = {}
        for i, t in sorted(zip(ids, texts)):
            found.setdefault(t, []).append(i)
        self.texts, self.ids = list(found), list(found.values())
        self.taken = [0] * len(found)
        self.place = dict(zip(found, range(len(found))))

    def free(self) -> list[int]:
        """Texts that have an id left."""
        return [k for k, ids in enumerate(self.ids) if self.taken[k] < len(ids)]

    def next(self, k: int) -> int | None:
        """Smallest id of text k that is free."""
        return self.ids[k][self.taken[k]] if self.taken[k] < len(self.ids[k]) else None


def bounds(left: list[str], right: list[str]) -> Iterator[np.ndarray]:
    """For each left text the highest scores that character counts allow with all right texts."""
    axis: dict[str, int] = {}
    for t in right:
        for c in t:
            axis.setdefault(c, len(axis))
    counts = np.zeros((len(right), len(axis)), dtype=np.int32)
    for k, t in enumerate(right):
        for c, n in Counter(t).items():
            counts[k, axis[c]] = n
    lengths = np.array([len(t) for t in right])
    for t in left:
        own = [(axis[c], n) for c, n in Counter(t).items() if c in axis]
        at = [k for k, _ in own]
        common = np.minimum(counts[:, at], np.array([n for _, n in own], dtype=np.int32)).sum(axis=1)
        total = lengths + len(t)
        yield np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def best_first(left: Side, right: Side, threshold: float) -> tuple[list[tuple[int, int, float]], int]:
    """Greedy pairs (i, j, score) by score desc, then i, then j; and how many text pairs were scored.

    Only equal texts score 1, so they are paired first, without bounds or scores; bounds are drawn up for what is left.
    """
    out, scored = [], 0
    for a, text in enumerate(left.texts if threshold <= 1 else ()):
        b = right.place.get(text)
        if b is not None:
            both = list(zip(left.ids[a], right.ids[b]))
            out += [(i, j, 1.0) for i, j in both]
            left.taken[a] = right.taken[b] = len(both)
    rest_a, rest_b = left.free(), np.array(right.free(), dtype=np.int64)
    if not rest_a or not len(rest_b):
        return out, scored
    waiting: list[tuple] = []  # (-bound, 0, a, place in a's order) or (-score, 1, i, j, a, b)
    orders, places = {}, {}
    for a, most in zip(rest_a, bounds([left.texts[a] for a in rest_a], [right.texts[b] for b in rest_b])):
        order = np.argsort(-most, kind="stable")
        order = order[: np.count_nonzero(most >= threshold)]
        orders[a] = rest_b[order].tolist(), most[order].tolist()
        if len(order):
            waiting.append((-orders[a][1][0], 0, a, 0))
    heapq.heapify(waiting)
    while waiting:
        top = heapq.heappop(waiting)
        if top[1]:
            score, _, i, j, a, b = top
            now = left.next(a), right.next(b)
            if None in now:
                continue
            if now == (i, j):
                out.append((i, j, -score))
                left.taken[a] += 1
                right.taken[b] += 1
                now = left.next(a), right.next(b)
            if None not in now:
                heapq.heappush(waiting, (score, 1, *now, a, b))
            continue
        _, _, a, k = top
        i = left.next(a)
        if i is None:
            continue
        order, most = orders[a]
        if k + 1 < len(order):
            heapq.heappush(waiting, (-most[k + 1], 0, a, k + 1))
        b = order[k]
        j = right.next(b)
        if j is None:
            continue
        if a not in places:
            places[a] = _places(left.texts[a])
        score = ratio_of(left.texts[a], right.texts[b], places[a])
        scored += 1
        if score >= threshold:
            heapq.heappush(waiting, (-score, 1, i, j, a, b))
    return out, scored


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before it; NaN equals NaN, as in Spark's grouping."""
    before, now = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.equal(before, now)
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.and_(pc.is_nan(before), pc.is_nan(now)))
    return ~same.to_numpy()


def _sorted_matches(keys: list[str], threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Match groups as they come by, sorted by keys: a task takes many small groups in one call and holds one at a time."""

    def decide(group: list[tuple]) -> list[tuple]:
        left, right = ([(i, t) for s, i, t in group if s == own] for own in (True, False))
        return best_first(Side(*zip(*left)), Side(*zip(*right)), threshold)[0] if left and right else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, kinds = [], None, None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            table = pa.Table.from_batches([batch]).drop_null()  # null keys and texts match nothing
            if not len(table):
                continue
            rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "id", "txt"))))
            names = [table.column(k) for k in keys]
            starts = np.flatnonzero(np.logical_or.reduce([_changes(c) for c in names])) + 1 if len(rows) > 1 else []
            out = []
            for a, b in zip([0, *starts], [*starts, len(rows)]):
                own = tuple(c[int(a)].as_py() for c in names)
                if own != name and not (name and all(x == y or (x != x and y != y) for x, y in zip(own, name))):
                    out += [(*name, *found) for found in decide(held)] if held else []
                    held, name = [], own
                held += rows[a:b]
            if out:
                yield packed(out, kinds)
        if held and (out := [(*name, *found) for found in decide(held)]):
            yield packed(out, kinds)

    def packed(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        types = [*kinds, pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*keys, "i", "j", "score"])

    return run


def in_rounds(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Matches of groups of any size: equal texts, then scored pairs in rounds over the whole cluster."""
    spark = left.sparkSession

    def kept(df: DataFrame) -> DataFrame:  # read more than once below
        path = scratch(spark, "matches")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    left, right = kept(left), kept(right)
    twins = kept(_twins(left, right, keys))
    rest_l = left.join(twins.select(*keys, "i"), [*keys, "i"], "left_anti")
    rest_r = right.join(twins.select(*keys, "j"), [*keys, "j"], "left_anti")
    return twins.unionByName(kept(greedy_pairs(scored_pairs(rest_l, rest_r, keys, threshold), keys)))


def greedy_match(left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float, held: int = HELD_PAIRS) -> DataFrame:
    """Match left (keys, i, txt) and right (keys, j, txt) by indel ratio at or above the threshold.

    Ids are whole numbers and unique within a group and side. Null keys or texts match nothing.
    """
    keys = list(keys)
    rows = left.select(*keys, F.lit(True).alias("side"), F.col("i").cast("bigint").alias("id"), "txt").unionByName(
        right.select(*keys, F.lit(False).alias("side"), F.col("j").cast("bigint").alias("id"), "txt")
    )
    sizes = rows.groupBy(*keys).agg(F.count_if("side").alias("n"), F.count_if(~F.col("side")).alias("m"))
    big = cut(sizes.where(F.col("n").cast("double") * F.col("m") > held).select(*keys))
    whole = big.isEmpty()
    few = rows if whole else rows.join(big, keys, "left_anti")
    kinds = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys)
    streams = few.repartition(*keys).sortWithinPartitions(*keys)
    out = streams.mapInArrow(_sorted_matches(keys, threshold), f"{kinds}, i bigint, j bigint, score double")
    if not whole:
        out = out.unionByName(in_rounds(left.join(big, keys, "left_semi"), right.join(big, keys, "left_semi"), keys, threshold))
    return cut(out)  # a match table is small next to its inputs and read by several metrics


def fuzzy_score(a: Column, b: Column) -> Column:
    """Record text score: lower case, trimmed; an empty side gives 0."""
    x, y = F.trim(F.lower(F.coalesce(a, F.lit("")))), F.trim(F.lower(F.coalesce(b, F.lit(""))))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(indel_ratio(x, y))
