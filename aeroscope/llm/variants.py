"""Spelling variants one edit apart, found by k-d trees over letter-count vectors.

One edit changes a word's letter counts by one letter lost, one gained, or both: at most 2 in L1. For each length a
k-d tree splits the words by their counts into cells; the tree comes from a bounded sample, which only decides how even
the cells are. A word is searched for in every cell whose box its range can reach, among words of its length, one longer
and one shorter. Inside a cell a k-d tree over its words prunes by boxes again, and what is left is verified letter by
letter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroscope.llm.common import map_arrow, saved

#: Shortest word, occurrences that it needs, and how much more often its form must be.
CHARS, COUNT, RATIO = 6, 5, 5
#: Of so many runs of a document, one loses a letter.
EVERY = 199
#: Words of a cell, words that a search compares at once, and about how many words the trees are made from.
CELL, LEAF, SAMPLE = 4096, 64, 50_000
#: Entries that a task counts before it hands them on, and characters of a text taken at once.
HELD, SLICE = 400_000, 1 << 22
#: Letters in one byte each: a-z, and the upper half of Latin-1 as it is. A-Z go to lower case, the rest to spaces.
LETTERS = [*range(97, 123), *range(192, 256)]
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS else 32 for b in range(256))
AXIS = np.zeros(256, dtype=np.int64)
AXIS[LETTERS] = np.arange(len(LETTERS))
#: Gains and losses of letters on the way to a near word of the same length, one longer, one shorter.
MOVES = {0: (1, 1), 1: (1, 0), -1: (0, 1)}


def runs(text: str) -> Iterator[list[bytes]]:
    """Runs of letters, a slice of the text at a time."""
    folded, at = text.encode("latin-1", "replace").translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if at + SLICE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def count_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n: all words that are long enough, after the deletions, combined in each task."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        seen: Counter = Counter()

        def flush():
            words = list(seen)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.record_batch({"word": pa.array([w.decode("latin-1") for w in part], pa.string()), "n": pa.array([seen[w] for w in part], pa.int64())})
            seen.clear()

        for batch in batches:
            for id_, text in zip(*map(pa.Array.to_pylist, batch.columns)):
                start = zlib.crc32(f"{id_}:".encode())
                for found in runs(text):
                    for word, n in Counter([w for w in found if len(w) >= CHARS]).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % EVERY == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        if len(word) >= CHARS:
                            seen[word] += n
                if len(seen) > HELD:
                    yield from flush()
        yield from flush()

    return map_arrow(rows, count, "word string, n bigint")


def codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row each."""
    n = len(words[0]) if words else 0
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), n)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts."""
    axes, out = AXIS[letters], np.zeros((len(letters), len(LETTERS)), dtype=np.int16 if letters.shape[1] < 1 << 15 else np.int64)
    if letters.shape[1] > 4 * len(LETTERS):  # a long word
        for a in range(len(LETTERS)):
            out[:, a] = (axes == a).sum(axis=1)
        return out
    every = np.arange(len(letters))
    for k in range(letters.shape[1]):
        out[every, axes[:, k]] += 1
    return out


def parities(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each letter's count is odd, as bits of two words."""
    odd = (counts & 1).astype(np.uint64)
    bit = np.arange(len(LETTERS), dtype=np.uint64) % np.uint64(45)
    return tuple((odd[:, a:b] << bit[a:b]).sum(axis=1, dtype=np.uint64) for a, b in ((0, 45), (45, 90)))


class KdTree:
    """Splits of letter-count space by one letter's count each, until a part has `size` of the points or can't be split."""

    def __init__(self, points: np.ndarray, size: float):
        #: (axis, bound, below, above), or (-1, number of the leaf, 0, 0)
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self.grow(points, size)

    def grow(self, points: np.ndarray, size: float) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, self.leaves, 0, 0))
        if len(points) > size:
            axis, bound = self.best(points)
            if axis >= 0:
                low = points[:, axis] <= bound
                below = self.grow(points[low], size)
                above = self.grow(points[~low], size)
                self.nodes[at] = axis, bound, below, above
                return at
        self.leaves += 1
        return at

    @staticmethod
    def best(points: np.ndarray) -> tuple[int, int]:
        """The axis with the greatest spread, and its most even bound; (-1, 0) if all points are equal."""
        axis = int(points.var(axis=0).argmax())
        values, counts = np.unique(points[:, axis], return_counts=True)
        if len(values) < 2:
            return -1, 0
        k = int(np.abs(2 * np.cumsum(counts)[:-1] - len(points)).argmin())
        return axis, int(values[k])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), dtype=np.int64)
        for leaf, which in self.reach(points, 0, 0):
            out[which] = leaf
        return out

    def reach(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points) where a leaf's box can be reached with `up` letters gained and `down` lost.

        The two parts of the L1 distance to the box are kept apart, so a box needs to be near in both.
        """
        none = np.zeros(len(points), dtype=np.int64)
        waiting = [(0, np.arange(len(points)), none, none, {})]
        while waiting:
            at, which, gain, loss, box = waiting.pop()
            axis, bound, below, above = self.nodes[at]
            if axis < 0:
                if len(which):
                    yield bound, which
                continue
            value = points[which, axis].astype(np.int64)
            lo, hi = box.get(axis, (-1, 1 << 62))  # of counts above lo, up to hi
            over = np.maximum(value - hi, 0)
            under = np.maximum(lo + 1 - value, 0)
            for child, (a, b) in ((below, (lo, bound)), (above, (bound, hi))):
                g = gain - under + np.maximum(a + 1 - value, 0)
                s = loss - over + np.maximum(value - b, 0)
                near = (g <= up) & (s <= down)
                if near.any():
                    waiting.append((child, which[near], g[near], s[near], box | {axis: (a, b)}))


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one letter replaced, or one inserted in the longer side."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(axis=1) == 1
    if left.shape[1] > right.shape[1]:
        left, right = right, left
    n = left.shape[1]
    front = np.logical_and.accumulate(left == right[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate(left[:, ::-1] == right[:, ::-1][:, :n], axis=1).sum(axis=1)
    return front + back >= n


def near_pairs(points: list[str], queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) numbers of near words, once each. Points have one length, queries that or one more or less."""
    letters = codes(points)
    counts = vectors(letters)
    tree = KdTree(counts, LEAF)
    order = np.argsort(leaf := tree.leaf_of(counts), kind="stable")
    bounds = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    odd = parities(counts)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(queries):
        by_length.setdefault(len(w), []).append(i)
    for n, numbers in by_length.items():
        numbers = np.array(numbers)
        for a in range(0, len(numbers), 20_000):
            part = numbers[a : a + 20_000]
            own = codes([queries[i] for i in part])
            own_counts = vectors(own)
            own_odd = parities(own_counts)
            up, down = MOVES[letters.shape[1] - n]
            for leaf, which in tree.reach(own_counts, up, down):
                here = order[bounds[leaf] : bounds[leaf + 1]]
                for b in range(0, len(here), 4 * LEAF):  # more only where words have equal counts
                    some = here[b : b + 4 * LEAF]
                    for c in range(0, len(which), 4096):
                        w = which[c : c + 4096]
                        apart = sum(np.bitwise_count(x[w][:, None] ^ y[some]) for x, y in zip(own_odd, odd))
                        q, p = np.nonzero(apart == up + down)
                        q, p = w[q], some[p]
                        ok = one_edit(own[q], letters[p])
                        if ok.any():
                            yield part[q[ok]], p[ok]


def search(table: pa.Table) -> pa.Table:
    """Of one cell: word, near (how many of the cell's words), best_n and best_word among them."""
    rows = table.filter(pc.invert(table.column("query")))
    points, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    queries = table.filter(table.column("query")).column("word").to_pylist()
    near: dict[int, int] = {}
    best: dict[int, tuple[int, str]] = {}
    for qs, ps in near_pairs(points, queries) if points and queries else ():
        for q, p in zip(qs.tolist(), ps.tolist()):
            near[q] = near.get(q, 0) + 1
            found = -int(n[p]), points[p]
            if q not in best or found < best[q]:
                best[q] = found
    return pa.table({
        "word": pa.array([queries[q] for q in near], pa.string()), "near": pa.array(list(near.values()), pa.int64()),
        "less": pa.array([best[q][0] for q in near], pa.int64()), "best": pa.array([best[q][1] for q in near], pa.string()),
    })


def trees(words: DataFrame, cell: int, sample: int) -> dict[int, KdTree]:
    """A tree for each length that has more than `cell` words, from those whose hash is in the first part of about `sample`."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    first = F.shiftrightunsigned(F.xxhash64("word"), 1) <= int(min(1.0, sample / total) * ((1 << 63) - 1024))
    by_length: dict[int, list[str]] = {n: [] for n in sizes}
    for r in words.where(F.length("word").isin(list(sizes)) & first).select("word").collect():
        by_length[len(r["word"])].append(r["word"])
    taken = sum(map(len, by_length.values()))
    return {n: KdTree(vectors(codes(sorted(ws))), cell * taken / total) for n, ws in by_length.items() if ws}


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, best (struct less, word: minus the occurrences of its most frequent near word, and that word), where any."""
    spark = words.sparkSession
    words = words.repartition(1 + words.count() // CELL, "word")  # small rows with much work each
    splits = spark.sparkContext.broadcast(trees(words, cell, sample))  # about a node per cell

    def leaves(batch: pa.RecordBatch, up_to: int) -> Iterator[tuple[list[str], np.ndarray, int, int, np.ndarray]]:
        """(words, their numbers in the batch, length of the cells, leaf, which of the words) that reach a leaf."""
        found, kinds = batch.column("word").to_pylist(), splits.value
        lengths = np.array([len(w) for w in found])
        for n in np.unique(lengths).tolist():
            numbers = np.flatnonzero(lengths == n)
            own = [found[i] for i in numbers]
            counts = vectors(codes(own))
            for step in (0, 1, -1)[:up_to]:
                up, down = MOVES[step] if up_to > 1 else (0, 0)
                tree = kinds.get(n + step)
                for leaf, which in tree.reach(counts, up, down) if tree else [(0, np.arange(len(own)))]:
                    yield own, numbers, n + step, leaf, which

    def sizes(batches):
        for batch in batches:
            out = [(n, leaf, len(which)) for _, _, n, leaf, which in leaves(batch, 1)]
            yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in zip(("length", "leaf", "n"), zip(*out) if out else ((), (), ()))})

    counted = map_arrow(words, sizes, "length bigint, leaf bigint, n bigint").groupBy("length", "leaf").agg(F.sum("n").alias("n"))
    # words with equal counts, or a part that the sample has missed, are dealt over parts of a cell
    large = {(r["length"], r["leaf"]): -(-r["n"] // cell) for r in counted.where(F.col("n") > 2 * cell).collect()}
    parts = spark.sparkContext.broadcast(large)  # fewer than there are cells

    def deal(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            for own, numbers, length, leaf, which in leaves(batch, 1):
                cut = parts.value.get((length, leaf), 1)
                part = [zlib.crc32(own[i].encode()) % cut for i in which]
                yield rows_of(length, leaf, part, False, [own[i] for i in which], n[numbers[which]])
            for own, _, length, leaf, which in leaves(batch, 3):
                if length < CHARS:
                    continue
                for part in range(parts.value.get((length, leaf), 1)):
                    yield rows_of(length, leaf, [part] * len(which), True, [own[i] for i in which], np.zeros(len(which), dtype=np.int64))

    def rows_of(length: int, leaf: int, part: list[int], query: bool, found: list[str], n: np.ndarray) -> pa.RecordBatch:
        size = len(found)
        return pa.record_batch({
            "length": pa.array(np.full(size, length)), "leaf": pa.array(np.full(size, leaf)), "part": pa.array(part, pa.int64()),
            "query": pa.array([query] * size), "word": pa.array(found, pa.string()), "n": pa.array(n, pa.int64()),
        })

    dealt = map_arrow(words, deal, "length bigint, leaf bigint, part bigint, query boolean, word string, n bigint")
    found = dealt.groupBy("length", "leaf", "part").applyInArrow(search, "word string, near bigint, less bigint, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", F.col("best").alias("word"))).alias("best"))


def follow(forms: DataFrame, most: int) -> DataFrame:
    """word, root: where chains of (word, form) end. Each step has RATIO times the occurrences, so chains are short."""
    steps = max(1, math.floor(math.log(max(RATIO, most / COUNT), RATIO)) + 1)
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = saved(now.join(ahead, now["root"] == ahead["at"], "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return now


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least CHARS letters and COUNT occurrences.

    Words are maximal runs of Latin-1 letters, A-Z lower-cased; of every document some runs lose a letter, by a checksum
    of its id and the run. A word's form is its near word (one letter more, less or other) with the most occurrences, the
    smallest of equals, if it has RATIO times its own; its root is where forms lead. Null texts have no words, a null id
    counts as empty text. Rows that repeat count each. Texts of any length are read slice by slice. An empty table gives
    no rows. Other columns of `df` are not read.
    """
    words = saved(count_words(df, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT), "variant-words")
    near = near_words(words, cell, sample)
    form = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    rows = words.join(near, "word", "left").select(
        "word", form["word"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), (-form["less"]).alias("form_n")
    )
    rows = saved(rows, "variant-forms")
    roots = follow(rows.where("form IS NOT NULL"), words.agg(F.max("n")).first()[0] or 0)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
