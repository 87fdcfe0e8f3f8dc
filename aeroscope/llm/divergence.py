"""Divergence between the sources of a language, by hash-consed segment trees over term ids.

Terms of a language that enough of its documents have are dealt into tiles by hash; inside a tile, term ids follow the
order of the terms. There each source has a segment tree over the ids whose leaves are its counts. Trees are
hash-consed: equal subtrees, of whatever sources and places, are one node. Two sources are compared by walking their
trees together, level by level; pairs of nodes that come again are priced once. A tile adds its price to the pair.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.llm.common import discard, map_arrow, saved
from aeroscope.session import scratch

#: Documents of the language that a term must be in; terms listed per group; what probabilities are multiples of.
LEAST, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms of a tile, and sources of a block: a task compares two blocks of sources in one tile.
TILE, SIDE = 2048, 32
#: Entries that a task counts before it hands them on, and bytes of a text taken at once.
HELD, SLICE = 500_000, 1 << 22
#: A-Z to lower case, everything else below 128 that isn't a letter to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a slice of it at a time."""
    rest = b""
    for at in range(0, len(text), SLICE):
        part = rest + text[at : at + SLICE].translate(FOLD)
        if at + SLICE < len(text):
            cut = part.rfind(b" ") + 1
            part, rest = part[:cut], part[cut:]
        yield part.split()


COUNTED = "lang string, term string, docs bigint, sources array<struct<source:string,n:bigint>>"


def count_terms(df: DataFrame, text_col: str, lang_col: str, source_col: str, least: int) -> DataFrame:
    """Counts of each task (COUNTED), of three kinds.

    Rows with docs have the documents of a term in the task; the counts per source are with them if the documents are
    fewer than `least`. If not, the term is kept for sure, and its counts come in a row of their own, without docs. So
    no term gathers more than one short row a task where its documents are added up. Rows without a term name groups.
    """
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    rows = df.select(*group, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def table(lang: str, words: pa.Array, docs: pa.Array, ends: np.ndarray, names: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        sources = pa.StructArray.from_arrays([names, pa.array(n, pa.int64())], ["source", "n"])
        out = pa.record_batch({
            "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(words), dtype=np.int32))), "term": words, "docs": docs,
            "sources": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sources),
        })
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)

    def tables(lang: str, docs: Counter, sources: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        place = dict(zip(docs, range(len(docs))))
        words, names = pa.array(list(docs), pa.binary()).cast(pa.string()), pa.array(list(sources), pa.string())
        in_docs = np.fromiter(docs.values(), dtype=np.int64, count=len(docs))
        term = np.concatenate([np.fromiter(map(place.__getitem__, c), dtype=np.int64, count=len(c)) for c in sources.values()])
        n = np.concatenate([np.fromiter(c.values(), dtype=np.int64, count=len(c)) for c in sources.values()])
        source = np.repeat(np.arange(len(sources)), [len(c) for c in sources.values()])
        none = lambda kind, size: pa.nulls(size, kind)
        yield from table(lang, none(pa.string(), len(names)), none(pa.int64(), len(names)), np.arange(len(names) + 1), names, np.zeros(len(names), dtype=np.int64))
        order = np.argsort(term, kind="stable")
        for kept_for_sure in (True, False):
            which = order[(in_docs[term[order]] >= least) == kept_for_sure]
            each = np.bincount(term[which], minlength=len(docs))
            rows = np.flatnonzero(each) if kept_for_sure else np.arange(len(docs))
            ends = np.concatenate([[0], np.cumsum(each[rows])])
            own = none(pa.int64(), len(rows)) if kept_for_sure else pa.array(in_docs)
            yield from table(lang, words.take(pa.array(rows)), own, ends, names.take(pa.array(source[which])), n[which])

    def count(batches):
        seen: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        held = 0

        def flush():
            while seen:
                lang, (docs, sources) = seen.popitem()
                yield from tables(lang, docs, sources)

        for batch in batches:
            for lang, source, text in zip(*map(pa.Array.to_pylist, batch.columns)):
                docs, sources = seen.setdefault(lang, (Counter(), {}))
                if source not in sources:
                    sources[source] = Counter()
                    held += 1
                n = sources[source]
                held -= len(n)
                own: set[bytes] = set()
                for part in terms(text):
                    n.update(part)
                    own.update(part)
                docs.update(own)
                held += len(n)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return map_arrow(rows, count, COUNTED)


class Forest:
    """Segment trees of equal width as one set of hash-consed nodes. Level 0 has the leaves: distinct values."""

    def __init__(self, rows: np.ndarray):
        """One tree per row; the width is a power of two."""
        self.leaves, now = np.unique(rows, return_inverse=True)
        now = now.reshape(rows.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        base = len(self.leaves)
        while now.shape[1] > 1:
            key = now[:, ::2] * base + now[:, 1::2]
            found, now = np.unique(key, return_inverse=True)
            now = now.reshape(key.shape)
            self.children.append((found // base, found % base))
            base = len(found)
        self.roots = now[:, 0]

    def nodes(self) -> int:
        return len(self.leaves) + sum(len(left) for left, _ in self.children)

    def walk(self, a: int, b: int, price) -> int:
        """Sum of price(leaf numbers of a, leaf numbers of b) over all places, each distinct pair of nodes once."""
        left, right, steps = np.array([a]), np.array([b]), []
        for i in range(len(self.children) - 1, -1, -1):
            low, high = self.children[i]
            base = len(self.children[i - 1][0]) if i else len(self.leaves)
            key = np.concatenate([low[left], high[left]]) * base + np.concatenate([low[right], high[right]])
            found, to = np.unique(key, return_inverse=True)
            steps.append(to)
            left, right = found // base, found % base
        sums = price(left, right)
        for to in reversed(steps):
            half = len(to) // 2
            sums = sums[to[:half]] + sums[to[half:]]
        return int(sums[0])


def probabilities(leaves: np.ndarray, own: np.ndarray, size: int, kept: int) -> np.ndarray:
    """Of the leaf values that a group has, in multiples of 1 / UNIT; 0 for places without a term (-1)."""
    out = np.zeros(len(leaves), dtype=np.int64)
    for k in own.tolist():
        if leaves[k] >= 0:
            out[k] = 1 + UNIT * (int(leaves[k]) + 2) // (size + 2 * kept)
    return out


def compare(table: pa.Table) -> pa.Table:
    """Prices of all pairs of sources of two blocks in one tile."""
    heads = table.filter(pc.is_null(table.column("term"))).sort_by("idx")
    rows = table.filter(pc.is_valid(table.column("term")))
    idx, names = heads.column("idx").to_numpy(), heads.column("source").to_pylist()
    sizes, kept = heads.column("size").to_pylist(), heads.column("kept")[0].as_py()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    here = heads.column("n")[0].as_py()  # terms of the tile, those that none of these sources has among them
    counts = np.full((len(idx), 1 << max(0, here - 1).bit_length()), -1, dtype=np.int64)
    counts[:, :here] = 0
    counts[np.searchsorted(idx, rows.column("idx").to_numpy()), rank[coded.indices.to_numpy()]] = rows.column("n").to_numpy()
    forest = Forest(counts)
    p = [probabilities(forest.leaves, np.unique(np.searchsorted(forest.leaves, c)), n, kept) for c, n in zip(counts, sizes)]
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    out = []
    for i in range(len(idx)):
        for j in range(i + 1, len(idx)):
            if low != high and idx[i] // SIDE == idx[j] // SIDE:
                continue

            def price(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                x, y = p[i][a], p[j][b]
                return (x - y) ** 2 // np.maximum(x + y, 1)

            out.append((names[i], names[j], forest.walk(forest.roots[i], forest.roots[j], price)))
    a, b, value = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def probability(n: str | Column, size: str) -> Column:
    """1 + floor(UNIT (n + 2) / (size + 2 kept)), exact for counts of any size."""
    wide = f"(CAST({UNIT} AS decimal(10,0)) * CAST({n} + 2 AS decimal(20,0))) div CAST({size} + 2 * kept AS decimal(20,0))"
    return F.expr(f"1 + CASE WHEN {n} < 9000000000 THEN ({UNIT}L * ({n} + 2)) div ({size} + 2 * kept) ELSE {wide} END")  # 64 bits hold the former


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    Terms are runs of letters (A-Z lower-cased, everything beyond ASCII a letter); a language keeps those in `least` of
    its documents or more. Part `pair` has every other source of the language with the sum of (p - q)^2 / (p + q),
    rounded down term by term; part `term` the `top` terms that the source has more often than its language. Ties go by
    the item. Null texts, languages and sources are empty strings. Texts of any length are read slice by slice. Rows
    that repeat are documents of their own. A source without terms has pairs and no terms; a language without kept terms
    has values of 0. An empty table gives no rows. Other columns of `df` are not read.

    The pairs of sources of a language are the result, so their number is; no other pairs are made.
    """
    spark = df.sparkSession
    path = scratch(spark, "divergence-counts")
    count_terms(df, text_col, lang_col, source_col, least).write.parquet(path)
    counted = spark.read.schema(COUNTED).parquet(path)
    in_docs = counted.where("term IS NOT NULL AND docs IS NOT NULL")
    enough = in_docs.groupBy("lang", "term").agg(F.sum("docs").alias("in_all")).where(F.col("in_all") >= least).select("lang", "term")
    some = in_docs.where(F.size("sources") > 0).join(enough, ["lang", "term"], "left_semi")
    sure = counted.where("term IS NOT NULL AND docs IS NULL")
    each = some.select("lang", "term", F.inline("sources")).unionByName(sure.select("lang", "term", F.inline("sources")))
    rows = saved(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "divergence-terms")
    named_groups = saved(counted.where("term IS NULL").select("lang", F.col("sources")[0]["source"].alias("source")).distinct(), "divergence-sources")
    discard(spark, path)
    kept = saved(rows.groupBy("lang", "term").agg(F.sum("n").alias("total")), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = named_groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.row_number().over(order) - 1).alias("idx"), F.count("*").over(Window.partitionBy("lang")).alias("groups"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("size", "kept", "lang_size")],
    ).withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("kept") / tile)).cast("int"))
    groups = saved(groups, "divergence-groups")

    p, q = probability("n", "size"), probability("total", "lang_size")
    named = rows.join(kept, ["lang", "term"]).join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = F.expr("(p - q) * (p - q) div (p + q)").alias("value")
    listed = named.select("lang", "source", F.lit("term").alias("part"), "item", far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    own_tile = F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile")
    in_tile = kept.join(groups.groupBy("lang").agg(F.first("tiles").alias("tiles")), "lang").groupBy("lang", own_tile).agg(F.count("*").alias("n"))
    data = rows.join(groups.select("lang", "source", "idx", "groups", "tiles"), ["lang", "source"]).select(
        "lang", own_tile, "idx", "groups", F.lit(None).cast("string").alias("source"), "term", "n",
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("kept"),
    )
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "idx", "groups", "source", F.lit(None).cast("string").alias("term"), "size", "kept",
    ).join(in_tile, ["lang", "tile"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    block = F.floor(F.col("idx") / SIDE).cast("int")
    dealt = data.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / SIDE).cast("int"))))
    dealt = dealt.withColumn("low", F.least(block, "other")).withColumn("high", F.greatest(block, "other")).drop("groups", "other")
    parts = dealt.groupBy("lang", "tile", "low", "high").applyInArrow(compare, "lang string, a string, b string, value bigint")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(best))
    return both.unionByName(listed)
