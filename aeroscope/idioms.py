"""Small DataFrame and Column building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.session import cut

MARK = "\u0001"


def replace_each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Rewrite every regex match with a Column expression, inside whole-stage expressions (no UDF)."""
    marked = F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    parts = F.split(marked, MARK)
    return F.array_join(
        F.transform(parts, lambda part, i: F.when(i % 2 == 1, change(part)).otherwise(part)), ""
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: lambdas inside array functions would otherwise repeat its whole expression."""
    return F.transform(F.array(value), body)[0]


def lookup(key: Column, table: Mapping[str, str] | Column) -> Column:
    """Value of a key in a map column, or in a fixed small dictionary as a map literal; null if it is not there."""
    if isinstance(table, Column):
        return F.try_element_at(table, key)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_int(text: Column, pattern: str, group: int = 1) -> Column:
    return first_group(text, pattern, group).try_cast("int")


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num / den as double, `empty` when the denominator is zero."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty))


def salted(left: DataFrame, right: DataFrame, salts: int, spread: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add a salt column: one value per left row, all values on the right.

    A hot key is then split over `salts` tasks without losing a pair.
    """
    left = left.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left, right


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: str = "last") -> DataFrame:
    """One whole row per key, picked by order.

    An aggregate instead of a window: rows of a hot key are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct(*rest)
    ranked = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("row"))
    return ranked.select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*df.columns)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    block: int = 1_000_000,
) -> DataFrame:
    """Inclusive running sums over an integer order that is unique inside its key.

    Two levels: totals per block of `block` order values (combined map side), then a window inside one
    block, so no task sees more than `block` rows of a hot key.
    """
    keys = list(keys)
    names = list(sums)
    rows = df.withColumn("block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    for n, c in sums.items():
        rows = rows.withColumn(f"in_{n}", c)
    per_block = rows.groupBy(*keys, "block").agg(*[F.sum(f"in_{n}").alias(f"t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, "block", *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"o_{n}") for n in names]
    )
    inside = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*df.columns, "block", *[F.sum(f"in_{n}").over(inside).alias(f"r_{n}") for n in names])
    left, right = local.alias("l"), offsets.alias("r")
    same = F.col("l.block") == F.col("r.block")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l.r_{n}") + F.col(f"r.o_{n}")).alias(n) for n in names],
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    block: int = 1_000_000,
    before: bool = False,
) -> DataFrame:
    """Last non-null value at each row or before it (`before`: only before it), over a numeric order unique inside its key.

    A prefix scan in two levels: the last value of each block of `block` order values is found by an aggregate and
    carried over the blocks, then filled inside one block, so no task sees more than a block's rows of a hot key.
    """
    keys = list(keys)
    rows = df.withColumn("block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    for n, c in values.items():
        rows = rows.withColumn(f"in_{n}", c)
    per_block = rows.groupBy(*keys, "block").agg(
        *[F.max_by(f"in_{n}", F.when(F.col(f"in_{n}").isNotNull(), F.col(order))).alias(f"t_{n}") for n in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "block", *[F.last(f"t_{n}", True).over(earlier).alias(f"o_{n}") for n in values])
    inside = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.select(*df.columns, "block", *[F.last(f"in_{n}", True).over(inside).alias(f"r_{n}") for n in values])
    left, right = local.alias("l"), offsets.alias("r")
    same = F.col("l.block") == F.col("r.block")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[F.coalesce(F.col(f"l.r_{n}"), F.col(f"r.o_{n}")).alias(n) for n in values],
    )


def pair_ranges(
    left: DataFrame,
    right: DataFrame,
    value: Column,
    low: Column,
    high: Column,
    width: int,
) -> DataFrame:
    """Pairs with low <= value < high as an equi-join on value buckets (never a nested loop)."""
    left = left.withColumn("bucket", F.floor(value / width).cast("bigint"))
    right = right.withColumn(
        "bucket",
        F.explode(F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))),
    )
    return left.join(right, "bucket").where((value >= low) & (value < high)).drop("bucket")


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null (null equals null); keys are kept once, from the left."""
    l, r = left.alias("l"), right.alias("r")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    rest = [c for c in right.columns if c not in keys]
    return l.join(r, cond, how).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in rest])


def once_per_value(df: DataFrame, column: str, values: Mapping[str, Column]) -> DataFrame:
    """Distinct values of a column with what is computed from them: join it back to the rows where values repeat.

    It is cut off from `df`, so that the costly part runs once and the join is not one of a table with itself.
    """
    return cut(df.select(column).distinct().withColumns(dict(values)))


class BestOf:
    """Best k items of each query of a slice, while items stream by in batches; memory is that of the slice and one batch.

    `seq` orders ties; `k` may differ by query. A matrix product finds who can be among the best; their scores are then
    computed pair by pair, so that equal vectors score alike wherever they stand in a batch.
    """

    STEP, NEAR = 256, 1e-9

    def __init__(self, seq, vec, k, before, epsilon):
        import numpy as np

        self.seq, self.vec, self.k, self.before, self.epsilon = seq, vec, k, before, epsilon
        self.norm = np.linalg.norm(vec, axis=1)
        self.low = np.full(len(seq), -np.inf)  # score of the k-th best so far
        self.best = [None] * -(-len(seq) // self.STEP)

    def add(self, seq, ids, vec, missing):
        import numpy as np

        norm = np.linalg.norm(vec, axis=1)

        def divided(dots, norms):
            return dots / (norms + self.epsilon if self.epsilon else np.where(norms == 0, 1e-12, norms))

        for part, at in enumerate(range(0, len(self.seq), self.STEP)):
            here = slice(at, at + self.STEP)
            seen = self.before and seq[None, :] < self.seq[here, None]
            if self.before and not seen.any():
                continue
            scores = divided(self.vec[here] @ vec.T, self.norm[here, None] * norm)
            scores[:, missing] = -1.0
            if self.before:
                scores[~seen] = -np.inf
            most, low = int(self.k[here].max()), self.low[here]
            able = scores >= low[:, None] - self.NEAR
            if 0 < most < scores.shape[1] and np.count_nonzero(able) > 4 * most * len(able):
                able &= scores >= np.partition(scores, scores.shape[1] - most, axis=1)[:, [scores.shape[1] - most]] - self.NEAR
            q, i = np.nonzero(able & (scores > -np.inf))
            if not len(q):
                continue
            exact = np.where(missing[i], -1.0, divided(np.einsum("ij,ij->i", self.vec[at + q], vec[i]), self.norm[at + q] * norm[i]))
            rows = [q, exact, seq[i], ids[i]]
            if self.best[part] is not None:
                rows = [np.concatenate(x) for x in zip(self.best[part], rows)]
            order = np.lexsort((rows[2], -rows[1], rows[0]))
            rows = [x[order] for x in rows]
            first = np.searchsorted(rows[0], rows[0])
            kept = np.arange(len(order)) - first < self.k[at + rows[0]]
            self.best[part] = rows = [x[kept] for x in rows]
            count = np.bincount(rows[0], minlength=len(low))
            full = (count == self.k[here]) & (count > 0)
            low[full] = rows[1][np.cumsum(count)[full] - 1]

    def rows(self):
        """Place of the query, rank, score, seq and id of the item, for each step of queries."""
        import numpy as np

        for part, found in enumerate(self.best):
            if found is not None:
                q, score, seq, ids = found
                yield part * self.STEP + q, np.arange(len(q)) - np.searchsorted(q, q) + 1, score, seq, ids


def top_k_cosine(
    queries: DataFrame,
    items: DataFrame,
    k: Column | int,
    before: bool = False,
    epsilon: float = 0.0,
    block: int = 8192,
    salts: int = 8,
) -> DataFrame:
    """Exact top-k items per query by cosine, inside the same `grp`.

    Queries: grp, q_id, q_seq (bigint, unique), q_vec, q_k. Items: grp, i_id, i_seq (bigint), i_vec (null = -1).
    Queries lie in slices of about `block`; a row of an item goes to each slice and streams past its queries, which keep
    their best k. So neither pairs nor blocks of vectors are held or written, and a slice gives its final ranks.
    `before` keeps items with i_seq < q_seq. Ties go to the lower i_seq. `epsilon` is added to the denominator (0: a zero
    norm divides by 1e-12).
    """
    import numpy as np
    import pyarrow as pa

    k_col = k if isinstance(k, Column) else F.lit(k)
    none = lambda df, c, name: F.lit(None).cast(df.schema[c].dataType).alias(name)
    q = queries.withColumn("q_k", k_col.cast("int")).where("grp IS NOT NULL AND q_k > 0")
    if before:
        q = q.withColumn("qb", F.floor(F.col("q_seq") / block).cast("bigint"))
    else:  # numbers may lie far apart, and an item goes to each slice
        parts = q.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"))
        q = q.join(parts, "grp").withColumn("qb", F.pmod(F.xxhash64("q_seq"), F.col("parts"))).drop("parts")
    slices = q.groupBy("grp", "qb").agg(F.max("q_seq").alias("q_top"))
    left, right = salted(items, slices, salts, ["i_seq"])
    met = left.join(right, ["grp", "salt"])
    if before:
        met = met.where(F.col("i_seq") < F.col("q_top"))
    doubles = lambda c: F.col(c).cast("array<double>").alias("vec")
    asked = q.select("grp", "qb", F.lit(0).alias("side"), F.col("q_seq").cast("bigint").alias("seq"), "q_id", none(items, "i_id", "i_id"), doubles("q_vec"), "q_k")
    shown = met.select("grp", "qb", F.lit(1).alias("side"), F.col("i_seq").cast("bigint").alias("seq"), none(queries, "q_id", "q_id"), "i_id", doubles("i_vec"), F.lit(0).alias("q_k"))
    keys = ["grp", "qb"]
    streams = asked.unionByName(shown).repartition(*keys).sortWithinPartitions(*keys, "side", "seq")

    def plain(column):
        return np.array(column.to_pylist(), dtype=object) if column.null_count else column.to_numpy(zero_copy_only=False)

    def matrix(column, dim):
        there = ~column.is_null().to_numpy(zero_copy_only=False)
        m = np.zeros((len(column), dim))
        m[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return m, ~there

    def best(batches):
        now, asked, slice_ = None, [], None

        def answers():
            if slice_ is not None:
                ids = pa.concat_arrays([b.column("q_id") for b in asked])
                for at, rank, score, seq, found in slice_.rows():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([now[0]] * len(at), asked[0].schema.field("grp").type), ids.take(pa.array(at)), pa.array(found, kinds["i_id"]), pa.array(seq), pa.array(score), pa.array(rank, pa.int32())],
                        ["grp", "q_id", "i_id", "i_seq", "score", "rank"],
                    )

        kinds = {}
        for batch in batches:
            kinds["i_id"] = batch.schema.field("i_id").type
            places = list(zip(batch.column("grp").to_pylist(), batch.column("qb").to_pylist(), batch.column("side").to_pylist()))
            cuts = [0, *[n for n in range(1, len(places)) if places[n] != places[n - 1]], len(places)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if places[a][:2] != now:
                    yield from answers()
                    now, asked, slice_ = places[a][:2], [], None
                if places[a][2] == 0:
                    asked.append(part)
                    continue
                if slice_ is None:
                    vecs = pa.concat_arrays([x.column("vec") for x in asked])
                    seqs, ks = (np.concatenate([x.column(c).to_numpy() for x in asked]) for c in ("seq", "q_k"))
                    slice_ = BestOf(seqs, matrix(vecs, len(vecs[0]))[0], ks, before, epsilon)
                slice_.add(part.column("seq").to_numpy(), plain(part.column("i_id")), *matrix(part.column("vec"), slice_.vec.shape[1]))
        yield from answers()

    fields = {f.name: f.dataType.simpleString() for f in [*queries.schema, *items.schema]}
    schema = f"grp {fields['grp']}, q_id {fields['q_id']}, i_id {fields['i_id']}, i_seq bigint, score double, rank int"
    return streams.mapInArrow(best, schema)
