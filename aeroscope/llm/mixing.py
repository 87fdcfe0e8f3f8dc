"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are shuffled and cut into blocks. With shares that sum to Q, block j of a source with n
shares is released at slot floor(j Q / n) and due at slot ceil((j + 1) Q / n); each slot goes to the released block with
the earliest deadline. At every slot each source then has its exact share to within less than one block. The schedule
repeats after Q slots, so only one period is computed, and a block's slot follows from its number: no task sees more
than the rows of one rank group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.llm.common import quoted, row_hash

#: Stands for every source that the shares don't name, null among them.
REST = "*"
#: Rows of a source that one rank group holds on average: a source has as many groups as its rows ask for.
RANK_GROUP = 512


def pfair_window(j: int, shares: int, total: int) -> tuple[int, int]:
    """Release and deadline of block j."""
    return j * total // shares, -(-(j + 1) * total // shares)


def edf_period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among released blocks, then by name."""
    total = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in sorted(shares)}
    for t in range(total):
        due = [
            (end, s) for s, n in shares.items()
            for release, end in [pfair_window(len(slots[s]), n, total)] if release <= t and len(slots[s]) < n
        ]
        slots[min(due)[1]].append(t)
    return slots


def mix(
    df: DataFrame,
    shares: Mapping[str, int],
    block: int = 4,
    id_col: str = "doc_id",
    source_col: str = "source",
    columns: list[str] | None = None,
    group: int = RANK_GROUP,
) -> DataFrame:
    """Schedule of all rows: row (struct of `columns`, default all of them), source, block, release, deadline, slot, in_mix.

    `shares` are whole numbers per source; `REST` stands for all sources that aren't named and for null. Sources
    without rows give their share to the others. Documents of a source come in the order of the MD5 of their id, then id.
    `in_mix` tells the longest stretch of slots in which every source can fill its block: there the weights hold, and
    what lies behind it is the surplus of sources that have more than their weight. Rows without any share have null
    slots and are not in the mix. Rows with equal ids are ordered among themselves by their other columns. An empty
    table gives no rows. Only counts per share name come to the driver.
    """
    if any(n < 0 for n in shares.values()):
        raise ValueError("shares can't be negative")
    spark = df.sparkSession
    kept = columns or df.columns
    row = F.struct(*[F.col(quoted(c)) for c in kept])
    key = F.coalesce(F.when(F.col(source_col).isin([s for s in shares if s != REST]), F.col(source_col)), F.lit(REST))
    rows = df.select(
        row.alias("row"), key.alias("source"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(id_col).alias("id"),
        row_hash(df, kept).alias("tie"),
    )
    # ranks in two levels: totals of hash ranges, and places inside one range
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    present = {s: n for s, n in shares.items() if n and counts.get(s)}
    spread = F.lit(1)
    for s, n in counts.items():
        spread = F.when(F.col("source") == s, max(1, n // group)).otherwise(spread)
    rows = rows.withColumn("part", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * spread, 32))
    same = ["source", "part"]
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*same).agg(F.count("*").alias("n")).select(*same, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*same).orderBy("h", "id", "tie")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1).join(first, same)
    ranked = ranked.withColumn("block", F.floor((F.col("first") + F.col("place")) / block).cast("bigint"))
    total = sum(present.values())
    slots = edf_period(present)
    ends = [n // block // present[s] * total + slots[s][n // block % present[s]] for s, n in counts.items() if s in present]
    windows = {s: [pfair_window(j, n, total) for j in range(n)] for s, n in present.items()}
    period = spark.createDataFrame(
        [(s, j, windows[s][j][0], windows[s][j][1], t) for s, at in slots.items() for j, t in enumerate(at)],
        "source string, j bigint, r bigint, d bigint, t bigint",
    )
    n = F.lit(None).cast("bigint")
    for s, shares_of in present.items():
        n = F.when(F.col("source") == s, shares_of).otherwise(n)
    ranked = ranked.withColumn("n", n)
    ranked = ranked.withColumn("j", F.col("block") % F.col("n")).join(F.broadcast(period), ["source", "j"], "left")  # `total` rows
    base = F.floor(F.col("block") / F.col("n")).cast("bigint") * total
    slot = (base + F.col("t")).cast("bigint")
    return ranked.select(
        "row", "source", "block", (base + F.col("r")).cast("bigint").alias("release"), (base + F.col("d")).cast("bigint").alias("deadline"),
        slot.alias("slot"), F.coalesce(slot < min(ends, default=0), F.lit(False)).alias("in_mix"),
    )
