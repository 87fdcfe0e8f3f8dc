"""Aircraft and runway tables keyed by snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.functions.geo import OCCUPANTS, PHASES, RUNWAY_MODES, WAKES, dist_nm, enum_or
from aeroscope.idioms import latest
from aeroscope.session import cut

#: Aircraft up to which the traffic of a snapshot is held as one value.
CROWD = 1000


def lookup_aircraft(requests: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Requests with their aircraft row, matched without regard to case; unknown ones drop out."""
    r = requests.withColumn("key", F.upper("callsign")).drop("callsign")
    a = aircraft.withColumn("key", F.upper("callsign"))
    return r.join(a, ["snapshot_id", "key"]).drop("key")


def lookup_runway(requests: DataFrame, runways: DataFrame) -> DataFrame:
    r = requests.withColumn("key", F.upper("runway")).drop("runway")
    a = runways.withColumn("key", F.upper("runway_id"))
    return r.join(a, ["snapshot_id", "key"]).drop("key")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """Latest row per key wins by `seq`; a tombstone drops rows that are not newer than it."""
    merged = latest(current.unionByName(changes), keys, ["seq"])
    if removed is None:
        return merged
    gone = removed.groupBy(*keys).agg(F.max("seq").alias("gone_at"))
    return (
        merged.join(gone, keys, "left")
        .where(F.col("gone_at").isNull() | (F.col("seq") > F.col("gone_at")))
        .drop("gone_at")
    )


def neighbours(targets: DataFrame, aircraft: DataFrame, radius_nm: float) -> DataFrame:
    """Every other aircraft of the same snapshot within the radius of each target.

    Targets need snapshot_id, callsign, lat and lon. A target, whose row may be wide, stays in its own grid cell and
    travels once; the narrow rows of the others go to every cell from which a target can reach them (the highest
    latitude of such a target sets how many longitude cells). The join is an equi-join on snapshot and cell; a crowded
    cell is split by adaptive execution.
    """
    reach = radius_nm / 60.0
    width, slack = 3 * reach, 1e-9
    edge = F.abs(F.col("o_lat")) + reach + slack
    wide = F.when(edge < 89.99, F.least(F.lit(reach) / F.cos(F.radians(edge)), F.lit(360.0))).otherwise(360.0)
    cell = lambda c: F.floor(c / width).cast("bigint")
    cells = lambda c, r: F.sequence(cell(F.col(c) - r - slack), cell(F.col(c) + r + slack))
    others = aircraft.select(
        "snapshot_id",
        F.col("callsign").alias("o_callsign"),
        F.col("ord").alias("o_ord"),
        F.col("lat").alias("o_lat"),
        F.col("lon").alias("o_lon"),
        F.col("altitude").alias("o_altitude"),
    )
    others = others.withColumn("cy", F.explode(cells("o_lat", F.lit(reach)))).withColumn("cx", F.explode(cells("o_lon", wide)))
    looking = targets.withColumn("cy", cell(F.col("lat"))).withColumn("cx", cell(F.col("lon")))
    dist = dist_nm(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    return (
        looking.join(others, ["snapshot_id", "cy", "cx"])
        .where(F.upper("callsign") != F.upper("o_callsign"))
        .withColumn("dist_nm", dist)
        .where(F.col("dist_nm") <= radius_nm)
        .drop("cy", "cx")
    )


def by_crowd(targets: DataFrame, aircraft: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Targets and aircraft of snapshots whose traffic fits into one value, then those of crowded ones if there are any."""
    counts = aircraft.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    crowded = cut(counts.where(F.col("n") > CROWD).select("snapshot_id"))
    if crowded.isEmpty():
        return [(targets, aircraft)]
    return [tuple(df.join(crowded, "snapshot_id", how) for df in (targets, aircraft)) for how in ("left_anti", "left_semi")]


def beside(targets: DataFrame, aircraft: DataFrame, how: str = "inner") -> DataFrame:
    """Targets with the aircraft of their snapshot as the array `others`, in table order; for snapshots of a checked size.

    Both sides travel once, as narrow rows, and no row of a pair is made: what is wide, such as a track, is best computed
    from the columns of the result.
    """
    others = aircraft.select(
        "snapshot_id",
        F.struct(
            F.col("ord").alias("o_ord"), F.col("callsign").alias("o_callsign"), F.col("lat").alias("o_lat"),
            F.col("lon").alias("o_lon"), F.col("altitude").alias("o_altitude"),
        ).alias("o"),
    )
    return targets.join(others.groupBy("snapshot_id").agg(F.sort_array(F.collect_list("o")).alias("others")), "snapshot_id", how)


def within(radius_nm: float, callsign: str = "callsign") -> Column:
    """Those of `others` that `neighbours` would pair with the row; latitude alone rules most of the far ones out."""
    return F.filter(
        "others",
        lambda o: (F.abs(o["o_lat"] - F.col("lat")) * 60 <= radius_nm + 1e-6)
        & (dist_nm(F.col("lat"), F.col("lon"), o["o_lat"], o["o_lon"]) <= radius_nm)
        & (F.upper(F.col(callsign)) != F.upper(o["o_callsign"])),
    )


def constraint_breaks(aircraft: DataFrame) -> DataFrame:
    """One row per broken constraint; rows are reported, not dropped."""
    checks = {
        "heading_range": ~F.col("heading").between(0, 360),
        "speed_negative": F.col("speed") < 0,
    }
    if "confidence" in aircraft.columns:
        checks["confidence_range"] = ~F.col("confidence").between(0.0, 1.0)
    if "position_history" in aircraft.columns:
        checks["history_length"] = F.size("position_history") > 10
    broken = F.filter(
        F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()
    )
    return aircraft.withColumn("broken", F.explode(broken))


def coerce_enums(aircraft: DataFrame) -> DataFrame:
    """Unknown texts fall back to the defaults the loaders use."""
    fixed = {
        "flight_phase": (PHASES, "cruise"),
        "wake": (WAKES, "M"),
        "mode": (RUNWAY_MODES, "mixed"),
        "occupant_type": (OCCUPANTS, None),
    }
    return aircraft.withColumns(
        {c: enum_or(F.col(c), *rule) for c, rule in fixed.items() if c in aircraft.columns}
    )


def snapshot_summary(snapshot: DataFrame, aircraft: DataFrame, runways: DataFrame) -> DataFrame:
    """Overview text per snapshot. Aircraft are counted, so a crowded snapshot never builds one long value;
    the runway list is bounded by the runways of a sector."""
    counts = aircraft.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    status = F.concat(F.col("runway_id"), F.when(F.col("occupied"), ": occupied").otherwise(": free"))
    lists = (
        runways.groupBy("snapshot_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", status.alias("txt")))).alias("items"))
        .select("snapshot_id", F.array_join(F.col("items.txt"), ", ").alias("runways"))
    )
    msa = F.when(F.coalesce("msa", F.lit(0)) == 0, F.lit("N/A")).otherwise(F.col("msa").cast("string"))
    return (
        snapshot.join(counts, "snapshot_id", "left")
        .join(lists, "snapshot_id", "left")
        .select(
            "snapshot_id",
            F.concat(
                F.lit("MSA: "), msa, F.lit(", Total aircraft: "), F.coalesce("n", F.lit(0)).cast("string")
            ).alias("traffic"),
            F.coalesce("runways", F.lit("No runway data")).alias("runways"),
        )
    )


def aircraft_lines(aircraft: DataFrame) -> DataFrame:
    """One description line per aircraft."""
    text = F.concat(
        "callsign",
        F.lit(": Alt="), F.col("altitude").cast("string"),
        F.lit("ft, Speed="), F.col("speed").cast("string"),
        F.lit("kts, Heading="), F.col("heading").cast("string"),
        F.lit("°"),
    )
    return aircraft.select("snapshot_id", "callsign", text.alias("line"))
