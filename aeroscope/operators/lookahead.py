"""Apply instructions to snapshots and look ahead minute by minute."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.functions.geo import dist_nm
from aeroscope.idioms import let
from aeroscope.operators.traffic import beside, by_crowd, neighbours, within

# Instruction types that change each field, and feet per minute by type.
ALTITUDE_TYPES = ("descent", "climb", "maintain_altitude", "expedite_descent", "expedite_climb")
HEADING_TYPES = ("heading", "turn_left", "turn_right")
SPEED_TYPES = ("speed", "maintain_speed", "reduce_speed", "increase_speed")
RUNWAY_TYPES = ("takeoff_clearance", "landing_clearance")
RATES = {"descent": -1000, "expedite_descent": -2000, "climb": 1500, "expedite_climb": 2500}
SEARCH_NM = 30.0
MIN_VERTICAL_FT = 1000
MIN_HORIZONTAL_NM = 5.0


def vertical_rate(itype: Column) -> Column:
    rate = F.lit(0)
    for name, fpm in RATES.items():
        rate = F.when(itype == name, fpm).otherwise(rate)
    return rate


def minutes_to_altitude(current: Column, target: Column, itype: Column) -> Column:
    rate = (
        F.when(itype == "expedite_descent", 2000)
        .when(itype == "expedite_climb", 2500)
        .when(itype == "descent", 1000)
        .otherwise(1500)
    )
    return F.abs(target - current) / rate.cast("double")


def phase_after(altitude: Column, itype: Column) -> Column:
    """Flight phase once an altitude has been assigned."""
    return (
        F.when(altitude < 1000, F.when(itype == "takeoff_clearance", "takeoff").otherwise("ground"))
        .when(altitude < 10000, F.when(itype == "climb", "climb").otherwise("approach"))
        .when(
            altitude < 18000,
            F.when(itype == "climb", "climb").when(itype == "descent", "descent").otherwise("cruise"),
        )
        .otherwise("cruise")
    )


def target_altitude() -> Column:
    return F.coalesce(F.col("target_altitude"), F.col("flight_level") * 100)


def target_speed() -> Column:
    """Speed 0 counts as missing and falls through to the other field."""
    return F.coalesce(F.nullif("speed_param", F.lit(0)), F.col("target_speed"))


def with_aircraft(instruction: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Instructions with their own aircraft and the reason when it cannot be projected."""
    own = aircraft.select(
        "snapshot_id",
        F.upper("callsign").alias("key"),
        F.col("callsign").alias("a_callsign"),
        F.col("ord").alias("a_ord"),
        "lat", "lon",
        F.col("altitude").alias("old_altitude"),
        F.col("heading").alias("old_heading"),
        F.col("speed").alias("old_speed"),
        F.col("flight_phase").alias("old_phase"),
    )
    if "speed_param" not in instruction.columns:
        instruction = instruction.withColumn("speed_param", F.lit(None).cast("int"))
    joined = instruction.withColumn("key", F.upper("callsign")).join(own, ["snapshot_id", "key"], "left")
    error = (
        F.when(F.coalesce("callsign", F.lit("")) == "", "No callsign in instruction")
        .when(F.col("a_ord").isNull(), F.concat(F.lit("Aircraft "), "callsign", F.lit(" not found")))
    )
    return joined.withColumn("error", error).drop("key")


def apply_instruction(joined: DataFrame) -> DataFrame:
    """New altitude, heading, speed, runway, phase and clearances of the addressed aircraft."""
    itype = F.col("itype")
    alt, hdg, spd = target_altitude(), F.col("heading"), target_speed()
    sets_alt = itype.isin(*ALTITUDE_TYPES) & alt.isNotNull()
    sets_hdg = itype.isin(*HEADING_TYPES) & hdg.isNotNull()
    sets_spd = itype.isin(*SPEED_TYPES) & spd.isNotNull()
    sets_rwy = itype.isin(*RUNWAY_TYPES) & (F.coalesce("runway", F.lit("")) != "")
    return joined.withColumns(
        {
            "new_altitude": F.when(sets_alt, alt).otherwise(F.col("old_altitude")),
            "new_heading": F.when(sets_hdg, hdg).otherwise(F.col("old_heading")),
            "new_speed": F.when(sets_spd, spd).otherwise(F.col("old_speed")),
            "altitude_assigned": F.when(sets_alt, alt),
            "heading_assigned": F.when(sets_hdg, hdg),
            "speed_assigned": F.when(sets_spd, spd),
            "runway_assigned": F.when(sets_rwy, F.col("runway")),
            "new_phase": F.when(sets_alt, phase_after(alt, itype))
            .when(sets_rwy & (itype == "takeoff_clearance"), "takeoff")
            .when(sets_rwy & (itype == "landing_clearance"), "landing")
            .otherwise(F.col("old_phase")),
            "vertical_rate": vertical_rate(itype),
        }
    )


def track(
    lat: Column,
    lon: Column,
    altitude: Column,
    speed: Column,
    heading: Column,
    rate: Column,
    minutes: int = 10,
    stop_at: Column | None = None,
) -> Column:
    """Minute track as array<struct<minute, lat, lon, altitude, speed>>.

    The altitude runs past the assigned one unless `stop_at` is given. The speed of a minute is the one
    set at the end of the minute before it. Rounded positions are output only, the fold carries exact ones.
    """
    point = "struct<minute:int,lat:double,lon:double,altitude:int,speed:int>"
    start = F.struct(
        lat.alias("lat"),
        lon.alias("lon"),
        altitude.cast("int").alias("alt"),
        speed.cast("int").alias("spd"),
        F.array().cast(f"array<{point}>").alias("points"),
    )

    def move(s: Column, minute: Column) -> Column:
        step = s["spd"] / F.lit(60.0) / F.lit(60.0)
        return F.struct(
            s["points"].alias("points"),
            (s["lat"] + step * F.cos(F.radians(heading))).alias("lat"),
            (s["lon"] + step * F.sin(F.radians(heading)) / F.cos(F.radians(s["lat"]))).alias("lon"),
            bounded(F.greatest(s["alt"] + rate, F.lit(0))).cast("int").alias("alt"),
            minute.alias("minute"),
        )

    def bounded(alt: Column) -> Column:
        if stop_at is None:
            return alt
        return (
            F.when(stop_at.isNull(), alt)
            .when(rate < 0, F.greatest(alt, F.least(stop_at, altitude)))
            .when(rate > 0, F.least(alt, F.greatest(stop_at, altitude)))
            .otherwise(alt)
        )

    def settle(s: Column) -> Column:
        climbing = rate > 0
        spd = (
            F.when(s["alt"] < 1000, F.when(climbing, 150).otherwise(140))
            .when(s["alt"] < 10000, F.when(climbing, 250).otherwise(280))
            .otherwise(450)
        )
        here = F.struct(
            s["minute"].alias("minute"),
            F.round(s["lat"], 6).alias("lat"),
            F.round(s["lon"], 6).alias("lon"),
            s["alt"].alias("altitude"),
            spd.alias("speed"),
        )
        return F.struct(
            s["lat"].alias("lat"),
            s["lon"].alias("lon"),
            s["alt"].alias("alt"),
            spd.alias("spd"),
            F.concat(s["points"], F.array(here)).alias("points"),
        )

    def step(s: Column, minute: Column) -> Column:
        # transform over a one-element array binds the moved state once instead of repeating its expression
        return F.transform(F.array(move(s, minute)), settle)[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(minutes)), start, step, lambda s: s["points"])


def project(
    aircraft: DataFrame, instruction: DataFrame, minutes: int = 10, clamp: bool = False
) -> DataFrame:
    """One row per instruction: error, new values of its aircraft and its minute track."""
    applied = apply_instruction(with_aircraft(instruction, aircraft))
    return applied.withColumn("track", F.when(F.col("error").isNull(), path(minutes, clamp)))


def path(minutes: int = 10, clamp: bool = False) -> Column:
    """Minute track of a row of `apply_instruction`."""
    return track(
        F.col("lat"), F.col("lon"), F.col("old_altitude"), F.col("new_speed"), F.col("new_heading"),
        F.col("vertical_rate"), minutes, F.col("altitude_assigned") if clamp else None,
    )


def track_rows(projected: DataFrame) -> DataFrame:
    return projected.where(F.col("error").isNull()).select(
        "instr_id", F.explode("track").alias("p"), "vertical_rate"
    ).select(
        "instr_id", "p.minute", "p.lat", "p.lon", "p.altitude", "p.speed", "vertical_rate",
        (F.col("p.minute") * 60).alias("at_sec"),
    )


def clash(way: Column, other: Column) -> Column:
    """Whether the track ever comes too close; `way` has track, lowest and highest altitude (see `seen_along`)."""
    return (
        (other["o_altitude"] > way["low"] - MIN_VERTICAL_FT)
        & (other["o_altitude"] < way["high"] + MIN_VERTICAL_FT)
        & F.exists(
            way["track"],
            lambda w: (F.abs(w["altitude"] - other["o_altitude"]) < MIN_VERTICAL_FT)
            & (dist_nm(w["lat"], w["lon"], other["o_lat"], other["o_lon"]) < MIN_HORIZONTAL_NM),
        )
    )


def seen_along(way: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a track and its range of altitudes once."""
    ends = lambda w: F.struct(w.alias("track"), F.array_min(w["altitude"]).alias("low"), F.array_max(w["altitude"]).alias("high"))
    return let(way, lambda w: let(ends(w), body))


def _gaps(track: Column, other: Column) -> Column:
    """Smallest gaps per axis along a track, and the first time of a conflict."""
    gaps = F.transform(
        track,
        lambda w: F.struct(
            F.abs(w["altitude"] - other["o_altitude"]).alias("v"),
            dist_nm(w["lat"], w["lon"], other["o_lat"], other["o_lon"]).alias("h"),
            (w["minute"] * 60).alias("t"),
        ),
    )
    hits = lambda g: F.filter(g, lambda x: (x["v"] < MIN_VERTICAL_FT) & (x["h"] < MIN_HORIZONTAL_NM))
    return let(
        gaps,
        lambda g: F.struct(
            other["o_callsign"].alias("o_callsign"), other["o_ord"].alias("o_ord"),
            F.array_min(g["v"]).alias("min_vertical_ft"), F.array_min(g["h"]).alias("min_horizontal_nm"),
            F.array_min(F.transform(hits(g), lambda x: x["t"])).alias("conflict_sec"),
        ),
    )


OTHER = ("o_callsign", "o_ord", "o_lat", "o_lon", "o_altitude")


def _moving(rows: DataFrame, minutes: int, clamp: bool) -> tuple[DataFrame, Column]:
    """Rows without error and their track: the one they have, else one to be computed where it is needed."""
    moving = rows.where(F.col("error").isNull()).withColumn("callsign", F.col("a_callsign"))
    return moving, F.col("track") if "track" in rows.columns else path(minutes, clamp)


def separation(rows: DataFrame, aircraft: DataFrame, minutes: int = 10, clamp: bool = False) -> DataFrame:
    """Per (instruction, other aircraft in range): smallest gaps per axis and the first conflict time.

    Takes rows of `apply_instruction` or `project`. Rows without a track get it after they have met the traffic, so that
    it is never shuffled; in crowded snapshots it travels with its row, and so the minima need no shuffle either.
    """
    moving, way = _moving(rows, minutes, clamp)
    (calm, sparse), *crowd = by_crowd(moving, aircraft)
    gaps = let(way, lambda w: F.transform(within(SEARCH_NM), lambda o: _gaps(w, o)))
    parts = [beside(calm, sparse).select("instr_id", "snapshot_id", "callsign", F.inline(gaps))]
    for busy, dense in crowd:
        near = neighbours(busy.select("instr_id", "snapshot_id", "callsign", "lat", "lon", way.alias("track")), dense, SEARCH_NM)
        near = near.withColumn("gaps", _gaps(F.col("track"), F.struct(*OTHER)))
        parts.append(near.select("instr_id", "snapshot_id", "callsign", "gaps.*"))
    return reduce(DataFrame.unionByName, parts).withColumn("conflict", F.col("conflict_sec").isNotNull())


def conflict_flags(sep: DataFrame) -> DataFrame:
    return sep.groupBy("instr_id").agg(
        F.bool_or("conflict").alias("has_conflict"),
        F.count_if("conflict").alias("n_conflicts"),
        F.count("*").alias("n_near"),
    )


def conflicts(rows: DataFrame, aircraft: DataFrame, minutes: int = 10, clamp: bool = False) -> DataFrame:
    """What `conflict_flags` gives of `separation`, without a row for each pair."""
    moving, way = _moving(rows, minutes, clamp)
    (calm, sparse), *crowd = by_crowd(moving, aircraft)
    met = beside(calm, sparse).withColumn("near", within(SEARCH_NM)).where(F.size("near") > 0)
    n = seen_along(way, lambda w: F.size(F.filter("near", lambda o: clash(w, o))))
    counted = met.select("instr_id", n.cast("bigint").alias("n"), F.size("near").cast("bigint").alias("m"))
    flags = counted.groupBy("instr_id").agg(
        F.max(F.col("n") > 0).alias("has_conflict"), F.sum("n").alias("n_conflicts"), F.sum("m").alias("n_near")
    )
    for busy, dense in crowd:
        flags = flags.unionByName(conflict_flags(separation(busy, dense, minutes, clamp)))
    return flags


def resulting_snapshot(projected: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Whole snapshot per instruction after it is applied: the addressed row replaced, others kept."""
    own = projected.select(
        "instr_id", "snapshot_id", "error", F.col("a_ord").alias("own_ord"),
        "new_altitude", "new_heading", "new_speed", "new_phase",
    )
    hit = F.col("error").isNull() & (F.col("own_ord") == F.col("ord"))
    return own.join(aircraft, "snapshot_id").select(
        "instr_id", "snapshot_id", "ord", "callsign", "lat", "lon",
        F.when(hit, F.col("new_altitude")).otherwise(F.col("altitude")).alias("altitude"),
        F.when(hit, F.col("new_heading")).otherwise(F.col("heading")).alias("heading"),
        F.when(hit, F.col("new_speed")).otherwise(F.col("speed")).alias("speed"),
        F.when(hit, F.col("new_phase")).otherwise(F.col("flight_phase")).alias("flight_phase"),
    )
