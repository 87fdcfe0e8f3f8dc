"""Whole batch: instruction rows to look-ahead, violations, alerts and decisions in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.functions.geo import dist_nm
from aeroscope.operators import alerts, lookahead, rules
from aeroscope.operators.traffic import beside, by_crowd, neighbours, within


def gate(projected: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Per instruction which rule families run: altitude always, separation after a predicted conflict,
    runway for a take-off or landing clearance with a runway. Rows of `with_facts` need no flags."""
    ok = F.col("error").isNull()
    rows = projected if flags is None else projected.join(flags, "instr_id", "left")
    return rows.withColumns(
        {
            "has_conflict": F.coalesce("has_conflict", F.lit(False)),
            "run_altitude": ok,
            "run_separation": ok & F.coalesce("has_conflict", F.lit(False)),
            "run_runway": ok
            & F.col("itype").isin(*lookahead.RUNWAY_TYPES)
            & (F.coalesce("runway", F.lit("")) != ""),
        }
    )


def as_targets(gated: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The addressed aircraft after the instruction, in the shape the rules expect."""
    return gated.where("run_altitude").join(snapshot, "snapshot_id").select(
        F.col("instr_id").alias("target_id"), "snapshot_id", "sector_id", "msa",
        F.col("a_callsign").alias("callsign"), "lat", "lon", F.col("new_altitude").alias("altitude"),
        "run_separation", "run_runway", "itype", "runway", "raw_text", "speaker", "target_altitude",
    )


def fallback_violations(
    targets: DataFrame, separations: DataFrame, runways: DataFrame, missing: set[str]
) -> DataFrame:
    """Simple checks for the rule families in `missing` that have no evaluator: all CRITICAL."""
    branches = []
    if "ALTITUDE" in missing:
        low = targets.where(F.col("altitude") < F.col("msa"))
        branches.append(
            low.select(
                "target_id", "snapshot_id", "callsign", F.lit("MSA_RULE").alias("rule_id"),
                F.lit("ALTITUDE_MINIMUM").alias("condition_type"), F.lit("CRITICAL").alias("severity"),
                F.lit(None).cast("string").alias("other"),
                F.format_string("Altitude %dft below MSA %dft", "altitude", "msa").alias("explanation"),
            )
        )
    if "SEPARATION" in missing:
        branches.append(
            separations.where("conflict").select(
                F.col("instr_id").alias("target_id"), "snapshot_id", "callsign",
                F.lit("SEPARATION_RULE").alias("rule_id"), F.lit("SEPARATION_VERTICAL").alias("condition_type"),
                F.lit("CRITICAL").alias("severity"), F.col("o_callsign").alias("other"),
                F.format_string("Predicted loss of separation with %s in %ds", "o_callsign", "conflict_sec").alias(
                    "explanation"
                ),
            )
        )
    if "RUNWAY" in missing:
        held = runways.where(F.coalesce("occupied_by", F.lit("")) != "").select(
            "snapshot_id", F.col("runway_id").alias("runway"), "occupied_by"
        )
        branches.append(
            targets.where("run_runway").join(held, ["snapshot_id", "runway"]).select(
                "target_id", "snapshot_id", "callsign", F.lit("RUNWAY_RULE").alias("rule_id"),
                F.lit("RUNWAY_AVAILABLE").alias("condition_type"), F.lit("CRITICAL").alias("severity"),
                F.col("occupied_by").alias("other"),
                F.concat(F.lit("Runway "), "runway", F.lit(" occupied by "), "occupied_by").alias("explanation"),
            )
        )
    return reduce(DataFrame.unionByName, branches).withColumn("fallback", F.lit(True))


def _first_hit(near: Column, close: Callable[[Column, Column], Column]) -> Column:
    """First of the near aircraft, in table order, that a standard separation check finds; near ones are in that order."""
    gap = lambda o: F.abs(F.col("new_altitude") - o["o_altitude"])
    dist = lambda o: dist_nm(F.col("lat"), F.col("lon"), o["o_lat"], o["o_lon"])
    found = F.filter(near, lambda o: (dist(o) <= rules.SEARCH_NM) & close(gap(o), dist(o)))
    row = lambda o: F.struct(o["o_ord"].alias("o_ord"), o["o_callsign"].alias("o_callsign"), gap(o).alias("gap_ft"), dist(o).alias("dist_nm"))
    return F.get(F.transform(F.slice(found, 1, 1), row), 0)


def with_facts(applied: DataFrame, aircraft: DataFrame, minutes: int = 10) -> DataFrame:
    """Rows with what their neighbours mean: predicted conflict (has_conflict) and the first neighbour of each standard
    separation check (v, h).

    A row meets the traffic of its snapshot and is answered where it is; rows of one instruction, if several aircraft
    answer to its callsign, share their facts in a window that needs no shuffle of its own.
    """
    ok = F.col("error").isNull()
    (calm, sparse), *crowd = by_crowd(applied, aircraft)
    near = F.when(ok, within(lookahead.SEARCH_NM, "a_callsign"))
    met = beside(calm, sparse, "left").withColumn("near", near).drop("others")
    clash = lookahead.seen_along(lookahead.path(minutes), lambda w: F.exists("near", lambda o: lookahead.clash(w, o)))
    met = met.withColumns(
        {
            "has_conflict": F.when(ok & (F.size("near") > 0), clash),
            "v": _first_hit(F.col("near"), lambda gap, _: gap < rules.VERTICAL_STD_FT),
            "h": _first_hit(F.col("near"), lambda _, dist: dist < rules.HORIZONTAL_STD_NM),
        }
    ).drop("near")
    own = Window.partitionBy("snapshot_id", "instr_id")
    met = met.withColumns(
        {
            "has_conflict": F.coalesce(F.max("has_conflict").over(own), F.lit(False)),
            "v": F.min_by("v", F.col("v.o_ord")).over(own), "h": F.min_by("h", F.col("h.o_ord")).over(own),
        }
    )
    for busy, dense in crowd:
        facts = _neighbour_facts(busy.withColumn("track", F.when(ok, lookahead.path(minutes))), dense)
        told = busy.join(facts, "instr_id", "left").withColumn("has_conflict", F.coalesce("has_conflict", F.lit(False)))
        met = met.unionByName(told)
    return met


def _neighbour_facts(projected: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Per instruction of crowded snapshots, from one neighbour join: predicted conflict and the first neighbour of each
    standard separation check."""
    moving = projected.where(F.col("error").isNull()).select(
        "instr_id", "snapshot_id", F.col("a_callsign").alias("callsign"), "lat", "lon", "new_altitude", "track"
    )
    near = neighbours(moving, aircraft, lookahead.SEARCH_NM)
    clash = F.exists(
        "track",
        lambda w: (F.abs(w["altitude"] - F.col("o_altitude")) < lookahead.MIN_VERTICAL_FT)
        & (dist_nm(w["lat"], w["lon"], F.col("o_lat"), F.col("o_lon")) < lookahead.MIN_HORIZONTAL_NM),
    )
    close = F.col("dist_nm") <= rules.SEARCH_NM
    facts = near.select(
        "instr_id", clash.alias("clash"),
        F.struct("o_ord", "o_callsign", F.abs(F.col("new_altitude") - F.col("o_altitude")).alias("gap_ft"), "dist_nm").alias("hit"),
        "o_ord", close.alias("close"),
    )
    low = F.col("close") & (F.col("hit.gap_ft") < rules.VERTICAL_STD_FT)
    side = F.col("close") & (F.col("hit.dist_nm") < rules.HORIZONTAL_STD_NM)
    return facts.groupBy("instr_id").agg(
        F.bool_or("clash").alias("has_conflict"),
        F.min_by("hit", F.when(low, F.col("o_ord"))).alias("v"),
        F.min_by("hit", F.when(side, F.col("o_ord"))).alias("h"),
    )


def _hit(rule_id: str, kind: str | Column, severity: str, other: Column, text: Column) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("condition_type"),
        F.lit(severity).alias("severity"), other.cast("string").alias("other"), text.alias("explanation"),
    )


def assess(aircraft: DataFrame, snapshot: DataFrame, runways: DataFrame, instruction: DataFrame, minutes: int = 10) -> DataFrame:
    """One row per instruction with its violations as an array: the default rules and the user rules.

    Runways are few per snapshot and join as one small array; each other input is joined once.
    """
    applied = lookahead.apply_instruction(lookahead.with_aircraft(instruction, aircraft))
    held = runways.where(F.col("occupied") & (F.coalesce("occupied_by", F.lit("")) != "")).groupBy("snapshot_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "runway_id", "occupied_by"))).alias("held")
    )
    rows = (
        with_facts(applied, aircraft, minutes)
        .join(snapshot, "snapshot_id", "left").join(held, "snapshot_id", "left")
        .withColumn("callsign", F.coalesce("a_callsign", "callsign"))
        .withColumn("altitude", F.col("new_altitude"))
    )
    ok = F.col("error").isNull()
    none = F.lit(None).cast("string")
    low = F.when(
        ok & (F.col("msa") != 0) & (F.col("altitude") < F.col("msa")),
        _hit("MSA_RULE", "MSA_VIOLATION", "CRITICAL", none, F.format_string("CRITICAL: Aircraft %s at %dft is below MSA (%dft)", "callsign", "altitude", "msa")),
    )
    first = F.coalesce("v", "h")
    vertical = F.col("v").isNotNull()
    sep = F.when(
        ok & F.col("has_conflict") & first.isNotNull(),
        _hit(
            "SEPARATION_RULE", F.when(vertical, "SEPARATION_VERTICAL").otherwise("SEPARATION_HORIZONTAL"), "HIGH", first["o_callsign"],
            F.when(vertical, F.format_string("Vertical separation between %s and %s is %dft, below minimum 1000ft", "callsign", first["o_callsign"], first["gap_ft"]))
            .otherwise(F.format_string("Horizontal separation between %s and %s is %.1fNM, below minimum 5NM", "callsign", first["o_callsign"], first["dist_nm"])),
        ),
    )
    clearance = ok & F.col("itype").isin(*lookahead.RUNWAY_TYPES) & (F.coalesce("runway", F.lit("")) != "")
    others = F.filter("held", lambda r: r["occupied_by"] != F.col("callsign"))
    sweep = F.transform(
        others,
        lambda r: _hit("RUNWAY_RULE", "RUNWAY_AVAILABLE", "CRITICAL", r["occupied_by"], F.concat(F.lit("Runway "), r["runway_id"], F.lit(" occupied by "), r["occupied_by"])),
    )
    own = [F.when(ok, h) for h in rules.user_hits()]
    single = F.array_compact(F.array(low, sep, *own))
    found = F.when(clearance & sweep.isNotNull(), F.concat(single, sweep)).otherwise(single)
    return rows.select(
        F.col("instr_id").alias("target_id"), "snapshot_id", "callsign", "error", "has_conflict", found.alias("violations")
    )


def violation_rows(assessed: DataFrame) -> DataFrame:
    return assessed.select("target_id", "snapshot_id", "callsign", F.explode("violations").alias("x")).select(
        "target_id", "snapshot_id", "callsign", "x.*"
    )


def decisions(assessed: DataFrame) -> DataFrame:
    """Counts, decision and applied flag straight from the violation array."""
    bad = F.col("error").isNotNull()
    critical = F.exists("violations", lambda v: v["severity"] == "CRITICAL")
    return assessed.select(
        F.col("target_id").alias("instr_id"), "error", F.size("violations").cast("bigint").alias("alert_count"),
        critical.alias("has_critical"), "has_conflict",
        F.when(bad, "ROLLBACK").otherwise(alerts.decision(critical)).alias("decision"),
        (~bad & alerts.applied(critical, F.col("has_conflict"))).alias("applied"),
    )


def run(
    aircraft: DataFrame, snapshot: DataFrame, runways: DataFrame, instruction: DataFrame, minutes: int = 10
) -> dict[str, DataFrame]:
    """Violations, alerts and decisions as lazy tables over one assessment."""
    assessed = assess(aircraft, snapshot, runways, instruction, minutes)
    found = violation_rows(assessed)
    return {"assessed": assessed, "violations": found, "alerts": alerts.to_alerts(found), "decisions": decisions(assessed)}


def step_status(decisions: DataFrame) -> DataFrame:
    """One row per (instruction, step) with its status, as the step log shows them."""
    ok, failed, skipped = F.lit("success"), F.lit("failed"), F.lit("skipped")
    bad = F.col("error").isNotNull()
    refused = (F.col("decision") == "COMMIT") & ~F.col("applied")
    steps = [
        ("INPUT_PROCESSING", ok),
        ("NORMALIZATION", ok),
        ("STATE_UPDATE", F.when(bad, failed).otherwise(ok)),
        ("RULE_EVALUATION", F.when(bad, skipped).otherwise(ok)),
        ("ALERT_GENERATION", F.when(bad, skipped).otherwise(ok)),
        ("ALERT_PRESENTATION", F.when(bad, skipped).otherwise(ok)),
        ("ATCO_DECISION", F.when(bad, skipped).otherwise(ok)),
        ("FINAL_STATE_UPDATE", F.when(bad, skipped).when(refused, failed).otherwise(ok)),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), s.alias("status"))
            for i, (n, s) in enumerate(steps)
        ]
    )
    return decisions.select("instr_id", F.explode(rows).alias("s")).select("instr_id", "s.*")
