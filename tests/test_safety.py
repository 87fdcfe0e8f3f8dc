"""Golden rows of rules, look-ahead and decisions."""

import math

from pyspark.sql import functions as F

from aeroscope.operators import alerts, lookahead, rules, traffic
from aeroscope.plans import batch
from aeroscope.streaming import decisions as dec

PLANE = "snapshot_id long, ord long, callsign string, lat double, lon double, altitude int, heading int, speed int, flight_phase string"
RULE = "rule_id string, condition_type string, check_type string, separation_type string, reference_value int, min_distance double, runway_id string, max_holding int"


def planes(spark, *rows):
    return spark.createDataFrame([(1, i, *r, 90, 250, "cruise") for i, r in enumerate(rows)], PLANE)


def targets(aircraft, msa=5000):
    return aircraft.select(
        F.col("ord").alias("target_id"), "snapshot_id", F.lit("S").alias("sector_id"), F.lit(msa).cast("int").alias("msa"),
        "callsign", "lat", "lon", "altitude",
    )


def rule(spark, **f):
    names = [x.split()[0] for x in RULE.split(", ")]
    return spark.createDataFrame([tuple(f.get(n) for n in names)], RULE)


PAIR = (("AAL123", 40.0, -74.0, 30000), ("UAL456", 40.08, -74.0, 30000))


def test_msa_and_edges(spark):
    low = planes(spark, ("AAL123", 40.0, -74.0, 4000))
    r = rule(spark, rule_id="R", condition_type="ALTITUDE", check_type="MSA_CHECK")
    assert [x["severity"] for x in rules.msa(targets(low), r).collect()] == ["CRITICAL"]
    for msa in (4000, 0, None):
        assert rules.msa(targets(low, msa), r).count() == 0


def test_minimum(spark):
    low = targets(planes(spark, ("AAL123", 40.0, -74.0, 4000)))
    for ref, n in ((5000, 1), (4000, 0), (3000, 0)):
        r = rule(spark, rule_id="R", condition_type="ALTITUDE", check_type="MINIMUM", reference_value=ref)
        assert rules.altitude_minimum(low, r).count() == n


def test_separation(spark):
    both = planes(spark, *PAIR)
    pairs = rules.near_pairs(targets(both), both)
    r = rule(spark, rule_id="R", condition_type="SEPARATION", separation_type="VERTICAL", min_distance=1000.0)
    assert {(x["callsign"], x["other"]) for x in rules.separation_vertical(pairs, r).collect()} == {("AAL123", "UAL456"), ("UAL456", "AAL123")}
    r5 = rule(spark, rule_id="R", condition_type="SEPARATION", separation_type="HORIZONTAL", min_distance=5.0)
    assert rules.separation_horizontal(pairs, r5).count() == 2
    apart = planes(spark, PAIR[0], ("UAL456", 40.2, -74.0, 32000))
    rb = rule(spark, rule_id="R", condition_type="SEPARATION", separation_type="BOTH", min_distance=5.0)
    assert rules.separation_both(rules.near_pairs(targets(apart), apart), rb).count() == 0


def test_neighbours_match_brute_force(spark):
    import random

    random.seed(3)
    rows = [(f"C{i}", random.uniform(-85, 85), random.uniform(-179, 179) if i % 2 else random.uniform(-1, 1), 1000) for i in range(300)]
    rows += [(f"D{i}", 60 + random.uniform(0, 1), random.uniform(0, 1), 1000) for i in range(100)]
    df = planes(spark, *rows)
    got = {(r["callsign"], r["o_callsign"]) for r in traffic.neighbours(df.select("snapshot_id", "callsign", "lat", "lon"), df, 30.0).collect()}

    def d(a, b):
        return math.hypot((b[1] - a[1]) * 60, (b[2] - a[2]) * 60 * math.cos(math.radians(a[1])))

    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and d(a, b) <= 30.0}
    assert got


def test_runway_rules(spark):
    strips = spark.createDataFrame(
        [(1, 0, "27L", True, "AAL123", ["A", "B", "C", "D"])], "snapshot_id long, ord int, runway_id string, occupied boolean, occupied_by string, holding_short array<string>"
    )
    t = targets(planes(spark, ("UAL456", 40.0, -74.0, 100)))
    r = rule(spark, rule_id="R", condition_type="RUNWAY", check_type="OCCUPIED", runway_id="27L")
    assert rules.runway_occupied(t, r, strips).first()["severity"] == "CRITICAL"
    full = rule(spark, rule_id="R", condition_type="RUNWAY", check_type="HOLDING_SHORT_FULL", runway_id="27L", max_holding=3)
    assert rules.holding_congestion(t, full, strips).first()["condition_type"] == "HOLDING_SHORT_CONGESTION"
    gone = rule(spark, rule_id="R", condition_type="RUNWAY", check_type="EXISTS", runway_id="09R")
    assert rules.runway_missing(t, gone, strips).first()["severity"] == "HIGH"
    assert rules.runway_sweep(t, strips).count() == 1


def test_any_logic_and_empty(spark):
    c = spark.createDataFrame(
        [(1, "A", "ANY", True, None), (1, "A", "ANY", False, "LOW"), (1, "B", "ALL", True, None), (1, "B", "ALL", False, "HIGH"),
         (1, "C", "ALL", None, None), (1, "D", "ANY", None, None)],
        "target_id long, rule_id string, logic string, satisfied boolean, severity string",
    )
    got = {r["rule_id"]: (r["passed"], r["severity"]) for r in rules.check_rules(c).collect()}
    assert got == {"A": (True, "INFO"), "B": (False, "HIGH"), "C": (True, "INFO"), "D": (False, "INFO")}


INSTR = "instr_id long, snapshot_id long, seq long, callsign string, itype string, target_altitude int, flight_level int, heading int, target_speed int, runway string, speaker string, raw_text string"


def instruction(spark, *rows):
    return spark.createDataFrame([(i, 1, i, *r) for i, r in enumerate(rows)], INSTR)


def test_projection(spark):
    df = planes(spark, ("AAL123", 40.0, -74.0, 30000))
    ask = instruction(spark, ("AAL123", "descent", None, 240, None, None, None, "ATCO", "x"), (None, "climb", 1, None, None, None, None, "ATCO", "x"))
    p = {r["instr_id"]: r for r in lookahead.project(df, ask, minutes=5).collect()}
    assert p[0]["new_altitude"] == 24000 and len(p[0]["track"]) == 5
    assert [w["altitude"] for w in p[0]["track"]] == [29000, 28000, 27000, 26000, 25000]
    assert p[1]["error"] == "No callsign in instruction"
    clamped = lookahead.project(df, ask, minutes=10, clamp=True).where("instr_id = 0").first()
    assert clamped["track"][-1]["altitude"] == 24000
    t = lookahead.minutes_to_altitude(F.lit(30000), F.lit(24000), F.lit("descent"))
    assert spark.range(1).select(t).first()[0] == 6.0


def test_readback(spark):
    ask = instruction(spark, ("A", "descent", 4000, None, None, None, None, "PILOT", "going down"), ("A", "descent", 4000, None, None, None, None, "PILOT", "down 4000"))
    assert alerts.readback_misses(ask).count() == 1


def run_events(spark, rows):
    names = [f.split()[0] for f in dec.EVENT_FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], dec.EVENT_FIELDS)


SYNC = {
    "sector_id": "S", "seq": 0, "kind": "sync", "msa": 1000, "runways": "[]",
    "aircraft": '[{"callsign":"AAL1","lat":40.0,"lon":-74.0,"altitude":30000,"heading":90,"speed":400},'
                '{"callsign":"UAL2","lat":40.0,"lon":-73.9,"altitude":30000,"heading":90,"speed":400}]',
}


def test_forced_commit_history_and_undo(spark):
    rows = [
        SYNC,
        {"sector_id": "S", "seq": 1, "kind": "propose", "callsign": "AAL1", "itype": "maintain_altitude", "target_altitude": 30000},
        {"sector_id": "S", "seq": 2, "kind": "commit"},
        {"sector_id": "S", "seq": 3, "kind": "commit", "forced": True, "reason": "seen"},
        {"sector_id": "S", "seq": 4, "kind": "undo"},
        {"sector_id": "S", "seq": 5, "kind": "instr", "callsign": "UAL2", "itype": "descent", "target_altitude": 500},
        {"sector_id": "S", "seq": 6, "kind": "instr", "callsign": "NONE", "itype": "climb", "target_altitude": 500},
    ]
    got = {r["seq"]: r for r in dec.run_decisions(run_events(spark, rows)).collect()}
    assert [got[i]["status"] for i in range(7)] == ["applied", "pending", "refused", "applied", "applied", "rolled_back", "invalid"]
    assert got[3]["reason"] == "seen" and got[3]["history"] == 2 and got[4]["history"] == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for s in ("S", "T"):
        rows.append({**SYNC, "sector_id": s})
        rows += [
            {"sector_id": s, "seq": i, "kind": "instr", "callsign": "AAL1" if i % 2 else "UAL2", "itype": "descent", "target_altitude": 30000 - 900 * i}
            for i in range(1, 40)
        ]
    events = run_events(spark, rows)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        events.where((F.col("seq") / 14).cast("int") == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(dec.EVENT_FIELDS).option("maxFilesPerTrigger", 1).parquet(src)
    q = (
        dec.run_decision_stream(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(spark.read.parquet(out)) == key(dec.run_decisions(events))


def test_fallback_and_affected(spark):
    v = spark.createDataFrame(
        [(1, 1, "A", "R", "RUNWAY_AVAILABLE", "CRITICAL", "B", "x"), (1, 1, "A", "R", "SEPARATION_VERTICAL", "HIGH", "C", "x")],
        "target_id long, snapshot_id long, callsign string, rule_id string, condition_type string, severity string, other string, explanation string",
    )
    got = {(r["affected"], r["affected_raw"]) for r in alerts.to_alerts(v).collect()}
    assert got == {("A,B", "A,B"), ("A,C", "")}


def test_headings_round_half_to_even(spark, tmp_path):
    from aeroscope.catalog import safety

    rows = [(1, 72.1), (2, 72.3), (3, -0.1), (4, -0.3)]  # 360.5, 361.5, -0.5, -1.5 degrees
    spark.createDataFrame(rows, "event_id long, value double").withColumn("user_id", F.lit(50)).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.event_id for r in safety.t5(spark, str(tmp_path)).collect() if r.broken == "heading_range"}
    assert found == {2, 4}


def test_neighbours_against_all_pairs(spark):
    """Every pair within the radius, also near a pole, over the date line's numbers and across cells; a target travels once."""
    import random

    from aeroscope.functions.geo import dist_nm

    rnd = random.Random(5)
    spots = [(rnd.uniform(*a), rnd.uniform(*o)) for a, o, n in (((39, 42), (-76, -73), 120), ((-1, 1), (-1, 1), 60), ((88, 90), (-180, 180), 60), ((-80, -78), (170, 180), 60)) for _ in range(n)]
    air = planes(spark, *[(f"A{i}", lat, lon, 30000) for i, (lat, lon) in enumerate(spots)]).cache()
    for radius in (20.0, 30.0):
        near = traffic.neighbours(air.select("snapshot_id", "callsign", "lat", "lon"), air, radius)
        others = air.select("snapshot_id", *[F.col(c).alias(f"o_{c}") for c in ("callsign", "lat", "lon")])
        pairs = air.join(others, "snapshot_id").where(F.col("callsign") != F.col("o_callsign"))
        all_pairs = pairs.where(dist_nm(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= radius)
        found = sorted((r.callsign, r.o_callsign) for r in near.select("callsign", "o_callsign").collect())
        assert found == sorted((r.callsign, r.o_callsign) for r in all_pairs.select("callsign", "o_callsign").collect()) and len(found) > 300
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    looking = plan[: plan.index("o_callsign#", plan.index("Join Inner"))]
    assert "Generate" not in looking.split("Join Inner")[1]


def test_altitude_counts_like_the_rows(spark):
    air = planes(spark, *[(f"A{i}", 40.0, -74.0, 1000 * (i % 9)) for i in range(30)])
    aim = targets(air).withColumn("msa", F.when(F.col("target_id") % 4 > 0, F.col("msa")).cast("int"))
    kinds = [("MINIMUM", 4000), ("MINIMUM", 4000), ("MINIMUM", 7500), ("MAXIMUM", 5000), ("MAXIMUM", None), ("MSA_CHECK", None), ("MSA_CHECK", None)]
    rows = [rule(spark, rule_id=f"R{i}", condition_type="ALTITUDE", check_type=c, reference_value=v) for i, (c, v) in enumerate(kinds)]
    some = rows[0]
    for r in rows[1:]:
        some = some.unionByName(r)
    every = rules.altitude_minimum(aim, some).unionByName(rules.altitude_maximum(aim, some)).unionByName(rules.msa(aim, some))
    by_rows = {r.target_id: r.n for r in every.groupBy("target_id").agg(F.count("*").alias("n")).collect()}
    counted = rules.altitude_counts(aim, some)
    assert {r.target_id: r.n for r in counted.collect()} == by_rows
    assert "explanation" not in counted._jdf.queryExecution().analyzed().toString()


def test_rule_counts_like_the_rows(spark):
    air = planes(spark, *[(f"A{i}", 40.0 + i % 7 * 0.03, -74.0, 700 * (i % 9)) for i in range(30)])
    aim = targets(air).withColumn("msa", F.when(F.col("target_id") % 4 > 0, F.col("msa")).cast("int"))
    lanes = spark.createDataFrame(
        [(1, "09L", True, "A1", ["H"] * 3), (1, "27R", False, None, []), (1, "04L", True, None, ["H"] * 4), (1, "04L", True, "A2", ["H"])],
        "snapshot_id long, runway_id string, occupied boolean, occupied_by string, holding_short array<string>",
    )
    kinds = [("MINIMUM", 2000), ("MINIMUM", 2000), ("MINIMUM", None), ("MAXIMUM", 3000), ("MSA_CHECK", None), ("BANK", 1)]
    rows = [dict(condition_type="ALTITUDE", check_type=c, reference_value=v) for c, v in kinds]
    rows += [dict(condition_type="SEPARATION", separation_type=c, min_distance=v) for c, v in (("VERTICAL", 1000.0), ("VERTICAL", 300.0), ("HORIZONTAL", 2.5), ("HORIZONTAL", 5.0), ("BOTH", 5.0))]
    rows += [dict(condition_type="RUNWAY", check_type=c, runway_id=v) for c in ("OCCUPIED", "HOLDING_SHORT_FULL", "EXISTS") for v in ("09L", "04L", "13C", None)]
    names = [x.split()[0] for x in RULE.split(", ")]
    some = spark.createDataFrame([tuple({"rule_id": f"R{i // 2}", **r}.get(n) for n in names) for i, r in enumerate(rows)], RULE)
    by_rows = rules.evaluate(aim, some, air, lanes).groupBy("rule_id", "condition_type").agg(F.count("*").alias("n"))
    counted = rules.rule_counts(aim, some, air, lanes)
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in by_rows.collect()}
    assert len({r.condition_type for r in counted.collect()}) == 8
    assert "explanation" not in counted._jdf.queryExecution().analyzed().toString()


def test_nearest_states_without_frames_to_the_end(spark):
    at = [(s, t, n) for s in "AB" for n, t in enumerate((0, 60, 60, 7300, 7400, 40000)) if (s, n) != ("B", 0)]
    versions = spark.createDataFrame(at, "sector_id string, at_sec long, seq long")
    asked = [("A", q, t) for q, t in enumerate((0, 30, 31, 60, 3600, 3700, 7350, 7351, 24000, 50000))] + [("B", 90, 1), ("B", 91, 23700)]
    found = dec.nearest_states(versions, spark.createDataFrame(asked, "sector_id string, q_id long, t_sec long"))
    nearest = {(s, q): min((abs(v - t), v, n) for x, v, n in at if x == s)[1:] for s, q, t in asked}
    assert {(r.sector_id, r.q_id): (r.at_sec, r.seq) for r in found.collect()} == nearest
    assert "unboundedfollowing" not in found._jdf.queryExecution().analyzed().toString().lower()


def sky(spark, n=60):
    import random

    random.seed(11)
    rows = [
        (k % 3, k, f"C{k}" if k % 7 else f"c{k - 1}", 40 + random.uniform(0, 1), -74 + random.uniform(0, 1), 1000 * random.randint(2, 12), random.randint(0, 359), 250, "cruise")
        for k in range(n)
    ]
    air = spark.createDataFrame(rows, PLANE)
    asks = [(r[1], r[0], r[2] if r[1] % 9 else "X1", ("descent", "climb", "heading", "takeoff_clearance")[r[1] % 4], 5000, None, 90, None, "27L", "text", "ATCO") for r in rows]
    ask = spark.createDataFrame(
        asks, "instr_id long, snapshot_id long, callsign string, itype string, target_altitude int, flight_level int, heading int, target_speed int, runway string, raw_text string, speaker string"
    )
    shot = spark.createDataFrame([(k, "S", 5000) for k in range(3)], "snapshot_id long, sector_id string, msa int")
    strips = spark.createDataFrame([(k, 0, "27L", True, "C1") for k in range(3)], "snapshot_id long, ord int, runway_id string, occupied boolean, occupied_by string")
    return air, shot, strips, ask


def test_no_track_is_shuffled(spark):
    """Tracks are computed where a row has met its traffic; only narrow rows travel."""
    air, shot, strips, ask = sky(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = batch.run(air, shot, strips, ask)["decisions"]._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def sent(node):
        own = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())] if "Exchange" in node.nodeName() else []
        return own + [t for i in range(node.children().size()) for t in sent(node.children().apply(i))]

    types = sent(plan)
    assert types and not [t for t in types if "minute" in t]


def test_crowded_snapshots_give_the_same_rows(spark, monkeypatch):
    air, shot, strips, ask = sky(spark)
    applied = lookahead.apply_instruction(lookahead.with_aircraft(ask, air))

    def rows():
        found = [lookahead.separation(applied, air), lookahead.conflicts(applied, air), batch.run(air, shot, strips, ask)["violations"], batch.run(air, shot, strips, ask)["decisions"]]
        return [sorted(map(str, d.select(*sorted(d.columns)).collect())) for d in found]

    calm = rows()
    monkeypatch.setattr(traffic, "CROWD", 0)
    assert rows() == calm and all(calm)
    pairs = lookahead.separation(applied, air).groupBy("instr_id").count()
    assert {r["instr_id"]: r["count"] for r in pairs.collect()} == {r["instr_id"]: r["n_near"] for r in lookahead.conflicts(applied, air).collect()}
