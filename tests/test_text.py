"""Golden rows of normalisation and parsing."""

import pytest
from pyspark.sql import functions as F

from aeroscope.functions import compact, normalize, parse, vocab


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("text, out", [
    ("JBU1676 contact tower", "jetblue one six seven six contact tower"),
    ("AA12", "american one two"),
    ("W1676 ILS16R", "whiskey one six seven six ils one six right"),
    ("118.5", "one one eight five"),
    ("runway 16L wx", "runway one six left weather"),
    ("eight thirty five", "eight three five"),
    ("climb FL340", "climb flight level three four zero"),
    ("ten one twenty", "one one two zero"),
    ("é123 ok", "é123 ok"),
    ("", ""),
    (None, ""),
])
def test_normalize(spark, text, out):
    assert one(spark, text, normalize.normalize) == out


def test_switches_off(spark):
    off = lambda c: normalize.normalize(c, expand_callsigns=False, expand_numbers=False, lowercase=False, remove_punctuation=False)
    assert one(spark, "AAL123,  Go", off) == "AAL123, Go"
    spelled = lambda c: normalize.normalize(c, expand_icao=True)
    assert one(spark, "direct BORDO", spelled) == "direct bravo oscar romeo delta oscar"


@pytest.mark.parametrize("text, out", [
    ("american one two three descend to flight level two four zero", "AAL123 descend to FL240"),
    ("runway zero four left now", "RWY04L now"),
    ("heading two seven zero", "HDG270"),
    ("flight level two four zero now", "FL240now"),
    ("united airlines four five alpha hold", "UAL45A hold"),
    ("nothing here", "nothing here"),
])
def test_compact(spark, text, out):
    assert one(spark, text, compact.compact) == out


def test_compact_keep_space(spark):
    assert one(spark, "flight level two four zero now", lambda c: compact.compact(c, keep_space=True)) == "FL240 now"


@pytest.mark.parametrize("text, callsign, itype, field, value", [
    ("AAL123 descend to FL240", "AAL123", "descent", "target_altitude", 24000),
    ("UAL456 cleared for takeoff RWY34R", "UAL456", "takeoff_clearance", "runway", "34R"),
    ("AAL123 contact approach 118.5", "AAL123", "approach_clearance", "target_altitude", None),
])
def test_adapt(spark, text, callsign, itype, field, value):
    row = parse.to_instructions(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["callsign"], row["itype"], row["params"][field]) == (callsign, itype, value)


def test_minimal_grammar(spark):
    p = one(spark, "AAL123 cleared for takeoff runway 04L", parse.parse_minimal)
    assert (p["callsign"], p["itype"], p["params"]["runway"]) == ("AAL123", "takeoff_clearance", "04l")
    assert one(spark, "DAL789 heading 270", parse.parse_minimal)["params"]["heading"] == 789
    assert one(spark, "DAL789 heading 270", parse.parse_bench)["params"]["heading"] == 270


@pytest.mark.parametrize("text, itype, field, value", [
    ("UAL456 turn left heading 270", "turn_left", "heading", 270),
    ("AAL123 climb FL 350", "climb", "flight_level", 350),
    ("proceed direct to bordo", "direct_to", "waypoint", "BORDO"),
    ("AAL1 contact ground 121.9", "contact", "frequency", "121.9"),
    ("AAL1 line up and wait runway 09L", "line_up_and_wait", "runway", "09L"),
])
def test_console_grammar(spark, text, itype, field, value):
    p = one(spark, text, parse.parse_console)
    assert (p["itype"], p["params"][field]) == (itype, value)


def test_huge_numbers_do_not_fail(spark):
    assert one(spark, "AAL1 descend to FL99999999999999", parse.parse_minimal)["params"]["target_altitude"] is None


def test_airlines_from_a_table(spark):
    """Names of airlines that the built-in dictionary lacks."""
    from aeroscope.functions import compact, normalize, vocab

    air = spark.createDataFrame([("QQQ", "quick quokka"), ("ZQX", "zebra"), ("ZQA", "zebra air")], "code string, name string")
    df = spark.createDataFrame([("QQQ12 climb BA7 and XYZ3",)], "t string").withColumn("names", vocab.airline_map(air))
    row = df.select(normalize.icao_callsigns(F.col("t"), F.col("names")).alias("x")).first()
    assert row["x"] == "quick quokka one two climb BA7 and XYZ3"
    said = spark.createDataFrame([("quick quokka one two climb",), ("zebra one",), ("zebra air five",), ("delta airlines two",)], "t string")
    said = said.withColumn("codes", vocab.spoken_code_map(air))
    got = [r["x"].strip() for r in said.select(compact.compact_callsign(F.col("t"), codes=F.col("codes")).alias("x")).collect()]
    assert got == ["QQQ12 climb", "ZQX1", "ZQA5", "DAL2"]


def test_whole_airline_table(tmp_path):
    assert len(vocab.AIRLINES) == 281 and list(vocab.AIRLINES) == sorted(vocab.AIRLINES)
    assert set(vocab.IATA.values()) <= set(vocab.AIRLINES)
    other = tmp_path / "own.csv"
    other.write_text("# own table\ncode,name\nxyz,Some Carrier\n")
    assert vocab.load_airlines(str(other)) == {"XYZ": "some carrier"}


def test_airline_table_is_a_table_of_its_own(spark):
    """What the airline table is made from must not stand in the plans that read it: Spark mixed up the two sides of such joins."""
    from aeroscope.catalog import text

    plan = text.n27_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
