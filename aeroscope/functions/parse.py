"""Instruction parsing: text columns to instruction structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.functions.compact import compact
from aeroscope.functions.normalize import normalize
from aeroscope.idioms import first_group, first_int, let

# Verb texts in search order and the instruction type of the first one found.
VERBS = (
    ("climb", "climb"), ("descend", "descent"), ("maintain", "maintain_altitude"),
    ("altitude", "maintain_altitude"), ("level", "maintain_altitude"), ("flight level", "maintain_altitude"),
    ("turn", "heading"), ("heading", "heading"), ("fly heading", "heading"), ("hdg", "heading"),
    ("left", "turn_left"), ("right", "turn_right"),
    ("reduce speed", "reduce_speed"), ("increase speed", "increase_speed"), ("speed", "speed"),
    ("reduce", "reduce_speed"), ("increase", "increase_speed"),
    ("cleared to land", "landing_clearance"), ("cleared for approach", "approach_clearance"),
    ("approach", "approach_clearance"), ("contact approach", "approach_clearance"), ("land", "landing_clearance"),
    ("cleared for takeoff", "takeoff_clearance"), ("cleared for take off", "takeoff_clearance"),
    ("cleared for", "takeoff_clearance"), ("cleared", "takeoff_clearance"), ("proceed", "takeoff_clearance"),
    ("direct", "takeoff_clearance"), ("takeoff", "takeoff_clearance"), ("take off", "takeoff_clearance"),
    ("hold", "hold_position"), ("holding", "hold_position"), ("contact", "contact"), ("frequency", "contact"),
)

# Clearance and altitude types.
CLEARANCES = (
    "takeoff_clearance", "landing_clearance", "approach_clearance", "cleared_to_land", "cleared_as_filed",
)
ALTITUDE_CHANGES = ("descent", "climb", "expedite_descent", "expedite_climb", "maintain_altitude")
SPOKEN_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "niner": "9",
}
HEARD = "(?:zero|one|two|three|four|five|six|seven|eight|nine|niner)"

FIELDS = (
    ("target_altitude", "int"), ("flight_level", "int"), ("heading", "int"), ("direction", "string"),
    ("target_speed", "int"), ("speed_param", "int"), ("runway", "string"), ("waypoint", "string"),
    ("squawk", "string"), ("frequency", "string"),
)
CALLSIGN = r"(?iU)^([A-Z]{2,3}\d{1,4}[A-Z]?)\b|\b([A-Z]{3}\d{1,3})\b(?!\s*(?:fl|hdg|rwy))"


def callsign(text: Column) -> Column:
    return F.upper(F.coalesce(first_group(text, CALLSIGN, 1), first_group(text, CALLSIGN, 2)))


def first_verb(text: Column) -> Column:
    """First verb in list order that occurs anywhere in the text, as struct<text, itype>."""
    verbs = F.array(*[F.struct(F.lit(v).alias("text"), F.lit(t).alias("itype")) for v, t in VERBS])
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda t: F.try_element_at(F.filter(verbs, lambda v: t.contains(v["text"])), F.lit(1)))


def instruction_type(text: Column) -> Column:
    return F.coalesce(first_verb(text)["itype"], F.lit("unknown"))


def action_verb(text: Column) -> Column:
    return F.coalesce(F.substring_index(first_verb(text)["text"], " ", 1), F.lit("unknown"))


def altitude(text: Column) -> Column:
    p = r"(?i)FL(\d{2,3})|(?:to|at|maintain|level)\s+(\d{2,5})\s*(?:feet|ft)?|(\d{2,5})\s*(?:feet|ft)"
    return F.coalesce(first_int(text, p, 1) * 100, first_int(text, p, 2), first_int(text, p, 3))


def heading(text: Column) -> Column:
    return F.coalesce(
        first_int(text, r"(?i)(?:heading|turn)\s*(?:left|right)?\s*(\d{3})"), first_int(text, r"(?i)HDG(\d{3})")
    )


def direction(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right")


def runway(text: Column) -> Column:
    return F.upper(
        F.coalesce(
            first_group(text, r"(?i)RWY(\d{2}[LR]?)"), first_group(text, r"(?i)(?:runway|rwy)\s*(\d{2}[LR]?)")
        )
    )


def speed(text: Column) -> Column:
    patterns = (
        r"(?i)speed\s+(\d{3})", r"(?i)(\d{3})\s*knots?", r"(?i)maintain\s+speed\s+(\d{3})",
        r"(?i)reduce\s+speed\s+to\s+(\d{3})", r"(?i)increase\s+speed\s+to\s+(\d{3})",
    )
    return F.coalesce(*[first_int(text, p) for p in patterns])


def words_to_digits(text: Column) -> Column:
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.rtrim(w, F.lit(".,")))
    table = F.create_map(*[F.lit(x) for kv in SPOKEN_DIGITS.items() for x in kv])
    known = F.filter(words, lambda w: w.isin(*SPOKEN_DIGITS))
    return F.array_join(F.transform(known, lambda w: F.element_at(table, w)), "")


def _params(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS])


def compact_params(text: Column, itype: Column) -> Column:
    """Parameters from compact text; which ones are read depends on the type."""
    turns = itype.isin("heading", "turn_left", "turn_right")
    return _params(
        target_altitude=F.when(itype.isin("climb", "descent", "maintain_altitude"), altitude(text)),
        heading=F.when(turns, heading(text)),
        direction=F.when(turns, direction(text)),
        runway=runway(text),
        target_speed=F.when(itype.isin("speed", "reduce_speed", "increase_speed"), speed(text)),
    )


def spoken_params(text: Column) -> Column:
    """Parameters from spoken words."""
    low = F.lower(text)
    level = words_to_digits(first_group(low, rf"flight\s+level\s+({HEARD}(?:\s+{HEARD}){{1,2}})"))
    level = F.when(F.length(level).isin(2, 3), level.try_cast("int"))
    feet = first_int(low, r"(\d+)\s*(?:thousand\s+)?feet")
    feet = F.when(low.contains("thousand"), feet * 1000).otherwise(feet)
    said = words_to_digits(
        first_group(low, rf"(?:(?:descend|climb)\s+to|at|maintain|level)\s+({HEARD}(?:\s+{HEARD})+)")
    )
    said = F.when(F.length(said) >= 3, said.try_cast("int"))
    tail = first_group(low, r"runway\s+(.+)")
    side = F.when(tail.contains("left"), "L").when(tail.contains("right"), "R").otherwise("")
    rwy = F.nullif(words_to_digits(tail), F.lit(""))
    hdg = words_to_digits(first_group(low, rf"heading\s+({HEARD}(?:\s+{HEARD}){{2}})"))
    knots = first_group(low, rf"({HEARD}(?:\s+{HEARD}){{1,2}})\s*knots?")
    plain = first_group(low, rf"(?:speed|reduce speed to|increase speed to)\s+({HEARD}(?:\s+{HEARD}){{1,2}})")
    return _params(
        flight_level=level,
        target_altitude=F.coalesce(level * 100, feet, said),
        runway=F.concat(rwy, side),
        heading=F.when(F.length(hdg) == 3, hdg.try_cast("int")),
        target_speed=F.coalesce(
            first_int(low, r"(\d+)\s*knots?"),
            F.nullif(words_to_digits(knots), F.lit("")).try_cast("int"),
            F.nullif(words_to_digits(plain), F.lit("")).try_cast("int"),
        ),
    )


def is_empty(params: Column) -> Column:
    return F.coalesce(*[params[n].cast("string") for n, _ in FIELDS]).isNull()


def merge(*params: Column) -> Column:
    """Field by field, the first struct that has it wins."""
    return F.struct(*[F.coalesce(*[p[n] for p in params]).alias(n) for n, _ in FIELDS])


def to_instructions(transcript: DataFrame, text: str = "text", airlines=None) -> DataFrame:
    """Transcript rows with normalised and compact text and the parsed instruction; context stays as columns."""
    extra = {} if airlines is None else {"airlines": airlines}
    return (
        transcript.withColumn("asr_normalized", normalize(F.col(text), **extra))
        .withColumn("compact_text", compact(F.col("asr_normalized"), **extra))
        .withColumn("callsign", callsign(F.col("compact_text")))
        .withColumn("itype", instruction_type(F.col("compact_text")))
        .withColumn("verb", action_verb(F.col("compact_text")))
        .withColumn("short", compact_params(F.col("compact_text"), F.col("itype")))
        .withColumn(
            "params",
            F.when(is_empty(F.col("short")), spoken_params(F.col("asr_normalized"))).otherwise(F.col("short")),
        )
        .drop("short")
    )


def best_spans(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best tagged span per utterance and group, first one on ties, as one row per utterance."""
    def best(group: str) -> Column:
        mine = F.col("entity_group") == group
        return F.max_by(F.struct("word", "score"), F.when(mine, F.struct("score", (-F.col("ord")).alias("o"))))

    rows = spans.groupBy("utt_id").agg(*[best(g).alias(g) for g in ("callsign", "command", "value")])
    for g in ("callsign", "command", "value"):
        ok = F.col(f"{g}.score") >= threshold
        rows = rows.withColumn(f"{g}_entity", F.when(ok, F.col(f"{g}.word"))).withColumn(
            f"{g}_score", F.when(ok, F.col(f"{g}.score"))
        )
    code = F.upper(first_group(compact(F.col("callsign_entity")), r"(?U)\b([A-Z]{2,4}\d{1,4}[A-Z]?)\b"))
    rows = (
        rows.drop("callsign", "command", "value")
        .withColumn("callsign", code)
        .withColumn("value_compact", F.nullif(compact(F.col("value_entity")), F.lit("")))
    )
    scores = [F.when(F.col(f"{g}_score") > 0, F.col(f"{g}_score")) for g in ("callsign", "command", "value")]
    return rows.withColumns(
        {
            "confidence": F.coalesce(F.least(*scores), F.lit(0.0)),
            "success": F.col("callsign").isNotNull()
            & (F.col("command_entity").isNotNull() | F.col("value_entity").isNotNull()),
        }
    )


def merge_spans(transcript: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Span values over full-text values over spoken values; rows without good spans use the text alone."""
    parsed = to_instructions(transcript, text)
    best = best_spans(spans).where("success").select(
        "utt_id", F.col("callsign").alias("s_callsign"), "command_entity", "value_entity", "value_compact", "confidence"
    )
    both = parsed.join(best, "utt_id", "left")
    hit = F.col("s_callsign").isNotNull()
    named = instruction_type(F.col("command_entity"))
    source = F.when(named != "unknown", F.col("command_entity")).otherwise(F.col("compact_text"))
    return (
        both.withColumn("n_type", F.when(hit, instruction_type(source)).otherwise(F.col("itype")))
        .withColumn("n_verb", F.when(hit, action_verb(source)).otherwise(F.col("verb")))
        .withColumn(
            "merged",
            merge(
                compact_params(F.col("value_compact"), F.col("n_type")),
                compact_params(F.col("compact_text"), F.col("n_type")),
            ),
        )
        .withColumn(
            "params",
            F.when(~hit, F.col("params"))
            .when(is_empty(F.col("merged")) & F.col("value_entity").isNotNull(), spoken_params(F.col("value_entity")))
            .otherwise(F.col("merged")),
        )
        .withColumn("callsign", F.coalesce("s_callsign", "callsign"))
        .withColumn("itype", F.col("n_type"))
        .withColumn("verb", F.col("n_verb"))
        .drop("merged", "s_callsign", "n_type", "n_verb")
    )


def _parsed(callsign_col: Column, itype: Column, verb: Column, params: Column) -> Column:
    return F.struct(
        callsign_col.alias("callsign"), itype.alias("itype"), verb.alias("verb"), params.alias("params")
    )


def _rules(rules: list[tuple[Column, str, str]], default: tuple[str, str] = ("unknown", "unknown")) -> tuple[Column, Column]:
    itype = F.coalesce(*[F.when(c, F.lit(t)) for c, t, _ in rules], F.lit(default[0]))
    verb = F.coalesce(*[F.when(c, F.lit(v)) for c, _, v in rules], F.lit(default[1]))
    return itype, verb


def parse_console(raw: Column) -> Column:
    """Console grammar: the first matching family decides type and parameters."""
    text = F.trim(raw)
    low = F.lower(text)
    has: Callable[[str], Column] = low.contains
    levels = [
        (r"(?i)(?:climb|descend|descent)\s+(?:to\s+)?FL\s*(\d{3})", True),
        (r"(?i)(?:climb|descend|descent)\s+(?:to\s+)?(\d{4,5})", False),
        (r"(?i)(?:maintain|level)\s+(?:altitude\s+)?(\d{4,5})", False),
        (r"(?i)(?:maintain|level)\s+FL\s*(\d{3})", True),
    ]
    found = F.coalesce(
        *[
            F.when(
                text.rlike(p),
                F.struct(
                    (first_int(text, p) * (100 if is_fl else 1)).alias("alt"),
                    (first_int(text, p) if is_fl else F.lit(None).cast("int")).alias("fl"),
                ),
            )
            for p, is_fl in levels
        ]
    )
    is_alt = found.isNotNull()
    hdg = first_int(text, r"(?i)(?:heading|turn\s+(?:left|right)?|fly\s+heading)\s+(\d{3})")
    is_hdg = ~is_alt & hdg.isNotNull()
    spd = first_int(text, r"(?i)(?:speed|reduce\s+speed|increase\s+speed|maintain\s+speed)\s+(\d{3})")
    is_spd = ~is_alt & ~is_hdg & spd.isNotNull()
    rest = ~is_alt & ~is_hdg & ~is_spd
    itype, verb = _rules(
        [
            (is_alt & has("climb"), "climb", "climb"),
            (is_alt & (has("descend") | has("descent")), "descent", "descend"),
            (is_alt, "maintain_altitude", "maintain"),
            (is_hdg & has("turn left"), "turn_left", "turn_left"),
            (is_hdg & has("turn right"), "turn_right", "turn_right"),
            (is_hdg, "heading", "heading"),
            (is_spd & has("reduce"), "reduce_speed", "reduce_speed"),
            (is_spd & has("increase"), "increase_speed", "increase_speed"),
            (is_spd, "speed", "speed"),
            (has("cleared for takeoff"), "takeoff_clearance", "takeoff"),
            (has("land"), "landing_clearance", "land"),
            (has("taxi"), "taxi", "taxi"),
            (has("line up") & has("wait"), "line_up_and_wait", "line_up_and_wait"),
            (has("line up"), "line_up", "line_up"),
            (has("hold short"), "hold_short", "hold_short"),
            (has("hold position"), "hold_position", "hold_position"),
            (has("go around") | has("go-around"), "go_around", "go_around"),
            (has("direct to"), "direct_to", "direct_to"),
            (has("squawk"), "squawk", "squawk"),
            (has("mayday"), "mayday", "mayday"),
            (has("pan pan"), "pan_pan", "pan_pan"),
            (has("emergency descent"), "emergency_descent", "emergency_descent"),
            (has("contact"), "contact", "contact"),
            (has("monitor"), "monitor", "monitor"),
        ]
    )
    params = _params(
        target_altitude=found["alt"],
        flight_level=found["fl"],
        heading=F.when(is_hdg, hdg),
        speed_param=F.when(is_spd, spd),
        runway=F.when(rest, F.upper(first_group(text, r"(?i)runway\s+(\d{2}[LR]?)"))),
        waypoint=F.when(itype == "direct_to", F.upper(first_group(low, r"(?:^|.*?\s)to\s+(\S+)"))),
        squawk=F.when(itype == "squawk", first_group(low, r"squawk\s+(\d{4})")),
        frequency=F.when(itype == "contact", first_group(text, r"(\d{3}\.\d{1,3})")),
    )
    return _parsed(F.upper(first_group(text, r"(?iU)\b([A-Z]{2,4}\d{1,4})\b")), itype, verb, params)


def parse_minimal(raw: Column) -> Column:
    """Minimal grammar; the heading is the first three digits anywhere in the text, runways stay lower case."""
    low = F.lower(raw)
    has = low.contains
    itype, verb = _rules(
        [
            (has("descend") | has("descent"), "descent", "descend"),
            (has("climb"), "climb", "climb"),
            (has("turn"), "heading", "turn"),
            (has("heading"), "heading", "heading"),
            (has("cleared for takeoff"), "takeoff_clearance", "takeoff"),
            (has("cleared to land"), "landing_clearance", "land"),
        ]
    )
    level = first_int(low, r"fl\s*(\d+)")
    params = _params(
        target_altitude=F.when(itype.isin("descent", "climb"), level * 100),
        flight_level=F.when(itype == "descent", level),
        heading=F.when(itype == "heading", first_int(low, r"(\d{3})")),
        runway=F.when(itype.isin("takeoff_clearance", "landing_clearance"), first_group(low, r"runway\s+(\d+[lr]?)")),
    )
    return _parsed(F.upper(first_group(low, r"(?U)\b([a-z]{3}\d+)\b")), itype, verb, params)


def parse_bench(raw: Column) -> Column:
    """Benchmark grammar: adds maintain, speed, taxi, hold, squawk and line-up; headings follow their word."""
    low = F.lower(raw)
    has = low.contains
    itype, verb = _rules(
        [
            (has("descend") | has("descent"), "descent", "descend"),
            (has("climb"), "climb", "climb"),
            (has("maintain"), "maintain_altitude", "maintain"),
            (has("turn"), "heading", "turn"),
            (has("heading"), "heading", "heading"),
            (has("speed"), "speed", "speed"),
            (has("cleared for takeoff"), "takeoff_clearance", "takeoff"),
            (has("cleared to land"), "landing_clearance", "land"),
            (has("taxi"), "taxi", "taxi"),
            (has("hold short") | has("hold position"), "hold_short", "hold"),
            (has("contact"), "contact", "contact"),
            (has("squawk"), "squawk", "squawk"),
            (has("line up"), "line_up", "line_up"),
        ]
    )
    level = first_int(low, r"fl\s*(\d+)")
    feet = first_int(low, r"(?:to|at)\s+(\d{4,6})\s*(?:feet|ft)?")
    held = first_int(low, r"maintain\s+(?:at\s+)?(?:fl\s*)?(\d{4,6})\s*(?:feet|ft)?")
    held = F.when(held < 1000, held * 100).otherwise(held)
    params = _params(
        target_altitude=F.when(itype.isin("descent", "climb"), F.coalesce(level * 100, feet)).when(
            itype == "maintain_altitude", F.coalesce(level * 100, held)
        ),
        flight_level=F.when(itype == "descent", level),
        heading=F.when(itype == "heading", first_int(low, r"(?:heading|turn\s+(?:left|right)?)\s+(\d{3})")),
        speed_param=F.when(itype == "speed", first_int(low, r"speed\s+(?:to\s+)?(\d{3})")),
        runway=F.when(
            itype.isin("takeoff_clearance", "landing_clearance", "taxi", "hold_short", "line_up"),
            first_group(low, r"runway\s+(\d+[lr]?)"),
        ),
        waypoint=F.when(itype == "taxi", F.trim(F.regexp_extract(low, r"(?U)(?:to|via)\s+([\w\s]+)", 1))),
        squawk=F.when(itype == "squawk", first_group(low, r"squawk\s+(\d{4})")),
    )
    params = params.withField("waypoint", F.nullif(params["waypoint"], F.lit("")))
    return F.when(
        F.coalesce(raw, F.lit("")) != "",
        _parsed(F.upper(first_group(low, r"(?U)\b([a-z]{3}\d+)\b")), itype, verb, params),
    )


def derived(itype: Column, params: Column, temporal: Column, priority: Column) -> dict[str, Column]:
    """Target values and predicates of an instruction."""
    return {
        "to_altitude": F.coalesce(params["target_altitude"], params["flight_level"] * 100),
        "to_heading": params["heading"],
        "to_speed": F.coalesce(F.nullif(params["speed_param"], F.lit(0)), params["target_speed"]),
        "is_clearance": itype.isin(*CLEARANCES),
        "is_altitude_change": itype.isin(*ALTITUDE_CHANGES),
        "needs_immediate": F.coalesce(temporal == "immediately", F.lit(False))
        | F.coalesce(priority.isin("urgent", "expedite"), F.lit(False)),
    }


def has_parameter(params: Column, name: str) -> Column:
    return params[name].isNotNull()


def get_parameter(params: Column, name: str, default: Column) -> Column:
    return F.coalesce(params[name], default)
