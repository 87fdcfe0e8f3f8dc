"""Text normalisation and instruction parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroscope.catalog import query
from aeroscope.fixtures import sql_spoken, table
from aeroscope.functions import compact, normalize, parse, vocab
from aeroscope.idioms import join_nulls, once_per_value
from aeroscope.session import cut


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_each(text: str, pattern: str, change) -> str:
    """Rewrite every match: mark, split, change the odd parts."""
    marked = f"regexp_replace({text}, '({_q(pattern)})', chr(1) || '\\1' || chr(1), 'g')"
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(1)), "
        f"lambda x, i: CASE WHEN i % 2 = 0 THEN {change('x')} ELSE x END), '')"
    )


def sql_case(expr: str, table_: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {default} END"


def coded(n: int, names: dict[str, str]):
    return lambda t: sql_each(
        t, rf"\b[A-Z]{{{n}}}\d{{1,4}}\b",
        lambda x: f"coalesce({sql_case(f'substr({x}, 1, {n})', names)} || ' ' || {sql_spoken(f'substr({x}, {n + 1})')}, {x})",
    )


def num(x: str) -> str:
    return sql_spoken(f"regexp_extract({x}, '(\\d+)$', 1)")


def sql_runway(x: str) -> str:
    digits = sql_spoken(f"regexp_extract({x}, '(\\d+)[A-Za-z]$', 1)")
    return (
        f"(CASE WHEN lower({x}) LIKE 'runway%' THEN 'runway ' ELSE '' END) || {digits} || "
        f"(CASE WHEN upper({x}) LIKE '%L' THEN ' left' ELSE ' right' END)"
    )


def sql_chain(t: str, pairs) -> str:
    for p, r in pairs:
        t = f"regexp_replace({t}, '{_q(p)}', '{r}', 'gi')"
    return t


def sql_compound(t: str) -> str:
    return sql_chain(t, [(rf"\b{k}\s+(one|two|three|four|five|six|seven|eight|nine)\b", rf"{v} \1") for k, v in vocab.TENS.items()])


def sql_tens(t: str) -> str:
    return sql_chain(t, [(rf"\b{k}\b", f"{v} zero") for k, v in vocab.TENS.items()])


def sql_abbr(t: str) -> str:
    return sql_chain(t, [(rf"\b{k}\b", v) for k, v in vocab.ABBREVIATIONS.items()])


def sql_punct(t: str) -> str:
    return f"translate({t}, '{_q(vocab.PUNCTUATION)}', '{' ' * len(vocab.PUNCTUATION)}')"


def sql_squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def sql_nato(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {sql_case('c', vocab.NATO, 'lower(c)')}), ' ')"


SQL = {
    "N1_navaids": lambda t: sql_each(
        t, r"(?i)\b(?:ILS|VOR|NDB|DME|GS|LOC|VORDME|VORTAC)\d{1,3}(?:L|R|C)?\b",
        lambda x: f"lower(regexp_extract({x}, '^[A-Za-z]+')) || ' ' || regexp_replace({x}, '^[A-Za-z]+', '')",
    ),
    "N2_icao": coded(3, vocab.AIRLINES),
    "N3_iata": coded(2, vocab.iata_names()),
    "N4_letter": coded(1, vocab.NATO),
    "N5_numbers": lambda t: sql_each(t, r"\b\d{3,5}\b", sql_spoken),
    "N7_level": lambda t: sql_each(t, r"(?i)\b(?:FL|FLIGHT LEVEL)\s*\d{2,3}\b", lambda x: f"'flight level ' || {num(x)}"),
    "N8_heading": lambda t: sql_each(t, r"(?i)\b(?:HDG|HEADING)\s*\d{3}\b", lambda x: f"'heading ' || {num(x)}"),
    "N9_frequency": lambda t: sql_each(
        t, r"\b\d{2,3}\.\d{2,3}\b",
        lambda x: f"{sql_spoken(f'''split_part({x}, '.', 1)''')} || ' decimal ' || {sql_spoken(f'''split_part({x}, '.', 2)''')}",
    ),
    "N10_squawk": lambda t: sql_each(t, r"(?i)\b(?:SQUAWK|SQ)\s*\d{4}\b", lambda x: f"'squawk ' || {num(x)}"),
    "N11_runway": lambda t: sql_each(t, r"(?i)\b(?:runway\s+)?\d{1,2}[LR]\b", sql_runway),
    "N12_abbreviations": sql_abbr,
    "N13_all_numbers": lambda t: sql_each(t, r"\b\d+\b", sql_spoken),
    "N14_compound": sql_compound,
    "N15_tens": sql_tens,
    "N16_waypoints": lambda t: sql_each(t, r"\b[A-Z]{4,5}\b", sql_nato),
    "N17_punctuation": sql_punct,
    "N18_whitespace": lambda t: f"lower({sql_squeeze(t)})",
}

SPARK = {
    "N1_navaids": normalize.split_navaids,
    "N2_icao": normalize.icao_callsigns,
    "N3_iata": normalize.iata_callsigns,
    "N4_letter": normalize.letter_callsigns,
    "N5_numbers": normalize.bare_numbers,
    "N7_level": normalize.flight_level,
    "N8_heading": normalize.heading,
    "N9_frequency": normalize.frequency,
    "N10_squawk": normalize.squawk,
    "N11_runway": normalize.runway,
    "N12_abbreviations": normalize.abbreviations,
    "N13_all_numbers": normalize.all_numbers,
    "N14_compound": normalize.compound_numbers,
    "N15_tens": normalize.lone_tens,
    "N16_waypoints": normalize.waypoints,
    "N17_punctuation": normalize.drop_punctuation,
    "N18_whitespace": lambda c: F.lower(normalize.squeeze(c)),
}


def _text_query(name, fn, sql):
    @query(name, sql)
    def run(spark, sf):
        return table(spark, sf, "utterance").select("utt_id", fn(F.col("text")).alias("out"))


for _name, _fn in SPARK.items():
    _text_query(_name, _fn, f"SELECT utt_id, {SQL[_name]('text')} AS out FROM utterance")

SQL_STEPS = [
    "N1_navaids", "N2_icao", "N3_iata", "N4_letter", "N5_numbers", "N7_level", "N8_heading", "N9_frequency",
    "N10_squawk", "N11_runway", "N12_abbreviations", "N13_all_numbers", "N14_compound", "N15_tens",
    "N17_punctuation", "N18_whitespace",
]


def norm_ctes(source: str, key: str) -> str:
    """One CTE per step so that no text is repeated inside another."""
    out = [f"s0 AS (SELECT {key}, coalesce(text, '') AS t FROM {source})"]
    for i, n in enumerate(SQL_STEPS):
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT {key}, {SQL[n]('t')} AS t FROM s{i})")
    return ", ".join(out)


LAST = f"s{len(SQL_STEPS)}"


@query("N6_spell_number", """SELECT event_id, trim(array_to_string(list_transform(string_split(CAST(value AS STRING), ''),
  lambda c: CASE c WHEN '0' THEN 'zero' WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four'
  WHEN '5' THEN 'five' WHEN '6' THEN 'six' WHEN '7' THEN 'seven' WHEN '8' THEN 'eight' WHEN '9' THEN 'nine' ELSE c END), ' ')) AS out
FROM events""")
def n6(spark, sf):
    return table(spark, sf, "events").select("event_id", normalize.spell_number(F.col("value").cast("string")).alias("out"))


@query("N19_normalize", f"WITH {norm_ctes('utterance', 'utt_id')} SELECT utt_id, t AS out FROM {LAST}")
def n19(spark, sf):
    return table(spark, sf, "utterance").select("utt_id", normalize.normalize(F.col("text")).alias("out"))


@query("N20_expand_callsign", f"""
WITH c AS (SELECT instr_id, upper(coalesce(callsign, 'QQ12')) AS c FROM instruction)
SELECT instr_id, CASE WHEN regexp_matches(c, '^[A-Z]{{3}}\\d+$') THEN {sql_case('substr(c, 1, 3)', vocab.AIRLINES)} || ' ' || {sql_spoken('substr(c, 4)')} END AS out
FROM c""")
def n20(spark, sf):
    c = F.concat(F.lit(" "), F.lower(F.coalesce("callsign", F.lit("QQ12"))))
    return table(spark, sf, "instruction").select("instr_id", normalize.expand_callsign(c).alias("out"))


# an airline table made from the data: the codes that stand in texts, with nations as names
AIR_SQL = """air AS (SELECT code, lower(any_value(n_name)) || ' ' || lower(code) AS name
 FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b([A-Z]{3})\\d{1,4}\\b', 1)) AS code FROM utterance) JOIN nation ON n_nationkey = ascii(code) % 25 GROUP BY code)"""


def _airlines(spark, sf):
    codes = table(spark, sf, "utterance").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{3})\d{1,4}\b"), F.lit(1))).alias("code")).distinct()
    nations = table(spark, sf, "nation").select((F.col("n_nationkey") % 25).cast("int").alias("k"), F.lower("n_name").alias("nation"))
    # few rows that plans read three times; the cut keeps a table and what is derived from it apart in one plan
    return cut(codes.join(nations, F.ascii("code") % 25 == F.col("k")).select("code", F.concat_ws(" ", "nation", F.lower("code")).alias("name")))


def _by_table(t: str, n: int) -> str:
    return sql_each(t, rf"\b[A-Z]{{{n}}}\d{{1,4}}\b", lambda x: f"coalesce(names[substr({x}, 1, {n})] || ' ' || {sql_spoken(f'substr({x}, {n + 1})')}, {x})")


@query("N2_airline_table", f"WITH {AIR_SQL} SELECT utt_id, {_by_table('text', 3)} AS out FROM utterance, (SELECT map_from_entries(list((code, name))) AS names FROM air)")
def n2_table(spark, sf):
    said = table(spark, sf, "utterance").withColumn("names", vocab.airline_map(_airlines(spark, sf)))
    return said.select("utt_id", normalize.icao_callsigns(F.col("text"), F.col("names")).alias("out"))


@query("N27_airline_table", f"""WITH {AIR_SQL}, said AS (SELECT utt_id, name, right(utt_id::VARCHAR, 2) AS digits, code FROM utterance JOIN air ON code = regexp_extract(text, '\\b([A-Z]{{3}})\\d{{1,4}}\\b', 1))
SELECT utt_id, code || digits || ' climb' AS out FROM said""")
def n27_table(spark, sf):
    """Spoken names of the table's airlines, then two spoken digits, back to codes."""
    airlines = _airlines(spark, sf)
    digits = F.substring(F.col("utt_id").cast("string"), -2, 2)
    code = F.regexp_extract("text", r"\b([A-Z]{3})\d{1,4}\b", 1)
    said = table(spark, sf, "utterance").select("utt_id", code.alias("code"), digits.alias("digits")).join(airlines, "code")
    said = said.withColumn("codes", vocab.spoken_code_map(airlines))
    text = F.concat_ws(" ", "name", normalize.spoken(F.col("digits")), F.lit("climb"))
    return said.select("utt_id", F.rtrim(compact.compact_callsign(text, codes=F.col("codes"))).alias("out"))


# every airline of the built-in table stands in some text; the twin reads the table's file
FILE_SQL = f"""air AS (SELECT list(code ORDER BY code) AS codes, map_from_entries(list((code, lower(name)))) AS names FROM read_csv('{vocab.AIRLINES_FILE}', header = true, comment = '#', all_varchar = true)),
called AS (SELECT utt_id, codes[abs(utt_id) % len(codes) + 1] AS code, (100 + abs(utt_id) % 900)::VARCHAR AS digits, names FROM utterance, air)"""


def _called(spark, sf):
    codes = F.array(*map(F.lit, vocab.AIRLINES))
    return table(spark, sf, "utterance").select(
        "utt_id", F.get(codes, (F.abs("utt_id") % len(vocab.AIRLINES)).cast("int")).alias("code"), (100 + F.abs("utt_id") % 900).cast("string").alias("digits")
    )


@query("N2_every_airline", f"WITH {FILE_SQL} SELECT utt_id, names[code] || ' ' || {sql_spoken('digits')} || ' climb' AS out FROM called")
def n2_every(spark, sf):
    return _called(spark, sf).select("utt_id", normalize.icao_callsigns(F.concat("code", "digits", F.lit(" climb"))).alias("out"))


@query("N20_every_airline", f"WITH {FILE_SQL} SELECT utt_id, names[code] || ' ' || {sql_spoken('digits')} AS out FROM called")
def n20_every(spark, sf):
    return _called(spark, sf).select("utt_id", normalize.expand_callsign(F.concat("code", "digits")).alias("out"))


@query("N22_every_airline", f"WITH {FILE_SQL} SELECT utt_id, names[code] AS out FROM called")
def n22_every(spark, sf):
    return _called(spark, sf).select("utt_id", normalize.airline_name(F.lower("code")).alias("out"))


@query("N21_spelling", f"""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(upper(p_name), ''),
  lambda c: regexp_matches(c, '^[A-Z0-9]$')), lambda c: {sql_case('c', vocab.NATO, 'lower(c)')}), ' ') AS out FROM part""")
def n21(spark, sf):
    return table(spark, sf, "part").select("p_partkey", normalize.spell_icao(F.col("p_name")).alias("out"))


@query("N22_airline", f"""SELECT instr_id, {sql_case("substr(upper(coalesce(callsign, 'ba')), 1, 3)", {**vocab.AIRLINES, **vocab.iata_names()})} AS out
FROM instruction""")
def n22(spark, sf):
    code = F.substring(F.lower(F.coalesce("callsign", F.lit("ba"))), 1, 3)
    return table(spark, sf, "instruction").select("instr_id", normalize.airline_name(code).alias("out"))


@query("N23_callsigns", r"""SELECT utt_id, array_to_string(list_sort(list_distinct(
  regexp_extract_all(upper(text), '\b([A-Z]{3}\d{1,4})\b', 1) || regexp_extract_all(upper(text), '\b([A-Z]{2}\d{1,4})\b', 1))), ',') AS out
FROM utterance""")
def n23(spark, sf):
    return table(spark, sf, "utterance").select(
        "utt_id", F.array_join(F.array_sort(normalize.extract_callsigns(F.col("text"))), ",").alias("out")
    )


HEARD = compact.HEARD
W2N = compact.WORD_TO_NUMBER


def sql_digits(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in W2N)
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w IN ({words})), "
        f"lambda w: {sql_case('w', W2N)}), '')"
    )


def sql_tag(tag: str, heard: str, lead: str):
    return lambda t: sql_each(
        t, rf"(?i){lead}\s+(?:(?:{heard})\s*)+",
        lambda x: f"CASE WHEN {sql_digits(x)} <> '' THEN '{tag}' || {sql_digits(x)} ELSE {x} END",
    )


def sql_compact_runway(t: str) -> str:
    last = "regexp_extract(trim({x}), '(\\S+)$', 1)"
    side = lambda x: (
        f"CASE WHEN {last.format(x=x)} IN ('left', 'l') THEN 'L' WHEN {last.format(x=x)} IN ('right', 'r') THEN 'R' "
        f"WHEN {last.format(x=x)} IN ('center', 'c') THEN 'C' ELSE '' END"
    )
    return sql_each(
        t, rf"(?i)runway\s+(?:(?:{HEARD})\s*)+(?:left|right|center|L|R|C)?\b",
        lambda x: f"CASE WHEN {sql_digits(x)} <> '' THEN 'RWY' || {sql_digits(x)} || {side(x)} ELSE {x} END",
    )


CODES = vocab.spoken_codes()
SPELLED_IN = ", ".join(f"'{w}'" for w in compact.SPELLED)


def sql_callsign_expr(t: str) -> str:
    """Longest run of spoken digits after an airline name of one to three words."""
    tries = []
    w = f"string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')"
    for k in (1, 2, 3):
        rest = f"list_slice({w}, {k + 1}, len({w}))"
        stop = f"coalesce(list_position(list_transform({rest}, lambda v: v IN ({SPELLED_IN})), false), 0)"
        n = f"(CASE WHEN {stop} > 0 THEN {stop} - 1 ELSE len({rest}) END)"
        code = sql_case(f"array_to_string(list_slice({w}, 1, {k}), ' ')", CODES)
        said = f"array_to_string(list_transform(list_slice({rest}, 1, {n}), lambda v: {sql_case('v', compact.SPELLED)}), '')"
        tries.append(
            f"CASE WHEN len({w}) > {k} AND {n} > 0 THEN {code} || {said} || ' ' || array_to_string(list_slice({rest}, {n} + 1, len({rest})), ' ') END"
        )
    return f"coalesce({', '.join(tries)}, {t})"


COMPACT_SQL = {
    "N24_level": (compact.compact_level, sql_tag("FL", HEARD, "flight\\s+level")),
    "N25_runway": (compact.compact_runway, sql_compact_runway),
    "N26_heading": (compact.compact_heading, sql_tag("HDG", compact.HEARD_HEADING, "heading")),
    "N27_callsign": (compact.compact_callsign, sql_callsign_expr),
}
for _name, (_fn, _sql) in COMPACT_SQL.items():
    _text_query(_name, lambda c, f=_fn: f(F.lower(c)), f"SELECT utt_id, {_sql('lower(text)')} AS out FROM utterance")


@query("N27_every_airline", f"""WITH {FILE_SQL}, said AS (SELECT utt_id, names[code] || ' ' || {sql_spoken('digits')} || ' climb' AS t FROM called)
SELECT utt_id, {sql_callsign_expr('t')} AS out FROM said""")
def n27_every(spark, sf):
    """Spoken names of all airlines, then three spoken digits, to codes."""
    said = _called(spark, sf)
    name = F.get(F.array(*map(F.lit, vocab.AIRLINES.values())), (F.abs("utt_id") % len(vocab.AIRLINES)).cast("int"))
    text = F.concat_ws(" ", name, normalize.spoken(F.col("digits")), F.lit("climb"))
    return said.select("utt_id", compact.compact_callsign(text).alias("out"))


def compact_ctes(source: str, key: str, col: str) -> str:
    return (
        f"c0 AS (SELECT {key}, lower({col}) AS t FROM {source}), "
        + ", ".join(
            f"c{i + 1} AS MATERIALIZED (SELECT {key}, {COMPACT_SQL[n][1]('t')} AS t FROM c{i})"
            for i, n in enumerate(("N24_level", "N25_runway", "N26_heading", "N27_callsign"))
        )
        + f", ct AS MATERIALIZED (SELECT {key}, {sql_squeeze('t')} AS t FROM c4)"
    )


@query("N28_compact", f"WITH {compact_ctes('utterance', 'utt_id', 'text')} SELECT utt_id, t AS out FROM ct")
def n28(spark, sf):
    return table(spark, sf, "utterance").select("utt_id", compact.compact(F.col("text")).alias("out"))


# ---- parsing ----------------------------------------------------------------------------------------

FULL_CTES = f"{norm_ctes('utterance', 'utt_id')}, {compact_ctes(LAST, 'utt_id', 't')}"


def sql_int(t: str, p: str, g: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract({t}, '{_q(p)}', {g}), '') AS int)"


def sql_str(t: str, p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({t}, '{_q(p)}', {g}), '')"


ITYPE = "CASE " + " ".join(f"WHEN contains(t, '{v}') THEN '{k}'" for v, k in parse.VERBS) + " ELSE 'unknown' END"
VERB = "CASE " + " ".join(f"WHEN contains(t, '{v}') THEN '{v.split()[0]}'" for v, _ in parse.VERBS) + " ELSE 'unknown' END"
ALT_P = r"(?i)FL(\d{2,3})|(?:to|at|maintain|level)\s+(\d{2,5})\s*(?:feet|ft)?|(\d{2,5})\s*(?:feet|ft)"


def _compact_rows(spark, sf):
    u = table(spark, sf, "utterance")
    return u.withColumn("asr", normalize.normalize(F.col("text"))).withColumn("t", compact.compact(F.col("asr")))


def _parse_query(name, cols, sql):
    @query(name, f"WITH {FULL_CTES}, l AS (SELECT utt_id, t, lower(t) AS low FROM ct) {sql}" if sql else None)
    def run(spark, sf):
        return _compact_rows(spark, sf).select("utt_id", *[c.alias(n) for n, c in cols(F.col("t")).items()])


_parse_query("P1_callsign", lambda t: {"callsign": parse.callsign(t)}, r"""
SELECT utt_id, upper(coalesce(nullif(regexp_extract(t, '(?i)^([A-Z]{2,3}\d{1,4}[A-Z]?)\b', 1), ''),
  nullif(regexp_extract(regexp_replace(t, '(?i)\b([A-Z]{3}\d{1,3})(\s*)(fl|hdg|rwy)', '#', 'g'), '(?i)\b([A-Z]{3}\d{1,3})\b', 1), ''))) AS callsign FROM ct""")
_parse_query("P2_verb", lambda t: {"itype": parse.instruction_type(t), "verb": parse.action_verb(t)},
             f"SELECT utt_id, {ITYPE} AS itype, {VERB} AS verb FROM (SELECT utt_id, low AS t FROM l)")
_parse_query("P3_altitude", lambda t: {"altitude": parse.altitude(t)},
             f"SELECT utt_id, coalesce({sql_int('t', ALT_P, 1)} * 100, {sql_int('t', ALT_P, 2)}, {sql_int('t', ALT_P, 3)}) AS altitude FROM ct")
HDG_SQL = f"coalesce({sql_int('t', r'(?i)(?:heading|turn)\s*(?:left|right)?\s*(\d{3})')}, {sql_int('t', r'(?i)HDG(\d{3})')})"
DIR_SQL = "CASE WHEN contains(lower(t), 'left') THEN 'left' WHEN contains(lower(t), 'right') THEN 'right' END"
RWY_SQL = f"upper(coalesce({sql_str('t', r'(?i)RWY(\d{2}[LR]?)')}, {sql_str('t', r'(?i)(?:runway|rwy)\s*(\d{2}[LR]?)')}))"
SPD_SQL = "coalesce(" + ", ".join(
    sql_int("t", p) for p in (r"(?i)speed\s+(\d{3})", r"(?i)(\d{3})\s*knots?", r"(?i)maintain\s+speed\s+(\d{3})",
                              r"(?i)reduce\s+speed\s+to\s+(\d{3})", r"(?i)increase\s+speed\s+to\s+(\d{3})")) + ")"
_parse_query("P4_heading", lambda t: {"heading": parse.heading(t), "direction": parse.direction(t)},
             f"SELECT utt_id, {HDG_SQL} AS heading, {DIR_SQL} AS direction FROM ct")
_parse_query("P5_runway", lambda t: {"runway": parse.runway(t)}, f"SELECT utt_id, {RWY_SQL} AS runway FROM ct")
_parse_query("P6_speed", lambda t: {"speed": parse.speed(t)}, f"SELECT utt_id, {SPD_SQL} AS speed FROM ct")

SPOKEN_IN = ", ".join(f"'{w}'" for w in parse.SPOKEN_DIGITS)


def sql_words(x: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(trim({x}), '\\s+'), "
        f"lambda w: rtrim(w, '.,')), lambda w: w IN ({SPOKEN_IN})), lambda w: {sql_case('w', parse.SPOKEN_DIGITS)}), '')"
    )


H = parse.HEARD
SPOKEN_CTE = f"""sp AS (SELECT utt_id, t,
  {sql_str('t', rf'flight\s+level\s+({H}(?:\s+{H}){{1,2}})')} AS w_fl,
  {sql_int('t', r'(\d+)\s*(?:thousand\s+)?feet')} * CASE WHEN contains(t, 'thousand') THEN 1000 ELSE 1 END AS feet,
  {sql_str('t', rf'(?:(?:descend|climb)\s+to|at|maintain|level)\s+({H}(?:\s+{H})+)')} AS w_alt,
  {sql_str('t', r'runway\s+(.+)')} AS w_rwy,
  {sql_str('t', rf'heading\s+({H}(?:\s+{H}){{2}})')} AS w_hdg,
  {sql_int('t', r'(\d+)\s*knots?')} AS knots,
  {sql_str('t', rf'({H}(?:\s+{H}){{1,2}})\s*knots?')} AS w_kn,
  {sql_str('t', rf'(?:speed|reduce speed to|increase speed to)\s+({H}(?:\s+{H}){{1,2}})')} AS w_spd FROM {LAST}),
sd AS (SELECT utt_id, CASE WHEN length({sql_words('w_fl')}) IN (2, 3) THEN CAST({sql_words('w_fl')} AS int) END AS fl, feet,
  CASE WHEN length({sql_words('w_alt')}) >= 3 THEN TRY_CAST({sql_words('w_alt')} AS int) END AS alt,
  nullif({sql_words('w_rwy')}, '') || CASE WHEN contains(w_rwy, 'left') THEN 'L' WHEN contains(w_rwy, 'right') THEN 'R' ELSE '' END AS rwy,
  CASE WHEN length({sql_words('w_hdg')}) = 3 THEN CAST({sql_words('w_hdg')} AS int) END AS hdg,
  coalesce(knots, TRY_CAST(nullif({sql_words('w_kn')}, '') AS int), TRY_CAST(nullif({sql_words('w_spd')}, '') AS int)) AS spd FROM sp),
sparams AS (SELECT utt_id, coalesce(fl * 100, feet, alt) AS target_altitude, fl AS flight_level, hdg AS heading, rwy AS runway, spd AS target_speed FROM sd)"""

NUMBERS = ("target_altitude", "flight_level", "heading", "runway", "target_speed")


@query("P7_spoken", f"WITH {norm_ctes('utterance', 'utt_id')}, {SPOKEN_CTE} SELECT utt_id, {', '.join(NUMBERS)} FROM sparams")
def p7(spark, sf):
    u = table(spark, sf, "utterance").select("utt_id", "text")
    said = once_per_value(u, "text", {"asr": normalize.normalize(F.col("text"))}).withColumn("p", parse.spoken_params(F.col("asr")))
    return join_nulls(u, cut(said.select("text", *[F.col("p")[n].alias(n) for n in NUMBERS])), ["text"]).drop("text")


@query("P8_digits", f"WITH {norm_ctes('utterance', 'utt_id')} SELECT utt_id, {sql_words('t')} AS digits FROM {LAST}")
def p8(spark, sf):
    u = table(spark, sf, "utterance").withColumn("asr", normalize.normalize(F.col("text")))
    return u.select("utt_id", parse.words_to_digits(F.col("asr")).alias("digits"))


INSTR_CTE = f"""l AS (SELECT utt_id, lower(t) AS t FROM ct), ty AS (SELECT utt_id, {ITYPE} AS itype, {VERB} AS verb FROM l),
sh AS (SELECT ct.utt_id, itype, verb,
  CASE WHEN itype IN ('climb', 'descent', 'maintain_altitude') THEN coalesce({sql_int('t', ALT_P, 1)} * 100, {sql_int('t', ALT_P, 2)}, {sql_int('t', ALT_P, 3)}) END AS target_altitude,
  CASE WHEN itype IN ('heading', 'turn_left', 'turn_right') THEN {HDG_SQL} END AS heading,
  CASE WHEN itype IN ('heading', 'turn_left', 'turn_right') THEN {DIR_SQL} END AS direction,
  {RWY_SQL} AS runway,
  CASE WHEN itype IN ('speed', 'reduce_speed', 'increase_speed') THEN {SPD_SQL} END AS target_speed
  FROM ct JOIN ty ON ct.utt_id = ty.utt_id),
fin AS (SELECT sh.utt_id, itype, verb, direction, coalesce(sh.target_altitude, sh.heading) IS NULL AND sh.direction IS NULL AND sh.runway IS NULL AND sh.target_speed IS NULL AS none,
  sh.target_altitude AS a, sh.heading AS h, sh.runway AS r, sh.target_speed AS s, p.* EXCLUDE (utt_id)
  FROM sh JOIN sparams p ON sh.utt_id = p.utt_id)"""
PICK = """CASE WHEN none THEN target_altitude ELSE a END AS target_altitude, CASE WHEN none THEN flight_level END AS flight_level,
  CASE WHEN none THEN heading ELSE h END AS heading, CASE WHEN none THEN runway ELSE r END AS runway,
  CASE WHEN none THEN target_speed ELSE s END AS target_speed"""


@query("P9_adapt", f"WITH {FULL_CTES}, {SPOKEN_CTE}, {INSTR_CTE} SELECT utt_id, itype, verb, direction, {PICK} FROM fin")
def p9(spark, sf):
    out = parse.to_instructions(table(spark, sf, "utterance"))
    return out.select("utt_id", "itype", "verb", *[F.col("params")[n].alias(n) for n in ("direction", *NUMBERS)])


BEST_SQL = f"""r AS (SELECT *, row_number() OVER (PARTITION BY utt_id, entity_group ORDER BY score DESC, ord) AS rn FROM ner_span),
b AS (SELECT utt_id, entity_group, word, score FROM r WHERE rn = 1 AND score >= 0.5),
bw AS (SELECT utt_id, max(word) FILTER (entity_group = 'callsign') AS cw, max(word) FILTER (entity_group = 'command') AS command_entity,
  max(word) FILTER (entity_group = 'value') AS value_entity, min(score) FILTER (score > 0) AS sc FROM b GROUP BY utt_id),
bu AS (SELECT DISTINCT utt_id FROM ner_span)"""


@query("P10_spans", f"""WITH {BEST_SQL},
{compact_ctes('bw', 'utt_id', 'cw')}
SELECT bu.utt_id, {sql_str('ct.t', r'\b([A-Z]{2,4}\d{1,4}[A-Z]?)\b')} AS callsign, command_entity, value_entity,
  coalesce(sc, 0.0) AS confidence,
  coalesce({sql_str('ct.t', r'\b([A-Z]{2,4}\d{1,4}[A-Z]?)\b')} IS NOT NULL AND (command_entity IS NOT NULL OR value_entity IS NOT NULL), false) AS success
FROM bu LEFT JOIN bw ON bu.utt_id = bw.utt_id LEFT JOIN ct ON bu.utt_id = ct.utt_id""")
def p10(spark, sf):
    return parse.best_spans(table(spark, sf, "ner_span")).select(
        "utt_id", "callsign", "command_entity", "value_entity", "confidence", "success"
    )


@query("P11_merge")
def p11(spark, sf):
    out = parse.merge_spans(table(spark, sf, "utterance"), table(spark, sf, "ner_span"))
    return out.select("utt_id", "callsign", "itype", "verb", *[F.col("params")[n].alias(n) for n, _ in parse.FIELDS])


def _grammar(name, fn, sql):
    @query(name, sql)
    def run(spark, sf):
        c = table(spark, sf, "console").select("utt_id", fn(F.col("text")).alias("p"))
        return c.select("utt_id", "p.callsign", "p.itype", "p.verb", *[F.col("p.params")[n].alias(n) for n, _ in parse.FIELDS])


def low(*texts: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{t}')" for t in texts) + ")"


CONSOLE_TYPES = [
    ("alt IS NOT NULL AND " + low("climb"), "climb", "climb"),
    ("alt IS NOT NULL AND " + low("descend", "descent"), "descent", "descend"),
    ("alt IS NOT NULL", "maintain_altitude", "maintain"),
    ("hdg IS NOT NULL AND " + low("turn left"), "turn_left", "turn_left"),
    ("hdg IS NOT NULL AND " + low("turn right"), "turn_right", "turn_right"),
    ("hdg IS NOT NULL", "heading", "heading"),
    ("spd IS NOT NULL AND " + low("reduce"), "reduce_speed", "reduce_speed"),
    ("spd IS NOT NULL AND " + low("increase"), "increase_speed", "increase_speed"),
    ("spd IS NOT NULL", "speed", "speed"),
    (low("cleared for takeoff"), "takeoff_clearance", "takeoff"),
    (low("land"), "landing_clearance", "land"),
    (low("taxi"), "taxi", "taxi"),
    (low("line up") + " AND " + low("wait"), "line_up_and_wait", "line_up_and_wait"),
    (low("line up"), "line_up", "line_up"),
    (low("hold short"), "hold_short", "hold_short"),
    (low("hold position"), "hold_position", "hold_position"),
    (low("go around", "go-around"), "go_around", "go_around"),
    (low("direct to"), "direct_to", "direct_to"),
    (low("squawk"), "squawk", "squawk"),
    (low("mayday"), "mayday", "mayday"),
    (low("pan pan"), "pan_pan", "pan_pan"),
    (low("emergency descent"), "emergency_descent", "emergency_descent"),
    (low("contact"), "contact", "contact"),
    (low("monitor"), "monitor", "monitor"),
]


def sql_pick(rules, i: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in rules) + " ELSE 'unknown' END"


_grammar("P12_console", parse.parse_console, f"""
WITH a AS (SELECT utt_id, trim(text) AS t, lower(trim(text)) AS low FROM console),
b AS (SELECT *, {sql_int('t', r'(?i)(?:climb|descend|descent)\s+(?:to\s+)?FL\s*(\d{3})')} AS a1,
  {sql_int('t', r'(?i)(?:climb|descend|descent)\s+(?:to\s+)?(\d{4,5})')} AS a2,
  {sql_int('t', r'(?i)(?:maintain|level)\s+(?:altitude\s+)?(\d{4,5})')} AS a3,
  {sql_int('t', r'(?i)(?:maintain|level)\s+FL\s*(\d{3})')} AS a4,
  {sql_int('t', r'(?i)(?:heading|turn\s+(?:left|right)?|fly\s+heading)\s+(\d{3})')} AS hdg,
  {sql_int('t', r'(?i)(?:speed|reduce\s+speed|increase\s+speed|maintain\s+speed)\s+(\d{3})')} AS spd FROM a),
c AS (SELECT *, coalesce(a1 * 100, a2, a3, a4 * 100) AS alt FROM b),
d AS (SELECT *, {sql_pick(CONSOLE_TYPES, 1)} AS itype, {sql_pick(CONSOLE_TYPES, 2)} AS verb FROM c)
SELECT utt_id, upper({sql_str('t', r'(?i)\b([A-Z]{2,4}\d{1,4})\b')}) AS callsign, itype, verb,
  alt AS target_altitude, CASE WHEN a1 IS NOT NULL THEN a1 WHEN a2 IS NULL AND a3 IS NULL THEN a4 END AS flight_level,
  CASE WHEN alt IS NULL THEN hdg END AS heading, CAST(NULL AS STRING) AS direction, CAST(NULL AS int) AS target_speed,
  CASE WHEN alt IS NULL AND hdg IS NULL THEN spd END AS speed_param,
  CASE WHEN alt IS NULL AND hdg IS NULL AND spd IS NULL THEN upper({sql_str('t', r'(?i)runway\s+(\d{2}[LR]?)')}) END AS runway,
  CASE WHEN itype = 'direct_to' THEN upper(list_extract(string_split(low, ' '), list_position(string_split(low, ' '), 'to') + 1)) END AS waypoint,
  CASE WHEN itype = 'squawk' THEN {sql_str('low', r'squawk\s+(\d{4})')} END AS squawk,
  CASE WHEN itype = 'contact' THEN {sql_str('t', r'(\d{3}\.\d{1,3})')} END AS frequency FROM d""")

MINIMAL_TYPES = [
    (low("descend", "descent"), "descent", "descend"),
    (low("climb"), "climb", "climb"),
    (low("turn"), "heading", "turn"),
    (low("heading"), "heading", "heading"),
    (low("cleared for takeoff"), "takeoff_clearance", "takeoff"),
    (low("cleared to land"), "landing_clearance", "land"),
]
NULLS = "CAST(NULL AS STRING) AS direction, CAST(NULL AS int) AS target_speed, CAST(NULL AS STRING) AS frequency"

_grammar("P13_minimal", parse.parse_minimal, f"""
WITH a AS (SELECT utt_id, lower(text) AS low FROM console),
d AS (SELECT *, {sql_pick(MINIMAL_TYPES, 1)} AS itype, {sql_pick(MINIMAL_TYPES, 2)} AS verb, {sql_int('low', r'fl\s*(\d+)')} AS fl FROM a)
SELECT utt_id, upper({sql_str('low', r'\b([a-z]{3}\d+)\b')}) AS callsign, itype, verb, {NULLS}, CAST(NULL AS int) AS speed_param,
  CASE WHEN itype IN ('descent', 'climb') THEN fl * 100 END AS target_altitude, CASE WHEN itype = 'descent' THEN fl END AS flight_level,
  CASE WHEN itype = 'heading' THEN {sql_int('low', r'(\d{3})')} END AS heading,
  CASE WHEN itype LIKE '%clearance' THEN {sql_str('low', r'runway\s+(\d+[lr]?)')} END AS runway,
  CAST(NULL AS STRING) AS waypoint, CAST(NULL AS STRING) AS squawk FROM d""")

BENCH_TYPES = [
    (low("descend", "descent"), "descent", "descend"),
    (low("climb"), "climb", "climb"),
    (low("maintain"), "maintain_altitude", "maintain"),
    (low("turn"), "heading", "turn"),
    (low("heading"), "heading", "heading"),
    (low("speed"), "speed", "speed"),
    (low("cleared for takeoff"), "takeoff_clearance", "takeoff"),
    (low("cleared to land"), "landing_clearance", "land"),
    (low("taxi"), "taxi", "taxi"),
    (low("hold short", "hold position"), "hold_short", "hold"),
    (low("contact"), "contact", "contact"),
    (low("squawk"), "squawk", "squawk"),
    (low("line up"), "line_up", "line_up"),
]

_grammar("P14_bench", parse.parse_bench, f"""
WITH a AS (SELECT utt_id, lower(text) AS low FROM console),
d AS (SELECT *, {sql_pick(BENCH_TYPES, 1)} AS itype, {sql_pick(BENCH_TYPES, 2)} AS verb, {sql_int('low', r'fl\s*(\d+)')} AS fl,
  {sql_int('low', r'(?:to|at)\s+(\d{4,6})\s*(?:feet|ft)?')} AS ft,
  {sql_int('low', r'maintain\s+(?:at\s+)?(?:fl\s*)?(\d{4,6})\s*(?:feet|ft)?')} AS held FROM a)
SELECT utt_id, upper({sql_str('low', r'\b([a-z]{3}\d+)\b')}) AS callsign, itype, verb, {NULLS},
  CASE WHEN itype IN ('descent', 'climb') THEN coalesce(fl * 100, ft) WHEN itype = 'maintain_altitude' THEN coalesce(fl * 100, CASE WHEN held < 1000 THEN held * 100 ELSE held END) END AS target_altitude,
  CASE WHEN itype = 'descent' THEN fl END AS flight_level,
  CASE WHEN itype = 'heading' THEN {sql_int('low', r'(?:heading|turn\s+(?:left|right)?)\s+(\d{3})')} END AS heading,
  CASE WHEN itype = 'speed' THEN {sql_int('low', r'speed\s+(?:to\s+)?(\d{3})')} END AS speed_param,
  CASE WHEN itype IN ('takeoff_clearance', 'landing_clearance', 'taxi', 'hold_short', 'line_up') THEN {sql_str('low', r'runway\s+(\d+[lr]?)')} END AS runway,
  CASE WHEN itype = 'taxi' THEN trim({sql_str('low', r'(?:to|via)\s+([\w\s]+)')}) END AS waypoint,
  CASE WHEN itype = 'squawk' THEN {sql_str('low', r'squawk\s+(\d{4})')} END AS squawk FROM d""")


@query("P15_derived", f"""WITH {FULL_CTES}, {SPOKEN_CTE}, {INSTR_CTE}, z AS (SELECT utt_id, itype, {PICK} FROM fin)
SELECT utt_id, coalesce(target_altitude, flight_level * 100) AS to_altitude, heading AS to_heading, target_speed AS to_speed,
  itype IN ('takeoff_clearance', 'landing_clearance', 'approach_clearance') AS is_clearance,
  itype IN ('descent', 'climb', 'maintain_altitude') AS is_altitude_change, utt_id % 3 = 0 OR utt_id % 5 = 0 AS needs_immediate,
  runway IS NOT NULL AS has_runway, coalesce(runway, 'none') AS runway FROM z""")
def p15(spark, sf):
    out = parse.to_instructions(table(spark, sf, "utterance"))
    d = parse.derived(
        F.col("itype"), F.col("params"),
        F.when(F.col("utt_id") % 3 == 0, "immediately"), F.when(F.col("utt_id") % 5 == 0, "urgent"),
    )
    return out.select(
        "utt_id", *[c.alias(n) for n, c in d.items()],
        parse.has_parameter(F.col("params"), "runway").alias("has_runway"),
        parse.get_parameter(F.col("params"), "runway", F.lit("none")).alias("runway"),
    )
