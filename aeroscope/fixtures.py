"""Input tables of the engine derived from the given Parquet tables.

Each derivation is one portable SQL text, run unchanged by Spark and by DuckDB.
`{name}` refers to a given table or to another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {}

FIXTURES["aircraft_snap"] = """
WITH e AS (
  SELECT CAST(floor(event_id / 50.0) AS bigint) AS snapshot_id, event_id AS ord,
         concat(CASE user_id % 4 WHEN 0 THEN 'AAL' WHEN 1 THEN 'UAL' WHEN 2 THEN 'DAL' ELSE 'JBU' END,
                CAST(100 + user_id AS STRING)) AS callsign,
         CAST(40 AS double) + (user_id % 15) * CAST(0.05 AS double) AS lat,
         CAST(-74 AS double) + (user_id % 11) * CAST(0.05 AS double) AS lon,
         CAST(1000 * (2 + floor(value / 10.0)) AS int) AS altitude,
         CAST((event_id * 37) % 360 AS int) AS heading,
         CAST(200 + (user_id % 20) * 10 AS int) AS speed, event_type,
         CASE user_id % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'H' WHEN 2 THEN 'S' ELSE 'M' END AS wake
  FROM {events}),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, callsign ORDER BY ord DESC) AS rn FROM e)
SELECT snapshot_id, ord, callsign, lat, lon, altitude, heading, speed, wake,
       CASE event_type WHEN 'error' THEN 'descent' WHEN 'view' THEN 'cruise' WHEN 'click' THEN 'climb'
            WHEN 'signup' THEN 'ground' ELSE 'approach' END AS flight_phase
FROM r WHERE rn = 1
"""

FIXTURES["snapshot"] = """
SELECT snapshot_id, concat('S', CAST(snapshot_id % 4 AS STRING)) AS sector_id,
       CASE WHEN snapshot_id % 17 = 0 THEN NULL WHEN snapshot_id % 19 = 0 THEN 0 ELSE 5000 END AS msa
FROM (SELECT DISTINCT CAST(floor(event_id / 50.0) AS bigint) AS snapshot_id FROM {events}) d
"""

FIXTURES["runway_snap"] = """
WITH k AS (SELECT 0 AS k, '09L' AS runway_id UNION ALL SELECT 1, '27R' UNION ALL SELECT 2, '04L'
           UNION ALL SELECT 3, '22R'),
first_ac AS (SELECT snapshot_id, min_by(callsign, ord) AS callsign FROM {aircraft_snap} GROUP BY snapshot_id)
SELECT f.snapshot_id, k.k AS ord, k.runway_id, (f.snapshot_id + k.k) % 3 = 0 AS occupied,
       CASE WHEN (f.snapshot_id + k.k) % 3 = 0 THEN f.callsign END AS occupied_by,
       CASE k.k WHEN 0 THEN 'takeoff' WHEN 1 THEN 'landing' ELSE 'mixed' END AS mode,
       CAST((f.snapshot_id + k.k) % 5 AS int) AS holding_n
FROM first_ac f CROSS JOIN k
"""

FIXTURES["instruction"] = """
WITH b AS (
  SELECT ord, snapshot_id, callsign AS own, altitude,
         CASE flight_phase WHEN 'descent' THEN 'descent' WHEN 'cruise' THEN 'climb' WHEN 'climb' THEN 'heading'
              WHEN 'ground' THEN 'takeoff_clearance' ELSE 'reduce_speed' END AS itype,
         CASE WHEN ord % 29 = 0 THEN NULL WHEN ord % 31 = 0 THEN 'ZZZ999' ELSE callsign END AS callsign
  FROM {aircraft_snap}),
v AS (
  SELECT *, CASE itype WHEN 'descent' THEN CAST(10 + ord % 200 AS int)
                       WHEN 'climb' THEN CAST(60 + ord % 300 AS int) END AS flight_level,
         CASE WHEN itype = 'heading' THEN CAST((ord * 7) % 360 AS int) END AS heading,
         CASE WHEN itype = 'reduce_speed' THEN CAST(180 + ord % 100 AS int) END AS target_speed,
         CASE WHEN itype = 'takeoff_clearance' THEN
              CASE ord % 4 WHEN 0 THEN '09L' WHEN 1 THEN '27R' WHEN 2 THEN '04L' ELSE '31C' END
              END AS runway
  FROM b)
SELECT ord AS instr_id, snapshot_id, ord AS seq, callsign, itype,
       flight_level * 100 AS target_altitude, flight_level, heading, target_speed, runway,
       CASE WHEN ord % 13 = 0 THEN 'PILOT' ELSE 'ATCO' END AS speaker,
       concat(coalesce(callsign || ' ', ''),
         CASE itype WHEN 'descent' THEN concat('descend to FL', lpad(CAST(flight_level AS STRING), 3, '0'))
              WHEN 'climb' THEN concat('climb to FL', lpad(CAST(flight_level AS STRING), 3, '0'))
              WHEN 'heading' THEN concat('turn left heading ', lpad(CAST(heading AS STRING), 3, '0'))
              WHEN 'takeoff_clearance' THEN concat('cleared for takeoff runway ', runway)
              ELSE concat('reduce speed to ', CAST(target_speed AS STRING), ' knots') END) AS raw_text
FROM v
"""

FIXTURES["rule"] = """
SELECT concat('RULE', CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS STRING), 3, '0')
                           ELSE CAST(s_suppkey AS STRING) END) AS rule_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'ALTITUDE' WHEN 1 THEN 'SEPARATION' ELSE 'RUNWAY' END AS condition_type,
       CASE s_suppkey % 3 WHEN 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 'MINIMUM' WHEN 1 THEN 'MAXIMUM'
                                           WHEN 2 THEN 'MSA_CHECK' ELSE 'BANK' END
                          WHEN 2 THEN CASE s_suppkey % 4 WHEN 0 THEN 'OCCUPIED' WHEN 1 THEN 'EXISTS'
                                           ELSE 'HOLDING_SHORT_FULL' END END AS check_type,
       CASE WHEN s_suppkey % 3 = 1 THEN CASE s_suppkey % 4 WHEN 0 THEN 'VERTICAL' WHEN 1 THEN 'HORIZONTAL'
                                             WHEN 2 THEN 'BOTH' END END AS separation_type,
       CASE WHEN s_suppkey % 7 <> 0 THEN CAST(1000 + (s_suppkey % 13) * 1000 AS int) END AS reference_value,
       CASE WHEN s_suppkey % 4 = 0 THEN CAST(1000 AS double) WHEN s_suppkey % 8 = 5 THEN CAST(2.5 AS double) ELSE CAST(5 AS double) END AS min_distance,
       CASE s_suppkey % 5 WHEN 0 THEN '09L' WHEN 1 THEN '27R' WHEN 2 THEN '04L' WHEN 3 THEN '13C' END AS runway_id,
       CAST(3 AS int) AS max_holding,
       s_suppkey AS ord
FROM {supplier}
"""

FIXTURES["rule_verdict"] = """
SELECT instr_id, concat('RULE', lpad(CAST(k.k AS STRING), 3, '0')) AS rule_id,
       (instr_id + k.k) % 3 = 0 AS violated,
       round(CAST((instr_id * 7 + k.k * 13) % 100 AS double) / CAST(100 AS double), 2) AS confidence,
       CASE (instr_id + k.k) % 6 WHEN 0 THEN 'HIGH' WHEN 3 THEN 'low' WHEN 1 THEN 'CRITICAL' END AS severity_override,
       (instr_id + k.k) % 4 = 0 AS relevant
FROM {instruction} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k
"""

FIXTURES["decision_log"] = """
SELECT s.sector_id, i.seq, i.instr_id, i.snapshot_id,
       CASE WHEN i.seq % 7 = 0 THEN 'rollback' WHEN i.seq % 11 = 0 THEN 'undo' WHEN i.seq % 13 = 0 THEN 'sync'
            WHEN i.seq % 3 = 0 THEN 'propose' ELSE 'commit' END AS kind,
       i.seq % 17 = 0 AS forced, CASE WHEN i.seq % 17 = 0 THEN 'operator' END AS reason,
       i.seq * 60 AS at_sec
FROM {instruction} i JOIN {snapshot} s ON i.snapshot_id = s.snapshot_id
"""


def sql_spoken(expr: str) -> str:
    """A digit string as words, in SQL."""
    words = "zero one two three four five six seven eight nine".split()
    for d, w in enumerate(words):
        expr = f"replace({expr}, '{d}', '{w} ')"
    return f"trim({expr})"


FIXTURES["utterance"] = f"""
WITH s AS (SELECT *, CASE substr(callsign, 1, 3) WHEN 'AAL' THEN 'american' WHEN 'UAL' THEN 'united airlines'
    WHEN 'DAL' THEN 'delta' WHEN 'JBU' THEN 'jetblue' ELSE 'zulu' END AS airline FROM {{instruction}})
SELECT instr_id * 10 AS utt_id, raw_text AS text FROM s
UNION ALL
SELECT instr_id * 10 + 1, concat(coalesce(airline || ' ' || {sql_spoken("substr(callsign, 4)")} || ' ', ''),
  CASE itype WHEN 'descent' THEN concat('descend to flight level ', {sql_spoken("lpad(CAST(flight_level AS STRING), 3, '0')")})
   WHEN 'climb' THEN concat('climb and maintain ', {sql_spoken("CAST(target_altitude AS STRING)")}, ' feet')
   WHEN 'heading' THEN concat('turn right heading ', {sql_spoken("lpad(CAST(heading AS STRING), 3, '0')")}, ' now')
   WHEN 'takeoff_clearance' THEN concat('cleared for takeoff runway ', {sql_spoken("substr(runway, 1, 2)")}, ' left')
   ELSE concat('reduce speed to ', {sql_spoken("CAST(target_speed AS STRING)")}, ' knots') END) FROM s
UNION ALL
SELECT instr_id * 10 + 2, concat(raw_text, CASE instr_id % 8 WHEN 0 THEN ', ILS16R vor115 app'
  WHEN 1 THEN ' contact tower 118.75 niner' WHEN 2 THEN '; SQUAWK 4521 wx ahead'
  WHEN 3 THEN ' Runway 16R FL90 AB12' WHEN 4 THEN '. thirty five ten one twenty'
  WHEN 5 THEN ' BORDO maintain 5000 ft' WHEN 6 THEN ' W1676 31236 nm HDG 090'
  ELSE ' BA12 KLM445 rwy 8-0-0' END) FROM s
UNION ALL
SELECT -(conv_id * 1000 + turn) - 1, text FROM {{conversations}}
"""

FIXTURES["console"] = """
SELECT instr_id AS utt_id, CASE instr_id % 25
  WHEN 0 THEN concat(raw_text, ' go around')
  WHEN 1 THEN concat(coalesce(callsign, 'X'), ' taxi via alpha bravo to runway 04L')
  WHEN 2 THEN concat(coalesce(callsign, 'X'), ' line up and wait runway 27R')
  WHEN 3 THEN concat(coalesce(callsign, 'X'), ' hold short runway 09')
  WHEN 4 THEN concat(coalesce(callsign, 'X'), ' proceed direct to bordo')
  WHEN 5 THEN concat(coalesce(callsign, 'X'), ' squawk 4521')
  WHEN 6 THEN concat('mayday mayday ', coalesce(callsign, 'X'))
  WHEN 7 THEN concat(coalesce(callsign, 'X'), ' pan pan')
  WHEN 8 THEN concat(coalesce(callsign, 'X'), ' contact ground 121.9')
  WHEN 9 THEN concat(coalesce(callsign, 'X'), ' monitor tower')
  WHEN 10 THEN concat(coalesce(callsign, 'X'), ' maintain altitude 8000')
  WHEN 11 THEN concat(coalesce(callsign, 'X'), ' climb to 12000 feet')
  WHEN 12 THEN concat(coalesce(callsign, 'X'), ' cleared to land runway 22R')
  WHEN 13 THEN concat(coalesce(callsign, 'X'), ' increase speed 290')
  WHEN 14 THEN concat(coalesce(callsign, 'X'), ' turn right 270')
  WHEN 15 THEN concat(coalesce(callsign, 'X'), ' line up runway 27R')
  WHEN 16 THEN concat(coalesce(callsign, 'X'), ' hold position')
  WHEN 17 THEN concat(coalesce(callsign, 'X'), ' emergency descent')
  WHEN 18 THEN concat(coalesce(callsign, 'X'), ' descend FL080')
  WHEN 19 THEN concat(coalesce(callsign, 'X'), ' level FL 110')
  ELSE raw_text END AS text FROM {instruction}
UNION ALL SELECT -(conv_id * 1000 + turn) - 1, text FROM {conversations}
"""

FIXTURES["ner_span"] = """
SELECT instr_id * 10 AS utt_id, instr_id * 10 + k.k AS ord,
  CASE k.k WHEN 0 THEN 'callsign' WHEN 1 THEN 'command' WHEN 2 THEN 'value' ELSE 'callsign' END AS entity_group,
  CASE WHEN k.k IN (0, 3) THEN lower(coalesce(callsign, 'american one two')) WHEN k.k = 1 THEN
       CASE itype WHEN 'descent' THEN 'descend' WHEN 'climb' THEN 'climb' WHEN 'heading' THEN 'turn left'
            WHEN 'takeoff_clearance' THEN 'cleared for' ELSE 'slow' END
       ELSE CASE itype WHEN 'descent' THEN 'flight level two four zero' WHEN 'climb' THEN 'flight level one zero zero'
            WHEN 'heading' THEN 'heading two seven zero' WHEN 'takeoff_clearance' THEN 'runway zero four left'
            ELSE 'two five zero knots' END END AS word,
  round(CAST((instr_id * (k.k + 3)) % 100 AS double) / CAST(100 AS double), 2) AS score
FROM {instruction} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
"""


FIXTURES["expected"] = """
SELECT CAST(floor(doc_id / 10.0) AS bigint) AS case_id, concat('RULE', lpad(CAST(doc_id % 10 AS STRING), 3, '0')) AS rule_id,
       quality = 1 AS exp_satisfied, CASE doc_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low'
       WHEN 3 THEN 'CRITICAL' END AS exp_severity
FROM {labels}
"""

FIXTURES["actual"] = """
SELECT CAST(floor(doc_id / 10.0) AS bigint) AS case_id, concat('RULE', lpad(CAST(doc_id % 10 AS STRING), 3, '0')) AS rule_id,
       k.strategy, CASE WHEN k.k = 0 THEN toxic = 0 ELSE (doc_id * 7) % 5 < 3 END AS act_satisfied,
       CASE (doc_id * (k.k + 2)) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS act_severity,
       CAST((doc_id * 13 + k.k) % 97 AS double) AS latency_ms
FROM {labels} CROSS JOIN (SELECT 0 AS k, 'compiled' AS strategy UNION ALL SELECT 1, 'generic') k
WHERE (doc_id + k.k) % 9 <> 0
"""

FIXTURES["generated"] = """
SELECT CAST(floor(doc_id / 12.0) AS bigint) AS case_id, concat('RULE', lpad(CAST(doc_id % 14 AS STRING), 3, '0')) AS rule_id,
       CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'critical' END AS severity, doc_id AS ord, doc_id % 2 AS src
FROM {documents}
"""

FIXTURES["latency"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'native' WHEN 'N' THEN 'compiled' ELSE 'generic' END AS component,
       concat('R', CAST(l_suppkey AS STRING)) AS rule_id, CAST(l_orderkey % 500 AS bigint) AS case_id,
       CAST(l_linenumber - 1 AS int) AS iteration,
       CASE WHEN l_partkey % 11 = 0 THEN CAST(0 AS double) ELSE l_quantity END AS ms
FROM {lineitem}
"""


def _num(prefix: str, expr: str) -> str:
    """Identifier with at least three digits."""
    return f"concat('{prefix}', CASE WHEN {expr} < 1000 THEN lpad(CAST({expr} AS STRING), 3, '0') ELSE CAST({expr} AS STRING) END)"


_RUNS = "(SELECT 0 AS k, 'gt' AS run UNION ALL SELECT 1, 'm1' UNION ALL SELECT 2, 'm2') k"

FIXTURES["entity"] = f"""
SELECT k.run, CAST(floor(p_partkey / 20.0) AS double) AS page, CAST(floor((p_partkey % 20) / 10.0) AS int) AS chunk,
  CAST(p_partkey % 10 AS int) AS idx, p_partkey AS seq,
  CASE WHEN k.k = 0 THEN {_num('E', '(p_partkey % 1000)')} WHEN p_partkey % 41 = 0 THEN '' WHEN p_partkey % 43 = 0 THEN 'X12'
       WHEN p_partkey % 47 = 0 THEN '77' WHEN p_partkey % 23 = 0 THEN {_num('E', '((p_partkey - 1) % 1000)')}
       ELSE {_num('E', '(p_partkey % 1000)')} END AS id,
  CASE WHEN k.k > 0 AND p_partkey % 59 = 0 THEN {_num('E', '(p_partkey % 1000)')}
       WHEN k.k > 0 AND p_partkey % 5 = 0 THEN concat(p_name, ' unit') WHEN k.k = 2 AND p_partkey % 7 = 0 THEN upper(p_name)
       ELSE p_name END AS text,
  CASE WHEN k.k = 2 AND p_partkey % 6 = 0 THEN 'Other' ELSE p_brand END AS label, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS subtype,
  CASE WHEN k.k > 0 AND p_partkey % 31 = 0 THEN '' WHEN k.k > 0 AND p_partkey % 37 = 0 THEN 'N/A' ELSE concat('the ', p_name) END AS context,
  CASE WHEN p_partkey % 29 = 0 THEN 'None' WHEN p_partkey % 4 = 0 THEN concat(p_name, ' means it') END AS formal_definition
FROM {{part}} CROSS JOIN {_RUNS} WHERE k.k = 0 OR p_partkey % (11 - k.k) <> 1
"""

FIXTURES["relationship"] = f"""
SELECT k.run, CAST(floor(o_orderkey / 20.0) AS double) AS page, CAST(floor((o_orderkey % 20) / 10.0) AS int) AS chunk,
  CAST(o_orderkey % 10 AS int) AS idx, o_orderkey AS seq,
  CASE WHEN k.k > 0 AND o_orderkey % 71 = 0 THEN '' WHEN k.k > 0 AND o_orderkey % 73 = 0 THEN 'Q1' ELSE {_num('R', '(o_orderkey % 1000)')} END AS id,
  CASE WHEN k.k > 0 AND o_orderkey % 61 = 0 THEN 'X9' ELSE {_num('E', '(o_orderkey % 1000)')} END AS subject_id,
  concat('item ', CAST(o_orderkey % 37 AS STRING), ' of ', o_orderstatus) AS subject_text,
  CASE WHEN k.k > 0 AND o_orderkey % 4 = 0 THEN 'requires' ELSE lower(o_orderpriority) END AS predicate,
  {_num('E', '((o_orderkey + 1) % 1000)')} AS object_id, concat('place ', CAST(o_custkey AS STRING)) AS object_text,
  CASE WHEN k.k = 2 AND o_orderkey % 5 = 0 THEN 'causal' ELSE 'spatial' END AS relation_type
FROM {{orders}} CROSS JOIN {_RUNS} WHERE k.k = 0 OR o_orderkey % (13 - k.k) <> 2
"""

FIXTURES["event"] = f"""
SELECT k.run, CAST(floor(c_custkey / 20.0) AS double) AS page, CAST(floor((c_custkey % 20) / 10.0) AS int) AS chunk,
  CAST(c_custkey % 10 AS int) AS idx, c_custkey AS seq,
  CASE WHEN k.k > 0 AND c_custkey % 39 = 0 THEN 'V2' ELSE {_num('EV', '(c_custkey % 1000)')} END AS id, lower(c_mktsegment) AS event_type,
  CASE WHEN k.k > 0 AND c_custkey % 3 = 0 THEN concat(c_name, ' departs') ELSE c_name END AS trigger_text,
  CASE WHEN k.k > 0 AND c_custkey % 27 = 0 THEN 'E001,Z9' WHEN c_custkey % 4 = 0 THEN '' ELSE {_num('E', '(c_custkey % 1000)')} END AS actors_csv,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat({_num('E', '(c_custkey % 1000)')}, ',', {_num('E', '((c_custkey + 3) % 1000)')}) END AS targets_csv,
  CASE c_custkey % 3 WHEN 0 THEN 'climb' WHEN 1 THEN 'cruise' ELSE 'taxi' END AS phase,
  CASE WHEN c_custkey % 5 = 0 THEN 'before departure' END AS temporal_context
FROM {{customer}} CROSS JOIN {_RUNS} WHERE k.k = 0 OR c_custkey % (9 - k.k) <> 3
"""

FIXTURES["krule"] = f"""
SELECT k.run, CAST(floor(s_suppkey / 5.0) AS double) AS page, 0 AS chunk, CAST(s_suppkey % 5 AS int) AS idx, s_suppkey AS seq,
  {_num('RULE', '(s_suppkey % 1000)')} AS id,
  CASE s_suppkey % 3 WHEN 0 THEN 'prohibition' WHEN 1 THEN 'obligation' ELSE 'permission' END AS rule_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'shall_not' WHEN 1 THEN 'must' WHEN 2 THEN 'should' END AS modality,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'strong' END AS deontic_strength,
  CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'critical' END AS severity, s_suppkey % 2 = 0 AS safety_critical,
  CASE s_suppkey % 13 WHEN 0 THEN 'Aircraft below 5000 feet near E001' WHEN 1 THEN 'When conflict is predicted' WHEN 2 THEN 'Runway occupied on runway 09L'
    WHEN 3 THEN 'Aircraft above FL240' WHEN 4 THEN 'Lateral distance under 5 NM' WHEN 5 THEN 'Visibility is poor'
    WHEN 6 THEN 'Crew on duty' WHEN 7 THEN 'Speed over 250 knots' WHEN 8 THEN 'Turn right near E002' WHEN 9 THEN 'Taxi clearance at holding point'
    WHEN 10 THEN 'Two aircraft within 1000 feet vertical' WHEN 11 THEN '' ELSE 'See RULE001 and (E003)' END AS trigger_text,
  CASE s_suppkey % 5 WHEN 0 THEN 'Keep clear of E004' WHEN 1 THEN 'Stop at R005' WHEN 2 THEN 'Wait' ELSE 'Report E999' END AS constraint_text,
  CASE s_suppkey % 4 WHEN 0 THEN 'occupied(E001)' WHEN 1 THEN 'state is open' WHEN 2 THEN 'less than minimum' ELSE 'moving' END AS if_cond,
  CASE s_suppkey % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'advise the station' ELSE 'give way' END AS then_act,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'keeps order' END AS explainability,
  concat({_num('E', '(s_suppkey % 1000)')}, CASE WHEN k.k > 0 AND s_suppkey % 8 = 0 THEN ',K1' ELSE '' END) AS trigger_entities_csv,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE {_num('E', '((s_suppkey * 3) % 1000)')} END AS action_entities_csv,
  concat({_num('E', '(s_suppkey % 1000)')}, ',', {_num('E', '((s_suppkey * 3) % 1000)')}, ',E99999') AS linked_entities_csv,
  concat({_num('R', '(s_suppkey % 1000)')}, ',', {_num('RULE', '(s_suppkey % 1000)')}) AS linked_relationships_csv
FROM {{supplier}} CROSS JOIN {_RUNS} WHERE k.k = 0 OR s_suppkey % (8 - k.k) <> 4
"""

FIXTURES["procedure"] = f"""
SELECT k.run, CAST(floor(s_suppkey / 5.0) AS double) AS page, 0 AS chunk, CAST(s_suppkey % 5 AS int) AS idx, s_suppkey AS seq,
  CASE WHEN k.k > 0 AND s_suppkey % 6 = 0 THEN 'RULE001' ELSE {_num('P', '(s_suppkey % 1000)')} END AS id,
  CASE WHEN k.k > 0 AND s_suppkey % 4 = 0 THEN concat(s_name, ' v2') ELSE s_name END AS name,
  concat('serves nation ', CAST(s_nationkey AS STRING)) AS purpose, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'arrival' END AS context,
  CASE WHEN k.k > 0 AND s_suppkey % 5 = 0 THEN 'R001' ELSE {_num('RULE', '(s_suppkey % 1000)')} END AS linked_rules_csv
FROM {{supplier}} CROSS JOIN {_RUNS} WHERE k.k = 0 OR s_suppkey % (7 - k.k) <> 1
"""

FIXTURES["truth"] = """
SELECT CAST(instr_id AS bigint) AS sample_id, raw_text AS text FROM {instruction}
UNION ALL SELECT -(conv_id * 1000 + turn) - 1, text FROM {conversations}
"""

FIXTURES["transcript"] = """
SELECT k.model, t.sample_id, CASE k.k WHEN 0 THEN text WHEN 1 THEN replace(replace(text, ' to ', ' '), ' de ', ' ')
       WHEN 2 THEN replace(replace(text, 'an', 'on'), 'turn left', 'turn the left') ELSE CASE WHEN sample_id % 7 = 0 THEN '' ELSE text END END AS text
FROM {truth} t CROSS JOIN (SELECT 0 AS k, 'm0' AS model UNION ALL SELECT 1, 'm1' UNION ALL SELECT 2, 'm2' UNION ALL SELECT 3, 'm3') k
WHERE sample_id % 9 <> 4 AND (k.k < 3 OR sample_id % 8 <> 3)
"""

FIXTURES["asr_score"] = """
SELECT CASE l_linestatus WHEN 'F' THEN 'tower' ELSE 'ground' END AS dataset, concat('m', CAST(l_linenumber % 4 AS STRING)) AS model,
  l_orderkey * 10 + l_linenumber AS sample_id, CAST(l_quantity AS int) AS num_ref_words, CAST(l_quantity AS int) + CAST(l_partkey % 3 AS int) AS num_hyp_words,
  CAST(l_partkey % 4 AS int) AS substitutions, CAST(l_suppkey % 3 AS int) AS deletions, CAST(l_partkey % 3 AS int) AS insertions,
  CAST(l_quantity AS int) AS hits,
  CAST(l_partkey % 4 + l_suppkey % 3 + l_partkey % 3 AS double) / l_quantity AS wer,
  CAST(l_partkey % 4 + l_suppkey % 3 + l_partkey % 3 AS double) / (l_quantity + 9) AS mer, l_tax AS wil, 1 - l_tax AS wip
FROM {lineitem}
"""

FIXTURES["pair_verdict"] = """
SELECT a.run, 'entity' AS kind, a.seq AS i, b.seq AS j, CAST(50 + (a.seq * 7 + b.seq * 3) % 50 AS double) / CAST(100 AS double) AS score,
  (a.seq * 7 + b.seq * 3) % 50 >= 25 AS is_duplicate
FROM {entity} a JOIN {entity} b ON a.run = b.run AND a.page = b.page AND a.seq < b.seq AND (a.seq + b.seq) % 11 = 0
"""

FIXTURES["semantic_verdict"] = """
SELECT k.model, CAST(floor(doc_id / 8.0) AS double) AS page, CAST(doc_id % 4 AS int) AS chunk, k.kind,
  CASE WHEN (doc_id + k.k) % 6 <> 0 THEN CAST((doc_id * 3 + k.k) % 100 AS double) / CAST(100 AS double) END AS score, (doc_id + k.k) % 17 = 0 AS both_empty
FROM {documents} CROSS JOIN (SELECT 0 AS k, 'm1' AS model, 'entity' AS kind UNION ALL SELECT 1, 'm1', 'event' UNION ALL SELECT 2, 'm2', 'entity' UNION ALL SELECT 3, 'm2', 'krule') k
"""

RECORD_TYPES = ("entity", "relationship", "event", "krule", "procedure")


def records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five record tables with id lists as arrays."""
    out = {}
    for name in RECORD_TYPES:
        df = table(spark, sf_dir, name)
        for c in [c for c in df.columns if c.endswith("_csv")]:
            parts = F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
            df = df.withColumn(c[:-4], parts).drop(c)
        out[name] = df
    return out


def _deps(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a table derived from them."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name]
    parts = {d: table(spark, sf_dir, d) for d in _deps(sql)}
    return spark.sql(sql, **parts)


def runways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runway_snap with the holding queue as an array."""
    df = table(spark, sf_dir, "runway_snap")
    names = F.transform(F.sequence(F.lit(1), F.col("holding_n")), lambda i: F.concat(F.lit("HLD"), i.cast("string")))
    return df.withColumn(
        "holding_short", F.when(F.col("holding_n") > 0, names).otherwise(F.array().cast("array<string>"))
    )


def with_fixtures(body: str) -> str:
    """Prefix a DuckDB query with the derived tables it names."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in _deps(FIXTURES[name]):
            if d in FIXTURES:
                visit(d)
        order.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    if not order:
        return body.strip()
    ctes = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', FIXTURES[n]).strip()})" for n in order]
    body = body.strip()
    head = "WITH "
    if body.upper().startswith("WITH RECURSIVE"):
        head, body = "WITH RECURSIVE ", ", " + body[len("WITH RECURSIVE"):]
    elif body.upper().startswith("WITH"):
        body = ", " + body[len("WITH"):]
    return head + ",\n".join(ctes) + "\n" + body


def chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """True chunks (lines of the documents) and the chunks of two models that shift and merge them."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(
        "doc_id", F.filter(F.transform(F.split("text", "\n"), lambda t: F.trim(t)), lambda s: s != "").alias("l")
    ).where(F.size("l") > 0)
    truth = lines.select(F.col("doc_id").cast("double").alias("page"), F.posexplode("l").alias("chunk", "text"))
    cut_head = F.when(F.col("chunk") == 0, F.expr("substring(text, 1 + int(page) % 4)")).otherwise(F.col("text"))
    m1 = truth.select(F.lit("m1").alias("model"), "page", "chunk", cut_head.alias("text"))
    group = F.col("chunk") - F.when((F.col("chunk") % 6 == 5), 1).otherwise(0)
    m2 = (
        truth.withColumn("g", group).groupBy("page", "g")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("x"))
        .select(F.lit("m2").alias("model"), "page", F.col("g").alias("chunk"), F.array_join("x.text", " ").alias("text"))
    )
    return truth, m1.unionByName(m2)
