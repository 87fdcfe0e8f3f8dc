"""Extraction, knowledge-rule and prefilter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroscope.catalog import query
from aeroscope.fixtures import RECORD_TYPES, records, table
from aeroscope.operators import extraction as ex
from aeroscope.operators import knowledge as kn
from aeroscope.operators import prefilter as pf

# ---- K: rules ---------------------------------------------------------------------------------------

TEXT = "lower(concat(coalesce(trigger_text, ''), ' ', coalesce(if_cond, ''), ' ', coalesce(then_act, '')))"
TRIG = "lower(concat(coalesce(trigger_text, ''), ' ', coalesce(if_cond, '')))"


def _or(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


CATEGORY = "CASE " + " ".join(
    [f"WHEN {_or('t', w)} THEN '{c}'" for _, c, w, _ in kn.PATTERNS] + [f"WHEN {_or('t', w)} THEN '{c}'" for c, w in kn.CATEGORY_WORDS]
) + " ELSE 'GENERIC' END"
FIELDS = "CASE " + " ".join(f"WHEN {_or('g', w)} THEN '{','.join(f)}'" for _, _, w, f in kn.PATTERNS) + " ELSE concat_ws(',', " + ", ".join(
    f"CASE WHEN {_or('g', w)} THEN '{','.join(f)}' END" for w, f in kn.FIELD_WORDS) + ") END"
BASE = f"b AS (SELECT *, {TEXT} AS t, {TRIG} AS g, concat_ws(' ', coalesce(trigger_text, ''), coalesce(if_cond, ''), coalesce(then_act, '')) AS raw FROM krule)"


def _re(p: str) -> str:
    return f"nullif(regexp_extract(raw, '{p}', 1), '')"


NUMS = f"""coalesce(CAST({_re(r'(?i)FL\s*(\d+)')} AS int) * 100, CAST({_re(r'(?i)(\d+)\s*(?:feet|ft)')} AS int)) AS altitude,
  CAST({_re(r'(?i)(\d+(?:\.\d+)?)\s*NM')} AS double) AS min_horizontal, CAST({_re(r'(?i)(\d+)\s*feet\s+(?:vertical|separation)')} AS int) AS min_vertical,
  upper({_re(r'(?i)(?:runway|rwy)\s*(\d{2}[LR]?)')}) AS runway_id"""


def _rules(spark, sf) -> DataFrame:
    return records(spark, sf)["krule"]


@query("K1_category", f"WITH {BASE} SELECT run, page, idx, {CATEGORY} AS category FROM b")
def k1(spark, sf):
    return _rules(spark, sf).select("run", "page", "idx", kn.category(kn.rule_text()).alias("category"))


@query("K2_fields", f"WITH {BASE} SELECT run, page, idx, {FIELDS} AS fields FROM b")
def k2(spark, sf):
    text = F.lower(F.concat(F.coalesce("trigger_text", F.lit("")), F.lit(" "), F.coalesce("if_cond", F.lit(""))))
    return _rules(spark, sf).select("run", "page", "idx", F.array_join(kn.required_fields(text), ",").alias("fields"))


@query("K3_numbers", f"WITH {BASE} SELECT run, page, idx, {NUMS} FROM b")
def k3(spark, sf):
    text = F.concat_ws(" ", "trigger_text", "if_cond", "then_act")
    return _rules(spark, sf).select("run", "page", "idx", *[c.alias(n) for n, c in kn.numbers(text).items()])


K4_SQL = f"""{BASE}, c AS (SELECT *, {CATEGORY} AS category, {NUMS}, {_or('g', ('above', 'greater than', '>'))} AS above FROM b),
d AS (SELECT *, category IN ('ALTITUDE','SEPARATION','RUNWAY') AS known FROM c),
e AS (SELECT *, CASE WHEN category = 'ALTITUDE' THEN CASE WHEN altitude IS NULL THEN 'MSA_CHECK' WHEN above THEN 'MAXIMUM' ELSE 'MINIMUM' END
  WHEN category = 'RUNWAY' AND runway_id IS NOT NULL THEN 'OCCUPIED' END AS check_type FROM d)"""


@query("K4_executable", f"""WITH {K4_SQL}
SELECT run, id AS rule_id, category, CASE WHEN known THEN category END AS condition_type, check_type,
  CASE WHEN category = 'SEPARATION' THEN CASE WHEN min_vertical IS NOT NULL THEN 'VERTICAL' WHEN min_horizontal IS NOT NULL THEN 'HORIZONTAL' ELSE 'BOTH' END END AS separation_type,
  CASE WHEN check_type IN ('MINIMUM', 'MAXIMUM') THEN altitude END AS reference_value,
  CASE WHEN category = 'SEPARATION' THEN coalesce(min_vertical::double, min_horizontal, 5.0) END AS min_distance,
  CASE WHEN known THEN runway_id END AS runway_id,
  CASE WHEN known THEN if_cond || ' -> ' || then_act WHEN category = 'GENERIC' THEN 'Trigger: ' || trigger_text || '. Condition: ' || if_cond || '. Action required: ' || then_act END AS description,
  CASE WHEN category = 'GENERIC' THEN {FIELDS} END AS required_fields, CASE WHEN category = 'UNEVALUABLE' THEN '{kn.REASON}' END AS reason FROM e""")
def k4(spark, sf):
    return kn.to_rules(_rules(spark, sf)).select(
        "run", "rule_id", "category", "condition_type", "check_type", "separation_type", "reference_value", "min_distance",
        "runway_id", "description", "required_fields", "reason",
    )


@query("K5_older", f"""WITH {BASE}, c AS (SELECT *, {NUMS}, lower(concat(coalesce(trigger_text, ''), coalesce(if_cond, ''))) AS h FROM b),
d AS (SELECT *, CASE WHEN {_or('h', ("altitude", "msa", "flight level", "fl"))} AND {_or('h', ("below", "less than", "<"))} THEN 'ALTITUDE_MINIMUM'
  WHEN {_or('h', ("altitude", "msa", "flight level", "fl"))} AND {_or('h', ("above", "greater than", ">"))} THEN 'ALTITUDE_MAXIMUM'
  WHEN {_or('h', ("separation", "distance", "conflict", "loss"))} THEN 'SEPARATION_VERTICAL'
  WHEN {_or('h', ("runway", "rwy", "occupied", "closed"))} THEN CASE WHEN {_or('h', ("occupied", "closed"))} THEN 'RUNWAY_CLOSED' ELSE 'RUNWAY_AVAILABLE' END END AS kind FROM c)
SELECT run, id AS rule_id, kind, CASE WHEN kind LIKE 'ALTITUDE%' THEN coalesce(altitude, 5000) END AS altitude_value,
  CASE WHEN kind LIKE 'SEP%' THEN coalesce(min_vertical, 1000) END AS min_vertical, CASE WHEN kind LIKE 'SEP%' THEN coalesce(min_horizontal, 5.0) END AS min_horizontal,
  CASE WHEN kind LIKE 'RUNWAY%' THEN runway_id END AS runway_id FROM d""")
def k5(spark, sf):
    return kn.older_condition(_rules(spark, sf))


@query("K6_find", """SELECT r.run, r.idx AS from_idx, r.page, e.text FROM relationship r
JOIN (SELECT run, id, max_by(text, page * 100 + chunk * 10 + idx) AS text FROM entity GROUP BY 1, 2) e ON r.run = e.run AND r.subject_id = e.id""")
def k6(spark, sf):
    rec = records(spark, sf)
    wanted = rec["relationship"].select("run", F.col("idx").alias("from_idx"), "page", F.col("subject_id").alias("id"))
    return kn.find_by_id(wanted, kn.collect_latest(rec["entity"]).select("run", "id", "text")).select("run", "from_idx", "page", "text")


@query("K7_collect", """SELECT run, id, page, chunk, idx, text FROM (SELECT *, row_number() OVER (PARTITION BY run, id ORDER BY page DESC, chunk DESC, idx DESC) AS rn FROM entity) WHERE rn = 1""")
def k7(spark, sf):
    return kn.collect_latest(records(spark, sf)["entity"]).select("run", "id", "page", "chunk", "idx", "text")


@query("K7_counts", " UNION ALL ".join(f"SELECT '{k}' AS kind, run, count(*) AS n, count(DISTINCT id) AS n_ids FROM {k} GROUP BY run" for k in RECORD_TYPES))
def k7_counts(spark, sf):
    return kn.type_counts(records(spark, sf))


LATEST_E = "le AS (SELECT run, id, max_by(text, page * 100 + chunk * 10 + idx) AS said FROM entity GROUP BY 1, 2)"
LATEST_R = "lr AS (SELECT run, id, max_by(concat(subject_text, ' ', predicate, ' ', object_text), page * 100 + chunk * 10 + idx) AS said FROM relationship GROUP BY 1, 2)"


@query("K8_resolve_arrays", f"""WITH {LATEST_E}, x AS (SELECT run, page, chunk, idx, id, unnest(string_split(linked_entities_csv, ',')) AS ref, generate_subscripts(string_split(linked_entities_csv, ','), 1) AS pos FROM krule)
SELECT x.run, page, chunk, idx, x.id, string_agg(coalesce(said, ref), '|' ORDER BY pos) AS resolved FROM x LEFT JOIN le ON x.run = le.run AND x.ref = le.id GROUP BY 1, 2, 3, 4, 5""")
def k8(spark, sf):
    rec = records(spark, sf)
    out = kn.resolve_ids(rec["krule"], "linked_entities", rec["entity"], F.col("text"))
    return out.select(*kn.RECORD, "id", F.array_join("resolved", "|").alias("resolved"))


@query("K8_resolve_relationships", f"""WITH {LATEST_R}, x AS (SELECT run, page, chunk, idx, id, unnest(string_split(linked_relationships_csv, ',')) AS ref, generate_subscripts(string_split(linked_relationships_csv, ','), 1) AS pos FROM krule)
SELECT x.run, page, chunk, idx, x.id, string_agg(coalesce(said, ref), '|' ORDER BY pos) AS resolved FROM x LEFT JOIN lr ON x.run = lr.run AND x.ref = lr.id GROUP BY 1, 2, 3, 4, 5""")
def k8_rel(spark, sf):
    rec = records(spark, sf)
    out = kn.resolve_ids(rec["krule"], "linked_relationships", rec["relationship"], kn.relation_text())
    return out.select(*kn.RECORD, "id", F.array_join("resolved", "|").alias("resolved"))


RESOLVE_SQL = f"""{LATEST_E}, {LATEST_R}, al AS (SELECT * FROM le UNION ALL SELECT * FROM lr),
tk AS (SELECT run, page, chunk, idx, id, generate_subscripts(p, 1) AS pos, unnest(p) AS tok FROM (SELECT run, page, chunk, idx, id, string_split(regexp_replace(src, '(\\b[ER]\\d{{3}}\\b)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM src0)),
rs AS (SELECT tk.run, page, chunk, idx, tk.id, string_agg(CASE WHEN pos % 2 = 0 THEN coalesce('"' || said || '"', tok) ELSE tok END, '' ORDER BY pos) AS resolved_text
  FROM tk LEFT JOIN al ON tk.run = al.run AND tk.tok = al.id GROUP BY 1, 2, 3, 4, 5)"""


@query("K9_resolve_text", f"""WITH src0 AS (SELECT run, page, chunk, idx, id, trigger_text || ' / ' || constraint_text AS src FROM krule), {RESOLVE_SQL}
SELECT rs.run, rs.page, rs.chunk, rs.idx, rs.id, resolved_text, regexp_matches(src, '\\w[ER]\\d{{3}}|[ER]\\d{{3}}\\w') AS inside_word FROM rs JOIN src0 ON rs.run = src0.run AND rs.page = src0.page AND rs.chunk = src0.chunk AND rs.idx = src0.idx""")
def k9(spark, sf):
    rec = records(spark, sf)
    src = rec["krule"].select(*kn.RECORD, "id", F.concat_ws(" / ", "trigger_text", "constraint_text").alias("src"))
    return kn.resolve_text(src, "src", rec["entity"], rec["relationship"]).select(*kn.RECORD, "id", "resolved_text", "inside_word")


@query("K10_complete", f"""WITH src0 AS (SELECT run, page, chunk, idx, id, concat_ws(' ', trigger_text, constraint_text, if_cond, then_act, explainability) AS src FROM krule
 WHERE modality IS NOT NULL AND deontic_strength IS NOT NULL AND explainability IS NOT NULL), {RESOLVE_SQL}
SELECT run, id FROM rs WHERE NOT regexp_matches(resolved_text, '\\b[ER]\\d{{3}}\\b')""")
def k10(spark, sf):
    rec = records(spark, sf)
    return kn.complete_rules(rec["krule"], rec["entity"], rec["relationship"]).select("run", "id")


@query("K11_missing", """SELECT DISTINCT run, id, page FROM (SELECT run, page, unnest(string_split(linked_rules_csv, ',')) AS id FROM procedure) x
WHERE NOT EXISTS (SELECT 1 FROM krule k WHERE k.run = x.run AND k.id = x.id)""")
def k11(spark, sf):
    rec = records(spark, sf)
    refs = rec["procedure"].select("run", "page", F.explode("linked_rules").alias("id")).distinct()
    return kn.missing_references(refs, rec["krule"]).select("run", "id", "page")


@query("K12_fold", """SELECT run, id, CASE WHEN rule_type = 'prohibition' THEN 'prohibition' ELSE 'obligation' END AS rule_type,
 CASE WHEN modality = 'shall_not' THEN 'shall_not' ELSE 'must' END AS modality, 'strong' AS deontic_strength, CASE WHEN severity = 'high' THEN 'high' ELSE 'medium' END AS severity FROM krule""")
def k12(spark, sf):
    return kn.fold_enums(_rules(spark, sf))


def _compiled(spark, sf):
    return table(spark, sf, "rule").where("ord % 4 = 0").select("rule_id")


@query("K13_generic", "SELECT rule_id, condition_type FROM rule WHERE ord % 4 <> 0")
def k13(spark, sf):
    return kn.generic_rules(table(spark, sf, "rule"), _compiled(spark, sf)).select("rule_id", "condition_type")


@query("K13_counts", "SELECT count(*) AS total, count(*) FILTER (ord % 4 <> 0) AS generic, count(*) FILTER (ord % 4 = 0) AS skipped FROM rule")
def k13_counts(spark, sf):
    return kn.load_counts(table(spark, sf, "rule"), _compiled(spark, sf))


@query("K14_status", """SELECT rule_id, CASE WHEN ord % 9 = 0 THEN 'failed' WHEN ord % 4 = 0 THEN 'not_compilable' WHEN ord % 7 <> 0 THEN 'compiled' ELSE 'failed' END AS status FROM rule""")
def k14(spark, sf):
    r = table(spark, sf, "rule")
    verdicts = r.where("ord % 9 <> 0").select("rule_id", (F.col("ord") % 4 != 0).alias("compilable"), (F.col("ord") % 7 != 0).alias("valid"))
    return kn.status_rows(r, verdicts).select("rule_id", "status")


# ---- F: prefilter -----------------------------------------------------------------------------------

TOPIC_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_or('low', pf.TOPICS[n])} THEN '{n}' END" for n in sorted(pf.TOPICS)) + "], lambda x: x IS NOT NULL)"
TAGGED = f"tg AS (SELECT *, array_to_string({TOPIC_LIST}, ',') AS topic_set FROM (SELECT *, lower(coalesce(raw_text, '')) AS low FROM instruction))"
RULE_TXT = f"""rt AS (SELECT *, {TOPIC_LIST} AS tl FROM (SELECT id AS rule_id, seq AS rule_seq, lower(concat_ws(' ', nullif(trigger_text, ''), nullif(constraint_text, ''), if_cond)) AS low FROM krule WHERE run = 'gt'))"""
CAND = """st AS (SELECT DISTINCT topic_set FROM tg), cd0 AS (SELECT topic_set, rule_id, rule_seq FROM st JOIN rt ON topic_set <> '' AND (list_has_any(string_split(topic_set, ','), tl) OR trim(low) = '')),
cd AS (SELECT * FROM cd0 UNION ALL SELECT topic_set, rule_id, rule_seq FROM st JOIN rt ON topic_set NOT IN (SELECT topic_set FROM cd0))"""
VECS = """iv AS (SELECT tg.instr_id, topic_set, embedding AS vec FROM tg JOIN embeddings ON vec_id = instr_id % (SELECT count(*) FROM embeddings)),
rv AS (SELECT rule_id, rule_seq, embedding AS vec FROM rt LEFT JOIN embeddings ON vec_id = rule_seq * 3 AND rule_seq % 10 <> 0)"""
RANKED = f"""WITH {TAGGED}, {RULE_TXT}, {CAND}, {VECS},
sc AS (SELECT iv.instr_id, cd.rule_id, cd.rule_seq, coalesce(list_dot_product(iv.vec::double[], rv.vec::double[]) / (sqrt(list_dot_product(iv.vec::double[], iv.vec::double[])) * sqrt(list_dot_product(rv.vec::double[], rv.vec::double[])) + 1e-8), -1.0) AS score
  FROM iv JOIN cd ON iv.topic_set = cd.topic_set JOIN rv ON cd.rule_id = rv.rule_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY instr_id ORDER BY score DESC, rule_seq) AS rank FROM sc QUALIFY rank <= 5)"""


def _generic(spark, sf, run="gt"):
    """Rules of one run, or of all."""
    k = _rules(spark, sf)
    k = k if run is None else k.where(F.col("run") == run)
    return k.select(
        "run",
        F.col("id").alias("rule_id"), F.col("trigger_text").alias("raw_trigger"), F.col("constraint_text").alias("raw_constraint"),
        F.col("if_cond").alias("description"), F.lit("").alias("category"), F.col("seq").alias("ord"),
    )


def _vectors(spark, sf):
    """Instructions with the id of their vector, rule vectors, and the embeddings table that both are taken from."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    i = table(spark, sf, "instruction").withColumn("vec_id", F.col("instr_id") % e.agg(F.count("*")).scalar())
    r = _generic(spark, sf).select("rule_id", F.col("ord").alias("rule_seq"), F.when(F.col("ord") % 10 != 0, F.col("ord") * 3).alias("vec_id"))
    return i, r.join(e, "vec_id", "left").drop("vec_id"), e


@query("F1_topics", f"WITH {TAGGED} SELECT instr_id, topic_set FROM tg")
def f1(spark, sf):
    return pf.topic_sets(table(spark, sf, "instruction")).select("instr_id", "topic_set")


@query("F2_keywords", f"WITH {TAGGED}, {RULE_TXT}, {CAND} SELECT topic_set, rule_id FROM cd")
def f2(spark, sf):
    return pf.keyword_rules(pf.topic_sets(table(spark, sf, "instruction")), _generic(spark, sf))


@query("F3_vectors", f"{RANKED} SELECT instr_id, rule_id, round(score, 5) AS score, rank FROM rk")
def f3(spark, sf):
    i, r, e = _vectors(spark, sf)
    tagged = pf.tag(i)
    out = pf.rank_rules(tagged, pf.keyword_rules(tagged, _generic(spark, sf), ["ord"]), r, 5, e)
    return out.select("instr_id", "rule_id", F.round("score", 5).alias("score"), "rank")


VERDICT_KEEP = """vg AS (SELECT DISTINCT instr_id, rule_id FROM rule_verdict WHERE relevant)"""


@query("F4_verdicts", f"""WITH {VERDICT_KEEP}, c AS (SELECT instr_id, rule_id FROM rule_verdict),
m AS (SELECT c.*, vg.rule_id IS NOT NULL AS ok FROM c LEFT JOIN vg ON c.instr_id = vg.instr_id AND c.rule_id = vg.rule_id)
SELECT instr_id, rule_id FROM m QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY instr_id)""")
def f4(spark, sf):
    v = table(spark, sf, "rule_verdict")
    return pf.keep_relevant(v.select("instr_id", "rule_id"), v)


@query("F5_cascade", f"""{RANKED}, {VERDICT_KEEP}, m AS (SELECT rk.*, vg.rule_id IS NOT NULL AS ok FROM rk LEFT JOIN vg ON rk.instr_id = vg.instr_id AND rk.rule_id = vg.rule_id)
SELECT instr_id, rule_id, rank FROM m QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY instr_id)""")
def f5(spark, sf):
    i, r, e = _vectors(spark, sf)
    return pf.prefilter(i, _generic(spark, sf), r, table(spark, sf, "rule_verdict"), 5, vectors=e).select("instr_id", "rule_id", "rank")


@query("F6_hash", """WITH h AS (SELECT run, seq, md5(id || ':' || trigger_text || ':' || constraint_text || ':' || if_cond) AS h FROM krule),
b AS (SELECT run, seq // 4096 AS b, md5(string_agg(h, '' ORDER BY seq)) AS h FROM h GROUP BY 1, 2) SELECT run, md5(string_agg(h, '' ORDER BY b)) AS rules_hash FROM b GROUP BY run""")
def f6(spark, sf):
    return pf.rules_hash(_generic(spark, sf, None), ["run"])


# ---- X: extraction ----------------------------------------------------------------------------------

KEY_SQL = {
    "entity": "trim(lower(text))",
    "relationship": "trim(lower(concat(subject_text, ':', predicate, ':', object_text)))",
    "event": "trim(lower(concat(event_type, ':', trigger_text)))",
    "krule": "trim(lower(concat(rule_type, ':', trigger_text)))",
    "procedure": "trim(lower(name))",
}
FIRST = "row_number() OVER (PARTITION BY run, key ORDER BY page, chunk, idx)"


@query("X1_accumulate", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, run, key, page, chunk, idx FROM (SELECT *, {FIRST} AS rn FROM (SELECT *, {s} AS key FROM {k}) WHERE key <> '') WHERE rn = 1"
    for k, s in KEY_SQL.items()))
def x1(spark, sf):
    out = None
    for k, df in records(spark, sf).items():
        part = ex.accumulate(df, k).select(F.lit(k).alias("kind"), "run", "key", "page", "chunk", "idx")
        out = part if out is None else out.unionByName(part)
    return out


def _ne(prefix: str, col: str) -> str:
    return f"'{prefix}' || nullif({col}, '')"


EMBED_SQL = {
    "entity": f"concat_ws(' | ', nullif(text, ''), {_ne('type: ', 'label')}, {_ne('subtype: ', 'subtype')}, {_ne('context: ', 'context')})",
    "relationship": f"concat_ws(' | ', subject_text || ' ' || predicate || ' ' || object_text, {_ne('type: ', 'relation_type')})",
    "event": f"concat_ws(' | ', {_ne('type: ', 'event_type')}, {_ne('trigger: ', 'trigger_text')}, {_ne('phase: ', 'phase')}, {_ne('when: ', 'temporal_context')})",
    "krule": f"concat_ws(' | ', {_ne('type: ', 'rule_type')}, {_ne('modality: ', 'modality')}, {_ne('trigger: ', 'trigger_text')}, {_ne('constraint: ', 'constraint_text')}, {_ne('purpose: ', 'explainability')})",
    "procedure": f"concat_ws(' | ', {_ne('name: ', 'name')}, {_ne('purpose: ', 'purpose')}, {_ne('context: ', 'context')})",
}


@query("X2_embed_text", " UNION ALL ".join(f"SELECT '{k}' AS kind, run, page, chunk, idx, trim({s}) AS txt FROM {k}" for k, s in EMBED_SQL.items()))
def x2(spark, sf):
    out = None
    for k, df in records(spark, sf).items():
        part = df.select(F.lit(k).alias("kind"), "run", "page", "chunk", "idx", ex.embed_text(k).alias("txt"))
        out = part if out is None else out.unionByName(part)
    return out


COS = "list_dot_product(q.v, i.v) / greatest(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v)), 1e-12)"
EMB = "em AS (SELECT vec_id, label % 5 AS g, embedding::double[] AS v FROM embeddings)"


@query("X3_top_context", f"""WITH {EMB}, s AS (SELECT q.vec_id AS q_id, i.vec_id AS i_id, {COS} AS score FROM em q JOIN em i ON q.g = i.g),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, i_id) AS rank FROM s QUALIFY rank <= 5)
SELECT q_id, i_id, round(score, 5) AS score, rank FROM r WHERE score >= 0.1""")
def x3(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") % 5).alias("grp"), "vec_id", "embedding")
    q = e.select("grp", F.col("vec_id").alias("q_id"), F.col("vec_id").alias("q_seq"), F.col("embedding").alias("q_vec"))
    i = e.select("grp", F.col("vec_id").alias("i_id"), F.col("vec_id").alias("i_seq"), F.col("embedding").alias("i_vec"))
    return ex.top_context(q, i, 5).select("q_id", "i_id", F.round("score", 5).alias("score"), "rank")


@query("X4_context", f"""WITH {EMB}, n AS (SELECT g, CASE g WHEN 0 THEN 50 WHEN 2 THEN 10 ELSE 5 END AS k FROM (SELECT DISTINCT g FROM em)),
s AS (SELECT q.vec_id AS q_id, i.vec_id AS i_id, i.g, {COS} AS score FROM em q JOIN em i ON i.vec_id < q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id, g ORDER BY score DESC, i_id) AS rank FROM s)
SELECT q_id, CASE r.g WHEN 0 THEN 'entity' WHEN 1 THEN 'krule' WHEN 2 THEN 'relationship' WHEN 3 THEN 'event' ELSE 'procedure' END AS kind, i_id, round(score, 5) AS score, rank
FROM r JOIN n ON r.g = n.g WHERE rank <= k AND score >= 0.1""")
def x4(spark, sf):
    kinds = ["entity", "krule", "relationship", "event", "procedure"]
    names = F.array(*[F.lit(k) for k in kinds])
    e = table(spark, sf, "embeddings")
    q = e.select(F.explode(names).alias("grp"), F.col("vec_id").alias("q_id"), F.col("vec_id").alias("q_seq"), F.col("embedding").alias("q_vec"))
    i = e.select(F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("grp"), F.col("vec_id").alias("i_id"), F.col("vec_id").alias("i_seq"), F.col("embedding").alias("i_vec"))
    out = ex.context_by_type(q, i)
    return out.select("q_id", F.col("grp").alias("kind"), "i_id", F.round("score", 5).alias("score"), "rank")


@query("X5_last_ids", """WITH n AS (SELECT run, page, chunk, max(CAST(regexp_extract(id, '^E(\\d+)$', 1) AS bigint)) AS num FROM entity WHERE regexp_matches(id, '^E\\d+$') GROUP BY 1, 2, 3),
l AS (SELECT run, max_by(num, page * 100 + chunk) AS last, max(num) AS top FROM n WHERE num > 0 GROUP BY 1)
SELECT run, printf('E%03d', last) AS last_id, printf('E%03d', top) AS max_id, printf('E%03d', last + 1) AS next_hint FROM l""")
def x5(spark, sf):
    return ex.last_ids(records(spark, sf)["entity"], "E")


def _refs_bad(csv: str, prefix: str) -> str:
    return f"len(list_filter(CASE WHEN {csv} = '' THEN [] ELSE string_split({csv}, ',') END, lambda r: NOT starts_with(r, '{prefix}')))"


X6_BASE = f"""fe AS (SELECT *, id AS raw_id, CASE WHEN regexp_matches(id, '^\\d+$') THEN 'E' || id ELSE id END AS fid FROM entity),
u AS (
 SELECT 0 AS t, run, page, chunk, idx, raw_id, fid AS id, starts_with(fid, 'E') AS p, text = fid AS corrupt, true AS refs, 'entity' AS kind FROM fe
 UNION ALL SELECT 1, run, page, chunk, idx, id, id, starts_with(id, 'R'), false, starts_with(subject_id, 'E') AND starts_with(object_id, 'E'), 'relationship' FROM relationship
 UNION ALL SELECT 2, run, page, chunk, idx, id, id, starts_with(id, 'EV'), false, {_refs_bad('actors_csv', 'E')} = 0 AND {_refs_bad('targets_csv', 'E')} = 0, 'event' FROM event
 UNION ALL SELECT 3, run, page, chunk, idx, id, id, starts_with(id, 'RULE'), false, {_refs_bad('trigger_entities_csv', 'E')} = 0 AND {_refs_bad('action_entities_csv', 'E')} = 0
    AND {_refs_bad('linked_entities_csv', 'E')} = 0 AND {_refs_bad('linked_relationships_csv', 'R')} = 0, 'rule' FROM krule
 UNION ALL SELECT 4, run, page, chunk, idx, id, id, starts_with(id, 'P'), false, {_refs_bad('linked_rules_csv', 'RULE')} = 0, 'procedure' FROM procedure),
f AS (SELECT run, page, chunk, id, min(t * 1000000 + idx) AS fp FROM u WHERE id <> '' AND p AND NOT corrupt AND refs GROUP BY 1, 2, 3, 4),
z AS (SELECT u.*, coalesce(t * 1000000 + u.idx > fp, false) AS dup FROM u LEFT JOIN f ON u.run = f.run AND u.page = f.page AND u.chunk = f.chunk AND u.id = f.id),
kept AS (SELECT * FROM z WHERE id <> '' AND p AND NOT dup AND NOT corrupt AND refs)"""


def _kept_query(name: str, kind: str, shown: str):
    @query(name, f"WITH {X6_BASE} SELECT run, page, chunk, idx, id FROM kept WHERE kind = '{shown}'")
    def run(spark, sf):
        kept, _ = ex.clean(records(spark, sf))
        return kept[kind].select("run", "page", "chunk", "idx", F.col("id") if kind != "entity" else
                                 F.when(F.col("id").rlike(r"^\d+$"), F.concat(F.lit("E"), "id")).otherwise(F.col("id")).alias("id"))


for _n, _k, _s in (("X6a_entities", "entity", "entity"), ("X6b_relationships", "relationship", "relationship"), ("X6c_events", "event", "event"),
                   ("X6d_rules", "krule", "rule"), ("X6e_procedures", "procedure", "procedure")):
    _kept_query(_n, _k, _s)

ERRORS_SQL = f"""{X6_BASE}, live AS (SELECT z.*, e.context, e.formal_definition FROM z JOIN fe e ON z.t = 0 AND z.run = e.run AND z.page = e.page AND z.chunk = e.chunk AND z.idx = e.idx
   WHERE z.id <> '' AND p AND NOT dup AND NOT z.corrupt),
g AS (SELECT * FROM z WHERE id <> '' AND p AND NOT dup AND t > 0),
er AS (
 SELECT run, page, chunk, idx, kind AS record_type, kind AS item_type, 'missing_id' AS type, NULL AS field FROM z WHERE id = '' AND t = 0
 UNION ALL SELECT run, page, chunk, idx, kind, kind, 'wrong_prefix', NULL FROM z WHERE id <> '' AND ((t = 0 AND NOT starts_with(raw_id, 'E')) OR (t > 0 AND NOT p))
 UNION ALL SELECT run, page, chunk, idx, kind, kind, 'duplicate_id', NULL FROM z WHERE id <> '' AND p AND dup
 UNION ALL SELECT run, page, chunk, idx, kind, kind, 'corrupt_entity', NULL FROM z WHERE id <> '' AND p AND NOT dup AND corrupt
 UNION ALL SELECT run, page, chunk, idx, kind, kind, 'empty_context', NULL FROM live WHERE coalesce(context, '') IN ('', 'N/A', 'None')
 UNION ALL SELECT run, page, chunk, idx, kind, kind, 'normalized_field', NULL FROM live WHERE formal_definition IN ('', 'N/A', 'None')
 UNION ALL SELECT g.run, g.page, g.chunk, g.idx, g.kind, 'unknown', 'invalid_cross_reference', 'subject_id' FROM g JOIN relationship r ON g.kind = 'relationship' AND g.run = r.run AND g.page = r.page AND g.chunk = r.chunk AND g.idx = r.idx WHERE NOT starts_with(subject_id, 'E')
 UNION ALL SELECT g.run, g.page, g.chunk, g.idx, g.kind, 'unknown', 'invalid_cross_reference', 'actors' FROM g JOIN event r ON g.kind = 'event' AND g.run = r.run AND g.page = r.page AND g.chunk = r.chunk AND g.idx = r.idx WHERE {_refs_bad('actors_csv', 'E')} > 0
 UNION ALL SELECT g.run, g.page, g.chunk, g.idx, g.kind, 'unknown', 'invalid_cross_reference', 'trigger_entities' FROM g JOIN krule r ON g.kind = 'rule' AND g.run = r.run AND g.page = r.page AND g.chunk = r.chunk AND g.idx = r.idx WHERE {_refs_bad('trigger_entities_csv', 'E')} > 0
 UNION ALL SELECT g.run, g.page, g.chunk, g.idx, g.kind, 'unknown', 'invalid_cross_reference', 'linked_rules' FROM g JOIN procedure r ON g.kind = 'procedure' AND g.run = r.run AND g.page = r.page AND g.chunk = r.chunk AND g.idx = r.idx WHERE {_refs_bad('linked_rules_csv', 'RULE')} > 0)"""


@query("X6f_errors", f"WITH {ERRORS_SQL} SELECT * FROM er")
def x6f(spark, sf):
    return ex.clean(records(spark, sf))[1].drop("item_id")


@query("X6f_lenient", f"WITH {X6_BASE.replace('AND NOT corrupt AND refs GROUP', 'AND NOT corrupt GROUP')} SELECT run, kind, count(*) AS n FROM z WHERE id <> '' AND p AND NOT dup AND NOT corrupt GROUP BY 1, 2")
def x6f_lenient(spark, sf):
    kept, _ = ex.clean(records(spark, sf), strict=False)
    out = None
    for k, df in kept.items():
        c = df.groupBy("run").agg(F.count("*").alias("n")).withColumn("kind", F.lit(ex.ITEM_NAMES[k]))
        out = c if out is None else out.unionByName(c)
    return out


@query("X7_references", f"""SELECT run, page, idx, 'actors' AS field, array_to_string(list_filter(string_split(actors_csv, ','), lambda r: NOT starts_with(r, 'E')), ',') AS "values" FROM event WHERE {_refs_bad('actors_csv', 'E')} > 0
UNION ALL SELECT run, page, idx, 'targets', array_to_string(list_filter(string_split(targets_csv, ','), lambda r: NOT starts_with(r, 'E')), ',') FROM event WHERE {_refs_bad('targets_csv', 'E')} > 0""")
def x7(spark, sf):
    return ex.reference_errors(records(spark, sf)["event"], "event").select("run", "page", "idx", "field", "values")


@query("X8_summary", f"WITH {ERRORS_SQL} SELECT run, page, type, item_type, count(*) AS n FROM er GROUP BY GROUPING SETS ((run, page, type), (run, page, item_type))")
def x8(spark, sf):
    return ex.error_summary(ex.clean(records(spark, sf))[1])


@query("X9_failures", """WITH a AS (SELECT conv_id, turn, turn % 4 <> 0 AS ok, CASE WHEN turn % 3 = 0 THEN role END AS step, CAST(turn % 5 AS int) AS step_num FROM conversations)
SELECT conv_id, turn, CASE WHEN ok THEN 'warning' END AS severity, CASE WHEN NOT ok AND step IS NOT NULL THEN 'Step ' || step_num || ' (' || step || ') failed: bad'
 WHEN NOT ok THEN 'KEX extraction failed after all retries (see raw_llm_output for details)' ELSE 'Step ' || step_num || ' (' || step || ') had errors but extraction continued' END AS message
FROM a WHERE NOT ok OR step IS NOT NULL""")
def x9(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.lit("m1").alias("run"), F.col("conv_id").alias("page"), F.col("turn").alias("chunk"), (F.col("turn") % 4 != 0).alias("ok"),
        F.when(F.col("turn") % 3 == 0, F.col("role")).alias("step"), (F.col("turn") % 5).cast("int").alias("step_num"), F.lit("bad").alias("message"),
    )
    return ex.failure_rows(c).select(F.col("page").alias("conv_id"), F.col("chunk").alias("turn"), "severity", "message")


@query("X10_contract", """WITH i AS (SELECT 'entity' AS kind, 'E' AS p, run, page, chunk, id FROM entity UNION ALL SELECT 'relationship', 'R', run, page, chunk, id FROM relationship
 UNION ALL SELECT 'event', 'EV', run, page, chunk, id FROM event UNION ALL SELECT 'krule', 'RULE', run, page, chunk, id FROM krule UNION ALL SELECT 'procedure', 'P', run, page, chunk, id FROM procedure)
SELECT run, page, chunk, id, 'duplicate_id' AS rule, count(*) AS n FROM i WHERE id <> '' GROUP BY 1, 2, 3, 4 HAVING count(*) > 1
UNION ALL SELECT run, page, chunk, id, 'wrong_prefix', count(*) FROM i WHERE NOT starts_with(id, p) GROUP BY 1, 2, 3, 4
UNION ALL SELECT run, page, chunk, id, 'blank_context', count(*) FROM entity WHERE lower(trim(coalesce(context, ''))) IN ('', 'n/a', 'none') GROUP BY 1, 2, 3, 4""")
def x10(spark, sf):
    return ex.contract_breaks(records(spark, sf))


@query("X11_resume", """SELECT doc_id AS page, CASE WHEN doc_id < (SELECT floor(max(doc_id) / 8.0) FROM documents) THEN 'context' ELSE 'process' END AS role FROM documents
WHERE doc_id <= (SELECT max(doc_id) FROM documents)""")
def x11(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").cast("double").alias("page"))
    final = pages.agg(F.max("page")).first()[0]
    return ex.resume_window(pages, float(final // 8), final).select(F.col("page").cast("bigint").alias("page"), "role")


@query("X12_lines", """SELECT doc_id, count(*) AS n, sum(length(s)) AS chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS s FROM documents) WHERE s <> '' GROUP BY 1""")
def x12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(ex.segments(F.col("text"), "line")).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("X12_sentences", r"""SELECT doc_id, count(*) AS n, sum(length(s)) AS chars FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), ' ') AS s FROM documents) WHERE s <> '' GROUP BY 1""")
def x12_sentences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(ex.segments(F.col("text"), "sentence")).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


LINES_SQL = """ln AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS lines FROM documents)"""


def _lines(spark, sf):
    return table(spark, sf, "documents").select(
        F.lit("m1").alias("run"), F.col("doc_id").cast("double").alias("page"), ex.segments(F.col("text"), "line").alias("lines")
    ).where(F.size("lines") > 0)


def _ranges(spark, sf):
    """Ranges of four lines; some pages start at -1, skip a line or end early."""
    p = _lines(spark, sf).select("run", "page", F.size("lines").alias("n_lines"))
    d = F.col("page").cast("bigint")
    ctx = d % 3 == 0
    starts = F.sequence(F.lit(0), F.col("n_lines") - 1, F.lit(4))
    return p.withColumn("s", F.explode(starts)).select(
        "run", "page", "n_lines", ctx.alias("has_context"),
        F.when((F.col("s") == 0) & ctx & (d % 7 != 0), F.lit(-1)).when((F.col("s") == 4) & (d % 5 == 0), F.lit(5)).otherwise(F.col("s")).cast("int").alias("start"),
        F.least(F.col("s") + 3, F.col("n_lines") - 1 - F.when(d % 11 == 0, 1).otherwise(0)).cast("int").alias("end"),
    )


RANGES_SQL = f"""{LINES_SQL}, r0 AS (SELECT doc_id, len(lines) AS n, unnest(range(0, len(lines), 4)) AS s FROM ln WHERE len(lines) > 0),
rg AS (SELECT doc_id AS page, n AS n_lines, doc_id % 3 = 0 AS has_context, CASE WHEN s = 0 AND doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN -1 WHEN s = 4 AND doc_id % 5 = 0 THEN 5 ELSE s END AS "start",
  least(s + 3, n - 1 - CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) AS "end" FROM r0)"""


@query("X13_ranges", f"""WITH {RANGES_SQL}, w AS (SELECT *, lag("end") OVER (PARTITION BY page ORDER BY "start", "end") AS pe, row_number() OVER (PARTITION BY page ORDER BY "start", "end") AS rn FROM rg),
a AS (SELECT page, bool_or("start" < -1 OR "end" < -1) AS low, bool_or("start" > "end") AS inv, bool_or(rn = 1 AND "start" <> CASE WHEN has_context THEN -1 ELSE 0 END) AS fst,
  arg_max("end", rn) <> max(n_lines) - 1 AS lst, bool_or(rn > 1 AND "start" <> pe + 1) AS gap FROM w GROUP BY page)
SELECT page, CASE WHEN low THEN 'index below -1' WHEN inv THEN 'start after end' WHEN fst THEN 'wrong first index' WHEN lst THEN 'wrong last index' WHEN gap THEN 'gap' END AS error FROM a""")
def x13(spark, sf):
    return ex.range_errors(_ranges(spark, sf)).select(F.col("page").cast("bigint").alias("page"), "error")


@query("X14_chunk_texts", f"""WITH {RANGES_SQL}, cr AS (SELECT doc_id AS page, lag(lines[-1]) OVER (ORDER BY doc_id) AS carried, lines FROM ln WHERE len(lines) > 0)
SELECT rg.page, "start", "end", CASE WHEN "start" = -1 THEN carried || CASE WHEN "end" >= 0 THEN ' ' ELSE '' END || array_to_string(lines[1:"end" + 1], ' ') ELSE array_to_string(lines["start" + 1:"end" + 1], ' ') END AS text
FROM rg JOIN cr ON rg.page = cr.page""")
def x14(spark, sf):
    pages = _lines(spark, sf)
    chunks = pages.select("run", "page", (F.size("lines") - 1).alias("chunk"), F.element_at("lines", -1).alias("text"))
    out = ex.chunk_texts(pages.join(ex.carried_text(chunks), ["run", "page"]), _ranges(spark, sf))
    return out.select(F.col("page").cast("bigint").alias("page"), "start", "end", "text")


@query("X15_carry", """WITH c AS (SELECT conv_id, turn, conv_id % 4 = 0 AS external, max(turn) OVER (PARTITION BY conv_id) AS lt, count(*) OVER (PARTITION BY conv_id) AS n, max(conv_id) OVER () AS lp FROM conversations)
SELECT conv_id, turn, turn = lt AS carried, NOT (turn = lt AND NOT external AND conv_id <> lp AND n > 1) AS saved FROM c""")
def x15(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.lit("m1").alias("run"), F.col("conv_id").alias("page"), F.col("turn").alias("chunk"), (F.col("conv_id") % 4 == 0).alias("external")
    )
    return ex.carry_last(c).select(F.col("page").alias("conv_id"), F.col("chunk").alias("turn"), "carried", "saved")


@query("X16_external", """SELECT d.doc_id::double AS page, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE text END AS text, d.doc_id % 5 = 0 AS external FROM documents d
UNION ALL SELECT page_id + 0.5, '', true FROM pages WHERE page_id % 7 = 0""")
def x16(spark, sf):
    own = table(spark, sf, "documents").select(F.col("doc_id").cast("double").alias("page"), "text")
    ext = table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("double").alias("page"))
    sub = table(spark, sf, "pages").where("page_id % 7 = 0").select((F.col("page_id") + F.lit(0.5)).alias("page"))
    return ex.prefer_external(own, ext.unionByName(sub))


ACC_SQL = ", ".join(f"a_{k} AS (SELECT run, page, chunk FROM (SELECT *, {FIRST} AS rn FROM (SELECT *, {s} AS key FROM {k}) WHERE key <> '') WHERE rn = 1)" for k, s in KEY_SQL.items() if k in ("entity", "krule", "relationship"))


@query("X17_audit", f"""WITH {ACC_SQL}, ch AS (SELECT DISTINCT run, page, chunk FROM relationship),
al AS (SELECT run, page, chunk, 0 AS is_ch, 1 AS e, 0 AS k, 0 AS r FROM a_entity UNION ALL SELECT run, page, chunk, 0, 0, 1, 0 FROM a_krule UNION ALL SELECT run, page, chunk, 0, 0, 0, 1 FROM a_relationship),
s AS (SELECT ch.run, ch.page, ch.chunk, coalesce(sum(e), 0) AS e, coalesce(sum(k), 0) AS k, coalesce(sum(r), 0) AS r FROM ch LEFT JOIN al ON ch.run = al.run AND ch.page = al.page AND ch.chunk = al.chunk GROUP BY 1, 2, 3)
SELECT run, page, chunk, CAST(sum(e) OVER w AS bigint) AS entity_total, CAST(sum(k) OVER w AS bigint) AS krule_total, CAST(sum(r) OVER w AS bigint) AS relationship_total FROM s WINDOW w AS (PARTITION BY run ORDER BY page, chunk)""")
def x17(spark, sf):
    rec = records(spark, sf)
    acc = {k: ex.accumulate(rec[k], k) for k in ("entity", "krule", "relationship")}
    return ex.chunk_audit(acc, rec["relationship"].select("run", "page", "chunk").distinct())


@query("X18_json", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS json FROM events")
def x18(spark, sf):
    e = table(spark, sf, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\ndone"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Result {bad} "), "props", F.lit(" end"))
    ).otherwise(F.concat(F.lit("none "), "event_type"))
    return e.select("event_id", ex.first_json(t).alias("json"))


@query("X19_catalogue", f"SELECT run, key, text, label, coalesce(context, '') AS context, 'pagina_' || page::int || '.json' AS source_file FROM (SELECT *, {FIRST} AS rn FROM (SELECT *, {KEY_SQL['entity']} AS key FROM entity) WHERE key <> '') WHERE rn = 1")
def x19(spark, sf):
    return ex.entity_catalogue(records(spark, sf)["entity"])


@query("X20_totals", """WITH u AS (SELECT 'entity' AS kind, run, page, chunk FROM entity UNION ALL SELECT 'relationship', run, page, chunk FROM relationship UNION ALL SELECT 'event', run, page, chunk FROM event
 UNION ALL SELECT 'krule', run, page, chunk FROM krule UNION ALL SELECT 'procedure', run, page, chunk FROM procedure)
SELECT run, count(DISTINCT page) AS pages, count(DISTINCT page * 10 + chunk) AS chunks, count(*) FILTER (kind = 'entity') AS entity, count(*) FILTER (kind = 'relationship') AS relationship,
 count(*) FILTER (kind = 'event') AS event, count(*) FILTER (kind = 'krule') AS krule, count(*) FILTER (kind = 'procedure') AS procedure FROM u GROUP BY run""")
def x20(spark, sf):
    return ex.run_totals(records(spark, sf))
