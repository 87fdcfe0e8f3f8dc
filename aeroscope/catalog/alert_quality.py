"""Rule and alert quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroscope.catalog import query
from aeroscope.fixtures import table
from aeroscope.operators import alert_eval as ev


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


DECISIONS_SQL = """dc AS (SELECT CAST(doc_id AS STRING) AS rule_id, k.model, CASE WHEN k.k = 0 THEN toxic = 0 ELSE doc_id % 3 <> 0 END AS m, quality = 1 AS g
  FROM labels CROSS JOIN (SELECT 0 AS k, 'm0' AS model UNION ALL SELECT 1, 'm1') k)"""


def _decisions(spark, sf):
    lab = table(spark, sf, "labels")
    dec = lab.select(
        F.col("doc_id").cast("string").alias("rule_id"),
        F.explode(F.array(
            F.struct(F.lit("m0").alias("model"), (F.col("toxic") == 0).alias("compilable")),
            F.struct(F.lit("m1").alias("model"), (F.col("doc_id") % 3 != 0).alias("compilable")),
        )).alias("x"),
    ).select("rule_id", "x.*")
    truth = lab.select(F.col("doc_id").cast("string").alias("rule_id"), (F.col("quality") == 1).alias("is_compilable"))
    return dec, truth


CLASS_SQL = """SELECT model, count(*) FILTER (m AND g) AS tp, count(*) FILTER (m AND NOT g) AS fp, count(*) FILTER (NOT m AND NOT g) AS tn,
  count(*) FILTER (NOT m AND g) AS fn, count(*) AS n, round(count(*) FILTER (m = g) / count(*)::double, 6) AS accuracy,
  round(coalesce(count(*) FILTER (m AND g) / nullif(count(*) FILTER (m), 0)::double, 0), 6) AS precision,
  round(coalesce(count(*) FILTER (m AND g) / nullif(count(*) FILTER (g), 0)::double, 0), 6) AS recall FROM dc GROUP BY model"""


@query("M1_classification", f"WITH {DECISIONS_SQL} {CLASS_SQL}")
def m1(spark, sf):
    return r6(ev.classification(*_decisions(spark, sf)), "accuracy", "precision", "recall")


def _validation(spark, sf):
    return table(spark, sf, "latency").select(F.col("component").alias("model"), (F.col("ms") > 5).alias("passed"))


@query("M2_pass_rate", """SELECT component AS model, round(avg(CASE WHEN ms > 5 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS total
FROM latency GROUP BY 1""")
def m2(spark, sf):
    return r6(ev.pass_rate(_validation(spark, sf)), "pass_rate")


def _outputs(spark, sf):
    e, a = table(spark, sf, "expected"), table(spark, sf, "actual")
    j = a.join(e, ["case_id", "rule_id"], "left")
    return j.select(
        F.col("strategy").alias("model"),
        F.when(F.col("latency_ms") > 90, "timeout").alias("error"),
        (F.col("latency_ms") <= 90).alias("has_output"),
        (F.col("exp_satisfied").isNotNull() & (F.col("latency_ms") > 10)).alias("has_expected"),
        F.col("act_satisfied").alias("out_satisfied"), "exp_satisfied",
        F.lower("act_severity").alias("out_severity"), F.lower("exp_severity").alias("exp_severity"),
    )


EXEC_SQL = """o AS (SELECT strategy AS model, latency_ms > 90 AS err, latency_ms > 10 AS has_exp,
  CASE WHEN latency_ms > 90 THEN false WHEN latency_ms > 10 THEN coalesce(act_satisfied = exp_satisfied, true)
    AND coalesce(lower(act_severity) = lower(exp_severity), true) END AS mt
  FROM actual a LEFT JOIN expected e ON a.case_id = e.case_id AND a.rule_id = e.rule_id),
ex AS (SELECT model, count(*) AS total, count(*) FILTER (NOT err) AS succeeded, count(*) FILTER (err) AS failed,
  count(*) FILTER (NOT err AND (mt IS NULL OR mt)) AS passed, round(count(*) FILTER (mt) / count(*)::double, 6) AS match_rate FROM o GROUP BY model)"""


@query("M3_execution", f"WITH {EXEC_SQL} SELECT * FROM ex")
def m3(spark, sf):
    return r6(ev.executions(_outputs(spark, sf)), "match_rate")


@query("M4_overall", f"""WITH {DECISIONS_SQL}, cl AS ({CLASS_SQL}), {EXEC_SQL},
v AS (SELECT CASE component WHEN 'compiled' THEN 'm0' WHEN 'native' THEN 'm1' ELSE 'm2' END AS model, avg(CASE WHEN ms > 5 THEN 1.0 ELSE 0.0 END) AS pr FROM latency GROUP BY 1),
x AS (SELECT CASE model WHEN 'compiled' THEN 'm0' ELSE 'm1' END AS model, match_rate AS mr FROM ex),
s AS (SELECT CASE strategy WHEN 'compiled' THEN 'm0' ELSE 'm1' END AS model, avg(latency_ms / 100.0) AS sc FROM actual GROUP BY 1)
SELECT v.model, round(coalesce(accuracy, 0), 4) AS classification, round(pr, 4) AS validation, round(coalesce(mr, 0), 4) AS execution, round(coalesce(sc, 0), 4) AS semantic,
  round(0.15 * coalesce(accuracy, 0) + 0.15 * pr + 0.30 * coalesce(mr, 0) + 0.40 * coalesce(sc, 0), 4) AS overall
FROM v LEFT JOIN cl ON v.model = cl.model LEFT JOIN x ON v.model = x.model LEFT JOIN s ON v.model = s.model""")
def m4(spark, sf):
    def named(df, mapping):
        c = F.col("model")
        out = F.lit("m2")
        for k, v in mapping.items():
            out = F.when(c == k, v).otherwise(out)
        return df.withColumn("model", out)

    paths = {"compiled": "m0", "native": "m1"}
    sides = {"compiled": "m0", "generic": "m1"}
    sem = table(spark, sf, "actual").select(F.col("strategy").alias("model"), (F.col("latency_ms") / 100.0).alias("score"))
    out = ev.rule_overall(
        ev.classification(*_decisions(spark, sf)),
        named(ev.pass_rate(_validation(spark, sf)), paths),
        named(ev.executions(_outputs(spark, sf)), sides),
        named(sem, sides),
    )
    return out.select("model", *[F.round(n, 4).alias(n) for n in ("classification", "validation", "execution", "semantic", "overall")])


CONF_SQL = """cf AS (SELECT a.strategy, a.rule_id, a.case_id, exp_satisfied AS e, act_satisfied AS s,
   coalesce(lower(exp_severity) = lower(act_severity), false) AS same
   FROM expected x JOIN actual a ON x.case_id = a.case_id AND x.rule_id = a.rule_id)"""


def conf_counts(by: str) -> str:
    return f"""SELECT {by}, count(*) FILTER (NOT e AND NOT s) AS tp, count(*) FILTER (e AND NOT s) AS fp, count(*) FILTER (e AND s) AS tn,
  count(*) FILTER (NOT e AND s) AS fn, count(*) FILTER (NOT e AND NOT s AND same) AS severity_correct, count(*) FILTER (NOT e AND NOT s) AS severity_total
  FROM cf GROUP BY {by}"""


RATES = """coalesce(tp / nullif(tp + fp, 0)::double, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) AS recall,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) AS f1, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::double, 0) AS accuracy,
  coalesce(severity_correct / nullif(severity_total, 0)::double, 0) AS severity_accuracy"""
RATE_NAMES = ("precision", "recall", "f1", "accuracy", "severity_accuracy")
ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in RATE_NAMES)


def _confusion(spark, sf, by):
    return ev.confusion(table(spark, sf, "expected"), table(spark, sf, "actual"), by)


@query("M5_confusion", f"WITH {CONF_SQL} {conf_counts('strategy, rule_id')}")
def m5(spark, sf):
    return _confusion(spark, sf, ["strategy", "rule_id"])


@query("M6_rates", f"""WITH {CONF_SQL}, c AS ({conf_counts('strategy, rule_id')}), r AS (SELECT strategy, rule_id, {RATES} FROM c)
SELECT strategy, rule_id, {ROUNDED} FROM r""")
def m6(spark, sf):
    return r6(ev.rates(_confusion(spark, sf, ["strategy", "rule_id"])), *RATE_NAMES).select("strategy", "rule_id", *RATE_NAMES)


@query("M7_strategies", f"""WITH {CONF_SQL}, c AS ({conf_counts('strategy, rule_id')}), r AS (SELECT strategy, rule_id, {RATES} FROM c),
m AS (SELECT strategy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(accuracy) AS accuracy, avg(severity_accuracy) AS severity_accuracy FROM r GROUP BY 1),
s AS (SELECT strategy, avg(latency_ms / 100.0) AS semantic FROM actual GROUP BY 1),
o AS (SELECT m.*, semantic, 0.3 * precision + 0.3 * recall + 0.2 * severity_accuracy + 0.2 * semantic AS overall FROM m JOIN s ON m.strategy = s.strategy)
SELECT strategy, {ROUNDED}, round(semantic, 6) AS semantic, round(overall, 6) AS overall, row_number() OVER (ORDER BY overall DESC, strategy) AS rank FROM o""")
def m7(spark, sf):
    sem = table(spark, sf, "actual").select("strategy", (F.col("latency_ms") / 100.0).alias("score"))
    out = ev.strategies(ev.rates(_confusion(spark, sf, ["strategy", "rule_id"])), sem)
    return r6(out, *RATE_NAMES, "semantic", "overall")


@query("M8_mean_latency", "SELECT strategy, round(avg(latency_ms), 6) AS avg_latency_ms FROM actual GROUP BY 1")
def m8(spark, sf):
    return r6(ev.mean_latency(table(spark, sf, "actual"), ["strategy"]), "avg_latency_ms")


@query("M9_cases", f"""WITH {CONF_SQL}, c AS ({conf_counts('case_id')}), r AS (SELECT case_id, tp, fp, tn, fn, {RATES} FROM c)
SELECT case_id, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r""")
def m9(spark, sf):
    out = ev.rates(_confusion(spark, sf, ["case_id"]))
    return r6(out, "precision", "recall", "f1").select("case_id", "tp", "fp", "tn", "fn", "precision", "recall", "f1")


FIRST_SQL = """fa AS (SELECT case_id, rule_id, severity, src FROM (SELECT *, row_number() OVER (PARTITION BY case_id, rule_id ORDER BY src, ord) AS rn FROM generated) WHERE rn = 1)"""
CASE_SQL = f"""{FIRST_SQL},
fj AS (SELECT coalesce(e.case_id, g.case_id) AS case_id, coalesce(e.rule_id, g.rule_id) AS rule_id, coalesce(NOT exp_satisfied, false) AS want,
   coalesce(exp_satisfied, false) AS safe, g.rule_id IS NOT NULL AS gen, coalesce(lower(exp_severity) = lower(severity), false) AS same
   FROM expected e FULL JOIN fa g ON e.case_id = g.case_id AND e.rule_id = g.rule_id),
cs AS (SELECT case_id, count(*) FILTER (want AND gen) AS tp, count(*) FILTER (gen AND NOT want) + count(*) FILTER (gen AND safe) AS fp,
   count(*) FILTER (gen AND NOT want) AS fp_distinct, count(*) FILTER (want AND NOT gen) AS fn, count(*) FILTER (want AND gen AND same) AS severity_correct,
   count(*) FILTER (want AND gen) AS severity_total,
   coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (want), '') AS expected_violations,
   coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (gen), '') AS generated,
   coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (gen AND NOT want), '') AS unexpected FROM fj GROUP BY case_id)"""
PRF = """round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) AS f1,
  round(coalesce(severity_correct / nullif(severity_total, 0)::double, 0), 6) AS severity_accuracy"""


def _first(spark, sf):
    g = table(spark, sf, "generated")
    return ev.first_alerts(g.where("src = 0").drop("src"), g.where("src = 1").drop("src"))


def _cases(spark, sf):
    return ev.case_accuracy(table(spark, sf, "expected"), _first(spark, sf))


@query("M10_case_accuracy", f"WITH {CASE_SQL} SELECT *, {PRF} FROM cs")
def m10(spark, sf):
    return r6(_cases(spark, sf), "precision", "recall", "f1", "severity_accuracy")


@query("M11_micro", f"""WITH {CASE_SQL}, t AS (SELECT case_id, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, sum(severity_correct)::bigint AS severity_correct,
  sum(severity_total)::bigint AS severity_total FROM cs GROUP BY ROLLUP (case_id)) SELECT *, {PRF} FROM t""")
def m11(spark, sf):
    return r6(ev.micro_totals(_cases(spark, sf)), "precision", "recall", "f1", "severity_accuracy")


@query("M12_first_alerts", f"WITH {FIRST_SQL} SELECT * FROM fa")
def m12(spark, sf):
    return _first(spark, sf)


def stats_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS count, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms,
  list_extract(list_sort(list(ms)), CAST(count(*) // 2 AS bigint) + 1) AS p50,
  list_extract(list_sort(list(ms)), least(CAST(floor(count(*) * 0.95::double) AS bigint), count(*) - 1) + 1) AS p95,
  list_extract(list_sort(list(ms)), least(CAST(floor(count(*) * 0.99::double) AS bigint), count(*) - 1) + 1) AS p99
  FROM {source} WHERE ms > 0 GROUP BY {by}"""


@query("M13_latency", stats_sql("latency", "component"))
def m13(spark, sf):
    return r6(ev.latency_stats(table(spark, sf, "latency"), ["component"]), "avg_ms")


@query("M14_by_rule", f"""WITH l2 AS (SELECT component, NULL AS step, ms FROM latency UNION ALL SELECT component, component || '_' || rule_id, ms FROM latency)
{stats_sql('l2', 'component, step')}""")
def m14(spark, sf):
    return r6(ev.latency_by_component(table(spark, sf, "latency")), "avg_ms")


@query("M14_rank", """SELECT component, round(avg(ms), 6) AS avg_ms, row_number() OVER (ORDER BY avg(ms), component) AS rank FROM latency WHERE ms > 0 GROUP BY 1""")
def m14_rank(spark, sf):
    out = ev.rank_latency(ev.latency_stats(table(spark, sf, "latency"), ["component"]))
    return r6(out, "avg_ms").select("component", "avg_ms", "rank")


@query("M15_measured", "SELECT case_id, rule_id, round(avg(ms), 6) AS mean_ms, count(*) AS n FROM latency WHERE iteration >= 2 GROUP BY 1, 2")
def m15(spark, sf):
    return r6(ev.measured_means(table(spark, sf, "latency"), 2, ["case_id", "rule_id"]), "mean_ms")


@query("M16_unexplained", "WITH c AS (SELECT doc_id AS case_id, text FROM documents) SELECT case_id FROM c WHERE case_id NOT IN (SELECT case_id FROM expected)"
       + "".join(f" AND NOT contains(lower(text), '{m}')" for m in ev.CLEAN_MARKERS))
def m16(spark, sf):
    cases = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("description"))
    return ev.unexplained_cases(cases, table(spark, sf, "expected")).select("case_id")


@query("M17_problems", f"WITH {CASE_SQL} SELECT case_id, tp, fp, fn, tp + fp + fn AS total FROM cs WHERE fp > 5 OR fn > 0")
def m17(spark, sf):
    return ev.problem_cases(_cases(spark, sf)).select("case_id", "tp", "fp", "fn", "total")


@query("M18_score_histogram", """SELECT CAST(least(floor(latency_ms / 96.0::double * 10), 9) AS int) AS bin, count(*) AS n FROM actual GROUP BY 1""")
def m18(spark, sf):
    return ev.score_histogram(table(spark, sf, "actual").withColumn("s", F.col("latency_ms") / 96.0), "s")


@query("M18_count_histogram", f"""WITH {CASE_SQL}, l AS (SELECT 'fp' AS name, fp AS v FROM cs UNION ALL SELECT 'fn', fn FROM cs),
w AS (SELECT max(fp) AS top, greatest(1, (max(fp) + 1) // 15) AS w FROM cs), z AS (SELECT *, ((top + 1) // w) * w AS last FROM w)
SELECT name, CAST(least((v // w) * w, last - w) AS bigint) AS bin_low, count(*) AS n FROM l, z WHERE v <= last GROUP BY 1, 2""")
def m18_counts(spark, sf):
    return ev.count_histogram(_cases(spark, sf), ["fp", "fn"], "fp")


@query("M19_rules_latency", """SELECT case_id, count(DISTINCT component || rule_id) AS n_rules, round(sum(ms), 6) AS total_ms FROM latency GROUP BY 1 HAVING sum(ms) > 0""")
def m19(spark, sf):
    return r6(ev.rules_against_latency(table(spark, sf, "latency")), "total_ms")


@query("M20_runs", """SELECT component AS model, count(*) AS total, count(*) FILTER (ms > 2) AS passed, count(*) FILTER (ms <= 2) AS failed,
  round(sum(ms), 6) AS time, bool_and(ms > 2) AS all_passed FROM latency GROUP BY 1""")
def m20(spark, sf):
    runs = table(spark, sf, "latency").select(
        F.col("component").alias("model"), F.when(F.col("ms") > 2, "passed").otherwise("failed").alias("status"), F.col("ms").alias("duration")
    )
    return r6(ev.run_summary(runs), "time")


@query("M21_paths", f"""WITH s AS (SELECT component, case_id, sum(ms) AS ms FROM latency GROUP BY 1, 2), t AS ({stats_sql('s', 'component')})
SELECT component, count, avg_ms, p95 FROM t""")
def m21(spark, sf):
    return r6(ev.path_latency(table(spark, sf, "latency")), "avg_ms")
