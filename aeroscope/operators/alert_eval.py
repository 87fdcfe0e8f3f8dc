"""Quality of rules and alerts against expectations, and latency statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.idioms import join_nulls, ratio

# Texts that mark a case without expectations as a clean one.
CLEAN_MARKERS = (
    "clean", "no violation", "no violations", "compliant", "safely", "adequately separated", "single aircraft",
    "runway 27l is clear", "runway 27l clear", "runway clear", "stopped at c1", "holding short",
    "without explicit", "information only", "standard professional", "clear and concise", "just above",
    "well above", "no altitude violation", "no separation to check", "condition met", "correct format", " ok",
    "above 3 nm", "above minimum",
)
# Default weights of the overall scores.
RULE_WEIGHTS = {"classification": 0.15, "validation": 0.15, "execution": 0.30, "semantic": 0.40}
STRATEGY_WEIGHTS = {"precision": 0.3, "recall": 0.3, "severity_accuracy": 0.2, "semantic": 0.2}
QUANTILES = {"p50": None, "p95": 0.95, "p99": 0.99}


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def classification(decisions: DataFrame, truth: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Compilable or not (decisions: rule_id, compilable; truth: rule_id, is_compilable)."""
    j = decisions.join(truth, "rule_id")
    m, g = F.col("compilable"), F.col("is_compilable")
    counts = j.groupBy(*by).agg(
        F.count_if(m & g).alias("tp"), F.count_if(m & ~g).alias("fp"),
        F.count_if(~m & ~g).alias("tn"), F.count_if(~m & g).alias("fn"), F.count("*").alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = prf(tp, fp, fn)
    return counts.withColumns(
        {"accuracy": ratio(tp + F.col("tn"), F.col("n")), "precision": scores["precision"], "recall": scores["recall"]}
    )


def pass_rate(results: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return results.groupBy(*by).agg(
        F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count("*").alias("total")
    )


def output_match(outputs: DataFrame) -> Column:
    """Output equals expectation; a missing expectation gives null, missing fields are not compared."""
    same_sat = F.coalesce(F.col("out_satisfied") == F.col("exp_satisfied"), F.lit(True))
    same_sev = F.coalesce(F.col("out_severity") == F.col("exp_severity"), F.lit(True))
    return F.when(~F.col("has_output"), False).when(F.col("has_expected"), same_sat & same_sev)


def executions(outputs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    rows = outputs.withColumn("matches", output_match(outputs))
    ok = F.col("error").isNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("matches").isNull() | F.col("matches"))).alias("passed"),
        ratio(F.count_if(F.col("matches")), F.count("*")).alias("match_rate"),
    )


def rule_overall(
    class_scores: DataFrame, validation: DataFrame, execution: DataFrame, semantic: DataFrame,
    weights: Mapping[str, float] = RULE_WEIGHTS,
) -> DataFrame:
    """Weighted model score; a missing part counts 0."""
    sem = semantic.groupBy("model").agg(F.avg("score").alias("semantic"))
    parts = {
        "classification": class_scores.select("model", F.col("accuracy").alias("classification")),
        "validation": validation.select("model", F.col("pass_rate").alias("validation")),
        "execution": execution.select("model", F.col("match_rate").alias("execution")),
        "semantic": sem,
    }
    out = None
    for p in parts.values():
        out = p if out is None else out.join(p, "model", "full")
    out = out.na.fill(0.0, list(parts))
    return out.withColumn("overall", sum(F.col(n) * w for n, w in weights.items()))


def confusion(expected: DataFrame, actual: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per group over (case, rule) pairs present on both sides; positive = not satisfied."""
    j = expected.join(actual, ["case_id", "rule_id"])
    e, a = F.col("exp_satisfied"), F.col("act_satisfied")
    hit = ~e & ~a
    same = F.coalesce(F.lower("exp_severity") == F.lower("act_severity"), F.lit(False))
    return j.groupBy(*by).agg(
        F.count_if(hit).alias("tp"), F.count_if(e & ~a).alias("fp"),
        F.count_if(e & a).alias("tn"), F.count_if(~e & a).alias("fn"),
        F.count_if(hit & same).alias("severity_correct"), F.count_if(hit).alias("severity_total"),
    )


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            **prf(tp, fp, fn),
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "severity_accuracy": ratio(F.col("severity_correct"), F.col("severity_total")),
        }
    )


def strategies(
    rule_rates: DataFrame, semantic: DataFrame, weights: Mapping[str, float] = STRATEGY_WEIGHTS
) -> DataFrame:
    """Macro means over rules, weighted score and rank per strategy."""
    names = ("precision", "recall", "f1", "accuracy", "severity_accuracy")
    macro = rule_rates.groupBy("strategy").agg(*[F.avg(n).alias(n) for n in names])
    sem = semantic.groupBy("strategy").agg(F.avg("score").alias("semantic"))
    scored = macro.join(sem, "strategy", "left").na.fill(0.0, ["semantic"])
    scored = scored.withColumn("overall", sum(F.col(n) * w for n, w in weights.items()))
    # one row per strategy: a small global window
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall"), "strategy")))


def mean_latency(actual: DataFrame, by: Sequence[str]) -> DataFrame:
    return actual.groupBy(*by).agg(F.avg("latency_ms").alias("avg_latency_ms"))


def first_alerts(alerts: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per (case, rule): alerts come before violations, then row order. An aggregate, not a window."""
    rows = alerts.withColumn("src", F.lit(0)).unionByName(violations.withColumn("src", F.lit(1)))
    return (
        rows.groupBy("case_id", "rule_id")
        .agg(F.min_by(F.struct("severity", "src"), F.struct("src", "ord")).alias("r"))
        .select("case_id", "rule_id", "r.severity", "r.src")
    )


def case_accuracy(expected: DataFrame, generated: DataFrame) -> DataFrame:
    """Expected against generated alerts per case. An alert on an expected-safe rule counts twice as false
    positive (`fp`); `fp_distinct` counts it once. The lists are bounded by the number of rules."""
    e = expected.select("case_id", "rule_id", "exp_satisfied", "exp_severity")
    g = generated.select("case_id", "rule_id", F.col("severity").alias("gen_severity"), F.lit(True).alias("gen"))
    j = e.join(g, ["case_id", "rule_id"], "full")
    want = F.coalesce(~F.col("exp_satisfied"), F.lit(False))
    safe = F.coalesce(F.col("exp_satisfied"), F.lit(False))
    gen = F.coalesce("gen", F.lit(False))
    same = F.coalesce(F.lower("gen_severity") == F.lower("exp_severity"), F.lit(False))

    def rules(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("rule_id")))), ",")

    counts = j.groupBy("case_id").agg(
        F.count_if(want & gen).alias("tp"),
        (F.count_if(gen & ~want) + F.count_if(gen & safe)).alias("fp"),
        F.count_if(gen & ~want).alias("fp_distinct"),
        F.count_if(want & ~gen).alias("fn"),
        F.count_if(want & gen & same).alias("severity_correct"),
        F.count_if(want & gen).alias("severity_total"),
        rules(want).alias("expected_violations"),
        rules(gen).alias("generated"),
        rules(gen & ~want).alias("unexpected"),
    )
    return counts.withColumns(
        {
            **prf(F.col("tp"), F.col("fp"), F.col("fn")),
            "severity_accuracy": ratio(F.col("severity_correct"), F.col("severity_total")),
        }
    )


def micro_totals(cases: DataFrame) -> DataFrame:
    """Per case and in total (case_id null), ratios from summed counts."""
    names = ("tp", "fp", "fn", "severity_correct", "severity_total")
    sums = cases.rollup("case_id").agg(*[F.sum(n).alias(n) for n in names])
    return sums.withColumns(
        {
            **prf(F.col("tp"), F.col("fp"), F.col("fn")),
            "severity_accuracy": ratio(F.col("severity_correct"), F.col("severity_total")),
        }
    )


def latency_stats(df: DataFrame, by: Sequence[str], value: str = "ms") -> DataFrame:
    """count, avg, min, max and floor-rank percentiles of the positive values per group.

    Exact for any group size: equal values are counted before the shuffle, a logarithmic bucket finds where
    each rank falls, and only the few buckets that hold a rank are ordered.
    """
    by = list(by)
    counts = (
        df.where(F.col(value) > 0)
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", F.floor(F.log("_v") * 64).cast("bigint"))
    )
    buckets = counts.groupBy(*by, "_b").agg(
        F.sum("_c").alias("_bc"), F.sum(F.col("_v") * F.col("_c")).alias("_bs"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
    )
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = buckets.withColumns({"_n": F.sum("_bc").over(whole), "_end": F.sum("_bc").over(upto)}).withColumn(
        "_start", F.col("_end") - F.col("_bc")
    )
    ranks = {
        name: (F.floor(F.col("_n") / 2) if q is None else F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)).cast("bigint")
        for name, q in QUANTILES.items()
    }
    wanted = F.filter(
        F.array(*[F.struct(F.lit(k).alias("_q"), r.alias("_rank")) for k, r in ranks.items()]),
        lambda x: (x["_rank"] >= F.col("_start")) & (x["_rank"] < F.col("_end")),
    )
    holders = placed.withColumn("_w", wanted).where(F.size("_w") > 0).select(*by, "_b", "_start", "_w")
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        join_nulls(counts, holders, [*by, "_b"])
        .withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumn("_x", F.explode("_w"))
        .where((F.col("_x._rank") >= F.col("_start")) & (F.col("_x._rank") < F.col("_end")))
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("_x._q") == k, F.col("_v"))).alias(k) for k in QUANTILES])
    )
    basics = buckets.groupBy(*by).agg(
        F.sum("_bc").alias("count"), (F.sum("_bs") / F.sum("_bc")).alias("avg_ms"),
        F.min("_lo").alias("min_ms"), F.max("_hi").alias("max_ms"),
    )
    return join_nulls(basics, picked, by)


def latency_by_component(runs: DataFrame) -> DataFrame:
    """Statistics per component and per (component, rule) in one frame; rule_id is null for the component.

    Each row is emitted once per level, so both levels share one pass over the values."""
    levels = F.explode(F.array(F.lit(None).cast("string"), F.concat_ws("_", "component", "rule_id")))
    return latency_stats(runs.withColumn("step", levels), ["component", "step"])


def rank_latency(stats: DataFrame) -> DataFrame:
    """Components by mean latency, fastest first (one row per component)."""
    return stats.withColumn("rank", F.row_number().over(Window.orderBy("avg_ms", "component")))


def measured_means(runs: DataFrame, warmup: int, by: Sequence[str]) -> DataFrame:
    return runs.where(F.col("iteration") >= warmup).groupBy(*by).agg(
        F.avg("ms").alias("mean_ms"), F.count("*").alias("n")
    )


def unexplained_cases(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases without expectations whose description carries no clean marker."""
    low = F.lower(F.coalesce("description", F.lit("")))
    clean = F.lit(False)
    for m in CLEAN_MARKERS:
        clean = clean | low.contains(m)
    return cases.join(expected.select("case_id").distinct(), "case_id", "left_anti").where(~clean)


def problem_cases(cases: DataFrame, top: int | None = None) -> DataFrame:
    total = F.col("tp") + F.col("fp") + F.col("fn")
    out = cases.where((F.col("fp") > 5) | (F.col("fn") > 0)).withColumn("total", total)
    out = out.orderBy(F.desc("total"), "case_id")
    return out if top is None else out.limit(top)


def score_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins over [0, 1], right end inclusive."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(0.0, 1.0)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def count_histogram(df: DataFrame, columns: Sequence[str], scale_by: str) -> DataFrame:
    """Counts of small integers in bins whose width follows the largest value of one column."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("v")) for c in columns])).alias("x")
    ).select("x.name", "x.v")
    counts = long.groupBy("name", "v").agg(F.count("*").alias("c"))
    top = F.max(F.when(F.col("name") == scale_by, F.col("v"))).over(Window.partitionBy())
    width = F.greatest(F.lit(1), F.floor((top + 1) / 15)).cast("bigint")
    # numpy bins: edges 0, w, 2w, ... < top + 2; values past the last edge fall outside
    last = F.floor((top + 1) / width) * width
    placed = counts.withColumns({"width": width, "last": last.cast("bigint")}).where(F.col("v") <= F.col("last"))
    low = F.least(F.floor(F.col("v") / F.col("width")) * F.col("width"), F.col("last") - F.col("width")).cast("bigint")
    return placed.groupBy("name", low.alias("bin_low")).agg(F.sum("c").alias("n"))


def rules_against_latency(runs: DataFrame) -> DataFrame:
    """Number of rules evaluated and total latency per case."""
    return runs.groupBy("case_id").agg(
        F.count_distinct("component", "rule_id").alias("n_rules"), F.sum("ms").alias("total_ms")
    ).where(F.col("total_ms") > 0)


def path_latency(runs: DataFrame) -> DataFrame:
    """Latency summed per case and path, then mean and p95 over cases."""
    sums = runs.groupBy("component", "case_id").agg(F.sum("ms").alias("ms"))
    return latency_stats(sums, ["component"]).select("component", "count", "avg_ms", "p95")


def run_summary(runs: DataFrame) -> DataFrame:
    ok = F.col("status") == "passed"
    return runs.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("duration").alias("time"), F.bool_and(ok).alias("all_passed"),
    )
