"""Alerts, their summary and the commit / rollback decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.idioms import latest
from aeroscope.operators.rules import severity_rank


def category(condition_type: Column) -> Column:
    c = F.lower(condition_type)
    return (
        F.when(c.contains("altitude") | c.contains("msa"), "altitude_violation")
        .when(c.contains("separation"), "separation_loss")
        .when(c.contains("runway"), "runway_conflict")
        .when(c.contains("speed"), "speed_violation")
        .otherwise("procedural_error")
    )


def to_alerts(violations: DataFrame) -> DataFrame:
    """One alert per violation. `affected` comes from the violation keys; `affected_raw` keeps the callsigns
    that only the default runway check and the fallback checks list."""
    pair = F.concat_ws(",", "callsign", F.when(F.col("condition_type") != "RUNWAY_NOT_FOUND", F.col("other")))
    listed = F.col("condition_type") == "RUNWAY_AVAILABLE"
    if "fallback" in violations.columns:
        listed = listed | F.col("fallback")
    return violations.select(
        "target_id", "snapshot_id", "rule_id", "condition_type",
        category(F.col("condition_type")).alias("category"),
        "severity",
        F.concat(F.lit("Alert: "), "condition_type").alias("title"),
        pair.alias("affected"),
        F.when(listed, pair).otherwise("").alias("affected_raw"),
        F.col("callsign").alias("primary_callsign"),
        "explanation",
        F.lit("Review instruction").alias("suggested_action"),
    )


def summary(instructions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert counts per instruction, zero rows included."""
    per = alerts.groupBy("target_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("severity") == "CRITICAL").alias("crit")
    )
    return instructions.join(per, "target_id", "left").select(
        *instructions.columns,
        F.coalesce("n", F.lit(0)).alias("alert_count"),
        F.coalesce("crit", F.lit(False)).alias("has_critical"),
    )


def decision(has_critical: Column) -> Column:
    return F.when(has_critical, "ROLLBACK").otherwise("COMMIT")


def applied(has_critical: Column, has_conflict: Column) -> Column:
    """A commit is refused while the look-ahead holds a conflict; the decision text stays COMMIT."""
    return ~has_critical & ~has_conflict


def primary_violation(violations: DataFrame, by: str = "target_id", order: str = "ord") -> DataFrame:
    """Most severe violation, first one on ties."""
    return latest(violations, [by], [-severity_rank(F.col("severity")), order], keep="first")


def alert_flags(alerts: DataFrame) -> DataFrame:
    sev = F.col("severity")
    return alerts.withColumns(
        {
            "is_critical": sev == "CRITICAL",
            "is_immediate": sev.isin("CRITICAL", "HIGH"),
            "is_resolved": F.coalesce(F.col("commit_decision").isin("COMMIT", "ROLLBACK"), F.lit(False))
            | F.col("acknowledged"),
        }
    )


def is_safe(status: Column, severity: Column) -> Column:
    """A result is safe when OK, or a warning whose alert is not critical."""
    return (status == "OK") | ((status == "WARNING") & severity.isNotNull() & (severity != "CRITICAL"))


def decision_updates(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Alerts with their latest decision and acknowledgement from an update log (alert_id, seq, kind, reason)."""
    acked = F.max(F.when(F.col("kind") == "ACK", 1).otherwise(0)) == 1
    is_decision = F.when(F.col("kind").isin("COMMIT", "ROLLBACK"), F.col("seq"))
    last = updates.groupBy("alert_id").agg(
        acked.alias("acknowledged"),
        F.max_by("kind", is_decision).alias("commit_decision"),
        F.max_by("reason", F.when((F.col("kind") == "COMMIT") & F.col("reason").isNotNull(), F.col("seq"))).alias(
            "force_reason"
        ),
    )
    return alerts.join(last, "alert_id", "left").withColumns(
        {
            "acknowledged": F.coalesce("acknowledged", F.lit(False)),
            "force_committed": F.col("force_reason").isNotNull(),
        }
    )


def readback_misses(instructions: DataFrame) -> DataFrame:
    """Pilot replies to a descent that do not repeat the assigned altitude."""
    target = F.coalesce("target_altitude", F.lit(0))
    return instructions.where(
        (F.col("itype") == "descent")
        & (F.lower("speaker") == "pilot")
        & (target > 0)
        & ~F.col("raw_text").contains(target.cast("string"))
    ).withColumn("severity", F.lit("MEDIUM"))
