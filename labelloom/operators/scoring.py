"""Scores, risk and confidence of screenings from their checks.

checks: screening_id, rule_id, field, field_label, domain, severity, status,
reliability. conflicts: screening_id, conflict_type. Points are kept in
hundredths, so one-decimal scores round exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights in hundredths and thresholds of scoring version 2026.1.
CONFIG = {"pass": 100, "warning": 50, "needs_review": 85, "insufficient": 50, "fail": 0, "critical_at": 1, "high_at": 2, "review_at": 2}


def config_frame(spark, **changes: int) -> DataFrame:
    """A scoring configuration as a one-row table; unionByName of several gives a what-if over many."""
    row = CONFIG | changes
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()))


def is_(status: str) -> Column:
    return F.col("status") == status


def points(cfg: dict[str, int] = CONFIG) -> Column:
    """Hundredths of a point that a check earns; null if not applicable."""
    return (
        F.when(is_("PASS"), cfg["pass"])
        .when(is_("WARNING"), cfg["warning"])
        .when(is_("NEEDS_REVIEW"), cfg["needs_review"])
        .when(is_("INSUFFICIENT_EVIDENCE"), cfg["insufficient"])
        .when(is_("FAIL"), cfg["fail"])
    )


def one_decimal(hundredths: Column, n: Column) -> Column:
    """hundredths / n, rounded half up to one decimal."""
    return F.floor((20 * hundredths + n) / (2 * n)) / 10


def rule_points(checks: DataFrame, cfg: dict[str, int] = CONFIG) -> DataFrame:
    """Points, most points and risk contribution of each check."""
    severe = F.lower("severity").isin("high", "critical")
    risk = (
        F.when(is_("NOT_APPLICABLE"), "NONE")
        .when(is_("PASS"), F.when((F.col("reliability") > 0) & (F.col("reliability") < 60), "LOW").otherwise("NONE"))
        .when(is_("FAIL"), F.when(severe, "CRITICAL").otherwise("HIGH"))
        .otherwise("MEDIUM")
    )
    return checks.select(
        *checks.columns,
        (F.coalesce(points(cfg), F.lit(0)) / 100).alias("earned"),
        F.when(is_("NOT_APPLICABLE"), 0.0).otherwise(1.0).alias("most"),
        risk.alias("risk_contribution"),
    )


def check_counts(checks: DataFrame, *keys: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Counters by status for each key; insufficient evidence counts as review too. more: aggregates of the same checks, by name."""
    n = lambda c: F.count_if(c).alias
    severe = F.lower("severity").isin("high", "critical")
    return checks.groupBy(*keys).agg(
        F.count("*").alias("total"),
        n(~is_("NOT_APPLICABLE"))("applicable"),
        n(is_("PASS"))("passed"),
        n(is_("FAIL"))("failed"),
        n(is_("WARNING"))("warnings"),
        n(is_("NEEDS_REVIEW") | is_("INSUFFICIENT_EVIDENCE"))("needs_review"),
        n(is_("INSUFFICIENT_EVIDENCE"))("insufficient"),
        n(is_("NOT_APPLICABLE"))("not_applicable"),
        n(is_("FAIL") & severe)("critical"),
        F.coalesce(F.sum(points()), F.lit(0)).cast("long").alias("earned"),
        *(c.alias(k) for k, c in (more or {}).items()),
    )


def scores(checks: DataFrame, conflicts: DataFrame | None = None, cfg: dict[str, int] = CONFIG, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per screening: score, status, risk level and risk score; then more, aggregates of its checks, by name."""
    c = check_counts(checks, "screening_id", more=more)
    if conflicts is not None:
        found = conflicts.groupBy("screening_id").agg(F.count("*").alias("conflicts"), F.count_if(F.col("conflict_type") == "CHRONOLOGICAL_INCONSISTENCY").alias("chronological"))
        c = c.join(found, "screening_id", "left").na.fill(0, ["conflicts", "chronological"])
    else:
        c = c.withColumns({"conflicts": F.lit(0), "chronological": F.lit(0)})
    score = F.when(F.col("applicable") > 0, one_decimal(F.col("earned"), F.col("applicable"))).otherwise(100.0)
    review = F.col("needs_review") + F.col("warnings") + F.col("conflicts")
    status = (
        F.when(F.col("failed") > 0, "POTENTIAL NON-COMPLIANCE")
        .when(F.col("needs_review") + F.col("warnings") > 0, "REVIEW REQUIRED")
        .when(F.col("score") >= 80, "COMPLIANT")
        .otherwise("REVIEW REQUIRED")
    )
    critical = (F.col("critical") >= cfg["critical_at"]) | (F.col("chronological") > 0)
    high = (F.col("failed") >= cfg["high_at"]) | (F.col("failed") > 0)
    medium = (review >= cfg["review_at"]) | (F.col("insufficient") > 0) | (F.col("conflicts") > 0)
    level = F.when(critical, "CRITICAL").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
    risk = (
        F.when(critical, F.least(F.lit(100.0), 85.0 + F.col("critical") * 5 + F.col("conflicts") * 3))
        .when(high, F.least(F.lit(84.0), 65.0 + F.col("failed") * 6))
        .when(medium, F.least(F.lit(64.0), 35.0 + review * 5))
        .otherwise(F.greatest(F.lit(5.0), F.round(100.0 - F.col("score"), 1)))
    )
    with_score = c.withColumn("score", score)
    return with_score.select(
        "screening_id", "score", status.alias("status"), level.alias("risk_level"), risk.alias("risk_score"), "total", "applicable", "passed", "failed", "warnings",
        "needs_review", "insufficient", "not_applicable", F.col("critical").alias("critical_count"), review.alias("review_count"), *(more or {}),
    )


def category_scores(checks: DataFrame, domains: tuple[str, ...] = ("LEGAL_METROLOGY", "FSSAI")) -> DataFrame:
    """Score and status of each screening in each domain, absent ones included."""
    c = check_counts(checks, "screening_id", "domain")
    every = checks.select("screening_id").distinct().select("screening_id", F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    full = every.join(c, ["screening_id", "domain"], "left").na.fill(0)
    review = F.col("needs_review") + F.col("warnings")
    return full.select(
        "screening_id",
        "domain",
        F.when(F.col("applicable") > 0, one_decimal(F.col("earned"), F.col("applicable"))).otherwise(100.0).alias("score"),
        "total", "applicable", "passed", "failed", review.alias("review"), "not_applicable",
        F.when(F.col("applicable") == 0, "NOT_APPLICABLE").when(F.col("failed") > 0, "NON_COMPLIANT").when(review > 0, "REVIEW_REQUIRED").otherwise("COMPLIANT").alias("status"),
    )


def confidence(checks: DataFrame, extraction: DataFrame | None = None) -> DataFrame:
    """Mean evidence and extraction confidence of each screening and its tier. extraction: screening_id, confidence."""
    e = checks.groupBy("screening_id").agg(F.coalesce(F.round(F.avg(F.when(F.col("reliability") != 0, F.col("reliability"))), 1), F.lit(85.0)).alias("evidence_avg"))
    if extraction is not None:
        x = extraction.groupBy("screening_id").agg(
            F.round(F.avg("confidence"), 1).alias("extraction_avg"), F.count_if(F.col("confidence") >= 75).alias("high_count"), F.count_if(F.col("confidence") < 60).alias("low_count")
        )
        e = e.join(x, "screening_id", "left")
    else:
        e = e.withColumns({"extraction_avg": F.lit(None).cast("double"), "high_count": F.lit(0), "low_count": F.lit(0)})
    e = e.na.fill({"extraction_avg": 85.0, "high_count": 0, "low_count": 0})
    both = F.round(F.col("extraction_avg") * 0.5 + F.col("evidence_avg") * 0.5, 1)
    return e.withColumn("overall", both).withColumn("tier", F.when(F.col("overall") >= 75, "HIGH").when(F.col("overall") >= 55, "MEDIUM").otherwise("LOW"))


def risk_factors(checks: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Risk factors as rows: failures of high severity, other failures, reviews, conflicts."""
    severe = F.lower("severity").isin("high", "critical")
    kinds = (
        F.when(is_("FAIL") & severe, F.struct(F.lit("RF-CRIT-").alias("p"), F.lit("CRITICAL_STATUTORY_FAILURE").alias("t"), F.lit("CRITICAL").alias("s")))
        .when(is_("FAIL"), F.struct(F.lit("RF-FAIL-").alias("p"), F.lit("MISSING_MANDATORY_DECLARATION").alias("t"), F.lit("HIGH").alias("s")))
        .when(is_("WARNING") | is_("NEEDS_REVIEW") | is_("INSUFFICIENT_EVIDENCE"), F.struct(F.lit("RF-REV-").alias("p"), F.lit("DATA_AMBIGUITY").alias("t"), F.lit("MEDIUM").alias("s")))
    )
    out = checks.withColumn("k", kinds).filter("k IS NOT NULL")
    out = out.select("screening_id", F.concat("k.p", "rule_id").alias("factor_id"), F.col("k.t").alias("factor_type"), "rule_id", "field", F.col("k.s").alias("severity"))
    if conflicts is None:
        return out
    t = F.col("conflict_type")
    more = conflicts.select(
        "screening_id", F.concat(F.lit("RF-CONF-"), t).alias("factor_id"), F.lit("RULE_CONFLICT").alias("factor_type"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("field"),
        F.when(t.contains("CHRONOLOGICAL") | t.contains("IMPORT"), "HIGH").otherwise("MEDIUM").alias("severity"),
    )
    return out.unionByName(more)
