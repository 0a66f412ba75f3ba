"""Counts and summaries of screenings, checks, reviews and caches, per tenant where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAILED = ("FAIL", "NON_COMPLIANT", "FAILED")
REVIEW = ("NEEDS_REVIEW", "WARNING", "REVIEW_REQUIRED", "REVIEW")
PASSED = ("PASS", "COMPLIANT", "PASSED")
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def outcome(failed: Column, review: Column, passed: Column, status: Column) -> Column:
    """FAILURE, NEEDS_REVIEW or COMPLIANT: by finding counts, then by status text; the score never decides."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(failed > 0, "FAILURE")
        .when(review > 0, "NEEDS_REVIEW")
        .when(passed > 0, "COMPLIANT")
        .when(s.contains("FAIL") | s.contains("NON_COMPLIANCE") | s.contains("NON-COMPLIANCE"), "FAILURE")
        .when(s.contains("REVIEW") | s.contains("WARNING"), "NEEDS_REVIEW")
        .when(s.contains("COMPLIANT") | s.contains("PASS"), "COMPLIANT")
        .otherwise("NEEDS_REVIEW")
    )


def legacy_risk(level: Column, failed: Column, review: Column, score: Column) -> Column:
    """The stored level, else the older rule with its odd order: two failures HIGH, one CRITICAL."""
    return F.coalesce(F.upper(level), F.when(failed >= 2, "HIGH").when(failed == 1, "CRITICAL").when(review > 0, "MEDIUM").when(score >= 90, "LOW").otherwise("MEDIUM"))


def finding_counts(checks: DataFrame) -> DataFrame:
    s = F.upper("status")
    return checks.groupBy(F.col("screening_id").alias("id")).agg(F.count_if(s.isin(*FAILED)).alias("failed"), F.count_if(s.isin(*REVIEW)).alias("review"), F.count_if(s.isin(*PASSED)).alias("passed"))


def with_findings(screenings: DataFrame, checks: DataFrame) -> DataFrame:
    """Screenings with finding counts, 0 where there are no checks, and their outcome."""
    out = screenings.join(finding_counts(checks), "id", "left").na.fill(0, ["failed", "review", "passed"])
    return out.withColumn("outcome", outcome(F.col("failed"), F.col("review"), F.col("passed"), F.col("status")))


def dashboard(screenings: DataFrame, checks: DataFrame, *by: str) -> DataFrame:
    """Packages, compliant packages, failed and review findings, mean score."""
    return with_findings(screenings, checks).groupBy(*by).agg(
        F.count("*").alias("packages"),
        F.count_if(F.col("outcome") == "COMPLIANT").alias("compliant"),
        F.sum("failed").cast("long").alias("failed_findings"),
        F.sum("review").cast("long").alias("review_findings"),
        F.round(F.avg("score"), 4).alias("average_score"),
    )


def by_status(screenings: DataFrame) -> DataFrame:
    return screenings.groupBy("status").agg(F.count("*").alias("n"))


def daily_trend(screenings: DataFrame, as_of: str, days: int) -> DataFrame:
    """Counts of each of the days that end with as_of, zero where there are none."""
    spark = screenings.sparkSession
    end = F.lit(as_of).cast("date")
    calendar = spark.range(days).select(F.date_sub(end, F.col("id").cast("int")).alias("day"))
    seen = screenings.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLIANT").alias("compliant"), F.sum("score").alias("sum"))
    out = calendar.join(seen, "day", "left").na.fill(0, ["total", "compliant"])
    return out.select("day", "total", "compliant", (F.col("total") - F.col("compliant")).alias("violations"), F.round(F.coalesce(F.col("sum") / F.col("total"), F.lit(0.0)), 1).alias("average_score"))


def risk_distribution(screenings: DataFrame, scores: DataFrame, *by: str) -> DataFrame:
    """Packages in each risk level and status, mean score and mean risk. scores: the rows of scoring.scores."""
    s = scores.select(F.col("screening_id").alias("id"), "risk_level", "failed", (F.col("needs_review") + F.col("warnings")).alias("review"), F.col("score").alias("engine_score"))
    known = F.coalesce(F.upper("risk_level"), F.lit("MEDIUM"))
    n = F.count("*")
    grouped = screenings.join(s, "id").groupBy(*by).agg(
        n.alias("total"),
        *(F.count_if((known == v) if v != "MEDIUM" else ~known.isin("CRITICAL", "HIGH", "LOW")).alias(f"{v.lower()}_count") for v in LEVELS),
        F.count_if(F.col("failed") > 0).alias("failure_count"),
        F.count_if((F.col("failed") == 0) & (F.col("review") > 0)).alias("review_count"),
        F.count_if((F.col("failed") == 0) & (F.col("review") == 0)).alias("compliant_count"),
        F.round(F.sum(F.col("engine_score").cast("decimal(10,1)")) / n, 2).cast("double").alias("average_score"),
    )
    pct = lambda v: F.round(100 * F.col(f"{v.lower()}_count").cast("decimal(20,0)") / F.col("total"), 1).cast("double").alias(f"{v.lower()}_pct")
    return grouped.select("*", F.round(F.lit(100).cast("decimal(10,2)") - F.col("average_score").cast("decimal(10,2)"), 1).cast("double").alias("average_risk"), *map(pct, LEVELS))


def review_summary(reviews: DataFrame) -> DataFrame:
    """Counters of a review queue in one row."""
    s, r = F.col("status"), F.col("risk_level")
    open_ = ~s.startswith("VERIFIED")
    return reviews.agg(
        F.count("*").alias("total"), F.count_if(s == "PENDING_REVIEW").alias("pending"), F.count_if(s == "UNDER_REVIEW").alias("under_review"), F.count_if(s == "RESCAN_REQUESTED").alias("rescan"),
        F.count_if(s.startswith("VERIFIED")).alias("verified"), F.count_if(open_ & (r == "CRITICAL")).alias("critical_open"), F.count_if(open_ & (r == "HIGH")).alias("high_open"),
    )


def workload(officers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Assigned, open and verified reviews of every officer, zero where there are none."""
    n = reviews.groupBy(F.lower("officer").alias("__o")).agg(F.count("*").alias("assigned"), F.count_if(F.col("status").startswith("VERIFIED")).alias("verified"))
    out = officers.join(n, F.lower(officers["officer"]) == F.col("__o"), "left").na.fill(0, ["assigned", "verified"])
    return out.select(*officers.columns, "assigned", (F.col("assigned") - F.col("verified")).alias("open"), "verified")


def cache_statistics(cache: DataFrame, now: str) -> DataFrame:
    """Rows, active and expired ones of each type in one pass. cache: one row a key."""
    from labelloom.operators.selection import expires

    live = expires() > F.lit(now).cast("timestamp")
    return cache.groupBy("identifier_type").agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("expired"))


#: Weight of a violation by severity.
SEVERITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}


def penalties(violations: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Estimated fine and its range per screening. violations: screening_id, severity. prior: screening_id, notices."""
    w = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY_WEIGHT.items()), F.lit(1))
    v = violations.groupBy("screening_id").agg(F.count("*").alias("violations"), F.sum(w).alias("weighted"), F.bool_or(F.col("severity") == "high").alias("severe"))
    v = v.join(prior, "screening_id", "left").na.fill(0, ["notices"]) if prior is not None else v.withColumn("notices", F.lit(0))
    n, s = F.col("violations"), F.col("weighted")
    again = F.col("notices") > 0
    base = F.when(again, 10000 + s * 2000 + n * 1500).when(F.col("severe"), 5000 + s * 1500 + n * 1000).otherwise(2000 + s * 1000 + n * 500)
    fine = F.least(base, F.when(again, 50000).otherwise(25000)).cast("long")
    return v.select("screening_id", "violations", "weighted", again.alias("repeat_offence"), fine.alias("fine"), F.greatest(F.lit(1000), F.floor(fine / 2)).cast("long").alias("fine_least"))


def show_cause(screenings: DataFrame, violations: DataFrame) -> DataFrame:
    """A notice's numbered list of violations per screening. violations: screening_id, rule_id, field_label, severity."""
    rows = F.sort_array(F.collect_list(F.struct("rule_id", "field_label", "severity")))
    v = violations.groupBy(F.col("screening_id").alias("id")).agg(F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["rule_id"], F.lit("] "), x["field_label"], F.lit(" ("), x["severity"], F.lit(")"))), "\n").alias("items"))
    return screenings.join(v, "id").select("id", F.concat(F.lit("Show cause: "), F.col("product_name"), F.lit("\n"), F.col("items")).alias("notice"))


def critical_reasons(checks: DataFrame) -> DataFrame:
    """Severe failures of each screening: how many, and their labels in rule order."""
    c = checks.filter((F.col("status") == "FAIL") & F.lower("severity").isin("high", "critical"))
    return c.groupBy("screening_id").agg(F.count("*").alias("critical_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule_id", "field_label"))), lambda x: x["field_label"]), "; ").alias("reasons"))


#: Rules whose evidence belongs on the front panel.
FRONT_RULES = ("LM-002", "LM-003", "LM-004", "FS-001", "FS-002")


def panel_zones(checks: DataFrame) -> DataFrame:
    """Checks of the front and information panels of each screening and the panel's status."""
    zone = F.when(F.col("rule_id").isin(*FRONT_RULES), "FRONT").otherwise("INFORMATION")
    g = checks.groupBy("screening_id", zone.alias("zone")).agg(
        F.count("*").alias("rules"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status").isin("WARNING", "NEEDS_REVIEW", "INSUFFICIENT_EVIDENCE")).alias("review"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"),
    )
    return g.withColumn("status", F.when(F.col("failed") > 0, "NON_COMPLIANT").when(F.col("review") > 0, "REVIEW_REQUIRED").otherwise("COMPLIANT"))


def risk_trend(screenings: DataFrame, key: str = "product_key", step: float = 3) -> DataFrame:
    """Each product's last score against the one before."""
    w = W.partitionBy(key).orderBy("created_at", "id")
    rows = screenings.select("*", F.lag("score").over(w).alias("before"), F.row_number().over(W.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))).alias("rn")).filter("rn = 1")
    d = F.col("score") - F.col("before")
    return rows.select(key, F.col("id").alias("last_id"), F.col("score").alias("current"), "before", F.when(d >= step, "IMPROVING").when(d <= -step, "DEGRADING").otherwise("STABLE").alias("trend"))


def version_sequence(timeline: DataFrame, key: str = "product_key") -> DataFrame:
    """Versions of each product numbered in time, with the change of score."""
    w = W.partitionBy(key).orderBy("created_at", "id")
    return timeline.select(key, "id", F.row_number().over(w).alias("version"), "score", (F.col("score") - F.lag("score").over(w)).alias("score_delta"))


def initial_reviews(screenings: DataFrame, scores: DataFrame, existing: DataFrame) -> DataFrame:
    """Review rows for screenings that have none: snapshot, hand-over risk by score."""
    new = screenings.join(existing.select("id"), "id", "left_anti").join(scores.select(F.col("screening_id").alias("id"), F.col("score").alias("engine_score"), "failed", F.col("risk_level").alias("engine_risk")), "id")
    s = F.col("engine_score")
    return new.select("id", F.lit("PENDING_REVIEW").alias("status"), s.alias("ai_score"), F.when(s < 60, "CRITICAL").when(s < 80, "HIGH").when(s < 90, "MEDIUM").otherwise("LOW").alias("risk_level"), "engine_risk", F.col("failed").alias("failed_rules"))


def queue_order(reviews: DataFrame, as_of: str, limit: int) -> DataFrame:
    """Reviews by risk, then age in hours (one decimal, never negative), both highest first."""
    weight = F.coalesce(*(F.when(F.col("risk_level") == v, 4 - i) for i, v in enumerate(LEVELS)), F.lit(0))
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("updated_at")
    age = F.greatest(F.lit(0.0), F.round(seconds / 3600, 1))
    return reviews.select("review_id", "status", "risk_level", weight.alias("weight"), age.alias("age_hours")).orderBy(F.desc("weight"), F.desc("age_hours"), "review_id").limit(limit)


def review_ages(reviews: DataFrame, as_of: str) -> DataFrame:
    """Reviews of each officer by age band."""
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("updated_at")) / 3600)
    band = F.when(hours < 24, "under 1 day").when(hours < 168, "under 1 week").when(hours < 720, "under 30 days").otherwise("older")
    return reviews.groupBy("officer", band.alias("band")).agg(F.count("*").alias("n"), F.max(F.round(hours, 1)).alias("oldest_hours"))
