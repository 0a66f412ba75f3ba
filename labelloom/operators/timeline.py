"""Order and state in time: transitions, sliding windows, hash chains, timelines; and issue rows of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Legal moves of a review.
MOVES = {
    "PENDING_REVIEW": ("UNDER_REVIEW", "RESCAN_REQUESTED"),
    "UNDER_REVIEW": ("VERIFIED_COMPLIANT", "VERIFIED_NON_COMPLIANT", "RESCAN_REQUESTED"),
    "RESCAN_REQUESTED": ("PENDING_REVIEW", "UNDER_REVIEW"),
    "VERIFIED_COMPLIANT": ("UNDER_REVIEW",),
    "VERIFIED_NON_COMPLIANT": ("UNDER_REVIEW",),
}


def legal(before: Column, after: Column) -> Column:
    """Whether a review may move so; a first state and staying are legal."""
    ok = before.isNull() | (before == after)
    for a, b in MOVES.items():
        ok = ok | ((before == a) & after.isin(*b))
    return F.coalesce(ok, F.lit(False))


def transitions(log: DataFrame) -> DataFrame:
    """Each state of a review with the one before and after, and whether the move is legal."""
    w = W.partitionBy("review_id").orderBy("ts", "event_id")
    out = log.select("event_id", "review_id", "status", F.lag("status").over(w).alias("before"), F.lead("status").over(w).alias("next"))
    return out.withColumn("legal", legal(F.col("before"), F.col("status")))


def sliding_attempts(attempts: DataFrame, seconds: int, most: int) -> DataFrame:
    """For each failure the failures of its key in the window before it, since the last success; blocked from ``most`` on.

    The window excludes its far end. attempts: event_id, key, ts, failure, success.
    """
    order = W.partitionBy("key").orderBy("ts", "event_id")
    epoch = F.coalesce(F.sum(F.col("success").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = W.partitionBy("key", "epoch").orderBy(F.unix_micros("ts")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = attempts.withColumn("epoch", epoch).withColumn("failures", F.count_if("failure").over(near))
    return counted.filter("failure").select("event_id", "key", "ts", "failures", (F.col("failures") >= most).alias("blocked"))


def event_hash(previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, F.col("event_type"), F.col("actor"), F.col("created_at")), 256)


BUCKET = 1000


def verify_chain(log: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Verdict on hash-chained logs: log, event_id, prev_hash, event_hash, event_type, actor, created_at.

    A link needs its own row and the hash before it. Rows look back inside buckets
    of ids, and each bucket's first row is joined to the last of the bucket before,
    so no task holds a whole log. A row for each log: links, broken ones, first
    broken id, why.
    """
    b = log.withColumn("b", F.floor(F.col("event_id") / bucket))
    w = W.partitionBy("log", "b").orderBy("event_id")
    rows = b.select("*", F.lag("event_hash").over(w).alias("own"), F.row_number().over(w).alias("rn"))
    ends = b.groupBy("log", "b").agg(F.max_by("event_hash", "event_id").alias("end"))
    before = ends.select("log", "b", F.lag("end").over(W.partitionBy("log").orderBy("b")).alias("end"))  # a thousandth of the rows
    joined = rows.join(before, ["log", "b"]).withColumn("expected", F.coalesce(F.when(F.col("rn") > 1, F.col("own")).otherwise(F.col("end")), F.lit("GENESIS")))
    why = F.when(F.col("prev_hash") != F.col("expected"), "PREVIOUS_HASH").when(event_hash(F.col("prev_hash")) != F.col("event_hash"), "EVENT_HASH")
    at = F.when(F.col("why").isNotNull(), F.col("event_id"))
    return joined.withColumn("why", why).groupBy("log").agg(F.count("*").alias("links"), F.count("why").alias("broken"), F.min(at).alias("first_broken"), F.min_by("why", at).alias("reason"))


def chained_fixture(events: DataFrame) -> DataFrame:
    """A hash-chained log for each user, with some actors and previous hashes changed afterwards."""
    rows = events.select(
        F.col("user_id").alias("log"), "event_id", "event_type", F.col("user_id").cast("string").alias("actor"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("created_at")
    )
    per_log = rows.groupBy("log").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "actor", "created_at"))).alias("e"))
    kind = "array<struct<event_id:bigint,event_type:string,actor:string,created_at:string,prev_hash:string,event_hash:string>>"

    def link(done: Column, x: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["event_hash"], F.lit("GENESIS"))
        own = F.sha2(F.concat_ws("|", before, x["event_type"], x["actor"], x["created_at"]), 256)
        return F.array_append(done, F.struct(x["event_id"], x["event_type"], x["actor"], x["created_at"], before.alias("prev_hash"), own.alias("event_hash")))

    log = per_log.select("log", F.inline(F.aggregate("e", F.array().cast(kind), link)))
    i = F.col("event_id")
    return log.withColumns({"actor": F.when(i % 1000 == 7, F.concat("actor", F.lit("x"))).otherwise(F.col("actor")), "prev_hash": F.when(i % 1500 == 8, "none").otherwise(F.col("prev_hash"))})


def timeline(screenings: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Screenings and comparisons of products as one kind of event."""
    s = screenings.select("product_key", F.lit("SCREENING").alias("kind"), F.col("id").cast("string").alias("ref"), F.col("created_at").alias("at"), "score")
    at = screenings.select(F.col("id").alias("version_b"), F.col("created_at").alias("at"))
    c = comparisons.join(at, "version_b").select("product_key", F.lit("COMPARISON").alias("kind"), F.concat_ws("-", "version_a", "version_b").alias("ref"), "at", (F.col("score_b") - F.col("score_a")).alias("score"))
    return s.unionByName(c)


def comparable(screenings: DataFrame, artworks: DataFrame, limit: int) -> DataFrame:
    """Screenings and artworks that can be compared, newest first."""
    s = screenings.select(F.lit("SCREENING").alias("kind"), F.col("id").cast("string").alias("ref"), "organization", "created_at", "score")
    return s.unionByName(artworks.select(*s.columns)).orderBy(F.desc("created_at"), "ref").limit(limit)


def outcomes_by_month(found: DataFrame) -> DataFrame:
    """Counts of outcome and of three risk grades by organization and month."""
    from labelloom.operators.dashboards import legacy_risk

    s = F.col("score")
    return found.select(
        "organization",
        F.date_format("created_at", "yyyy-MM").alias("month"),
        "outcome",
        legacy_risk(F.lit(None).cast("string"), F.col("failed"), F.col("review"), s).alias("legacy_risk"),
        F.when(s < 60, "CRITICAL").when(s < 80, "HIGH").when(s < 90, "MEDIUM").otherwise("LOW").alias("handover_risk"),
        F.when(s >= 90, "LOW").when(s >= 70, "MEDIUM").otherwise("CRITICAL").alias("artwork_risk"),
    ).groupBy("organization", "month", "outcome", "legacy_risk", "handover_risk", "artwork_risk").agg(F.count("*").alias("n"))


def issues(checks: DataFrame) -> DataFrame:
    """An issue row of each failed, warned or thinly evidenced check."""
    s, label = F.col("status"), F.col("field_label")
    text = F.when(s == "FAIL", F.concat(label, F.lit(" is missing or invalid"))).when(s == "WARNING", F.concat(label, F.lit(" needs attention"))).otherwise(F.concat(label, F.lit(" has too little evidence")))
    return checks.filter(s.isin("FAIL", "WARNING", "INSUFFICIENT_EVIDENCE")).select("screening_id", "line", "rule_id", "field", "severity", "status", text.alias("issue"))


def recommendations(checks: DataFrame) -> DataFrame:
    """Priority, action and step of each check by its status and rule."""
    s, label = F.col("status"), F.col("field_label")
    none = s.isin("PASS", "NOT_APPLICABLE")
    return checks.select(
        "screening_id", "line", "rule_id", "status",
        F.when(s == "FAIL", "HIGH").when(none, "INFO").otherwise("MEDIUM").alias("priority"),
        F.when(s == "FAIL", "CORRECT_LABEL").when(none, "NO_ACTION").otherwise("VERIFY").alias("action"),
        F.when(s == "FAIL", F.concat(F.lit("Print "), label, F.lit(" on the label"))).when(none, "None").otherwise(F.concat(F.lit("Verify "), label, F.lit(" on the package"))).alias("step"),
    )


def distinct_lists(checks: DataFrame) -> DataFrame:
    return checks.groupBy("screening_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def checks_in_order(checks: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("rule_id", "status")))
    return checks.groupBy("screening_id").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["rule_id"], F.lit("="), x["status"])), " ").alias("checks"))
