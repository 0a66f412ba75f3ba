"""Queries on streams, and on reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import claims as K
from labelloom.operators.rules import RULE_ROWS
from labelloom.operators.timeline import MOVES, recommendations
from labelloom.plans.facts import SCORES
from labelloom.plans.facts import SQL as FACTS_SQL
from labelloom.plans.joins import CLAIMS, _claims
from labelloom.plans.labels import CHECKS
from labelloom.plans.registry import Registry
from labelloom.sources import exports as X
from labelloom.sources.shared import new_path
from labelloom.sources.views import frame, with_views
from labelloom.streaming import jobs as J
from labelloom.streaming import timed as T

QUERIES, SQL, query = Registry.new()


def _events(spark, d):
    return J.stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("k01_limiter")
def k01(spark, d):
    e = _events(spark, d).filter("event_type IN ('error', 'signup')").select("event_id", F.col("user_id").alias("key"), "ts", (F.col("event_type") == "error").alias("failure"), (F.col("event_type") == "signup").alias("success"))
    return J.replayed(T.limiter(e, 6 * 3600, 5), new_path(spark, "k01"), **T.SETTINGS)


SQL["k01_limiter"] = FACTS_SQL["g11_attempts"]


#: Expiry as timers tell it, in milliseconds against the watermark, which ends at the last event.
@query("k02_cache", """SELECT event_id, identifier_type, identifier_value, cached_at, ttl * 3600 AS ttl, (epoch_us(cached_at) + ttl * 3600000000 + 999) // 1000 <= (SELECT max(epoch_us(cached_at)) // 1000 FROM cache_rows) AS expired FROM cache_rows
QUALIFY row_number() OVER (PARTITION BY identifier_type, identifier_value ORDER BY cached_at DESC, event_id DESC) = 1""", ("cache_rows",))  # fmt: skip
def k02(spark, d):
    rows = _events(spark, d).select("event_id", F.col("event_type").alias("identifier_type"), (F.col("user_id") % 100).cast("string").alias("identifier_value"), F.col("ts").alias("cached_at"), (3600 * F.floor(F.coalesce("value", F.lit(0.0)))).cast("long").alias("ttl"))
    out = J.replayed(T.cache(rows), new_path(spark, "k02"), **T.SETTINGS)
    last = F.max_by(F.struct("event_id", "cached_at", "ttl", "expired"), F.struct("cached_at", "event_id", "expired")).alias("__c")
    return out.groupBy("identifier_type", "identifier_value").agg(last).select("identifier_type", "identifier_value", "__c.*")


@query("k03_review_workflow")
def k03(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "PENDING_REVIEW").when(kind == "click", "UNDER_REVIEW").when(kind == "purchase", "VERIFIED_COMPLIANT").when(kind == "error", "RESCAN_REQUESTED").otherwise("VERIFIED_NON_COMPLIANT")
    log = _events(spark, d).select("event_id", F.col("user_id").alias("review_id"), "ts", status.alias("status"))
    out = J.replayed(T.review_workflow(log), new_path(spark, "k03"), parts={"accepted": "legal", "rejected": "NOT legal"}, **T.SETTINGS)
    return out["accepted"].withColumn("place", F.lit("accepted")).unionByName(out["rejected"].withColumn("place", F.lit("rejected")))


_LEGAL = " OR ".join(f"(r.state = '{a}' AND s.status IN ({', '.join(repr(x) for x in to)}))" for a, to in MOVES.items() if to)
SQL["k03_review_workflow"] = with_views(
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts, event_id) AS rn FROM reviews_log),
r AS (SELECT review_id, rn, event_id, status, CAST(NULL AS VARCHAR) AS before, true AS legal, status AS state FROM s WHERE rn = 1 UNION ALL
  SELECT s.review_id, s.rn, s.event_id, s.status, r.state, r.state = s.status OR {_LEGAL}, CASE WHEN r.state = s.status OR {_LEGAL} THEN s.status ELSE r.state END FROM r JOIN s ON s.review_id = r.review_id AND s.rn = r.rn + 1)
SELECT event_id, review_id, status, before, legal, CASE WHEN legal THEN 'accepted' ELSE 'rejected' END AS place FROM r""",
    "reviews_log",
)


@query("k04_screening", f"""WITH {CHECKS}, n AS (SELECT label_id, count(*) FILTER (WHERE r.status <> 'NOT_APPLICABLE') AS applicable, count(*) FILTER (WHERE r.status = 'PASS') AS passed, count(*) FILTER (WHERE r.status = 'FAIL') AS failed, count(*) FILTER (WHERE r.status = 'WARNING') AS warned FROM c GROUP BY 1)
SELECT label_id, count(*) AS n, CAST(min(passed) AS BIGINT) AS passed, CAST(min(failed) AS BIGINT) AS failed FROM c JOIN n USING (label_id) GROUP BY 1""", ("label_truth",))  # fmt: skip
def k04(spark, d):
    labels = frame(spark, d, "label_text")
    path = new_path(spark, "k04")
    labels.write.parquet(f"{path}/labels")
    stream = spark.readStream.schema(labels.schema).parquet(f"{path}/labels")
    out = J.replayed(stream, path, each=J.screening)
    return out.groupBy("label_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"))


_SEVERE = ", ".join(f"'{r[0]}'" for r in RULE_ROWS if r[4] in ("high", "critical"))


#: Scores, risks and checks of labels as they arrive, half of the files a batch, appended by the number of the batch.
@query("k04_scores", f"""WITH {CHECKS}, checks AS (SELECT label_id AS screening_id, r.rule_id AS rule_id, r.status AS status, CASE WHEN r.rule_id IN ({_SEVERE}) THEN 'high' ELSE 'low' END AS severity FROM c), {SCORES},
n AS (SELECT screening_id, string_agg(rule_id || '=' || status, ',' ORDER BY rule_id) AS checks FROM checks GROUP BY 1)
SELECT risks.screening_id AS label_id, score, risks.status AS status, risk_level, risk_score, n.checks AS checks FROM risks JOIN n ON n.screening_id = risks.screening_id""", ("label_truth",))  # fmt: skip
def k04_scores(spark, d):
    labels = frame(spark, d, "label_text")
    path = new_path(spark, "k04-scores")
    labels.write.parquet(f"{path}/labels")
    files = len(spark.read.schema(labels.schema).parquet(f"{path}/labels").inputFiles())
    stream = spark.readStream.schema(labels.schema).option("maxFilesPerTrigger", (files + 1) // 2).parquet(f"{path}/labels")
    out = J.replayed(stream, path, each=J.scored_screening)
    return out.withColumn("checks", F.array_join(F.transform("checks", lambda c: F.concat(c["rule_id"], F.lit("="), c["status"])), ","))


@query("k05_daily_trend", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def k05(spark, d):
    return J.replayed(J.daily_trend(_events(spark, d)), new_path(spark, "k05"), "update", last=("day",))


@query("a01_a02_read_screenings", """SELECT screening_id AS id, CASE WHEN screening_id % 10 = 0 THEN 0 WHEN screening_id % 10 = 1 THEN 3 ELSE count(*) FILTER (WHERE status = 'PASS') END AS passed,
CASE WHEN screening_id % 10 < 2 THEN 0 ELSE count(*) FILTER (WHERE status = 'FAIL') END AS failed, CASE WHEN screening_id % 10 < 2 THEN 0 ELSE count(*) END AS n FROM rule_checks GROUP BY 1""", ("rule_checks",))  # fmt: skip
def a01(spark, d):
    c = frame(spark, d, "rule_checks").groupBy(F.col("screening_id").alias("id")).agg(F.collect_list(F.struct("rule_id", "status", "severity")).alias("checks"))
    text = F.when(F.col("id") % 10 == 0, "{broken").when(F.col("id") % 10 == 1, '{"passed_rules": 3}').otherwise(F.to_json(F.struct("checks")))
    path = new_path(spark, "a01")
    c.select("id", text.alias("compliance_result")).write.parquet(path)
    s = X.read_screenings(spark, path)
    n = X.checks_of(s).groupBy("id").agg(F.count("*").alias("n"))
    return s.select("id", "passed", "failed").join(n, "id", "left").na.fill(0, ["n"])


@query("a07_write_findings", f"WITH {CLAIMS} SELECT label_id, claim, status, confidence, hits AS evidence FROM f", ("label_truth",))
def a07(spark, d):
    path = new_path(spark, "a07")
    _claims(spark, d).write.parquet(f"{path}/assessments")
    findings, edges = K.split_findings(spark.read.parquet(f"{path}/assessments"))
    X.write_findings(findings, edges, path)
    again = lambda df: df.filter("label_id % 2 = 0")
    X.write_findings(again(findings), again(edges), path)  # replaces half of what is stored
    e = spark.read.parquet(f"{path}/evidence").groupBy("label_id", "claim_id").agg(F.array_join(F.array_sort(F.collect_list("evidence_text")), ",").alias("evidence"))
    return spark.read.parquet(f"{path}/findings").join(e, ["label_id", "claim_id"], "left").select("label_id", "claim", "status", "confidence", "evidence")


@query("a08_a10_export_csv", """SELECT 'summary' AS section, CAST(id AS VARCHAR) AS id, '0' AS ordinal, 'product' AS name, product_name AS value FROM screenings UNION ALL SELECT 'summary', CAST(id AS VARCHAR), '1', 'score', CAST(score AS VARCHAR) FROM screenings
UNION ALL SELECT 'rules', CAST(screening_id AS VARCHAR), rule_id, field_label, status FROM checks
UNION ALL SELECT 'review', CAST(review_id AS VARCHAR), '0', officer, status FROM reviews
UNION ALL SELECT 'claims', CAST(label_id AS VARCHAR), 'CLM-001', claim, coalesce(claim_rule, 'none') FROM label_truth WHERE claim IS NOT NULL""", ("screenings", "checks", "reviews", "label_truth"))  # fmt: skip
def a08(spark, d):
    path = new_path(spark, "a08")
    checks = frame(spark, d, "checks")
    rules = K.claim_rules(spark)
    text = frame(spark, d, "label_text")
    claims = K.numbered(K.find_claims(text, rules).unionByName(K.open_claims(text, rules)))
    sections = X.report_sections(frame(spark, d, "screenings"), checks, recommendations(checks), frame(spark, d, "reviews"), claims)
    X.export_csv(sections, path)
    return spark.read.option("header", True).csv(path).filter("section <> 'actions'").select("section", "id", "ordinal", "name", "value")


@query("a09_a11_export_json", "SELECT version_a, version_b, score_a, score_b FROM pairs", ("pairs",))
def a09(spark, d):
    path = new_path(spark, "a09")
    X.export_comparison(frame(spark, d, "pairs"), path, "json")
    return spark.read.schema("version_a long, version_b long, score_a double, score_b double").json(path)
