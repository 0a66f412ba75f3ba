"""Queries over screenings, checks, reviews, caches and logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import dashboards as D
from labelloom.operators import scoring as S
from labelloom.operators import selection as X
from labelloom.operators import timeline as T
from labelloom.plans.registry import Registry
from labelloom.sources.views import frame

AS_OF_DAY = "2001-08-01"
AS_OF = "2024-01-31 00:00:00"

QUERIES, SQL, query = Registry.new()


def _scores(spark, d):
    return S.scores(frame(spark, d, "checks"))


SCORES = """s AS (SELECT screening_id, count(*) AS total, count(*) FILTER (WHERE status <> 'NOT_APPLICABLE') AS applicable,
  count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARNING') AS warnings,
  count(*) FILTER (WHERE status IN ('NEEDS_REVIEW', 'INSUFFICIENT_EVIDENCE')) AS needs_review, count(*) FILTER (WHERE status = 'INSUFFICIENT_EVIDENCE') AS insufficient,
  count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'high') AS critical_count,
  sum(CASE status WHEN 'PASS' THEN 100 WHEN 'WARNING' THEN 50 WHEN 'NEEDS_REVIEW' THEN 85 WHEN 'INSUFFICIENT_EVIDENCE' THEN 50 ELSE 0 END) AS earned
  FROM checks GROUP BY screening_id),
scores AS (SELECT *, CASE WHEN applicable = 0 THEN 100.0 ELSE floor((20 * earned + applicable) / (2 * applicable)) / 10 END::DOUBLE AS score, warnings + needs_review AS review_count FROM s),
risks AS (SELECT *,
  CASE WHEN failed > 0 THEN 'POTENTIAL NON-COMPLIANCE' WHEN review_count > 0 THEN 'REVIEW REQUIRED' WHEN score >= 80 THEN 'COMPLIANT' ELSE 'REVIEW REQUIRED' END AS status,
  CASE WHEN critical_count >= 1 THEN 'CRITICAL' WHEN failed > 0 THEN 'HIGH' WHEN review_count >= 2 OR insufficient > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN critical_count >= 1 THEN least(100, 85 + 5 * critical_count) WHEN failed > 0 THEN least(84, 65 + 6 * failed)
    WHEN review_count >= 2 OR insufficient > 0 THEN least(64, 35 + 5 * review_count) ELSE greatest(5, round(100 - score, 1)) END::DOUBLE AS risk_score
  FROM scores)"""


@query("i04_risk_distribution", f"""WITH {SCORES}
SELECT organization, count(*) AS total, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_count,
  count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_count, count(*) FILTER (WHERE risk_level = 'LOW') AS low_count,
  count(*) FILTER (WHERE failed > 0) AS failure_count, count(*) FILTER (WHERE failed = 0 AND review_count > 0) AS review_count, count(*) FILTER (WHERE failed = 0 AND review_count = 0) AS compliant_count,
  CAST(floor(sum(CAST(risks.score * 10 + 0.5 AS BIGINT)) * 10 / count(*) + 0.5) / 100 AS DOUBLE) AS average_score,
  CAST(round(CAST(100 AS DECIMAL(10,2)) - CAST(floor(sum(CAST(risks.score * 10 + 0.5 AS BIGINT)) * 10 / count(*) + 0.5) / 100 AS DECIMAL(10,2)), 1) AS DOUBLE) AS average_risk,
  CAST(floor(1000 * count(*) FILTER (WHERE risk_level = 'CRITICAL') / count(*) + 0.5) / 10 AS DOUBLE) AS critical_pct, CAST(floor(1000 * count(*) FILTER (WHERE risk_level = 'HIGH') / count(*) + 0.5) / 10 AS DOUBLE) AS high_pct,
  CAST(floor(1000 * count(*) FILTER (WHERE risk_level = 'MEDIUM') / count(*) + 0.5) / 10 AS DOUBLE) AS medium_pct, CAST(floor(1000 * count(*) FILTER (WHERE risk_level = 'LOW') / count(*) + 0.5) / 10 AS DOUBLE) AS low_pct
FROM screenings JOIN risks ON id = screening_id GROUP BY organization""".replace("risks.score * 10 + 0.5", "round(risks.score * 10)"), ("screenings", "checks"))  # fmt: skip
def i04(spark, d):
    return D.risk_distribution(frame(spark, d, "screenings"), _scores(spark, d), "organization")


@query("i05_i06_i11_i12_scores", f"WITH {SCORES} SELECT screening_id, score, status, risk_level, risk_score, total, applicable, passed, failed, warnings, needs_review, insufficient, not_applicable, critical_count, review_count FROM risks", ("checks",))
def i05(spark, d):
    return _scores(spark, d)


@query("i07_category_scores", """WITH e AS (SELECT DISTINCT screening_id, t.domain FROM checks, (VALUES ('LEGAL_METROLOGY'), ('FSSAI')) t(domain)),
c AS (SELECT screening_id, domain, count(*) AS total, count(*) FILTER (WHERE status <> 'NOT_APPLICABLE') AS applicable, count(*) FILTER (WHERE status = 'PASS') AS passed,
  count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status IN ('WARNING', 'NEEDS_REVIEW', 'INSUFFICIENT_EVIDENCE')) AS review, count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS not_applicable,
  sum(CASE status WHEN 'PASS' THEN 100 WHEN 'WARNING' THEN 50 WHEN 'NEEDS_REVIEW' THEN 85 WHEN 'INSUFFICIENT_EVIDENCE' THEN 50 ELSE 0 END) AS earned FROM checks GROUP BY ALL)
SELECT e.screening_id, e.domain, coalesce(CASE WHEN applicable > 0 THEN floor((20 * earned + applicable) / (2 * applicable)) / 10 END, 100)::DOUBLE AS score, coalesce(total, 0) AS total, coalesce(applicable, 0) AS applicable,
  coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(review, 0) AS review, coalesce(not_applicable, 0) AS not_applicable,
  CASE WHEN coalesce(applicable, 0) = 0 THEN 'NOT_APPLICABLE' WHEN failed > 0 THEN 'NON_COMPLIANT' WHEN review > 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLIANT' END AS status
FROM e LEFT JOIN c USING (screening_id, domain)""", ("checks",))  # fmt: skip
def i07(spark, d):
    return S.category_scores(frame(spark, d, "checks"))


@query("i08_rule_points", """SELECT *, CASE status WHEN 'PASS' THEN 1 WHEN 'WARNING' THEN 0.5 WHEN 'NEEDS_REVIEW' THEN 0.85 WHEN 'INSUFFICIENT_EVIDENCE' THEN 0.5 ELSE 0 END::DOUBLE AS earned,
  CASE status WHEN 'NOT_APPLICABLE' THEN 0 ELSE 1 END::DOUBLE AS most,
  CASE WHEN status = 'NOT_APPLICABLE' THEN 'NONE' WHEN status = 'PASS' THEN CASE WHEN reliability > 0 AND reliability < 60 THEN 'LOW' ELSE 'NONE' END
    WHEN status = 'FAIL' THEN CASE severity WHEN 'high' THEN 'CRITICAL' ELSE 'HIGH' END ELSE 'MEDIUM' END AS risk_contribution FROM checks""", ("checks",))  # fmt: skip
def i08(spark, d):
    return S.rule_points(frame(spark, d, "checks"))


@query("i09_confidence", """WITH e AS (SELECT screening_id, coalesce(round(avg(CASE WHEN reliability <> 0 THEN reliability END), 1), 85) AS evidence_avg FROM checks GROUP BY 1)
SELECT screening_id, evidence_avg, 85.0::DOUBLE AS extraction_avg, 0 AS high_count, 0 AS low_count, round(42.5 + evidence_avg * 0.5, 1)::DOUBLE AS overall,
  CASE WHEN round(42.5 + evidence_avg * 0.5, 1) >= 75 THEN 'HIGH' WHEN round(42.5 + evidence_avg * 0.5, 1) >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM e""", ("checks",))  # fmt: skip
def i09(spark, d):
    return S.confidence(frame(spark, d, "checks"))


@query("i10_risk_factors", """SELECT screening_id, CASE WHEN status = 'FAIL' AND severity = 'high' THEN 'RF-CRIT-' WHEN status = 'FAIL' THEN 'RF-FAIL-' ELSE 'RF-REV-' END || rule_id AS factor_id,
  CASE WHEN status = 'FAIL' AND severity = 'high' THEN 'CRITICAL_STATUTORY_FAILURE' WHEN status = 'FAIL' THEN 'MISSING_MANDATORY_DECLARATION' ELSE 'DATA_AMBIGUITY' END AS factor_type, rule_id, field,
  CASE WHEN status = 'FAIL' AND severity = 'high' THEN 'CRITICAL' WHEN status = 'FAIL' THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM checks WHERE status NOT IN ('PASS', 'NOT_APPLICABLE')""", ("checks",))  # fmt: skip
def i10(spark, d):
    return S.risk_factors(frame(spark, d, "checks"))


FINDINGS = """f AS (SELECT screening_id, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status IN ('NEEDS_REVIEW', 'WARNING')) AS review, count(*) FILTER (WHERE status = 'PASS') AS passed FROM checks GROUP BY 1),
o AS (SELECT s.*, coalesce(failed, 0) AS failed, coalesce(review, 0) AS review, coalesce(passed, 0) AS passed,
  CASE WHEN failed > 0 THEN 'FAILURE' WHEN review > 0 THEN 'NEEDS_REVIEW' WHEN passed > 0 THEN 'COMPLIANT' WHEN status LIKE '%NON-COMPLIANCE%' THEN 'FAILURE' WHEN status LIKE '%REVIEW%' THEN 'NEEDS_REVIEW' ELSE 'COMPLIANT' END AS outcome
  FROM screenings s LEFT JOIN f ON id = screening_id)"""


@query("i01_dashboard", f"""WITH {FINDINGS} SELECT organization, count(*) AS packages, count(*) FILTER (WHERE outcome = 'COMPLIANT') AS compliant, CAST(sum(failed) AS BIGINT) AS failed_findings,
  CAST(sum(review) AS BIGINT) AS review_findings, round(avg(score), 4) AS average_score FROM o WHERE id NOT IN (1, 2, 3) GROUP BY 1""", ("screenings", "checks"))  # fmt: skip
def i01(spark, d):
    return D.dashboard(X.exclude_demo(frame(spark, d, "screenings")), frame(spark, d, "checks"), "organization")


@query("i02_by_status", "SELECT status, count(*) AS n FROM screenings GROUP BY 1", ("screenings",))
def i02(spark, d):
    return D.by_status(frame(spark, d, "screenings"))


@query("i03_daily_trend", f"""WITH c AS (SELECT CAST(DATE '{AS_OF_DAY}' - CAST(i AS INT) AS DATE) AS day FROM range(60) t(i)), g AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = 'COMPLIANT') AS compliant, sum(score) AS s FROM screenings GROUP BY 1)
SELECT day, coalesce(total, 0) AS total, coalesce(compliant, 0) AS compliant, coalesce(total - compliant, 0) AS violations, round(coalesce(s / total, 0), 1) AS average_score FROM c LEFT JOIN g USING (day)""", ("screenings",))  # fmt: skip
def i03(spark, d):
    return D.daily_trend(frame(spark, d, "screenings"), AS_OF_DAY, 60)


@query("cj7_outcome_and_risk", f"""WITH {FINDINGS}, r AS (SELECT *, CASE WHEN failed >= 2 THEN 'HIGH' WHEN failed = 1 THEN 'CRITICAL' WHEN review > 0 THEN 'MEDIUM' WHEN score >= 90 THEN 'LOW' ELSE 'MEDIUM' END AS legacy_risk,
  CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 80 THEN 'HIGH' WHEN score < 90 THEN 'MEDIUM' ELSE 'LOW' END AS handover_risk, CASE WHEN score >= 90 THEN 'LOW' WHEN score >= 70 THEN 'MEDIUM' ELSE 'CRITICAL' END AS artwork_risk FROM o)
SELECT organization, strftime(created_at, '%Y-%m') AS month, outcome, legacy_risk, handover_risk, artwork_risk, count(*) AS n FROM r GROUP BY ALL""", ("screenings", "checks"))  # fmt: skip
def cj7(spark, d):
    return T.outcomes_by_month(D.with_findings(frame(spark, d, "screenings"), frame(spark, d, "checks")))


@query("i20_cache_statistics", f"""WITH l AS (SELECT * FROM cache_rows QUALIFY row_number() OVER (PARTITION BY identifier_type, identifier_value ORDER BY cached_at DESC, event_id DESC) = 1)
SELECT identifier_type, count(*) AS total, count(*) FILTER (WHERE cached_at + to_seconds(ttl * 3600) > TIMESTAMP '{AS_OF}') AS active, count(*) FILTER (WHERE NOT cached_at + to_seconds(ttl * 3600) > TIMESTAMP '{AS_OF}') AS expired FROM l GROUP BY 1""", ("cache_rows",))  # fmt: skip
def i20(spark, d):
    return D.cache_statistics(X.latest(_cache(spark, d), ["identifier_type", "identifier_value"], "cached_at", "event_id"), AS_OF)


def _cache(spark, d):
    return frame(spark, d, "cache_rows").withColumn("ttl", F.col("ttl") * 3600)


@query("b11_cache_valid", f"""SELECT event_id, identifier_type, identifier_value, cached_at, ttl * 3600 AS ttl FROM (SELECT * FROM cache_rows QUALIFY row_number() OVER (PARTITION BY identifier_type, identifier_value ORDER BY cached_at DESC, event_id DESC) = 1)
WHERE cached_at + to_seconds(ttl * 3600) > TIMESTAMP '{AS_OF}'""", ("cache_rows",))  # fmt: skip
def b11(spark, d):
    return X.cache_valid(_cache(spark, d), AS_OF)


@query("a06_upsert", """SELECT event_id, identifier_type, identifier_value, cached_at, ttl FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN ttl + 1 ELSE ttl END AS t2 FROM cache_rows) QUALIFY row_number() OVER (PARTITION BY identifier_type, identifier_value ORDER BY cached_at DESC, event_id DESC) = 1""", ("cache_rows",))
def a06(spark, d):
    rows = frame(spark, d, "cache_rows")
    return X.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["identifier_type", "identifier_value"], "cached_at", "event_id")


@query("i21_review_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PENDING_REVIEW') AS pending, count(*) FILTER (WHERE status = 'UNDER_REVIEW') AS under_review, count(*) FILTER (WHERE status = 'RESCAN_REQUESTED') AS rescan,
  count(*) FILTER (WHERE status LIKE 'VERIFIED%') AS verified, count(*) FILTER (WHERE status NOT LIKE 'VERIFIED%' AND risk_level = 'CRITICAL') AS critical_open, count(*) FILTER (WHERE status NOT LIKE 'VERIFIED%' AND risk_level = 'HIGH') AS high_open FROM reviews""", ("reviews",))  # fmt: skip
def i21(spark, d):
    return D.review_summary(frame(spark, d, "reviews"))


@query("f24_i21_workload", """WITH o AS (SELECT DISTINCT 'officer-' || CAST(c_custkey AS VARCHAR) AS officer FROM customer WHERE c_custkey < 25)
SELECT o.officer, count(review_id) AS assigned, count(review_id) FILTER (WHERE status NOT LIKE 'VERIFIED%') AS open, count(review_id) FILTER (WHERE status LIKE 'VERIFIED%') AS verified FROM o LEFT JOIN reviews r ON o.officer = r.officer GROUP BY 1""", ("reviews",))  # fmt: skip
def f24(spark, d):
    officers = frame(spark, d, "customer").filter("c_custkey < 25").select(F.concat(F.lit("officer-"), F.col("c_custkey").cast("string")).alias("officer")).distinct()
    return D.workload(officers, frame(spark, d, "reviews"))


@query("h03_queue_order", f"""SELECT review_id, status, risk_level, CASE risk_level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS weight,
  greatest(0, round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(updated_at))) / 3600, 1))::DOUBLE AS age_hours FROM reviews ORDER BY weight DESC, age_hours DESC, review_id LIMIT 50""", ("reviews",))  # fmt: skip
def h03(spark, d):
    return D.queue_order(frame(spark, d, "reviews"), AS_OF, 50)


@query("cj9_review_ages", f"""WITH a AS (SELECT officer, greatest(0, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(updated_at))) / 3600) AS h FROM reviews)
SELECT officer, CASE WHEN h < 24 THEN 'under 1 day' WHEN h < 168 THEN 'under 1 week' WHEN h < 720 THEN 'under 30 days' ELSE 'older' END AS band, count(*) AS n, max(round(h, 1))::DOUBLE AS oldest_hours FROM a GROUP BY ALL""", ("reviews",))  # fmt: skip
def cj9(spark, d):
    return D.review_ages(frame(spark, d, "reviews"), AS_OF)


@query("i18_panel_zones", """WITH g AS (SELECT screening_id, CASE WHEN rule_id IN ('LM-002', 'LM-003', 'LM-004', 'FS-001', 'FS-002') THEN 'FRONT' ELSE 'INFORMATION' END AS zone, count(*) AS rules, count(*) FILTER (WHERE status = 'PASS') AS passed,
  count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status IN ('WARNING', 'NEEDS_REVIEW', 'INSUFFICIENT_EVIDENCE')) AS review, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM checks GROUP BY ALL)
SELECT *, CASE WHEN failed > 0 THEN 'NON_COMPLIANT' WHEN review > 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLIANT' END AS status FROM g""", ("checks",))  # fmt: skip
def i18(spark, d):
    return D.panel_zones(frame(spark, d, "checks"))


@query("i22_critical_reasons", """SELECT screening_id, count(*) AS critical_count, string_agg(field_label, '; ' ORDER BY rule_id, field_label) AS reasons FROM checks WHERE status = 'FAIL' AND severity = 'high' GROUP BY 1""", ("checks",))
def i22(spark, d):
    return D.critical_reasons(frame(spark, d, "checks"))


@query("i23_penalties", """WITH v AS (SELECT screening_id, count(*) AS violations, CAST(sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS weighted, bool_or(severity = 'high') AS severe FROM checks WHERE status = 'FAIL' GROUP BY 1),
p AS (SELECT *, screening_id % 5 = 0 AS repeat_offence FROM v), q AS (SELECT *, CAST(least(CASE WHEN repeat_offence THEN 10000 + weighted * 2000 + violations * 1500 WHEN severe THEN 5000 + weighted * 1500 + violations * 1000 ELSE 2000 + weighted * 1000 + violations * 500 END, CASE WHEN repeat_offence THEN 50000 ELSE 25000 END) AS BIGINT) AS fine FROM p)
SELECT screening_id, violations, weighted, repeat_offence, fine, greatest(1000, fine // 2) AS fine_least FROM q""", ("checks",))  # fmt: skip
def i23(spark, d):
    v = frame(spark, d, "checks").filter("status = 'FAIL'")
    prior = frame(spark, d, "screenings").filter("id % 5 = 0").select(F.col("id").alias("screening_id"), F.lit(1).alias("notices"))
    return D.penalties(v.select("screening_id", "severity"), prior)


@query("i24_show_cause", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY screening_id ORDER BY rule_id, field_label, severity) AS i FROM checks WHERE status = 'FAIL')
SELECT id, 'Show cause: ' || product_name || chr(10) || string_agg(CAST(i AS VARCHAR) || '. [' || rule_id || '] ' || field_label || ' (' || severity || ')', chr(10) ORDER BY i) AS notice FROM screenings JOIN n ON id = screening_id GROUP BY id, product_name""", ("screenings", "checks"))  # fmt: skip
def i24(spark, d):
    return D.show_cause(frame(spark, d, "screenings"), frame(spark, d, "checks").filter("status = 'FAIL'"))


@query("i33_initial_reviews", f"""WITH {SCORES} SELECT id, 'PENDING_REVIEW' AS status, risks.score AS ai_score, CASE WHEN risks.score < 60 THEN 'CRITICAL' WHEN risks.score < 80 THEN 'HIGH' WHEN risks.score < 90 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, risk_level AS engine_risk, failed AS failed_rules
FROM screenings JOIN risks ON id = screening_id WHERE id NOT IN (SELECT review_id FROM reviews)""".replace("risk_level AS engine_risk", "risks.risk_level AS engine_risk"), ("screenings", "checks", "reviews"))  # fmt: skip
def i33(spark, d):
    return D.initial_reviews(frame(spark, d, "screenings"), _scores(spark, d), frame(spark, d, "reviews").select(F.col("review_id").alias("id")))


@query("e20_issues", """SELECT screening_id, line, rule_id, field, severity, status, CASE status WHEN 'FAIL' THEN field_label || ' is missing or invalid' WHEN 'WARNING' THEN field_label || ' needs attention' ELSE field_label || ' has too little evidence' END AS issue
FROM checks WHERE status IN ('FAIL', 'WARNING', 'INSUFFICIENT_EVIDENCE')""", ("checks",))  # fmt: skip
def e20(spark, d):
    return T.issues(frame(spark, d, "checks"))


@query("e21_recommendations", """SELECT screening_id, line, rule_id, status, CASE status WHEN 'FAIL' THEN 'HIGH' WHEN 'PASS' THEN 'INFO' WHEN 'NOT_APPLICABLE' THEN 'INFO' ELSE 'MEDIUM' END AS priority,
  CASE status WHEN 'FAIL' THEN 'CORRECT_LABEL' WHEN 'PASS' THEN 'NO_ACTION' WHEN 'NOT_APPLICABLE' THEN 'NO_ACTION' ELSE 'VERIFY' END AS action,
  CASE status WHEN 'FAIL' THEN 'Print ' || field_label || ' on the label' WHEN 'PASS' THEN 'None' WHEN 'NOT_APPLICABLE' THEN 'None' ELSE 'Verify ' || field_label || ' on the package' END AS step FROM checks""", ("checks",))  # fmt: skip
def e21(spark, d):
    return T.recommendations(frame(spark, d, "checks"))


@query("g03_risk_trend", """WITH w AS (SELECT *, lag(score) OVER (PARTITION BY product_key ORDER BY created_at, id) AS before, row_number() OVER (PARTITION BY product_key ORDER BY created_at DESC, id DESC) AS rn FROM screenings)
SELECT product_key, id AS last_id, score AS current, before, CASE WHEN score - before >= 3 THEN 'IMPROVING' WHEN score - before <= -3 THEN 'DEGRADING' ELSE 'STABLE' END AS trend FROM w WHERE rn = 1""", ("screenings",))  # fmt: skip
def g03(spark, d):
    return D.risk_trend(frame(spark, d, "screenings"))


@query("g13_version_sequence", """SELECT product_key, id, CAST(row_number() OVER w AS INT) AS version, score, score - lag(score) OVER w AS score_delta FROM screenings WINDOW w AS (PARTITION BY product_key ORDER BY created_at, id)""", ("screenings",))
def g13(spark, d):
    return D.version_sequence(frame(spark, d, "screenings"))


@query("g12_review_transitions", """WITH w AS (SELECT *, lag(status) OVER (PARTITION BY review_id ORDER BY ts, event_id) AS before, lead(status) OVER (PARTITION BY review_id ORDER BY ts, event_id) AS next FROM reviews_log)
SELECT event_id, review_id, status, before, next, before IS NULL OR before = status OR (before, status) IN (('PENDING_REVIEW', 'UNDER_REVIEW'), ('PENDING_REVIEW', 'RESCAN_REQUESTED'), ('UNDER_REVIEW', 'VERIFIED_COMPLIANT'), ('UNDER_REVIEW', 'VERIFIED_NON_COMPLIANT'),
 ('UNDER_REVIEW', 'RESCAN_REQUESTED'), ('RESCAN_REQUESTED', 'PENDING_REVIEW'), ('RESCAN_REQUESTED', 'UNDER_REVIEW'), ('VERIFIED_COMPLIANT', 'UNDER_REVIEW'), ('VERIFIED_NON_COMPLIANT', 'UNDER_REVIEW')) AS legal FROM w""", ("reviews_log",))  # fmt: skip
def g12(spark, d):
    return T.transitions(frame(spark, d, "reviews_log"))


@query("g11_attempts", """WITH e AS (SELECT *, coalesce(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM attempts)
SELECT a.event_id, a.key, a.ts, count(b.event_id) AS failures, count(b.event_id) >= 5 AS blocked FROM e a LEFT JOIN e b ON a.key = b.key AND a.epoch = b.epoch AND b.failure AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOUR WHERE a.failure GROUP BY ALL""", ("attempts",))  # fmt: skip
def g11(spark, d):
    return T.sliding_attempts(frame(spark, d, "attempts"), seconds=6 * 3600, most=5)


@query("g06_audit_chain", """WITH RECURSIVE e AS (SELECT event_id, user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type, CAST(user_id AS VARCHAR) AS actor, CAST(epoch_us(ts) AS VARCHAR) AS created_at FROM events),
c AS (SELECT *, 'GENESIS' AS prev_hash, sha256('GENESIS|' || event_type || '|' || actor || '|' || created_at) AS event_hash FROM e WHERE n = 1
  UNION ALL SELECT e.*, c.event_hash, sha256(c.event_hash || '|' || e.event_type || '|' || e.actor || '|' || e.created_at) FROM e JOIN c ON e.log = c.log AND e.n = c.n + 1),
a AS (SELECT * REPLACE (CASE WHEN event_id % 1000 = 7 THEN actor || 'x' ELSE actor END AS actor, CASE WHEN event_id % 1500 = 8 THEN 'none' ELSE prev_hash END AS prev_hash) FROM c),
w AS (SELECT *, CASE WHEN prev_hash <> coalesce(lag(event_hash) OVER (PARTITION BY log ORDER BY event_id), 'GENESIS') THEN 'PREVIOUS_HASH'
  WHEN sha256(prev_hash || '|' || event_type || '|' || actor || '|' || created_at) <> event_hash THEN 'EVENT_HASH' END AS why FROM a)
SELECT log, count(*) AS links, count(why) AS broken, min(event_id) FILTER (WHERE why IS NOT NULL) AS first_broken, arg_min(why, event_id) FILTER (WHERE why IS NOT NULL) AS reason FROM w GROUP BY log""")  # fmt: skip
def g06(spark, d):
    return T.verify_chain(T.chained_fixture(frame(spark, d, "events")))


@query("h01_timeline", """SELECT product_key, 'SCREENING' AS kind, CAST(id AS VARCHAR) AS ref, created_at AS at, score FROM screenings
UNION ALL SELECT p.product_key, 'COMPARISON', CAST(version_a AS VARCHAR) || '-' || CAST(version_b AS VARCHAR), b.created_at, score_b - score_a FROM pairs p JOIN screenings b ON b.id = version_b""", ("screenings", "pairs"))  # fmt: skip
def h01(spark, d):
    return T.timeline(frame(spark, d, "screenings"), frame(spark, d, "pairs"))


@query("h02_comparable_versions", """SELECT kind, ref, organization, created_at, score FROM (SELECT 'SCREENING' AS kind, CAST(id AS VARCHAR) AS ref, organization, created_at, score FROM screenings
UNION ALL SELECT 'ARTWORK', 'A' || CAST(p_partkey AS VARCHAR), p_partkey % 25, TIMESTAMP '1995-01-01' + to_days(CAST(p_size AS INT)), CAST(p_size AS DOUBLE) FROM part) ORDER BY created_at DESC, ref LIMIT 200""", ("screenings",))  # fmt: skip
def h02(spark, d):
    art = frame(spark, d, "part").select(F.lit("ARTWORK").alias("kind"), F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("ref"), (F.col("p_partkey") % 25).alias("organization"),
                                        F.timestamp_seconds(F.lit(788918400) + F.col("p_size") * 86400).alias("created_at"), F.col("p_size").cast("double").alias("score"))
    return T.comparable(frame(spark, d, "screenings"), art, 200)


@query("h04_h05_newest", "SELECT * FROM screenings WHERE organization = 7 ORDER BY created_at DESC, id DESC LIMIT 5", ("screenings",))
def h04(spark, d):
    return X.newest(X.scope(frame(spark, d, "screenings"), "AUDIT_OFFICER", 7), 5)


@query("h07_distinct_fields", "SELECT screening_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM checks GROUP BY 1", ("checks",))
def h07(spark, d):
    return T.distinct_lists(frame(spark, d, "checks"))


@query("h08_checks_in_order", "SELECT screening_id, string_agg(rule_id || '=' || status, ' ' ORDER BY rule_id) AS checks FROM rule_checks GROUP BY 1", ("rule_checks",))
def h08(spark, d):
    return T.checks_in_order(frame(spark, d, "rule_checks"))


@query("b01_exclude_demo", "SELECT * FROM screenings WHERE id NOT IN (1, 2, 3)", ("screenings",))
def b01(spark, d):
    return X.exclude_demo(frame(spark, d, "screenings"))


@query("b02_purge_test", "SELECT event_id, id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TEST-' WHEN 1 THEN 'test.' WHEN 2 THEN 'Demo-' ELSE '' END || CAST(event_id AS VARCHAR) AS id FROM events) WHERE NOT (id ILIKE 'test-%' OR id ILIKE 'test_%' OR id ILIKE 'demo-%' OR id IN ('1', '2', '3'))")
def b02(spark, d):
    i = F.col("event_id")
    prefix = F.when(i % 4 == 0, "TEST-").when(i % 4 == 1, "test.").when(i % 4 == 2, "Demo-").otherwise("")
    return X.purge_test(frame(spark, d, "events").select("event_id", F.concat(prefix, i.cast("string")).alias("id")))


@query("b03_search", "SELECT * FROM screenings WHERE (lower(product_name) LIKE '%product 1%' OR CAST(id AS VARCHAR) LIKE '%product 1%') AND status LIKE '%REVIEW%' ORDER BY created_at DESC, id DESC LIMIT 50", ("screenings",))
def b03(spark, d):
    return X.search(frame(spark, d, "screenings"), " PRODUCT 1", "review")


@query("b04_tenant_scope", """WITH p AS (SELECT c_name AS name, c_nationkey AS org, CASE c_custkey % 4 WHEN 0 THEN 'AUDIT_OFFICER' WHEN 1 THEN 'MERCHANT_PUBLIC' WHEN 2 THEN 'NOBODY' ELSE 'ENFORCEMENT_OFFICER' END AS role FROM customer WHERE c_custkey < 12)
SELECT p.name AS principal, s.* FROM screenings s JOIN p ON s.organization = p.org WHERE role IN ('AUDIT_OFFICER', 'ENFORCEMENT_OFFICER') OR role = 'MERCHANT_PUBLIC' AND lower(trim(s.owner)) = lower(trim(p.name))""", ("screenings",))  # fmt: skip
def b04(spark, d):
    k = F.col("c_custkey")
    role = F.when(k % 4 == 0, "AUDIT_OFFICER").when(k % 4 == 1, "MERCHANT_PUBLIC").when(k % 4 == 2, "NOBODY").otherwise("ENFORCEMENT_OFFICER")
    principals = frame(spark, d, "customer").filter(k < 12).select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("organization"), role.alias("role"))
    return X.scope_many(frame(spark, d, "screenings"), principals)


@query("b05_b06_owner_scope", "SELECT * FROM screenings WHERE (organization = 3 OR organization IS NULL) AND lower(owner) = 'customer#000000011' OR lower(owner) = 'customer#000000013'", ("screenings",))
def b05(spark, d):
    s = frame(spark, d, "screenings")
    a = X.owned_by(X.scope_timeline(s, 3), "CUSTOMER#000000011")
    return a.unionByName(X.owned_by(s, "CUSTOMER#000000013")).distinct()


@query("b07_match_product", "SELECT * FROM screenings WHERE lower(product_name) = 'product 12'", ("screenings",))
def b07(spark, d):
    return X.match_product(frame(spark, d, "screenings"), " product 12 ")


@query("b08_review_filter", "SELECT * FROM reviews WHERE status LIKE 'VERIFIED%' AND risk_level = 'HIGH' ORDER BY updated_at DESC, review_id DESC LIMIT 40", ("reviews",))
def b08(spark, d):
    return X.reviews(frame(spark, d, "reviews"), "verified", risk="high", limit=40)


@query("b12_audit_reads", "SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def b12(spark, d):
    return X.audit(frame(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"), "error")


@query("b14_get_many", "SELECT * FROM screenings WHERE id IN (SELECT review_id FROM reviews)", ("screenings", "reviews"))
def b14(spark, d):
    return X.get_many(frame(spark, d, "screenings"), frame(spark, d, "reviews").select(F.col("review_id").alias("id")), "id")


@query("b15_delete", "SELECT * FROM screenings WHERE id NOT IN (SELECT review_id FROM reviews)", ("screenings", "reviews"))
def b15(spark, d):
    return X.delete(frame(spark, d, "screenings"), frame(spark, d, "reviews").select(F.col("review_id").alias("id")), "id")


@query("b16_list_versions", "SELECT p.* FROM pairs p JOIN screenings s ON s.id = version_b WHERE s.organization = 4 ORDER BY created_at DESC, id DESC LIMIT 30", ("pairs", "screenings"))
def b16(spark, d):
    s = X.scope(frame(spark, d, "screenings"), "AUDIT_OFFICER", 4)
    p = frame(spark, d, "pairs")
    return X.newest(p.join(s.select(F.col("id").alias("version_b"), "created_at"), "version_b"), 30, ("created_at", "version_b")).select(*p.columns)


@query("f30_assignable_officers", "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 20 AND c_nationkey IN (SELECT organization FROM reviews)", ("reviews",))
def f30(spark, d):
    return X.get_many(frame(spark, d, "customer").filter("c_custkey < 20").withColumnRenamed("c_nationkey", "organization"), frame(spark, d, "reviews"), "organization").select("c_custkey", "c_name")
