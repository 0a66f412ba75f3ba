"""Officers' corrections of declarations: fields side by side, and rules and scores of corrected labels again."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import extraction as E
from labelloom.operators import reviews as V
from labelloom.operators import rules as R
from labelloom.plans.facts import SCORES
from labelloom.plans.labels import CHECKS
from labelloom.plans.registry import Registry
from labelloom.sources.shared import stored
from labelloom.sources.views import frame

QUERIES, SQL, query = Registry.new()

#: Prices (an earlier correction among them) where label_id % 9 = 0, licences of foods where % 9 = 3, quantity and origin where % 9 = 6.
_PRICE, _LICENCE, _ORIGIN = "label_id % 9 = 0 AND label_id % 7 <> 3", "label_id % 9 = 3 AND is_food", "label_id % 9 = 6"
FIXES = f"""SELECT label_id, 'mrp' AS field, ' 55.00 ' AS value, 'asha' AS officer, 'misread' AS reason, 2 AS at FROM {{t}} WHERE {_PRICE}
UNION ALL SELECT label_id, 'mrp', '44.00', 'ravi', 'first look', 1 FROM {{t}} WHERE {_PRICE}
UNION ALL SELECT label_id, 'fssai_license', '10012345678901', 'ravi', 'from the registry', 3 FROM {{t}} WHERE {_LICENCE}
UNION ALL SELECT label_id, 'net_quantity', '750 g', 'asha', 'weighed', 4 FROM {{t}} WHERE {_ORIGIN}
UNION ALL SELECT label_id, 'country_of_origin', 'India', 'asha', 'asked', 4 FROM {{t}} WHERE {_ORIGIN}
UNION ALL SELECT label_id, 'colour', 'red', 'asha', 'no such field', 4 FROM {{t}} WHERE label_id % 9 = 1"""
FIXED = f"""fixed_truth AS (SELECT * REPLACE (CASE WHEN {_PRICE} THEN 55.00 ELSE price END AS price, CASE WHEN {_LICENCE} THEN '10012345678901' ELSE licence END AS licence,
  CASE WHEN {_ORIGIN} THEN 750 ELSE amount END AS amount, CASE WHEN {_ORIGIN} THEN 'g' ELSE unit END AS unit, CASE WHEN {_ORIGIN} THEN 'India' ELSE origin END AS origin) FROM label_truth)"""


def _renamed(sql: str, end: str, *names: str) -> str:
    for n in names:
        sql = sql.replace(f"{n} AS (", f"{n}_{end} AS (").replace(f"FROM {n})", f"FROM {n}_{end})")
    return sql


def _scored(end: str, truth: str) -> str:
    """Rule outcomes of a table of truths as c_<end>, and their scores as risks_<end>."""
    checks = _renamed(CHECKS.replace("FROM label_truth", f"FROM {truth}"), end, "t", "c")
    joined = f"checks_{end} AS (SELECT label_id AS screening_id, r.rule_id AS rule_id, r.status AS status, r.value AS value, rules.severity AS severity FROM c_{end} JOIN rules ON rules.rule_id = r.rule_id)"
    return f"{checks}, {joined}, {_renamed(SCORES.replace('FROM checks', f'FROM checks_{end}'), end, 's', 'scores', 'risks')}"


def _fixes(spark, d):
    return spark.sql(FIXES.format(t="{t}"), t=frame(spark, d, "label_truth"))


def _declared(spark, d):
    return stored(E.declarations(frame(spark, d, "label_text")))


_SIDE = """SELECT label_id, product_name, CAST(brand AS VARCHAR) AS brand, CAST(price AS VARCHAR) AS mrp, CAST(amount AS VARCHAR) || ' ' || unit AS net_quantity, maker AS manufacturer, CAST(NULL AS VARCHAR) AS marketed_by, licence AS fssai_license,
  phone || ', ' || email AS consumer_care, coalesce(origin, CASE WHEN label_id % 26 = 7 THEN 'India' END) AS country_of_origin, made AS manufacture_date, best_before AS expiry_date, batch AS batch_number, ingredients, CASE WHEN is_food THEN 'Panel detected' END AS nutritional_info"""
_ROWS = f"FROM ({_SIDE} FROM {{}}) UNPIVOT INCLUDE NULLS (v FOR field IN ({', '.join(V.FIELDS)}))"


@query("f25_fields_machine_vs_human", f"""WITH {FIXED}, fx AS (SELECT label_id, field, max("at") AS "at", arg_max(officer, "at") AS officer, arg_max(reason, "at") AS reason FROM ({FIXES.format(t='label_truth')}) WHERE field <> 'colour' GROUP BY ALL),
a AS ({_ROWS.format('label_truth')}), h AS ({_ROWS.format('fixed_truth')})
SELECT label_id, field, a.v AS ai_value, h.v AS human_value, fx."at" IS NOT NULL AS is_changed, CASE WHEN fx."at" IS NOT NULL THEN 'CORRECTED' ELSE 'UNCHANGED' END AS change_type, officer, "at", reason
FROM a JOIN h USING (label_id, field) LEFT JOIN fx USING (label_id, field)""", ("label_truth",))  # fmt: skip
def f25_fields(spark, d):
    declared, fixes = _declared(spark, d), _fixes(spark, d)
    return V.machine_vs_human(declared, V.corrected(declared, fixes), fixes)


@query("i32_reevaluated_scores", f"""WITH {FIXED}, {_scored('ai', 'label_truth')}, {_scored('human', 'fixed_truth')}
SELECT a.screening_id AS label_id, a.score AS ai_score, a.status AS ai_status, a.risk_level AS ai_risk_level, h.score AS human_score, h.status AS human_status, h.risk_level AS human_risk_level, round(h.score - a.score, 1) AS delta
FROM risks_ai a JOIN risks_human h USING (screening_id)""", ("label_truth", "rules"))  # fmt: skip
def i32_reevaluated_scores(spark, d):
    declared = _declared(spark, d)
    return V.reevaluated(declared, R.evaluate(declared), _fixes(spark, d), text=True)[1]


@query("i32_reevaluated_checks", f"WITH {FIXED}, {_scored('human', 'fixed_truth')} SELECT screening_id AS label_id, rule_id, status, value FROM checks_human", ("label_truth", "rules"))
def i32_reevaluated_checks(spark, d):
    declared = _declared(spark, d)
    return V.reevaluated(declared, R.evaluate(declared), _fixes(spark, d), text=True)[0].select("label_id", "rule_id", "status", "value")
