"""Queries on diffs, registries, claims and word boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import columns as C
from labelloom.operators import claims as K
from labelloom.operators import evidence as V
from labelloom.operators import extraction as E
from labelloom.operators import jobs as J
from labelloom.operators import locate as LO
from labelloom.operators import reconcile as R
from labelloom.operators import rules as RU
from labelloom.operators import scoring as S
from labelloom.operators.common import by_label
from labelloom.plans.facts import SCORES
from labelloom.plans.labels import CHECKS
from labelloom.plans.registry import Registry
from labelloom.sources.shared import stored
from labelloom.sources.views import frame

QUERIES, SQL, query = Registry.new()


def _diff(spark, d):
    c = frame(spark, d, "rule_checks")
    return R.rule_diff(c, c, frame(spark, d, "pairs"))


DIFF = """a AS (SELECT p.version_a, p.version_b, rule_id, status AS sa FROM pairs p JOIN rule_checks ON screening_id = version_a),
b AS (SELECT p.version_a, p.version_b, rule_id, status AS sb FROM pairs p JOIN rule_checks ON screening_id = version_b),
d AS (SELECT version_a, version_b, rule_id, coalesce(sa, 'NOT_APPLICABLE') AS status_a, coalesce(sb, 'NOT_APPLICABLE') AS status_b, sa IS NOT NULL AS has_a, sb IS NOT NULL AS has_b FROM a FULL JOIN b USING (version_a, version_b, rule_id)),
r AS (
  SELECT version_a, version_b, rule_id, CASE status_b WHEN 'PASS' THEN 'RESOLVED' WHEN 'NEEDS_REVIEW' THEN 'UNRESOLVED_REVIEW' ELSE 'STILL_PRESENT' END AS resolution
  FROM d WHERE status_a IN ('FAIL', 'WARNING') AND has_b AND status_b IN ('PASS', 'FAIL', 'WARNING', 'NEEDS_REVIEW')
  UNION ALL SELECT version_a, version_b, rule_id, 'NEW_ISSUE' FROM d WHERE status_b IN ('FAIL', 'WARNING') AND (NOT has_a OR status_a = 'PASS'))"""


@query("f01_rule_diff", f"""WITH {DIFF} SELECT *, CASE WHEN status_a = status_b THEN 'UNCHANGED' WHEN status_b = 'PASS' AND status_a <> 'NOT_APPLICABLE' THEN 'FIXED' WHEN status_a = 'PASS' AND status_b IN ('FAIL', 'WARNING', 'NEEDS_REVIEW') THEN 'REGRESSED'
WHEN status_a = 'NOT_APPLICABLE' THEN 'NEWLY_EVALUATED' ELSE 'MODIFIED' END AS change FROM d""", ("pairs", "rule_checks"))  # fmt: skip
def f01(spark, d):
    return _diff(spark, d)


@query("f02_issue_resolution", f"WITH {DIFF} SELECT * FROM r", ("pairs", "rule_checks"))
def f02(spark, d):
    return R.issue_resolution(_diff(spark, d))


#: Food failures of high severity count as critical, and a quarter of the checks as not detected, so that both counts occur.
JUDGED = "judged AS (SELECT screening_id, status, CASE WHEN domain = 'FSSAI' AND severity = 'high' THEN 'critical' ELSE severity END AS severity, status <> 'NOT_APPLICABLE' AS required, reliability >= 25 AS detected FROM checks)"


@query("f06_version_summary", f"""WITH {DIFF}, {SCORES}, {JUDGED}, n AS (SELECT version_a, version_b, count(*) FILTER (WHERE resolution = 'RESOLVED') AS resolved, count(*) FILTER (WHERE resolution = 'STILL_PRESENT') AS remaining, count(*) FILTER (WHERE resolution = 'NEW_ISSUE') AS new_issues FROM r GROUP BY ALL),
k AS (SELECT screening_id, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'critical') AS critical, count(*) FILTER (WHERE required AND NOT detected) AS missing FROM judged GROUP BY 1),
w AS (SELECT screening_id, CASE risk_level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS w FROM risks),
j AS (SELECT p.version_a, p.version_b, round(round(score_b, 1) - round(score_a, 1), 1) AS score_delta, coalesce(wa.w, 2) AS wa, coalesce(wb.w, 2) AS wb, coalesce(resolved, 0) AS resolved, coalesce(remaining, 0) AS remaining, coalesce(new_issues, 0) AS new_issues,
  coalesce(ka.critical, 0) AS critical_a, coalesce(kb.critical, 0) AS critical_b, coalesce(ka.missing, 0) AS missing_a, coalesce(kb.missing, 0) AS missing_b
  FROM pairs p LEFT JOIN n USING (version_a, version_b) LEFT JOIN w wa ON wa.screening_id = p.version_a LEFT JOIN w wb ON wb.screening_id = p.version_b LEFT JOIN k ka ON ka.screening_id = p.version_a LEFT JOIN k kb ON kb.screening_id = p.version_b)
SELECT version_a, version_b, score_delta, CASE WHEN wb < wa THEN 'IMPROVED' WHEN wb > wa THEN 'DEGRADED' ELSE 'UNCHANGED' END AS risk_shift, resolved, remaining, new_issues, critical_a, critical_b, missing_a, missing_b,
  CASE WHEN score_delta < 0 THEN 'REGRESSED' WHEN score_delta > 0 AND resolved > 0 THEN 'IMPROVED' ELSE 'CONSISTENT' END AS verdict FROM j""", ("pairs", "rule_checks", "checks"))  # fmt: skip
def f06(spark, d):
    c = frame(spark, d, "checks")
    severity = F.when((F.col("domain") == "FSSAI") & (F.col("severity") == "high"), "critical").otherwise(F.col("severity"))
    judged = c.select("screening_id", "status", severity.alias("severity"), (F.col("status") != "NOT_APPLICABLE").alias("required"), (F.col("reliability") >= 25).alias("detected"))
    return R.version_summary(frame(spark, d, "pairs"), R.issue_resolution(_diff(spark, d)), S.scores(c), judged)


def _truth(spark, d):
    return frame(spark, d, "label_truth")


def _as_declared(t):
    """Truth columns under the names of declarations."""
    q = F.concat_ws(" ", F.col("amount").cast("string"), "unit")
    return t.select(
        "label_id", "product_name", "brand", F.col("price").cast("string").alias("mrp"), F.when(F.col("amount").isNotNull(), q).alias("net_quantity"), F.concat(F.lit("USP: "), "usp", F.lit(" per g")).alias("unit_sale_price"), F.col("made").alias("manufacturing_date"), F.col("best_before").alias("expiry_date"),
        F.col("maker").alias("manufacturer"), F.lit(None).cast("string").alias("marketed_by"), F.lit(None).cast("string").alias("importer"), F.col("origin").alias("country_of_origin"), F.col("licence").alias("fssai_license"), F.concat_ws(", ", "phone", "email").alias("consumer_care"), F.col("batch").alias("batch_number"), "ingredients", "is_food", "supplier_id",
    )


def _label_pairs(spark, d, step: int):
    t = _truth(spark, d).select("label_id")
    return t.join(t.select((F.col("label_id") - step).alias("label_id")), "label_id", "left_semi").select(F.col("label_id").alias("label_a"), (F.col("label_id") + step).alias("label_b"))


PAIRS = "p AS (SELECT a.label_id AS label_a, b.label_id AS label_b FROM label_truth a JOIN label_truth b ON b.label_id = a.label_id + {0})"
#: The declarations that two versions are compared by.
COMPARED_FIELDS = ("product_name", "brand", "mrp", "net_quantity", "unit_sale_price", "manufacturing_date", "expiry_date", "manufacturer", "marketed_by", "importer", "country_of_origin", "fssai_license", "consumer_care", "batch_number")


@query("f03_field_diff", f"""WITH {PAIRS.format(7)}, l AS (UNPIVOT (SELECT label_id, product_name, CAST(brand AS VARCHAR) AS brand, CAST(price AS VARCHAR) AS mrp, CAST(amount AS VARCHAR) || ' ' || unit AS net_quantity, 'USP: ' || usp || ' per g' AS unit_sale_price, made AS manufacturing_date, best_before AS expiry_date, maker AS manufacturer,
  CAST(NULL AS VARCHAR) AS marketed_by, CAST(NULL AS VARCHAR) AS importer, origin AS country_of_origin, licence AS fssai_license, phone || ', ' || email AS consumer_care, batch AS batch_number FROM label_truth) ON {', '.join(COMPARED_FIELDS)} INTO NAME field VALUE value),
a AS (SELECT p.*, field, value AS value_a FROM p JOIN l ON label_id = label_a), b AS (SELECT p.*, field, value AS value_b FROM p JOIN l ON label_id = label_b),
v AS (SELECT *, CASE WHEN field IN ('mrp', 'net_quantity') THEN CAST(string_split(value_a, ' ')[1] AS DOUBLE) END AS na, CASE WHEN field IN ('mrp', 'net_quantity') THEN CAST(string_split(value_b, ' ')[1] AS DOUBLE) END AS nb FROM a FULL JOIN b USING (label_a, label_b, field)),
j AS (SELECT *, round(nb - na, 2) AS delta FROM v)
SELECT label_a, label_b, field, value_a, value_b, CASE WHEN value_a IS NULL THEN 'ADDED' WHEN value_b IS NULL THEN 'REMOVED' WHEN lower(value_a) = lower(value_b) THEN 'UNCHANGED' ELSE 'CHANGED' END AS change, delta, round(100 * delta / nullif(na, 0), 1) AS percent FROM j""", ("label_truth",))  # fmt: skip
def f03(spark, d):
    return R.field_diff(_label_pairs(spark, d, 7), _as_declared(_truth(spark, d)), COMPARED_FIELDS)


@query("f04_h06_ingredient_diff", f"""WITH {PAIRS.format(1)}, t AS (SELECT label_id, list_filter(list_transform(string_split(coalesce(ingredients, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS t FROM label_truth),
j AS (SELECT label_a, label_b, a.t AS ta, b.t AS tb FROM p JOIN t a ON a.label_id = label_a JOIN t b ON b.label_id = label_b)
SELECT label_a, label_b, array_to_string(list_sort([x FOR x IN tb IF NOT list_contains(ta, x)]), ', ') AS added, array_to_string(list_sort([x FOR x IN ta IF NOT list_contains(tb, x)]), ', ') AS removed,
  array_to_string(list_sort([x FOR x IN ta IF list_contains(tb, x)]), ', ') AS common, CASE WHEN list_sort(ta) = list_sort(tb) THEN CASE WHEN ta = tb THEN 'UNCHANGED' ELSE 'REORDERED_ONLY' END ELSE 'CHANGED' END AS state FROM j""", ("label_truth",))  # fmt: skip
def f04(spark, d):
    return R.ingredient_diff(_label_pairs(spark, d, 1), _truth(spark, d).select("label_id", "ingredients"))


FACTS = "f AS (UNPIVOT (SELECT label_id, CAST(protein AS DOUBLE) AS protein, CAST(sugar AS DOUBLE) AS sugar, CAST(fat AS DOUBLE) AS fat FROM label_truth) ON protein, sugar, fat INTO NAME nutrient VALUE amount)"


@query("f05_nutrient_diff", f"""WITH {PAIRS.format(1)}, {FACTS}, a AS (SELECT p.*, nutrient, amount AS amount_a FROM p JOIN f ON label_id = label_a), b AS (SELECT p.*, nutrient, amount AS amount_b FROM p JOIN f ON label_id = label_b)
SELECT label_a, label_b, nutrient, amount_a, amount_b, round(amount_b - amount_a, 2) AS delta FROM a FULL JOIN b USING (label_a, label_b, nutrient)""", ("label_truth",))  # fmt: skip
def f05(spark, d):
    return R.nutrient_diff(_label_pairs(spark, d, 1), E.nutrition_facts(frame(spark, d, "label_text")))


#: The listing of a label: a fifth ask twice the price, a sixth leave the quantity out, others name another maker, licence or unit.
LISTED = """l AS (SELECT label_id, product_name, CAST(amount AS VARCHAR) || ' ' || unit AS quantity, CAST(price AS VARCHAR) AS mrp, maker, licence, origin,
  CASE WHEN label_id % 9 = 0 THEN 'Zz' ELSE product_name END AS l_product_name, CASE WHEN label_id % 6 <> 0 THEN CAST(CASE WHEN label_id % 7 = 0 THEN amount * 10 ELSE amount END AS VARCHAR) || ' ' || unit END AS l_quantity,
  CASE WHEN label_id % 11 <> 0 THEN CAST(CAST(CASE WHEN label_id % 5 = 0 THEN price * 2 WHEN label_id % 5 = 1 THEN price / 2 ELSE price END AS DECIMAL(12,2)) AS VARCHAR) END AS l_mrp,
  CASE WHEN label_id % 13 = 0 THEN 'Zzyzx Qwk' ELSE maker END AS l_maker, CASE WHEN label_id % 8 = 0 THEN reverse(licence) WHEN label_id % 8 <> 1 THEN licence END AS l_licence, CASE WHEN label_id % 10 <> 0 THEN 'INDIA' END AS l_origin FROM label_truth),
v AS (SELECT label_id, unnest([
 {'field': 'product_name', 'package': product_name, 'listing': l_product_name, 'same': label_id % 9 <> 0, 'high': 'HIGH', 'none': 'MEDIUM'},
 {'field': 'net_quantity', 'package': quantity, 'listing': l_quantity, 'same': label_id % 7 <> 0, 'high': 'CRITICAL', 'none': 'HIGH'},
 {'field': 'mrp', 'package': mrp, 'listing': l_mrp, 'same': abs(CAST(mrp AS DOUBLE) - CAST(l_mrp AS DOUBLE)) < 0.01, 'high': CASE WHEN label_id % 5 = 0 THEN 'CRITICAL' ELSE 'HIGH' END, 'none': 'HIGH'},
 {'field': 'manufacturer', 'package': maker, 'listing': l_maker, 'same': label_id % 13 <> 0, 'high': 'HIGH', 'none': 'MEDIUM'},
 {'field': 'fssai_license', 'package': licence, 'listing': l_licence, 'same': licence = l_licence, 'high': 'CRITICAL', 'none': 'HIGH'},
 {'field': 'country_of_origin', 'package': origin, 'listing': l_origin, 'same': lower(origin) = 'india', 'high': 'CRITICAL', 'none': 'HIGH'}]) AS v FROM l),
r AS (SELECT label_id, v.field AS field, v.package AS package, v.listing AS listing, CASE WHEN v.listing IS NULL THEN 'INSUFFICIENT_DATA' WHEN v.same THEN 'MATCH' ELSE 'MISMATCH' END AS result,
 CASE WHEN v.listing IS NULL THEN v.none WHEN v.same THEN 'INFO' ELSE v.high END AS severity FROM v WHERE v.package IS NOT NULL)"""


def _listed(spark, d):
    own = _as_declared(_truth(spark, d)).select("label_id", "product_name", "net_quantity", "mrp", "manufacturer", "fssai_license", "country_of_origin")
    n = lambda k, r=0: F.col("label_id") % k == r
    price = F.col("mrp").cast("decimal(12,2)")
    amount, unit = F.split("net_quantity", " ")[0], F.split("net_quantity", " ")[1]
    listing = own.withColumns(
        {
            "product_name": F.when(n(9), "Zz").otherwise(F.col("product_name")),
            "net_quantity": F.when(~n(6), F.concat(F.when(n(7), (amount.cast("int") * 10).cast("string")).otherwise(amount), F.lit(" "), unit)),
            "mrp": F.when(~n(11), F.when(n(5), price * 2).when(n(5, 1), price / 2).otherwise(price).cast("decimal(12,2)").cast("string")),
            "manufacturer": F.when(n(13), "Zzyzx Qwk").otherwise(F.col("manufacturer")),
            "fssai_license": F.when(n(8), F.reverse("fssai_license")).when(~n(8, 1), F.col("fssai_license")),
            "country_of_origin": F.when(~n(10), "INDIA"),
        }
    )
    return R.package_vs_listing(own, listing)


@query("f07_package_vs_listing", f"WITH {LISTED} SELECT * FROM r", ("label_truth",))
def f07(spark, d):
    return _listed(spark, d)


@query("f07_listing_verdict", f"""WITH {LISTED}, n AS (SELECT label_id, count(*) FILTER (result = 'MATCH') AS matches, count(*) FILTER (result = 'MISMATCH') AS mismatches, count(*) FILTER (result = 'INSUFFICIENT_DATA') AS insufficient FROM r GROUP BY 1)
SELECT *, CASE WHEN mismatches > 0 THEN 'MISMATCH_DETECTED' WHEN insufficient > 0 THEN 'INSUFFICIENT_ONLINE_DATA' ELSE 'COMPLIANT_MATCH' END AS verdict FROM n""", ("label_truth",))  # fmt: skip
def f07_verdict(spark, d):
    return R.listing_verdict(_listed(spark, d))


def _licences(spark, d, every: int):
    t = _truth(spark, d).filter(f"licence IS NOT NULL AND supplier_id % {every} = 0")
    return t.select(F.col("licence").alias("fssai_license"), F.col("maker").alias("record")).distinct()


@query("f08_licence_lookup", """SELECT label_id, licence AS fssai_license, CASE WHEN licence IS NULL THEN 'INVALID_FORMAT' WHEN supplier_id % 2 = 0 THEN 'PROVIDER_1' WHEN supplier_id % 3 = 0 THEN 'PROVIDER_2' ELSE 'NOT_FOUND' END AS source,
CASE WHEN licence IS NOT NULL AND (supplier_id % 2 = 0 OR supplier_id % 3 = 0) THEN maker END AS record FROM label_truth""", ("label_truth",))  # fmt: skip
def f08(spark, d):
    keys = _as_declared(_truth(spark, d)).select("label_id", "fssai_license")
    return R.lookup(keys, [_licences(spark, d, 2), _licences(spark, d, 3)], "fssai_license", C.licence_valid(F.col("fssai_license")))


CODES = """b AS (SELECT product_id, name, code12, CAST(10 - (CAST(list_sum([CAST(substr(code12, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END FOR i IN range(1, 13)]) AS INT)) % 10 AS INT) % 10 AS c FROM products),
g AS (SELECT product_id, name, code12 || CAST(CASE WHEN product_id % 8 = 0 THEN (c + 3) % 10 ELSE c END AS VARCHAR) AS code, product_id % 8 <> 0 AS valid FROM b)"""


def _codes(spark, d):
    p = frame(spark, d, "products")
    c = C.check_digit(F.col("code12")).cast("int")
    return p.select("product_id", "name", F.concat("code12", F.when(F.col("product_id") % 8 == 0, (c + 3) % 10).otherwise(c).cast("string")).alias("code"))


@query("f09_gtin_lookup", f"WITH {CODES} SELECT product_id, code, CASE WHEN NOT valid THEN 'INVALID_FORMAT' WHEN product_id % 2 = 1 THEN 'PROVIDER_1' WHEN product_id % 3 = 0 THEN 'PROVIDER_2' ELSE 'NOT_FOUND' END AS source, CASE WHEN valid AND (product_id % 2 = 1 OR product_id % 3 = 0) THEN name END AS record FROM g", ("products",))
def f09(spark, d):
    c = _codes(spark, d)
    provider = lambda cond: c.filter(cond).select("code", F.col("name").alias("record"))
    return R.lookup(c.select("product_id", "code"), [provider("product_id % 2 = 1"), provider("product_id % 3 = 0")], "code", C.gtin_valid(F.col("code")))


@query("f11_f12_registry_names", "SELECT label_id, CASE WHEN supplier_id % 4 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS result FROM label_truth", ("label_truth",))
def f11(spark, d):
    t = _truth(spark, d).select("label_id", "maker", F.when(F.col("supplier_id") % 4 == 0, "Zzyzx Qwk").otherwise(F.regexp_replace("maker", "Foods Pvt Ltd", "Private Limited")).alias("registered"))
    return t.select("label_id", R.graded(R.similarity(F.col("maker"), F.col("registered")), 0.70, 0.40).alias("result"))


@query("cj4_entity_match", "SELECT s_suppkey AS id, s_suppkey AS match_id, 'Supplier ' || CAST(s_suppkey AS VARCHAR) || ' Private Limited' AS match_name, 1.0::DOUBLE AS score FROM supplier")
def cj4(spark, d):
    s = frame(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    name = lambda tail: F.concat(F.lit("Supplier "), F.col("id").cast("string"), F.lit(tail)).alias("name")
    return R.best_match(s.select("id", name(" Foods Pvt Ltd")), s.select("id", name(" Private Limited")))


@query("f13_code_payload", "SELECT label_id, licence IS NOT NULL AS licence_match, price IS NOT NULL AS price_match FROM label_truth", ("label_truth",))
def f13(spark, d):
    t = _truth(spark, d)
    payload = F.concat_ws(" ", F.lit("https://id.example/01/08901234567890/10/L7?"), F.concat(F.lit("FSSAI "), "licence"), F.concat(F.lit("Rs "), F.col("price").cast("string")))
    j = t.select("label_id", "licence", F.col("price").cast("string").alias("price"), payload.alias("payload"))
    return j.select("label_id", F.coalesce(C.payload_licence(F.col("payload")) == F.col("licence"), F.lit(False)).alias("licence_match"), F.coalesce(F.col("payload").contains(F.col("price")), F.lit(False)).alias("price_match"))


def _compared(spark, d):
    t = _as_declared(_truth(spark, d))
    i = F.col("label_id")
    code = F.when(i % 9 != 2, F.concat(F.lit("890"), F.lpad(i.cast("string"), 10, "0")))
    reg = t.withColumns(
        {
            "r_name": F.when(i % 6 == 0, F.lit("Quartz Vase")).when(i % 6 == 1, F.concat(F.lit("Crisp "), F.col("product_name"))).when(i % 6 == 2, F.regexp_replace("product_name", " ", "")).otherwise(F.upper("product_name")),
            "r_brand": F.when(i % 8 == 0, F.lit("Other")).when(i % 8 != 1, F.lower("brand")),
            "r_maker": F.when(i % 10 == 0, F.lit("Zzyzx Qwk")).otherwise(F.concat(F.col("manufacturer"), F.lit(" (India)"))),
            "r_quantity": F.when(i % 12 == 0, F.lit("5 kg")).when(i % 12 == 1, F.regexp_extract("net_quantity", r"(\d+ *[a-z]+)", 1)).otherwise(F.col("net_quantity")),
            "r_price": F.when(i % 4 != 0, (F.col("mrp").cast("decimal(12,2)") + F.when(i % 4 == 1, 5).otherwise(0)).cast("string")),
            "r_licence": F.when(i % 14 == 0, F.lit("10000000000000")).when(i % 14 != 1, F.col("fssai_license")),
            "barcode": code,
            "r_code": F.when(i % 16 == 0, F.lit("8999999999999")).when(i % 16 != 1, code),
        }
    )
    fields = {"product_name": ("product_name", "r_name", "text"), "brand": ("brand", "r_brand", "brand"), "manufacturer": ("manufacturer", "r_maker", "maker"), "net_quantity": ("net_quantity", "r_quantity", "quantity"), "fssai_license": ("fssai_license", "r_licence", "digits"), "barcode": ("barcode", "r_code", "digits"), "mrp": ("mrp", "r_price", "price")}
    return R.compared(reg, ("label_id",), fields)


COMPARED = """r AS (SELECT label_id, licence, unnest([{'field': 'product_name', 'result': CASE WHEN label_id % 6 = 0 THEN 'MISMATCH' ELSE 'MATCH' END},
 {'field': 'brand', 'result': CASE label_id % 8 WHEN 0 THEN 'MISMATCH' WHEN 1 THEN 'NOT_FOUND' ELSE 'MATCH' END},
 {'field': 'manufacturer', 'result': CASE WHEN label_id % 10 = 0 THEN 'MISMATCH' ELSE 'MATCH' END},
 {'field': 'net_quantity', 'result': CASE WHEN label_id % 12 = 0 THEN CASE WHEN amount IS NULL THEN 'NOT_VERIFIED' ELSE 'MISMATCH' END WHEN amount IS NULL THEN 'NOT_FOUND' ELSE 'MATCH' END},
 {'field': 'fssai_license', 'result': CASE WHEN licence IS NULL THEN 'NOT_FOUND' WHEN label_id % 14 = 0 THEN 'MISMATCH' WHEN label_id % 14 = 1 THEN 'NOT_VERIFIED' ELSE 'MATCH' END},
 {'field': 'barcode', 'result': CASE WHEN label_id % 9 = 2 THEN 'NOT_FOUND' WHEN label_id % 16 = 0 THEN 'MISMATCH' WHEN label_id % 16 = 1 THEN 'NOT_VERIFIED' ELSE 'MATCH' END},
 {'field': 'mrp', 'result': CASE WHEN price IS NULL OR label_id % 4 = 0 THEN 'NOT_COMPARABLE' WHEN label_id % 4 = 1 THEN 'MISMATCH' ELSE 'MATCH' END}]) AS r FROM label_truth),
v AS (SELECT label_id, r.field AS field, r.result AS result, licence FROM r)"""


@query("f14_f15_field_compare", f"WITH {COMPARED} SELECT label_id, field, result FROM v", ("label_truth",))
def f14(spark, d):
    return _compared(spark, d)


@query("i15_i16_i17_consistency", f"""WITH {COMPARED}, s AS (SELECT label_id, ['VERIFIED', 'NOT_FOUND', 'UNAVAILABLE', 'INVALID_FORMAT', NULL][label_id % 5 + 1] AS lic, ['VERIFIED', 'UNAVAILABLE', 'NOT_FOUND', 'NOT_APPLICABLE'][label_id % 4 + 1] AS code FROM label_truth),
g AS (SELECT label_id, count(*) FILTER (WHERE result = 'MATCH') AS m, count(*) FILTER (WHERE result = 'PARTIAL') AS p, count(*) FILTER (WHERE result = 'MISMATCH') AS x, count(*) FILTER (WHERE result = 'MISMATCH' AND field IN ('fssai_license', 'mrp')) AS critical
  FROM (SELECT label_id, field, CASE WHEN field = 'brand' AND result = 'MATCH' AND label_id % 3 = 0 THEN 'PARTIAL' ELSE result END AS result FROM v WHERE label_id % 11 <> 0) GROUP BY 1),
h AS (SELECT s.label_id, lic, code, coalesce(m, 0) AS m, coalesce(p, 0) AS p, coalesce(x, 0) AS x, coalesce(critical, 0) AS critical FROM s LEFT JOIN g USING (label_id)),
a AS (SELECT *, coalesce((200 * m + 100 * p + (m + p + x)) // nullif(2 * (m + p + x), 0), 0) AS ah FROM h),
c AS (SELECT *, ah / 100 AS agreement, CASE WHEN lic IN ('VERIFIED', 'NOT_FOUND', 'UNAVAILABLE') THEN 150 ELSE 0 END + CASE WHEN code IN ('VERIFIED', 'NOT_FOUND', 'UNAVAILABLE') THEN 150 ELSE 0 END + CASE WHEN lic = 'VERIFIED' THEN 200 ELSE 0 END + CASE WHEN code = 'VERIFIED' THEN 150 ELSE 0 END + (35 * ah + 5) // 10 AS raw FROM a),
z AS (SELECT *, least(100, (greatest(0, raw - 350 * critical) + 5) // 10) / 100 AS confidence FROM c)
SELECT label_id, m AS match, p AS partial, x AS mismatch, critical, agreement, CASE WHEN x > 0 THEN 'MISMATCH' WHEN p > 0 THEN 'PARTIAL' WHEN m > 0 THEN 'MATCH' ELSE 'UNVERIFIED' END AS overall, confidence,
  CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.45 THEN 'MEDIUM' WHEN confidence > 0 THEN 'LOW' ELSE 'ZERO' END AS tier,
  CASE WHEN x > 0 THEN 'REVIEW_REQUIRED' WHEN m > 0 THEN 'MATCH' WHEN lic = 'UNAVAILABLE' AND code = 'UNAVAILABLE' THEN 'EXTERNAL_VERIFICATION_UNAVAILABLE' WHEN lic = 'NOT_FOUND' OR code = 'NOT_FOUND' THEN 'EXTERNAL_DATA_NOT_FOUND' ELSE 'NOT_VERIFIED' END AS verdict FROM z""", ("label_truth",))  # fmt: skip
def i15(spark, d):
    i = F.col("label_id")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x).cast("string") for x in v)), (i % n + 1).cast("int"))
    known = _truth(spark, d).select("label_id", pick(5, "VERIFIED", "NOT_FOUND", "UNAVAILABLE", "INVALID_FORMAT", None).alias("licence_status"), pick(4, "VERIFIED", "UNAVAILABLE", "NOT_FOUND", "NOT_APPLICABLE").alias("code_status"))
    partial = (F.col("field") == "brand") & (F.col("result") == "MATCH") & (i % 3 == 0)
    results = _compared(spark, d).filter(i % 11 != 0).withColumn("result", F.when(partial, "PARTIAL").otherwise(F.col("result")))  # a label in eleven was never compared
    return R.consistency(results.withColumn("critical", (F.col("result") == "MISMATCH") & F.col("field").isin("fssai_license", "mrp")), known, "label_id")


@query("f16_barcode_verdict", f"WITH {CODES} SELECT product_id, code, CASE WHEN NOT valid THEN CASE WHEN product_id % 3 = 0 THEN 'checksum,name' ELSE 'checksum' END WHEN product_id % 3 = 0 THEN 'name' ELSE '' END AS discrepancies, CASE WHEN NOT valid OR product_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM g", ("products",))
def f16(spark, d):
    c = _codes(spark, d)
    reg = c.filter("product_id % 3 <> 2").select("code", F.when(F.col("product_id") % 3 == 0, F.lit("something else")).otherwise(F.upper("name")).alias("name"))
    return R.barcode_verdict(c, reg)


@query("f17_master_record", "SELECT product_id, name AS product_name, brand AS brand_name, CASE WHEN product_id % 2 = 0 THEN CAST(size AS VARCHAR) || ' g' END AS net_content, 'colour' AS unused FROM products", ("products",))
def f17(spark, d):
    p = frame(spark, d, "products")
    title = F.when(F.col("product_id") % 2 == 0, "title").otherwise("product_name")
    payload = F.create_map(title, "name", F.lit("brandName"), "brand", F.lit("size"), F.when(F.col("product_id") % 2 == 0, F.concat(F.col("size").cast("string"), F.lit(" g"))), F.lit("colour"), F.lit("red"))
    return R.master_record(p.select("product_id", payload.alias("payload")), {"product_name": ("product_name", "title"), "brand_name": ("brand", "brandName"), "net_content": ("net_content", "size")})


@query("f18_identity_conflicts", f"""WITH {CODES}, l AS (SELECT t.*, g.code, supplier_id % 3 = 0 AS other_maker, label_id % 5 = 0 AS other_quantity, label_id % 7 = 0 AS other_brand, label_id % 13 = 3 AS other_qr FROM label_truth t LEFT JOIN g ON g.product_id = t.label_id AND label_id % 4 <> 3),
k AS (SELECT *, licence IS NOT NULL AND supplier_id % 2 = 0 AS licensed, code IS NOT NULL AND label_id % 2 = 0 AS known, licence IS NOT NULL AND supplier_id % 4 = 1 AS lic_absent, code IS NOT NULL AND label_id % 8 = 1 AS code_absent FROM l),
c AS (SELECT *, concat_ws(',', CASE WHEN licence IS NOT NULL AND other_qr THEN 'licence' END, CASE WHEN amount IS NOT NULL AND label_id % 19 = 1 THEN 'quantity_code' END, CASE WHEN known AND amount IS NOT NULL AND other_quantity THEN 'quantity' END,
  CASE WHEN known AND other_brand THEN 'brand' END, CASE WHEN licensed AND other_maker THEN 'maker' END, CASE WHEN code IS NOT NULL AND origin = 'Nepal' THEN 'origin' END) AS conflicts FROM k)
SELECT label_id, conflicts, CASE WHEN conflicts <> '' THEN 'CONFLICT_DETECTED' WHEN licensed OR known THEN 'PASS' WHEN lic_absent OR code_absent THEN 'REGISTRY_NOT_FOUND' WHEN licence IS NULL AND code IS NULL THEN 'NOT_CHECKED' ELSE 'REGISTRY_UNAVAILABLE' END AS status FROM c""", ("label_truth", "products"))  # fmt: skip
def f18(spark, d):
    i, s = F.col("label_id"), F.col("supplier_id")
    codes = _codes(spark, d).select(F.col("product_id").alias("label_id"), F.col("code").alias("barcode")).filter(i % 4 != 3)
    t = _as_declared(_truth(spark, d)).join(codes, "label_id", "left")
    issuer = J.with_issuer(t.filter("barcode IS NOT NULL").select("label_id", "barcode"), "barcode").select("label_id", F.regexp_replace("issuer", "^GS1 ", "").alias("code_country"))
    label = t.join(issuer, "label_id", "left").withColumns({"qr_licence": F.when(i % 13 == 3, F.lit("20000000000000")).otherwise(F.col("fssai_license")), "qr_weight": F.when(i % 19 == 1, F.lit("7 kg")).otherwise(F.regexp_replace("net_quantity", " ", ""))})
    firm = F.when(s % 3 == 0, F.lit("Zzyzx Qwk")).otherwise(F.upper("manufacturer"))
    licences = t.filter("fssai_license IS NOT NULL AND (supplier_id % 2 = 0 OR supplier_id % 4 = 1)").select("fssai_license", F.when(s % 2 == 0, "VERIFIED").otherwise("NOT_FOUND").alias("licence_status"), F.when(s % 2 == 0, firm).alias("business_name")).distinct()
    content = F.when(i % 5 == 0, F.lit("77777 g")).otherwise(F.col("net_quantity"))
    master = t.filter("barcode IS NOT NULL AND (label_id % 2 = 0 OR label_id % 8 = 1)").select("barcode", F.when(i % 2 == 0, "VERIFIED").otherwise("NOT_FOUND").alias("code_status"), F.when(i % 2 == 0, F.when(i % 7 == 0, F.lit("Zzyzx")).otherwise(F.lower("brand"))).alias("brand_name"), F.when(i % 2 == 0, content).alias("net_content"))
    return R.identity_conflicts(label, licences, master)


@query("f19_identity_record", """WITH r AS (SELECT label_id, is_food, unnest([{'field': 'brand', 'v': CAST(brand AS VARCHAR)}, {'field': 'mrp', 'v': CAST(price AS VARCHAR)}, {'field': 'fssai_license', 'v': licence}]) AS r FROM label_truth)
SELECT label_id, r.field AS field, CASE WHEN r.v IS NOT NULL THEN 'FOUND' WHEN r.field = 'fssai_license' AND NOT is_food THEN 'NOT_APPLICABLE' ELSE 'NOT_FOUND' END AS status FROM r""", ("label_truth",))  # fmt: skip
def f19(spark, d):
    fields = ("brand", "mrp", "fssai_license")
    dec = E.declarations(frame(spark, d, "label_text"), fields).join(by_label(_truth(spark, d).select("label_id", "is_food")), "label_id")
    return R.identity_record(dec, fields, ("fssai_license",), F.col("is_food")).select("label_id", "field", "status")


def _corrections(spark, d):
    c = frame(spark, d, "conversations")
    rule = F.concat(F.lit("LM-00"), (F.col("turn") % 9 + 1).cast("string"))
    return c.select(F.col("conv_id").alias("screening_id"), rule.alias("rule_id"), F.when(F.col("role") == "user", "PASS").otherwise("FAIL").alias("status"), F.col("turn").alias("at"))


HUMAN = "h AS (SELECT conv_id AS screening_id, 'LM-00' || CAST(turn % 9 + 1 AS VARCHAR) AS rule_id, arg_max(CASE WHEN role = 'user' THEN 'PASS' ELSE 'FAIL' END, turn) AS human, max(turn) AS \"at\" FROM conversations GROUP BY 1, 2)"


@query("f25_g05_machine_vs_human", f"WITH {HUMAN} SELECT screening_id, rule_id, status AS machine, coalesce(human, status) AS final, coalesce(human <> status, false) AS changed FROM rule_checks LEFT JOIN h USING (screening_id, rule_id)", ("rule_checks",))
def f25(spark, d):
    return R.machine_vs_human(frame(spark, d, "rule_checks"), _corrections(spark, d))


@query("i32_recalculated_scores", f"WITH {HUMAN}, {SCORES.replace('FROM checks', 'FROM corrected')} SELECT screening_id, score, risk_level FROM risks".replace("WITH h AS", "WITH h AS", 1).replace(", s AS (SELECT screening_id", ", corrected AS (SELECT screening_id, rule_id, severity, coalesce(human, status) AS status FROM rule_checks LEFT JOIN h USING (screening_id, rule_id)), s AS (SELECT screening_id", 1), ("rule_checks",))
def i32(spark, d):
    c = frame(spark, d, "rule_checks")
    final = R.machine_vs_human(c, _corrections(spark, d)).select("screening_id", "rule_id", F.col("final").alias("status"))
    return S.scores(c.drop("status").join(final, ["screening_id", "rule_id"])).select("screening_id", "score", "risk_level")


@query("f31_apply_actions", f"WITH {HUMAN} SELECT screening_id, rule_id, CASE human WHEN 'PASS' THEN 'APPROVE' ELSE 'REJECT' END AS action, \"at\", status AS previous_value, human AS new_value FROM rule_checks JOIN h USING (screening_id, rule_id)", ("rule_checks",))
def f31(spark, d):
    acts = _corrections(spark, d).select("screening_id", "rule_id", F.when(F.col("status") == "PASS", "APPROVE").otherwise("REJECT").alias("action"), "at")
    return R.apply_actions(frame(spark, d, "rule_checks"), acts)[1]


@query("f27_duplicate_boxes", """WITH e AS (SELECT screening_id AS label_id, CAST(line % 3 AS VARCHAR) AS bbox, CASE WHEN rule_id = 'FS-002' THEN 'LM-002' ELSE rule_id END AS r FROM checks)
SELECT label_id, bbox, string_agg(DISTINCT r, ',' ORDER BY r) AS rules FROM e GROUP BY ALL HAVING count(DISTINCT r) > 1""", ("checks",))  # fmt: skip
def f27(spark, d):
    return R.duplicate_boxes(frame(spark, d, "checks").select(F.col("screening_id").alias("label_id"), "rule_id", (F.col("line") % 3).cast("string").alias("bbox")))


@query("f28_artwork_chain", """WITH RECURSIVE a AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id FROM part),
c AS (SELECT id, id AS root, 1 AS iteration, '' AS ancestors FROM a WHERE parent_id IS NULL UNION ALL SELECT a.id, c.root, c.iteration + 1, concat_ws('/', nullif(c.ancestors, ''), CAST(c.id AS VARCHAR)) FROM a JOIN c ON a.parent_id = c.id) SELECT * FROM c""")  # fmt: skip
def f28(spark, d):
    p = frame(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).alias("parent_id"))
    return R.artwork_chain(p)


@query("f29_snapshots", """SELECT v.ref, CASE WHEN s.id IS NOT NULL THEN 'SCREENING' WHEN p.p_partkey IS NOT NULL THEN 'ARTWORK' END AS kind, coalesce(s.score, p.p_size)::DOUBLE AS score, coalesce(s.product_name, p.p_name) AS label
FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE 'A' END || CAST(o_orderkey AS VARCHAR) AS ref, o_orderkey AS k FROM orders) v LEFT JOIN screenings s ON s.id = k AND ref LIKE 'S%' LEFT JOIN part p ON p_partkey = k AND ref LIKE 'A%'""", ("screenings",))  # fmt: skip
def f29(spark, d):
    k = F.col("o_orderkey")
    ids = frame(spark, d, "orders").select(F.concat(F.when(k % 2 == 0, "S").otherwise("A"), k.cast("string")).alias("ref"))
    s = frame(spark, d, "screenings").select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("ref"), "score", F.col("product_name").alias("label"))
    p = frame(spark, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("ref"), F.col("p_size").cast("double").alias("score"), F.col("p_name").alias("label"))
    return R.resolve_snapshots(ids, s, p)


def _evidence_labels(spark, d):
    t = _truth(spark, d)
    facts = F.map_filter(F.create_map(*(x for k in ("protein", "sugar", "fat") for x in (F.lit(k), F.col(k).cast("double")))), lambda k, v: v.isNotNull())
    return frame(spark, d, "label_text").join(t.select("label_id", "ingredients", facts.alias("facts"), F.col("origin").alias("country_of_origin")), "label_id")


def _claims(spark, d):
    return K.claim_job(_evidence_labels(spark, d), K.claim_rules(spark))


#: Each claim of the fixture: what decides its status, as status and confidence of its evidence (null without evidence, 0 for none of its own).
_ING = "CASE WHEN ingredients IS NULL THEN {none} WHEN regexp_matches(ingredients, '{bad}') THEN ['POTENTIAL_CONTRADICTION', '85'] ELSE {ok} END"
VERDICTS = {
    "CLAIM-RULE-ING-001": "CASE WHEN regexp_matches(ingredients, 'ins 211|sodium benzoate') THEN ['POTENTIAL_CONTRADICTION', '85'] ELSE ['SUPPORTED', '85'] END",
    "CLAIM-RULE-NUT-001": _ING.format(none="['INSUFFICIENT_EVIDENCE', '0']", bad="sugar|honey", ok="['SUPPORTED', '0']"),
    "CLAIM-RULE-NUT-002": "CASE WHEN regexp_matches(ingredients, 'sugar|honey') THEN ['POTENTIAL_CONTRADICTION', '85'] WHEN sugar > 0.5 THEN ['POTENTIAL_CONTRADICTION', '0'] WHEN sugar IS NOT NULL THEN ['SUPPORTED', '0'] ELSE ['INSUFFICIENT_EVIDENCE', '0'] END",
    # Without a declared value the number after the word counts, even if it is the unit price or the second price below.
    "CLAIM-RULE-NUT-003": "CASE WHEN coalesce(protein, CAST(usp AS DOUBLE), CASE WHEN stamped THEN 9.5 END) IS NULL THEN ['INSUFFICIENT_EVIDENCE', '0'] WHEN coalesce(protein, CAST(usp AS DOUBLE), 9.5) >= 12 THEN ['SUPPORTED', '92'] ELSE ['POTENTIAL_CONTRADICTION', '90'] END",
    "CLAIM-RULE-NUT-004": "CASE WHEN fat IS NULL THEN ['INSUFFICIENT_EVIDENCE', NULL] WHEN fat <= 3 THEN ['SUPPORTED', '0'] ELSE ['POTENTIAL_CONTRADICTION', '0'] END",
    "CLAIM-RULE-NUT-005": "['INSUFFICIENT_EVIDENCE', NULL]",
    "CLAIM-RULE-ING-002": _ING.format(none="['INSUFFICIENT_EVIDENCE', '0']", bad="sodium benzoate", ok="['HIGH_RISK_REVIEW', '0']"),
    "CLAIM-RULE-ING-003": "CASE WHEN ingredients IS NULL THEN ['INSUFFICIENT_EVIDENCE', NULL] ELSE ['SUPPORTED', '0'] END",
    "CLAIM-RULE-ORG-001": "CASE WHEN origin = 'Nepal' THEN ['POTENTIAL_CONTRADICTION', '0'] ELSE ['SUPPORTED', '0'] END",
    "CLAIM-RULE-CRT-001": "CASE WHEN claim_text LIKE '%NPOP%' THEN ['SUPPORTED', '0'] ELSE ['INSUFFICIENT_EVIDENCE', '0'] END",
    "CLAIM-RULE-HLT-001": "['HIGH_RISK_REVIEW', '0']",
    "CLAIM-RULE-QLT-001": "CASE WHEN ingredients IS NULL THEN ['INSUFFICIENT_EVIDENCE', NULL] ELSE ['POTENTIAL_CONTRADICTION', '85'] END",
    **{r: "['HIGH_RISK_REVIEW', '90']" for r in ("CLAIM-RULE-ING-004", "CLAIM-RULE-MED-001", "CLAIM-RULE-MED-002", "CLAIM-RULE-CMP-001", "CLAIM-RULE-ENV-001")},
    "CLAIM-RULE-HLT-002": "['HIGH_RISK_REVIEW', NULL]",
    **{r: "['NOT_ASSESSABLE', NULL]" for r in ("CLAIM-RULE-CRT-002", "CLAIM-RULE-QLT-002")},
}
_CASES = " ".join(f"WHEN claim_rule = '{r}' THEN {v}" for r, v in VERDICTS.items())
_flag = lambda rules, words: f"(coalesce(claim_rule IN ({', '.join(map(repr, rules))}), false) OR len(list_filter([{', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in words)}], lambda w: contains(claim, w))) > 0)"
_FOUND = "CASE WHEN claim_rule = 'CLAIM-RULE-ING-001' THEN CASE kind WHEN 1 THEN 'ins 211' WHEN 4 THEN 'sodium benzoate' END WHEN claim_rule IN ('CLAIM-RULE-NUT-001', 'CLAIM-RULE-NUT-002') THEN CASE kind WHEN 1 THEN 'sugar' WHEN 4 THEN 'honey' END WHEN claim_rule = 'CLAIM-RULE-ING-002' AND kind = 4 THEN 'sodium benzoate' END"
CLAIMS = f"""k AS (SELECT *, {_FOUND} AS hits, CASE {_CASES} WHEN claim = 'completely fresh' THEN ['HIGH_RISK_REVIEW', NULL] ELSE ['HIGH_RISK_REVIEW', '90'] END AS v FROM label_truth WHERE claim IS NOT NULL),
a AS (SELECT label_id, claim_rule AS rule_id, claim, hits, v[1] AS status, CAST(v[2] AS DOUBLE) AS e, {_flag(K.ABSOLUTE_RULES, K.ABSOLUTE)} AS is_absolute, {_flag(K.COMPARATIVE_RULES, K.COMPARATIVE)} AS is_comparative, {_flag(K.HIGH_RISK_RULES, K.HIGH_RISK)} AS is_high_risk FROM k),
s AS (SELECT *, CASE WHEN e > 0 THEN e WHEN e = 0 THEN 85 WHEN status = 'INSUFFICIENT_EVIDENCE' THEN 60 ELSE 75 END AS evidence, CASE status WHEN 'POTENTIAL_CONTRADICTION' THEN 92 WHEN 'SUPPORTED' THEN 90 WHEN 'HIGH_RISK_REVIEW' THEN 85 WHEN 'INSUFFICIENT_EVIDENCE' THEN 80 ELSE 65 END AS judged FROM a),
f AS (SELECT *, greatest(10, least(99, round(0.25::DOUBLE * 90 + 0.20::DOUBLE * 85 + 0.25::DOUBLE * evidence + 0.30::DOUBLE * judged, 1)))::DOUBLE AS confidence FROM s)"""


@query("f20_claim_patterns", f"WITH {CLAIMS} SELECT label_id, rule_id, claim FROM a WHERE rule_id IS NOT NULL", ("label_truth",))
def f20(spark, d):
    return K.find_claims(frame(spark, d, "label_text"), K.claim_rules(spark)).select("label_id", "rule_id", "claim")


@query("f21_matching_rule", f"WITH {CLAIMS} SELECT label_id, claim, rule_id FROM a WHERE rule_id IS NOT NULL", ("label_truth",))
def f21(spark, d):
    rules = K.claim_rules(spark)
    return K.matching_rule(K.find_claims(frame(spark, d, "label_text"), rules).select("label_id", "claim"), rules)


@query("f22_contradictions", f"WITH {CLAIMS} SELECT label_id, rule_id, hits FROM a WHERE hits IS NOT NULL", ("label_truth",))
def f22(spark, d):
    rules = K.claim_rules(spark)
    return K.contradictions(K.find_claims(frame(spark, d, "label_text"), rules), rules, _truth(spark, d).select("label_id", "ingredients"))


@query("f23_findings_nested", f"WITH {CLAIMS} SELECT label_id, claim, status, CASE WHEN hits IS NULL THEN '' ELSE 'CONTRADICTS:' || hits END AS evidence FROM a", ("label_truth",))
def f23(spark, d):
    findings, edges = K.split_findings(stored(_claims(spark, d)))
    nested = K.findings_with_evidence(findings, edges)
    return nested.select("label_id", "claim", "status", F.array_join(F.transform("evidence", lambda x: F.concat(x["link_type"], F.lit(":"), x["evidence_text"])), ";").alias("evidence"))


@query("j18_claim_assessments", f"WITH {CLAIMS} SELECT label_id, rule_id, claim, 'CLM-001' AS claim_id, status, hits, confidence FROM f", ("label_truth",))
def j18(spark, d):
    return _claims(spark, d).select("label_id", "rule_id", "claim", "claim_id", "status", "hits", "confidence")


@query("j17_claim_flags", f"WITH {CLAIMS} SELECT label_id, claim, is_absolute, is_comparative, is_high_risk FROM a WHERE rule_id IS NOT NULL UNION ALL SELECT label_id, claim, claim NOT LIKE 'treats%', claim LIKE 'best%', claim LIKE 'treats%' FROM a WHERE rule_id IS NULL", ("label_truth",))
def j17(spark, d):
    return _claims(spark, d).select("label_id", "claim", "is_absolute", "is_comparative", "is_high_risk")


@query("i13_i14_claim_summary", f"""WITH {CLAIMS} SELECT label_id, count(*) AS claims, count(*) FILTER (WHERE status = 'SUPPORTED') AS supported, count(*) FILTER (WHERE status = 'INSUFFICIENT_EVIDENCE') AS insufficient_evidence, count(*) FILTER (WHERE status = 'POTENTIAL_CONTRADICTION') AS potential_contradiction,
count(*) FILTER (WHERE status = 'HIGH_RISK_REVIEW') AS high_risk_review, count(*) FILTER (WHERE status = 'NOT_ASSESSABLE') AS not_assessable, count(*) FILTER (WHERE status <> 'SUPPORTED') AS needs_review FROM a GROUP BY 1""", ("label_truth",))  # fmt: skip
def i13(spark, d):
    return K.claim_summary(_claims(spark, d))


@query("i25_confusion", """WITH m AS (SELECT label_id % 5 <> 0 AS truth, coalesce(claim_rule, '') <> '' AS hit FROM label_truth), c AS (SELECT count(*) FILTER (WHERE truth AND hit) AS tp, count(*) FILTER (WHERE NOT truth AND hit) AS fp, count(*) FILTER (WHERE truth AND NOT hit) AS fn, count(*) FILTER (WHERE NOT truth AND NOT hit) AS tn FROM m)
SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM c""", ("label_truth",))  # fmt: skip
def i25(spark, d):
    truth = _truth(spark, d).select("label_id", (F.col("label_id") % 5 != 0).alias("has_claim"))
    return K.confusion(truth, K.find_claims(frame(spark, d, "label_text"), K.claim_rules(spark)))


@query("g14_open_claims", f"WITH {CLAIMS} SELECT label_id, CASE claim WHEN 'completely fresh' THEN 'ABSOLUTE' WHEN 'treats headaches' THEN 'MEDICAL' ELSE 'COMPARATIVE' END AS category, claim FROM a WHERE rule_id IS NULL", ("label_truth",))
def g14(spark, d):
    return K.open_claims(frame(spark, d, "label_text"), K.claim_rules(spark)).select("label_id", "category", "claim")


@query("g04_g07_claim_numbers", """SELECT label_id, CASE WHEN claim_rule < 'CLAIM-RULE-NUT-004' THEN 'CLM-001' ELSE 'CLM-002' END AS claim_id, claim FROM label_truth WHERE claim <> 'low fat'
UNION ALL SELECT label_id, CASE WHEN claim_rule < 'CLAIM-RULE-NUT-004' THEN 'CLM-002' ELSE 'CLM-001' END, 'low fat' FROM label_truth""", ("label_truth",))  # fmt: skip
def g04(spark, d):
    """Claims of two panels, the second with a claim that most labels lack on the first, numbered once each."""
    rules = K.claim_rules(spark)
    t = frame(spark, d, "label_text").select("label_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("panel"))
    panels = t.withColumn("text", F.when(F.col("panel") == 2, F.concat("text", F.lit("\nLOW FAT"))).otherwise(F.col("text")))
    claims = K.find_claims(panels, rules).unionByName(K.open_claims(panels, rules))
    return K.numbered(K.deduplicated(claims)).select("label_id", "claim_id", "claim")


@query("d19_provenance", """WITH t AS (SELECT label_id, 'brand' AS field, unnest(string_split(lower(brand), ' ')) AS token FROM label_truth UNION ALL SELECT label_id, 'phone', replace(phone, '-', '') FROM label_truth),
s AS (SELECT w.*, t.field, regexp_replace(lower(word), '[^a-z0-9_]', '', 'g') AS a, regexp_replace(t.token, '[^a-z0-9_]', '', 'g') AS b FROM words w JOIN t ON w.label_id = t.label_id),
b AS (SELECT *, b AS token, row_number() OVER (PARTITION BY label_id, field, b ORDER BY line, pos) AS rn FROM s WHERE a = b OR (length(a) > 3 AND length(b) > 3 AND CASE WHEN contains(a, b) THEN length(b) >= 0.5 * length(a) ELSE contains(b, a) AND length(a) >= 0.7 * length(b) END))
SELECT label_id, field, count(*) AS n, CAST(min(x) AS INT) AS x, CAST(max(x + w) AS BIGINT) AS right FROM b WHERE rn = 1 GROUP BY ALL""", ("words", "label_truth"))  # fmt: skip
def d19(spark, d):
    t = _truth(spark, d)
    v = t.select("label_id", F.lit("brand").alias("field"), F.col("brand").alias("value")).unionByName(t.select("label_id", F.lit("phone").alias("field"), F.col("phone").alias("value")))
    return V.provenance(v, frame(spark, d, "words")).select("label_id", "field", "n", F.col("x").cast("int"), F.col("right").cast("long"))


SIZES = "sizes AS (SELECT label_id, 600 AS width, 900 AS height FROM label_truth)"


def _sizes(spark, d):
    return _truth(spark, d).select("label_id", F.lit(600).alias("width"), F.lit(900).alias("height"))


_KEYS = ", ".join(f"('{r}', '{k}')" for r, words in V.REGION_WORDS.items() for k in words)


@query("d21_d24_layout", rf"""WITH {SIZES}, kw(region, keyword) AS (VALUES {_KEYS}), kc AS (SELECT region, keyword, row_number() OVER () AS ord, trim(regexp_replace(lower(keyword), '[:;,.\-_()#]', '', 'g')) AS clean FROM kw),
o AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY line, pos) AS i, count(*) OVER (PARTITION BY label_id) AS total FROM words),
g AS (SELECT a.label_id, a.i, a.y, n, string_agg(lower(b.word), ' ' ORDER BY b.i) AS r, string_agg(trim(regexp_replace(lower(b.word), '[:;,.\-_()#]', '', 'g')), ' ' ORDER BY b.i) AS c FROM o a, range(1, 5) s(n) JOIN o b ON b.label_id = a.label_id AND b.i BETWEEN a.i AND a.i + n - 1 WHERE a.i + n - 1 <= a.total GROUP BY ALL),
h AS (SELECT label_id, i, n, y, region, arg_min(keyword, ord) AS keyword FROM g JOIN kc ON (clean <> '' AND contains(c, clean)) OR contains(r, keyword) GROUP BY ALL),
b AS (SELECT h.label_id, h.region, h.keyword, o.x, o.y, o.x + o.w AS r, o.y + o.h AS b FROM h JOIN o ON o.label_id = h.label_id AND o.i BETWEEN h.i AND h.i + h.n + 3 AND (o.i < h.i + h.n OR abs(o.y - h.y) < 60)),
u AS (SELECT label_id, region, min(x) AS x, min(y) AS y, max(r) AS r, max(b) AS b, count(DISTINCT keyword) AS keywords FROM b GROUP BY ALL)
SELECT label_id, region, greatest(0, greatest(0, x) - 10) AS x, greatest(0, greatest(0, y) - 8) AS y, least(width, least(width, r) + 10) AS "right", least(height, least(height, b) + 8) AS bottom, keywords, round(least(0.95, 0.70 + 0.08 * keywords), 2)::DOUBLE AS confidence FROM u JOIN sizes USING (label_id)""", ("words", "label_truth"))  # fmt: skip
def d21(spark, d):
    return V.layout(frame(spark, d, "words"), _sizes(spark, d))


def _hits(words):
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words)


@query("d22_panel_class", f"""WITH p AS (SELECT label_id, CASE label_id % 4 WHEN 0 THEN 'Classic taste' WHEN 1 THEN 'Rich and tasty, batch no 7' ELSE text END AS text, 300 + (label_id % 7) * 200 AS width, 1000 - (label_id % 5) * 150 AS height, label_id % 3 = 0 AS has_nutrition_table, label_id % 2 = 0 AS has_barcode FROM label_text),
n AS (SELECT label_id, count(*) AS n, max(h) AS tall, avg(h) AS mean FROM (SELECT label_id, pos, CASE WHEN line = 1 AND label_id % 8 = 0 THEN h * 8 ELSE h END AS h, line FROM words) WHERE label_id % 6 <> 5 AND (label_id % 4 > 1 OR line < 3) GROUP BY 1),
j AS (SELECT p.*, lower(text) AS t, coalesce(n, 0) AS n, tall, mean, width / greatest(height, 1) AS aspect FROM p LEFT JOIN n USING (label_id)),
k AS (SELECT *, {_hits(V.BACK)} AS bh, {_hits(V.FRONT)} AS fh, aspect < 0.45 OR aspect > 2.3 AS narrow FROM j),
s AS (SELECT label_id, n, CASE WHEN narrow THEN 0 ELSE 0.10::DOUBLE END + CASE WHEN n < 15 AND n > 0 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN fh >= 1 AND bh <= 1 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN tall > mean * 2.5 AND tall > height * 0.08 THEN 0.25::DOUBLE ELSE 0 END AS f,
  CASE WHEN narrow THEN 0 ELSE 0.10::DOUBLE END + CASE WHEN n > 35 THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN bh >= 3 THEN 0.45::DOUBLE WHEN bh >= 1 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN has_nutrition_table THEN 0.35::DOUBLE ELSE 0 END AS b,
  CASE WHEN narrow THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN has_barcode AND (aspect < 0.6 OR aspect > 1.8) THEN 0.30::DOUBLE ELSE 0 END AS d FROM k)
SELECT label_id, n, CASE WHEN greatest(f, b, d) < 0.25 THEN 'unknown' WHEN f = greatest(f, b, d) THEN 'front_candidate' WHEN b = greatest(f, b, d) THEN 'back_candidate' ELSE 'side_candidate' END AS panel,
  CASE WHEN greatest(f, b, d) < 0.25 THEN 0.35::DOUBLE ELSE round(least(0.96::DOUBLE, greatest(0.40::DOUBLE, greatest(f, b, d) / (f + b + d + 1e-4::DOUBLE) * 0.85::DOUBLE + 0.15::DOUBLE)), 2) END AS confidence FROM s""", ("label_text", "words"))  # fmt: skip
def d22(spark, d):
    i = F.col("label_id")
    text = F.when(i % 4 == 0, "Classic taste").when(i % 4 == 1, "Rich and tasty, batch no 7").otherwise(F.col("text"))
    panels = frame(spark, d, "label_text").select("label_id", text.alias("text"), (300 + (i % 7) * 200).alias("width"), (1000 - (i % 5) * 150).alias("height"), (i % 3 == 0).alias("has_nutrition_table"), (i % 2 == 0).alias("has_barcode"))
    words = frame(spark, d, "words").filter((i % 6 != 5) & ((i % 4 > 1) | (F.col("line") < 3)))
    return V.panel_class(panels, words.withColumn("h", F.when((F.col("line") == 1) & (i % 8 == 0), F.col("h") * 8).otherwise(F.col("h"))))


@query("d23_small_text", "SELECT label_id, count(*) AS words, count(*) FILTER (WHERE h - pos % 4 < 12) AS small FROM words GROUP BY 1", ("words",))
def d23(spark, d):
    return V.small_text(frame(spark, d, "words").withColumn("h", F.col("h") - F.col("pos") % 4))


@query("g08_sequences", """SELECT label_id, 'origin' AS phrase, line, pos, CAST(3 AS INT) AS n_words FROM words WHERE word = 'Country' UNION ALL SELECT label_id, 'care', line, pos, CAST(2 AS INT) FROM words WHERE word = 'Customer'
UNION ALL SELECT label_id, 'best', line, pos, CAST(2 AS INT) FROM words WHERE word = 'Best' AND line > 4 AND label_id IN (SELECT label_id FROM label_truth WHERE best_before IS NOT NULL OR has_life) AND label_id % 26 NOT IN (17, 24)
UNION ALL SELECT label_id, 'best', min(line), 1, CAST(2 AS INT) FROM words WHERE word = 'Best' AND label_id IN (SELECT label_id FROM label_truth WHERE best_before IS NOT NULL OR has_life) AND label_id % 26 IN (17, 24) GROUP BY 1""", ("words", "label_truth"))  # fmt: skip
def g08(spark, d):
    phrases = spark.createDataFrame([("origin", ["country", "of", "origin"]), ("care", ["customer", "care"]), ("best", ["best", "before"])], "phrase string, targets array<string>")
    return LO.sequences(frame(spark, d, "words"), phrases).select("label_id", "phrase", "line", "pos", "n_words")


@query("g09_same_line", """WITH l AS (SELECT label_id, 'mrp' AS target, string_agg(word, ' ' ORDER BY x, pos) AS text FROM words WHERE line = 3 GROUP BY 1 UNION ALL SELECT w.label_id, 'fssai', string_agg(word, ' ' ORDER BY x, pos) FROM words w JOIN label_truth t ON w.label_id = t.label_id AND licence IS NOT NULL WHERE line = 6 GROUP BY 1),
c AS (SELECT w.label_id, 'below' AS target, string_agg(w.word, ' ' ORDER BY floor(w.y / (0.8 * a.h)), w.x, w.pos, w.word) AS text FROM words w JOIN words a ON a.label_id = w.label_id AND a.line = 3 AND a.pos = 1
  WHERE w.y >= a.y - 0.5 * a.h AND w.y + w.h <= a.y + a.h + a.h * 3.2 AND w.x >= greatest(0, a.x - 50) AND w.x + w.w <= a.x + 400 GROUP BY 1) SELECT * FROM l UNION ALL SELECT * FROM c""", ("words", "label_truth"))  # fmt: skip
def g09(spark, d):
    anchors = spark.createDataFrame([("mrp", "mrp", "LINE", 0, 0), ("fssai", "fssai", "LINE", 0, 0), ("below", "mrp", "CLUSTER", 2, 400)], "name string, target string, kind string, below int, width int")
    return LO.gathered(frame(spark, d, "words"), anchors).select("label_id", F.col("name").alias("target"), "text")


@query("i19_heat_map", """WITH e AS (SELECT screening_id AS label_id, line % 2 AS image, CASE WHEN status IN ('FAIL', 'WARNING') THEN 100 WHEN status = 'NEEDS_REVIEW' THEN 85 ELSE 60 END AS w, 1 AS own FROM checks WHERE line % 3 <> 0 UNION ALL SELECT label_id, line % 2, 30, 0 FROM words),
g AS (SELECT label_id, CAST(image AS INT) AS image, count(*) AS points, CAST(sum(own) AS BIGINT) AS evidence_points, CAST(sum(w) AS BIGINT) / 100 AS heat FROM e GROUP BY ALL) SELECT *, CASE WHEN points > 40 THEN 'HIGH' WHEN points > 15 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM g""", ("checks", "words"))  # fmt: skip
def i19(spark, d):
    line = F.col("line")
    boxes = frame(spark, d, "checks").select(F.col("screening_id").alias("label_id"), (line % 2).cast("int").alias("image"), "rule_id", "field", "status", (10 * line).alias("x"), F.lit(20).alias("y"), (10 * line + F.when(line % 3 == 0, 0).otherwise(30)).alias("right"), F.lit(44).alias("bottom"))
    words = frame(spark, d, "words").select("label_id", (line % 2).cast("int").alias("image"), "x", "y", (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"))
    return V.heat_map(V.heat_points(boxes, words))


_holds = lambda words: "(" + " OR ".join(f"contains(lower(word), '{w}')" for w in words) + ")"
HEIGHTS = "hh AS (" + " UNION ALL ".join(f"SELECT label_id, '{f}' AS field, {mm}::DOUBLE AS least_mm, avg(h) AS px FROM words WHERE {_holds(w)} GROUP BY 1" for f, w, mm in V.HEIGHTS) + "), he AS (SELECT label_id, field, least_mm, round(px / 150.0::DOUBLE * 25.4::DOUBLE, 2) AS mm FROM hh)"


@query("i26_letter_heights", f"WITH {HEIGHTS} SELECT *, round(mm / 0.352778::DOUBLE, 1) AS pt, mm >= least_mm AS ok FROM he", ("words",))
def i26(spark, d):
    return V.letter_heights(frame(spark, d, "words"), 150)


def _printed(spark, d):
    """Words as an artwork shows them: a label in three lacks its quantity's words, a label in five its price's."""
    i, low = F.col("label_id"), F.lower("word")
    gone = ((i % 3 == 1) & (low.contains("net") | low.contains("qty"))) | ((i % 5 == 1) & (low.contains("mrp") | low.contains("rs") | low.contains("tax") | low.contains("incl")))
    return frame(spark, d, "words").filter(~gone)


PRINTED = "pw AS (SELECT * FROM words WHERE NOT ((label_id % 3 = 1 AND (contains(lower(word), 'net') OR contains(lower(word), 'qty'))) OR (label_id % 5 = 1 AND (contains(lower(word), 'mrp') OR contains(lower(word), 'rs') OR contains(lower(word), 'tax') OR contains(lower(word), 'incl')))))"
_KIND = " ".join(f"WHEN {_holds(w)}{' AND (y + h / 2) / 900 < 0.35' if n == 'BRAND_HEADER' else ''} THEN '{n}'" for n, w in V.ARTWORK)
ARTWORK = f"{PRINTED}, rg AS (SELECT label_id, region, count(*) AS n_words, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b FROM (SELECT *, CASE {_KIND} END AS region FROM pw) WHERE region IS NOT NULL GROUP BY ALL)"
PLACED = f"""{ARTWORK}, pl AS (SELECT t.label_id, f.field, CASE WHEN g.region IS NOT NULL OR coalesce(CASE f.field WHEN 'mrp' THEN sm ELSE sq END, false) THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN g.y IS NOT NULL THEN round(greatest(0, least(1, g.y / 900)), 4) END::DOUBLE AS zone_y
  FROM label_truth t CROSS JOIN (VALUES ('mrp', 'MRP_STAMP'), ('net_quantity', 'NET_QTY_AREA')) f(field, region) LEFT JOIN rg g ON g.label_id = t.label_id AND g.region = f.region
  LEFT JOIN (SELECT label_id, bool_or(contains(lower(word), 'mrp')) AS sm, bool_or(contains(lower(word), 'net') OR contains(lower(word), 'qty')) AS sq FROM pw GROUP BY 1) s ON s.label_id = t.label_id)"""
LISTED = """ls AS (SELECT label_id, [x FOR x IN [CASE WHEN amount IS NULL THEN 'net_quantity' END, CASE WHEN price IS NULL THEN 'mrp' END, CASE WHEN made IS NULL THEN 'manufacturing_date' END, CASE WHEN best_before IS NULL THEN 'expiry_date' END, CASE WHEN origin IS NULL AND label_id % 26 <> 7 THEN 'country_of_origin' END,
  CASE WHEN licence IS NULL THEN 'fssai_license' END, CASE WHEN ingredients IS NULL THEN 'ingredients' END, CASE WHEN NOT is_food THEN 'nutritional_info' END] IF x IS NOT NULL] AS missing_list FROM label_truth)"""
FIXES = f"""{PLACED}, {LISTED}, {HEIGHTS}, {CHECKS}, fa AS (SELECT label_id, CASE r.rule_id WHEN 'FS-001' THEN 'fssai_license' WHEN 'FS-005' THEN 'date_marking' WHEN 'LM-008' THEN 'manufacturing_date' ELSE r.rule_id END AS field FROM c WHERE r.status = 'FAIL'),
mi AS (SELECT label_id, unnest(missing_list) AS field FROM ls),
co AS (SELECT label_id, field, 'MISSING_DECLARATION' AS kind, 'CRITICAL' AS severity, true AS blocking FROM mi UNION ALL SELECT label_id, field, 'FAILED_CHECK', 'CRITICAL', true FROM fa ANTI JOIN mi USING (label_id, field)
  UNION ALL SELECT label_id, field, 'PLACEMENT', 'MAJOR', false FROM pl WHERE status <> 'PASS' UNION ALL SELECT label_id, field, 'FONT_SIZE', 'MAJOR', false FROM he WHERE mm < least_mm)"""
READY = f"""{FIXES}, rd AS (SELECT l.label_id, CAST(len(missing_list) AS INT) AS missing, coalesce(b, 0) AS blocking, CASE WHEN l.label_id IN (SELECT label_id FROM fa) OR len(missing_list) > 2 THEN 'NON_COMPLIANT' WHEN len(missing_list) > 0 OR coalesce(b, 0) > 0 THEN 'NEEDS_REVIEW' ELSE 'COMPLIANT' END AS readiness
  FROM ls l LEFT JOIN (SELECT label_id, count(*) FILTER (WHERE blocking) AS b FROM co GROUP BY 1) b ON b.label_id = l.label_id)"""


def _artwork(spark, d):
    """Checks, checklist, placements and heights, with extraction and rules done once."""
    dec = stored(E.declarations(frame(spark, d, "label_text")))
    w = _printed(spark, d)
    checks = stored(RU.evaluate(dec).select("label_id", "field", "status"))
    return checks, V.checklist(dec), V.placement(w, _sizes(spark, d), _truth(spark, d)), V.letter_heights(frame(spark, d, "words"), 150)


@query("d24_artwork_regions", f"WITH {ARTWORK} SELECT label_id, region, n_words, x, y, r AS \"right\", b AS bottom, round(least(1, x / 600), 4)::DOUBLE AS share_x, round(least(1, y / 900), 4)::DOUBLE AS share_y, round(least(1, r / 600), 4)::DOUBLE AS share_right, round(least(1, b / 900), 4)::DOUBLE AS share_bottom FROM rg", ("words",))
def d24(spark, d):
    return V.artwork_regions(_printed(spark, d), _sizes(spark, d))


@query("i27_placement", f"WITH {PLACED} SELECT * FROM pl", ("words", "label_truth"))
def i27(spark, d):
    return V.placement(_printed(spark, d), _sizes(spark, d), _truth(spark, d))


@query("i28_checklist", f"WITH {LISTED} SELECT label_id, CAST(12 - len(missing_list) AS INT) AS present, CAST(len(missing_list) AS INT) AS missing, array_to_string(missing_list, ',') AS missing_list FROM ls", ("label_truth",))
def i28(spark, d):
    return V.checklist(E.declarations(frame(spark, d, "label_text"))).withColumn("missing_list", F.array_join("missing_list", ","))


@query("i29_designer_corrections", f"WITH {FIXES} SELECT * FROM co", ("words", "label_truth"))
def i29(spark, d):
    checks, listed, placed, heights = _artwork(spark, d)
    return V.designer_corrections(listed, checks, placed, heights)


@query("i30_readiness", f"WITH {READY} SELECT *, CASE readiness WHEN 'NON_COMPLIANT' THEN 'ACTION_REQUIRED' WHEN 'NEEDS_REVIEW' THEN 'CHANGES_REQUESTED' ELSE 'DRAFT' END AS workflow_status, readiness = 'COMPLIANT' AS ready FROM rd", ("words", "label_truth"))
def i30(spark, d):
    checks, listed, placed, heights = _artwork(spark, d)
    return V.readiness(V.designer_corrections(listed, checks, placed, heights), listed, checks)


@query("f32_approval_gate", f"""WITH {READY}, g AS (SELECT t.label_id AS artwork_id, CASE t.label_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'REQUEST_CHANGES' END AS decision, readiness, t.label_id % 10 <> 3 AS ack FROM label_truth t LEFT JOIN rd ON rd.label_id = t.label_id AND t.label_id % 7 <> 2)
SELECT artwork_id, decision, readiness, CASE WHEN NOT ack OR (decision = 'APPROVED' AND coalesce(readiness, '') = 'NON_COMPLIANT') THEN 'REFUSED' ELSE CASE decision WHEN 'APPROVED' THEN 'READY_FOR_PRINT' WHEN 'REJECTED' THEN 'REJECTED' ELSE 'CHANGES_REQUESTED' END END AS outcome FROM g""", ("words", "label_truth"))  # fmt: skip
def f32(spark, d):
    i = F.col("label_id")
    checks, listed, placed, heights = _artwork(spark, d)
    ready = V.readiness(V.designer_corrections(listed, checks, placed, heights), listed, checks).filter(i % 7 != 2).withColumnRenamed("label_id", "artwork_id")
    decisions = _truth(spark, d).select(i.alias("artwork_id"), F.when(i % 3 == 0, "APPROVED").when(i % 3 == 1, "REJECTED").otherwise("REQUEST_CHANGES").alias("decision"), (i % 10 != 3).alias("acknowledged"))
    ok, refused = R.approval_gate(decisions, ready)
    return ok.select("artwork_id", "decision", "readiness", F.col("workflow_status").alias("outcome")).unionByName(refused.select("artwork_id", "decision", "readiness", F.lit("REFUSED").alias("outcome")))


@query("d04_d14_price_rate_and_code", "SELECT label_id, coalesce('USP: ' || usp || ' per g', 'USP Rs. 1.5 / g') AS unit_sale_price, '8901234567894' AS barcode FROM label_truth", ("label_truth",))
def d04(spark, d):
    t = frame(spark, d, "label_text").withColumn("text", F.concat("text", F.lit("\nUSP Rs. 1.5 / g\nEAN: 8901234567894")))
    return E.declarations(t).select("label_id", "unit_sale_price", "barcode")
