"""The fourteen label rules as columns over declarations, and what follows from their outcomes.

Each rule is a function of nothing that returns STRUCT<status, reason, value>
over the columns of extraction.declarations and of context(). RULES is the
registry: a user adds a rule by adding a function. All rules of a label are made
in one projection and one inline, so a table of labels is scanned once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import columns as C
from labelloom.operators.common import by_label
from labelloom.sources.views import RULES as RULE_ROWS

#: Keywords by which a package's context is inferred.
FOOD = ("oats", "rice", "juice", "noodles", "snack", "cereal", "food", "edible", "flour", "atta", "oil", "masala", "biscuit", "tea", "coffee", "chocolate", "protein", "sugar", "salt", "milk", "dairy", "spices", "pulses", "dal", "wheat", "grain", "beverage", "drink", "bar", "candy", "confectionery", "soup", "pasta", "sauce")
COSMETICS = ("shampoo", "conditioner", "soap", "lotion", "face wash", "cream", "serum", "lipstick", "perfume", "deodorant", "cosmetic", "moisturizer", "sunscreen", "hair oil", "body wash", "toothpaste")
MEDICAL = ("thermometer", "syringe", "bandage", "dressing", "catheter", "glucometer", "oximeter", "diagnostic", "sterile", "medical device", "surgical")
SINGLE = ("basmati rice", "raw rice", "pure salt", "whole wheat", "crystal salt")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


def context(d: DataFrame) -> DataFrame:
    """Adds is_food, is_cosmetics, is_medical, is_imported, is_export, is_single, is_retail, category and n_words."""
    d = d.withColumn("__low", F.lower(F.coalesce("text", F.lit(""))))  # once, not for each keyword
    low, name, origin = F.col("__low"), F.lower(F.coalesce("product_name", F.lit(""))), F.lower(F.coalesce("country_of_origin", F.lit("")))
    food = F.col("fssai_license").isNotNull() | F.col("nutrition_facts").isNotNull() | F.col("ingredients").isNotNull() | _has(name, FOOD) | _has(low, ("ingredients:", "nutrition facts", "fssai"))
    cosmetics = _has(name, COSMETICS) | _has(low, ("for external use only", "dermatologically tested", "cosmetic licence"))
    medical = _has(name, MEDICAL) | _has(low, ("mfg. lic. no.", "sterile eo", "single use only"))
    foreign = (origin != "") & ~origin.isin("india", "bharat", "ind") & ~_has(low, ("made in india", "product of india", "mfd. in india"))
    export = low.rlike(r"\b(?:for\s*export\s*only|export\s*pack|duty\s*free)\b")
    out = d.withColumns(
        {
            "is_food": food,
            "is_cosmetics": cosmetics,
            "is_medical": medical,
            "is_imported": low.rlike(r"\b(?:imported\s*by|importer|imported\s*from)\b") | foreign,
            "is_export": export,
            "is_single": _has(name, SINGLE) | low.rlike(r"100%\s*(?:pure|basmati|whole|single)"),
            "is_retail": ~_has(low, ("wholesale only", "industrial use", "institutional pack")),
            "n_words": F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")),
        }
    ).drop("__low")
    return out.withColumn("category", F.when(F.col("is_food"), "FOOD").when(F.col("is_cosmetics"), "COSMETICS").when(F.col("is_medical"), "MEDICAL_DEVICES").when(F.col("is_export"), "EXPORT").otherwise("NON_FOOD"))


def _r(status: str, reason: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def _conf(field: str, default: float) -> Column:
    return F.coalesce(F.try_element_at("confidences", F.lit(field)), F.lit(default))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _sure(found: Column, field: str, default: float, what: str, value: Column) -> list[tuple[Column, Column]]:
    """PASS at confidence 70 or more, else WARNING."""
    return [(found & (_conf(field, default) >= 70), _r("PASS", f"{what} declared", value)), (found, _r("WARNING", f"{what} read with low confidence", value))]


def _ladder(steps: list[tuple[Column, Column]], last: Column) -> Column:
    out = None
    for cond, value in steps:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(last)


def _food_only(steps: list[tuple[Column, Column]], last: Column) -> Column:
    return _ladder([(~F.col("is_food"), _r("NOT_APPLICABLE", "Not a food package")), *steps], last)


def lm_001() -> Column:
    v = F.coalesce("manufacturer", "marketed_by", "packer", "importer")
    c = F.coalesce(F.try_element_at("confidences", F.lit("manufacturer")), F.try_element_at("confidences", F.lit("marketed_by")), F.lit(80.0))
    ok = F.length(F.trim(v)) > 3
    return _ladder([(ok & (c >= 70), _r("PASS", "Maker declared", v)), (ok, _r("WARNING", "Maker read with low confidence", v)), (F.col("n_words") < 30, _r("NEEDS_REVIEW", "Too little text to tell"))], _r("FAIL", "No maker, packer or importer"))


def lm_002() -> Column:
    v = F.col("product_name")
    return _ladder(_sure(F.length(F.trim(v)) >= 2, "product_name", 85, "Product name", v), _r("NEEDS_REVIEW", "No product name could be read"))


def lm_003() -> Column:
    v = F.col("net_quantity")
    ok = v.rlike(r"(?i)\d+(?:\.\d+)?\s*(?:g|kg|ml|l|ltr|pcs|n)\b")
    more = [(v.isNotNull(), _r("NEEDS_REVIEW", "Quantity unclear", v)), (_text().rlike(r"(?i)\bNet\s*(?:Weight|Wt|Qty|Quantity)\b"), _r("NEEDS_REVIEW", "Quantity marking without a readable number"))]
    return _ladder([*_sure(ok, "net_quantity", 85, "Net quantity", v), *more], _r("FAIL", "No net quantity"))


def lm_004() -> Column:
    v = F.col("mrp")
    ok = F.regexp_extract(v, r"(\d+)", 1).try_cast("long") >= 1
    mark = _text().rlike(r"(?i)\b(?:MRP|M\.R\.P\.|Maximum\s*Retail\s*Price|FOR\s*MR\b|FOR\s*MRP\b)")
    return _ladder([*_sure(ok, "mrp", 85, "Retail price", v), (mark, _r("NEEDS_REVIEW", "Price marking without a readable number", F.coalesce(v, F.lit("MRP marking detected"))))], _r("FAIL", "No retail price"))


def lm_005() -> Column:
    v = F.concat_ws(", ", F.array_distinct(F.array_compact(F.array("consumer_care_phone", "consumer_care_email"))))
    mark = _text().rlike(r"(?i)\b(?:consumer\s*care|customer\s*care|helpline|feedback)\b")
    return _ladder([(v != "", _r("PASS", "Consumer care declared", v)), (mark, _r("NEEDS_REVIEW", "Consumer care without a contact"))], _r("FAIL", "No consumer care"))


def lm_006() -> Column:
    v = F.col("country_of_origin")
    home = F.col("manufacturer").isNotNull() | _text().rlike(r"(?i)\b(?:India|Gujarat|Maharashtra|Delhi|Surat|Mumbai|Bengaluru)\b")
    return _ladder([(v.isNotNull(), _r("PASS", "Origin declared", v)), (F.col("is_imported"), _r("FAIL", "Imported without an origin")), (home, _r("NOT_APPLICABLE", "Domestic package"))], _r("NEEDS_REVIEW", "Origin can't be told"))


USP = r"(?i)(?:UNIT\s*SALE\s*PRICE|USP|Unit\s*Price)[\s:.\-]*₹?\s*Rs\.?\s*\d+(?:\.\d+)?\s*(?:per|/)\s*(?:g|kg|100\s*g|ml|l|100\s*ml|unit|piece|item|N)"


def lm_007() -> Column:
    v = F.coalesce(F.when(F.col("unit_sale_price").rlike(r"\d"), F.col("unit_sale_price")), F.nullif(F.regexp_extract(_text(), f"({USP})", 1), F.lit("")))
    mark = _text().rlike(r"(?i)\b(?:UNIT\s*SALE\s*PRICE|USP|Unit\s*Price)\b")
    return _ladder([(v.isNotNull(), _r("PASS", "Unit price declared", v)), (mark, _r("NEEDS_REVIEW", "Unit price marking without a number", F.lit("USP label detected")))], _r("NEEDS_REVIEW", "No unit price seen"))


def lm_008() -> Column:
    any_date = F.coalesce("best_before", "relative_shelf_life", "manufacturing_date")
    mark = _text().rlike(r"(?i)\b(?:MFG|MFD|Date\s*of\s*Mfg|Date\s*of\s*Packing|Pkd)\b")
    return _ladder(
        [
            (F.col("is_food"), _r("NOT_APPLICABLE", "Food dates are judged under the food rules", any_date)),
            (F.col("manufacturing_date").rlike(r"\d"), _r("PASS", "Date made declared", F.col("manufacturing_date"))),
            (F.col("best_before").isNotNull(), _r("NOT_APPLICABLE", "Covered by the expiry date", F.col("best_before"))),
            (mark, _r("NEEDS_REVIEW", "Date marking without a readable date")),
        ],
        _r("FAIL", "No date made"),
    )


def lm_009() -> Column:
    t = _text()
    tax = F.when(F.col("mrp").isNotNull() & ~t.rlike(r"(?i)incl[.\s]*of\s*all\s*taxes|incl[.\s]*all\s*taxes|inclusive\s*of\s*all\s*taxes"), F.lit("price without the tax phrase"))
    prices = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)(?:MRP|M\.R\.P\.|Rs\.?|₹)\s*:?\s*(\d+(?:\.\d{1,2})?)"), F.lit(1)), lambda x: x.try_cast("double"))
    spread = F.when(F.array_max(prices) - F.array_min(prices) > 2, F.lit("several prices"))
    maker = F.coalesce("manufacturer", "marketed_by")
    words = r"(?i)\b(?:road|rd\.?|street|st\.?|nagar|pur(?:am)?|abad|colony|layout|sector|industrial|complex|plot|phase|estate|house|apartment|flat|building)\b"
    pin = F.when(maker.isNotNull() & t.rlike(words) & ~t.rlike(r"\b\d{6}\b"), F.lit("address without a PIN code"))
    found = F.array_join(F.array_compact(F.array(tax, spread, pin)), "; ")
    return F.when(found == "", _r("PASS", "Nothing misleading")).otherwise(F.struct(F.lit("WARNING").alias("status"), found.alias("reason"), found.alias("value")))


def fs_001() -> Column:
    v = F.col("fssai_license")
    return _food_only([*_sure(v.rlike(r"^\d{14}$"), "fssai_license", 85, "Licence number", v), (_text().rlike(r"(?i)\b(?:FSSAI|Lic\.?\s*No)\b"), _r("NEEDS_REVIEW", "Licence marking without a readable number"))], _r("FAIL", "No licence number"))


def fs_002() -> Column:
    v = F.col("product_name")
    return _food_only(_sure(F.length(F.trim(v)) >= 2, "product_name", 85, "Food name", v), _r("NEEDS_REVIEW", "No food name could be read"))


def fs_003() -> Column:
    v = F.col("ingredients")
    head = _text().rlike(r"(?i)\b(?:INGREDIENTS?|INOREDIENTS?|INGREDENTS?|COMPOSITION|CONTAINS|SAMAGRI)\b|सामग्री|घटक")
    ok = F.length(F.trim(v)) >= 5
    steps = [(F.col("is_single"), _r("NOT_APPLICABLE", "Single-ingredient food")), (ok & ((_conf("ingredients", 80) >= 70) | head), _r("PASS", "Ingredients declared", v)), (ok, _r("NEEDS_REVIEW", "Ingredients read with low confidence", v)), (head, _r("NEEDS_REVIEW", "Ingredients heading without a list"))]
    return _food_only(steps, _r("NEEDS_REVIEW", "No ingredients seen"))


def fs_004() -> Column:
    steps = [(F.col("is_single"), _r("NOT_APPLICABLE", "Single-ingredient food")), (F.col("nutrition_facts").isNotNull(), _r("PASS", "Nutrition panel declared", F.col("nutrition_facts"))), (_text().rlike(r"(?i)\b(?:NUTRITION|NUTRIENTS|PER\s*100G|ENERGY|PROTEIN)\b"), _r("NEEDS_REVIEW", "Nutrition marking without a panel"))]
    return _food_only(steps, _r("FAIL", "No nutrition panel"))


def fs_005() -> Column:
    dated, made, life = r"\b\d{1,2}[/-]\d{2,4}\b", F.col("manufacturing_date"), F.col("relative_shelf_life")
    ref = F.coalesce(made.rlike(r"\d"), F.lit(False))
    steps = [
        (F.col("best_before").rlike(dated), _r("PASS", "Expiry or best-before date declared", F.col("best_before"))),
        (life.isNotNull() & ref, _r("PASS", "Shelf life with a reference date", F.concat(life, F.lit(" (Mfg: "), made, F.lit(")")))),
        (life.isNotNull(), _r("NEEDS_REVIEW", "Shelf life without a reference date", life)),
        (ref, _r("WARNING", "Date made without an expiry", made)),
        (_text().rlike(r"(?i)\b(?:BEST\s*BEFORE|EXP|EXPIRY|USE\s*BY|MFG|MFD|DATE\s*OF\s*MFG)\b"), _r("NEEDS_REVIEW", "Date heading without a readable date")),
    ]
    return _food_only(steps, _r("FAIL", "No date marking"))


RULES: dict[str, Callable[[], Column]] = {"LM-001": lm_001, "LM-002": lm_002, "LM-003": lm_003, "LM-004": lm_004, "LM-005": lm_005, "LM-006": lm_006, "LM-007": lm_007, "LM-008": lm_008, "LM-009": lm_009, "FS-001": fs_001, "FS-002": fs_002, "FS-003": fs_003, "FS-004": fs_004, "FS-005": fs_005}


def rules_df(spark) -> DataFrame:
    """The rule dimension with evidence fields and category applicability."""
    rows = [(r[0], r[1], r[2], r[3], r[4], [r[1]], ["FOOD"] if r[3] == "FSSAI" else ["ALL"]) for r in RULE_ROWS]
    return spark.createDataFrame(rows, "rule_id string, field string, field_label string, domain string, severity string, evidence_fields array<string>, categories array<string>")


def judged(d: DataFrame) -> DataFrame:
    """d with checks, an array of rule_id, status and value of every rule: evaluate for those that go on with a row of each label."""
    rows = F.array(*(F.struct(F.lit(name).alias("rule_id"), rule().alias("r")) for name, rule in RULES.items()))
    short = F.transform(rows, lambda x: F.struct(x["rule_id"].alias("rule_id"), x["r"]["status"].alias("status"), x["r"]["value"].alias("value")))
    return context(d).select(*d.columns, short.alias("checks"))


def evaluate(d: DataFrame, only: tuple[str, ...] | None = None, applicable_only: bool = False, **override: bool) -> DataFrame:
    """Checks of every (label, rule): status, reason, value, required, detected and the inputs used.

    d: extraction.declarations. override: context flags to set for a what-if.
    applicable_only leaves out rules that the context rules out (off by default).
    """
    c = context(d)
    c = c.withColumns({k: F.lit(v) for k, v in override.items()}) if override else c
    known = {r[0]: r for r in RULE_ROWS}
    rows = []
    for name, rule in RULES.items():
        if only is None or name in only:
            _, field, label, domain, severity = known.get(name, (name, name.lower(), name, "OTHER", "medium"))
            rows.append(F.struct(F.lit(name).alias("rule_id"), F.lit(field).alias("field"), F.lit(label).alias("field_label"), F.lit(domain).alias("domain"), F.lit(severity).alias("severity"), rule().alias("r"), ((F.lit(domain != "FSSAI") | F.col("is_food")) & ~F.col("is_export")).alias("applies")))
    out = c.select("label_id", F.create_map(*(x for k in ("category", "is_food", "is_imported", "is_single") for x in (F.lit(k), F.col(k).cast("string")))).alias("trace"), F.explode(F.array(*rows)).alias("c"))
    if applicable_only:
        out = out.filter("c.applies")
    s = F.col("c.r.status")
    return out.select("label_id", "c.rule_id", "c.field", "c.field_label", "c.domain", "c.severity", s.alias("status"), F.col("c.r.reason").alias("reason"), F.col("c.r.value").alias("value"), (s != "NOT_APPLICABLE").alias("required"), F.col("c.r.value").isNotNull().alias("detected"), "trace")


def rule_conflicts(d: DataFrame, candidate_conflicts: DataFrame) -> DataFrame:
    """Contradictions across declarations of a label, with the rules concerned."""
    year = lambda c: F.regexp_extract(F.col(c), r"(\d{4})$", 1).try_cast("int")
    usp = F.regexp_extract("unit_sale_price", r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    origin = F.lower("country_of_origin")
    kind = lambda k, *rules: F.struct(F.lit(k).alias("conflict_type"), F.array(*map(F.lit, rules)).alias("rule_ids"))
    own = d.select("label_id", F.explode(F.array_compact(F.array(
        F.when(year("best_before") < year("manufacturing_date"), kind("CHRONOLOGICAL_INCONSISTENCY", "LM-008", "FS-005")),
        F.when(usp > F.col("mrp").try_cast("double"), kind("PRICE_INCONSISTENCY", "LM-004", "LM-007")),
        F.when((origin != "india") & F.col("importer").isNull() & ~F.lower("text").rlike(r"\bimport"), kind("IMPORT_INCONSISTENCY", "LM-001", "LM-006")),
    ))).alias("k"))
    mapped = conflict_rules(candidate_conflicts)
    return own.select("label_id", "k.conflict_type", "k.rule_ids").unionByName(mapped.select("label_id", F.concat(F.lit("CANDIDATE_CONFLICT:"), "field").alias("conflict_type"), "rule_ids"))


def conflict_rules(candidate_conflicts: DataFrame) -> DataFrame:
    """The rules whose evidence a conflicting field is, as a sorted array. candidate_conflicts: label_id, field."""
    rules = rules_df(candidate_conflicts.sparkSession).select("rule_id", F.explode("evidence_fields").alias("field"))
    found = candidate_conflicts.join(F.broadcast(rules), "field")  # fourteen rules
    return found.groupBy("label_id", "field").agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))


def font_heights(d: DataFrame, boxes: DataFrame, px_per_mm: float) -> DataFrame:
    """Least and seen letter heights of the quantity and the price. boxes: label_id, field, h in pixels."""
    grams, _ = C.quantity_base(F.col("net_quantity"))
    least = C.letter_height(grams.cast("double"))
    b = boxes.groupBy("label_id").agg(F.avg(F.when(F.col("field") == "net_quantity", F.col("h"))).alias("q"), F.avg(F.when(F.col("field") == "mrp", F.col("h"))).alias("p"))
    j = d.join(by_label(b), "label_id", "left").select("label_id", least.alias("least_mm"), F.round(F.coalesce(F.col("q") / px_per_mm, least * 1.25), 2).alias("quantity_mm"), F.round(F.coalesce(F.col("p") / px_per_mm, least * 1.35), 2).alias("price_mm"))
    return j.withColumn("compliant", (F.col("quantity_mm") >= F.col("least_mm")) & (F.col("price_mm") >= F.col("least_mm")))
