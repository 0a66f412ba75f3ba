"""What officers correct on labels: values side by side, and rules and scores run again where something was corrected.

Corrections are few beside labels: they are reduced to the last one of each field first, and only labels that have one
are evaluated again. Everything is keyed by label_id, so the joins keep the partitioning of the declarations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators import rules as R
from labelloom.operators import scoring as S
from labelloom.operators.common import by_label

#: The fields that machine and officer are compared by, and the columns of declarations that hold them.
FIELDS = {"product_name": "product_name", "brand": "brand", "mrp": "mrp", "net_quantity": "net_quantity", "manufacturer": "manufacturer", "marketed_by": "marketed_by", "fssai_license": "fssai_license", "consumer_care": "consumer_care", "country_of_origin": "country_of_origin", "manufacture_date": "manufacturing_date", "expiry_date": "best_before", "batch_number": "batch_number", "ingredients": "ingredients", "nutritional_info": "nutrition_facts"}
#: What a contact consists of in declarations; an officer's contact stands in the first.
CARE = ("consumer_care_phone", "consumer_care_email")


def _held(column: str) -> Column:
    return F.nullif(F.concat_ws(", ", *CARE), F.lit("")) if column == "consumer_care" else F.col(column)


def last_corrections(corrections: DataFrame) -> DataFrame:
    """label_id and fixes: a map of field to the last correction (value, officer, reason, at).

    corrections: label_id, field, value, officer, reason, at. Of equal times the greatest value counts; values are
    trimmed, null ones and fields that are not compared are left out.
    """
    c = corrections.filter(F.col("field").isin(*FIELDS) & F.col("value").isNotNull()).withColumn("value", F.trim("value"))
    last = c.groupBy("label_id", "field").agg(F.max(F.struct("at", "value", "officer", "reason")).alias("fix"))
    return last.groupBy("label_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "fix"))).alias("fixes"))


def corrected(declared: DataFrame, corrections: DataFrame, text: bool = False) -> DataFrame:
    """Declarations of the labels that were corrected, with the corrected values, which are sure (confidence 100).

    declared: extraction.declarations. The printed text is left out, as the officer's values are what counts;
    text=True keeps it as evidence for the rules that read it.
    """
    d = declared.join(by_label(last_corrections(corrections)), "label_id")
    fix = lambda f: F.try_element_at("fixes", F.lit(f))["value"]
    new = {c: F.coalesce(fix(f), F.col(c)) for f, c in FIELDS.items() if c != "consumer_care"}
    new[CARE[0]] = F.coalesce(fix("consumer_care"), F.col(CARE[0]))
    new[CARE[1]] = F.when(fix("consumer_care").isNull(), F.col(CARE[1]))
    sure = F.flatten(F.transform(F.map_keys("fixes"), lambda k: F.coalesce(*(F.when(k == f, F.array(*map(F.lit, CARE if c == "consumer_care" else (c,)))) for f, c in FIELDS.items()))))
    kept = F.map_filter("confidences", lambda k, v: ~F.array_contains(sure, k))
    new["confidences"] = F.map_concat(kept, F.map_from_arrays(sure, F.transform(sure, lambda k: F.lit(100.0))))
    if not text:
        new["text"] = F.lit("")
    return d.withColumns(new).drop("fixes")


def machine_vs_human(declared: DataFrame, human: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row for each label and field: ai_value, human_value, is_changed, change_type, officer, at, reason.

    human: declarations as verified; a label without a row there is as the machine read it. A field with a correction is
    CORRECTED, whatever its value; one that differs without a correction CORRECTED, ADDED or REMOVED by which side is empty.
    """
    side = lambda d, name: d.select("label_id", F.struct(*(_held(c).cast("string").alias(f) for f, c in FIELDS.items())).alias(name))
    j = side(declared, "a").join(by_label(side(human, "h")), "label_id", "left").join(by_label(last_corrections(corrections)), "label_id", "left").withColumn("h", F.coalesce("h", "a"))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col("a")[f].alias("ai_value"), F.col("h")[f].alias("human_value"), F.try_element_at("fixes", F.lit(f)).alias("fix")) for f in FIELDS))
    j = j.select("label_id", F.inline(rows))
    a, h = (F.trim(F.coalesce(c, F.lit(""))) for c in ("ai_value", "human_value"))
    kind = F.when(F.col("fix").isNotNull() | ((a != h) & (a != "") & (h != "")), "CORRECTED").when(a == h, "UNCHANGED").when(h != "", "ADDED").otherwise("REMOVED")
    return j.select("label_id", "field", "ai_value", "human_value", (kind != "UNCHANGED").alias("is_changed"), kind.alias("change_type"), "fix.officer", "fix.at", "fix.reason")


def reevaluated(declared: DataFrame, checks: DataFrame, corrections: DataFrame, text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(checks after the corrections, one row a label with both scores, statuses, risks and the difference).

    checks: rules.evaluate of declared. All rules run again for corrected labels, since a value may decide another rule;
    the checks of the others stay as they are and are not computed again.
    """
    again = R.evaluate(corrected(declared, corrections, text))
    ids = corrections.filter(F.col("field").isin(*FIELDS) & F.col("value").isNotNull()).select("label_id").distinct()
    after = checks.join(ids, "label_id", "left_anti").unionByName(again)
    of = lambda c, p: S.scores(c.withColumnRenamed("label_id", "screening_id")).select(F.col("screening_id").alias("label_id"), *(F.col(x).alias(f"{p}_{x}") for x in ("score", "status", "risk_level")))
    ai, human = of(checks, "ai"), of(again, "human")
    j = ai.join(human, "label_id", "left")
    both = [F.coalesce(f"human_{x}", f"ai_{x}").alias(f"human_{x}") for x in ("score", "status", "risk_level")]
    return after, j.select("label_id", "ai_score", "ai_status", "ai_risk_level", *both, F.round(F.coalesce("human_score", "ai_score") - F.col("ai_score"), 1).alias("delta"))
