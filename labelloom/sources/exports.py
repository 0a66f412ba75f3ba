"""Reading stored screenings and writing findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.columns import spreadsheet_safe

CHECKS = "struct<checks:array<struct<rule_id:string,status:string,severity:string>>,passed_rules:long,failed_rules:long,needs_review_rules:long>"


def parsed(rows: DataFrame, column: str = "compliance_result") -> DataFrame:
    """Screenings whose JSON payload became the column result; unreadable JSON is an empty result."""
    r = F.from_json(column, CHECKS, {"mode": "PERMISSIVE"})
    n = F.size("r.checks")
    count = lambda s, f: F.when(n > 0, F.size(F.filter("r.checks", lambda x: x["status"] == s))).otherwise(F.coalesce(f"r.{f}", F.lit(0))).cast("long")
    return rows.withColumn("r", r).select(*[c for c in rows.columns if c != column], F.col("r").alias("result"), count("PASS", "passed_rules").alias("passed"), count("FAIL", "failed_rules").alias("failed"))


def read_screenings(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.parquet(path))


def checks_of(screenings: DataFrame) -> DataFrame:
    """One row for each check of each screening."""
    return screenings.select("id", F.inline("result.checks"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keyword dictionaries of a folder (one JSON file a language: field to list) as language, field, keyword."""
    rows = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.json$", 1).alias("language"), F.explode(F.from_json("value", "map<string,array<string>>")).alias("field", "words"))
    return rows.select("language", "field", F.explode("words").alias("keyword"))


def write_findings(findings: DataFrame, edges: DataFrame, path: str) -> None:
    """Findings and evidence edges; screenings written now replace their stored rows, others stay.

    Tables are partitioned by a bucket of label_id, and only the buckets concerned are written again.
    """
    spark = findings.sparkSession
    keys = findings.select("label_id").distinct()
    for name, new in (("findings", findings), ("evidence", edges)):
        at = f"{path}/{name}"
        rows = new.withColumn("bucket", F.expr("pmod(xxhash64(label_id), 64)"))
        try:
            old = spark.read.parquet(at)
        except Exception as e:  # the first write
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.write.partitionBy("bucket").parquet(at)
            continue
        hit = keys.select(F.expr("pmod(xxhash64(label_id), 64)").alias("bucket")).distinct()
        kept = old.join(hit, "bucket", "left_semi").join(keys, "label_id", "left_anti")
        merged = kept.unionByName(rows, allowMissingColumns=True)
        fresh = f"{at}__new"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(fresh)  # read before its source is replaced
        spark.read.parquet(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)


def report_sections(screenings: DataFrame, checks: DataFrame, recommendations: DataFrame, reviews: DataFrame | None = None, claims: DataFrame | None = None) -> dict[str, DataFrame]:
    """Report rows by section, all of one shape: id, section, ordinal, name, value. reviews: review_id, officer, status; claims: as numbered."""
    shape = lambda df, section, key, ordinal, name, value: df.select(F.col(key).alias("id"), F.lit(section).alias("section"), ordinal.cast("string").alias("ordinal"), name.alias("name"), value.cast("string").alias("value"))
    out = {
        "summary": shape(screenings, "summary", "id", F.lit("0"), F.lit("product"), F.col("product_name")).unionByName(shape(screenings, "summary", "id", F.lit("1"), F.lit("score"), F.col("score"))),
        "rules": shape(checks, "rules", "screening_id", F.col("rule_id"), F.col("field_label"), F.col("status")),
        "actions": shape(recommendations, "actions", "screening_id", F.col("rule_id"), F.col("action"), F.col("step")),
    }
    if reviews is not None:
        out["review"] = shape(reviews, "review", "review_id", F.lit("0"), F.col("officer"), F.col("status"))
    if claims is not None:
        out["claims"] = shape(claims, "claims", "label_id", F.col("claim_id"), F.col("claim"), F.coalesce("rule_id", F.lit("none")))
    return out


def safe(rows: DataFrame) -> DataFrame:
    """All text columns safe for spreadsheets."""
    return rows.select(*(spreadsheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def export_csv(sections: dict[str, DataFrame], path: str) -> None:
    """Every section below its own partition; commas, quotes and line ends are quoted."""
    rows = None
    for df in sections.values():
        rows = df if rows is None else rows.unionByName(df)
    safe(rows).write.mode("overwrite").partitionBy("section").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_comparison(diffs: DataFrame, path: str, form: str = "csv") -> None:
    """A comparison's rows as csv or json."""
    (export_json(diffs, path) if form == "json" else safe(diffs).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
