"""Table jobs over declarations, codes, licences, evidence, boxes, pages and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions import columns as C
from labelloom.operators.common import small

#: Prefix ranges and the organisations that issue them.
ISSUERS = ((0, 139, "GS1 US"), (300, 379, "GS1 France"), (400, 440, "GS1 Germany"), (450, 459, "GS1 Japan"), (490, 499, "GS1 Japan"), (500, 509, "GS1 UK"), (690, 699, "GS1 China"), (880, 880, "GS1 Korea"), (885, 885, "GS1 Thailand"), (888, 888, "GS1 Singapore"), (890, 890, "GS1 India"), (930, 939, "GS1 Australia"))


def issuers(spark) -> DataFrame:
    """prefix (three digits) and issuer, one row for each of up to 1000 prefixes."""
    rows = spark.createDataFrame(list(ISSUERS), "lo int, hi int, issuer string")
    return rows.select(F.explode(F.sequence("lo", "hi")).alias("p"), "issuer").select(F.lpad(F.col("p").cast("string"), 3, "0").alias("prefix"), "issuer")


def with_issuer(codes: DataFrame, code: str = "code") -> DataFrame:
    """Adds the issuing organisation by the prefix of the padded 14-digit code: an equi join, no range join."""
    p = F.substring(F.lpad(C.gtin_digits(F.col(code)), 13, "0"), 1, 3)
    return codes.withColumn("prefix", p).join(F.broadcast(issuers(codes.sparkSession)), "prefix", "left").drop("prefix")  # 1000 rows at most


def gtin_audit(codes: DataFrame) -> DataFrame:
    """Codes by format and issuer: how many, how many valid, how many shared by products. codes: product_id, code."""
    found = with_issuer(codes).withColumn("n", F.count("*").over(W.partitionBy("code")))
    return found.groupBy(C.gtin_format(F.col("code")).alias("format"), "issuer").agg(F.count("*").alias("codes"), F.count_if(C.gtin_valid(F.col("code"))).alias("valid"), F.count_if(F.col("n") > 1).alias("duplicates"))


def licence_audit(d: DataFrame) -> DataFrame:
    """Labels and licences by state and tier, and licences that several makers use. d: fssai_license, manufacturer."""
    per = d.groupBy(F.col("fssai_license").alias("licence")).agg(F.count("*").alias("labels"), F.count_distinct(C.entity_name(F.col("manufacturer"))).alias("makers"))
    return per.groupBy(F.substring("licence", 2, 2).alias("state"), C.licence_tier(F.col("licence")).alias("tier")).agg(F.sum("labels").alias("labels"), F.count("*").alias("licences"), F.count_if(F.col("makers") > 1).alias("shared"))


def normalised(d: DataFrame) -> DataFrame:
    """Declarations with typed price, quantity in base units, dates and licence."""
    amount, unit = C.quantity_base(F.col("net_quantity"))
    return d.select("*", C.price(F.col("mrp")).alias("price"), amount.alias("amount"), unit.alias("unit"), C.label_date(F.col("manufacturing_date")).alias("made"), F.when(C.licence_valid(F.col("fssai_license")), F.col("fssai_license")).alias("licence"))


def normalised_by_source(d: DataFrame) -> DataFrame:
    """Parse failures and sums by source."""
    miss = lambda c: F.count_if(F.col(c).isNull()).alias(f"{c if c != 'amount' else 'quantity'}_failed")
    return normalised(d).groupBy("source").agg(F.count("*").alias("labels"), miss("price"), miss("amount"), miss("licence"), F.sum("amount").cast("double").alias("amount_sum"), F.sum("price").cast("double").alias("price_sum"))


def screening_seal() -> Column:
    """Seal of a screening: its parts by name, the score with a fixed scale."""
    return C.seal(F.concat(F.lit("id="), F.col("id").cast("string")), F.concat(F.lit("product="), "product_name"), F.concat(F.lit("score="), F.col("score").cast("decimal(10,2)").cast("string")), F.concat(F.lit("status="), "status"))


def seal_report(screenings: DataFrame) -> DataFrame:
    """Verified, altered and missing seals by organization. screenings: with stored_seal."""
    s = F.col("stored_seal")
    return screenings.groupBy("organization").agg(F.count("*").alias("n"), F.count_if(s == screening_seal()).alias("verified"), F.count_if(s.isNotNull() & (s != screening_seal())).alias("altered"), F.count_if(s.isNull()).alias("missing"))


def evidence_quality(evidence: DataFrame) -> DataFrame:
    """Evidence of each rule by reliability tier. evidence: rule_id, method, confidence, evidence_status."""
    score, tier = C.reliability(F.col("method"), F.col("confidence"), F.col("evidence_status"))
    return evidence.select("rule_id", score.alias("s"), tier.alias("tier")).groupBy("rule_id", "tier").agg(F.count("*").alias("n"), F.sum(F.round(F.col("s") * 10).cast("long")).alias("tenths"))


def box_overlap(words: DataFrame) -> DataFrame:
    """Overlapping boxes of a line with their intersection over union. words: label_id, line, pos, x, y, w, h.

    A word is compared with those of its own line only.
    """
    a, b = words.alias("a"), words.alias("b")
    v = lambda t: tuple(F.col(f"{t}.{c}") for c in ("x", "y", "w", "h"))
    j = a.join(b, (F.col("a.label_id") == F.col("b.label_id")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.pos") < F.col("b.pos")))
    return j.withColumn("iou", C.iou(v("a"), v("b"))).filter("iou > 0").select("a.label_id", "a.line", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.round("iou", 4).alias("iou"))


def safe_rows(screenings: DataFrame) -> DataFrame:
    """Report rows: names safe for spreadsheets, times in India."""
    return screenings.select("id", C.spreadsheet_safe(F.col("product_name")).alias("name"), C.india_time(F.col("created_at")).alias("at"))


#: Elements whose whole content is dropped.
DROPPED = ("script", "style", "head", "meta", "link", "noscript", "svg", "iframe")


def page_text(pages: DataFrame) -> DataFrame:
    """Text nodes of each page, one a line, without the content of the dropped elements."""
    h = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", "\n")
    for t in DROPPED:
        h = F.regexp_replace(h, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>|<{t}\b[^>]*/?>", "\n")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", "\n")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        h = F.replace(h, F.lit(a), F.lit(b))
    lines = F.filter(F.transform(F.split(h, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select("page_id", F.size(lines).alias("n_lines"), F.array_join(lines, "\n").alias("text"))


def listing_text(listings: DataFrame) -> DataFrame:
    """Canonical text lines of structured listings; empty ones are skipped, the country is India by default."""
    line = lambda label, c: F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), F.concat(F.lit(label), c.cast("string")))
    return listings.select("label_id", F.concat_ws("\n", line("Product: ", F.col("product_name")), line("Brand: ", F.col("brand")), line("MRP: Rs. ", F.col("price")), line("Country of Origin: ", F.coalesce("origin", F.lit("India")))).alias("text"))


def combine_panels(panels: DataFrame) -> DataFrame:
    """Texts and warnings of a package's panels in order, with headers where there are several. panels: label_id, panel, text, c (summed confidence), n (words), warning."""
    rows = F.array_sort(F.collect_list(F.struct("panel", "text", "warning")))
    g = panels.groupBy("label_id").agg(rows.alias("r"), F.count("*").alias("panels"), F.round(F.sum("c") / F.sum("n"), 1).alias("mean_confidence"), F.sum("n").alias("n_words"))
    headed = lambda x: F.concat(F.lit("--- Panel "), x["panel"].cast("string"), F.lit(" ---\n"), x["text"])
    text = F.array_join(F.transform("r", lambda x: F.when(F.col("panels") > 1, headed(x)).otherwise(x["text"])), "\n")
    return g.select("label_id", "panels", "mean_confidence", "n_words", text.alias("text"), F.array_join(F.array_compact(F.transform("r", lambda x: x["warning"])), "; ").alias("warnings"))
