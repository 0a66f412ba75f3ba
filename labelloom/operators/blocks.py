"""Declarations of several lines, and the state of a price: lists from a heading to what ends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.extraction import conflicts

#: Headings of an ingredient list, the lines that it may take, and what ends it at the start of a line.
LIST_HEADINGS = (r"\bINGREDIENTS?\b", r"\bINOREDIENTS?\b", r"\bINGREDENTS?\b", r"\bINGR?EDI?ENTS?\b", r"\bCOMPOSITION\b", r"\bCONTAINS\b", r"\bPROPRIETARY\s*FO\w*[\s:]*.*?(?:INCLUDING|NCLUDINO)\b", r"\b(?:INCLUDING|NCLUDINO)\s*ROLLED\b", r"\bSAMAGRI\b", r"\bसामग्री\b", r"\bघटक\b")
LIST = rf"(?i)(?:{'|'.join(LIST_HEADINGS)})[:\s\-]*([^\n]+(?:\n[^\n]+){{1,8}})"
LIST_ENDS = r"(?i)\n\s*(?:ALLERGEN|ALLERSEN|ALLERGY|NUTRITION|STORE\s*IN|STORAGE|NET\s*WEIGHT|BEST\s*BEFORE|MFG|BATCH|MRP|COOK|COOKING|PREPARATION|DIRECTIONS|HOW\s*TO|SERVE|SERVING|DISCLAIMER|TO\s*IDENTIFY|LIC\s*NO|FOR\s*FEEDBACK|SCAN\s*QR)"
#: Least and most characters of a list; a token of so many letters without two vowels in a row is suspicious; shares of them and the confidence above each.
LEAST, MOST, LONG = 8, 350, 12
CONFIDENCE = ((0.25, 55.0), (0.1, 68.0), (0.0, 88.0))
PRICE_HEADING = r"(?i)\b(?:MRP|M\.R\.P\.|Maximum\s*Retail\s*Price|MRPR|FOR\s*MR\b|FOR\s*MRP\b|MRP\s*₹|MRP\s*Rs)\b"
UNPRINTED = "price heading without a number"


def spaced(block: Column) -> Column:
    """One line, with spaces outside brackets and after separators."""
    out = F.regexp_replace(F.trim(F.regexp_replace(block, r"[\r\n]+", " ")), r"(?U)^[^\w(]+", "")
    for pattern, new in ((r"(?<=[a-zA-Z0-9])\(", " ("), (r"\)(?=[a-zA-Z0-9])", ") "), (r"(?<=[a-zA-Z0-9])([,;:])(?=[a-zA-Z0-9])", "$1 "), (r"\s{2,}", " ")):
        out = F.regexp_replace(F.trim(out), pattern, new)
    return F.trim(out)


def ingredient_lists(labels: DataFrame) -> DataFrame:
    """label_id, ingredients and confidence: the first list, from its heading on for nine lines or up to what ends it.

    Confidence falls with the share of tokens that look like damaged print.
    """
    block = F.trim(F.split(F.trim(F.nullif(F.regexp_extract("text", LIST, 1), F.lit(""))), LIST_ENDS, 2)[0])
    found = labels.select("label_id", spaced(block).alias("whole")).filter(F.length("whole") >= LEAST)
    tokens = F.filter(F.transform(F.split("whole", r"\s+"), lambda t: F.regexp_replace(t, r"^[(),.:;]+|[(),.:;]+$", "")), lambda t: t != "")
    odd = F.filter(tokens, lambda t: (F.length(t) >= LONG) & ~t.rlike(r"(?i)[aeiou]{2,}"))
    share = F.size(odd) / F.greatest(F.size(tokens), F.lit(1))
    confidence = F.when(share >= CONFIDENCE[0][0], CONFIDENCE[0][1]).when(share >= CONFIDENCE[1][0], CONFIDENCE[1][1]).otherwise(CONFIDENCE[2][1])
    return found.select("label_id", F.left("whole", F.lit(MOST)).alias("ingredients"), confidence.alias("confidence"))


def price_states(labels: DataFrame, found: DataFrame) -> DataFrame:
    """label_id, status, value and confidence of the price of every label.

    FOUND; CONFLICT if prices differ by more than a hundredth; UNCERTAIN at 50 where only a heading
    is printed; NOT_FOUND. found: candidates of the labels.
    """
    prices = found.filter("field = 'mrp'")
    best = prices.groupBy("label_id").agg(F.min_by(F.struct("value", "confidence"), F.struct(-F.col("confidence"), "pos", "value")).alias("p"))
    j = labels.select("label_id", F.coalesce(F.col("text").rlike(PRICE_HEADING), F.lit(False)).alias("heading")).join(best, "label_id", "left")
    j = j.join(conflicts(prices).select("label_id", F.lit(True).alias("clash")), "label_id", "left")
    status = F.when(F.col("clash"), "CONFLICT").when(F.col("p").isNotNull(), "FOUND").when(F.col("heading"), "UNCERTAIN").otherwise("NOT_FOUND")
    return j.select("label_id", status.alias("status"), F.coalesce("p.value", F.when(F.col("heading"), UNPRINTED)).alias("value"), F.coalesce("p.confidence", F.when(F.col("heading"), 50.0), F.lit(0.0)).alias("confidence"))
