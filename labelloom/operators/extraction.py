"""Declarations from label texts: a long table of candidates, then the best of each field.

candidates: label_id, field, raw, value, confidence, method, pos. Every pattern
runs over all labels in one pass; candidates are rows, so resolution is a window
and conflicts an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions import columns as C
from labelloom.operators.common import by_label, small

#: Serving and nutrition words that disqualify a line for the net quantity.
SERVING = r"(?i)serv(?:e|ing)|per\s*100|energy|protein|nutrition|sugar|fat|kcal"
#: The fields with a status, and those that only food packages carry.
FIELDS = ("product_name", "brand", "mrp", "net_quantity", "manufacturer", "fssai_license", "manufacturing_date", "best_before", "batch_number", "consumer_care_phone", "consumer_care_email", "country_of_origin", "ingredients", "nutrition_facts")
FOOD_FIELDS = ("fssai_license", "ingredients", "nutrition_facts", "best_before")
#: Words that make a number beside them a contact, and beginnings of digit runs that are no codes.
CONTACT = ("consumer", "customer", "feedback", "complaint", "queries", "helpline", "call us", "tel", "phone", "ph.", "toll free", "contact", "levercare", "care")
NO_CODE = ("100", "107", "115", "124", "133")
#: Food categories, first match wins.
CATEGORIES = (("cereal", ("oats", "cereal", "muesli")), ("beverage", ("juice", "drink", "tea", "coffee")), ("noodles", ("noodle", "pasta")), ("bakery", ("biscuit", "cookie", "bread")), ("dairy", ("milk", "paneer", "ghee")), ("staples", ("rice", "atta", "flour", "dal")), ("spices", ("masala", "spice")), ("confectionery", ("chocolate", "candy")), ("oil", ("edible oil", "sunflower oil")))


def lines_of(labels: DataFrame) -> DataFrame:
    """label_id, line (from 0), content."""
    return labels.select("label_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern finds, empty if nothing."""
    return F.trim(F.regexp_extract(text, pattern, group))


def _any(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _found_by(text: Column, low: Column, words: tuple[str, ...], pattern: str) -> Column:
    """_found, tried only where the text, in lower case in low, has one of the words that the pattern can't do without."""
    return F.when(_any(low, words), _found(text, pattern))


def _candidate(field: str, raw: Column, value: Column, confidence: float | Column, method: str) -> Column:
    """Null where raw is, so that a line is not repaired for every field that it lacks."""
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.when(raw.isNotNull(), F.struct(F.lit(field).alias("field"), raw.alias("raw"), value.cast("string").alias("value"), c.cast("double").alias("confidence"), F.lit(method).alias("method")))


def candidates(labels: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """All candidates of all fields, or of some. labels: label_id, text."""
    x, low = F.col("content"), F.col("low")
    mrp = _found_by(x, low, ("mrp", "m.r.p", "retail",), r"(?i)(?:mrp|m\.r\.p\.?|maximum\s*retail\s*price)[^0-9]{0,15}(\d+(?:[.,]\d{1,2})?)")
    loose = _found_by(x, low, ("rs", "₹",), r"(?i)(?:₹|rs\.?)\s*(\d+(?:\.\d{1,2})?)")
    q_anchor = _found_by(x, low, ("net",), r"(?i)net\s*(?:qty|quantity|wt|weight|content)[^0-9]{0,10}(\d+(?:\.\d+)?\s*(?:kg|mg|g|gm|ml|l|ltr|pcs|n)\b)")
    q_loose = F.when(x.rlike(r"\d\s*[kKgGmMlL]") & ~x.rlike(SERVING), _found(x, r"(?i)\b(\d+(?:\.\d+)?\s*(?:kg|g|gm|ml|l|ltr)\b)"))
    lic = F.when(_any(low, ("fssai", "lic")) | x.rlike(r"\d{14}"), C.repaired_licence(x))
    maker = _found_by(x, low, ("by",), r"(?i)(?:manufactured|mfd\.?|mfg\.?)\s*by[:\s]*([^,:\s][^,\n]*)")
    packer = _found_by(x, low, ("packed",), r"(?i)packed\s*by[:\s]*([^,:\s][^,\n]*)")
    marketer = _found_by(x, low, ("marketed", "mktd",), r"(?i)(?:marketed|mktd\.?)\s*by[:\s]*([^,:\s][^,\n]*)")
    importer = _found_by(x, low, ("imported",), r"(?i)imported\s*by[:\s]*([^,:\s][^,\n]*)")
    date = r"(\d{1,2}[/\-.]\d{2,4}(?:[/\-.]\d{2,4})?)"
    made = _found_by(x, low, ("mfg", "mfd", "pkd", "packed", "manufactured",), rf"(?i)(?:mfg|mfd|pkd|packed\s*on|manufactured\s*on|date\s*of\s*mfg)\.?\s*(?:date)?\s*:?\s*{date}")
    before = _found_by(x, low, ("best", "exp", "use",), rf"(?i)(?:best\s*before|exp(?:iry)?\.?\s*(?:date)?|use\s*by)\s*:?\s*{date}")
    life = _found_by(x, low, ("best",), r"(?i)best\s*before\s*:?\s*(\d+\s*(?:months?|days?|years?)\s*from\s*\w+)")
    batch = F.when(_any(low, ("batch", "lot")) & x.rlike(r"(?i)\b(?:batch|lot)\b"), F.nullif(C.repaired_batch(x), F.lit("")))
    email = _found_by(x, low, ("@",), r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})")
    tollfree = _found_by(x, low, ("1800",), r"\b(1800[\s\-]?(?:\d{3}[\s\-]?\d{3,4}|\d{2}[\s\-]?\d{2}[\s\-]?\d{3,4}|\d{6,8}))\b")
    contact = _any(low, CONTACT)
    landline = F.when(contact & x.rlike(r"\b0\d{2,4}"), _found(x, r"\b(0\d{2,4}[-\s]?\d{6,8})\b"))
    abroad = _found_by(x, low, ("+91",), r"(\+91[-\s]?[6-9]\d{4}[-\s]?\d{5})(?!\d)")
    mobile = F.when(contact, _found(x, r"(?:^|[^\d])((?:\+91[-\s]?)?[6-9]\d{4}[-\s]?\d{5})(?:\D|$)"))
    origin = _found_by(x, low, ("origin",), r"(?i)country\s*of\s*origin\s*:?\s*([A-Za-z ]+)")
    made_in = _found_by(x, low, ("made", "product",), r"(?i)(?:made\s*in|product\s*of)\s+([A-Za-z]+)")
    ingredients = _found_by(x, low, ("redient",), r"(?i)^\s*in[gqo]redients?\s*:?\s*(.{8,350})")
    allergen = _found_by(x, low, ("allergen", "contains",), r"(?i)(?:allergen[^:]*:|contains\s*:)\s*(.{3,150})")
    brand = _found_by(x, low, ("brand",), r"(?i)^\s*brand\s*:\s*(.+)$")
    nutrition = F.when(low.contains("nutrition"), F.lit("Panel detected"))
    usp = _found_by(x, low, ("usp", "unit",), r"(?i)((?:unit\s*sale\s*price|usp)[^0-9]{0,10}\d+(?:\.\d+)?\s*(?:per|/)\s*\d*\s*(?:g|kg|ml|l|unit))")
    code = _found_by(x, low, ("barcode", "ean", "gtin", "upc"), r"(?i)(?:barcode|ean|gtin|ean-?13|gtin-?13|upc)[\s.:\-]*\b(\d{8,14})\b")
    digits = F.when(x.contains("890") & lic.isNull(), _found(x, r"(?:^|\D)(890\d{10})(?:\D|$)"))
    run = F.when(x.rlike(r"\d{12}") & lic.isNull(), _found(x, rf"(?:^|[^\w])((?!890\d{{10}}(?:\D|$))(?!{'|'.join(NO_CODE)})\d{{12,14}})(?:[^\w]|$)"))
    # Each pattern runs once a line; the candidates below refer to its result, null where it is empty.
    raw = {"mrp": mrp, "loose": loose, "q_anchor": q_anchor, "q_loose": q_loose, "lic": lic, "maker": maker, "packer": packer, "marketer": marketer, "importer": importer, "made": made, "before": before, "life": life, "batch": batch, "email": email, "tollfree": tollfree, "landline": landline, "abroad": abroad, "mobile": mobile, "origin": origin, "made_in": made_in, "ingredients": ingredients, "allergen": allergen, "brand": brand, "nutrition": nutrition, "usp": usp, "code": code, "digits": digits, "run": run}
    lines = lines_of(labels).withColumn("low", F.lower("content")).select("label_id", "line", "content", *(c.alias(f"__{n}") for n, c in raw.items()))
    lines = lines.select("label_id", "line", "content", *(F.nullif(f"__{n}", F.lit("")).alias(f"__{n}") for n in raw))
    mrp, loose, q_anchor, q_loose, lic, maker, packer, marketer, importer, made, before, life, batch, email, tollfree, landline, abroad, mobile, origin, made_in, ingredients, allergen, brand, nutrition, usp, code, digits, run = (F.col(f"__{n}") for n in raw)
    name = F.when((F.col("line") == 0) & (F.size(F.split(x, " ")) <= 6), x)
    rows = (
        _candidate("mrp", mrp, C.repaired_price(mrp), 92, "anchored"),
        _candidate("mrp", F.when(mrp.isNull(), loose), F.when(mrp.isNull(), C.repaired_price(loose)), 85, "fallback"),
        _candidate("net_quantity", q_anchor, C.repaired_quantity(q_anchor), 92, "anchored"),
        _candidate("net_quantity", F.when(q_anchor.isNull(), q_loose), F.when(q_anchor.isNull(), C.repaired_quantity(q_loose)), 85, "standalone"),
        _candidate("fssai_license", lic, lic, 94, "repaired"),
        _candidate("manufacturer", maker, maker, 90, "anchored"),
        _candidate("packer", packer, packer, 90, "anchored"),
        _candidate("marketed_by", marketer, marketer, 92, "anchored"),
        _candidate("importer", importer, importer, 90, "anchored"),
        _candidate("manufacturing_date", made, C.label_date(C.repaired_date(made)), 85, "anchored"),
        _candidate("best_before", before, C.label_date(C.repaired_date(before)), 88, "anchored"),
        _candidate("relative_shelf_life", life, F.upper(life), 94, "anchored"),
        _candidate("batch_number", batch, batch, F.when(batch.rlike(r"\d"), 85.0).otherwise(65.0), "anchored"),
        _candidate("consumer_care_email", email, email, 95, "pattern"),
        _candidate("consumer_care_phone", tollfree, tollfree, 95, "toll-free"),
        _candidate("consumer_care_phone", landline, landline, 93, "landline"),
        _candidate("consumer_care_phone", mobile, mobile, 92, "mobile"),
        _candidate("consumer_care_phone", abroad, abroad, 90, "international"),
        _candidate("country_of_origin", origin, origin, 94, "declared"),
        _candidate("country_of_origin", F.when(origin.isNull(), made_in), F.when(origin.isNull(), F.when(F.upper(made_in).isin("USA", "UAE", "UK"), F.upper(made_in)).otherwise(F.initcap(made_in))), 90, "pattern"),
        _candidate("ingredients", ingredients, ingredients, 88, "header"),
        _candidate("allergens", allergen, allergen, 85, "header"),
        _candidate("brand", brand, brand, 90, "statement"),
        _candidate("nutrition_facts", nutrition, nutrition, 85, "panel"),
        _candidate("unit_sale_price", usp, usp, 90, "rate"),
        _candidate("barcode", code, code, 92, "labelled"),
        _candidate("barcode", F.when(code.isNull(), digits), F.when(code.isNull(), digits), 88, "prefix"),
        _candidate("barcode", F.when(code.isNull() & digits.isNull(), run), F.when(code.isNull() & digits.isNull(), run), 90, "digits"),
        _candidate("product_name", name, name, F.when(F.col("line") == 0, F.least(F.lit(94.0), 70 + 0.3 * name_score(x, F.col("line")))), "phrase"),
    )
    at = ("mrp", "mrp", "net_quantity", "net_quantity", "fssai_license", "manufacturer", "packer", "marketed_by", "importer", "manufacturing_date", "best_before", "relative_shelf_life", "batch_number", "consumer_care_email", "consumer_care_phone", "consumer_care_phone", "consumer_care_phone", "consumer_care_phone", "country_of_origin", "country_of_origin", "ingredients", "allergens", "brand", "nutrition_facts", "unit_sale_price", "barcode", "barcode", "barcode", "product_name")
    some = [r for f, r in zip(at, rows, strict=True) if fields is None or f in fields]
    return lines.select("label_id", F.col("line").alias("pos"), F.explode(F.array(*some)).alias("c")).filter("c.value IS NOT NULL").select("label_id", "c.*", "pos")


COMMODITY = ("oats", "juice", "noodles", "biscuit", "shampoo", "soap", "rice", "oil", "tea", "coffee", "atta", "salt")


def name_score(phrase: Column, line: Column) -> Column:
    """Bonus and penalty points of a phrase as a product name."""
    low, words = F.lower(phrase), F.size(F.split(F.trim(phrase), r"\s+"))
    hit = F.lit(False)
    for w in COMMODITY:
        hit = hit | low.contains(w)
    return (
        F.when(low.rlike(r"made in|country"), -60).otherwise(0)
        + F.when(low.rlike(r"marketed|customer|care"), -60).otherwise(0)
        + F.when(low.rlike(r"protein|energy|nutrition"), -50).otherwise(0)
        + F.when(hit, 45).otherwise(0)
        + F.when(phrase.rlike(r"^(?:[A-Z][a-z]*\s?)+$") | (F.upper(phrase) == phrase), 15).otherwise(0)
        + F.when(line == 0, 35).when(line < 5, 20).when(line < 15, 10).otherwise(0)
        + F.when(words.between(2, 4), 25).when(words == 1, 5).otherwise(0)
    )


def best(found: DataFrame) -> DataFrame:
    """The candidate of each (label, field) with most confidence; ties: first in the text, then smallest value."""
    w = W.partitionBy("label_id", "field").orderBy(F.desc("confidence"), "pos", "value")
    return found.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def conflicts(found: DataFrame) -> DataFrame:
    """Fields of a label with several values; prices conflict only if they differ by more than a hundredth."""
    g = found.groupBy("label_id", "field").agg(F.array_sort(F.collect_set("value")).alias("values"), (F.max(F.when(F.col("field") == "mrp", F.col("value").try_cast("double"))) - F.min(F.when(F.col("field") == "mrp", F.col("value").try_cast("double")))).alias("spread"))
    return g.filter((F.size("values") > 1) & (F.coalesce("spread", F.lit(1.0)) > 0.01)).select("label_id", "field", "values")


def spread(labels: DataFrame) -> DataFrame:
    """Labels dealt by their id. Windows, groups and joins by label keep this partitioning, so nothing is dealt again."""
    return labels.repartition("label_id")


def declarations(labels: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per label: text, a column for each field's best value, and map confidences. fields: those that are looked for, by default all; others are null."""
    labels = spread(labels)
    return declared(labels, candidates(labels, fields))


def declared(labels: DataFrame, found: DataFrame) -> DataFrame:
    """As declarations, from candidates that are there already."""
    top = best(found)
    extra = ("packer", "marketed_by", "importer", "relative_shelf_life", "allergens", "unit_sale_price", "barcode")
    wide = top.groupBy("label_id").agg(
        *(F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f) for f in (*FIELDS, *extra)),
        F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("confidences"),
    )
    return labels.join(by_label(wide), "label_id", "left")


def nutrition(text: Column) -> Column:
    """Facts per name in grams or milligrams or kilocalories, as a map of text to number; missing ones are left out."""
    facts = {"energy": r"energy", "protein": r"protein", "carbohydrate": r"carbohydrates?", "sugar": r"(?:total\s*)?sugars?", "fat": r"total\s*fat", "saturated_fat": r"saturated\s*fat", "sodium": r"sodium", "cholesterol": r"cholesterol"}
    pairs = [F.struct(F.lit(k), F.regexp_extract(text, rf"(?i)\b{p}[^0-9\n,;]{{0,12}}(\d+(?:\.\d+)?)\s*(?:g|mg|kcal)", 1).try_cast("double")) for k, p in facts.items()]
    return F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: v.isNotNull())


def nutrition_facts(labels: DataFrame) -> DataFrame:
    """label_id, nutrient, amount."""
    return labels.select("label_id", F.explode(nutrition(F.col("text"))).alias("nutrient", "amount"))


def category(text: Column) -> Column:
    """First food category with a keyword in the text; null if none."""
    low = F.lower(text)
    out = None
    for name, words in CATEGORIES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def field_status(d: DataFrame, is_food: Column) -> DataFrame:
    """FOUND, NOT_FOUND or NOT_APPLICABLE of every field of every label."""
    rows = [F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), "FOUND").when((F.lit(f in FOOD_FIELDS)) & ~is_food, "NOT_APPLICABLE").otherwise("NOT_FOUND").alias("status")) for f in FIELDS]
    return d.select("label_id", F.inline(F.array(*rows)))


def date_inversion(d: DataFrame) -> DataFrame:
    """Labels whose year made is after the year of expiry; both fields are in conflict."""
    year = lambda c: F.regexp_extract(F.col(c), r"(\d{4})$", 1).try_cast("int")
    return d.filter(year("manufacturing_date") > year("best_before")).select("label_id", "manufacturing_date", "best_before")


def sections(labels: DataFrame, heading: str, stop: str, most: int = 3) -> DataFrame:
    """Heading line and up to ``most`` lines after it until a stop word, joined."""
    w = W.partitionBy("label_id").orderBy("line")
    rows = lines_of(labels).select("*", *(F.lead("content", k).over(w).alias(f"n{k}") for k in range(1, most + 1))).filter(F.col("content").rlike(heading))
    out, open_ = [F.col("content")], F.lit(True)
    for k in range(1, most + 1):
        open_ = open_ & F.coalesce(~F.col(f"n{k}").rlike(stop), F.lit(False))
        out.append(F.when(open_, F.col(f"n{k}")))
    return rows.select("label_id", "line", F.concat_ws(" ", *out).alias("section"))


#: Unicode ranges of the scripts that labels use.
SCRIPTS = {"Devanagari": r"[\x{0900}-\x{097F}]", "Bengali": r"[\x{0980}-\x{09FF}]", "Gurmukhi": r"[\x{0A00}-\x{0A7F}]", "Gujarati": r"[\x{0A80}-\x{0AFF}]", "Tamil": r"[\x{0B80}-\x{0BFF}]", "Telugu": r"[\x{0C00}-\x{0C7F}]", "Kannada": r"[\x{0C80}-\x{0CFF}]", "Malayalam": r"[\x{0D00}-\x{0D7F}]", "Latin": r"[A-Za-z\x{00C0}-\x{024F}]"}
INDIC = r"[\x{0900}-\x{0D7F}]"


def scripts(docs: DataFrame, key: str) -> DataFrame:
    """Each document's letters by script, its main script, its share and whether scripts are mixed."""
    text = F.coalesce("text", F.lit(""))
    # The eight other scripts lie in one range; only texts with a letter of it are read for each.
    docs = docs.select(key, text.alias("text"), text.rlike(INDIC).alias("indic"))
    n = {s: F.length(F.regexp_replace("text", p.replace("[", "[^") + "+", "")) for s, p in SCRIPTS.items()}
    counts = F.array(*(F.struct((c if s == "Latin" else F.when(F.col("indic"), c).otherwise(0)).alias("n"), F.lit(s).alias("script")) for s, c in n.items()))
    top = docs.select(key, F.array_sort(counts).alias("c")).select(key, F.get("c", F.size("c") - 1).alias("top"), F.get("c", F.size("c") - 2).alias("next"), F.aggregate("c", F.lit(0), lambda a, x: a + x["n"]).alias("letters"))
    share = F.try_divide(F.col("top.n"), F.col("letters"))
    return top.select(key, F.when(F.col("letters") > 0, F.col("top.script")).alias("script"), "letters", F.round(share, 4).alias("share"),
                      F.when(F.col("letters") > 0, F.least(F.lit(0.99), F.greatest(F.lit(0.65), F.round(share, 4)))).alias("confidence"), ((F.col("next.n") >= 2) & (F.col("next.n") >= 0.08 * F.col("letters"))).alias("mixed"))


def multilingual(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """Candidates by dictionary keyword: the rest of a line after the longest keyword of a field.

    keywords: language, field, keyword; a dimension of a few hundred rows, broadcast up to a checked count.
    """
    k = small(keywords.select("language", "field", F.lower("keyword").alias("keyword")))
    hits = lines_of(labels).withColumn("low", F.lower("content")).join(k, F.col("low").contains(F.col("keyword")))
    w = W.partitionBy("label_id", "field").orderBy(F.desc(F.length("keyword")), "line", "language")
    rest = F.trim(F.regexp_replace(F.expr("substring(content, position(keyword, low) + length(keyword))"), r"^[\s:.\-]+", ""))
    return hits.withColumn("value", rest).filter("value <> ''").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("label_id", "field", "language", "keyword", "value", F.col("line").alias("pos"))


def merged(base: DataFrame, more: DataFrame) -> DataFrame:
    """base candidates, and of more those that fill a (label, field) gap, at confidence 80. Both meet in one window, so that base is made once."""
    fills = more.select("label_id", "field", F.col("value").alias("raw"), "value", F.lit(80.0).alias("confidence"), F.lit("dictionary").alias("method"), "pos")
    every = base.withColumn("__more", F.lit(False)).unionByName(fills.withColumn("__more", F.lit(True)))
    w = W.partitionBy("label_id", "field").orderBy("__more", F.desc("confidence"), "pos", "value")
    ranked = every.withColumns({"__rn": F.row_number().over(w), "__gap": F.first("__more").over(w)})
    return ranked.filter("__gap OR __rn = 1").drop("__more", "__rn", "__gap")
