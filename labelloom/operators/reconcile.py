"""Joins that set labels against labels, registries, listings and reviews."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import columns as C
from labelloom.sources.shared import stored

WEIGHT = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts; Spark has no built-in for it."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Name similarity, 0 to 1: 1 if equal, else half token Jaccard, half sequence ratio, 0.2 more if one holds the other."""
    a, b = C.entity_name(left), C.entity_name(right)
    ta, tb = F.split(a, " "), F.split(b, " ")
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    inside = F.when(a.contains(b) | b.contains(a), 0.2).otherwise(0.0)
    score = F.least(F.lit(1.0), 0.5 * jaccard + 0.5 * sequence_ratio(a, b) + inside)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.round(score, 3))


def graded(score: Column, match: float, partial: float) -> Column:
    return F.when(score.isNull(), "UNVERIFIED").when(score >= match, "MATCH").when(score >= partial, "PARTIAL").otherwise("MISMATCH")


def best_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left row (id, name) the right row (id, name) of the best score among those that share a token; null without one.

    Tokens of up to MOST_SHARED right names are joined first. A score is at most 0.7 and half the Jaccard, so a pair that
    reaches the best score so far shares a least part of the left name's tokens, and thus one of its rarest few; of
    these the common ones are joined as well, salted. No pair that could be the best is left out.
    """
    tokens = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.explode(F.array_distinct(F.split(C.entity_name(F.col("name")), " "))).alias("token")).filter("token <> ''")
    r = tokens(right, "r")
    shared = r.groupBy("token").agg(F.count("*").alias("n"))
    own = tokens(left, "l").distinct().join(shared, "token", "left").na.fill(0, ["n"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.select("l_id", "l_name", "r_id", "r_name").distinct().withColumn("score", similarity(F.col("l_name"), F.col("r_name")))

    rare = scored(own.filter(F.col("n") <= MOST_SHARED).join(r, "token"))
    so_far = rare.groupBy(F.col("l_id").alias("of_id"), F.col("l_name").alias("of_name")).agg(F.max("score").alias("s"))
    name = W.partitionBy("l_id", "l_name")
    ranked = own.withColumn("size", F.count("*").over(name)).withColumn("place", F.row_number().over(name.orderBy("n", "token"))).filter(F.col("n") > MOST_SHARED)
    part = F.greatest(F.lit(0.0), 2 * (F.coalesce("s", F.lit(0.0)) - 0.7005))  # scores are rounded to 0.001
    more = ranked.join(so_far, F.col("l_id").eqNullSafe(F.col("of_id")) & (F.col("l_name") == F.col("of_name")), "left").filter(F.col("place") <= F.col("size") - F.ceil(part * F.col("size") - 1e-9) + 1)
    salted = more.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    common = scored(salted.join(r.withColumn("salt", F.pmod(F.xxhash64("r_id", "r_name"), F.lit(SALTS)).cast("int")), ["token", "salt"]))
    found = rare.unionByName(common).select("l_id", F.struct("score", (-F.col("r_id")).alias("k"), "r_name").alias("b"))
    best = found.unionByName(left.select(F.col("id").alias("l_id")), allowMissingColumns=True).groupBy("l_id").agg(F.max("b").alias("b"))
    return best.select(F.col("l_id").alias("id"), (-F.col("b.k")).alias("match_id"), F.col("b.r_name").alias("match_name"), F.col("b.score").alias("score"))


#: Right names that may share a token before it is joined only where it can decide, and the parts such a token is dealt to.
MOST_SHARED = 100
SALTS = 16


#: What counts as an issue that a version can fix, what a pass can fall to, and what an issue is for resolution.
FIXABLE = ("FAIL", "WARNING", "NEEDS_REVIEW", "INSUFFICIENT_EVIDENCE")
DECLINE = ("FAIL", "WARNING", "NEEDS_REVIEW")
ISSUE = ("FAIL", "WARNING")


def rule_diff(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Outcome of each rule in version A and B and how it changed; a missing side is NOT_APPLICABLE (has_a, has_b tell)."""
    left = pairs.join(a.select(F.col("screening_id").alias("version_a"), "rule_id", F.col("status").alias("status_a")), "version_a").select("version_a", "version_b", "rule_id", "status_a")
    right = pairs.join(b.select(F.col("screening_id").alias("version_b"), "rule_id", F.col("status").alias("status_b")), "version_b").select("version_a", "version_b", "rule_id", "status_b")
    j = left.join(right, ["version_a", "version_b", "rule_id"], "full_outer").withColumns({"has_a": F.col("status_a").isNotNull(), "has_b": F.col("status_b").isNotNull()})
    j = j.na.fill("NOT_APPLICABLE", ["status_a", "status_b"])
    x, y = F.col("status_a"), F.col("status_b")
    change = (
        F.when(x == y, "UNCHANGED")
        .when(x.isin(*FIXABLE) & (y == "PASS"), "FIXED")
        .when((x == "PASS") & y.isin(*DECLINE), "REGRESSED")
        .when((x == "NOT_APPLICABLE") & (y != "NOT_APPLICABLE"), "NEWLY_EVALUATED")
        .otherwise("MODIFIED")
    )
    return j.withColumn("change", change)


def issue_resolution(diff: DataFrame) -> DataFrame:
    """What became of A's failures and warnings, and B's new ones (A absent or passed). diff: rows of rule_diff.

    A rule can be resolved for A's issue and can't be a new issue at once, so a rule gives one row at most.
    """
    x, y = F.col("status_a"), F.col("status_b")
    state = (
        F.when(x.isin(*ISSUE) & (y == "PASS"), "RESOLVED")
        .when(x.isin(*ISSUE) & y.isin(*ISSUE), "STILL_PRESENT")
        .when(x.isin(*ISSUE) & (y == "NEEDS_REVIEW"), "UNRESOLVED_REVIEW")
        .when(y.isin(*ISSUE) & (~F.col("has_a") | (x == "PASS")), "NEW_ISSUE")
    )
    return diff.withColumn("resolution", state).filter("resolution IS NOT NULL").select("version_a", "version_b", "rule_id", "resolution")


def field_diff(pairs: DataFrame, declared: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each field of each pair: ADDED, REMOVED, CHANGED or UNCHANGED, with price and quantity deltas. declared: label_id and the fields."""
    long = declared.select("label_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))).filter("value IS NOT NULL")
    left = pairs.join(long.withColumnRenamed("label_id", "label_a"), "label_a").withColumnRenamed("value", "value_a")
    right = pairs.join(long.withColumnRenamed("label_id", "label_b"), "label_b").withColumnRenamed("value", "value_b")
    j = left.join(right, ["label_a", "label_b", "field"], "full_outer")
    key = lambda c: F.when(F.col("field") == "fssai_license", C.licence_digits(F.col(c))).when(F.col("field") == "mrp", C.price(F.col(c)).cast("string")).otherwise(C.comparison_key(F.col(c)))
    change = F.when(F.col("value_a").isNull(), "ADDED").when(F.col("value_b").isNull(), "REMOVED").when(key("value_a") == key("value_b"), "UNCHANGED").otherwise("CHANGED")
    number = lambda c: F.when(F.col("field").isin("mrp", "net_quantity"), C.price(F.col(c)).cast("double"))
    delta = F.round(number("value_b") - number("value_a"), 2)
    return j.select("label_a", "label_b", "field", "value_a", "value_b", change.alias("change"), delta.alias("delta"), F.round(F.try_divide(100 * delta, number("value_a")), 1).alias("percent"))


def ingredient_diff(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Added, removed and common ingredients of each pair, any case. lists: label_id, ingredients as comma text."""
    tokens = F.filter(F.transform(F.split(F.lower(F.coalesce("ingredients", F.lit(""))), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    t = lists.select("label_id", tokens.alias("t"))
    j = pairs.join(t.toDF("label_a", "ta"), "label_a").join(t.toDF("label_b", "tb"), "label_b")
    text = lambda c: F.array_join(F.array_sort(c), ", ")
    added, removed = F.array_except("tb", "ta"), F.array_except("ta", "tb")
    state = F.when((F.size(added) == 0) & (F.size(removed) == 0), F.when(F.col("ta") == F.col("tb"), "UNCHANGED").otherwise("REORDERED_ONLY")).otherwise("CHANGED")
    return j.select("label_a", "label_b", text(added).alias("added"), text(removed).alias("removed"), text(F.array_intersect("ta", "tb")).alias("common"), state.alias("state"))


def nutrient_diff(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Amounts of each nutrient in A and B and their difference. facts: label_id, nutrient, amount."""
    a = pairs.join(facts.toDF("label_a", "nutrient", "amount_a"), "label_a")
    b = pairs.join(facts.toDF("label_b", "nutrient", "amount_b"), "label_b")
    j = a.join(b, ["label_a", "label_b", "nutrient"], "full_outer")
    return j.withColumn("delta", F.round(F.col("amount_b") - F.col("amount_a"), 2))


def version_summary(pairs: DataFrame, resolutions: DataFrame, risks: DataFrame, checks: DataFrame) -> DataFrame:
    """Score change, risk shift, resolved, remaining and new issues, critical failures and missing declarations of both sides, verdict.

    pairs: version_a, version_b, score_a, score_b; risks: screening_id, risk_level; checks: screening_id, status, severity, required, detected.
    """
    states = {"resolved": "RESOLVED", "remaining": "STILL_PRESENT", "new_issues": "NEW_ISSUE"}
    n = resolutions.groupBy("version_a", "version_b").agg(*(F.count_if(F.col("resolution") == v).alias(k) for k, v in states.items()))
    w = F.coalesce(*(F.when(F.upper("risk_level") == k, v) for k, v in WEIGHT.items()), F.lit(2))
    per = checks.groupBy("screening_id").agg(F.count_if((F.col("status") == "FAIL") & (F.col("severity") == "critical")).alias("critical"), F.count_if(~F.col("detected") & F.col("required")).alias("missing"))
    own = risks.select("screening_id", w.alias("w")).join(per, "screening_id", "full_outer")
    side = lambda s: own.toDF(f"version_{s}", f"w{s}", f"critical_{s}", f"missing_{s}")
    j = pairs.join(n, ["version_a", "version_b"], "left").join(side("a"), "version_a", "left").join(side("b"), "version_b", "left")
    j = j.na.fill(0, [*states, "critical_a", "critical_b", "missing_a", "missing_b"]).na.fill(2, ["wa", "wb"])
    shift = F.when(F.col("wb") < F.col("wa"), "IMPROVED").when(F.col("wb") > F.col("wa"), "DEGRADED").otherwise("UNCHANGED")
    delta = F.round(F.round("score_b", 1) - F.round("score_a", 1), 1)
    verdict = F.when((delta > 0) & (F.col("resolved") > 0), "IMPROVED").when(delta < 0, "REGRESSED").otherwise("CONSISTENT")
    return j.select("version_a", "version_b", delta.alias("score_delta"), shift.alias("risk_shift"), *states, "critical_a", "critical_b", "missing_a", "missing_b", verdict.alias("verdict"))


#: Severity of each field of a listing by what was found.
LISTING_SEVERITY = {
    "product_name": {"MISMATCH": "HIGH", "INSUFFICIENT_DATA": "MEDIUM"},
    "net_quantity": {"MISMATCH": "CRITICAL", "INSUFFICIENT_DATA": "HIGH"},
    "mrp": {"MISMATCH": "HIGH", "INSUFFICIENT_DATA": "HIGH"},
    "manufacturer": {"MISMATCH": "HIGH", "INSUFFICIENT_DATA": "MEDIUM"},
    "fssai_license": {"MISMATCH": "CRITICAL", "INSUFFICIENT_DATA": "HIGH"},
    "country_of_origin": {"MISMATCH": "CRITICAL", "INSUFFICIENT_DATA": "HIGH"},
}


def package_vs_listing(package: DataFrame, listing: DataFrame) -> DataFrame:
    """Fields that the package declares against its listing: label_id, field, package, listing, result, severity.

    MATCH, MISMATCH, or INSUFFICIENT_DATA where the listing has nothing. Names agree by a word
    of three characters or more, makers by one of four letters; quantities and prices by their
    first number to 0.01 (one without a number is compared as text, a quantity then differs);
    a listing price above the package's is CRITICAL. A label without a listing has no row.
    """
    j = package.join(listing.toDF(*(f"l_{c}" if c != "label_id" else c for c in listing.columns)), "label_id")
    tokens = lambda c, p: F.regexp_extract_all(F.lower(c), F.lit(rf"\b({p})\b"), 1)
    share = lambda f, p: F.arrays_overlap(tokens(f, p), tokens(f"l_{f}", p))
    number = lambda c: F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    near = lambda f: F.abs(number(f) - number(f"l_{f}")) < 0.01
    plain = lambda f: F.lower(f) == F.lower(f"l_{f}")
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    prices = number("mrp").isNotNull() & number("l_mrp").isNotNull()
    tests = {
        "product_name": share("product_name", "[a-z0-9]{3,}"),
        "net_quantity": F.coalesce(near("net_quantity"), F.lit(False)),
        "mrp": F.when(prices, near("mrp")).otherwise(plain("mrp")),
        "manufacturer": share("manufacturer", "[a-z]{4,}"),
        "fssai_license": digits("fssai_license") == digits("l_fssai_license"),
        "country_of_origin": plain("country_of_origin"),
    }
    known = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rows = []
    for f, t in tests.items():
        result = F.when(~known(f"l_{f}"), "INSUFFICIENT_DATA").when(t, "MATCH").otherwise("MISMATCH")
        level = F.when(result == "MATCH", "INFO")
        if f == "mrp":
            level = F.when(known("l_mrp") & ~prices, "MEDIUM").when(known("l_mrp") & (number("l_mrp") >= number("mrp") + 0.01), "CRITICAL").when(result == "MATCH", "INFO")
        for state, severity in LISTING_SEVERITY[f].items():
            level = level.when(result == state, severity)
        row = F.struct(F.lit(f).alias("field"), F.trim(f).alias("package"), F.when(known(f"l_{f}"), F.trim(f"l_{f}")).alias("listing"), result.alias("result"), level.alias("severity"))
        rows.append(F.when(known(f), row))
    return j.select("label_id", F.inline(F.array_compact(F.array(*rows))))


def listing_verdict(fields: DataFrame) -> DataFrame:
    """Verdict and counts of each label's compared fields. fields: package_vs_listing."""
    counts = {"matches": "MATCH", "mismatches": "MISMATCH", "insufficient": "INSUFFICIENT_DATA"}
    n = fields.groupBy("label_id").agg(*(F.count_if(F.col("result") == v).alias(k) for k, v in counts.items()))
    return n.select("label_id", F.when(F.col("mismatches") > 0, "MISMATCH_DETECTED").when(F.col("insufficient") > 0, "INSUFFICIENT_ONLINE_DATA").otherwise("COMPLIANT_MATCH").alias("verdict"), *counts)


def lookup(keys: DataFrame, providers: list[DataFrame], key: str, valid: Column) -> DataFrame:
    """Record of each key from the first provider that has it; invalid keys are not looked up.

    providers: in order of precedence, each with the key and a column record; a further one is a further DataFrame.
    """
    out = keys.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    for i, p in enumerate(providers):
        out = out.join(p.select(F.col(key).alias(f"__k{i}"), F.col("record").alias(f"__r{i}")), F.col("__ok") & (F.col(key) == F.col(f"__k{i}")), "left")
    source = F.when(~F.col("__ok"), "INVALID_FORMAT")
    for i in range(len(providers)):
        source = source.when(F.col(f"__k{i}").isNotNull(), f"PROVIDER_{i + 1}")
    return out.select(*keys.columns, source.otherwise("NOT_FOUND").alias("source"), F.coalesce(*(F.col(f"__r{i}") for i in range(len(providers)))).alias("record"))


def _plain(c: Column) -> Column:
    """Lower-case text with single spaces and without punctuation at its ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def _shared(a: Column, b: Column) -> Column:
    """Share of a's words that b has."""
    return F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) / F.greatest(F.lit(1), F.size(F.array_distinct(F.split(a, " "))))


def compared(j: DataFrame, keys: tuple[str, ...], fields: dict[str, tuple[str, str, str]], ratio: float = 0.65) -> DataFrame:
    """Field-wise comparison of label and registry: MATCH, MISMATCH, NOT_FOUND, NOT_VERIFIED, NOT_COMPARABLE.

    fields: name to (label column, registry column, kind). text: equal, one in the other,
    half of the label's words, or a sequence ratio; brand: equal or one in the other; maker:
    as text without corporate words and without the ratio; quantity: number, and unit where
    both have one; digits; price: within 0.05. Where a side is missing, digits and price
    look for the label's value first, the others for the registry's.
    """
    rows = []
    for f, (a, b, kind) in fields.items():
        x, y = F.nullif(F.trim(F.col(a)), F.lit("")), F.nullif(F.trim(F.col(b)), F.lit(""))
        if kind == "price":
            px, py = C.price(x).cast("double"), C.price(y).cast("double")
            found = F.when(y.isNull(), "NOT_COMPARABLE").when(x.isNull(), "NOT_FOUND").when(px.isNull() | py.isNull(), "NOT_COMPARABLE")
            ok = F.abs(px - py) < 0.05
        elif kind == "digits":
            found = F.when(x.isNull(), "NOT_FOUND").when(y.isNull(), "NOT_VERIFIED")
            ok = C.licence_digits(x) == C.licence_digits(y)
        else:
            found = F.when(y.isNull(), "NOT_FOUND").when(x.isNull(), "NOT_VERIFIED")
            name = C.entity_name if kind == "maker" else _plain
            kx, ky = name(x), name(y)
            inside = (kx == ky) | kx.contains(ky) | ky.contains(kx)
            if kind == "quantity":
                (qx, ux), (qy, uy) = C.quantity(x), C.quantity(y)
                ok = F.when(qx.isNotNull() & qy.isNotNull(), (qx == qy) & F.coalesce(ux == uy, F.lit(True))).otherwise(kx == ky)
            elif kind == "brand":
                ok = inside
            elif kind == "maker":
                ok = inside | (_shared(kx, ky) >= 0.5)
            else:
                ok = F.when(inside | (_shared(kx, ky) >= 0.5), True).otherwise(sequence_ratio(kx, ky) >= ratio)
        rows.append(F.struct(F.lit(f).alias("field"), found.when(F.coalesce(ok, F.lit(False)), "MATCH").otherwise("MISMATCH").alias("result")))
    return j.select(*keys, F.inline(F.array(*rows)))


def consistency(results: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Counts of results per key, overall by precedence, a verification confidence with tier, and the pipeline's verdict.

    results: key, field, result (MATCH, PARTIAL, MISMATCH; others aren't evaluable), critical.
    known: key, licence_status and code_status: VERIFIED, NOT_FOUND, UNAVAILABLE, INVALID_FORMAT, NOT_APPLICABLE or null without a record.
    """
    n = lambda v: F.count_if(F.col("result") == v).alias(v.lower())
    g = results.groupBy(key).agg(n("MATCH"), n("PARTIAL"), n("MISMATCH"), F.count_if("critical").alias("critical"))
    j = known.join(g, key, "left").na.fill(0, ["match", "partial", "mismatch", "critical"])
    formed = lambda c: F.coalesce(~F.col(c).isin("INVALID_FORMAT", "NOT_APPLICABLE"), F.lit(False))
    hit = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    part = lambda cond, v: F.when(cond, v).otherwise(0)
    seen = F.col("match") + F.col("partial") + F.col("mismatch")
    # Whole hundredths and thousandths, so that nothing depends on how halves are rounded in binary.
    hundredths = F.coalesce(F.floor(F.try_divide(200 * F.col("match") + 100 * F.col("partial") + seen, 2 * seen)), F.lit(0))
    raw = part(formed("licence_status"), 150) + part(formed("code_status"), 150) + part(hit("licence_status", "VERIFIED"), 200) + part(hit("code_status", "VERIFIED"), 150) + F.floor((35 * hundredths + 5) / 10)
    left = F.greatest(F.lit(0), raw - 350 * F.col("critical"))
    score = F.least(F.lit(100), F.floor((left + 5) / 10)) / 100
    agreement = hundredths / 100
    overall = F.when(F.col("mismatch") > 0, "MISMATCH").when(F.col("partial") > 0, "PARTIAL").when(F.col("match") > 0, "MATCH").otherwise("UNVERIFIED")
    tier = F.when(F.col("confidence") >= 0.75, "HIGH").when(F.col("confidence") >= 0.45, "MEDIUM").when(F.col("confidence") > 0, "LOW").otherwise("ZERO")
    down = hit("licence_status", "UNAVAILABLE") & hit("code_status", "UNAVAILABLE")
    absent = hit("licence_status", "NOT_FOUND") | hit("code_status", "NOT_FOUND")
    verdict = (
        F.when(F.col("mismatch") > 0, "REVIEW_REQUIRED")
        .when(F.col("match") > 0, "MATCH")
        .when(down, "EXTERNAL_VERIFICATION_UNAVAILABLE")
        .when(absent, "EXTERNAL_DATA_NOT_FOUND")
        .otherwise("NOT_VERIFIED")
    )
    out = j.select("*", overall.alias("overall"), score.alias("confidence"), agreement.alias("agreement"), verdict.alias("verdict"))
    return out.select(key, "match", "partial", "mismatch", "critical", "agreement", "overall", "confidence", tier.alias("tier"), "verdict")


def barcode_verdict(codes: DataFrame, registry: DataFrame) -> DataFrame:
    """PASS, WARNING or FAIL of each code against the registry. codes: product_id, code, name; registry: code, name."""
    j = codes.join(registry.select(F.col("code").alias("r_code"), F.col("name").alias("r_name")), F.col("code") == F.col("r_code"), "left")
    wrong = F.array_compact(F.array(F.when(~C.gtin_valid(F.col("code")), F.lit("checksum")), F.when(F.col("r_name").isNotNull() & (C.entity_name(F.col("name")) != C.entity_name(F.col("r_name"))), F.lit("name"))))
    text = F.array_join(wrong, ",")
    return j.select("product_id", "code", text.alias("discrepancies"), F.when(F.size(wrong) > 0, "FAIL").when(F.col("r_code").isNotNull() | C.gtin_valid(F.col("code")), "PASS").otherwise("WARNING").alias("verdict"))


def master_record(payloads: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Master columns from payload maps by candidate keys; what no column uses is kept apart. payloads: key columns and map payload."""
    used = [k for keys in columns.values() for k in keys]
    rest = F.map_filter("payload", lambda k, v: ~k.isin(*used))
    keys = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*keys, *(C.first_present(F.col("payload"), v).alias(k) for k, v in columns.items()), F.array_join(F.array_sort(F.map_keys(rest)), ",").alias("unused"))


def identity_conflicts(label: DataFrame, licences: DataFrame, codes: DataFrame) -> DataFrame:
    """What conflicts between a label, its QR payload and two registries, and the status that follows.

    label: label_id, manufacturer, brand, net_quantity, country_of_origin, fssai_license, barcode, qr_licence, qr_weight,
    code_country (null where the code's prefix tells none). licences: fssai_license, licence_status, business_name;
    codes: barcode, code_status, brand_name, net_content: what a lookup gave, VERIFIED or NOT_FOUND; others are unavailable.
    """
    j = label.join(licences, "fssai_license", "left").join(codes, "barcode", "left")
    close = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    digits = lambda c: F.nullif(F.regexp_extract(close(c), r"(\d+)", 1), F.lit(""))
    long_words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\w{4,})"), F.lit(1))
    apart = lambda a, b: ~F.lower(a).contains(F.lower(b)) & ~F.lower(b).contains(F.lower(a))
    known = F.coalesce((F.col("code_status") == "VERIFIED") & F.coalesce("brand_name", "net_content").isNotNull(), F.lit(False))
    licensed = F.coalesce((F.col("licence_status") == "VERIFIED") & F.col("business_name").isNotNull(), F.lit(False))
    maker, firm = F.col("manufacturer"), F.col("business_name")
    kinds = {
        "licence": F.col("fssai_license") != F.col("qr_licence"),
        "quantity_code": close("net_quantity") != close("qr_weight"),
        "quantity": known & (digits("net_quantity") != digits("net_content")),
        "brand": known & apart(F.col("brand"), F.col("brand_name")),
        "maker": licensed & (F.length(maker) > 4) & apart(letters(maker), letters(firm)) & (F.size(F.array_intersect(long_words(maker), long_words(firm))) == 0),
        "origin": F.col("barcode").isNotNull() & apart(F.col("country_of_origin"), F.col("code_country")),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in kinds.items())))
    absent = F.coalesce(F.col("licence_status") == "NOT_FOUND", F.lit(False)) | F.coalesce(F.col("code_status") == "NOT_FOUND", F.lit(False))
    status = (
        F.when(F.size(found) > 0, "CONFLICT_DETECTED")
        .when(known | licensed, "PASS")
        .when(absent, "REGISTRY_NOT_FOUND")
        .when(F.col("fssai_license").isNull() & F.col("barcode").isNull(), "NOT_CHECKED")
        .otherwise("REGISTRY_UNAVAILABLE")
    )
    return j.select("label_id", F.array_join(found, ",").alias("conflicts"), status.alias("status"))


def identity_record(d: DataFrame, fields: tuple[str, ...], food: tuple[str, ...], is_food: Column) -> DataFrame:
    """Each identity field's value, status and confidence."""
    c = lambda f: F.coalesce(F.try_element_at("confidences", F.lit(f)), F.lit(0.0))
    rows = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.when(F.col(f).isNotNull() & (c(f) >= 60), "FOUND").when(F.col(f).isNotNull(), "LOW_CONFIDENCE").when(F.lit(f in food) & ~is_food, "NOT_APPLICABLE").otherwise("NOT_FOUND").alias("status"), c(f).alias("confidence")) for f in fields]
    return d.select("label_id", F.inline(F.array(*rows)))


def machine_vs_human(checks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Machine status of each check and the last correction of it. corrections: screening_id, rule_id, status, at."""
    last = corrections.groupBy("screening_id", "rule_id").agg(F.max_by("status", "at").alias("human"))
    j = checks.join(last, ["screening_id", "rule_id"], "left")
    return j.select("screening_id", "rule_id", F.col("status").alias("machine"), F.coalesce("human", "status").alias("final"), F.coalesce(F.col("human") != F.col("status"), F.lit(False)).alias("changed"))


#: The status that each officer action gives a check.
ACTIONS = {"CORRECT": "PASS", "APPROVE": "PASS", "REJECT": "FAIL", "REQUEST_RESCAN": "NEEDS_REVIEW"}


def apply_actions(checks: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checks after the last action on each, and an audit row for each change. actions: screening_id, rule_id, action, at."""
    last = actions.groupBy("screening_id", "rule_id").agg(F.max_by("action", "at").alias("action"), F.max("at").alias("at"))
    to = F.coalesce(*(F.when(F.col("action") == k, v) for k, v in ACTIONS.items()))
    j = checks.join(last, ["screening_id", "rule_id"], "left").withColumn("new", F.coalesce(to, F.col("status")))
    after = j.select(*[F.col("new").alias("status") if c == "status" else F.col(c) for c in checks.columns])
    audit = j.filter("action IS NOT NULL").select("screening_id", "rule_id", "action", "at", F.col("status").alias("previous_value"), F.col("new").alias("new_value"))
    return after, audit


def duplicate_boxes(evidence: DataFrame) -> DataFrame:
    """Boxes that several unrelated rules of a label share. evidence: label_id, rule_id, bbox; LM-002 and FS-002 may share."""
    rule = F.when(F.col("rule_id") == "FS-002", "LM-002").otherwise(F.col("rule_id"))
    g = evidence.groupBy("label_id", "bbox").agg(F.array_sort(F.collect_set(rule)).alias("rules"))
    return g.filter(F.size("rules") > 1).select("label_id", "bbox", F.array_join("rules", ",").alias("rules"))


def artwork_chain(artworks: DataFrame) -> DataFrame:
    """Root, iteration and ancestors of each artwork. artworks: id, parent_id. A chain is as deep as it is.

    One join a level, whose rows are written before the next; a recursive query in SQL ends at a million rows.
    """
    left = stored(artworks.select("id", "parent_id"))
    level = left.filter("parent_id IS NULL").select("id", F.col("id").alias("root"), F.lit(1).alias("iteration"), F.lit("").alias("ancestors"))
    levels = []
    while True:
        level = stored(level)
        if level.isEmpty():
            break
        levels.append(level)
        above = level.select(F.col("id").alias("parent_id"), "root", "iteration", "ancestors")
        path = F.concat_ws("/", F.nullif("ancestors", F.lit("")), F.col("parent_id").cast("string"))
        level = left.join(above, "parent_id").select("id", "root", (F.col("iteration") + 1).alias("iteration"), path.alias("ancestors"))
    return reduce(DataFrame.unionByName, levels, level)


def resolve_snapshots(ids: DataFrame, screenings: DataFrame, artworks: DataFrame) -> DataFrame:
    """Version ids to the snapshot of a screening, or else an artwork. ids: ref; both others: ref, score, label."""
    both = screenings.select("ref", F.lit("SCREENING").alias("kind"), "score", "label").unionByName(artworks.select("ref", F.lit("ARTWORK").alias("kind"), "score", "label"))
    return ids.join(both, "ref", "left")


def approval_gate(decisions: DataFrame, readiness: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted decisions with their workflow and approval status, and refused ones with the reason.

    decisions: artwork_id, decision (APPROVED, REJECTED, or anything else for changes), acknowledged. Nothing is decided
    without the acknowledgement, and NON_COMPLIANT artwork can't be approved; artwork that was never analysed can.
    """
    j = decisions.join(readiness.select("artwork_id", "readiness"), "artwork_id", "left")
    no_ack = ~F.coalesce("acknowledged", F.lit(False))
    refused = F.when(no_ack, "NOT_ACKNOWLEDGED").when((F.col("decision") == "APPROVED") & (F.col("readiness") == "NON_COMPLIANT"), "NON_COMPLIANT")
    workflow = F.when(F.col("decision") == "APPROVED", "READY_FOR_PRINT").when(F.col("decision") == "REJECTED", "REJECTED").otherwise("CHANGES_REQUESTED")
    approval = F.when(F.col("decision").isin("APPROVED", "REJECTED"), F.col("decision")).otherwise("CHANGES_REQUESTED")
    j = j.withColumn("refused", refused)
    ok = j.filter("refused IS NULL").select("artwork_id", "decision", "readiness", workflow.alias("workflow_status"), approval.alias("approval_status"))
    return ok, j.filter("refused IS NOT NULL").select("artwork_id", "decision", "readiness", "refused")
