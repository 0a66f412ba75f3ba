"""Marketing claims: found in label texts, set against ingredients and nutrition, scored and summed.

claim rules: rule_id, claim_type, category, risk_level, patterns, contradictions,
is_absolute, is_comparative, is_high_risk, ord. Patterns and texts meet in a join on a
pattern's first run of letters and digits, however many rules there are.

Statuses: SUPPORTED, INSUFFICIENT_EVIDENCE, POTENTIAL_CONTRADICTION,
HIGH_RISK_REVIEW, NOT_ASSESSABLE; all but the first ask for a human review.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators.common import small

_COLOURS = ("ins 102", "ins 110", "ins 122", "ins 124", "ins 127", "ins 133", "tartrazine", "sunset yellow", "brilliant blue", "carmoisine", "erythrosine")
_SUGARS = ("sugar", "cane sugar", "sucrose", "invert sugar", "glucose", "fructose", "jaggery", "honey")
#: The claim rules in order: id, type, category, risk, patterns, ingredients that contradict.
CLAIM_RULES = (
    ("CLAIM-RULE-CRT-001", "ORGANIC_CERTIFICATION", "CERTIFICATION", "HIGH", ("organic", "certified organic", "100% organic", "npop certified", "jaivik"), ()),
    ("CLAIM-RULE-CRT-002", "GMP_ISO_STANDARDS", "CERTIFICATION", "MEDIUM", ("iso certified", "gmp certified", "haccp certified", "bis certified", "isi marked"), ()),
    ("CLAIM-RULE-CMP-001", "NO_1_OR_BEST_BRAND", "COMPARATIVE", "HIGH", ("no. 1 brand", "no 1 brand", "number 1 brand", "#1 brand", "best brand", "best in india", "most trusted brand"), ()),
    ("CLAIM-RULE-ENV-001", "BIODEGRADABLE_ECO_FRIENDLY", "ENVIRONMENTAL", "HIGH", ("biodegradable", "eco friendly", "eco-friendly", "recyclable", "plastic free", "carbon neutral"), ()),
    ("CLAIM-RULE-HLT-001", "IMMUNITY_BOOSTER", "HEALTH", "HIGH", ("immunity booster", "boosts immunity", "boost immunity", "immune support", "builds immunity"), ()),
    ("CLAIM-RULE-HLT-002", "WEIGHT_LOSS", "HEALTH", "CRITICAL", ("weight loss", "burns fat", "fat burner", "slimming"), ()),
    ("CLAIM-RULE-HLT-003", "ENERGY_BOOSTER", "HEALTH", "MEDIUM", ("energy booster", "boosts energy", "instant energy"), ()),
    ("CLAIM-RULE-ING-001", "NO_PRESERVATIVES", "INGREDIENT", "HIGH", ("no preservatives", "preservative free", "without preservatives", "zero preservatives", "no added preservatives"), ("sodium benzoate", "potassium sorbate", "sorbic acid", "benzoic acid", "sulphur dioxide", "calcium propionate", "sodium nitrite", "ins 211", "ins 202", "ins 220", "ins 223", "ins 224", "ins 282", "ins 250", "preservative", "preservatives")),
    ("CLAIM-RULE-ING-002", "NATURAL_QUALITY", "INGREDIENT", "HIGH", ("100% natural", "all natural", "pure natural", "natural ingredients"), ("artificial flavour", "artificial colour", "synthetic colour", "aspartame", "sucralose", "saccharin", *_COLOURS, "sodium benzoate", "potassium sorbate", "bha", "bht", "tbhq")),
    ("CLAIM-RULE-ING-003", "NO_ARTIFICIAL_COLOURS", "INGREDIENT", "HIGH", ("no artificial colours", "no artificial colors", "colour free", "no synthetic colours"), ("synthetic colour", "artificial colour", *_COLOURS)),
    ("CLAIM-RULE-ING-004", "CHEMICAL_FREE", "INGREDIENT", "HIGH", ("chemical free", "no chemicals", "zero chemicals", "chemical-free"), ()),
    ("CLAIM-RULE-MED-001", "DISEASE_CURE_TREATMENT", "MEDICAL", "CRITICAL", ("cures diabetes", "cures cancer", "prevents disease", "treats diabetes", "anti cancer"), ()),
    ("CLAIM-RULE-MED-002", "CLINICAL_DOCTOR_RECOMMENDED", "MEDICAL", "HIGH", ("doctor recommended", "clinically proven", "scientifically proven"), ()),
    ("CLAIM-RULE-NUT-001", "NO_ADDED_SUGAR", "NUTRITIONAL", "HIGH", ("no added sugar", "without added sugar", "zero added sugar", "no sugar added"), (*_SUGARS, "corn syrup", "dextrose", "maltodextrin", "molasses")),
    ("CLAIM-RULE-NUT-002", "SUGAR_FREE", "NUTRITIONAL", "HIGH", ("sugar free", "sugar-free", "zero sugar"), _SUGARS),
    ("CLAIM-RULE-NUT-003", "HIGH_PROTEIN", "NUTRITIONAL", "MEDIUM", ("high protein", "rich in protein", "protein rich", "source of protein"), ()),
    ("CLAIM-RULE-NUT-004", "LOW_FAT", "NUTRITIONAL", "MEDIUM", ("low fat", "low in fat", "light fat"), ()),
    ("CLAIM-RULE-NUT-005", "ZERO_CHOLESTEROL", "NUTRITIONAL", "MEDIUM", ("zero cholesterol", "cholesterol free", "no cholesterol"), ()),
    ("CLAIM-RULE-NUT-006", "RICH_IN_CALCIUM", "NUTRITIONAL", "MEDIUM", ("rich in calcium", "calcium rich", "high calcium"), ()),
    ("CLAIM-RULE-ORG-001", "MADE_IN_INDIA", "ORIGIN", "HIGH", ("made in india", "product of india", "manufactured in india", "swadeshi"), ()),
    ("CLAIM-RULE-QLT-001", "100_PERCENT_PURE", "QUALITY", "HIGH", ("100% pure", "guaranteed purity", "pure quality", "purest"), ()),
    ("CLAIM-RULE-QLT-002", "PREMIUM_QUALITY", "QUALITY", "LOW", ("premium quality", "superior quality", "finest quality"), ()),
)
#: Rules that are absolute, comparative or of high risk whatever their pattern.
ABSOLUTE_RULES = ("CLAIM-RULE-CMP-001", "CLAIM-RULE-ENV-001", "CLAIM-RULE-ING-002", "CLAIM-RULE-ING-004", "CLAIM-RULE-QLT-001")
COMPARATIVE_RULES = ("CLAIM-RULE-CMP-001",)
HIGH_RISK_RULES = ("CLAIM-RULE-HLT-001", "CLAIM-RULE-HLT-002", "CLAIM-RULE-MED-001", "CLAIM-RULE-MED-002")
#: Substrings that make a claim absolute, comparative or of high risk.
ABSOLUTE = ("100%", "100 percent", "zero", "0%", "no", "free", "pure", "only", "best", "number 1", "no. 1", "no 1", "#1", "completely", "guaranteed", "all")
COMPARATIVE = ("no. 1", "no 1", "number 1", "#1", "best", "better", "superior", "leading", "most trusted", "more than", "highest")
HIGH_RISK = ("cure", "cures", "treat", "treats", "prevent", "prevents", "disease", "cancer", "diabetes", "anti-covid", "anti covid", "infection", "clinically proven", "scientifically proven", "doctor recommended", "doctor's choice", "guaranteed weight loss", "burns fat", "100% disease protection")
#: Marks that support an organic claim, and nutrients that support an immunity claim.
MARKINGS = ("jaivik bharat", "npop", "pgs-india", "usda organic", "eu organic", "organic india")
IMMUNITY_NUTRIENTS = ("vitamin c", "zinc", "vitamin d", "vitamin a", "iron", "copper", "selenium", "protein")
#: Grammars of claims that no rule lists: category, flags (absolute, comparative, high risk), pattern.
OPEN = (
    ("ABSOLUTE", True, False, False, r"(?i)\b(100%\s+[a-zA-Z]{3,20}|zero\s+[a-zA-Z]{3,20}|completely\s+[a-zA-Z]{3,20})\b"),
    ("COMPARATIVE", True, True, False, r"(?i)\b(no\.?\s*1\s+[a-zA-Z]{3,20}|best\s+(?:in|for)\s+[a-zA-Z]{3,20})\b"),
    ("MEDICAL", False, False, True, r"(?i)\b(cures?\s+[a-zA-Z]{3,20}|prevents?\s+[a-zA-Z]{3,20}|treats?\s+[a-zA-Z]{3,20})\b"),
)
FLAGS = ("is_absolute", "is_comparative", "is_high_risk")
#: Reading confidence of a claim found in plain text, and of an ingredient list whose words carry none.
TEXT_CONFIDENCE, LIST_CONFIDENCE = 90.0, 85.0
#: Open claims are numbered after those of the rules.
OPEN_ORD = 1_000_000


def claim_rules(spark) -> DataFrame:
    rows = [(*r[:4], list(r[4]), list(r[5]), r[0] in ABSOLUTE_RULES, r[0] in COMPARATIVE_RULES, r[0] in HIGH_RISK_RULES, i) for i, r in enumerate(CLAIM_RULES)]
    return spark.createDataFrame(rows, "rule_id string, claim_type string, category string, risk_level string, patterns array<string>, contradictions array<string>, is_absolute boolean, is_comparative boolean, is_high_risk boolean, ord int")


def read_claim_rules(spark, path: str) -> DataFrame:
    """Claim rules of a folder of JSON arrays: enabled ones, the last file by name winning for a rule id."""
    schema = "rule_id string, claim_type string, category string, risk_level string, enabled boolean, patterns array<string>, contradiction_ingredients array<string>, is_absolute boolean, is_comparative boolean, is_high_risk boolean"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("file")))).filter("rn = 1 AND coalesce(enabled, true)")
    empty = F.array().cast("array<string>")
    n = F.row_number().over(W.orderBy("file", "rule_id")) - 1  # a few dozen rules
    lists = (F.coalesce("patterns", empty).alias("patterns"), F.coalesce("contradiction_ingredients", empty).alias("contradictions"))
    return last.select("rule_id", "claim_type", "category", "risk_level", *lists, *(F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS), n.alias("ord"))


def _word(p: Column) -> Column:
    """A regular expression for a literal with a word border, or the text's end, on both sides."""
    return F.concat(F.lit(r"(?U)(?:\b|^)"), F.regexp_replace(p, r"(?U)([^\w\s])", r"\\$1"), F.lit(r"(?:\b|$)"))


def _norm(p: Column) -> Column:
    return F.lower(F.trim(p))


#: Runs of letters, digits and underscores of any script, and the same for texts of ASCII, where the classes of Unicode only take time.
RUN, ASCII_RUN = r"(?U)(\w+)", r"(\w+)"


def _runs(text: Column) -> Column:
    every = lambda run: F.regexp_extract_all(text, F.lit(run), F.lit(1))
    return F.array_distinct(F.when(F.octet_length(text) == F.length(text), every(ASCII_RUN)).otherwise(every(RUN)))


def _keys(texts: DataFrame) -> list[str]:
    """label_id and what else tells texts apart, such as a panel."""
    return [c for c in texts.columns if c != "text"]


def find_claims(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Claims per text and rule: the first pattern of the rule that the text has, in lower case, with the rule's flags. texts: label_id, text, and a panel or other columns that a label's texts are told apart by.

    Patterns and texts are compared without regard to case. A pattern meets the texts that have its
    first run of letters and digits, which the borders make a whole one of the text, so any number of
    rules is one join; patterns of signs alone are tried on every text.
    """
    own = _keys(texts)
    some = texts.select(*own, F.lower("text").alias("low"))
    has = F.col("low").contains(F.col("pattern")) & F.rlike("low", _word(F.col("pattern")))
    keep = ("rule_id", "claim_type", "category", "risk_level", *FLAGS, "ord")
    patterns = _flagged(rules).select(*keep, F.posexplode("patterns").alias("p_ord", "pattern")).withColumn("pattern", _norm(F.col("pattern"))).filter("pattern <> ''")
    patterns = patterns.withColumn("run", F.regexp_extract("pattern", RUN, 1))
    runs = some.select(*own, "low", F.explode(_runs(F.col("low"))).alias("run"))
    hits = runs.join(small(patterns.filter("run <> ''")), "run").filter(has).drop("run")
    signs = patterns.filter("run = ''").drop("run")
    if not signs.isEmpty():
        hits = hits.unionByName(some.join(small(signs), has))
    found = hits.groupBy(*own, *keep).agg(F.min_by("pattern", "p_ord").alias("claim"))
    return found.select(*own, "rule_id", "claim_type", "category", "risk_level", "ord", "claim", *FLAGS)


def _flagged(rules: DataFrame) -> DataFrame:
    """Rules with the three flags, false where the table has none."""
    return rules.withColumns({f: F.coalesce(f, F.lit(False)) if f in rules.columns else F.lit(False) for f in FLAGS})


def open_claims(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Claims by the open grammars that no rule's pattern holds or is held by; a claim once, at its first place.

    Columns as find_claims gives them; ord follows grammar and place.
    """
    def found(at: int, category: str, flags: tuple[bool, ...], pattern: str) -> Column:
        once = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.lower(F.trim(x))))
        fixed = [F.lit(category).alias("category"), *(F.lit(v).alias(n) for n, v in zip(FLAGS, flags, strict=True))]
        return F.transform(once, lambda x, i: F.struct(*fixed, (F.lit(OPEN_ORD * (at + 1)) + i).alias("ord"), x.alias("claim")))

    every = F.concat(*(found(k, category, tuple(flags), pattern) for k, (category, *flags, pattern) in enumerate(OPEN)))
    own = _keys(texts)
    rows = texts.select(*own, F.explode(every).alias("c")).select(*own, "c.*")
    p = small(rules.select(F.explode(F.transform("patterns", _norm)).alias("p")).filter("p <> ''"))
    left = rows.join(p, F.col("claim").contains(F.col("p")) | F.col("p").contains(F.col("claim")), "left_anti")
    none = F.lit(None).cast("string")
    return left.select(*own, none.alias("rule_id"), none.alias("claim_type"), "category", none.alias("risk_level"), "ord", "claim", *FLAGS)


def deduplicated(claims: DataFrame) -> DataFrame:
    """The first of equal claims of a label by panel and rule order. claims: with panel."""
    key, rest = F.lower(F.trim("claim")).alias("__claim"), [c for c in claims.columns if c != "label_id"]
    first = claims.groupBy("label_id", key).agg(F.min_by(F.struct(*rest), F.struct("panel", "ord")).alias("c"))
    return first.select("label_id", *(F.col(f"c.{c}").alias(c) for c in rest)).select(*claims.columns)


def numbered(claims: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("label_id").orderBy("ord", "claim"))
    return claims.withColumn("claim_id", F.concat(F.lit("CLM-"), F.lpad(n.cast("string"), 3, "0")))


def matching_rule(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule in order with a pattern that holds the claim or is held by it. claims: key columns and claim."""
    p = small(rules.select("rule_id", "ord", F.explode(F.transform("patterns", _norm)).alias("pattern")).filter("pattern <> ''"))
    keys = claims.columns
    j = claims.join(p, F.lower("claim").contains(F.col("pattern")) | F.col("pattern").contains(F.lower("claim")))
    return j.groupBy(*keys).agg(F.min_by("rule_id", "ord").alias("rule_id"))


def _hits(bad: Column, ingredients: Column) -> Column:
    """Those of an array of words that stand in an ingredient list, in their order; null if none."""
    low = F.lower(F.coalesce(ingredients, F.lit("")))
    found = F.filter(bad, lambda b: low.contains(_norm(b)) & F.rlike(low, _word(_norm(b))))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def contradictions(claims: DataFrame, rules: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Ingredients of a label that contradict a claim's rule, in the rule's order. ingredients: label_id, ingredients."""
    c = claims.select("label_id", "rule_id").join(small(rules.select("rule_id", "contradictions").filter("size(contradictions) > 0")), "rule_id")
    return c.join(ingredients, "label_id").select("label_id", "rule_id", _hits(F.col("contradictions"), F.col("ingredients")).alias("hits")).filter("hits IS NOT NULL")


def _out(status: str, why: str, evidence: Column | float | None = None) -> Column:
    """evidence: confidence of the evidence; 0 for evidence that carries none, null without evidence."""
    e = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return F.struct(F.lit(status).alias("status"), F.lit(why).alias("why"), e.cast("double").alias("evidence"))


def _no_list() -> Column:
    return F.coalesce(F.trim("ingredients"), F.lit("")) == ""


def _low() -> Column:
    return F.lower(F.coalesce("text", F.lit("")))


def _contradicted() -> Column:
    return _out("POTENTIAL_CONTRADICTION", "An ingredient contradicts the claim", F.col("ingredients_confidence"))


def _no_preservatives() -> Column:
    none = _no_list() & ~_low().contains("preservative")
    return F.when(none, _out("INSUFFICIENT_EVIDENCE", "No ingredients", 0)).when(F.col("hits").isNotNull(), _contradicted()).otherwise(_out("SUPPORTED", "Evidence agrees", F.col("ingredients_confidence")))


def _by_fact(value: Callable[[], Column], what: str, least: float | None = None, most: float | None = None, evidence: tuple[float | None, float, float] = (None, 0, 0)) -> Callable[[], Column]:
    """evidence: confidences where the value is missing, agrees and contradicts."""

    def build() -> Column:
        v = value()
        ok = (v >= least) if least is not None else (v <= most)
        missing, agrees, against = evidence
        return (
            F.when(v.isNull(), _out("INSUFFICIENT_EVIDENCE", f"No value of {what}", missing))
            .when(ok, _out("SUPPORTED", f"The value of {what} agrees", agrees))
            .otherwise(_out("POTENTIAL_CONTRADICTION", f"The value of {what} contradicts the claim", against))
        )

    return build


def _fact(*names: str) -> Column:
    return F.coalesce(*(F.try_element_at("facts", F.lit(n)) for n in names))


def _protein() -> Column:
    """The declared value, else the first number after the word in the text."""
    return F.coalesce(_fact("protein"), F.regexp_extract(F.regexp_extract(_low(), r"protein[\s.:\-a-z]*([\d.]+)", 1), r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def _sugar() -> Column:
    v, free = _fact("sugar"), F.col("claim_type") == "SUGAR_FREE"
    return (
        F.when(F.col("hits").isNotNull(), _contradicted())
        .when(free & (v > 0.5), _out("POTENTIAL_CONTRADICTION", "The value of sugar contradicts the claim", 0))
        .when(free & v.isNotNull(), _out("SUPPORTED", "The value of sugar agrees", 0))
        .when(_no_list() & (F.coalesce(F.size("facts"), F.lit(0)) <= 0), _out("INSUFFICIENT_EVIDENCE", "No ingredients and no facts", 0))
        .otherwise(_out("SUPPORTED", "Evidence agrees", 0))
    )


def _natural() -> Column:
    return F.when(_no_list(), _out("INSUFFICIENT_EVIDENCE", "No ingredients", 0)).when(F.col("hits").isNotNull(), _contradicted()).otherwise(_out("HIGH_RISK_REVIEW", "No contradiction, but the claim is absolute", 0))


def _no_colours() -> Column:
    return F.when(_no_list(), _out("INSUFFICIENT_EVIDENCE", "No ingredients")).when(F.col("hits").isNotNull(), _contradicted()).otherwise(_out("SUPPORTED", "Evidence agrees", 0))


def _origin() -> Column:
    in_text = _low().contains("made in india") | _low().contains("product of india") | _low().contains("country of origin: india")
    o = F.coalesce(F.nullif(F.lower("country_of_origin"), F.lit("")), F.when(in_text, "india"))
    return F.when(o.isNull(), _out("INSUFFICIENT_EVIDENCE", "No origin declared")).when(o.contains("india"), _out("SUPPORTED", "Evidence agrees", 0)).otherwise(_out("POTENTIAL_CONTRADICTION", "Another origin is declared", 0))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _organic() -> Column:
    return F.when(_any_of(_low(), MARKINGS), _out("SUPPORTED", "A certification mark was seen", 0)).otherwise(_out("INSUFFICIENT_EVIDENCE", "No certification mark", 0))


def _immunity() -> Column:
    return F.when(_any_of(_low(), IMMUNITY_NUTRIENTS), _out("HIGH_RISK_REVIEW", "Health claim with nutrients that may support it", 0)).otherwise(_out("HIGH_RISK_REVIEW", "Health claim without supporting nutrients", 0))


def _pure() -> Column:
    several = _any_of(F.lower(F.coalesce("ingredients", F.lit(""))), (",", ";", "added"))
    return F.when(several, _out("POTENTIAL_CONTRADICTION", "Several ingredients", F.col("ingredients_confidence"))).when(_no_list(), _out("INSUFFICIENT_EVIDENCE", "No ingredients")).otherwise(_out("SUPPORTED", "One ingredient", 0))


def _review(why: str) -> Callable[[], Column]:
    return lambda: _out("HIGH_RISK_REVIEW", why, F.col("ocr_confidence"))


#: Evaluator of each claim type; a user adds one.
EVALUATORS: dict[str, Callable[[], Column]] = {
    "NO_PRESERVATIVES": _no_preservatives,
    "NO_ADDED_SUGAR": _sugar,
    "SUGAR_FREE": _sugar,
    "HIGH_PROTEIN": _by_fact(_protein, "protein", least=12, evidence=(0, 92, 90)),
    "LOW_FAT": _by_fact(lambda: _fact("total_fat", "fat"), "fat", most=3),
    "ZERO_CHOLESTEROL": _by_fact(lambda: _fact("cholesterol"), "cholesterol", most=5),
    "NATURAL_QUALITY": _natural,
    "NO_ARTIFICIAL_COLOURS": _no_colours,
    "CHEMICAL_FREE": _review("Everything is chemical"),
    "MADE_IN_INDIA": _origin,
    "ORGANIC_CERTIFICATION": _organic,
    "IMMUNITY_BOOSTER": _immunity,
    "100_PERCENT_PURE": _pure,
}
#: Evaluators of categories, for types without one.
BY_CATEGORY = {"MEDICAL": _review("Medical claim"), "COMPARATIVE": _review("Comparative claim"), "ENVIRONMENTAL": _review("Environmental claim")}


def flags(claim: Column) -> dict[str, Column]:
    """What its rule and, for claims of a rule, its own words make a claim. Columns FLAGS and rule_id."""
    own = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(claim).contains(w))
    return {f: F.col(f) | (F.col("rule_id").isNotNull() & own(words)) for f, words in zip(FLAGS, (ABSOLUTE, COMPARATIVE, HIGH_RISK), strict=True)}


def assess(claims: DataFrame, rules: DataFrame, labels: DataFrame) -> DataFrame:
    """Status, reason, contradicting ingredients and confidence of each claim.

    claims: as find_claims gives them; ocr_confidence and has_box where their words
    are known. labels: label_id, text, ingredients, facts map, country_of_origin, and
    ingredients_confidence where known.
    """
    known = lambda c, d, default: F.coalesce(F.col(c), F.lit(default)) if c in d.columns else F.lit(default)
    bad = small(rules.select("rule_id", "contradictions"))
    j = claims.withColumns(flags(F.col("claim"))).withColumns({"ocr_confidence": known("ocr_confidence", claims, TEXT_CONFIDENCE), "has_box": known("has_box", claims, False)})
    j = j.join(bad, "rule_id", "left").join(labels.withColumn("ingredients_confidence", known("ingredients_confidence", labels, LIST_CONFIDENCE)), "label_id", "left")
    j = j.withColumn("hits", _hits(F.coalesce("contradictions", F.array().cast("array<string>")), F.col("ingredients")))
    out = None
    for cond, build in [*((F.col("claim_type") == k, b) for k, b in EVALUATORS.items()), *((F.col("category") == k, b) for k, b in BY_CATEGORY.items())]:
        out = F.when(cond, build()) if out is None else out.when(cond, build())
    out = out.when(F.col("is_high_risk"), _out("HIGH_RISK_REVIEW", "Claim of high risk")).when(F.col("is_absolute"), _out("HIGH_RISK_REVIEW", "Absolute claim"))
    j = j.withColumn("a", out.otherwise(_out("NOT_ASSESSABLE", "No evidence rule")))
    keep = [c for c in claims.columns if c not in FLAGS]
    return j.select(*keep, F.col("a.status").alias("status"), F.col("a.why").alias("why"), "hits", *FLAGS, confidence().alias("confidence"))


def confidence() -> Column:
    """A claim's confidence from what was read, extracted, found as evidence and judged. Columns a, ocr_confidence, has_box."""
    s, e, ocr = F.col("a.status"), F.col("a.evidence"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("ocr_confidence")))
    extracted = F.when(ocr < 70, ocr).when(F.col("has_box"), 95.0).otherwise(85.0)
    evidence = F.when(e > 0, e).when(e.isNotNull(), 85.0).when(s == "INSUFFICIENT_EVIDENCE", 60.0).otherwise(75.0)
    judged = F.when(s == "POTENTIAL_CONTRADICTION", 92.0).when(s == "SUPPORTED", 90.0).when(s == "HIGH_RISK_REVIEW", 85.0).when(s == "INSUFFICIENT_EVIDENCE", 80.0).otherwise(65.0)
    return F.greatest(F.lit(10.0), F.least(F.lit(99.0), F.round(0.25 * ocr + 0.20 * extracted + 0.25 * evidence + 0.30 * judged, 1)))


def claim_job(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Found, deduplicated, numbered and assessed claims of a table of labels (see assess for its columns)."""
    texts = labels.select("label_id", "text")
    every = find_claims(texts, rules).unionByName(open_claims(texts, rules)).withColumn("panel", F.lit(1))
    return assess(numbered(deduplicated(every.repartition("label_id"))).drop("panel"), rules, labels)


def claim_summary(assessments: DataFrame) -> DataFrame:
    s = F.col("status")
    n = lambda v: F.count_if(s == v).alias(v.lower())
    every = ("SUPPORTED", "INSUFFICIENT_EVIDENCE", "POTENTIAL_CONTRADICTION", "HIGH_RISK_REVIEW", "NOT_ASSESSABLE")
    return assessments.groupBy("label_id").agg(F.count("*").alias("claims"), *map(n, every), F.count_if(s != "SUPPORTED").alias("needs_review"))


def findings_with_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with their evidence edges nested, none as an empty list."""
    e = evidence.groupBy("label_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("link_type", "evidence_text"))).alias("evidence"))
    return findings.join(e, ["label_id", "claim_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<link_type:string,evidence_text:string>>")))


def split_findings(assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and evidence edges of assessments, for two tables."""
    edges = assessments.filter("hits IS NOT NULL").select("label_id", "claim_id", F.lit("CONTRADICTS").alias("link_type"), F.explode(F.split("hits", ", ")).alias("evidence_text"))
    return assessments.drop("hits"), edges


def confusion(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Confusion matrix, precision, recall and accuracy. truth: label_id, has_claim; found: label_id of claims."""
    j = truth.join(found.select("label_id", F.lit(True).alias("hit")).distinct(), "label_id", "left").na.fill(False, ["hit"])
    c = lambda a, b: F.count_if((F.col("has_claim") == a) & (F.col("hit") == b))
    g = j.agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return g.select("*", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))
