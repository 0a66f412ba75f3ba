"""Who and what a label names: companies with addresses by role, product name and brand, wherever they stand.

labels: label_id, text. Texts become blocks after role headings, lines and phrases, as rows; each row is tested
and scored by itself and grouped back by label, so nothing but a label's own lines comes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings of the four roles, in the order of precedence of the fallback.
ROLES = {
    "marketed_by": r"(?i)(?:Marketed\s*by|Mktd\.?\s*by|Merkotod\s*Dy|Marketer|विपणक|द्वारा\s*विपणन)",
    "manufacturer": r"(?i)(?:Manufactured\s*by|Mfd\.?\s*by|MFO\s*by|Mfg\s*by|Produced\s*by|Manufacturer|निर्माता|द्वारा\s*निर्मित)",
    "packer": r"(?i)(?:Packed\s*by|Pkd\.?\s*by|Packer|पैकर)",
    "importer": r"(?i)(?:Imported\s*by|Imp\.?\s*by|Importer|आयातकर्ता)",
}
#: Characters of a block after a heading, and what ends it at the start of a line.
BLOCK = 300
ENDS = r"(?i)\n\s*(?:NUTRITION|NUTRITIONAL|STORA[GO]E|DIRECTIONS|COOK|RECIPE|ALLERGEN|ALLERSEN|BATCH|BEST\s*BEFORE|EXP|MRP|UNIT\s*SALE|LIC\s*NO|FSSAI|SCAN|FOR\s*FEEDBACK|FEEDBACK|MANUFACTUR|PACKED|PKD\b|MARKETED|MKTD\b|IMPORTED)"
#: A company by its ending, words of lines that name none, words of addresses, and what an address ends with.
COMPANY = r"(?i)\b([A-Z0-9][A-Za-z0-9\s,\.\-\&]{2,45}?(?:PVT[.,\s]*LTD\.?|PRIVATE\s*LIMITED|PYT[.,\s]*LT\.?|PTO[.,\s]*LTD\.?|PVT\.?|LTD\.?|LIMITED|PTO\.?|LLP|HEALTH\s*FO+DS?(?:\s*(?:PVT|PTO|PYT)[.,\s]*(?:LTD|PTO)\.?)?|FO+DS?(?:\s*(?:PVT|PTO|PYT)[.,\s]*(?:LTD|PTO)\.?)?|ALPINO[A-Za-z0-9\s,\.\-\&]*|SNACKS|BEVERAGES|AGRO|INDUSTRIES|ENTERPRISES|BAKERS))\b"
NO_ENTITY = r"(?i)(?:fat|protein|transfat|cholesterol|sugar|energy|kcal|saturated|sodium|carb|nutrients|open|damaged|contact|2409|los|\d+mg|\d+g|\d+%|transfer|tranfer|airtight|container|storage|store|cool|dry|infestation|moisture|hygiene|consume|frocuct|intoa)"
PLACES = r"UNILEVER\s*HOUSE|HOUSE|BUNGALOW|NGALOW|PLOT|FLAT|BUILDING|ESTATE|SURVEY|VILLAGE|ROAD|STREET|MARG|NAGAR|PHASE|SECTOR|INDUSTRIAL\s*AREA|NEAR"
STATES = r"MAHARASHTRA|GUJARAT|PUNJAB|DELHI|HARYANA|BIHAR|KARNATAKA|TAMIL\s*NADU|RAJASTHAN|KERALA|UP|MP|AP|INDIA"
ADDRESS_LINE = rf"(?i)(?:{PLACES}|SURAT|GUJARAT|PUNJAB|DELHI|HARYANA|BIHAR|KARNATAKA|TAMIL\s*NADU|RAJASTHAN|KERALA|UP|MP|AP|INDIA|\b\d{{6}}\b)"
ADDRESS = rf"(?i)((?:{PLACES})[A-Za-z0-9\s,\.\-\&\/\(\)]{{5,220}}?(?:\b\d{{6}}\b(?:\s*,\s*[A-Z]+)?|\b(?:{STATES})\b|\b\d{{6}}\b))"
NO_ADDRESS = r"(?i)fat|protein|cholesterol|sodium|socup|totalfat|transfat|sugars"
COMPANY_LEAD = r"(?i)^(?:FOR|THE|ADDRESS|CHECK|BY|OF|AND|NEAR|OPP|(?U:\W)+)+\s*"
COMPANY_CUT = r"(?i)(?:UNILEVER\s*HOUSE|BUNGALOW|PLOT|FLAT|BUILDING|ESTATE|SURVEY|VILLAGE|ROAD|STREET|MARG|NAGAR|PHASE|SECTOR|NEAR|OPP|NO\.\s*\d+)"
COMPANY_WORDS = r"(?i)ltd|limited|pvt|llp|foods|industries|enterprises|snacks|agro|care"
SCORED_WORDS = r"(?i)pvt|ltd|limited|llp|foods|industries|enterprises|snacks|care"
SCORED_PLACES = r"(?i)\b(?:gujarat|maharashtra|delhi|haryana|punjab|surat|mumbai|noida|bangalore|india)\b"


def _trimmed(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def company_name(raw: Column) -> Column:
    """A company without the words before it, and without an address written on the same line."""
    c = F.trim(F.regexp_replace(raw, COMPANY_LEAD, ""))
    parts = F.transform(F.split(c, COMPANY_CUT), lambda p: _trimmed(F.trim(p), r",.:\- "))
    last = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(parts, lambda p: p.rlike(COMPANY_WORDS))), -1)
    return F.trim(_trimmed(F.when(F.size(parts) > 1, F.coalesce(last, c)).otherwise(c), r",\s.:\-"))


def entity_score(company: Column, address: Column) -> Column:
    named = 30.0 + F.least(F.length(company), F.lit(30)) + F.when(company.rlike(SCORED_WORDS), 20).otherwise(0)
    placed = 20.0 + F.least(F.length(address), F.lit(40)) + F.when(address.rlike(r"\b\d{6}\b"), 30).otherwise(0) + F.when(address.rlike(SCORED_PLACES), 20).otherwise(0)
    return F.coalesce(named, F.lit(0.0)) + F.coalesce(placed, F.lit(0.0))


def role_blocks(labels: DataFrame) -> DataFrame:
    """label_id, role, at (place of the block in the text) and block: BLOCK characters after each heading, up to what ends it."""
    out = []
    for role, heading in ROLES.items():
        cut, heads = F.split("text", heading), F.regexp_extract_all("text", F.lit(heading), F.lit(0))
        upto = lambda k: F.aggregate(F.slice("lengths", 1, k + 1), F.lit(0), lambda a, n: a + n)
        lengths = F.zip_with(F.slice(cut, 1, F.size(heads)), heads, lambda a, b: F.length(a) + F.length(b))
        at = labels.filter(F.col("text").rlike(heading)).select("label_id", "text", lengths.alias("lengths"))
        places = at.select("label_id", "text", F.explode(F.transform("lengths", lambda n, k: upto(k))).alias("at"))
        out.append(places.select("label_id", F.lit(role).alias("role"), "at", F.trim(F.split(F.expr(f"substring(text, at + 1, {BLOCK})"), ENDS, 2)[0]).alias("block")))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_


def entities(labels: DataFrame) -> DataFrame:
    """label_id, role, company and address: the best block of each role, and for labels without any what their whole text has."""
    lines = role_blocks(labels).select("label_id", "role", "at", F.posexplode(F.split("block", "\n")).alias("n", "line")).withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").rlike(NO_ENTITY))
    # The pattern of companies is the dearest, so its match is a column that the next ones read.
    lines = lines.withColumn("m", F.regexp_extract("line", COMPANY, 0))
    lines = lines.withColumn("raw", F.when(F.col("m") != "", F.regexp_extract("m", COMPANY, 1)))
    rest = F.expr("substring(line, position(m, line) + length(m))")
    lines = lines.select("*", company_name(F.col("raw")).alias("c"), F.when(F.col("raw").isNotNull(), _trimmed(F.trim(rest), r",.:\- ")).alias("rest"))
    clean = F.trim(F.regexp_replace("line", r"(?U)^[^\w]+|[^\w\)]+$", ""))
    lines = lines.select("label_id", "role", "at", "n", F.when(F.length("c") >= 4, F.col("c")).alias("c"), F.when(F.length("rest") >= 4, F.col("rest")).alias("rest"), F.when(F.col("line").rlike(ADDRESS_LINE) & (F.length(clean) >= 4) & ~clean.rlike(NO_ADDRESS), clean).alias("place"))
    blocks = lines.groupBy("label_id", "role", "at").agg(F.sort_array(F.collect_list(F.struct("n", "c", "rest", "place"))).alias("l"), F.min_by("c", F.when(F.col("c").isNotNull(), F.col("n"))).alias("company"), F.min(F.when(F.col("c").isNotNull(), F.col("n"))).alias("own"))
    parts = F.array_compact(F.transform("l", lambda x: F.when(x["n"].eqNullSafe(F.col("own")), x["rest"]).otherwise(x["place"])))
    blocks = blocks.select("label_id", "role", "at", "company", F.when(F.size(parts) > 0, F.array_join(parts, ", ")).alias("address")).filter("company IS NOT NULL OR address IS NOT NULL")
    best = blocks.groupBy("label_id", "role").agg(F.max_by(F.struct("company", "address"), F.struct(entity_score(F.col("company"), F.col("address")), -F.col("at"))).alias("e"))
    wide = best.groupBy("label_id").pivot("role", list(ROLES)).agg(F.first("e"))
    j = labels.join(wide, "label_id", "left")
    three = ("marketed_by", "manufacturer", "packer")
    missing = lambda f: F.coalesce(*(F.col(r)[f] for r in three)).isNull()
    j = j.withColumn("raw", F.when(missing("company"), F.nullif(F.regexp_extract("text", COMPANY, 1), F.lit("")))).withColumn("spot", F.when(missing("address"), F.trim(F.nullif(F.regexp_extract("text", ADDRESS, 1), F.lit("")))))
    j = j.withColumn("whole", company_name(F.col("raw")))
    spot = F.when(F.upper("spot").startswith("NGALOW"), F.concat(F.lit("BU"), "spot")).otherwise(F.col("spot"))
    j = j.select("label_id", *ROLES, F.col("text").rlike(ROLES["marketed_by"]).alias("market"), F.when(F.length("whole") >= 4, F.col("whole")).alias("any_company"), spot.alias("any_address"))
    sold = F.col("market") | F.col("marketed_by.company").isNotNull()
    company = lambda r, here: F.coalesce(F.col(r)["company"], F.when(here, F.col("any_company")))
    address = lambda r, here: F.coalesce(F.col(r)["address"], F.when(here, F.col("any_address")))
    rows = [F.struct(F.lit(r).alias("role"), company(r, here).alias("company"), address(r, there).alias("address")) for r, here, there in (("marketed_by", F.col("market"), sold), ("manufacturer", ~F.col("market"), ~sold), ("packer", F.lit(False), F.lit(False)), ("importer", F.lit(False), F.lit(False)))]
    return j.select("label_id", F.inline(F.array(*rows))).filter("company IS NOT NULL")


#: Words that make a phrase no product name.
NO_NAME = (
    "recipe", "serving", "serve", "cook", "cooking", "directions", "preparation", "storage", "store in", "keep in", "enjoy", "try our", "available in", "full of", "thodi", "jaye", "chale", "breathe", "food safety", "exciting", "fun!",
    "making health", "health fun", "keep freshness", "freshness locked", "no artificial", "colours", "flavours", "with 100%", "from the farmer", "since 19", "since 20", "per serve", "of rda", "finest potatoes", "scan here", "imitation of",
    "boil", "fry", "bake", "roast", "mix well", "blend", "add", "heat", "pour", "garnish", "step", "method", "instruction", "instructions", "caution", "warning", "handling", "dispose", "dustbin", "green dot", "re-order",
    "ingredients", "nutrition", "nutritional", "energy", "carbohydrate", "fat", "mfg", "mfd", "mfo", "exp", "mrp", "batch", "net wt", "net weight", "net qty", "fssai", "lic", "licence", "license", "marketed", "merkotod", "mktd", "manufactured",
    "consumer care", "customer care", "feedback", "call us", "email us", "best before", "date of", "country of", "product of", "made in", "unit sale price", "usp", "inclusive of all taxes", "sector-", "pvt ltd", "pvt. ltd", "limited",
    "nagar", "road", "street", "floor", "park", "delhi", "mumbai", "noida", "gujarat", "india", "pin:", "tel:", "phone:", "complex", "phase", "plot", "lane", "p.o.", "dist", "district", "state", "village", "industrial", "area", "tehsil", "taluk", "estate",
    "sugar", "refined", "jaggery", "making", "health", "fun", "locked", "freshness", "athletes", "gym", "goers", "enthusiasts", "sport", "athetescym", "no", "zero", "free",
)
#: Commodities that a name is told by.
COMMODITIES = (
    "oats", "super oats", "rolled oats", "porridge", "cereal", "muesli", "granola", "cornflakes", "chips", "potato chips", "crisps", "namkeen", "snack", "snacks", "savoury", "savouries", "bhujia", "dal", "mixture", "noodles", "pasta", "sauce",
    "ketchup", "tomato ketchup", "puree", "paste", "juice", "drink", "beverage", "tea", "coffee", "biscuit", "biscuits", "cookie", "cookies", "rusk", "wafer", "cake", "bread", "flour", "atta", "rice", "oil", "ghee", "butter", "peanut butter",
    "spread", "chocolate", "chocolates", "sweet", "sweets", "extruded snack", "ready to eat", "tango", "masala", "chatpata",
)
#: Headings after which lines are passed over, and how many; claims that speak against a name, products that speak for it, names too short without a brand.
SKIPS = ((r"\b(?:recipe|directions|preparation|cooking|serving|instructions?)\b", 5), (r"\b(?:ingredients?|samagri)\b", 8), (r"\b(?:nutritional\s*info|nutrition\s*facts|per\s*serve|per\s*100g)\b", 10))
ORIGIN_CLAIM = r"\b(?:\d+%\s*)?(?:australian|american|california|indian|imported|authentic|pure|100%|organic|natural)\b"
MARKETING_CLAIM = r"\b(?:making\s*health|health\s*fun|keep\s*freshness|freshness\s*locked|for\s*athletes|gym\s*goers|sport\s*enthusiasts|taste\s*the\s*goodness)\b"
NUTRITION_CLAIM = r"\b(?:\d+g?\s*protein|per\s*100g|no\s*refined\s*sugar|refined\s*sugar|sugar\s*jaggery|\d+%\s*whole\s*grain|nuts\s*&\s*seeds)\b"
NUTRITION_NAME = r"\b(?:high\s*protein\s*(?:oats|snack|cookie|bar|cereal))\b"
KNOWN_NAME = r"\b(?:high\s*protein\s*(?:oats|cereal|muesli|cookie|biscuit)|tomato\s*ketchup|rolled\s*oats|super\s*oats|instant\s*noodles|basmati\s*rice|peanut\s*butter)\b"
SHORT_NAMES = ("tea", "juice", "snack", "noodles", "chips", "rice", "oil", "flour", "atta", "biscuit", "cookies")
LEAST_SCORE = 35.0
#: A brand by its trademark statement, by its owner, by a handle or a web address, and where a company's own part ends.
TRADEMARK, NO_TRADEMARK = r"(?i)(?:^|[\s.:;,])([A-Za-z0-9&'\-]{2,30})\s+IS\s+A\s+REGISTERED\s+TRADEMARK", ("this", "the", "imitation", "offence", "all", "product", "item")
TRADEMARK_OF = r"(?i)(?:trade\s*mark|regd\.?\s*tm|tm)\s+of\s+([A-Za-z0-9\s.,&'\-]{2,30})"
HANDLE, HANDLE_END = r"@([a-zA-Z0-9_]{3,20})", r"(?i)(?:healthfoods|foods|snacks|official|india|care|store)$"
SITE = r"(?i)www\.([a-zA-Z0-9\-]{3,20})\.(?:com|in|co\.in|store|org|net)"
COMPANY_OWN = r"(?i)\b(?:Pvt|Ltd|Limited|LLP|Industries|Holdings|Enterprises|Foods|Snacks|Products|India)\b"


def title(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1_000_000)))), "")


def phrases(labels: DataFrame) -> DataFrame:
    """label_id, idx and phrase: lines that could be names, and two or three short ones together among the first fifteen.

    A heading of a recipe, ingredients or nutrition passes over the lines after it; the first kind also inside the others, which wait for its end.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: (x != "") & ~x.rlike(r"^(?:===|---|\*\*\*|###)"))
    kind = F.transform("lines", lambda x: F.array(*(F.lower(x).rlike(p) for p, _ in SKIPS)))

    def step(s: Column, k: Column) -> Column:
        (_, r), (_, i), (_, n) = SKIPS
        what = (
            F.when(k[0], 0).when(s["r"] > 0, 1).when(k[1], 2).when(s["i"] > 0, 3).when(k[2], 4).when(s["n"] > 0, 5).otherwise(6)
        )
        return F.get(F.transform(F.array(what), lambda w: F.struct(
            F.when(w == 0, r).when(w == 1, s["r"] - 1).otherwise(s["r"]).alias("r"), F.when(w == 2, i).when(w == 3, s["i"] - 1).otherwise(s["i"]).alias("i"),
            F.when(w == 4, n).when(w == 5, s["n"] - 1).otherwise(s["n"]).alias("n"), F.concat(s["keep"], F.array(w == 6)).alias("keep"))), F.lit(0))

    begin = F.struct(F.lit(0).alias("r"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("keep"))
    kept = labels.select("label_id", lines.alias("lines")).select("*", F.aggregate(kind, begin, step, lambda s: s["keep"]).alias("keep"))
    short = lambda x: F.coalesce(F.size(F.split(x, r"\s+")) <= 2, F.lit(False))
    at = lambda k: F.get("lines", k)

    def made(keep: Column, k: Column) -> Column:
        two = keep & (k < 15) & short(at(k)) & short(at(k + 1))
        row = lambda p: F.struct(k.alias("idx"), p.alias("phrase"))
        return F.array(F.when(keep, row(at(k))), F.when(two, row(F.concat_ws(" ", at(k), at(k + 1)))), F.when(two & short(at(k + 2)), row(F.concat_ws(" ", at(k), at(k + 1), at(k + 2)))))

    return kept.select("label_id", F.explode(F.array_compact(F.flatten(F.transform("keep", made)))).alias("__p")).select("label_id", "__p.*")


def tall_words(words: DataFrame) -> DataFrame:
    """label_id, idx (0) and phrase: large words of the front, and up to four of them below each other. words: of front panels."""
    from pyspark.sql import Window as W

    some = words.filter((F.col("h") >= 22) & (F.col("confidence") >= 65)).select("label_id", "x", "y", "w", "h", F.trim(F.regexp_replace("word", r"(?U)^[^\w]+|[^\w']+$", "")).alias("t"))
    some = some.filter((F.length("t") >= 2) & ~F.lower("t").isin(*NO_NAME) & ~F.col("t").rlike(r"^\d+%?$"))
    w = W.partitionBy("label_id").orderBy("y", "x", "t")
    near = some.select("label_id", "y", "x", "h", "t", F.collect_list(F.struct("t", "x", "y", "h")).over(w.rowsBetween(0, 3)).alias("g"))
    close = lambda a, b: (b["y"] - a["y"] - a["h"] >= -15) & (b["y"] - a["y"] - a["h"] <= F.greatest(F.col("h"), F.lit(40))) & (F.abs(a["x"] - b["x"]) <= 80)
    g = lambda k: F.get("g", F.lit(k))
    out, fine = [F.col("t")], F.lit(True)
    for k in range(1, 4):
        fine = fine & F.coalesce(close(g(k - 1), g(k)), F.lit(False))
        out.append(F.when(fine, F.array_join(F.transform(F.slice("g", 1, k + 1), lambda v: v["t"]), " ")))
    return near.select("label_id", F.lit(0).alias("idx"), F.explode(F.array_compact(F.array(*out))).alias("phrase"))


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def name_score(phrase: Column, idx: Column) -> Column:
    """Points of a phrase as a product name, null if it can't be one."""
    low, size = F.lower(phrase), F.size(F.split(F.trim(phrase), r"\s+"))
    letters = F.length(F.regexp_replace(phrase, r"[^\p{L}]", ""))
    no = low.rlike(r"^[+\-*•\d.)]") | low.rlike(r"\b(?:pvt|ltd|limited|llp|inc|corp)\b") | phrase.contains(",") | (size > 6) | (letters < 4) | ~F.length(phrase).between(4, 60) | _holds(low, NO_NAME)
    goods = F.aggregate(F.array(*map(F.lit, COMMODITIES)), F.lit(0.0), lambda a, k: a + F.when(low.contains(k), 45.0).when(F.replace(low, F.lit(" "), F.lit("")).contains(F.replace(k, F.lit(" "), F.lit(""))), 30.0).otherwise(0.0))
    score = (
        F.when(low.rlike(ORIGIN_CLAIM), -60.0).otherwise(0.0)
        + F.when(low.rlike(MARKETING_CLAIM), -60.0).otherwise(0.0)
        + F.when(low.rlike(NUTRITION_CLAIM) & ~low.rlike(NUTRITION_NAME), -50.0).otherwise(0.0)
        + goods
        + F.when(low.rlike(KNOWN_NAME), 50.0).otherwise(0.0)
        + F.when((F.upper(phrase) == phrase) | (title(phrase) == phrase), 15.0).otherwise(0.0)
        + F.when(idx == 0, 35.0).when(idx < 5, 20.0).when(idx < 15, 10.0).otherwise(0.0)
        + F.when(size.between(2, 4), 25.0).when(size == 1, 5.0).otherwise(0.0)
    )
    return F.when(~no, score)


def brands(labels: DataFrame, companies: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """label_id, brand and source of it: trademark statement or owner, a large front word, the company's own part, handle or site, a short line at the top.

    labels may carry front, the front panel's text, for the last; companies: label_id, company; words: of front panels.
    """
    found = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    in_text = lambda c: F.rlike("text", F.concat(F.lit(r"(?iU)\b\Q"), c, F.lit(r"\E\b")))
    j = labels.join(companies.select("label_id", "company"), "label_id", "left")
    if words is not None:
        clean = F.trim(F.regexp_replace("word", r"(?U)^[^\w]+|[^\w']+$", ""))
        top = words.select("label_id", F.struct((-(F.col("w") * F.col("h"))).alias("a"), "line", "pos", "confidence", clean.alias("t")).alias("v")).groupBy("label_id").agg(F.slice(F.sort_array(F.collect_list("v")), 1, 6).alias("large"))
        j = j.join(top, "label_id", "left")
        fits = lambda v: (F.length(v["t"]) >= 3) & (v["confidence"] >= 75) & ~F.lower(v["t"]).isin(*NO_NAME) & ~v["t"].rlike(r"\d") & (F.coalesce(F.rlike("company", F.concat(F.lit(r"(?iU)\b\Q"), F.left(v["t"], F.lit(4)), F.lit(r"\E\b"))), F.lit(False)) | in_text(v["t"]))
        large = title(F.get(F.filter("large", fits), F.lit(0))["t"])
    else:
        large = F.lit(None).cast("string")
    mark = found(TRADEMARK)
    own = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.split("company", COMPANY_OWN, 2)[0]), r"(?U)^[^\w]+|[^\w']+$", "")), r"^[a-zA-Z]\s+", "")
    capital = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 100)))
    handle, site = found(HANDLE), found(SITE)
    cut = F.regexp_replace(handle, HANDLE_END, "")
    sources = {
        "trademark": title(F.when(~F.lower(mark).isin(*NO_TRADEMARK), mark)),
        "owner": title(F.get(F.split(found(TRADEMARK_OF), r"\s+"), F.lit(0))),
        "front word": large,
        "company": title(F.when((F.length(own) >= 3) & (F.size(F.split(own, r"\s+")) <= 2) & in_text(own), own)),
        "handle": F.when(handle.isNotNull(), F.when(F.length(cut) >= 3, capital(cut))).otherwise(capital(site)),
    }
    if "front" in labels.columns:
        lines = F.slice(F.filter(F.transform(F.split("front", "\n"), F.trim), lambda x: x != ""), 1, 5)
        sources["front line"] = title(F.get(F.filter(lines, lambda x: (F.size(F.split(x, r"\s+")) <= 2) & F.length(x).between(3, 25) & ~F.lower(x).isin(*NO_NAME) & ~x.rlike(r"\d")), F.lit(0)))
    tried = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(c.alias("brand"), F.lit(s).alias("source"))) for s, c in sources.items())))
    return j.select("label_id", F.get(tried, F.lit(0)).alias("__b")).filter("__b IS NOT NULL").select("label_id", "__b.*")


def product_names(labels: DataFrame, brand: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """label_id, phrase, product_name, confidence and score: the phrase of most points, the first of equal ones.

    brand: brands, put before a name that is a single common word; words: of front panels.
    """
    found = phrases(labels)
    if words is not None:
        found = found.unionByName(tall_words(words))
    scored = found.withColumn("score", name_score(F.col("phrase"), F.col("idx")))
    order = F.when(F.col("score").isNotNull(), F.struct("score", -F.col("idx"), -F.length("phrase"), "phrase"))
    best = scored.groupBy("label_id").agg(F.max_by(F.struct("phrase", "score"), order).alias("__p")).select("label_id", "__p.*").filter(F.col("score") >= LEAST_SCORE)
    name = F.regexp_replace(title(F.trim(F.regexp_replace("phrase", r"(?U)^[^\w\s]+|[^\w\s)]+$", ""))), r"(?i)\bKetchupo\b", "Ketchup")
    j = best.join(brand.select("label_id", "brand"), "label_id", "left").withColumn("n", name)
    bare = F.lower("n").isin(*SHORT_NAMES) & ~F.contains(F.lower("n"), F.lower("brand"))
    full = F.when(F.coalesce(bare, F.lit(False)), F.concat_ws(" ", "brand", "n")).otherwise(F.col("n"))
    return j.select("label_id", "phrase", full.alias("product_name"), F.least(F.lit(94.0), F.greatest(F.lit(75.0), 70.0 + 0.3 * F.col("score"))).alias("confidence"), "score")
