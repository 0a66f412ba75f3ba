"""Languages of texts by the scripts of their tokens, and declarations by keywords of ten languages.

Tokens of a text are counted where the text lies: one explode, then an aggregate
of fixed width, whose partial sums are one row a text. Keywords are found through
an index of their first letters, so a line meets only keywords that begin in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import columns as C
from labelloom.functions import languages as L
from labelloom.operators.common import by_label, small
from labelloom.operators.extraction import best

#: Languages with their names and scripts.
LANGUAGES = (("en", "English", "Latin"), ("hi", "Hindi", "Devanagari"), ("bn", "Bengali", "Bengali"), ("mr", "Marathi", "Devanagari"), ("gu", "Gujarati", "Gujarati"), ("pa", "Punjabi", "Gurmukhi"), ("ta", "Tamil", "Tamil"), ("te", "Telugu", "Telugu"), ("kn", "Kannada", "Kannada"), ("ml", "Malayalam", "Malayalam"))
#: Code points of each script, as the inside of a character class.
LETTERS = {"Latin": r"A-Za-z\x{00C0}-\x{017F}", "Devanagari": r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}", "Bengali": r"\x{0980}-\x{09FF}", "Gurmukhi": r"\x{0A00}-\x{0A7F}", "Gujarati": r"\x{0A80}-\x{0AFF}", "Tamil": r"\x{0B80}-\x{0BFF}", "Telugu": r"\x{0C00}-\x{0C7F}", "Kannada": r"\x{0C80}-\x{0CFF}", "Malayalam": r"\x{0D00}-\x{0D7F}"}
#: Words that tell Marathi from Hindi, and tokens that belong to no language.
MARATHI = "किंमत किं. वजन घटक उत्पादक नोंदणी पत्ता तक्रार वापर महिने आहे आणि पासून ग्राहकांसाठी तारीख विक्री मर्यादा उत्पादन पॅकिंग सर्व करांसह अधिकतम कस्टमर केअर ईमेल फोन क्रमांक निर्देश".split()
HINDI = "मूल्य कीमत मात्रा सामग्री निर्माता पंजीकरण पता शिकायत उपयोग महीने है और से उपभोक्ता तारीख बिक्री अवधि उत्पादन पैकिंग सभी करों सहित अधिकतम खुदरा वजन सेवा संपर्क संख्या निर्देश".split()
NEUTRAL = r"""(?U)^[\p{Nd}\s.,:;/\-+()\[\]{}#*%$€£¥₹^_=|<>'"`@!?~]+$"""
SPACE = r"(?U)[\s\x1C-\x1F]+"
#: Weights of letters and tokens in a language's confidence, its bounds; least tokens and share of a second language.
BY_LETTERS, BY_TOKENS, LEAST, MOST = 0.6, 0.4, 0.65, 0.99
SECOND, SECOND_SHARE = 2, 0.08
#: Lines of a serving or a year that hold no net quantity, and words that end a section.
SERVING = r"(?i)per\s*serve|serving\s*size|per\s*100\s*g|portion|rda|nutrition|energy|kcal|carb|fat|protein"
NO_QUANTITY = r"(?i)\b(?:19\d\d|20\d\d|kcal|cal)\b"
SECTION_ENDS = r"mrp|mfg|fssai|batch|net wt"
QUANTITY = r"(?i)(\d+(?:\.\d+)?\s*(?:grams|gms|gm|g|kgs|kg|mls|ml|litre|liter|ltr|l|piece|pcs|count|u|n))\b"
PRICE = r"(?i)(?:₹|Rs\.?|INR)\s*(\d+(?:\.\d{1,2})?)"
DATES = ("manufacturing_date", "packaging_date", "expiry_date", "best_before")
SECTIONS = ("ingredients", "nutritional_info", "allergens")
MAKERS = ("manufacturer", "marketed_by")
#: Letters of a keyword that the index is read by, a shorter keyword by all of its own; beginnings up to which a line is searched for these alone.
INDEX, BEGINNINGS = 3, 2_000


def _any_of(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _count(c: Column, script: str) -> Column:
    """Letters of a script; of texts in ASCII only Latin is counted."""
    n = F.length(F.regexp_replace(c, f"[^{LETTERS[script]}]", ""))
    return n if script == "Latin" else F.when(c.rlike(r"[^\x00-\x7F]"), n).otherwise(0)


def _tokens(docs: DataFrame, key: str) -> DataFrame:
    """key, pos, token, a column of letters for each script, and the token's script.

    The script with most letters; of equal ones the one that comes first in the token.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    t = docs.select(key, F.posexplode_outer(words).alias("pos", "token"))
    t = t.select("*", *(_count(F.col("token"), s).alias(f"n_{s}") for s in LETTERS))
    ranks = F.array(*(F.struct(F.col(f"n_{s}").alias("n"), (-F.regexp_instr("token", F.lit(f"[{p}]"))).alias("at"), F.lit(s).alias("script")) for s, p in LETTERS.items()))
    most, total = F.greatest(*(F.col(f"n_{s}") for s in LETTERS)), reduce(lambda a, b: a + b, (F.col(f"n_{s}") for s in LETTERS))
    # Only tokens of several scripts need the places of their letters.
    single = F.coalesce(*(F.when(F.col(f"n_{s}") == total, s) for s in LETTERS))
    script = F.when(F.col("token").rlike(NEUTRAL), "Neutral").when(total == 0, "Unknown").otherwise(F.coalesce(single, F.array_max(F.filter(ranks, lambda r: r["n"] > 0))["script"]))
    return t.withColumns({"script": F.when(F.col("token").isNotNull(), script), "share": F.round(most / F.nullif(total, F.lit(0)), 2)})


def token_languages(docs: DataFrame, key: str) -> DataFrame:
    """key, pos, token, script, language, confidence of every token of the texts, split at white space.

    Numbers and signs are Neutral (language neutral, 1.0); tokens without a letter of a known script Unknown (und, 0.5).
    A Devanagari token is Marathi or Hindi at up to 0.95 if it is a marker of that language alone, else Hindi at up to 0.85.
    Texts without tokens have no rows.
    """
    bare = F.regexp_replace("token", r"[^\x{0900}-\x{097F}]", "")
    mr, hi = bare.isin(*MARATHI), bare.isin(*HINDI)
    sure = mr != hi
    code = F.when(F.col("script") == "Neutral", "neutral").when(F.col("script") == "Unknown", "und").when((F.col("script") == "Devanagari") & mr & ~hi, "mr")
    code = F.coalesce(code, *(F.when(F.col("script") == s, c) for c, _, s in LANGUAGES))
    share = F.col("share")
    confidence = (
        F.when(F.col("script") == "Neutral", 1.0)
        .when(F.col("script") == "Unknown", 0.5)
        .when(F.col("script") == "Latin", F.greatest(F.lit(0.6), share))
        .when(F.col("script") == "Devanagari", F.when(sure, F.least(F.lit(0.95), share)).otherwise(F.least(F.lit(0.85), share * 0.9)))
        .otherwise(share)
    )
    return _tokens(docs, key).filter("token IS NOT NULL").select(key, "pos", "token", "script", code.alias("language"), confidence.alias("confidence"))


def text_languages(docs: DataFrame, key: str) -> DataFrame:
    """One row a key: primary_language, primary_script, confidence, mixed, scripts, and languages by falling tokens.

    languages: array of code, name, script, confidence, tokens; ties by first token, Devanagari last. Its tokens are
    Marathi if more of them hold a marker of Marathi than one of Hindi, else Hindi. mixed: the second language has at
    least two tokens and 8% of all. A text without letters is English at 0.90, an empty or null one at 1.0. Rows that
    share a key count as one text; other columns are left out.
    """
    dev = F.col("script") == "Devanagari"
    aggs = [F.count("token").alias("all")]
    for s in LETTERS:
        here = F.col("script") == s
        aggs += [F.count_if(here).alias(f"t_{s}"), F.min(F.when(here, F.col("pos"))).alias(f"p_{s}"), F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"c_{s}")]
    for code, words in (("mr", MARATHI), ("hi", HINDI)):
        aggs.append(F.count_if(dev & F.col("token").rlike(_any_of(words))).alias(f"h_{code}"))
    g = _tokens(docs, key).groupBy(key).agg(*aggs)
    tokens = reduce(lambda a, b: a + b, (F.col(f"t_{s}") for s in LETTERS))
    letters = reduce(lambda a, b: a + b, (F.col(f"c_{s}") for s in LETTERS))
    g = g.withColumns({"tokens": tokens, "letters": letters})
    marathi = F.col("h_mr") > F.col("h_hi")

    def one(code: str, name: str, script: str) -> Column:
        conf = F.round(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.col(f"c_{script}") / F.col("letters") * BY_LETTERS + F.col(f"t_{script}") / F.col("tokens") * BY_TOKENS)), 2)
        there = F.col(f"t_{script}") > 0
        if script == "Devanagari":
            there = there & (marathi if code == "mr" else ~marathi)
        order = [(-F.col(f"t_{script}")).alias("falling"), F.lit(int(script == "Devanagari")).alias("last"), F.col(f"p_{script}").alias("first")]
        return F.when(there, F.struct(*order, F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(script).alias("script"), conf.alias("confidence"), F.col(f"t_{script}").alias("tokens")))

    found = F.array_sort(F.array_compact(F.array(*(one(*x) for x in LANGUAGES))))
    plain = lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"), x["script"].alias("script"), x["confidence"].alias("confidence"), x["tokens"].alias("tokens"))
    english = F.struct(F.lit("en").alias("code"), F.lit("English").alias("name"), F.lit("Latin").alias("script"), F.when(F.col("all") == 0, 1.0).otherwise(0.9).alias("confidence"), F.col("all").alias("tokens"))
    langs = F.when(F.col("tokens") > 0, F.transform(found, plain)).otherwise(F.array(english))
    seen = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"t_{s}") > 0, F.struct(F.col(f"p_{s}").alias("first"), F.lit(s).alias("script"))) for s in LETTERS))))
    scripts = F.when(F.col("tokens") > 0, F.transform(seen, lambda x: x["script"])).otherwise(F.array(F.lit("Latin")))
    out = g.select(key, "tokens", langs.alias("languages"), scripts.alias("scripts"))
    second = F.get("languages", F.lit(1))["tokens"]
    top = lambda f: F.get("languages", F.lit(0))[f]
    return out.select(key, top("code").alias("primary_language"), top("script").alias("primary_script"), top("confidence").alias("confidence"), F.coalesce((second >= SECOND) & (second >= SECOND_SHARE * F.col("tokens")), F.lit(False)).alias("mixed"), "scripts", "languages")


def _index(keywords: DataFrame) -> DataFrame:
    """keywords with their first letters; one row for each (language, field, lower-cased keyword). Empty keywords are left out."""
    k = L.compatible(keywords.select("language", "field", "keyword"), "keyword")
    k = k.select("language", "field", F.lower(F.trim("keyword")).alias("keyword")).filter("keyword <> ''").distinct()
    return k.withColumn("head", F.left("keyword", F.lit(INDEX)))


def _beginnings(index: DataFrame) -> list[str]:
    """Patterns for the heads of an index, one for each of their lengths; for any letters if there are more than BEGINNINGS."""
    heads = index.select("head").distinct()
    known = sorted(r[0] for r in heads.limit(BEGINNINGS + 1).collect())
    if len(known) > BEGINNINGS:
        return [f".{{{r[0]}}}" for r in heads.select(F.length("head")).distinct().collect()]  # no more than INDEX numbers
    quoted = lambda x: "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in x)
    # The letters that heads begin with turn most places of a line away at once.
    some = {w: [quoted(h) for h in known if len(h) == w] for w in sorted(set(map(len, known)))}
    return [f"(?=[{''.join(sorted({quoted(h[0]) for h in known if len(h) == w}))}])(?:{'|'.join(hs)})" for w, hs in some.items()]


def _heads(line: Column, beginnings: list[str]) -> Column:
    """All runs of letters of a line that match a pattern, overlapping ones too, each once."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(line, F.lit(f"(?s)(?=({p}))"), F.lit(1)) for p in beginnings))))


def keyword_hits(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every keyword in every line: label_id, line, raw, content, following, language, field, keyword, at (from 1).

    content is the normalised line, raw the printed one, following the next three printed lines. keywords: language,
    field, keyword (sources.exports.read_keywords); case is of no account. The keywords are broadcast up to a checked
    count; whatever their number, a line meets only those that begin with letters that stand in it.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("raw"), x.alias("content"), F.slice(lines, i + 2, 3).alias("following")))
    each = L.normalized(labels.select("label_id", F.inline(rows)).filter(F.trim("raw") != ""), "content")
    each = each.withColumn("low", F.lower("content"))
    index = _index(keywords)
    met = each.withColumn("head", F.explode(_heads(F.col("low"), _beginnings(index) or [f".{{{INDEX}}}"]))).join(small(index), "head")
    return met.withColumn("at", F.expr("position(keyword, low)")).filter("at > 0").drop("head", "low")


def _value(field: Column) -> Column:
    """STRUCT<value, confidence> of a hit by its field, null if the line holds none."""
    window = F.expr("substring(content, at)")
    text = lambda p, c: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    made = lambda v, c: F.when(v.isNotNull(), F.struct(v.cast("string").alias("value"), F.lit(c).alias("confidence")))
    price = C.repaired_price(text(r"(\d+(?:[.,]\d{1,2})?)", F.regexp_replace(window, r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{8,}", "")))
    quantity = F.when(~F.col("content").rlike(SERVING), C.repaired_quantity(text(QUANTITY, F.left(window, F.lit(80)))))
    date = L.local_date(F.left(window, F.lit(60)))
    place = F.expr("coalesce(nullif(position(keyword, lower(raw)), 0), at)")
    goes_on = lambda x: (F.trim(x) != "") & ~F.lower(x).rlike(SECTION_ENDS)
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(True).alias("open"))
    taken = F.aggregate("following", start, lambda a, x: F.struct(F.when(a["open"] & goes_on(x), F.array_append(a["lines"], F.trim(x))).otherwise(a["lines"]).alias("lines"), (a["open"] & goes_on(x)).alias("open")))
    section = F.trim(F.concat_ws(" ", F.col("raw").substr(place, F.length("raw")), taken["lines"]))
    rest = F.regexp_replace(F.col("raw").substr(place + F.length("keyword"), F.length("raw")), r"^[ :\-,.]+|[ :\-,.]+$", "")
    after = F.trim(F.get("following", F.lit(0)))
    maker = F.coalesce(made(F.when(F.length(rest) >= 4, rest), 90.0), made(F.when(F.length(after) >= 4, after), 88.0))
    return (
        F.when(field == "mrp", made(price, 94.0))
        .when(field == "net_quantity", made(quantity, 94.0))
        .when(field.isin(*DATES), made(F.when(date.rlike(r"\d"), date), 92.0))
        .when(field.isin(*SECTIONS), made(F.when(F.length(section) >= 5, section), 92.0))
        .when(field == "consumer_care", made(F.col("raw"), 92.0))
        .when(field.isin(*MAKERS), maker)
    )


def local_declarations(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """label_id, field, value, confidence, language, keyword, pos: each field's first line with a value after a keyword.

    In a line the longest keyword that gives a value counts, then by language and keyword. Prices and quantities are
    repaired, dates are read with month names and digits of all languages, sections go on for up to three lines. A price,
    quantity or contact without a keyword is left to extraction.candidates. Other fields than those have no rows. Null texts and texts without a keyword have none.
    """
    hits = keyword_hits(labels, keywords).withColumn("v", _value(F.col("field")))
    # Hits without a value have no place in the order; a filter would compute every value twice, in the join and after it.
    order = F.when(F.col("v").isNotNull(), F.struct("line", -F.length("keyword"), "language", "keyword"))
    top = hits.groupBy("label_id", "field").agg(F.min_by(F.struct("v", "language", "keyword", "line"), order).alias("h")).filter("h IS NOT NULL")
    return top.select("label_id", "field", "h.v.value", "h.v.confidence", "h.language", "h.keyword", F.col("h.line").alias("pos"))


def filled(base: DataFrame, local: DataFrame) -> DataFrame:
    """The best candidates of base, and local declarations of the (label, field) gaps, with their own confidence. base: extraction.candidates."""
    top = best(base)
    gaps = local.join(by_label(top.select("label_id", "field")), ["label_id", "field"], "left_anti")
    return top.unionByName(gaps.select("label_id", "field", F.col("value").alias("raw"), "value", "confidence", F.lit("multilingual").alias("method"), "pos"))
