"""Column functions for label declarations: normalise, parse, repair, validate, escape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero digits of eight Indic scripts (Devanagari, Bengali, Gurmukhi, Gujarati, Tamil, Telugu, Kannada, Malayalam).
INDIC_ZERO = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66)
#: Unit words in the order of replacement (kg before g).
UNITS = (
    (r"kilo\s*grams?|kgs?", "kg"),
    (r"milli\s*grams?|mgs?", "mg"),
    (r"grams?|gms?|gm", "g"),
    (r"milli\s*lit(?:er|re)s?|mls?", "ml"),
    (r"lit(?:er|re)s?|ltrs?", "L"),
    (r"pieces?|pcs?|nos?|units?", "count"),
)
#: Corporate words that names are compared without.
STOP_WORDS = ("pvt", "private", "ltd", "limited", "llp", "inc", "corp", "corporation", "co", "company", "india", "the", "and", "of", "foods", "products", "industries", "enterprises")
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
#: Signatures that mark text as untrusted.
SIGNATURES = ("<script", "javascript:", "onerror=", "onload=", "ignore previous instructions", "system prompt", "drop table", "union select")


def indic_digits(c: Column) -> Column:
    frm = "".join(chr(z + i) for z in INDIC_ZERO for i in range(10))
    return F.translate(c, frm, "0123456789" * len(INDIC_ZERO))


def currency(c: Column) -> Column:
    """Currency words and symbols as one rupee sign."""
    one = F.regexp_replace(c, r"(?i)(?:\brupees?\b|\brs\b\.?|\binr\b|₨|रु\.?)", "₹")
    return F.regexp_replace(one, r"₹(?:\s*₹)+", "₹")


def units(c: Column) -> Column:
    for pattern, to in UNITS:
        c = F.regexp_replace(c, rf"(?i)(\d)\s*(?:{pattern})\b", rf"$1 {to}")
    return c


def comparison_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(indic_digits(c), r"\s+", " ")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often it stands in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def label_date(c: Column) -> Column:
    """DD/MM/YYYY or MM/YYYY from numeric and month-name dates; else the text as it was."""
    return bound(F.struct(c.alias("c"), F.lower(F.trim(indic_digits(c))).alias("t")), lambda v: F.coalesce(_named_date(v["t"]), _numeric_date(v["t"]), v["c"]))


def _named_date(t: Column) -> Column:
    number = F.create_map(*(F.lit(x) for m, i in MONTHS.items() for x in (m, f"{i:02d}")))
    month = F.try_element_at(number, F.regexp_extract(t, r"([a-z]{3})[a-z]*", 1))
    year4 = F.nullif(F.regexp_extract(t, r"\b(\d{4})\b", 1), F.lit(""))
    year2 = F.nullif(F.regexp_extract(t, r"(?:^|[^\d])(\d{2})$", 1), F.lit(""))
    year = F.coalesce(year4, F.concat(F.lit("20"), year2))
    day = F.nullif(F.regexp_extract(t, r"\b([0-2]?\d|3[01])(?:st|nd|rd|th)?[\s\-./]+[a-z]", 1), F.lit(""))
    return F.when(t.rlike(r"[a-z]{3}") & month.isNotNull() & year.isNotNull(), F.concat_ws("/", F.lpad(day, 2, "0"), month, year))


def _numeric_date(t: Column) -> Column:
    full = r"^(\d{1,2})[\-./](\d{1,2})[\-./](\d{2}|\d{4})$"
    short = r"^(\d{1,2})[\-./](\d{2}|\d{4})$"
    yr = lambda p, i: F.when(F.length(F.regexp_extract(t, p, i)) == 2, F.concat(F.lit("20"), F.regexp_extract(t, p, i))).otherwise(F.regexp_extract(t, p, i))
    two = lambda p, i: F.lpad(F.regexp_extract(t, p, i), 2, "0")
    return F.when(t.rlike(full), F.concat_ws("/", two(full, 1), two(full, 2), yr(full, 3))).when(t.rlike(short), F.concat_ws("/", two(short, 1), yr(short, 2)))


def price(c: Column) -> Column:
    """First decimal number, as DECIMAL(12,2)."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("decimal(12,2)")


def quantity(c: Column) -> tuple[Column, Column]:
    """Amount and lower-case unit, not converted."""
    p = r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)"
    return F.regexp_extract(c, p, 1).try_cast("decimal(14,3)"), F.nullif(F.lower(F.regexp_extract(c, p, 2)), F.lit(""))


def quantity_base(c: Column) -> tuple[Column, Column]:
    """Amount and unit with kilograms as grams and litres as millilitres, two decimals."""
    n, u = quantity(c)
    big = u.isin("kg", "l", "ltr", "litre", "liter")
    unit = F.when(u == "kg", "g").when(big, "ml").otherwise(u)
    return F.round(n * F.when(big, 1000).otherwise(1), 2), unit


def licence_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def entity_name(c: Column) -> Column:
    """Lower-case words without punctuation and corporate words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (w != "")), " ")


def gtin_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def gtin_format(c: Column) -> Column:
    n = F.length(gtin_digits(c))
    return F.when(n == 8, "GTIN-8").when(n == 12, "GTIN-12").when(n == 13, "GTIN-13").when(n == 14, "GTIN-14").otherwise("INVALID")


def check_digit(body: Column) -> Column:
    """Mod-10 check digit of a code without it: weights 3 and 1 from the right."""
    digits = F.split(F.reverse(body), "")
    total = F.aggregate(F.transform(digits, lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def gtin_valid(c: Column) -> Column:
    g = gtin_digits(c)
    return (gtin_format(c) != "INVALID") & (check_digit(F.substr(g, F.lit(1), F.length(g) - 1)) == F.right(g, F.lit(1)))


def licence_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[12]\d{13}$"), F.lit(False))


def licence_tier(c: Column) -> Column:
    return F.when(~licence_valid(c), "INVALID").when(F.substring(c, 2, 2) == "00", "CENTRAL").when(F.substring(c, 1, 1) == "1", "STATE").otherwise("REGISTRATION")


def gs1_field(url: Column, ai: str) -> Column:
    """A GS1 Digital Link's value of an application identifier (01 gtin, 10 lot, 17 expiry)."""
    return F.nullif(F.regexp_extract(url, rf"/{ai}/([^/?&#]+)", 1), F.lit(""))


def payload_licence(payload: Column) -> Column:
    """Licence inside a code payload: AI 423, then after a keyword, then JSON keys, then 14 bare digits."""
    found = lambda p: F.nullif(F.regexp_extract(payload, p, 1), F.lit(""))
    keys = [F.get_json_object(F.when(payload.startswith("{"), payload), f"$.{k}") for k in ("fssai", "fssai_license", "license_number", "lic_no")]
    return F.coalesce(found(r"\(423\)(\d{14})"), found(r"(?i)(?:fssai|lic)[^\d]{0,20}(\d{14})"), *(F.when(k.rlike(r"^\d{14}$"), k) for k in keys), found(r"(?:^|\D)((?:[1-3]\d|4[0-3])\d{12})(?:\D|$)"))


def clean_text(c: Column) -> Column:
    """Line endings, stray symbols and spaces of read text; lines of one or two punctuation marks are dropped."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[|~^`]+", " "), r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: (x != "") & ~x.rlike(r"^[^A-Za-z0-9]{1,2}$")), "\n")


def repaired_licence(c: Column) -> Column:
    """14 clean digits, else digits after a keyword with look-alike letters replaced."""
    clean = F.nullif(F.regexp_extract(c, r"(?:^|\D)(\d{14})(?:\D|$)", 1), F.lit(""))
    near = F.regexp_extract(c, r"(?i)(?:fssai|lic)[^0-9]{0,20}([0-9OlISBGzZ]{14})", 1)
    return F.coalesce(clean, F.nullif(F.translate(near, "OlISBGzZ", "01158622"), F.lit("")))


def repaired_quantity(c: Column) -> Column:
    """`400 9` read for `400 g`, and units in one spelling."""
    return units(F.regexp_replace(F.trim(c), r"^(\d+)\s+9$", "$1 g"))


def repaired_price(c: Column) -> Column:
    """A price between 1 and 50000; dates and runs of eight digits are no prices."""
    read = price(F.regexp_replace(c, r"(\d),(\d{2})\b(?!\d)", "$1.$2"))
    return F.when(~c.rlike(r"\d{8,}") & ~c.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), bound(read, lambda p: F.when(p.between(1, 50000), p)))


def repaired_date(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_extract(c, r"([0-9OlI]{1,2}[/\-. ][0-9OlI]{1,4}(?:[/\-. ][0-9OlI]{2,4})?)", 1), "OlI", "011"), r"[\-. ]", "/")


def repaired_batch(c: Column) -> Column:
    """Batch token of 2 to 30 characters without its heading and instruction words."""
    rest = F.regexp_replace(c, r"(?i)^\s*(?:batch|lot)\s*(?:no\.?|number)?\s*[:.\-]*\s*", "")
    words = F.filter(F.split(rest, r"\s+"), lambda w: ~F.upper(w).isin("SEE", "REFER", "TO", "ON", "PACK", "BOTTOM", "CAP", "SIDE"))
    return F.regexp_extract(F.array_join(words, " "), r"([A-Za-z0-9/\-]{2,30})", 1)


def sanitised(c: Column) -> Column:
    """Untrusted text with HTML escaped, signatures neutralised and control characters removed."""
    for s in SIGNATURES:
        c = F.regexp_replace(c, "(?i)" + "".join("\\" + x if not x.isalnum() and x != " " else x for x in s), "[removed]")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def spreadsheet_safe(c: Column) -> Column:
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def utc(c: Column) -> Column:
    """Timestamp from ISO text with Z, an offset or neither (UTC)."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def india_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "dd-MM-yyyy HH:mm")


def quality_score(method: Column, confidence: Column, status: Column) -> Column:
    """Evidence quality by match method, reading confidence and evidence status, 0 to 100."""
    within = lambda low, high, c: F.round(F.least(F.lit(high), F.greatest(F.lit(low), c)), 1)
    score = (
        F.when(status.isin("NOT_APPLICABLE", "UNAVAILABLE", "NO_EVIDENCE"), 0.0)
        .when(method == "DIRECT_OCR", within(85.0, 100.0, confidence))
        .when(method == "MULTI_TOKEN_OCR", within(75.0, 95.0, confidence))
        .when(method == "CONTEXTUAL_OCR", within(60.0, 75.0, confidence * 0.8))
        .when(method == "SEMANTIC_PANEL", 40.0)
        .when(method == "TOKEN_SEQUENCE", within(70.0, 90.0, confidence))
    )
    return F.coalesce(score, F.lit(0.0))


def reliability(method: Column, confidence: Column, status: Column) -> tuple[Column, Column]:
    """How far evidence can be relied on, 0 to 100, and its tier: reviews are held down, strong verified evidence is lifted."""
    q = quality_score(method, confidence, status)
    none = status.isin("NOT_APPLICABLE", "UNAVAILABLE", "NO_EVIDENCE")
    score = F.when(none, 0.0).when(status == "NEEDS_REVIEW", F.least(q, F.lit(65.0))).when((status == "VERIFIED") & (q >= 85), F.greatest(q, F.lit(90.0))).otherwise(q)
    return score, F.when(none, "NOT_APPLICABLE").when(score >= 85, "HIGH").when(score >= 70, "MEDIUM").when(score >= 50, "LOW").otherwise("NEEDS_VERIFICATION")


def letter_height(grams: Column) -> Column:
    """Least letter height in millimetres for a net quantity."""
    return F.when(grams <= 50, 1.0).when(grams <= 200, 2.0).when(grams <= 1000, 4.0).when(grams > 1000, 6.0).otherwise(2.0)


def readability(confidence: Column, blur: Column) -> tuple[Column, Column]:
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence * 0.7 + F.least(blur, F.lit(100.0)) * 0.3)), 1)
    return score, F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 40, "FAIR").otherwise("POOR")


def first_present(payload: Column, keys: tuple[str, ...]) -> Column:
    """First non-empty value of candidate keys in a map."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(payload, F.lit(k))), F.lit("")) for k in keys))


def seal(*parts: Column) -> Column:
    """SHA-256 over a canonical text of name=value parts in order of name; numbers should be cast with a fixed scale."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes x, y, w, h."""
    w = F.greatest(F.lit(0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.try_divide(w * h, a[2] * a[3] + b[2] * b[3] - w * h)


def clipped(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """A box (left, top, right, bottom) inside an image."""
    zero = F.lit(0)
    return F.greatest(zero, box[0]), F.greatest(zero, box[1]), F.least(width, box[2]), F.least(height, box[3])


def padded(box: tuple[Column, ...], across: int, down: int, width: Column, height: Column) -> tuple[Column, ...]:
    """A box made larger, inside an image."""
    return clipped((box[0] - across, box[1] - down, box[2] + across, box[3] + down), width, height)


def normalised_box(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """A box as shares of an image, 0 to 1, to four places; zeros for an image without a size."""
    share = lambda v, of: F.when((width > 0) & (height > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / of)), 4)).otherwise(0.0)
    return share(box[0], width), share(box[1], height), share(box[2], width), share(box[3], height)


def pixel_box(shares: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """Shares of an image as whole pixels."""
    return tuple(F.bround(s * of).cast("int") for s, of in zip(shares, (width, height, width, height), strict=True))
