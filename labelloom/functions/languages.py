"""Texts of ten languages: compatibility characters, digits, currency, units and dates with month names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import columns as C

#: Names of the months by language, in the order in which they are tried; alternatives are divided by a bar.
MONTH_NAMES = {
    "English": "jan|january feb|february mar|march apr|april may jun|june jul|july aug|august sep|sept|september oct|october nov|november dec|december",
    "Hindi, Marathi": "जनवरी|जानेवारी फरवरी|फेब्रुवारी मार्च अप्रैल|एप्रिल मई|मे जून जुलाई|जुलै अगस्त|ऑगस्ट सितंबर|सप्टेंबर अक्टूबर|ऑक्टोबर नवंबर|नोव्हेंबर दिसंबर|डिसेंबर",
    "Bengali": "জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর",
    "Gujarati": "જાન્યુઆરી ફેબ્રુઆરી માર્ચ એપ્રિલ મે જૂન જુલાઈ ઓગસ્ટ સપ્ટેમ્બર ઓક્ટોબર નવેમ્બર ડિસેમ્બર",
    "Punjabi": "ਜਨਵਰੀ ਫ਼ਰਵਰੀ ਮਾਰਚ ਅਪ੍ਰੈਲ ਮਈ ਜੂਨ ਜੁਲਾਈ ਅਗਸਤ ਸਤੰਬਰ ਅਕਤੂਬਰ ਨਵੰਬਰ ਦਸੰਬਰ",
    "Tamil": "ஜனவரி பிப்ரவரி மார்ச் ஏப்ரல் மே ஜூன் ஜூலை ஆகஸ்ட் செப்டம்பர் அக்டோபர் நவம்பர் டிசம்பர்",
    "Telugu": "జనవరి ఫిబ్రవరి మార్చి ఏప్రిల్ మే జూన్ జూలై ఆగస్టు సెప్టెంబరు అక్టోబరు నవంబరు డిసెంబరు",
    "Kannada": "ಜನವರಿ ಫೆಬ್ರವರಿ ಮಾರ್ಚ್ ಏಪ್ರಿಲ್ ಮೇ ಜೂನ್ ಜುಲೈ ಆಗಸ್ಟ್ ಸೆಪ್ಟೆಂಬರ್ ಅಕ್ಟೋಬರ್ ನವೆಂಬರ್ ಡಿಸೆಂಬರ್",
    "Malayalam": "ജനുവരി ഫെബ്രുവരി മാർച്ച് ഏപ്രിൽ മേയ് ജൂൺ ജൂലൈ ഓഗസ്റ്റ് സെപ്റ്റംബർ ഒക്ടോബർ നവംബർ ഡിസംബർ",
}


#: Words of currency, and of units with the short form of each, in all languages; longer units come first.
CURRENCY = r"(?:\bINR\b|\bRupees?\b|\bRupaye\b|\bRs\b\.?|₨|(?<![\p{L}\p{M}])(?:ரூபாய்|రూపాయలు|ರೂಪಾಯಿ|രൂപ|रु\.?|रू\.?|টাকা|ਰੁ\.?|ரூ\.?|రూ\.?|ರೂ\.?)(?![\p{L}\p{M}])|₹)"
UNITS = (
    ("kg", r"किलोग्राम|kilograms?|kilogram|kilo|किग्रा|कि\.?\s*ग्रा\.?|ਕਿਲੋ|கிலோகிராம்|கிலோ|కిలోగ్రాములు|కిలో|ಕಿಲೋಗ್ರಾಂ|কেজি|કિલોગ્રામ|કિગ્રા|કિ\.?\s*ગ્રા\.?|કિલો|kg|kgs"),
    ("mg", r"milligrams?|milligram|mg|mgs|मि\.?\s*ग्रा\.?|மி\.?\s*கி|ಮಿ\.?\s*ಗ್ರಾಂ"),
    ("g", r"grams?|gram|gm|gms|ग्राम|ग्रॅम|ग्रॅ|ഗ്രാം|கிராம்|ಗ್ರಾಂ|గ్రాములు|గ్రా|গ্রাম|ਗ੍ਰਾਮ|ગ્રા|g"),
    ("ml", r"millilitres?|milliliters?|millilitre|milliliter|milli|मिलीलीटर|मिली|मि\.?\s*ली\.?|மி\.?\s*லி|மில்லி|మిల్లీ|మి\.?\s*లీ|ಮಿಲಿ|মিলি|ਮਿਲੀ|મિલી|ml|mls"),
    ("l", r"litres?|liters?|litre|liter|लीटर|ली\.?|லிட்டர்|లీಟರ್|లీటరు|లీ|লিটার|ਲੀਟਰ|લિટર|ltrs|ltr|l"),
    ("u", r"pieces?|units?|संख्या|इकाई|নগ|எண்ணிக்கை|సంఖ్య|ಘಟಕ|ನੰਬਰ|સંખ્યા|pcs|pc|u|n"),
)


def months() -> list[tuple[str, str]]:
    """Every name with the number of its month, two digits."""
    return [(name, f"{i:02d}") for names in MONTH_NAMES.values() for i, some in enumerate(names.split(" "), 1) for name in some.split("|")]


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def local_date(c: Column) -> Column:
    """DD/MM/YYYY or MM/YYYY from a date with a month's name in any of the languages, or with numbers; else the text with ASCII digits.

    The year is a number of four digits, or of two after the month, or of two anywhere; the day a number before the month.
    """
    d = F.trim(C.indic_digits(c))
    # Bound once: the text is asked for every name.
    return F.get(F.transform(F.array(F.struct(d.alias("d"), F.lower(d).alias("low"))), lambda t: _local_date(t["d"], t["low"])), F.lit(0))


def _local_date(d: Column, low: Column) -> Column:
    names = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in months()))
    hit = F.get(F.filter(names, lambda m: low.contains(m["w"])), F.lit(0))

    def dated(m: Column) -> Column:
        at = F.position(m["w"], low)
        before, after = F.left(d, at - 1), d.substr(at + F.length(m["w"]), F.length(d))
        two = lambda x: _some(F.regexp_extract(x, r"\b(\d{2})\b", 1))
        year = F.coalesce(_some(F.regexp_extract(d, r"\b(20\d\d|19\d\d)\b", 1)), F.concat(F.lit("20"), F.coalesce(two(after), two(d))))
        day = F.regexp_extract(before, r"\b([0-2]?\d|3[01])\b", 1).try_cast("int")
        return F.when(year.isNotNull(), F.concat_ws("/", F.when(day > 0, F.lpad(day.cast("string"), 2, "0")), m["n"], year))

    named = F.get(F.transform(F.array(hit), lambda m: F.when(m.isNotNull(), dated(m))), F.lit(0))
    full, short = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})\b", r"\b(\d{1,2})[/.\-](\d{2,4})\b"
    part = lambda p, i: _some(F.regexp_extract(d, p, i))
    year = lambda p, i: F.concat(F.when(F.length(part(p, i)) == 2, "20").otherwise(""), part(p, i))
    two = lambda p, i: F.lpad(part(p, i), 2, "0")
    numbers = F.when(part(full, 1).isNotNull(), F.concat_ws("/", two(full, 1), two(full, 2), year(full, 3))).when(part(short, 1).cast("int").between(1, 12), F.concat_ws("/", two(short, 1), year(short, 2)))
    return F.coalesce(named, numbers, d)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(df: DataFrame, column: str) -> DataFrame:
    """df with a text column in Unicode's NFKC; only rows with characters beyond ASCII go through Python."""
    other = F.coalesce(F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.filter(~other).unionByName(df.filter(other).withColumn(column, _nfkc(column)))


def normalized(df: DataFrame, column: str) -> DataFrame:
    """df with a text column normalised: NFKC, ASCII digits, one rupee sign before a price, short units after a number, single spaces.

    Words of currency count as whole words only, so that no other word is cut (a month's name holds one).
    """
    text = F.regexp_replace(C.indic_digits(F.coalesce(column, F.lit(""))), rf"(?i){CURRENCY}(?:\s*{CURRENCY})*\s*", "₹")
    for short, words in UNITS:
        text = F.regexp_replace(text, rf"(?i)(\d+(?:\.\d+)?)\s*(?:{words})(?![\p{{L}}\p{{N}}_])", f"$1 {short}")
    return compatible(df, column).withColumn(column, F.trim(F.regexp_replace(text, r"[ \t]+", " ")))
