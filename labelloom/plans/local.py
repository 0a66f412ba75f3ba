"""Languages of texts and declarations in ten languages, against what the texts were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import languages as L
from labelloom.operators import extraction as E
from labelloom.operators import tongues as T
from labelloom.plans.registry import Registry
from labelloom.sources.shared import stored
from labelloom.sources.views import frame

QUERIES, SQL, query = Registry.new()

#: One keyword of each language for price, quantity, maker, date made, ingredients and contact; then words for gram and millilitre.
WORDS = {
    "en": ("maximum retail price", "net quantity", "manufactured by", "mfg date", "ingredients", "consumer care", "g", "ml"),
    "hi": ("अधिकतम खुदरा मूल्य", "शुद्ध मात्रा", "निर्माता", "निर्माण तिथि", "सामग्री", "उपभोक्ता सेवा", "ग्राम", "मिली"),
    "bn": ("সর্বোচ্চ খুচরা মূল্য", "নিট পরিমাণ", "প্রস্তুতকারক", "উৎপাদনের তারিখ", "উপাদান", "গ্রাহক সেবা", "গ্রাম", "মিলি"),
    "mr": ("कमाल किरकोळ किंमत", "निव्वळ प्रमाण", "उत्पादक", "उत्पादन दिनांक", "घटक", "ग्राहक सेवा", "ग्रॅम", "मिली"),
    "gu": ("મહત્તમ છૂટક કિંમત", "ચોખ્ખો જથ્થો", "ઉત્પાદક", "ઉત્પાદન તારીખ", "સામગ્રી", "ગ્રાહક સેવા", "ગ્રા", "મિલી"),
    "pa": ("ਵੱਧ ਤੋਂ ਵੱਧ ਪ੍ਰਚੂਨ ਮੁੱਲ", "ਕੁੱਲ ਮਾਤਰਾ", "ਨਿਰਮਾਤਾ", "ਨਿਰਮਾਣ ਮਿਤੀ", "ਸਮੱਗਰੀ", "ਗਾਹਕ ਸੇਵਾ", "ਗ੍ਰਾਮ", "ਮਿਲੀ"),
    "ta": ("அதிகபட்ச சில்லறை விலை", "நிகர அளவு", "உற்பத்தியாளர்", "உற்பத்தி தேதி", "பொருட்கள்", "வாடிக்கையாளர் சேவை", "கிராம்", "மில்லி"),
    "te": ("గరిష్ట చిల్లర ధర", "నికర పరిమాణం", "తయారీదారు", "తయారీ తేదీ", "పదార్థాలు", "వినియోగదారుల సంరక్షణ", "గ్రాములు", "మిల్లీ"),
    "kn": ("ಗರಿಷ್ಠ ಚಿಲ್ಲರೆ ಬೆಲೆ", "ನಿವ್ವಳ ಪ್ರಮಾಣ", "ತಯಾರಕರು", "ತಯಾರಿಕಾ ದಿನಾಂಕ", "ಪದಾರ್ಥಗಳು", "ಗ್ರಾಹಕ ಸೇವೆ", "ಗ್ರಾಂ", "ಮಿಲಿ"),
    "ml": ("പരമാവധി ചില്ലറ വിൽപ്പന വില", "അറ്റ അളവ്", "ഉത്പാദകർ", "ഉത്പാദന തീയതി", "ചേരുവകൾ", "ഉപഭോക്തൃ സേവനം", "ഗ്രാം", "ml"),
}
FIELDS = ("mrp", "net_quantity", "manufacturer", "manufacturing_date", "ingredients", "consumer_care")
_CODES = list(WORDS)
#: The zero of each language's digits.
_ZERO = {"en": "0", "hi": "०", "bn": "০", "mr": "०", "gu": "૦", "pa": "੦", "ta": "௦", "te": "౦", "kn": "೦", "ml": "൦"}
_MONTHS = {"en": "English", "hi": "Hindi, Marathi", "mr": "Hindi, Marathi", "bn": "Bengali", "gu": "Gujarati", "pa": "Punjabi", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam"}


def _local_text(spark, d):
    """Labels whose price, quantity, maker, date, ingredients and contact are printed in language number label_id % 10, with its digits and months.

    Every fourth maker stands on the line after its heading.
    """
    rows = []
    for k, c in enumerate(_CODES):
        months = [m.split("|")[-1 if c in ("en", "mr") else 0] for m in L.MONTH_NAMES[_MONTHS[c]].split(" ")]
        rows.append((k, *WORDS[c], "".join(chr(ord(_ZERO[c]) + i) for i in range(10)), months))
    words = spark.createDataFrame(rows, "k int, price_w string, amount_w string, maker_w string, made_w string, list_w string, care_w string, g_w string, ml_w string, digits string, months array<string>")
    return spark.sql("""SELECT label_id, concat_ws(chr(10), product_name, concat(price_w, ': ₹ ', translate(CAST(price AS STRING), '0123456789', digits)),
      concat(amount_w, ' ', translate(CAST(amount AS STRING), '0123456789', digits), ' ', CASE unit WHEN 'g' THEN g_w ELSE ml_w END),
      concat(maker_w, ':', CASE WHEN label_id % 4 = 0 THEN chr(10) ELSE ' ' END, maker), concat(made_w, ' - ', months[CAST(substr(made, 1, 2) AS INT) - 1], ' ', translate(substr(made, 4, 4), '0123456789', digits)),
      concat(list_w, ': ', ingredients, chr(10), 'citric acid', chr(10), 'Batch ', batch), concat(care_w, ' ', phone)) AS text
      FROM {truth} JOIN {words} ON label_id % 10 = k""", truth=frame(spark, d, "label_truth"), words=F.broadcast(words))  # fmt: skip


def _keywords(spark):
    return spark.createDataFrame([(c, f, w) for c, words in WORDS.items() for f, w in zip(FIELDS, words)], "language string, field string, keyword string")


_K = ", ".join(f"({k}, '{c}', '{WORDS[c][0]}', '{WORDS[c][4]}', '{WORDS[c][5]}')" for k, c in enumerate(_CODES))
LOCAL = f"""w AS (SELECT * FROM (VALUES {_K}) AS t(k, language, price_w, list_w, care_w)),
lo AS (SELECT label_id, language, unnest([{{'field': 'mrp', 'value': CAST(price AS VARCHAR), 'confidence': 94}}, {{'field': 'net_quantity', 'value': CAST(amount AS VARCHAR) || ' ' || unit, 'confidence': 94}},
  {{'field': 'manufacturer', 'value': maker, 'confidence': CASE WHEN label_id % 4 = 0 THEN 88 ELSE 90 END}}, {{'field': 'manufacturing_date', 'value': made, 'confidence': 92}},
  {{'field': 'ingredients', 'value': list_w || ': ' || ingredients || ' citric acid', 'confidence': 92}}, {{'field': 'consumer_care', 'value': care_w || ' ' || phone, 'confidence': 92}}]) AS r
  FROM label_truth JOIN w ON label_id % 10 = k)"""


@query("d17_local_declarations", f"WITH {LOCAL} SELECT label_id, language, r.field AS field, r.value AS value, r.confidence::DOUBLE AS confidence FROM lo WHERE r.value IS NOT NULL", ("label_truth",))
def d17_local_declarations(spark, d):
    return T.local_declarations(_local_text(spark, d), _keywords(spark)).select("label_id", "language", "field", "value", "confidence")


#: In English labels the general patterns find the price, the quantity, the list and makers on the heading's line.
@query("d17_filled_gaps", f"""WITH {LOCAL.replace("SELECT label_id, language, unnest", "SELECT label_id, language, unit, unnest")} SELECT label_id, r.field AS field, r.value AS value, r.confidence::DOUBLE AS confidence FROM lo WHERE r.value IS NOT NULL
AND NOT (language = 'en' AND (r.field IN ('mrp', 'net_quantity', 'ingredients') OR r.field = 'manufacturer' AND label_id % 4 <> 0))""", ("label_truth",))  # fmt: skip
def d17_filled_gaps(spark, d):
    labels = stored(_local_text(spark, d))
    all_of = T.filled(E.candidates(E.spread(labels)), T.local_declarations(labels, _keywords(spark)))
    return all_of.filter("method = 'multilingual'").select("label_id", "field", "value", "confidence")


#: A word of a language by label_id % 10; Hindi with and without a marker, Marathi with one.
NATIVE = (("पानी", "hi"), ("मूल्य", "hi"), ("জল", "bn"), ("किंमत", "mr"), ("પાણી", "gu"), ("ਪਾਣੀ", "pa"), ("நீர்", "ta"), ("నీరు", "te"), ("ನೀರು", "kn"), ("വെള്ളം", "ml"))
_NAMED = {c: (n, s) for c, n, s in T.LANGUAGES}
_N = ", ".join(f"({k}, '{w}', {len(w)}, '{c}', '{_NAMED[c][0]}', '{_NAMED[c][1]}')" for k, (w, c) in enumerate(NATIVE))
#: b words of a language, a words of English before or after them, and two Hindi words after some of Marathi; two numbers end every text.
COUNTS = f"""n AS (SELECT * FROM (VALUES {_N}) AS t(k, word, len, code, name, script)),
q AS (SELECT label_id, k, word, len, code, name, script, label_id % 4 AS a, CAST(floor(label_id / 10) AS BIGINT) % 6 AS b, label_id % 7 < 3 AS ahead, CASE WHEN k = 3 AND label_id % 3 = 0 THEN 2 ELSE 0 END AS h, label_id % 50 = 49 AS blank FROM label_truth JOIN n ON label_id % 10 = k)"""


def _mixed_text(spark, d):
    text = "concat(CASE WHEN ahead THEN repeat(concat(word, ' '), CAST(b AS INT)) ELSE '' END, repeat('label ', CAST(a AS INT)), CASE WHEN ahead THEN '' ELSE repeat(concat(word, ' '), CAST(b AS INT)) END, repeat('मूल्य ', h), '12 50%')"
    sql = COUNTS.replace("FROM label_truth", "FROM {label_truth}")
    return spark.sql(f"WITH {sql} SELECT label_id, CASE WHEN NOT blank THEN {text} END AS text FROM q", label_truth=frame(spark, d, "label_truth"))


_CONF = "round(least(0.99::DOUBLE, greatest(0.65::DOUBLE, c::DOUBLE / letters * 0.6::DOUBLE + t::DOUBLE / tokens * 0.4::DOUBLE)), 2)"
SPOKEN = f"""{COUNTS}, r AS (
  SELECT label_id, 'en' AS code, 'English' AS name, 'Latin' AS script, a AS t, 5 * a AS c, 0 AS last, CASE WHEN ahead THEN b ELSE 0 END AS first FROM q WHERE a > 0 AND NOT blank
  UNION ALL SELECT label_id, CASE WHEN k = 3 AND b <= h THEN 'hi' ELSE code END, CASE WHEN k = 3 AND b <= h THEN 'Hindi' ELSE name END, script, b + h, b * len + 5 * h, CAST(script = 'Devanagari' AS INT), CASE WHEN ahead THEN 0 ELSE a END FROM q WHERE b + h > 0 AND NOT blank),
z AS (SELECT *, sum(t) OVER (PARTITION BY label_id) AS tokens, sum(c) OVER (PARTITION BY label_id) AS letters FROM r),
o AS (SELECT label_id, row_number() OVER (PARTITION BY label_id ORDER BY t DESC, last, first) AS rank, code, name, script, {_CONF} AS confidence, t, tokens FROM z
  UNION ALL SELECT label_id, 1, 'en', 'English', 'Latin', CASE WHEN blank THEN 1.0 ELSE 0.9 END::DOUBLE, CASE WHEN blank THEN 0 ELSE 2 END, NULL FROM q WHERE blank OR a + b + h = 0)"""


@query("d20_languages", f"""WITH {SPOKEN} SELECT label_id, CAST(rank AS INT) AS rank, code, name, script, confidence, CAST(t AS BIGINT) AS tokens,
  coalesce(max(CASE WHEN rank = 2 THEN t >= 2 AND t >= 0.08 * tokens END) OVER (PARTITION BY label_id), false) AS mixed FROM o""", ("label_truth",))  # fmt: skip
def d20_languages(spark, d):
    found = T.text_languages(_mixed_text(spark, d), "label_id")
    return found.select("label_id", "mixed", F.posexplode("languages").alias("rank", "x")).select("label_id", (F.col("rank") + 1).alias("rank"), "x.*", "mixed")


@query("d20_token_languages", f"""WITH {COUNTS}, tk AS (SELECT label_id, 'Latin' AS script, 'en' AS language, a AS n, 1.0 AS confidence FROM q WHERE NOT blank
  UNION ALL SELECT label_id, script, code, b, CASE WHEN k = 0 THEN 0.85 WHEN k IN (1, 3) THEN 0.95 ELSE 1.0 END FROM q WHERE NOT blank UNION ALL SELECT label_id, script, 'hi', h, 0.95 FROM q WHERE NOT blank
  UNION ALL SELECT label_id, 'Neutral', 'neutral', 2, 1.0 FROM q WHERE NOT blank)
SELECT label_id, script, language, CAST(n AS BIGINT) AS tokens, confidence::DOUBLE AS confidence FROM tk WHERE n > 0""", ("label_truth",))  # fmt: skip
def d20_token_languages(spark, d):
    found = T.token_languages(_mixed_text(spark, d), "label_id")
    return found.groupBy("label_id", "script", "language").agg(F.count("*").alias("tokens"), F.max("confidence").alias("confidence"))
