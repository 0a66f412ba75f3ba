"""Companies, brands and product names wherever they stand on a label, against what the texts were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import languages as L
from labelloom.operators import blocks as B
from labelloom.operators import extraction as E
from labelloom.operators import identity as I
from labelloom.plans.registry import Registry
from labelloom.sources.shared import stored
from labelloom.sources.views import frame

QUERIES, SQL, query = Registry.new()

ENTITIES = """en AS (SELECT label_id, unnest(CASE label_id % 5
  WHEN 0 THEN [{'role': 'marketed_by', 'company': 'Supplier ' || supplier_id || ' Foods Pvt Ltd', 'address': 'Plot 5, Ring Road, Surat, Gujarat 395007'}]
  WHEN 1 THEN [{'role': 'manufacturer', 'company': 'Supplier ' || supplier_id || ' Foods Pvt Ltd', 'address': 'Plot 9, Estate, Delhi, 110001'}]
  WHEN 2 THEN [{'role': 'packer', 'company': 'Packhouse ' || supplier_id || ' Agro', 'address': 'Nagar Road'}, {'role': 'importer', 'company': 'Harbour ' || supplier_id || ' Enterprises', 'address': 'Sector 4'}]
  WHEN 3 THEN [{'role': 'manufacturer', 'company': 'Supplier ' || supplier_id || ' Foods', 'address': 'Plot 3, Ring Road, Delhi'}] END) AS e FROM pack_truth)"""
BRAND = """br AS (SELECT label_id, CASE WHEN label_id % 6 = 0 THEN 'Acme' || supplier_id WHEN label_id % 6 = 1 THEN 'Zeta' || supplier_id WHEN label_id % 5 IN (0, 1, 3) THEN 'Supplier ' || supplier_id WHEN label_id % 6 = 3 THEN 'Sunny' || supplier_id WHEN label_id % 6 = 4 THEN 'Moon' || supplier_id END AS brand,
  CASE WHEN label_id % 6 = 0 THEN 'trademark' WHEN label_id % 6 = 1 THEN 'owner' WHEN label_id % 5 IN (0, 1, 3) THEN 'company' ELSE 'handle' END AS source FROM pack_truth)"""
TITLE = lambda c: f"array_to_string([upper(x[1]) || x[2:] FOR x IN string_split({c}, ' ')], ' ')"


@query("d06_entities", f"WITH {ENTITIES} SELECT label_id, e.role AS role, e.company AS company, e.address AS address FROM en", ("pack_truth",))
def d06_entities(spark, d):
    return I.entities(frame(spark, d, "pack_text"))


def _companies(found):
    rank = F.when(F.col("role") == "manufacturer", 0).when(F.col("role") == "marketed_by", 1)
    return found.filter(rank.isNotNull()).groupBy("label_id").agg(F.min_by("company", rank).alias("company"))


def _brands(spark, d):
    text = stored(frame(spark, d, "pack_text"))
    return text, I.brands(text, _companies(I.entities(text)))


@query("d13_brand", f"WITH {BRAND} SELECT * FROM br WHERE brand IS NOT NULL", ("pack_truth",))
def d13_brand(spark, d):
    return _brands(spark, d)[1]


#: A name over two lines is told by a commodity in the second; without one the first line alone is as good and comes first.
@query("d13_product_name", f"""WITH n AS (SELECT label_id, CASE WHEN label_id % 4 = 3 AND NOT goods THEN left(name, length(name) - length(' Shampoo')) ELSE name END AS phrase, goods, CASE label_id % 4 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 35 END AS place FROM pack_truth),
s AS (SELECT label_id, phrase, (place + CASE WHEN goods THEN 45 ELSE 0 END + 25)::DOUBLE AS score FROM n)
SELECT label_id, phrase, {TITLE('phrase')} AS product_name, score, least(94, greatest(75, 70 + 0.3::DOUBLE * score))::DOUBLE AS confidence FROM s WHERE score >= 35""", ("pack_truth",))  # fmt: skip
def d13_product_name(spark, d):
    text, brand = _brands(spark, d)
    return I.product_names(text, stored(brand))


@query("d11_ingredient_lists", """SELECT label_id, CASE label_id % 5 WHEN 0 THEN 'Rolled oats, salt (5%) sugar; milk ' || supplier_id WHEN 1 THEN 'wheat flour ' || supplier_id || ' (palm oil) salt' WHEN 2 THEN 'qwrtpsdfghjkl zxcvbnmlkjhgf oats salt' ELSE 'one two three four five six seven qwrtpsdfghjkl tail' END AS ingredients,
CASE label_id % 5 WHEN 2 THEN 55 WHEN 3 THEN 68 ELSE 88 END::DOUBLE AS confidence FROM label_truth WHERE label_id % 5 <> 4""", ("label_truth",))  # fmt: skip
def d11_ingredient_lists(spark, d):
    return B.ingredient_lists(frame(spark, d, "list_text"))


@query("d03_price_states", f"""SELECT label_id, CASE WHEN stamped AND price <> 9.50 THEN 'CONFLICT' WHEN price IS NOT NULL THEN 'FOUND' ELSE 'UNCERTAIN' END AS status, coalesce(CAST(price AS VARCHAR), '{B.UNPRINTED}') AS value, CASE WHEN price IS NULL THEN 50 ELSE 92 END::DOUBLE AS confidence FROM label_truth""", ("label_truth",))
def d03_price_states(spark, d):
    labels = E.spread(frame(spark, d, "label_text"))
    return B.price_states(labels, E.candidates(labels))


#: A month's name in one of the languages by label_id % 10 (the last one numbers), with a day where label_id is even, digits of the script in Hindi.
_MONTH = "CASE label_id % 10 " + " ".join(f"WHEN {k} THEN CASE substr(made, 1, 2) " + " ".join(f"WHEN '{i:02d}' THEN '{some.split('|')[-1]}'" for i, some in enumerate(names.split(" "), 1)) + " END" for k, names in enumerate(L.MONTH_NAMES.values())) + " ELSE substr(made, 1, 2) END"
_YEAR = "CASE WHEN label_id % 10 = 1 THEN translate(substr(made, 4, 4), '0123456789', '०१२३४५६७८९') WHEN label_id % 3 = 0 THEN substr(made, 6, 2) ELSE substr(made, 4, 4) END"
DATES = f"SELECT label_id, concat(CASE WHEN label_id % 2 = 0 THEN concat(CAST(label_id % 28 + 1 AS STRING), CASE WHEN label_id % 10 = 9 THEN '-' ELSE ' ' END) ELSE '' END, {_MONTH}, CASE WHEN label_id % 10 = 9 THEN '.' ELSE ' ' END, {_YEAR}) AS text FROM {{label_truth}} WHERE made IS NOT NULL"


@query("c04_local_dates", "SELECT label_id, CASE WHEN label_id % 2 = 0 THEN lpad(CAST(label_id % 28 + 1 AS VARCHAR), 2, '0') || '/' ELSE '' END || made AS date FROM label_truth WHERE made IS NOT NULL", ("label_truth",))
def c04_local_dates(spark, d):
    text = spark.sql(DATES, label_truth=frame(spark, d, "label_truth"))
    return text.select("label_id", L.local_date(F.col("text")).alias("date"))


#: Every second label in full-width letters, with currency, quantity and digits of a script.
WIDE = "translate({}, 'abcdefghijklmnopqrstuvwxyz0123456789', 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９')"


@query("c05_normalized", "SELECT label_id, product_name || ' ₹' || CAST(amount AS VARCHAR) || ' ' || unit AS text FROM label_truth WHERE amount IS NOT NULL", ("label_truth",))
def c05_normalized(spark, d):
    t = frame(spark, d, "label_truth").filter("amount IS NOT NULL")
    name = F.when(F.col("label_id") % 2 == 0, F.expr(WIDE.format("product_name"))).otherwise(F.col("product_name"))
    digits = F.when(F.col("label_id") % 4 == 1, F.translate(F.col("amount").cast("string"), "0123456789", "०१२३४५६७८९")).otherwise(F.col("amount").cast("string"))
    return L.normalized(t.select("label_id", F.concat(name, F.lit("  Rs. "), digits, F.when(F.col("label_id") % 3 == 0, "").otherwise(" "), "unit").alias("text")), "text")
