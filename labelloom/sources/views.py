"""The driver's tables seen as screenings, checks, products, registries and event logs.

Each view is one SELECT that Spark and DuckDB both run, over base tables or other
views named in braces. ``frame`` gives a view as a DataFrame; ``with_views`` puts
the views that a SQL text names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: The fourteen rules in evaluation order: id, field, label, domain, severity.
RULES = (
    ("LM-001", "manufacturer", "Manufacturer / Packer / Importer", "LEGAL_METROLOGY", "high"),
    ("LM-002", "product_name", "Common / Generic Name", "LEGAL_METROLOGY", "high"),
    ("LM-003", "net_quantity", "Net Quantity", "LEGAL_METROLOGY", "high"),
    ("LM-004", "mrp", "Maximum Retail Price", "LEGAL_METROLOGY", "high"),
    ("LM-005", "consumer_care", "Consumer Care", "LEGAL_METROLOGY", "medium"),
    ("LM-006", "country_of_origin", "Country of Origin", "LEGAL_METROLOGY", "medium"),
    ("LM-007", "unit_sale_price", "Unit Sale Price", "LEGAL_METROLOGY", "low"),
    ("LM-008", "manufacturing_date", "Date of Manufacture", "LEGAL_METROLOGY", "medium"),
    ("LM-009", "misleading_declaration", "Misleading Declaration", "LEGAL_METROLOGY", "medium"),
    ("FS-001", "fssai_license", "Licence Number", "FSSAI", "high"),
    ("FS-002", "food_name", "Food Name", "FSSAI", "high"),
    ("FS-003", "ingredients", "Ingredients", "FSSAI", "medium"),
    ("FS-004", "nutritional_info", "Nutritional Information", "FSSAI", "high"),
    ("FS-005", "date_marking", "Date Marking", "FSSAI", "high"),
)

_RULES = ", ".join(f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', '{r[4]}')" for i, r in enumerate(RULES))

VIEWS: dict[str, str] = {
    "rules": f"SELECT * FROM (VALUES {_RULES}) AS t(rule_no, rule_id, field, field_label, domain, severity)",
    "screenings": """
        SELECT o_orderkey AS id, o_orderkey % n.parts AS product_key, concat('Product ', CAST(o_orderkey % n.parts AS STRING)) AS product_name,
          c_name AS owner, c_nationkey AS organization, CAST(o_orderdate AS TIMESTAMP) AS created_at,
          CASE o_orderstatus WHEN 'O' THEN 'COMPLIANT' WHEN 'F' THEN 'POTENTIAL NON-COMPLIANCE' ELSE 'REVIEW REQUIRED' END AS status,
          CAST(40 + (o_orderkey * 37) % 61 AS DOUBLE) AS score, o_orderpriority AS priority
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey CROSS JOIN (SELECT count(*) AS parts FROM {part}) n""",
    "checks": """
        SELECT l_orderkey AS screening_id, l_linenumber AS line, r.rule_id, r.field, r.field_label, r.domain, r.severity,
          CASE WHEN l_returnflag = 'N' THEN 'PASS'
            WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'FAIL'
            WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'WARNING'
            WHEN l_returnflag = 'A' AND l_tax < 0.02 THEN 'INSUFFICIENT_EVIDENCE'
            WHEN l_returnflag = 'A' THEN 'NEEDS_REVIEW' ELSE 'NOT_APPLICABLE' END AS status,
          l_quantity * 2 AS reliability
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM {lineitem}) l
        JOIN {rules} r ON l.l_partkey % 14 = r.rule_no WHERE rn = 1""",
    "rule_checks": """
        SELECT screening_id, rule_id, field, field_label, domain, severity, status, reliability
        FROM (SELECT *, row_number() OVER (PARTITION BY screening_id, rule_id ORDER BY line) AS rn FROM {checks}) c WHERE rn = 1""",
    "versions": """
        SELECT id AS version_b, lag(id) OVER (PARTITION BY product_key ORDER BY created_at, id) AS version_a, product_key,
          score AS score_b, lag(score) OVER (PARTITION BY product_key ORDER BY created_at, id) AS score_a FROM {screenings}""",
    "pairs": "SELECT version_a, version_b, product_key, score_a, score_b FROM {versions} WHERE version_a IS NOT NULL",
    "attempts": """
        SELECT event_id, user_id AS key, CAST(ts AS TIMESTAMP) AS ts, event_type = 'error' AS failure, event_type = 'signup' AS success
        FROM {events} WHERE event_type IN ('error', 'signup')""",
    "reviews_log": """
        SELECT event_id, user_id AS review_id, CAST(ts AS TIMESTAMP) AS ts,
          CASE event_type WHEN 'view' THEN 'PENDING_REVIEW' WHEN 'click' THEN 'UNDER_REVIEW' WHEN 'purchase' THEN 'VERIFIED_COMPLIANT'
            WHEN 'error' THEN 'RESCAN_REQUESTED' ELSE 'VERIFIED_NON_COMPLIANT' END AS status
        FROM {events}""",
    "reviews": """
        SELECT review_id, status, ts AS updated_at, concat('officer-', CAST(review_id % 20 AS STRING)) AS officer, review_id % 25 AS organization,
          CASE review_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
        FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, event_id DESC) AS rn FROM {reviews_log}) r WHERE rn = 1""",
    "cache_rows": """
        SELECT event_id, event_type AS identifier_type, CAST(user_id % 100 AS STRING) AS identifier_value, CAST(ts AS TIMESTAMP) AS cached_at,
          CAST(floor(coalesce(value, 0)) AS BIGINT) AS ttl FROM {events}""",
    "products": """
        SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price,
          concat('890', lpad(CAST(p_partkey AS STRING), 9, '0')) AS code12 FROM {part}""",
}

#: Claims that label texts end with, by label_id % 26 (0 and 8 have none): text, rule (none for the open grammars), claim as found.
CLAIMS = {
    1: ("No preservatives", "CLAIM-RULE-ING-001", "no preservatives"),
    2: ("No added sugar", "CLAIM-RULE-NUT-001", "no added sugar"),
    3: ("High protein", "CLAIM-RULE-NUT-003", "high protein"),
    4: ("100% natural", "CLAIM-RULE-ING-002", "100% natural"),
    5: ("Immunity booster", "CLAIM-RULE-HLT-001", "immunity booster"),
    6: ("Low fat", "CLAIM-RULE-NUT-004", "low fat"),
    7: ("Made in India", "CLAIM-RULE-ORG-001", "made in india"),
    9: ("Sugar free", "CLAIM-RULE-NUT-002", "sugar free"),
    10: ("Zero cholesterol", "CLAIM-RULE-NUT-005", "zero cholesterol"),
    11: ("No artificial colours", "CLAIM-RULE-ING-003", "no artificial colours"),
    12: ("Chemical free", "CLAIM-RULE-ING-004", "chemical free"),
    13: ("Certified organic", "CLAIM-RULE-CRT-001", "organic"),
    14: ("Organic, NPOP 77", "CLAIM-RULE-CRT-001", "organic"),
    15: ("Cures diabetes", "CLAIM-RULE-MED-001", "cures diabetes"),
    16: ("Clinically proven", "CLAIM-RULE-MED-002", "clinically proven"),
    17: ("Best in India", "CLAIM-RULE-CMP-001", "best in india"),
    18: ("Eco friendly", "CLAIM-RULE-ENV-001", "eco friendly"),
    19: ("100% pure", "CLAIM-RULE-QLT-001", "100% pure"),
    20: ("ISO certified", "CLAIM-RULE-CRT-002", "iso certified"),
    21: ("Weight loss", "CLAIM-RULE-HLT-002", "weight loss"),
    22: ("Completely fresh", None, "completely fresh"),
    23: ("Treats headaches", None, "treats headaches"),
    24: ("Best for families", None, "best for families"),
    25: ("Premium quality", "CLAIM-RULE-QLT-002", "premium quality"),
}


def _claim(at: int) -> str:
    return "CASE p_partkey % 26 " + " ".join(f"WHEN {n} THEN '{c[at]}'" for n, c in CLAIMS.items() if c[at]) + " END"


#: Label texts rendered from part and supplier, so that what an extractor should find is known. Some lines are left out
#: or added on purpose: the price is missing where label_id % 7 = 3, the licence where % 13 = 5, all dates where % 19 = 6,
#: the shelf life where % 23 = 9; a bad unit stands where % 11 = 4, an earlier year of expiry where % 17 = 0, a second price
#: where % 37 = 8, a unit price where % 29 is 4 (above the price) or 5, another origin than India where % 93 = 0.
VIEWS["label_truth"] = f"""
    SELECT p_partkey AS label_id, p_partkey % 5 AS kind, s_suppkey AS supplier_id,
      concat(upper(substring(p_name, 1, 1)), substring(p_name, 2, 100), CASE p_partkey % 5 WHEN 0 THEN ' Oats' WHEN 1 THEN ' Juice' WHEN 2 THEN ' Noodles' WHEN 3 THEN ' Shampoo' ELSE ' Biscuit' END) AS product_name,
      p_brand AS brand, p_partkey % 5 <> 3 AS is_food,
      CASE WHEN p_partkey % 7 <> 3 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS price, p_partkey % 7 <> 3 AND p_partkey % 37 = 8 AS stamped,
      CASE p_partkey % 29 WHEN 4 THEN '9999' WHEN 5 THEN '1.5' END AS usp,
      CASE WHEN p_partkey % 11 <> 4 THEN p_size * 10 END AS amount, CASE WHEN p_partkey % 11 <> 4 THEN CASE WHEN p_partkey % 5 IN (1, 3) THEN 'ml' ELSE 'g' END END AS unit,
      CASE WHEN p_partkey % 13 <> 5 AND p_partkey % 5 <> 3 THEN concat('1', lpad(CAST(10 + s_nationkey AS STRING), 2, '0'), lpad(CAST(s_suppkey AS STRING), 11, '0')) END AS licence,
      concat('Supplier ', CAST(s_suppkey AS STRING), ' Foods Pvt Ltd') AS maker, concat('395', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0')) AS pin,
      CASE WHEN p_partkey % 19 <> 6 THEN concat(lpad(CAST(p_size % 12 + 1 AS STRING), 2, '0'), '/', CAST(2022 + p_size % 3 AS STRING)) END AS made,
      CASE WHEN p_partkey % 4 <> 1 AND p_partkey % 19 <> 6 AND p_partkey % 23 <> 9
        THEN concat(lpad(CAST(p_size % 12 + 1 AS STRING), 2, '0'), '/', CAST(2023 + p_size % 3 - CASE WHEN p_partkey % 17 = 0 THEN 3 ELSE 0 END AS STRING)) END AS best_before,
      p_partkey % 4 = 1 AND p_partkey % 19 <> 6 AND p_partkey % 23 <> 9 AS has_life,
      concat('B', CAST(p_partkey AS STRING), 'X', CAST(p_size AS STRING)) AS batch, concat('care', CAST(s_suppkey AS STRING), '@example.in') AS email,
      concat('1800-', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) AS phone,
      CASE p_partkey % 5 WHEN 0 THEN 'rolled oats, salt' WHEN 1 THEN 'water, mango pulp, sugar, ins 211' WHEN 2 THEN 'wheat flour, palm oil, salt' WHEN 4 THEN 'wheat flour, honey, sodium benzoate' END AS ingredients,
      CASE WHEN p_partkey % 5 <> 3 THEN p_size % 25 END AS protein, CASE WHEN p_partkey % 5 <> 3 THEN p_size % 9 END AS sugar, CASE WHEN p_partkey % 5 <> 3 THEN p_size % 7 END AS fat,
      CASE WHEN p_partkey % 93 = 0 THEN 'Nepal' WHEN p_partkey % 3 = 0 THEN 'India' END AS origin,
      {_claim(0)} AS claim_text, {_claim(1)} AS claim_rule, {_claim(2)} AS claim
    FROM {{part}} JOIN {{supplier}} ON p_partkey % (SELECT count(*) FROM {{supplier}}) = s_suppkey"""
VIEWS["label_text"] = """
    SELECT label_id, concat_ws(chr(10), product_name, concat('Brand: ', brand),
      CASE WHEN price IS NOT NULL THEN concat('MRP Rs. ', CAST(price AS STRING), CASE WHEN label_id % 2 = 0 THEN ' incl. of all taxes' ELSE '' END) ELSE 'MRP Rs.' END,
      concat('Net Qty: ', coalesce(CAST(amount AS STRING) || ' ' || unit, 'several zz')),
      concat('Manufactured by: ', maker, ', Plot ', CAST(supplier_id % 90 + 1 AS STRING), ', Industrial Estate, Surat', CASE WHEN label_id % 6 <> 0 THEN concat(' - ', pin) ELSE '' END),
      'FSSAI Lic. No. ' || licence, 'Mfg Date: ' || made, CASE WHEN has_life THEN 'Best before 12 months from manufacture' ELSE 'Best Before: ' || best_before END, concat('Batch No: ', batch),
      concat('Customer care: ', phone, ', ', email), 'Country of Origin: ' || origin, 'Ingredients: ' || ingredients,
      CASE WHEN is_food THEN concat('Nutrition Facts per 100 g: Protein ', CAST(protein AS STRING), ' g, Sugar ', CAST(sugar AS STRING), ' g, Total Fat ', CAST(fat AS STRING), ' g') END,
      claim_text, 'USP: ' || usp || ' per g', CASE WHEN stamped THEN 'MRP Rs. 9.50' END) AS text
    FROM {label_truth}"""
VIEWS["words"] = """
    SELECT label_id, line, pos, word, 20 + 10 * pos AS x, 30 * line AS y, 8 * length(word) AS w, 12 + label_id % 20 AS h, 60 + (label_id * 7 + pos) % 40 AS confidence
    FROM {label_words}"""


#: Words of labels with what evidence is told by: a maker's words missing where label_id % 10 = 3 ("by:" too where % 20 = 3), contacts where % 9 = 4, price
#: where % 14 = 5, tall words where % 16 = 1, and lines of their own for unit prices, origin, ingredients, nutrition and headings.
VIEWS["pack_words"] = """
    SELECT label_id, line, pos, word, x, y, w, CASE WHEN label_id % 16 = 1 AND line > 3 THEN h * 12 ELSE h END AS h, confidence FROM {words}
    WHERE NOT (label_id % 10 = 3 AND line = 5 AND pos > 2) AND NOT (label_id % 20 = 3 AND word = 'by:') AND NOT (label_id % 9 = 4 AND (word LIKE '1800-%' OR word LIKE 'care%@%')) AND NOT (label_id % 14 = 5 AND line = 3 AND pos > 1)
    UNION ALL
    SELECT label_id, line, pos, word, 30 + 90 * pos AS x, 30 * line AS y, 9 * length(word) AS w, 20 AS h, 50 + (label_id + pos) % 50 AS confidence
    FROM {label_truth} JOIN (
      SELECT 6 AS every, 0 AS rest, 40 AS line, 1 AS pos, 'UNIT' AS word UNION ALL SELECT 6, 0, 40, 2, 'SALE' UNION ALL SELECT 6, 0, 40, 3, 'PRICE' UNION ALL SELECT 6, 0, 40, 4, 'Rs' UNION ALL SELECT 6, 0, 40, 5, '2' UNION ALL SELECT 6, 0, 40, 6, '/' UNION ALL SELECT 6, 0, 40, 7, 'g'
      UNION ALL SELECT 6, 1, 40, 1, 'Unit' UNION ALL SELECT 6, 1, 40, 2, 'SalePrice:' UNION ALL SELECT 6, 2, 40, 1, 'unitsaleprice' UNION ALL SELECT 6, 2, 40, 2, 'stamp'
      UNION ALL SELECT 5, 1, 42, 1, 'List' UNION ALL SELECT 5, 1, 42, 2, 'of' UNION ALL SELECT 5, 1, 42, 3, 'Inoredients' UNION ALL SELECT 5, 3, 43, 1, 'SAMAGRI' UNION ALL SELECT 5, 3, 44, 1, 'namak'
      UNION ALL SELECT 4, 2, 46, 1, 'Nutritional' UNION ALL SELECT 4, 2, 46, 2, 'information' UNION ALL SELECT 4, 2, 47, 1, 'Energy' UNION ALL SELECT 4, 2, 47, 2, '50' UNION ALL SELECT 4, 2, 47, 3, 'kcal'
      UNION ALL SELECT 7, 1, 49, 1, 'MADEININDIA' UNION ALL SELECT 7, 2, 49, 1, 'Made' UNION ALL SELECT 7, 2, 49, 2, 'with' UNION ALL SELECT 7, 2, 49, 3, 'love' UNION ALL SELECT 7, 2, 49, 4, 'in' UNION ALL SELECT 7, 2, 49, 5, 'India'
      UNION ALL SELECT 3, 1, 51, 1, 'For' UNION ALL SELECT 3, 1, 51, 2, 'Feedback' UNION ALL SELECT 3, 1, 51, 3, 'write' UNION ALL SELECT 8, 5, 52, 1, 'Date' UNION ALL SELECT 8, 5, 52, 2, 'of' UNION ALL SELECT 8, 5, 52, 3, 'Manufacture'
    ) e ON label_id % every = rest"""


#: Texts whose name, brand and companies stand in changing places: by label_id % 4 the name first, after a slogan, after a recipe, or over two
#: lines; by % 6 a trademark, an owner, a handle, a site or no brand; by % 5 a marketer over lines, a manufacturer on one, packer and importer, no heading, no company.
VIEWS["pack_truth"] = """
    SELECT label_id, supplier_id, replace(product_name, ' Noodles', ' Pasta') AS name, label_id % 5 <> 3 AS goods FROM {label_truth}"""
VIEWS["pack_text"] = """
    SELECT label_id, concat_ws(chr(10),
      CASE label_id % 4 WHEN 1 THEN 'ENJOY THE TASTE' WHEN 2 THEN concat_ws(chr(10), 'RECIPE IDEAS', 'Potato chips', 'Tea biscuits', 'Rice cake', 'Sweet bread', 'Rolled oats') END,
      CASE WHEN label_id % 4 = 3 THEN concat(substring(name, 1, length(name) - length(kind) - 1), chr(10), kind) ELSE name END,
      CASE label_id % 6 WHEN 0 THEN concat('Acme', k, ' IS A REGISTERED TRADEMARK') WHEN 1 THEN concat('TM of Zeta', k, ' Holdings') WHEN 3 THEN concat('@sunny', k, 'official') WHEN 4 THEN concat('www.moon', k, '.com') END,
      CASE label_id % 5
        WHEN 0 THEN concat_ws(chr(10), 'Marketed by:', concat('Supplier ', k, ' Foods Pvt Ltd'), 'Plot 5, Ring Road', 'Surat, Gujarat 395007', 'Best Before 12 months, see pack')
        WHEN 1 THEN concat_ws(chr(10), concat('Manufactured by: Supplier ', k, ' Foods Pvt Ltd, Plot 9, Estate'), 'Delhi, 110001', 'MRP Rs 10')
        WHEN 2 THEN concat_ws(chr(10), concat('Packed by: Packhouse ', k, ' Agro, Nagar Road'), concat('Imported by: Harbour ', k, ' Enterprises, Sector 4'))
        WHEN 3 THEN concat_ws(chr(10), concat('Trade name: Supplier ', k, ' Foods Private Limited'), 'Plot 3, Ring Road, Delhi') END) AS text
    FROM (SELECT *, CAST(supplier_id AS STRING) AS k, reverse(substring(reverse(name), 1, position(' ' IN reverse(name)) - 1)) AS kind FROM {pack_truth}) p"""


#: Texts with ingredient lists of several lines, by label_id % 5: brackets and separators without spaces, a heading of its own, damaged words
#: (half and a ninth of all), and a list that is too short.
VIEWS["list_text"] = """
    SELECT label_id, concat_ws(chr(10), product_name, CASE label_id % 5
      WHEN 0 THEN concat_ws(chr(10), 'INGREDIENTS: Rolled oats,salt(5%)', concat('sugar;milk ', CAST(supplier_id AS STRING)), 'Allergen advice: nuts', 'none')
      WHEN 1 THEN concat_ws(chr(10), 'Inoredients', concat('wheat flour ', CAST(supplier_id AS STRING)), '(palm oil)salt', 'STORE IN a cool place')
      WHEN 2 THEN concat_ws(chr(10), 'Samagri: qwrtpsdfghjkl zxcvbnmlkjhgf oats', 'salt', 'MRP Rs 5')
      WHEN 3 THEN concat_ws(chr(10), 'COMPOSITION - one two three four five six seven', 'qwrtpsdfghjkl tail', 'Batch 7')
      ELSE concat_ws(chr(10), 'Ingredients: salt', 'MRP Rs 5') END) AS text FROM {label_truth}"""


#: Labels that one task renders, at most, as keys are spread evenly; and those that one task renders and groups into whole labels again.
TASK_LABELS, TASK_PAGES = 50_000, 10_000


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: label_words in SQL; the frame is built with explode.
LABEL_WORDS = """SELECT label_id, line, CAST(pos AS INT) AS pos, word FROM (
  SELECT label_id, line, unnest(string_split(content, ' ')) AS word, generate_subscripts(string_split(content, ' '), 1) AS pos FROM (
    SELECT label_id, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line FROM {label_text}) l) w"""


ALL = VIEWS | {"label_words": LABEL_WORDS}


def label_words(label_text: DataFrame) -> DataFrame:
    lines = label_text.select("label_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    words = lines.select("label_id", (F.col("line") + 1).alias("line"), F.posexplode(F.split("content", " ")).alias("pos", "word"))
    return words.select("label_id", "line", (F.col("pos") + 1).alias("pos"), "word")


#: The lines of their own of pack_words: label_id % every = rest, line, words.
PACK_LINES = (
    (6, 0, 40, "UNIT SALE PRICE Rs 2 / g"), (6, 1, 40, "Unit SalePrice:"), (6, 2, 40, "unitsaleprice stamp"), (5, 1, 42, "List of Inoredients"), (5, 3, 43, "SAMAGRI"), (5, 3, 44, "namak"), (4, 2, 46, "Nutritional information"),
    (4, 2, 47, "Energy 50 kcal"), (7, 1, 49, "MADEININDIA"), (7, 2, 49, "Made with love in India"), (3, 1, 51, "For Feedback write"), (8, 5, 52, "Date of Manufacture"),
)


def pack_words(label_text: DataFrame) -> DataFrame:
    """The view of that name, without its union: a label's words all come from its row, so they stay where that is."""
    own = F.transform(F.split("text", "\n"), lambda content, i: F.struct((i + 1).alias("line"), content.alias("content")))
    more = F.array_compact(F.array(*(F.when(F.col("label_id") % every == rest, F.struct(F.lit(line).alias("line"), F.lit(words).alias("content"))) for every, rest, line, words in PACK_LINES)))
    lines = label_text.select("label_id", F.inline(F.concat(own, more)))
    words = lines.select("label_id", "line", F.posexplode(F.split("content", " ")).alias("pos", "word")).select("label_id", "line", (F.col("pos") + 1).alias("pos"), "word")
    left_out = """label_id % 10 = 3 AND line = 5 AND pos > 2 OR label_id % 20 = 3 AND word = 'by:' OR label_id % 9 = 4 AND (word LIKE '1800-%' OR word LIKE 'care%@%') OR label_id % 14 = 5 AND line = 3 AND pos > 1"""
    added = lambda a, b: f"CASE WHEN line >= {PACK_LINES[0][2]} THEN {a} ELSE {b} END"
    return words.filter(added("true", f"NOT ({left_out})")).selectExpr(
        "label_id", "line", "pos", "word", f"{added('30 + 90 * pos', '20 + 10 * pos')} AS x", "30 * line AS y", f"{added('9', '8')} * length(word) AS w",
        f"{added('20', '(12 + label_id % 20) * CASE WHEN label_id % 16 = 1 AND line > 3 THEN 12 ELSE 1 END')} AS h", f"{added('50 + (label_id + pos) % 50', '60 + (label_id * 7 + pos) % 40')} AS confidence",
    )


def frame(spark: SparkSession, sf_dir: str, name: str, _seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or view as a DataFrame."""
    seen = {} if _seen is None else _seen
    if name not in seen:
        if name in BASE:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        elif name == "label_words":
            seen[name] = label_words(frame(spark, sf_dir, "label_text", seen))
        elif name == "pack_words":
            seen[name] = pack_words(frame(spark, sf_dir, "label_text", seen))
        else:
            parts = {d: frame(spark, sf_dir, d, seen) for d in _names(VIEWS[name])}
            if name == "label_truth":
                # A short row of part becomes a long text and some eighty words. A file of few splits would be rendered by few
                # tasks, and without a number Spark would merge the short rows into few partitions again.
                # More labels make more partitions, so that what a task sorts or hashes does not grow with the table.
                tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts["part"].count() // TASK_LABELS))
                parts["part"] = parts["part"].repartition(tasks, "p_partkey")
            seen[name] = spark.sql(VIEWS[name], **parts)
    return seen[name]


def dealt(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Views of label_truth as frame gives them, the rows of a label in one partition and by label_id alike in all of them."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-frame(spark, sf_dir, "part").count() // TASK_PAGES))
    seen = {"label_truth": frame(spark, sf_dir, "label_truth").repartition(tasks, "label_id")}
    return [frame(spark, sf_dir, n, seen) for n in names]


def with_views(sql: str, *names: str) -> str:
    """sql with the named views, and those that they need, as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in BASE or name in order:
            return
        for d in _names(ALL[name]):
            need(d)
        order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({ALL[n].format(**{d: d for d in _names(ALL[n])})})" for n in order]
    body = sql.strip()
    if not parts:
        return body
    start = next((k for k in ("WITH RECURSIVE ", "WITH ") if body.startswith(k)), None)
    return f"{start}{', '.join(parts)}, {body[len(start):]}" if start else f"WITH {', '.join(parts)} {body}"
