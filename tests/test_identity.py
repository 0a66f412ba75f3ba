"""Companies, brands and names on texts that keep to no order."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import identity as I


def labels(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "label_id long, text string")


def companies(spark, *texts):
    return {(r.label_id, r.role): (r.company, r.address) for r in I.entities(labels(spark, *texts)).collect()}


def test_roles_are_told_apart(spark):
    text = "Mktd by Bright Foods Pvt. Ltd.\nTower Road\nMumbai 400001\nPacked by\nNorth Agro, Sector 9\nNOIDA, UP\nImported by: Sea Enterprises\nNear Port"
    got = companies(spark, text)
    assert got[1, "marketed_by"] == ("Bright Foods Pvt. Ltd", "Tower Road, Mumbai 400001")
    assert got[1, "packer"] == ("North Agro", "Sector 9, NOIDA, UP")
    assert got[1, "importer"] == ("Sea Enterprises", "Near Port")


def test_the_block_that_says_most_wins(spark):
    got = companies(spark, "Manufactured by Xy Agro\nBatch 1\nsee flap\nManufactured by: Sunrise Foods Private Limited\nPlot 4, Surat, Gujarat 395007")
    assert got[1, "manufacturer"][0].startswith("Sunrise Foods")
    assert "395007" in got[1, "manufacturer"][1]


def test_blocks_end_at_headings_and_at_300_characters(spark):
    got = companies(spark, "Mfg by\nMRP Rs 5\nLate Industries", "Mfg by " + "x " * 150 + "\nLate Industries\nMfd by Fine Bakers", "Mfg by Fine Bakers\nProtein Road 5 g\nHill Road")
    assert (1, "manufacturer") in got  # from the whole text
    assert got[2, "manufacturer"][0] == "Fine Bakers"
    assert got[3, "manufacturer"] == ("Fine Bakers", "Hill Road")


def test_whole_text_where_no_heading_helps(spark):
    got = companies(spark, "(Delta Snacks)\nPlot 7, Hill Road, Delhi", "nothing", None, "", "Marketed by:\nsee (Delta Snacks) store")
    assert got[1, "manufacturer"] == ("Delta Snacks", "Plot 7, Hill Road, Delhi")
    assert set(k[0] for k in got) == {1, 5} and (5, "marketed_by") in got


def test_addresses_before_a_company_are_cut(spark):
    raw = spark.createDataFrame([("OF THE Unilever House, Big Foods Ltd",), ("By: Plain Foods Ltd.",), ("Flat 5",)], "c string")
    assert [r.n for r in raw.select(I.company_name(F.col("c")).alias("n")).collect()] == ["Big Foods Ltd", "Plain Foods Ltd", "Flat 5"]


def names(spark, *texts, brand=None, words=None):
    b = spark.createDataFrame(brand or [], "label_id long, brand string")
    return {r.label_id: (r.product_name, r.score) for r in I.product_names(labels(spark, *texts), b, words).collect()}


def test_blocks_are_passed_over(spark):
    recipe = "\n".join(["Recipe", "masala oats", "tea cake", "rice cake", "sweet bread", "milk rusk", "Corn Chips"])
    inside = "\n".join(["INGREDIENTS", "rice", "RECIPE", *["sweet cake"] * 5, *["butter cake"] * 7, "Corn Chips"])
    table = "\n".join(["Nutrition Facts", *["bread cake"] * 10, "Corn Chips"])
    got = names(spark, recipe, inside, table)
    assert {k: v[0] for k, v in got.items()} == {1: "Corn Chips", 2: "Corn Chips", 3: "Corn Chips"}
    assert got[1][1] == 45 + 15 + 10 + 25


def test_short_lines_are_read_together(spark):
    got = names(spark, "Golden\nRolled Oats\nPure", "Tea", "Tea", brand=[(2, "Acme"), (3, "Tea Time")])
    assert got[1] == ("Golden Rolled Oats", 35 + 25 + 15 + 45 + 45 + 50)
    assert 2 not in got  # three letters are too few for a name


def test_single_common_words_take_the_brand(spark):
    assert names(spark, "Juice", "Juice", brand=[(1, "Acme"), (2, "Juice")]) == {1: ("Acme Juice", 100.0), 2: ("Juice", 100.0)}


@pytest.mark.parametrize("text", ["Made in India", "5 star bar", "A, B and C", "Acme Pvt", "one two three four five six seven", "abc", "Zero Juice", "x" * 61, "", None])
def test_no_names(spark, text):
    assert names(spark, text) == {}


def test_claims_speak_against_a_name(spark):
    assert names(spark, "Authentic Pure Taste") == {} and names(spark, "Authentic Rice Taste")[1][1] == 35 + 45 + 25 + 15 - 60
    assert names(spark, "25g Protein Bar") == {}  # digits first are no name
    assert names(spark, "With 25g protein oats") == {1: ("With 25G Protein Oats", 35 + 45 + 25 - 50)}


WORDS = "label_id long, line int, pos int, word string, x int, y int, w int, h int, confidence int"


def test_tall_words_below_each_other(spark):
    rows = [(1, 1, 1, "SUPER", 10, 0, 90, 40, 90), (1, 2, 1, "OATS!", 20, 50, 80, 40, 90), (1, 3, 1, "small", 10, 95, 50, 10, 90), (1, 4, 1, "far", 500, 100, 50, 40, 90), (1, 5, 1, "100%", 10, 140, 50, 40, 90), (1, 6, 1, "Blurry", 10, 190, 50, 40, 30)]
    words = spark.createDataFrame(rows, WORDS)
    assert {r.phrase for r in I.tall_words(words).collect()} == {"SUPER", "SUPER OATS", "OATS", "far"}
    assert names(spark, "plain text of no use here at all", words=words)[1][0] == "Super Oats"


def brand(spark, text, company=None, words=None, front=None):
    t = spark.createDataFrame([(1, text, front)], "label_id long, text string, front string")
    c = spark.createDataFrame([(1, company)], "label_id long, company string")
    return [(r.brand, r.source) for r in I.brands(t if front else t.drop("front"), c, words).collect()]


def test_sources_of_a_brand_in_their_order(spark):
    words = spark.createDataFrame([(1, 1, 1, "KING", 0, 0, 90, 50, 90), (1, 1, 2, "sugar", 0, 0, 200, 50, 90)], WORDS)
    text = "ACME is a registered trademark. TM of Zeta Co. King size. Sunny Hill Foods Pvt Ltd @mooncare www.star.com"
    assert brand(spark, text, "Sunny Hill Foods", words) == [("Acme", "trademark")]
    assert brand(spark, text.replace("ACME", "this"), "Sunny Hill Foods", words) == [("Zeta", "owner")]
    rest = text.split(". ", 2)[2]
    assert brand(spark, rest, "Sunny Hill Foods", words) == [("King", "front word")]
    assert brand(spark, rest, "Sunny Hill Foods") == [("Sunny Hill", "company")]
    assert brand(spark, rest, "Absent Foods") == [("Moon", "handle")]
    assert brand(spark, "see www.star.com") == [("Star", "handle")]
    assert brand(spark, "x", front="Best before 5\nLight House\nMore") == [("Light House", "front line")]
    assert brand(spark, "nothing") == [] and brand(spark, None) == []
