"""Languages of texts by tokens, keyword index and declarations in several languages."""

import pytest

from labelloom.operators import tongues

KEYWORDS = [("hi", "mrp", "मूल्य"), ("hi", "mrp", "अधिकतम मूल्य"), ("en", "mrp", "MRP"), ("hi", "net_quantity", "शुद्ध मात्रा"), ("en", "manufacturer", "Mfg by"), ("hi", "manufacturing_date", "निर्माण तिथि"), ("en", "ingredients", "ingredients"), ("en", "consumer_care", "care"), ("en", "colour", "shade"), ("en", "mrp", " ")]


def spoken(spark, text):
    d = spark.createDataFrame([(7, text, "clash")], "id int, text string, languages string")
    r = tongues.text_languages(d, "id").first()
    return r.primary_language, r.primary_script, r.confidence, r.mixed, r.scripts, [(x.code, x.tokens) for x in r.languages]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ("en", "Latin", 1.0, False, ["Latin"], [("en", 0)])),
        (" \n", ("en", "Latin", 1.0, False, ["Latin"], [("en", 0)])),
        ("12 50% ₹", ("en", "Latin", 0.9, False, ["Latin"], [("en", 3)])),
        ("日本 ok", ("en", "Latin", 0.99, False, ["Latin"], [("en", 1)])),
        ("किंमत आहे मूल्य", ("mr", "Devanagari", 0.99, False, ["Devanagari"], [("mr", 3)])),
        ("किंमत मूल्य", ("hi", "Devanagari", 0.99, False, ["Devanagari"], [("hi", 2)])),
        ("पानी label", ("en", "Latin", 0.65, False, ["Devanagari", "Latin"], [("en", 1), ("hi", 1)])),
        ("জল জল label label", ("bn", "Bengali", 0.65, True, ["Bengali", "Latin"], [("bn", 2), ("en", 2)])),
        ("a " * 30 + "জল জল", ("en", "Latin", 0.9, False, ["Latin", "Bengali"], [("en", 30), ("bn", 2)])),
    ],
)
def test_languages_of_a_text(spark, text, want):
    assert spoken(spark, text) == want


def test_tokens_of_several_scripts(spark):
    d = spark.createDataFrame([(1, "MRPमूल्य abनी १२ 日本 वजन"), (2, None), (3, "")], "id int, text string")
    got = [tuple(r) for r in tongues.token_languages(d, "id").orderBy("pos").collect()]
    assert [(r[2], r[3], r[4], round(r[5], 3)) for r in got] == [("MRPमूल्य", "Devanagari", "hi", 0.63), ("abनी", "Latin", "en", 0.6), ("१२", "Neutral", "neutral", 1.0), ("日本", "Unknown", "und", 0.5), ("वजन", "Devanagari", "hi", 0.85)]


def test_rows_of_one_key_and_an_empty_table(spark):
    d = spark.createDataFrame([(None, "ok"), (None, "जल जल")], "id int, text string")
    assert [(r.id, r.primary_language, len(r.languages)) for r in tongues.text_languages(d, "id").collect()] == [(None, "hi", 2)]
    assert tongues.text_languages(d.limit(0), "id").count() == tongues.token_languages(d.limit(0), "id").count() == 0


def declared(spark, text):
    k = spark.createDataFrame(KEYWORDS, "language string, field string, keyword string")
    d = spark.createDataFrame([(1, text, "clash")], "label_id int, text string, head string").select("label_id", "text")
    return {r.field: (r.value, r.confidence, r.language, r.keyword) for r in tongues.local_declarations(d, k).collect()}


def test_declarations_by_keyword(spark):
    got = declared(spark, "अधिकतम मूल्य: ₹ ५०.००\nमूल्य 9\nशुद्ध मात्रा ५०० ग्राम\nनिर्माण तिथि: १५ फेब्रुवारी २०२४\nMFG BY:\nAcme Foods Ltd\nIngredients: salt\nsugar\nBatch 7\noil\nmy CARE line\nshade red")
    assert got == {
        "mrp": ("50.00", 94.0, "hi", "अधिकतम मूल्य"),
        "net_quantity": ("500 g", 94.0, "hi", "शुद्ध मात्रा"),
        "manufacturing_date": ("15/02/2024", 92.0, "hi", "निर्माण तिथि"),
        "manufacturer": ("Acme Foods Ltd", 88.0, "en", "mfg by"),
        "ingredients": ("Ingredients: salt sugar", 92.0, "en", "ingredients"),
        "consumer_care": ("my CARE line", 92.0, "en", "care"),
    }


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, {}), ("", {}), ("nothing here", {}),
        ("MRP see below\nMRP 60", {"mrp": ("60.00", 94.0, "en", "mrp")}),
        ("MRP 12/05/2024 Rs. 60.50", {"mrp": ("60.50", 94.0, "en", "mrp")}),
        ("Ｍｒｐ ９９", {"mrp": ("99.00", 94.0, "en", "mrp")}),
        ("xMFG BYx Zed Mills", {"manufacturer": ("x Zed Mills", 90.0, "en", "mfg by")}),
        ("शुद्ध मात्रा 30 g per 100 g", {}),
    ],
)
def test_lines_without_and_with_a_value(spark, text, want):
    assert declared(spark, text) == want


def test_a_very_long_line_meets_few_keywords(spark):
    assert declared(spark, "word " * 20_000 + "MRP 75")["mrp"][0] == "75.00"


def test_gaps_only_are_filled(spark):
    base = spark.createDataFrame([(1, "mrp", "50", "50", 92.0, "anchored", 0)], "label_id int, field string, raw string, value string, confidence double, method string, pos int")
    local = spark.createDataFrame([(1, "mrp", "60", 94.0, "hi", "k", 1), (1, "net_quantity", "5 g", 94.0, "hi", "k", 2), (2, "mrp", "7", 94.0, "hi", "k", 3)], "label_id int, field string, value string, confidence double, language string, keyword string, pos int")
    got = sorted((r.label_id, r.field, r.value, r.method) for r in tongues.filled(base, local).collect())
    assert got == [(1, "mrp", "50", "anchored"), (1, "net_quantity", "5 g", "multilingual"), (2, "mrp", "7", "multilingual")]
