"""Dates and normalised texts of ten languages."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from labelloom.functions import languages


def test_every_month_is_told(spark):
    rows = [(i, f"5 {w.title() if w.isascii() else w} 2025", f"05/{n}/2025") for i, (w, n) in enumerate(languages.months())]
    d = spark.createDataFrame(rows, "i int, text string, want string").select("text", "want", languages.local_date(F.col("text")).alias("got"))
    assert [(r.text, r.got) for r in d.collect() if r.got != r.want] == [] and len(rows) > 110


@pytest.mark.parametrize(
    ("text", "want"),
    [("JAN 26", "01/2026"), ("26 Mar", "26/03/2026"), ("March", "March"), ("१५ जनवरी २०२४", "15/01/2024"), ("0 May 2024", "05/2024"), ("12-8-25", "12/08/2025"), ("5/2024", "05/2024"), ("13/2024", "13/2024"), ("soon", "soon"), ("", ""), (None, None)],
)
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(languages.local_date(F.col("t"))).first()[0] == want


def test_compatibility_characters(spark):
    texts = ["ｆｕｌｌ ①", "ﬁne ½ kg", "plain", "नमस्ते", "", None, "Å"]
    got = languages.compatible(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t")
    assert {r.i: r.t for r in got.collect()} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    assert languages.normalized(spark.createDataFrame([("Ｒｓ.  ५०\t only",)], "t string"), "t").first().t == "₹50 only"


@pytest.mark.parametrize(("text", "want"), [("500gms", "500 g"), ("2 किलोग्राम", "2 kg"), ("1.5 litres net", "1.5 l net"), ("250 மி.லி", "250 ml"), ("10 గ్రా", "10 g"), ("5 goats", "5 goats"), ("12 pcs", "12 u"), ("रु. ५०", "₹50"), ("Rs.Rs. 5", "₹5"), ("bars 5", "bars 5"), (None, "")])
def test_units_and_currency(spark, text, want):
    assert languages.normalized(spark.createDataFrame([(text,)], "t string"), "t").first().t == want
