"""Officers' corrections: last one of a field, sides by side, rules run again."""

import pytest

from labelloom.operators import extraction, reviews, rules

TEXT = "Rolled Oats\nMRP Rs. 60.00 incl. of all taxes\nNet Qty: 500 g\nManufactured by: Acme Foods, Pune\nIngredients: rolled oats, salt\nCustomer care: 1800-123-4567, care@acme.in"
FIX = "label_id int, field string, value string, officer string, reason string, at int"


@pytest.fixture(scope="module")
def declared(spark):
    return extraction.declarations(spark.createDataFrame([(1, TEXT), (2, TEXT), (3, "")], "label_id int, text string")).checkpoint()


def fixes(spark, *rows):
    return spark.createDataFrame(list(rows), FIX)


def test_the_last_correction_of_a_field_counts(spark):
    f = fixes(spark, (1, "mrp", " 5 ", "a", "r", 1), (1, "mrp", "7", "b", "s", 2), (1, "mrp", "8", "a", None, 2), (1, "brand", None, "a", "r", 9), (1, "colour", "red", "a", "r", 9))
    (row,) = reviews.last_corrections(f).collect()
    assert {k: (v.value, v.officer, v["at"]) for k, v in row.fixes.items()} == {"mrp": ("8", "a", 2)}


def test_sides_and_kinds_of_change(spark, declared):
    f = fixes(spark, (1, "mrp", "60.00", "a", "same", 1), (1, "consumer_care", "1800 1", "a", "r", 1))
    human = reviews.corrected(declared, f).unionByName(declared.filter("label_id = 2").replace("500 g", None, ["net_quantity"]).fillna({"brand": "Acme"}).replace("Acme Foods", "Zed", ["manufacturer"]))
    got = {(r.label_id, r.field): (r.ai_value, r.human_value, r.change_type, r.officer) for r in reviews.machine_vs_human(declared, human, f).collect()}
    assert len(got) == 3 * 14
    assert got[1, "mrp"] == ("60.00", "60.00", "CORRECTED", "a") and got[1, "consumer_care"] == ("1800-123-4567, care@acme.in", "1800 1", "CORRECTED", "a")
    assert got[2, "net_quantity"][2] == "REMOVED" and got[2, "brand"][2] == "ADDED" and got[2, "manufacturer"] == ("Acme Foods", "Zed", "CORRECTED", None)
    assert {v[2] for k, v in got.items() if k[0] == 3} == {"UNCHANGED"}


@pytest.mark.parametrize("text", [False, True])
def test_a_correction_decides_the_rules_that_depend_on_it(spark, declared, text):
    f = fixes(spark, (1, "fssai_license", "10012345678901", "a", "r", 1))
    checks = rules.evaluate(declared)
    after, scores = reviews.reevaluated(declared, checks, f, text)
    was, now = ({(r.label_id, r.rule_id): r.status for r in x.collect()} for x in (checks, after))
    assert len(now) == len(was) and was[1, "FS-001"] == "FAIL" and now[1, "FS-001"] == "PASS"
    assert {k: v for k, v in now.items() if k[0] != 1} == {k: v for k, v in was.items() if k[0] != 1}
    rows = {r.label_id: r for r in scores.collect()}
    assert rows[2].delta == 0 and rows[2].ai_score == rows[2].human_score and rows[1].delta == round(rows[1].human_score - rows[1].ai_score, 1)
    assert not text or rows[1].delta > 0


def test_without_corrections_nothing_changes(spark, declared):
    none = fixes(spark, (9, "mrp", "1", "a", "r", 1))
    checks = rules.evaluate(declared)
    for f in (none, none.limit(0)):
        after, scores = reviews.reevaluated(declared, checks, f)
        assert after.count() == checks.count() and {r.delta for r in scores.collect()} == {0.0}
    assert reviews.machine_vs_human(declared, reviews.corrected(declared, none), none).filter("is_changed").count() == 0
