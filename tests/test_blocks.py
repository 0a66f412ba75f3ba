"""Lists of several lines and states of prices."""

import pytest

from labelloom.operators import blocks, extraction


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ingredients: oats, salt\nand milk\n\nmore", ("oats, salt and milk", 88.0)),
        ("x\nINGREDIENTS\n" + "\n".join(f"part{i}" for i in range(12)), (" ".join(f"part{i}" for i in range(9)), 88.0)),
        ("Contains: wheat flour\nNet weight 5 g\nsalt", ("wheat flour", 88.0)),
        ("Ingredients: oats and salt", None),  # one line only
        ("Ingredients: - oat,salt(2%)x\ny", ("oat, salt (2%) x y", 88.0)),
        ("Ingredients: " + "a" * 400 + "\nb", ("a" * 350, 88.0)),
        ("Ingredients: " + "bcdfghjklmnp " * 3 + "\nb", ("bcdfghjklmnp bcdfghjklmnp bcdfghjklmnp b", 55.0)),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_lists(spark, text, want):
    rows = blocks.ingredient_lists(spark.createDataFrame([(1, text)], "label_id long, text string")).collect()
    assert [(r.ingredients, r.confidence) for r in rows] == ([want] if want else [])


def test_price_states(spark):
    texts = ["MRP Rs. 10", "MRP Rs. 10\nMRP Rs. 12", "MRP:", "M.R.P. stamped below", "no price", None, "MRP Rs. 10\nMRP Rs. 10.00"]
    labels = spark.createDataFrame(list(enumerate(texts, 1)), "label_id long, text string")
    got = {r.label_id: (r.status, r.confidence) for r in blocks.price_states(labels, extraction.candidates(labels)).collect()}
    assert got == {1: ("FOUND", 92.0), 2: ("CONFLICT", 92.0), 3: ("UNCERTAIN", 50.0), 4: ("NOT_FOUND", 0.0), 5: ("NOT_FOUND", 0.0), 6: ("NOT_FOUND", 0.0), 7: ("FOUND", 92.0)}
