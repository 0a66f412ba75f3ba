"""The word index: keys meet whatever matches, spans grow as the rules say, choices keep to their order."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from labelloom.operators import evidence, locate

WORDS = "label_id long, line int, pos int, word string, x int, y int, w int, h int, confidence int"


def some_pairs():
    rng = random.Random(4)
    stems = ["mrp", "mfg", "mfd", "exp", "expiry", "usp", "ingredient", "ingredients", "ingred", "inored", "saleprice", "unitsaleprice"]
    made = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    words = stems + [s + t for s in stems for t in ("", "x", "123456789")] + made + ["", "g", "kg"]
    return sorted({(a, b) for a in words for b in [*stems, *made[:30], "g", ""]})


def test_keys_meet_all_that_match(spark):
    pairs = some_pairs()
    d = spark.createDataFrame(pairs, "a string, b string")
    meets = F.arrays_overlap(locate.word_keys(F.col("a")), locate.target_keys(F.col("b")))
    rows = d.select("a", "b", locate.same(F.col("a"), F.col("b")).alias("same"), meets.alias("meets")).collect()
    assert sum(r.same for r in rows) > 100
    assert all(r.same == locate.same_text(r.a, r.b) for r in rows)
    assert all(r.meets for r in rows if r.same)


def test_places_are_those_of_all_that_match():
    words, targets = (sorted(x) for x in map(set, zip(*some_pairs(), strict=True)))
    flat = [1] * len(words)
    p = locate.Page(words, flat, flat, flat, flat)
    assert all(p.places(t) == [i for i, w in enumerate(words) if locate.same_text(w, t)] for t in targets)
    assert sum(len(p.places(t)) for t in targets) > 100


def page(text, dx=40, dy=30, h=20):
    return [(1, i, j, w, dx * j, dy * i, 8 * len(w), h, 90 - j) for i, line in enumerate(text.split("\n"), 1) for j, w in enumerate(line.split(" "), 1)]


def found(spark, text, phrase, **kw):
    words = spark.createDataFrame(page(text, **kw), WORDS)
    out = locate.sequences(words, spark.createDataFrame([("p", phrase.split(" "))], "name string, targets array<string>")).collect()
    return [(r.line, r.pos, r.n_words) for r in out]


def test_spans_skip_two_words_in_all(spark):
    assert found(spark, "best a before b end", "best before end") == [(1, 1, 3)]
    assert found(spark, "a b c d e f", "a c f", dx=30) == [(1, 1, 2)]
    assert found(spark, "best a b c before", "best before") == []
    assert found(spark, "net\nweight", "net weight") == [(1, 1, 2)]
    assert found(spark, "net\nx\nx\nweight", "net weight", dy=90) == []
    assert found(spark, "net weight", "net weight", dx=400) == []
    assert found(spark, "best x\nbest before", "best before") == [(1, 1, 2)]


def test_lines_and_clusters(spark):
    words = spark.createDataFrame(page("INGREDIENTS: oats\nsalt sugar\nenergy 5\n\nfar away"), WORDS)
    line = locate.same_line(words, spark.createDataFrame([("ingredients",)], "target string")).first()
    assert line.text == "INGREDIENTS: oats" and (line.n_words, line.confidence) == (2, 88)
    near = locate.cluster(words, spark.createDataFrame([("ingredients", 2, 300)], "target string, below int, width int")).first()
    assert near.text == "INGREDIENTS: oats salt sugar energy 5"
    assert locate.same_line(words, spark.createDataFrame([("absent",)], "target string")).collect() == []


def test_own_anchors_keep_to_their_label(spark):
    rows = page("alpha one") + [(2, *r[1:]) for r in page("beta two")]
    words = spark.createDataFrame(rows, WORDS)
    own = spark.createDataFrame([(1, "beta"), (2, "beta")], "label_id long, target string")
    assert [r.label_id for r in locate.same_line(words, own).collect()] == [2]


def test_handles_are_cut_at_known_words(spark):
    d = spark.createDataFrame([("alpinohealthfoods",), ("Foods",), ("zzz",), ("abcdefgh",), ("@sunnyagro2",)], "h string")
    assert [r.w for r in d.select(evidence.handle_words(F.col("h")).alias("w")).collect()] == [["alpino", "health", "food"], ["foods"], ["zzz"], ["abcdefgh"], ["sunny", "agro"]]


def choose(spark, text, values, checks, **kw):
    words = spark.createDataFrame(page(text, **kw), WORDS)
    fields = ("manufacturer", "product_name", "brand", "net_quantity", "mrp", "consumer_care_phone", "consumer_care_email", "fssai_license", "best_before", "manufacturer_address")
    d = spark.createDataFrame([(1, *(values.get(f) for f in fields))], "label_id long, " + ", ".join(f"{f} string" for f in fields))
    c = spark.createDataFrame([(1, r, s, v) for r, s, v in checks], "label_id long, rule_id string, status string, value string")
    out = evidence.evidence_choice(words, evidence.value_anchors(d), c)
    return {(r.rule_id, r.item): r for r in out.collect()}


def test_second_items(spark):
    got = choose(spark, "Made by Acme\nPlot Nine Surat\ncall 1800-123-456\nmail hi@acme.in", {"manufacturer": "Acme Foods", "manufacturer_address": "Plot Nine Surat", "consumer_care_phone": "1800-123-456", "consumer_care_email": "hi@acme.in"}, [("LM-001", "PASS", "Acme"), ("LM-005", "PASS", None)])
    assert got["LM-005", 1].text == "call 1800-123-456" and got["LM-005", 2].text == "mail hi@acme.in"
    assert got["LM-001", 1].text == "Plot Nine Surat" and ("LM-001", 2) not in got


def test_contacts_in_a_nutrition_table_do_not_count(spark):
    got = choose(spark, "Energy 1800-123-456\nfor feedback write", {"consumer_care_phone": "1800-123-456"}, [("LM-005", "PASS", None)])
    assert (got["LM-005", 1].text, got["LM-005", 1].evidence_status) == ("for feedback", "CONTEXTUAL")


def test_unit_price_by_its_line(spark):
    for text, status, value, want in (("unit sale price Rs 2 / g", "PASS", None, ("DIRECT_OCR", "VERIFIED", 7)), ("unit sale price", "PASS", "x", ("DIRECT_OCR", "VERIFIED", 3)), ("unit sale price", "NEEDS_REVIEW", None, ("CONTEXTUAL_OCR", "CONTEXTUAL", 3)), ("unit sale price 2 per g", "FAIL", None, ("DIRECT_OCR", "CONTEXTUAL", 6))):
        r = choose(spark, text, {}, [("LM-007", status, value)])["LM-007", 1]
        assert (r.method, r.evidence_status, r.n_words) == want


def test_bad_and_large_boxes_are_reviewed(spark):
    tall = choose(spark, "net weight", {}, [("LM-003", "PASS", None)], h=400)["LM-003", 1]
    assert (tall.evidence_status, tall.reliability, tall.tier) == ("NEEDS_REVIEW", 65.0, "LOW")
    bad = choose(spark, "net weight", {}, [("LM-003", "PASS", None)], dx=-60)["LM-003", 1]
    assert (bad.evidence_status, bad.method, bad.x) == ("NEEDS_REVIEW", "SEMANTIC_PANEL", None)


def test_no_words_give_defaults(spark):
    got = choose(spark, "nothing here", {}, [(r, s, None) for r, s in (("LM-009", "WARNING"), ("LM-008", "NOT_APPLICABLE"), ("LM-003", "FAIL"), ("FS-005", "NEEDS_REVIEW"), ("LM-006", "PASS"))])
    assert {k[0]: (r.method, r.evidence_status) for k, r in got.items()} == {"LM-009": ("NONE", "VERIFIED"), "LM-008": ("NONE", "NOT_APPLICABLE"), "LM-003": ("NONE", "UNAVAILABLE"), "FS-005": ("SEMANTIC_PANEL", "NEEDS_REVIEW"), "LM-006": ("TOKEN_SEQUENCE", "VERIFIED")}


def test_labels_of_a_batch_are_told_apart(monkeypatch):
    """Rows go in slices; words, anchors or both may be missing."""
    monkeypatch.setattr(evidence, "PAGES", 2)
    anchor = lambda *targets: dict(zip(evidence.ANCHOR, ("R", "main", 0, "LINE", list(targets), 0, 0), strict=True))
    own = pa.list_(pa.struct([(c, pa.list_(pa.string()) if c == "targets" else pa.int32() if c in ("ord", "below", "width") else pa.string()) for c in evidence.ANCHOR]))
    some = [["mrp", "oats"], None, ["oats"], [], ["salt", "oats"]]
    number = pa.array([None if s is None else list(range(len(s))) for s in some], pa.list_(pa.int32()))
    words = pa.array(some, pa.list_(pa.string()))
    ids, nothing = pa.array(range(5)), pa.nulls(5)
    b = pa.RecordBatch.from_arrays([ids, nothing, pa.array([[anchor("oats")], [anchor("oats")], None, [], [anchor("sugar"), anchor("salt")]], own), words, words, number, number, number, number, number], names=["label_id", "checks", "anchors", *evidence._WORD])
    fixed = [("F", "main", 100, "LINE", ["oats"], 0, 0)]
    out = [r for x in evidence._first_met(fixed, ("F",))(iter([b])) for r in x.to_pylist()]
    got = {r["label_id"]: {p["rule_id"]: (p["own"]["text"], p["own"]["n_words"], p["beside"] and p["beside"]["right"]) for p in r["shown"]} for r in out}
    both = ("mrp oats", 2, None)
    assert got == {0: {"R": both, "F": (*both[:2], 2.0)}, 1: {}, 2: {"F": ("oats", 1, 0.0)}, 3: {}, 4: {"R": ("salt oats", 2, None), "F": ("salt oats", 2, 2.0)}}
