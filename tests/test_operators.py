"""Small hand-made cases of operators and column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from labelloom.functions import columns as C
from labelloom.operators import claims, dashboards, evidence, extraction, jobs, locate, reconcile, rules, scoring, selection, timeline
from labelloom.sources import exports


def one(spark, *exprs, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return tuple(df.select(*exprs).first())


def test_digits_units_currency(spark):
    got = one(spark, C.indic_digits(F.lit("१२३ ৪৫")), C.units(F.lit("2 kilograms, 5 gms, 1 litre")), C.currency(F.lit("Rs. 20 rupees 30")))
    assert got == ("123 45", "2 kg, 5 g, 1 L", "₹ 20 ₹ 30")


@pytest.mark.parametrize("text,want", [("05/2024", "05/2024"), ("5-3-24", "05/03/2024"), ("12 March 2024", "12/03/2024"), ("Mar 2024", "03/2024"), ("soon", "soon")])
def test_label_date(spark, text, want):
    assert one(spark, C.label_date(F.lit(text)))[0] == want


@pytest.mark.parametrize("code,valid", [("8901234567890", True), ("8901234567894", False), ("96385074", True), ("12", False), (None, False)])
def test_gtin(spark, code, valid):
    assert one(spark, C.gtin_valid(F.lit(code).cast("string")))[0] is valid


def test_licence(spark):
    got = one(spark, C.licence_valid(F.lit("10012345678901")), C.licence_tier(F.lit("10012345678901")), C.licence_tier(F.lit("31")), C.repaired_licence(F.lit("FSSAI Lic: 1OO12345678901")))
    assert got == (True, "CENTRAL", "INVALID", "10012345678901")


def test_payload_and_gs1(spark):
    got = one(spark, C.payload_licence(F.lit('{"fssai": "10012345678901"}')), C.payload_licence(F.lit("(423)10012345678901")), C.gs1_field(F.lit("https://x/01/0890/10/L7?17=251231"), "10"))
    assert got == ("10012345678901", "10012345678901", "L7")


def test_repairs(spark):
    got = one(spark, C.repaired_quantity(F.lit("400 9")), C.repaired_price(F.lit("Rs 45,50")).cast("string"), C.repaired_price(F.lit("12/05/2024")), C.repaired_date(F.lit("O5-2O24")), C.repaired_batch(F.lit("Batch No: SEE B12X")))
    assert got[:3] == ("400 g", "45.50", None) and got[4] == "B12X"


def test_safe_text(spark):
    got = one(spark, C.spreadsheet_safe(F.lit("=1+1")), C.spreadsheet_safe(F.lit("a=b")), C.sanitised(F.lit("<script>x\x01</a>")))
    assert got == ("'=1+1", "a=b", "[removed]&gt;x&lt;/a&gt;")


def test_utc(spark):
    a, b, c = one(spark, C.utc(F.lit("2024-01-01T00:00:00Z")), C.utc(F.lit("2024-01-01T05:30:00+05:30")), C.utc(F.lit("no date")))
    assert a == b == datetime.datetime(2024, 1, 1) and c is None


def checks(spark, *statuses, severity="high"):
    return spark.createDataFrame([(1, f"R{i}", "f", "F", "FSSAI", severity, s, 80.0) for i, s in enumerate(statuses)], "screening_id long, rule_id string, field string, field_label string, domain string, severity string, status string, reliability double")


@pytest.mark.parametrize(
    "statuses,score,status,level,risk",
    [
        (("PASS", "PASS"), 100.0, "COMPLIANT", "LOW", 5.0),
        (("PASS", "FAIL"), 50.0, "POTENTIAL NON-COMPLIANCE", "CRITICAL", 90.0),
        (("PASS", "WARNING"), 75.0, "REVIEW REQUIRED", "LOW", 25.0),
        (("PASS", "NEEDS_REVIEW", "NEEDS_REVIEW"), 90.0, "REVIEW REQUIRED", "MEDIUM", 45.0),
        (("NOT_APPLICABLE",), 100.0, "COMPLIANT", "LOW", 5.0),
        (("PASS", "INSUFFICIENT_EVIDENCE"), 75.0, "REVIEW REQUIRED", "MEDIUM", 40.0),
    ],
)
def test_scores(spark, statuses, score, status, level, risk):
    r = scoring.scores(checks(spark, *statuses)).first()
    assert (r.score, r.status, r.risk_level, r.risk_score) == (score, status, level, risk)


def test_general_failures_and_conflicts(spark):
    r = scoring.scores(checks(spark, "FAIL", "FAIL", severity="low")).first()
    assert (r.risk_level, r.risk_score) == ("HIGH", 77.0)
    c = spark.createDataFrame([(1, "CHRONOLOGICAL_INCONSISTENCY")], "screening_id long, conflict_type string")
    r = scoring.scores(checks(spark, "PASS"), c).first()
    assert (r.risk_level, r.risk_score) == ("CRITICAL", 88.0)


def test_empty_checks(spark):
    none = checks(spark, "PASS").limit(0)
    assert scoring.scores(none).count() == 0 and scoring.category_scores(none).count() == 0 and dashboards.panel_zones(none).count() == 0


def test_outcome_by_counts_then_text(spark):
    o = lambda f, r, p, s: one(spark, dashboards.outcome(F.lit(f), F.lit(r), F.lit(p), F.lit(s).cast("string")))[0]
    assert [o(1, 0, 5, "COMPLIANT"), o(0, 1, 5, "x"), o(0, 0, 1, "FAIL"), o(0, 0, 0, "potential non-compliance"), o(0, 0, 0, None)] == ["FAILURE", "NEEDS_REVIEW", "COMPLIANT", "FAILURE", "NEEDS_REVIEW"]


def test_penalties(spark):
    v = spark.createDataFrame([(1, "high"), (1, "low"), (2, "low"), (3, "high")] + [(4, "high")] * 40, "screening_id long, severity string")
    prior = spark.createDataFrame([(3, 1)], "screening_id long, notices int")
    got = {r.screening_id: (r.fine, r.fine_least) for r in dashboards.penalties(v, prior).collect()}
    assert got == {1: (13000, 6500), 2: (3500, 1750), 3: (17500, 8750), 4: (25000, 12500)}


def test_scope_is_closed(spark):
    s = spark.createDataFrame([(1, 5, "Ann"), (2, 6, "Bo"), (3, None, "Ann")], "id long, organization int, owner string")
    ids = lambda *a: sorted(r.id for r in selection.scope(s, *a).collect())
    assert [ids("ADMIN"), ids("AUDIT_OFFICER", 5), ids("AUDIT_OFFICER"), ids("MERCHANT_PUBLIC", 5, "ann"), ids("MERCHANT_PUBLIC", 6, "ann"), ids("OTHER", 5)] == [[1, 2, 3], [1], [], [1], [], []]


def test_upsert_last_wins(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1), (3, "f", 1)], "k int, v string, t int")
    got = {r.k: r.v for r in selection.upsert(base, new, ["k"], "t", "v").collect()}
    assert got == {1: "c", 2: "b", 3: "f"}


LABEL = """Mango Juice
Brand: Sunny
MRP Rs. 45.00 incl. of all taxes
Net Qty: 200 ml
Manufactured by: Sunny Foods Pvt Ltd, Plot 4, Surat - 395001
FSSAI Lic. No. 10012345678901
Mfg Date: 01/2024
Best before 12 months from manufacture
Customer care: 1800-123-4567, care@sunny.in
Ingredients: water, mango pulp, sugar
Nutrition Facts per 100 g: Protein 2 g, Sugar 11 g"""


def labels(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "label_id long, text string")


def test_extraction_of_one_label(spark):
    d = extraction.declarations(labels(spark, LABEL)).first()
    assert (d.product_name, d.brand, d.mrp, d.net_quantity, d.manufacturer) == ("Mango Juice", "Sunny", "45.00", "200 ml", "Sunny Foods Pvt Ltd")
    assert (d.fssai_license, d.manufacturing_date, d.relative_shelf_life, d.consumer_care_phone) == ("10012345678901", "01/2024", "12 MONTHS FROM MANUFACTURE", "1800-123-4567")


@pytest.mark.parametrize(
    "line,field,value,confidence",
    [
        ("Customer care: 0120-2400286", "consumer_care_phone", "0120-2400286", 93.0),
        ("Call us +91-98765 43210", "consumer_care_phone", "+91-98765 43210", 92.0),
        ("+91 9876543210", "consumer_care_phone", "+91 9876543210", 90.0),
        ("Toll Free 1800-10-22-221", "consumer_care_phone", "1800-10-22-221", 95.0),
        ("UPC: 12345678", "barcode", "12345678", 92.0),
        ("501234567890", "barcode", "501234567890", 90.0),
        ("8901234567894", "barcode", "8901234567894", 88.0),
        ("10012345678901", "barcode", None, None),
        ("B 133123456789 x", "barcode", None, None),
    ],
)
def test_contacts_and_codes(spark, line, field, value, confidence):
    got = [(r.value, r.confidence) for r in extraction.best(extraction.candidates(labels(spark, "Name\n" + line))).filter(F.col("field") == field).collect()]
    assert got == ([(value, confidence)] if value else [])


def test_rules_of_one_label(spark):
    got = {r.rule_id: r.status for r in rules.evaluate(extraction.declarations(labels(spark, LABEL))).collect()}
    assert {k for k, v in got.items() if v == "PASS"} == {"LM-001", "LM-002", "LM-003", "LM-004", "LM-005", "LM-009", "FS-001", "FS-002", "FS-003", "FS-004", "FS-005"}
    assert (got["LM-006"], got["LM-007"], got["LM-008"]) == ("NOT_APPLICABLE", "NEEDS_REVIEW", "NOT_APPLICABLE")


def test_empty_and_null_labels(spark):
    got = rules.evaluate(extraction.declarations(labels(spark, "", None)))
    assert got.count() == 28 and got.filter("rule_id = 'LM-005' AND status = 'FAIL'").count() == 2
    assert rules.evaluate(extraction.declarations(labels(spark, "x").limit(0))).count() == 0


def test_conflicting_prices(spark):
    c = extraction.conflicts(extraction.candidates(labels(spark, "A\nMRP Rs. 10\nMRP Rs. 12", "A\nMRP Rs. 10\nMRP Rs. 10.00")))
    assert [(r.label_id, r.field) for r in c.filter("field = 'mrp'").collect()] == [(0, "mrp")]


def test_claims(spark):
    t = labels(spark, "No preservatives!", "no Preservatives", "pure unpreserved", "HIGH PROTEIN bar").withColumns(
        {"ingredients": F.element_at(F.array(F.lit("salt, INS 211"), F.lit("salt"), F.lit(None), F.lit(None)), (F.col("label_id") + 1).cast("int")), "facts": F.create_map(F.lit("protein"), F.lit(15.0)), "country_of_origin": F.lit(None).cast("string")}
    )
    got = {r.label_id: (r.claim_type, r.status, r.claim_id) for r in claims.claim_job(t, claims.claim_rules(spark)).collect()}
    assert got == {0: ("NO_PRESERVATIVES", "POTENTIAL_CONTRADICTION", "CLM-001"), 1: ("NO_PRESERVATIVES", "SUPPORTED", "CLM-001"), 3: ("HIGH_PROTEIN", "SUPPORTED", "CLM-001")}


def test_similarity(spark):
    s = lambda a, b: one(spark, reconcile.similarity(F.lit(a), F.lit(b)))[0]
    assert s("Sunny Foods Pvt Ltd", "SUNNY Private Limited") == 1.0 and s("Sunny", "") == 0.0 and s("Sunny Day", "Sunny") > 0.7 > s("Sunny", "Qwk")


def test_rule_diff(spark):
    p = spark.createDataFrame([(1, 2)], "version_a long, version_b long")
    c = spark.createDataFrame([(1, "A", "FAIL"), (2, "A", "PASS"), (1, "B", "PASS"), (2, "C", "FAIL")], "screening_id long, rule_id string, status string")
    got = {r.rule_id: r.change for r in reconcile.rule_diff(c, c, p).collect()}
    assert got == {"A": "FIXED", "B": "MODIFIED", "C": "NEWLY_EVALUATED"}
    assert {r.rule_id: r.resolution for r in reconcile.issue_resolution(reconcile.rule_diff(c, c, p)).collect()} == {"A": "RESOLVED", "C": "NEW_ISSUE"}


@pytest.mark.parametrize(
    "a,b,change,resolution",
    [
        ("WARNING", "PASS", "FIXED", "RESOLVED"),
        ("INSUFFICIENT_EVIDENCE", "PASS", "FIXED", None),
        ("PASS", "WARNING", "REGRESSED", "NEW_ISSUE"),
        ("PASS", "NEEDS_REVIEW", "REGRESSED", None),
        ("PASS", "INSUFFICIENT_EVIDENCE", "MODIFIED", None),
        ("WARNING", "FAIL", "MODIFIED", "STILL_PRESENT"),
        ("FAIL", "NEEDS_REVIEW", "MODIFIED", "UNRESOLVED_REVIEW"),
        ("WARNING", "NOT_APPLICABLE", "MODIFIED", None),
        ("NOT_APPLICABLE", "FAIL", "NEWLY_EVALUATED", None),
        (None, "FAIL", "NEWLY_EVALUATED", "NEW_ISSUE"),
        ("FAIL", None, "MODIFIED", None),
        ("FAIL", "FAIL", "UNCHANGED", "STILL_PRESENT"),
    ],
)
def test_changes_and_resolutions(spark, a, b, change, resolution):
    p = spark.createDataFrame([(1, 2)], "version_a long, version_b long")
    c = spark.createDataFrame([r for r in ((1, "A", a), (2, "A", b)) if r[2]], "screening_id long, rule_id string, status string")
    diff = reconcile.rule_diff(c, c, p)
    assert [r.change for r in diff.collect()] == [change]
    assert [r.resolution for r in reconcile.issue_resolution(diff).collect()] == ([resolution] if resolution else [])


@pytest.mark.parametrize(
    "method,confidence,status,score,tier",
    [
        ("DIRECT_OCR", 70.0, "VERIFIED", 90.0, "HIGH"),
        ("DIRECT_OCR", 97.0, "NEEDS_REVIEW", 65.0, "LOW"),
        ("MULTI_TOKEN_OCR", 80.0, "VERIFIED", 80.0, "MEDIUM"),
        ("CONTEXTUAL_OCR", 50.0, "CONTEXTUAL", 60.0, "LOW"),
        ("SEMANTIC_PANEL", 99.0, "NEEDS_REVIEW", 40.0, "NEEDS_VERIFICATION"),
        ("TOKEN_SEQUENCE", 0.0, "VERIFIED", 70.0, "MEDIUM"),
        ("NONE", 90.0, "VERIFIED", 0.0, "NEEDS_VERIFICATION"),
        ("DIRECT_OCR", 90.0, "UNAVAILABLE", 0.0, "NOT_APPLICABLE"),
    ],
)
def test_reliability(spark, method, confidence, status, score, tier):
    assert one(spark, *C.reliability(F.lit(method), F.lit(confidence), F.lit(status))) == (score, tier)


def test_claim_confidence_uses_what_was_read(spark):
    t = labels(spark, "High protein", "High protein", "Completely new, treats colds").withColumns({"ingredients": F.lit(None).cast("string"), "facts": F.create_map(F.lit("protein"), F.lit(15.0)), "country_of_origin": F.lit(None).cast("string")})
    rules_ = claims.claim_rules(spark)
    found = claims.numbered(claims.find_claims(t.select("label_id", "text"), rules_).unionByName(claims.open_claims(t.select("label_id", "text"), rules_)))
    read = found.withColumns({"ocr_confidence": F.when(F.col("label_id") == 1, 60.0).otherwise(95.0), "has_box": F.col("label_id") != 1})
    got = {r.claim: (r.status, r.confidence) for r in claims.assess(read, rules_, t).filter("label_id <> 1").collect()}
    low = claims.assess(read, rules_, t).filter("label_id = 1").first()
    assert got["high protein"] == ("SUPPORTED", 0.25 * 95 + 0.2 * 95 + 0.25 * 92 + 0.3 * 90 + 0.05)
    assert low.confidence == 0.25 * 60 + 0.2 * 60 + 0.25 * 92 + 0.3 * 90
    assert got["completely new"][0] == got["treats colds"][0] == "HIGH_RISK_REVIEW"


def test_refused_approvals(spark):
    d = spark.createDataFrame([(1, "APPROVED", True), (2, "APPROVED", False), (3, "REJECTED", True), (4, "HOLD", True), (5, "APPROVED", True)], "artwork_id long, decision string, acknowledged boolean")
    r = spark.createDataFrame([(1, "NON_COMPLIANT"), (3, "NON_COMPLIANT"), (4, "NEEDS_REVIEW")], "artwork_id long, readiness string")
    ok, no = reconcile.approval_gate(d, r)
    assert {x.artwork_id: x.workflow_status for x in ok.collect()} == {3: "REJECTED", 4: "CHANGES_REQUESTED", 5: "READY_FOR_PRINT"}
    assert {x.artwork_id: x.refused for x in no.collect()} == {1: "NON_COMPLIANT", 2: "NOT_ACKNOWLEDGED"}


def test_readiness_counts_failed_checks(spark):
    listed = spark.createDataFrame([(i, 12 - n, n, ["x", "y", "z"][:n]) for i, n in ((1, 0), (2, 0), (3, 1), (4, 3))], "label_id long, present int, missing int, missing_list array<string>")
    c = spark.createDataFrame([(1, "f", "PASS"), (2, "date_marking", "FAIL"), (3, "x", "PASS"), (4, "x", "FAIL")], "label_id long, field string, status string")
    none = spark.createDataFrame([], "label_id long, field string, status string, zone_y double")
    heights = spark.createDataFrame([(1, "mrp", 1.0, False)], "label_id long, field string, mm double, ok boolean")
    fixes = evidence.designer_corrections(listed, c, none, heights)
    assert sorted((r.label_id, r.field, r.kind) for r in fixes.collect() if r.label_id in (1, 2)) == [(1, "mrp", "FONT_SIZE"), (2, "date_marking", "FAILED_CHECK")]
    assert {r.label_id: r.readiness for r in evidence.readiness(fixes, listed, c).collect()} == {1: "COMPLIANT", 2: "NON_COMPLIANT", 3: "NEEDS_REVIEW", 4: "NON_COMPLIANT"}


def test_sequences_skip_words_and_lines(spark):
    rows = [(1, 1, 1, "Net", 0, 0), (1, 1, 2, "x", 20, 0), (1, 1, 3, "Wt.", 40, 0), (2, 1, 1, "best", 0, 0), (2, 2, 1, "before", 0, 25), (3, 1, 1, "best", 0, 0), (3, 2, 1, "before", 0, 60), (4, 1, 1, "net", 0, 0), (4, 1, 2, "wt", 300, 0)]
    w = spark.createDataFrame([(*r, 18, 20, 90) for r in rows], "label_id long, line int, pos int, word string, x int, y int, w int, h int, confidence int")
    p = spark.createDataFrame([("wt", ["net", "wt"]), ("date", ["best", "before", "end"])], "name string, targets array<string>")
    got = {(r.label_id, r.name): (r.n_words, r.x, r.right, r.bottom) for r in locate.sequences(w, p).collect()}
    assert got == {(1, "wt"): (2, 0, 58, 20), (2, "date"): (2, 0, 18, 45)}  # 3: too far below, 4: too far right


def test_boxes(spark):
    box = tuple(map(F.lit, (-5, 10, 700, 90)))
    w, h = F.lit(600), F.lit(100)
    assert one(spark, *C.padded(C.clipped(box, w, h), 10, 8, w, h)) == (0, 2, 600, 98)
    assert one(spark, *C.normalised_box(box, w, h)) == (0.0, 0.1, 1.0, 0.9) and one(spark, *C.pixel_box(tuple(map(F.lit, (0.0, 0.1, 1.0, 0.9))), w, h)) == (0, 10, 600, 90)
    assert one(spark, *C.normalised_box(box, F.lit(0), h)) == (0.0, 0.0, 0.0, 0.0)


def test_sliding_window_excludes_its_end_and_success_clears(spark):
    ts = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 9, ts(0), True, False), (2, 9, ts(10), True, False), (3, 9, ts(11), False, True), (4, 9, ts(12), True, False)]
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp, failure boolean, success boolean")
    assert [r.failures for r in timeline.sliding_attempts(df, 10, 5).orderBy("event_id").collect()] == [1, 1, 1]


def test_chain_finds_the_first_break(spark):
    import hashlib

    rows, before = [], "GENESIS"
    for i in range(2500):
        h = hashlib.sha256(f"{before}|e|u|{i}".encode()).hexdigest()
        rows.append((1, i, before, h, "e", "u" if i != 1000 else "v", str(i)))
        before = h
    df = spark.createDataFrame(rows, "log long, event_id long, prev_hash string, event_hash string, event_type string, actor string, created_at string")
    r = timeline.verify_chain(df).first()
    assert (r.links, r.broken, r.first_broken, r.reason) == (2500, 1, 1000, "EVENT_HASH")
    assert timeline.verify_chain(df.filter("event_id <> 2000")).first().reason in ("EVENT_HASH",) and timeline.verify_chain(df.filter("event_id <> 2000")).first().broken == 2


def test_page_text(spark):
    html = "<html><head><title>t</title></head><body><script>var a='</p>';</script><p>One &amp; two</p><style>x</style>Three</body></html>"
    r = jobs.page_text(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert r[0].text == "One & two\nThree" and r[1].n_lines == 0


def test_token_match(spark):
    m = lambda a, b: one(spark, locate.token_matches(F.lit(a), F.lit(b)))[0]
    assert [m("MRP:", "mrp"), m("ab", "abc"), m("ingredients", "ingredient"), m("xyz", "abcd")] == [True, False, True, False]


def test_broken_json_is_empty(spark):
    rows = spark.createDataFrame([(1, "{bad"), (2, None), (3, '{"failed_rules": 2}'), (4, '{"checks": [{"rule_id": "A", "status": "FAIL"}]}')], "id long, compliance_result string")
    got = {r.id: (r.passed, r.failed) for r in exports.parsed(rows).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 2), 4: (0, 1)}


def test_csv_keeps_hostile_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "0", "n", '=cmd,"x"\nline')], "id long, section string, ordinal string, name string, value string")
    exports.export_csv({"s": rows}, str(tmp_path / "r"))
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "r")).first()
    assert got.value == "'=cmd,\"x\"\nline"


def test_readers_of_folders(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "hi.json").write_text('{"mrp": ["मूल्य", "दाम"]}', encoding="utf-8")
    got = sorted(tuple(r) for r in exports.read_keywords(spark, str(tmp_path / "k")).collect())
    assert got == [("hi", "mrp", "दाम"), ("hi", "mrp", "मूल्य")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('[{"rule_id": "X", "claim_type": "T", "patterns": ["one"]}, {"rule_id": "Y", "enabled": false}]')
    (tmp_path / "c" / "b.json").write_text('[{"rule_id": "X", "claim_type": "U", "patterns": ["two"]}]')
    got = [(r.rule_id, r.claim_type) for r in claims.read_claim_rules(spark, str(tmp_path / "c")).collect()]
    assert got == [("X", "U")]
