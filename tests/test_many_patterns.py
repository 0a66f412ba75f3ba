"""Claim patterns of any case and number, between word borders."""

from labelloom.operators import claims

RULES = "rule_id string, claim_type string, category string, risk_level string, patterns array<string>, contradictions array<string>, ord int"


def found(spark, patterns, *texts):
    rules = spark.createDataFrame([("R", "T", "C", "LOW", patterns, [], 0)], RULES)
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "label_id long, text string")
    return {r.label_id: r.claim for r in claims.find_claims(rows, rules).collect()}


def test_patterns_after_the_5000th_are_found(spark):
    many = [f"a{i} Claim" for i in range(5001)] + ["1 zebra", "ZZ-top Taste", "日本"]
    texts = ("The ZZ-top taste!", "our #1 Zebra", "xzz-top taste", "A7 claim, a9 claim", "日本", None)
    assert found(spark, many, *texts) == {1: "zz-top taste", 2: "1 zebra", 4: "a7 claim", 5: "日本"}


def test_case_of_patterns_and_texts(spark):
    assert found(spark, [" Gluten Free "], "gluten free oats", "Gluten Free oats", "GLUTEN FREE", "gluten freedom", "glutenfree") == dict.fromkeys((1, 2, 3), "gluten free")
    rules = spark.createDataFrame([("R", "T", "C", "LOW", ["Gluten Free", ""], [], 0)], RULES)
    rows = spark.createDataFrame([(1, "totally gluten free"), (2, "Gluten"), (3, "other")], "label_id long, claim string")
    assert {r.label_id: r.rule_id for r in claims.matching_rule(rows, rules).collect()} == {1: "R", 2: "R"}


def test_borders_of_signs_and_scripts(spark):
    assert found(spark, ["#1 taste"], "our #1 taste", "our#1 taste", "#1 taste") == {2: "#1 taste", 3: "#1 taste"}
    assert found(spark, ["100%"], "100% pure", "pure 100%", "100%x") == {2: "100%", 3: "100%"}
    assert found(spark, ["été"], "un été ici", "étés", "pété", "ÉTÉ") == {1: "été", 4: "été"}
    assert found(spark, ["++", None], "a++", "c ++ d", "++") == {1: "++", 3: "++"}
