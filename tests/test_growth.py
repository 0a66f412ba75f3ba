"""What broke or slowed down on larger tables: limits of an engine, estimates, few splits."""

from pyspark.sql import functions as F

from labelloom.functions import columns
from labelloom.operators import claims, evidence, extraction, locate, reconcile, reviews, tongues
from labelloom.plans import joins, located
from labelloom.sources import views
from labelloom.sources.views import frame
from labelloom.streaming import jobs


def test_artwork_chain_is_not_cut_by_a_limit_of_rows(spark):
    """A recursive query ends at spark.sql.cteRecursionRowLimit rows, a million by default."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    try:
        a = spark.createDataFrame([(1, None), (9, 8)] + [(i, 1) for i in range(2, 8)] + [(20, 2), (30, 20)], "id long, parent_id long")
        got = {r.id: (r.root, r.iteration, r.ancestors) for r in reconcile.artwork_chain(a).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {1: (1, 1, "")} | {i: (1, 2, "1") for i in range(2, 8)} | {20: (1, 3, "1/2"), 30: (1, 4, "1/2/20")}


def test_labels_are_rendered_by_many_tasks(spark, sf_dir):
    """part is a file of one split; its rows are dealt before they become texts and words."""
    assert frame(spark, sf_dir, "part").rdd.getNumPartitions() == 1
    assert frame(spark, sf_dir, "words").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_meet_only_beginnings_of_keywords(spark):
    """A line gave a row for every run of letters in it; now only for those that some keyword begins with."""
    k = tongues._index(spark.createDataFrame([("en", "mrp", "M.R.P"), ("en", "care", "care"), ("en", "mrp", "a"), ("hi", "mrp", "मूल्य")], "language string, field string, keyword string"))
    line = spark.createDataFrame([("mxrxp, careful m.r.p मूल्य",)], "low string")
    assert sorted(line.select(tongues._heads(F.col("low"), tongues._beginnings(k))).first()[0]) == ["a", "car", "m.r", "मूल"]


def test_tables_of_all_labels_are_not_broadcast(spark):
    """Spark takes their size for that of the columns that texts are made from; the limit is 10 MB, as by default."""
    words = spark.createDataFrame([(1, 1, 1, "MRP", 0, 0, 10, 10, 90)], "label_id long, line int, pos int, word string, x int, y int, w int, h int, confidence int")
    own = words.select("label_id", F.array("word").alias("targets"), F.lit("LINE").alias("kind"), F.lit(0).alias("below"), F.lit(0).alias("width"))
    values = words.select("label_id", F.lit("brand").alias("field"), F.col("word").alias("value"))
    labels = words.select("label_id", F.col("word").alias("text"))
    read = locate.reading(words)
    for df in (locate.starts(read, own), locate.spans(read, locate.starts(read, own)), evidence.provenance(values, words), extraction.declarations(labels)):
        assert df.count() == 1
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_some_fields(spark):
    labels = spark.createDataFrame([(1, "Fine Oats\nMRP Rs. 20\nNet Qty: 5 g\nBatch No: B7")], "label_id long, text string")
    every = {tuple(r) for r in extraction.candidates(labels).collect()}
    assert {tuple(r) for r in extraction.candidates(labels, ("mrp", "product_name")).collect()} == {r for r in every if r[1] in ("mrp", "product_name")} != set()


def test_scripts_beyond_latin_lie_in_one_range(spark):
    """Texts without a letter of that range are not read for each of the eight scripts."""
    rows = [(i, s) for i, s in enumerate([chr(0x900), chr(0xD7F), "é जल ab", "ok", None, "඀"])]
    got = {r.id: (r.script, r.letters) for r in extraction.scripts(spark.createDataFrame(rows, "id int, text string"), "id").collect()}
    assert got == {0: ("Devanagari", 1), 1: ("Malayalam", 1), 2: ("Latin", 5), 3: ("Latin", 2), 4: (None, 0), 5: (None, 0)}


def test_dates_are_computed_once(spark):
    """A date's text stood in its months, years and patterns some fifty times, and each was computed anew."""
    text = spark.createDataFrame([("15 mar 2024", "Rs 45,50")], "d string, p string")
    plan = text.select(columns.label_date(F.reverse("d")).alias("date"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("reverse(") <= 2
    assert text.select(columns.label_date(F.col("d")), columns.repaired_price(F.col("p")).cast("string")).first()[:] == ("15/03/2024", "45.50")


def test_candidates_are_made_once_for_a_merge(spark):
    """They were made for their best and again for the gaps."""
    labels = spark.createDataFrame([(1, "Fine Oats\nMRP Rs. 20\nPlot 5")], "label_id long, text string")
    words = spark.createDataFrame([("en", "plot", "plot"), ("en", "mrp", "fine"), ("en", "plot", "no")], "language string, field string, keyword string")
    base = extraction.candidates(labels)
    got = extraction.merged(base, extraction.multilingual(labels, words))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 2
    assert {(r.field, r.method) for r in got.collect()} == {(r.field, r.method) for r in extraction.best(base).collect()} | {("plot", "dictionary")}


def test_screening_extracts_once(spark):
    """Scores and checks of a batch were joined, each from an extraction of its own."""
    labels = spark.createDataFrame([(1, "Fine Oats\nMRP Rs. 20")], "label_id long, text string")
    out = jobs.scored_screening(labels)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    assert len(out.first().checks) == 14


def test_artwork_checks_are_evaluated_once(spark, sf_dir):
    """Corrections and readiness both read the checks; the rules ran for each."""
    checks = joins._artwork(spark, sf_dir)[0]
    assert "Generate" not in checks._jdf.queryExecution().optimizedPlan().toString()
    assert checks.count() == 14 * checks.select("label_id").distinct().count()


def test_lines_and_clusters_are_gathered_in_one_pass(spark, sf_dir):
    plan = joins.QUERIES["g09_same_line"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_corrections_are_not_broadcast(spark):
    declared = extraction.declarations(spark.createDataFrame([(1, "Fine Oats\nMRP Rs. 20")], "label_id long, text string"))
    fixes = spark.createDataFrame([(1, "mrp", "30", "asha", "misread", 1)], "label_id long, field string, value string, officer string, reason string, at int")
    df = reviews.machine_vs_human(declared, reviews.corrected(declared, fixes), fixes)
    assert {r.field: r.human_value for r in df.collect()}["mrp"] == "30"
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_more_labels_make_more_tasks(spark, sf_dir, monkeypatch):
    """Labels were dealt into spark.sql.shuffle.partitions partitions however many there were, and each was sorted whole."""
    monkeypatch.setattr(views, "TASK_LABELS", 10, raising=False)
    assert frame(spark, sf_dir, "words").rdd.getNumPartitions() == frame(spark, sf_dir, "part").count() / 10


def test_words_are_not_sorted_for_provenance(spark, sf_dir):
    """All words were sorted to meet a few tokens, and stripped twice: once for a filter of empty ones."""
    df = joins.QUERIES["d19_provenance"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(lower(word") == 1


def test_words_are_classified_once_for_placement(spark, sf_dir):
    """Words were rendered and read for regions and again for words seen, sorted by label, and classified twice for a filter."""
    optimized = joins.QUERIES["i27_placement"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Generate posexplode") == 2  # lines, words
    regions = joins.QUERIES["d24_artwork_regions"](spark, sf_dir)._jdf.queryExecution()
    assert "SortMergeJoin" not in regions.executedPlan().toString()
    assert regions.optimizedPlan().toString().count(", helpline)") == 1


def test_placement_of_labels_without_page_or_region(spark):
    words = spark.createDataFrame([(1, "MRP", 90), (1, "netrs", 30), (2, "mrp", 45), (3, "oats", 9), (4, "Net", 1800)], "label_id long, word string, y int")
    pages = spark.createDataFrame([(1, 600, 900), (3, 600, 900), (4, 600, 900)], "label_id long, width int, height int")
    got = {(r.label_id, r.field): (r.status, r.zone_y) for r in evidence.placement(words, pages, spark.range(1, 6).toDF("label_id")).collect()}
    assert got == {
        (1, "mrp"): ("PASS", 0.0333), (1, "net_quantity"): ("PASS", None), (2, "mrp"): ("PASS", None), (2, "net_quantity"): ("REVIEW", None), (3, "mrp"): ("REVIEW", None), (3, "net_quantity"): ("REVIEW", None),
        (4, "mrp"): ("REVIEW", None), (4, "net_quantity"): ("PASS", 1.0), (5, "mrp"): ("REVIEW", None), (5, "net_quantity"): ("REVIEW", None),
    }


def test_letter_heights_make_no_rows_of_words(spark, sf_dir):
    """Every word became an array of the fields it is of, put in lower case for each keyword; now labels become rows after their means."""
    plan = joins.QUERIES["i26_letter_heights"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate inline") < plan.index("Aggregate [label_id")
    assert plan.count("lower(word") == 1
    words = spark.createDataFrame([(1, "MRP", 10), (1, "incl", 20), (1, "date", None), (2, "oats", 9), (2, None, 9)], "label_id long, word string, h int")
    assert {(r.label_id, r.field, r.mm, r.ok) for r in evidence.letter_heights(words, 254).collect()} == {(1, "mrp", 1.5, True), (1, "manufacturing_date", None, None)}


def test_claims_of_panels_are_found_together(spark, sf_dir):
    """Each label was rendered for the rules and the grammars of each of its panels: four times."""
    plan = joins.QUERIES["g04_g07_claim_numbers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 2
    texts = spark.createDataFrame([(1, 1, "Low fat, zero fuss"), (1, 2, "LOW FAT"), (2, 1, "é low fat")], "label_id long, panel int, text string")
    rules = claims.claim_rules(spark)
    found = claims.find_claims(texts, rules).unionByName(claims.open_claims(texts, rules))
    assert sorted(tuple(r) for r in found.select("label_id", "panel", "claim").collect()) == [(1, 1, "low fat"), (1, 1, "zero fuss"), (1, 2, "low fat"), (2, 1, "low fat")]


def test_runs_of_ascii_are_those_of_any_script(spark):
    texts = ["no 1 brand_x, 100%", "जल low-fat é1", "", None, "a\u200db K\u0301"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(claims._runs(F.col("t"))).collect()]
    assert got == [r[0] for r in df.select(F.array_distinct(F.regexp_extract_all("t", F.lit(claims.RUN), F.lit(1)))).collect()]
    assert got[:4] == [["no", "1", "brand_x", "100"], ["जल", "low", "fat", "é1"], [], None]


def test_evidence_moves_no_words(spark, sf_dir):
    """A label's words were dealt once for every key of theirs, sorted to meet the label's anchors and written to the shared folder; now rows of part and supplier only are."""
    plan = located.QUERIES["g10_evidence_choice"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and all("p_partkey" in line and "REPARTITION_BY_NUM" in line for line in dealt)
    assert plan.count("MapInArrow") == plan.count("SortMergeJoin [label_id") - 1 == 1


def test_labels_are_dealt_for_whole_pages(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "TASK_PAGES", 10)
    labels, words = views.dealt(spark, sf_dir, "label_text", "pack_words")
    assert labels.rdd.getNumPartitions() == words.rdd.getNumPartitions() == labels.count() / 10
    at = [df.select("label_id", F.spark_partition_id().alias("at")).distinct() for df in (labels, words)]
    assert at[0].exceptAll(at[1]).count() == 0 == at[1].count() - labels.count()


def test_pack_words_without_a_union(spark, sf_dir):
    view = spark.sql(views.VIEWS["pack_words"], words=frame(spark, sf_dir, "words"), label_truth=frame(spark, sf_dir, "label_truth"))
    words = frame(spark, sf_dir, "pack_words")
    assert words.dtypes == view.dtypes and words.count() == view.count()
    assert words.exceptAll(view).count() == 0
