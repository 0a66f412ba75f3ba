"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from labelloom.llm import chat, decontaminate, langid, mixing, quality, scoring, sharding, simhash, substrings, tokens
from labelloom.llm.common import new_path

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SAME = " ".join(f"same{i}" for i in range(40))
ROWS = [
    (1, SAME, "en", "a"),
    (2, SAME + " tail", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, LONG, "en", "b"),
    (6, "one", "de", "b"),
    (6, "one", "de", "b"),
    (None, SAME, "en", "a"),
    (8, " \n\t ", "en", "a"),
    (9, "Grüße, 世界! ÀÉ İ", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """More columns, named as the operators name theirs."""
    extra = ("size", "key", "fp", "n_words", "kept", "shard", "slot", "__key", "component", "tokens", "hits", "bucket")
    return docs.select("*", *(F.lit(f"x-{c}").alias(c) for c in extra))


# chat formatting


def chat_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "conv_id long, turn long, role string, text string")


def test_chat_merges_and_reads_back(spark):
    hostile = ["<|im_end|>", r"[\INST] a [/INST]", "</s><s>", r"<\\|im_sep|>", "<|im_next|>\\", "", "[", "日本"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(hostile)] + [(2, 0, None, None), (2, None, "user", "first"), (None, 0, "assistant", "x")]
    out = chat.read_chat(chat.format_chat(chat_rows(spark, *rows)))
    got = {r.conv_id: r for r in out.collect()}
    assert [t.text for t in got[1].turns] == hostile and [t.role for t in got[1].turns] == [r[2] for r in rows[:8]]
    assert got[1].loss_text == "".join(t for i, t in enumerate(hostile) if i % 3 == 0)
    assert got[1].formatted.count("<|im_start|>") == 6  # 8 turns in 6 runs
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "first"), ("", "")]
    assert got[None].loss_text == "x"


def test_chat_ties_repeats_and_empty_tables(spark):
    rows = chat_rows(spark, (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"))
    r = chat.read_chat(chat.format_chat(rows)).first()
    assert [t.text for t in r.turns] == ["a", "a", "b"] and r.formatted.count("<|im_start|>") == 1
    assert chat.format_chat(rows.limit(0)).count() == 0
    assert chat.format_chat(rows.withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))).columns == ["conv_id", "formatted", "loss_spans"]


# quality rules


def test_quality_measures(spark):
    text = "a b c d e a b c d e\nx # y\nx # y\n"
    d = spark.createDataFrame([(1, text, "en", "s")], SCHEMA)
    r = quality.measured(d).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (16, 2, 1, 10, 3)
    assert quality.measured(spark.createDataFrame([(1, "a a a a a a", "en", "s")], SCHEMA)).first().n_repeat_words == 6


def test_quality_cases(spark, docs, none):
    m = quality.measured(docs)
    got = quality.judged(m, quality.fences(m)).collect()
    assert len(got) == len(ROWS) and all(not r.kept for r in got if r.base_failed) and all(r.base_failed for r in got if r.n_words < 10)
    assert quality.quality_filter(none).count() == 0
    assert {r.doc_id for r in quality.quality_filter(clashing(docs)).collect()} == {1, 2, 5, None}  # 5 is alone in its group and a quarter of all that pass the base rule
    assert quality.quality_filter(clashing(docs)).columns == clashing(docs).columns


def test_quality_fences_follow_the_group(spark):
    text = lambda i, bars: " ".join(f"w{i}x{j}" + " ||" * (j < bars) for j in range(30))
    rows = [(i, text(i, 25 * (s == "tables")), "en", s) for s in ("tables", "plain") for i in range(120)]
    rows += [(500, text(500, 25), "en", "plain"), (501, text(501, 25), "en", "tables")]
    d = spark.createDataFrame(rows, SCHEMA)
    m = quality.measured(d)
    got = {r.doc_id: r.kept for r in quality.judged(m, quality.fences(m)).filter("doc_id >= 500").collect()}
    assert got == {500: False, 501: True}


def test_sketch_bins_keep_six_bits(spark):
    got = [r.b for r in spark.createDataFrame([(0,), (63,), (64,), (65,), (1000,), (10**9,)], "v long").select(quality.sketched(F.col("v")).alias("b")).collect()]
    assert got == [0, 63, 64, 64, 992, 989855744]


# near duplicates


def test_simhash_cases(spark, docs, none):
    p = simhash.with_fingerprint(docs, "doc_id")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(p).collect()}
    assert {(3, 3), (4, 3), (8, 3), (6, 6), (9, 9), (5, 5)} <= got  # null, empty and blank texts share fingerprint zero
    assert (None, 1) in got
    assert simhash.near_duplicates(p.limit(0)).count() == 0 and simhash.deduplicate(none).count() == 0
    assert simhash.fingerprint(b"one") != 0 and simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_one_of_each_group_stays(spark, docs):
    got = simhash.deduplicate(clashing(docs))
    assert got.columns == clashing(docs).columns
    ids = sorted(r.doc_id for r in got.collect())
    assert len(ids) == len(set(ids)) and {3, 5, 6, 9} <= set(ids) and 4 not in ids and 8 not in ids


def test_long_texts_in_parts(monkeypatch):
    whole = simhash.fingerprint(LONG.encode())
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 1000)
    assert simhash.fingerprint(LONG.encode()) == whole


# language


def test_language_cases(spark, none):
    assert [r.lang_pred for r in langid.predicted(none.select("doc_id", "text"), None).collect()] == []
    rows = [(i, ("the and of that with " if i % 2 else "der die und nicht ein ") * 5, "en" if i % 2 else "de", "s") for i in range(40)]
    d = spark.createDataFrame(rows, SCHEMA)
    net = langid.learned(d, steps=40)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and of the"), (5, "der und die nicht " * 2000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(odd, net).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["und"] * 3 and got[1][1] == 0 and got[4][0] == "en" and got[5][0] == "de"
    assert langid.learned(d.limit(0)) is None


# substrings and scoring


def test_substring_cases(spark, docs, none):
    got = {r.doc_id: r for r in substrings.without_repeats(docs).collect() if r.doc_id is not None}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept) == (0, 40, "tail")
    assert got[3].n_words == 0 and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    nulls = [r for r in substrings.without_repeats(docs).collect() if r.doc_id is None]
    assert [(r.n_words, r.n_removed) for r in nulls] == [(40, 0)]
    assert substrings.without_repeats(none).count() == 0
    assert substrings.without_repeats(clashing(docs)).count() == len(ROWS)


def test_substrings_do_not_depend_on_packs(spark, docs):
    rows = lambda **how: sorted(map(tuple, substrings.without_repeats(docs, **how).collect()), key=str)
    assert rows() == rows(pack_bytes=50) == rows(bucket_keys=10)


def test_scoring_cases(spark, docs, none):
    got = {r.doc_id: r for r in scoring.scored(docs).collect()}
    assert got[3].n_words == 0 and got[3].score == 0 and got[3].mean_score is None
    assert got[1].mean_score > got[5].mean_score  # what others say as well scores higher
    assert scoring.scored(none).count() == 0
    small = {r.doc_id: r.score for r in scoring.scored(docs, pack_bytes=50).collect()}
    assert small == {i: r.score for i, r in got.items()}


# decontamination


def test_decontamination_cases(spark, docs, none):
    items = spark.createDataFrame([(1, "Same1 same2 same3"), (2, None), (3, "!!"), (None, "世界"), (1, "Same1 same2 same3")], "item_id long, text string")
    got = {r.doc_id: r["__scan"] for r in decontaminate.scanned(clashing(docs), items).collect()}
    assert got[1].n_hit == 3 and got[1]["items"] == ["1"] and got[9]["items"] == [""]
    a, b = got[1].spans
    assert SAME[a:b] == "same1 same2 same3"
    assert decontaminate.scanned(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.decontaminate(clashing(docs), items).columns == clashing(docs).columns


def test_blocks_of_items_agree(spark, docs):
    items = spark.createDataFrame([(i, " ".join(f"same{j}" for j in range(i, i + 14))) for i in range(20)], "item_id long, text string")
    rows = lambda n: sorted(map(str, decontaminate.scanned(docs, items, block_bytes=n).select("doc_id", "__scan.n_hit", "__scan.items", "__scan.spans").collect()))
    assert rows(10**6) == rows(300)


# mixing and sharding


def test_mixing_cases(spark, docs, none):
    out = mixing.mix(clashing(docs))
    assert out.columns == clashing(docs).columns
    n = {(r["doc_id"], r["text"]): r["n"] for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert all(t and t.strip() for _, t in n) and max(n.values()) <= 6  # a repeated row counts twice
    assert mixing.mix(none).count() == 0
    again = sorted(map(str, mixing.mix(docs).collect()))
    assert again == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_targets_fill_like_water(spark):
    d = spark.createDataFrame([(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000)])], SCHEMA)
    got = {r.source: r.target for r in mixing.source_targets(mixing.sized(d)).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3)}


def test_sharding_cases(spark, docs, none):
    got = sharding.shard(docs).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(ROWS) and all(r.slot == 0 for r in got)
    assert sharding.shard(none).count() == 0
    a, b = (sorted((r.doc_id or 0, r.shard, r.slot) for r in sharding.shard(x).collect()) for x in (docs, docs.repartition(5)))
    assert a == b


def test_token_cases(spark, docs, none):
    for d, n in ((docs, len(ROWS)), (none, 0)):
        src, out = new_path(spark, "src"), new_path(spark, "out")
        d.write.parquet(src)
        tokens.write_shards(spark, src, out, length=64).count()
        if n:
            rows = tokens.read_shards(spark, out, length=64).collect()
            assert sum(r.part == 0 for r in rows) == n and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}


def test_words_encode_as_texts_do():
    import random

    import numpy as np

    t, rng = tokens.tokenizer(tokens.VOCABULARY), random.Random(1)
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'", "'s", "’", "!", "..", "日", "\u0301", "_", "²", "\u00a0", "\r\n", "İ", "ª"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(t.encode(text), "<u2").tolist() == t.own.encode_ordinary(text)
