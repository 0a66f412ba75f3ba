"""Values of clashing columns, bounds of memory, and models and files against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import chat, decontaminate, langid, mixing, packs, quality, scoring, sharding, simhash, substrings, tokens
from labelloom.llm.common import digits_for, new_path, stored
from labelloom.llm.permute import round_keys, sides
from tests.llm.test_cases import LONG, ROWS, SAME, SCHEMA
from tests.oracle import spark_rows

EXTRA = ("size", "key", "fp", "n_words", "kept", "copies", "copy", "b", "i", "first", "number", "at", "p_source", "p_epochs", "__key", "__scan", "__b", "__i", "__first", "__p_source", "__copies", "component", "has", "lang_pred", "score", "c0", "in_1", "__in_2", "__lang", "low_symbol_rate", "n", "set", "prefix")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """More columns, named as the operators name theirs, each with a value of its own."""
    return docs.select("*", *(F.lit(f"x-{c}").alias(c) for c in EXTRA))


@pytest.mark.parametrize("stage", [mixing.mix, sharding.shard, simhash.deduplicate, quality.quality_filter])
def test_clashing_columns_keep_their_values(clashing, stage):
    out = stage(clashing)
    rows = out.collect()
    assert out.columns[: len(clashing.columns)] == clashing.columns and rows
    for r in rows:
        assert all(r[c] == f"x-{c}" for c in EXTRA) and (r.doc_id, r.text, r.lang, r.source) in ROWS


def test_clashing_columns_of_scans(spark, clashing):
    items = spark.createDataFrame([(1, "same1 same2 same3")], "item_id long, text string")
    kept = decontaminate.decontaminate(clashing, items)
    assert kept.columns == clashing.columns and all(r[c] == f"x-{c}" for r in kept.collect() for c in EXTRA)
    out = langid.predicted(clashing, None)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.columns.count("score") == 1
    assert {r.lang_pred for r in out.collect()} == {"und"} and all(r["copies"] == "x-copies" for r in out.collect())
    a, b = (spark_rows(f(d)) for f, d in ((scoring.scored, clashing), (scoring.scored, clashing.select("doc_id", "text"))))
    assert a == b
    a, b = (spark_rows(substrings.without_repeats(d)) for d in (clashing, clashing.select("doc_id", "text")))
    assert a == b


def test_pipeline_on_odd_rows(spark, clashing, tmp_path):
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "same1 same2 same3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r[c] == f"x-{c}" for r in out for c in EXTRA)
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_equal_keys_keep_one_row(spark):
    rows = [(1, "same words here today", "en", s) for s in ("b", "a", "c")] + [(2, "other words entirely now", "en", "a")]
    d = spark.createDataFrame(rows, SCHEMA)
    once, again = (sorted(map(tuple, simhash.deduplicate(x).collect())) for x in (d, d.repartition(3)))
    assert once == again and [r[0] for r in once] == [1, 2]


# quality


@pytest.mark.parametrize("n", [3, 60, 400])
def test_thresholds_follow_group_and_language(spark, n):
    """A group of any size is judged by a mix of its own sketch and its language's; against plain Python."""
    rng = np.random.default_rng(1)
    text = lambda bars: " ".join(f"w{rng.integers(10**6)}" + " ||" * (j < bars) for j in range(30))
    rows = [(i, text(0), "en", "plain") for i in range(120)] + [(1000 + i, text(int(rng.integers(20, 26))), "en", "tables") for i in range(n)]
    m = stored(quality.measured(spark.createDataFrame(rows, SCHEMA)).drop("text"))
    r = m.select("source", quality.rates()["symbol_rate"].alias("v")).collect()

    def binned(v):
        e = max(v.bit_length() - 6, 0)
        return v >> e << e

    def quantile(bins, p, d):
        bins = sorted(bins)
        return next(b for k, b in enumerate(bins, 1) if d * k >= p * len(bins))

    points = lambda bins: [x for j in range(20) for x in [quantile(bins, 2 * j + 1, 40)] * 5]
    every = [binned(x.v) for x in r]
    lang = every + points(every)
    own = [binned(x.v) for x in r if x.source == "tables"] + points(lang)
    q25, q75 = quantile(own, 25, 100), quantile(own, 75, 100)
    f = quality.fences(m).filter("source = 'tables'").first()
    assert (f.low_symbol_rate, f.high_symbol_rate) == (q25 - 3 * max(q75 - q25, 60), q75 + 3 * max(q75 - q25, 60))


def test_quality_sql_cuts_words_at_all_white_space(spark, tmp_path):
    import duckdb

    rows = [(i, f"a{i}\x0bb\x0cc\rd\te\nf g h i j k\n#x\n#x", "en" if i % 2 else None, "s") for i in range(12)] + [(50, None, "en", None), (51, "a b c d e " * 4, "en", "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.sql(quality.OP6_SQL).fetchall())
    q = c.sql(quality.OP6_SQL).columns
    got = quality.op6_quality_rules(spark, str(tmp_path)).select(*q).collect()
    assert sorted(map(tuple, got)) == want and {r.n_words for r in got} == {13, 0, 20}


# near duplicates


def test_most_pairs_are_pruned_above_the_leaves():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    seen = []
    a, _ = simhash.linked(fp, np.zeros(len(fp), int), 4, seen)
    assert len(a) == 0 and {level for level, _, _ in seen} == set(range(6))
    leaves = sum(n for level, n, _ in seen if level == 0)
    assert leaves < 0.5 * len(fp) ** 2 / 2
    narrow = []
    simhash.linked(fp, np.zeros(len(fp), int), 1, narrow)
    assert sum(n for level, n, _ in narrow if level == 0) < 0.1 * leaves


def test_hot_nodes_are_split_into_parts(spark):
    rng = np.random.default_rng(5)
    x = np.unique(np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(12, 5, replace=False).astype(np.uint64)) for _ in range(400)]))
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(df, most=1, hot=10).collect()}  # all agree in 52 bits
    up = {int(v): int(v) for v in x}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for e in got:
        a, b = e
        assert bin(a ^ b).count("1") <= 1
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {int(v): int(v) for v in x}
    assert {v: root(v) for v in up} == want  # five bits set each: no two differ in one bit
    got = simhash.links(df, most=2, hot=10).collect()
    for r in got:
        up[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    assert len({root(v) for v in up}) == 1


def test_very_common_passages_make_few_pairs(spark):
    """Texts that share half their words hardly meet in a band, and copies among them are found."""
    from labelloom.llm import alike

    rng = np.random.default_rng(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.integers(10**6)}" for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, t + " end") for i, (_, t) in enumerate(rows[:20])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = stored(alike.with_signature(d.withColumn("__key", F.md5("text")), "doc_id", "__key"))
    b = p.select("set", F.explode("bands").alias("h"))
    met = b.join(b.toDF("other", "h"), "h").filter("set < other").select("set", "other").distinct().count()
    assert 20 <= met < 0.02 * 320 * 319 / 2
    assert sorted(r.doc_id for r in simhash.deduplicate(d).collect()) == list(range(300))


def test_sketches_tell_similar_sets(spark):
    from labelloom.llm import alike

    rng = np.random.default_rng(9)
    agree = []
    for share in (0.8, 0.3):
        a = rng.integers(0, 2**63, 900, dtype=np.uint64)
        k = int(900 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 900 - k, dtype=np.uint64)])
        x, y = (alike.sketch(alike.minima(v)).view(np.int64).tolist() for v in (a, b))
        d = spark.createDataFrame([(x, y)], "x array<long>, y array<long>")
        agree.append(d.selectExpr(alike.same("x", "y")).first()[0])
        assert agree[-1] == sum((p >> s & 3) == (q >> s & 3) for p, q in zip(x, y, strict=True) for s in range(0, 64, 2))
    assert agree[0] >= alike.LEAST_SAME > agree[1]


# language


def test_network_reads_as_a_plain_loop_does():
    rng = np.random.default_rng(2)
    h, k = langid.HIDDEN, 3
    p = {"out": rng.normal(size=(2 * h, k)), "bias": rng.normal(size=k)}
    for d in "fb":
        p |= {"x" + d: rng.normal(size=(256, 3 * h)), "u" + d: rng.normal(size=(h, 3 * h)) / 3}
    net = langid.Network(["a", "b", "c"], p)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (1, 63, 64, 150)]
    rows = np.frombuffer(b"".join(map(langid.stretched, texts)), np.uint8).reshape(-1, langid.STRETCH)
    got = net.probabilities(rows)

    def states(cells, x, u):
        at, out = np.zeros(h), []
        for c in cells:
            g = at @ u
            z, r = (1 / (1 + math.e ** -(x[c][i * h : (i + 1) * h] + g[i * h : (i + 1) * h])) for i in (0, 1))
            at = z * at + (1 - z) * np.tanh(x[c][2 * h :] + r * g[2 * h :])
            out.append(at)
        return out

    for row, mine in zip(rows, got, strict=True):
        cells = [c for c in row.tolist() if c]
        f, b = states(cells, p["xf"], p["uf"]), states(cells[::-1], p["xb"], p["ub"])[::-1]
        total = np.zeros(k)
        for i in range(len(cells)):
            e = np.exp(np.concatenate([f[i], b[i]]) @ p["out"] + p["bias"])
            total += e / e.sum()
        assert np.allclose(mine, total, atol=2e-3)


def test_predictions_pool_whole_texts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ("the and of that with " if i % 2 else "der die und nicht ein ") * 5, "en" if i % 2 else "de", "s") for i in range(40)]
    net = langid.learned(spark.createDataFrame(rows, SCHEMA), steps=20)
    texts = [" ".join(rng.choice(["the", "die", "und", "of", "ein"], n)) for n in (3, 50, 3000)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(d, net).collect()}
    for i, t in enumerate(texts):
        whole = langid.stretched(t.encode())
        sums = net.probabilities(np.frombuffer(whole, np.uint8).reshape(-1, langid.STRETCH)).astype(np.float64).sum(axis=0)
        assert got[i] == got[i + 3] and got[i][0] == net.languages[sums.argmax()] and math.isclose(got[i][1], sums.max() / sums.sum(), rel_tol=1e-4)


def test_sample_is_bounded_whatever_repeats(spark):
    one = [(0, "the same text of one document", "en", "s")] * 3000
    many = [(i, f"text number {i} of many", "en", "s") for i in range(1, 5000)]
    d = spark.createDataFrame(one + many + [(None, "kein Schlüssel", "de", "s")] * 50, SCHEMA)
    n = {r.lang: r["count"] for r in langid.sampled(d, 100).groupBy("lang").count().collect()}
    assert n == {"en": 100, "de": 1}
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.sampled(d, 100, most_languages=1)


# packs


def test_hot_and_null_ids_are_dealt_to_parts(spark):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"v{rng.integers(60)}" for _ in range(n))
    shared = words(20)
    rows = [(5, shared + " " + words(5)) for _ in range(120)] + [(None, shared + " " + words(5)) for _ in range(120)] + [(i, words(10) + " " + shared) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.without_repeats(d, pack_bytes=500).drop("kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, substrings.brute_force(rows)))
    p = packs.Packed(d, 0.2, pack_bytes=500)
    sizes = p.docs.groupBy("pack").agg(F.sum(F.length("ids") / 8).alias("n")).collect()
    assert max(r.n for r in sizes) < 40 and len({r.pack for r in sizes if r.pack < 0}) > 5
    a, b = (sorted(map(str, scoring.scored(d, pack_bytes=x).collect())) for x in (500, 10**6))
    assert a == b


def test_places_keep_the_order_of_ids():
    rng = np.random.default_rng(8)
    ids = np.sort(rng.integers(-(2**62), 2**62, 5000))
    edges = np.unique(ids[:: 5000 // 8])
    place = packs._places(ids, edges, 7)
    assert (np.diff(place) >= 0).all() and len(np.unique(place)) > 30
    assert (packs._places(edges, edges, 7) == packs._places(edges, edges, 7)).all()


def test_every_gram_can_count(spark):
    """least = 1 against plain counting: nothing of a known text backs off."""
    rows = [(1, "a b c a b d"), (2, "a b c"), (3, None), (4, "a b c")]
    got = {r.doc_id: r for r in scoring.scored(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()}
    one, two = {"a": 4, "b": 4, "c": 3, "d": 1}, {"ab": 4, "bc": 3, "ca": 1, "bd": 1}
    three = {"abc": 3, "bca": 1, "cab": 1, "abd": 1}
    want = [math.log(one["a"] / 12), math.log(two["ab"] / one["a"])]
    w = "abcabd"
    want += [math.log(three[w[i : i + 3]] / two[w[i : i + 2]]) for i in range(4)]
    assert got[1].n_backed_off == 0 and abs(got[1].score - sum(round(x * 1e6) for x in want) / 1e6) < 1e-9
    ties = scoring.scored(spark.createDataFrame(rows * 2, "doc_id long, text string"), least=1).filter("doc_id IN (2, 4)").collect()
    assert len({r.score for r in ties}) == 1 and len(ties) == 4


# chat, tokens


def test_chat_of_very_long_texts(spark):
    rows = [(1, 0, "user", LONG * 20), (1, 1, "assistant", "<|im_end|>" + LONG * 20)]
    r = chat.read_chat(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in r.turns] == [x[3] for x in rows] and r.loss_text == rows[1][3]


def test_token_places_by_brute_force(spark, tmp_path):
    """Slot, shard, offset and length of every sequence recomputed in plain Python from one file."""
    rows = [(i, " ".join(f"tok{j * i % 97}" for j in range(i * 7 % 300)), "en", "s") for i in range(60)] + [(None, SAME, "en", "s")] * 3 + [(7, None, "en", "s"), (7, None, "en", "s")]
    src, out = str(tmp_path / "d.parquet"), new_path(spark, "tokens")
    spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("x")).coalesce(1).write.parquet(src)
    length, per_shard, key = 32, 20, "k"
    tokens.write_shards(spark, src, out, length=length, per_shard=per_shard, key=key).count()
    t = tokens.tokenizer(tokens.VOCABULARY)
    order = [(r.doc_id, r.text) for r in spark.read.parquet(src).collect()]
    total = sum(tokens.numbers(len((x or "").encode()), length) for _, x in order)
    a, b = sides(total)

    def once(x):
        left, right = divmod(x, b)
        for i, (m, c, d) in enumerate(round_keys(key)):
            mixed = lambda v: ((u := (v * m + c) % (2**31 - 1)) * u + d) % (2**31 - 1)  # noqa: B023, E731
            left, right = ((left + mixed(right)) % a, right) if i % 2 == 0 else (left, (right + mixed(left)) % b)
        return left * b + right

    placed, number = [], 0
    for i, x in order:
        ids = t.own.encode_ordinary(x or "")
        for part in range(tokens.sequences(len(ids), length)):
            p = once(number + part)
            while p >= total:
                p = once(p)
            placed.append((p, i, part, len(ids[part * length : (part + 1) * length])))
        number += tokens.numbers(len((x or "").encode()), length)
    placed.sort(key=lambda r: r[0])
    want, at = [], {}
    for slot, (p, i, part, n) in enumerate(placed):
        s = p // per_shard
        want.append((slot, s, at.get(s, 0) * tokens.stride(length), i, part, n))
        at[s] = at.get(s, 0) + 1
    got = tokens.read_shards(spark, out, length=length).orderBy("slot")
    assert [tuple(r)[:6] for r in got.collect()] == want
    assert not got.isEmpty() and all(r.tokens == got.filter(F.col("slot") == r.slot).first().tokens for r in got.limit(1).collect())


def test_many_splits_keep_their_order(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, f"text {i} " * (i % 9), "en", "s") for i in range(200)], SCHEMA).repartition(5).write.parquet(src)
    runs = []
    for most in (10**6, 0):
        monkeypatch.setattr(tokens, "MOST_SPLITS", most)
        out = new_path(spark, "tokens")
        tokens.write_shards(spark, src, out, length=16, per_shard=50).count()
        runs.append(sorted(map(tuple, tokens.read_shards(spark, out, length=16).collect())))
    assert runs[0] == runs[1]


def test_larger_vocabularies_are_refused(tmp_path):
    import base64

    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i % 256, i // 256 % 256, i // 65536])[: 1 if i < 256 else 3]) + b" %d" % i for i in range(65_536)))
    with pytest.raises(ValueError, match="more tokens"):
        tokens.Tokenizer(str(path))


def test_prefixes_grow_with_the_rows():
    assert [digits_for(n) for n in (0, 10**6, 10**9, 10**11)] == [3, 3, 4, 6]


def test_words_of_an_item_beyond_one_byte(spark):
    """More words among the items than one byte can number; a match must start where a word does."""
    items = [(i, " ".join(f"q{i}x{j}" for j in range(14))) for i in range(60)]
    texts = [(i, "start " + t + " end") for i, t in items] + [(100, "nothing here")]
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r["__scan"].n_words, r["__scan"].n_hit, len(r["__scan"]["items"])) for r in decontaminate.scanned(a, b).collect())
    assert got == sorted((r[0], r[1], r[2], r[3]) for r in decontaminate.brute_force(texts, items))
    assert hashlib.sha256(b"").hexdigest() == decontaminate.brute_force([(1, None)], items)[0][4]
