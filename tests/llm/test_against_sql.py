"""Queries that SQL can express against DuckDB, the others against brute force, on the smallest tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import decontaminate, langid, permute, simhash, substrings, tokens
from labelloom.llm.queries import QUERIES, SQL
from tests.llm.test_alike import kept as one_of_each
from tests.oracle import connection, spark_rows, sql_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(duck, SQL[name])


def texts(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


def print_of(text):
    """Fingerprint by the contract's words."""
    import regex
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def groups_of(prints):
    """Smallest id reachable over pairs within four bits, for (id, print) pairs."""
    ids, fp = [i for i, _ in prints], np.array([p for _, p in prints], np.uint64)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(fp[k] ^ fp[k + 1 :]) <= 4):
            a, b = root(i), root(ids[k + 1 + j])
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir, duck):
    prints = [(i, print_of(t)) for i, t in texts(duck)]
    want = groups_of(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}


@pytest.mark.parametrize("bands,hot", [(5, 10**6), (5, 40), (6, 10**6), (8, 10**6)])
def test_index_loses_no_link(spark, bands, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    x = np.unique(np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64)) for b in base for _ in range(60)]))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64))], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, bands=bands, hot=hot).collect()}
    assert got == groups_of([(i, int(v)) for i, v in enumerate(x)])


def test_bands_grow_with_the_input():
    assert [simhash.bands_for(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [5, 5, 6, 7, 8]
    assert [len(simhash.masks(b, 4)) for b in (5, 6, 7, 8)] == [5, 15, 35, 70]
    assert all(bin(m & (2**64 - 1)).count("1") == 32 for m in simhash.masks(8, 4))


def test_decontamination_equals_brute_force(spark, sf_dir, duck):
    want = decontaminate.brute_force(texts(duck), duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    got = QUERIES["op10_benchmark_decontamination"](spark, sf_dir).drop("hit_spans")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_substrings_equal_brute_force(spark, sf_dir, duck):
    got = sorted(map(tuple, QUERIES["op5_substring_dedup"](spark, sf_dir).collect()))
    assert got == sorted(substrings.brute_force(texts(duck)))


def test_language_on_held_out_documents(spark, sf_dir, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op4_language_id"](spark, sf_dir).collect() if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in rows)
    assert len(rows) > 40 and right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    cols = np.ascontiguousarray(rng.integers(1, 5, (6, 3)).astype(np.uint8))
    cols[4:, 1] = 0
    x, u, w = rng.normal(size=(256, 6)), rng.normal(size=(2, 6)), rng.normal(size=(6, 3, 2))
    order = list(range(6))[::-1]
    loss = lambda: float((langid._forward(x, u, cols, order)[0] * w).sum())
    dx, du = langid._backward(u, cols, langid._forward(x, u, cols, order)[1], w)
    for a, g, at in ((u, du, (1, 4)), (u, du, (0, 2)), (x, dx, (2, 5)), (x, dx, (3, 0))):
        a[at] += 1e-6
        up = loss()
        a[at] -= 2e-6
        down = loss()
        a[at] += 1e-6
        assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-7)


def test_tokens_come_back(spark, sf_dir, duck):
    from labelloom.llm.common import new_path

    path = new_path(spark, "tokens")
    n = tokens.write_shards(spark, f"{sf_dir}/documents.parquet", path, per_shard=300).agg({"records": "sum"}).first()[0]
    rows = tokens.read_shards(spark, path).orderBy("doc_id", "part").collect()
    t, got = tokens.tokenizer(tokens.VOCABULARY), {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.tokens)
    assert {i: t.decode(b) for i, b in got.items()} == dict(texts(duck))
    assert sorted(r.slot for r in rows) == list(range(n)) and len({r.shard for r in rows}) > 3
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot)]
    assert order != sorted(order)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(permute.permuted(F.col("id"), n, "k").alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))


def plain_quality(duck):
    from labelloom.llm.quality import OP6_SQL

    return {r[0] for r in duck.sql(f"SELECT doc_id FROM ({OP6_SQL}) WHERE kept").fetchall()}


def test_pipeline_equals_brute_force(spark, sf_dir, duck):
    """Each stage on its predecessor's rows, by plain Python; near copies by a similarity of 0.8 of five-word shingles."""
    import xxhash  # noqa: F401

    docs = {r[0]: r for r in duck.sql("SELECT doc_id, text, source FROM documents").fetchall()}
    keep = plain_quality(duck)
    keep = set(one_of_each([(i, docs[i][1]) for i in keep]))
    bad = {r[0] for r in decontaminate.brute_force([(i, docs[i][1]) for i in keep], duck.sql("SELECT item_id, text FROM benchmark").fetchall()) if r[5]}
    keep -= bad
    size = {i: len((docs[i][1] or "").encode().split()) for i in keep}
    sums: dict = {}
    for i in keep:
        sums[docs[i][2]] = sums.get(docs[i][2], 0) + size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sums))}
    target, free, left = {}, set(sums), float(sum(sums.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sums[s]}
        if not over:
            target |= {s: weight[s] * share for s in free}
            break
        target |= {s: 3.0 * sums[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    want: dict = {}
    for s in sums:
        whole, upto = int(target[s] // sums[s]), 0
        rest = target[s] - whole * sums[s]
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        for i in sorted((i for i in keep if docs[i][2] == s), key=lambda i: md5(f"{i}:{md5(docs[i][1])}")):
            want[i] = whole + (2 * upto + size[i] <= 2 * rest)
            upto += size[i]
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot").collect()
    got: dict = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    per = [sorted(r.slot for r in rows if r.shard == k) for k in range(16)]
    assert all(x == list(range(len(x))) for x in per) and max(map(len, per)) - min(map(len, per)) <= 1


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
