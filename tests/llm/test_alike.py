"""Near copies at a similarity of 0.8 against plain search."""

import random

import pytest

from labelloom.llm import alike, simhash

SCHEMA = "doc_id long, text string"


def sets_of(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def kept(rows):
    """Smallest id of each group over pairs of similarity 0.8."""
    rows = sorted(rows)
    sets, up = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, b in enumerate(sets):
        for i in range(j):
            a = sets[i]
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def near_copies(bases, copies, most, n=200):
    rng, rows = random.Random(5), []
    for b in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(copies):
            mine = list(words)
            for i in rng.sample(range(n), rng.randint(0, most)):
                mine[i] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine)))
    return rows


def test_near_copies_go_down_to_four_fifths(spark):
    rows = near_copies(12, 8, 9)
    want = kept(rows)
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    assert 12 < len(want) < len(rows) - 20


@pytest.mark.parametrize("few,part", [(2, 2048), (2, 16), (12, 2048)])
def test_large_bands_lose_no_link(spark, few, part):
    from labelloom.llm.common import row_key, stored

    rows = near_copies(2, 60, 8, 90)
    d = spark.createDataFrame(rows, SCHEMA)
    keyed = d.withColumn("__key", row_key(d["doc_id"], d["text"]))
    p = stored(alike.with_signature(keyed, "doc_id", "__key"))
    of = {r.set: r.component for r in alike.grouped(p, keyed.select("__key", "text"), few, part).collect()}
    groups = {of.get(r.set, r.set) for r in p.collect()}
    assert len(groups) == len(kept(rows))


def test_stage_equals_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == want
