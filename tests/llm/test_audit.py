"""The filter audit against plain sets, and its merges on small lists."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from labelloom.llm import audit

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """The contract's rows by sets of row positions."""
    import regex

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = {f: set() for f in "ABCDE"}
    parts = {}
    for k, (i, t, s) in enumerate(docs):
        t = t or ""
        parts.setdefault(s or "", set()).add(k)
        w = regex.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(regex.findall("[A-Z]", t)) > 5 * len(t), "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > first[t]}
        for f, bad in tests.items():
            if bad:
                fails[f].add(k)
    out = []
    for part, rows in parts.items():
        mine = {f: fails[f] & rows for f in "ABCDE"}
        total = dict.fromkeys("ABCDE", 0)
        some = []
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                removed = mine[f] - gone
                total[f] += len(removed)
                marked = lambda ids: sum(docs[k][0] in ids for k in removed)  # noqa: B023, E731
                others = set().union(*(mine[g] for g in "ABCDE" if g != f))
                some.append((part, "".join(order), step, len(rows - gone - removed), len(removed), len(mine[f] & gone), len(mine[f] - others), marked(good), marked(toxic)))
                gone |= removed
        out += [(*r, total[r[1][r[2] - 1]]) for r in some]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(n, seed=5):
    rng = random.Random(seed)
    docs = [(None, "A", None), (None, None, "x"), (3, None, ""), (3, None, None), (4, "", "x"), (5, "$ " + "word " * 60, "x"), (5, "$ " + "word " * 60, "x")]
    words = ["Abc", "DEF", "ghi", "jk#", "l", "m n", "ñandú"]
    pool = [" ".join(rng.choice(words) + str(rng.randrange(rng.choice((3, 500)))) for _ in range(rng.choice((3, 49, 50, 80)))) for _ in range(n // 2)]
    docs += [(rng.randrange(2 * n), rng.choice(pool), rng.choice(("hot", "hot", "cold", None))) for _ in range(n)]
    labels = [(rng.choice((None, rng.randrange(2 * n))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(2 * n)]
    return docs, labels


@pytest.mark.parametrize("size", [audit.RANGE, 7])
def test_equals_sets(spark, size):
    docs, labels = made(150)
    d = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({"row": F.lit("x"), "part": F.lit("y"), "fails": F.lit("z"), "good": F.lit("g"), "salt": F.lit("s"), "n": F.lit("n")})
    assert rows_of(audit.audited(d, spark.createDataFrame(labels, LABELS), size)) == plain(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert audit.audited(none, labels).collect() == []
    out = audit.audited(spark.createDataFrame([(1, None, None)], DOCS), labels).collect()
    assert len(out) == 600 and {r.part for r in out} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in out)


def test_merges():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(5)]
        x, *others = lists
        assert audit.difference(x, others) == sorted(set(x).difference(*others))
        assert audit.union_size(lists) == len(set().union(*lists))
        assert audit.shared(x, others[0]) == len(set(x) & set(others[0]))
    for n in range(12):
        x = list(range(0, 2 * n, 2))
        for at in range(n + 1):
            for target in range(-1, 2 * n + 2):
                assert audit.gallop(x, target, at) == max(at, sum(v < target for v in x))


def test_postings_are_sorted_and_bounded(spark):
    docs, labels = made(200)
    some = audit.postings(audit.judged(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(labels, LABELS)), 16).collect()
    assert sum(r.n for r in some) == len(docs) and max(r.n for r in some) <= 16
    assert all(list(x) == sorted(set(x)) and len(x) <= r.n for r in some for x in r.lists)
