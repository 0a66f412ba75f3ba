"""Filter interaction audit over sorted posting lists of failing documents.

Each row gets a number; numbers are dealt in ranges of RANGE. For every part (source)
and range there are sorted lists of the numbers that fail each filter, and of those that
are labelled good or toxic. What a filter removes after others is the difference of its
list and theirs, what is left after a step is the part without a union; both are sizes
of k-way merges that gallop: a list is searched from where it stands by doubled steps,
so runs are passed over and not read. The sizes of all ranges are added up by part,
and the 120 orders are a join with the table of orders, for a step depends only on its
filter and on the set of filters before it.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code
points; D any of #$%&*|; E a text that a smaller doc_id has too, compared by SHA-256.

Copies are found by a grouped minimum of each digest in SALTS parts, so that the
copies of one text are no single task's; labels meet rows by doc_id. Row numbers are
written once with the rows' flags, so a task that is repeated reads the same ones.

Defined results: a null text is empty (no words: A fails, B and C do not); a null source is
the part ''; a null doc_id is no smaller id, is not larger than any, and has no label;
repeated rows are rows each, and none is the other's smaller id; a doc_id labelled more
than once is good, or toxic, if one label says so; texts are read whole; an empty
table has no part and gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, stored, table

FILTERS = "ABCDE"
#: Row numbers of one set of posting lists, and parts of the copies of a text.
RANGE, SALTS = 65_536, 64
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_OTHERS = [tuple(s) for k in range(len(FILTERS)) for s in combinations(range(len(FILTERS)), k)]


def flags(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes are split at U+0009..U+000D and space
    n = len(words)
    out = n < LEAST_WORDS
    out |= (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    if capitals:
        out |= (100 * capitals > MOST_CAPITALS * len(text.decode("utf-8", "replace"))) << 2
    return out | (len(text.translate(None, _SIGNS)) < len(text)) << 3


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fails, digests = [], []
        for t in b.column(2).cast(pa.binary()):
            text = t.as_py() or b""
            fails.append(flags(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, part, fails (bits of the failed filters), good and toxic of every document."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(_flagged, "doc_id long, part string, fails int, digest binary")
    rows = stored(own.withColumn("row", F.monotonically_increasing_id()))
    salted = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    # The groups of a digest are few, at most SALTS, so each task that a digest is dealt to can look its least id up.
    each = salted.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    twice = each.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1 AND first IS NOT NULL")
    firsts = twice.select("digest", "first", F.explode("salts").alias("salt"))
    told = salted.join(firsts, ["digest", "salt"], "left")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = told.select("row", "part", "doc_id", (F.col("fails") + F.when(copied, 16).otherwise(0)).cast("int").alias("fails")).join(marks.filter("good OR toxic"), "doc_id", "left")
    return known.select("row", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def postings(rows: DataFrame, size: int = RANGE) -> DataFrame:
    """part, range, n, and lists: sorted numbers failing each filter, then of the good and of the toxic rows.

    The rows of a range, which are ``size`` at most, are brought together by its number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = rows.withColumn("range", F.expr(f"row div {int(size)}L")).repartition(parts, "range", "part")  # a number given is kept: the lists are small but long to merge
    fail = [F.col("fails").bitwiseAND(1 << i) != 0 for i in range(len(FILTERS))]
    lists = [F.sort_array(F.collect_list(F.when(c, F.col("row")))) for c in [*fail, F.col("good"), F.col("toxic")]]
    return spot.groupBy("range", "part").agg(F.count("*").alias("n"), F.array(*lists).alias("lists"))


def gallop(x: list[int], target: int, at: int) -> int:
    """The first place from ``at`` on whose number is target or more, by doubled steps."""
    step, n = 1, len(x)
    low = at
    while at < n and x[at] < target:
        low = at + 1
        at += step
        step *= 2
    return bisect_left(x, target, low, min(at, n))


def difference(x: list[int], others: list[list[int]]) -> list[int]:
    """Numbers of x that none of the others has."""
    for other in sorted((o for o in others if o), key=len, reverse=True):
        out, i, j, n, m = [], 0, 0, len(x), len(other)
        while i < n and j < m:
            if x[i] < other[j]:
                k = gallop(x, other[j], i)
                out += x[i:k]
                i = k
            elif x[i] > other[j]:
                j = gallop(other, x[i], j)
            else:
                i += 1
                j += 1
        x = out + x[i:]
    return x


def union_size(lists: list[list[int]]) -> int:
    """How many numbers the lists have: the one that is behind moves up to the next head, run by run."""
    live = [[x, 0] for x in lists if x]
    n = 0
    while len(live) > 1:
        live.sort(key=lambda p: p[0][p[1]])
        x, at = live[0]
        head = live[1][0][live[1][1]]
        if x[at] == head:  # the number is counted with the next list
            live[0][1] = at + 1
        else:
            live[0][1] = end = gallop(x, head, at)
            n += end - at
        if live[0][1] == len(x):
            live.pop(0)
    return n + sum(len(x) - at for x, at in live)


def shared(x: list[int], y: list[int]) -> int:
    """How many numbers both have."""
    if len(x) > len(y):
        x, y = y, x
    at = n = 0
    for v in x:
        at = gallop(y, v, at)
        if at == len(y):
            break
        n += y[at] == v
    return n


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each filter and set of filters before it: what is left, removed, and of that good and toxic."""
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for part, n, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            *fail, good, toxic = lists
            unions: dict[int, int] = {}
            for i, own in enumerate(fail):
                for before in _OTHERS:
                    if i in before:
                        continue
                    removed = difference(own, [fail[j] for j in before])
                    mask = sum(1 << j for j in before)
                    after = mask | 1 << i
                    if after not in unions:
                        unions[after] = union_size([own, *(fail[j] for j in before)])
                    for column, v in zip(out, (part, i, mask, n, n - unions[after], len(removed), len(own), shared(removed, good), shared(removed, toxic)), strict=True):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["part", "filter", "before", "n", "kept", "removed", "fails", "good_lost", "toxic_lost"])


SIZES = "part string, filter long, before long, n long, kept long, removed long, fails long, good_lost long, toxic_lost long"


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter and before of every order of the filters: 600 rows."""
    rows = [("".join(FILTERS[i] for i in p), k + 1, p[k], sum(1 << j for j in p[:k])) for p in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter long, before long")


def audited(docs: DataFrame, labels: DataFrame, size: int = RANGE) -> DataFrame:
    """One row for each part, order and step of the filters."""
    counts = ("kept", "removed", "fails", "good_lost", "toxic_lost")
    parts = postings(judged(docs, labels), size).select("part", "n", "lists").mapInArrow(_sizes, SIZES)
    sums = stored(parts.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in counts)))  # 80 rows for each part
    k = len(FILTERS)
    weight = F.element_at(F.array(*(F.lit(factorial(m) * factorial(k - 1 - m)) for m in range(k))), F.bit_count("before") + 1)
    own = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.max_by("removed", F.bit_count("before")).alias("unique_fails"))
    out = sums.join(F.broadcast(orders(docs.sparkSession)), ["filter", "before"]).join(bounded(own), ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS fails
  FROM w LEFT JOIN m USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a JOIN l b ON b.l <> a.l JOIN l c ON c.l NOT IN (a.l, b.l) JOIN l d ON d.l NOT IN (a.l, b.l, c.l) JOIN l e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, ascii(filter_order[CAST(step AS INT)]) - 65 AS i, coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(left(filter_order, CAST(step AS INT) - 1), '') IF x <> '']), 0)::BIGINT AS before FROM o, range(1, 6) r(step)),
d AS (SELECT DISTINCT i, before FROM s),
z AS (SELECT part, i, before, coalesce(sum(n) FILTER (fails & (before | (1 << i)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & (1 << i) <> 0 AND fails & before = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails & (1 << i) <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = 1 << i), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails & (1 << i) <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & (1 << i) <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost FROM g, d GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM z JOIN s USING (i, before)
"""
