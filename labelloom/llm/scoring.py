"""Stupid-backoff scores of documents under the trigram model of all documents.

Count tables of 1-, 2- and 3-grams over the whole corpus are partitioned by hash.
Grams of fewer than ``least`` occurrences are cut from the 2- and 3-gram tables;
``least`` = 1 keeps every gram. A word's score is
count(trigram) / count(its first two words) if the trigram is in its table, else
BACKOFF times the bigram's, else BACKOFF times BACKOFF times count(word) / all
words; a document's first words have shorter grams. Each pack of documents is
exploded into its grams, whose distinct hashes meet the count tables bucket by
bucket; the counts come back to the pack and the logarithms are summed per
document, in whole millionths so that sums don't depend on order.

Defined results: a null text has no words, score 0 and mean null; a null doc_id
is scored like any other; repeated rows count and are scored each; texts are
scored whole, however long; other columns are ignored; an empty table gives no
rows. Grams are known by hashes: two share one with a chance of about 2 ** -29
each, and then have the sum of their counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import table
from labelloom.llm.packs import U64, Packed, documents, window_hashes, word_hashes
from labelloom.llm.packs import _schema as arrow_schema

ORDER = 3
BACKOFF = 0.4
LEAST = 2
#: Bits of a gram's hash that are kept below its bucket's: with at least 8 bucket bits, and one more whenever the
#: corpus doubles, a gram shares its hash with another with a chance of about 2 ** -29.
KEPT_BITS = 48
RESULT = "doc_id long, n_words long, micro long, n_backed_off long"
#: Stands for "any word": its count is the number of words.
ANY = U64(0)


def _grams(texts: list[bytes | None]) -> list[list[np.ndarray]]:
    """For each text the hashes of its 1-, 2- and 3-grams."""
    out = []
    for t in texts:
        w = word_hashes((t or b"").split())
        out.append([window_hashes(w, n) for n in range(1, ORDER + 1)])
    return out


def _keys(cut: Callable[[np.ndarray], np.ndarray]):
    def run(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        grams = _grams(texts)
        keys, counts = np.unique(cut(np.concatenate([g for x in grams for g in x] or [np.zeros(0, U64)])), return_counts=True)
        return np.concatenate(([ANY], keys)), np.concatenate(([sum(len(x[0]) for x in grams)], counts)).astype(np.int64)

    return run


def _totals(keys: np.ndarray, packs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return np.repeat(np.add.reduceat(counts.astype(np.int64), first), np.diff(np.append(first, len(keys))))


def _form(totals: np.ndarray) -> bytes:
    """One byte for counts below 255, and the rest by place."""
    large = np.flatnonzero(totals >= 255)
    small = np.minimum(totals, 255).astype(np.uint8)
    return len(totals).to_bytes(4, "little") + small.tobytes() + large.astype("<i4").tobytes() + totals[large].astype("<i8").tobytes()


def _unformed(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    out = np.frombuffer(b, np.uint8, n, 4).astype(np.int64)
    m = (len(b) - 4 - n) // 12
    out[np.frombuffer(b, "<i4", m, 4 + n)] = np.frombuffer(b, "<i8", m, 4 + n + 4 * m)
    return out


def _finish(cut: Callable[[np.ndarray], np.ndarray], least: int):
    def run(pack: pa.Table, answers: list[bytes]) -> pa.Table:
        ids, texts = documents(pack)
        return _pack_scores(ids, _grams(texts), cut, answers, least)

    return run


def _pack_scores(ids: list[int | None], grams: list[list[np.ndarray]], cut: Callable[[np.ndarray], np.ndarray], answers: list[bytes], least: int) -> pa.Table:
    flat = cut(np.concatenate([g for x in grams for g in x] or [np.zeros(0, U64)]))
    _, at = np.unique(flat, return_inverse=True)
    totals = np.concatenate([_unformed(a) for a in answers])
    count, words = totals[1:][at] if len(at) else np.zeros(0, np.int64), int(totals[0])
    out, place = [], 0
    for i, x in zip(ids, grams, strict=True):
        c = []
        for g in x:
            c.append(count[place : place + len(g)])
            place += len(g)
        n = len(c[0])
        ln = np.log(c[0] / words) if n else np.zeros(0)
        depth = np.zeros(n, np.int64)  # orders below the highest that the word's place allows
        for k in range(1, ORDER):
            if n > k:
                seen = c[k] >= least
                higher = np.log(np.where(seen, c[k], 1) / c[k - 1][: n - k])
                ln[k:] = np.where(seen, higher, np.log(BACKOFF) + ln[k:])
                depth[k:] = np.where(seen, 0, depth[k:] + 1)
        out.append((i, n, int(np.rint(ln * 1e6).astype(np.int64).sum()), int((depth > 0).sum())))
    return pa.table(list(zip(*out, strict=True)) if out else [[]] * 4, schema=arrow_schema(RESULT))


def scored(docs: DataFrame, least: int = LEAST, **how) -> DataFrame:
    """doc_id, n_words, score (natural logarithm), mean_score and n_backed_off for every row."""
    packed = Packed(docs.select("doc_id", "text"), 0.4, kept_bits=KEPT_BITS, **how)
    asked = packed.asked(_keys(packed.cut), True)
    raw = packed.resolved(packed.answered(asked, _totals, _form), _finish(packed.cut, least), RESULT)
    return raw.select("doc_id", "n_words", (F.col("micro") / 1e6).alias("score"), F.when(F.col("n_words") > 0, F.col("micro") / 1e6 / F.col("n_words")).alias("mean_score"), "n_backed_off")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents", "doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, c, lag(c, 1) OVER p AS b, lag(c, 2) OVER p AS a FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
n1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT g.doc_id, g.a, g.b, n1.n / (SELECT count(*) FROM t) AS s1,
    CASE WHEN n2.n >= 2 THEN n2.n / pb.n END AS s2, CASE WHEN n3.n >= 2 THEN n3.n / pab.n END AS s3
  FROM g JOIN n1 ON g.c = n1.c LEFT JOIN n2 ON g.b = n2.b AND g.c = n2.c LEFT JOIN n1 pb ON g.b = pb.c
  LEFT JOIN n3 ON g.a = n3.a AND g.b = n3.b AND g.c = n3.c LEFT JOIN n2 pab ON g.a = pab.b AND g.b = pab.c
), v AS (
  SELECT doc_id, CASE WHEN s3 IS NOT NULL THEN ln(s3)
      WHEN s2 IS NOT NULL THEN ln(s2) + CASE WHEN a IS NOT NULL THEN ln(0.4) ELSE 0 END
      ELSE ln(s1) + CASE WHEN a IS NOT NULL THEN 2 * ln(0.4) WHEN b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS l,
    a IS NOT NULL AND s3 IS NULL OR a IS NULL AND b IS NOT NULL AND s2 IS NULL AS off
  FROM s
), m AS (SELECT doc_id, count(*) AS n, CAST(sum(CAST(round_even(l * 1e6, 0) AS BIGINT)) AS BIGINT) AS micro, count(*) FILTER (WHERE off) AS off FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(micro, 0) / 1e6 AS score, CASE WHEN len(w) > 0 THEN micro / 1e6 / len(w) END AS mean_score,
  CAST(coalesce(off, 0) AS BIGINT) AS n_backed_off
FROM d LEFT JOIN m USING (doc_id)
"""
