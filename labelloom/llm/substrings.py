"""Exact substring dedup by Rabin-Karp hashes of every 13-word window.

Each window's hash is counted over all documents. A window is repeated if the
same words also start in a document with a smaller doc_id; repeated windows of a
document merge into maximal intervals, and the words they cover are removed.

Packs are ranges of doc_id, so a window is repeated for every document of a pack
if a pack before has it, and otherwise for all documents of the pack but the
smallest that has it. Hashes have 64 bits; the chance that any two of n distinct
windows share one is below n * n / 2 ** 65.

Defined results: a null text has no words; rows with a null doc_id are neither
removed from nor a cause of removal; rows with equal doc_id don't remove from
each other; a document of fewer words than a window is kept; texts are read whole,
however long; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from labelloom.llm.common import table
from labelloom.llm.packs import U64, Packed, documents, window_hashes, word_hashes
from labelloom.llm.packs import _schema as arrow_schema

WINDOW = 13
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _keys(window: int):
    def run(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([window_hashes(word_hashes((t or b"").split()), window) for t in texts] or [np.zeros(0, U64)]))
        return keys, keys

    return run


def _in_earlier_pack(keys: np.ndarray, packs: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """keys sorted, equal ones by pack: those whose pack has a place after the first of their run."""
    if not len(keys):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return packs > np.repeat(packs[first], np.diff(np.append(first, len(keys))))


def _finish(window: int, with_text: bool):
    def run(pack: pa.Table, answers: list[bytes]) -> pa.Table:
        ids, texts = documents(pack)
        words = [(t or b"").split() for t in texts]
        hashes = [window_hashes(word_hashes(w), window) for w in words]
        known = [k for k, i in enumerate(ids) if i is not None]
        flat = np.concatenate([hashes[k] for k in known] or [np.zeros(0, U64)])
        owner = np.repeat(np.array([ids[k] for k in known], np.int64), [len(hashes[k]) for k in known])
        keys, at = np.unique(flat, return_inverse=True)
        n = len(keys)
        earlier = np.unpackbits(np.concatenate([np.frombuffer(a[4:], np.uint8) for a in answers]), bitorder="little") if answers else np.zeros(0, np.uint8)
        if answers:  # each answer was padded to whole bytes
            sizes = [int.from_bytes(a[:4], "little") for a in answers]
            starts = np.cumsum([0, *(8 * (len(a) - 4) for a in answers)])[:-1]
            earlier = np.concatenate([earlier[s : s + m] for s, m in zip(starts, sizes, strict=True)])
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, at, owner)
        repeated = (earlier[at] > 0) | (owner > first[at]) if n else np.zeros(0, bool)
        out, place = [], 0
        for k, w in enumerate(words):
            kept = w
            if ids[k] is not None and len(hashes[k]):
                again = np.flatnonzero(repeated[place : place + len(hashes[k])])
                place += len(hashes[k])
                if len(again):
                    step = np.zeros(len(w) + 1, np.int64)
                    step[again] += 1
                    np.add.at(step, again + window, -1)
                    kept = [x for x, gone in zip(w, (np.cumsum(step)[:-1] > 0).tolist(), strict=True) if not gone]
            joined = b" ".join(kept)
            out.append((ids[k], len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
        return pa.table(list(zip(*out, strict=True)) if out else [[]] * 5, schema=arrow_schema(RESULT))

    return run


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags, bitorder="little").tobytes()


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words joined by one space, for every row."""
    packed = Packed(docs.select("doc_id", "text"), 0.2, **how)
    answers = packed.answered(packed.asked(_keys(window), False, skip_null=True), _in_earlier_pack, _bits)
    return packed.resolved(answers, _finish(window, with_text), RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).drop("kept")


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract's columns by plain search, for tests."""
    import regex

    words = [(i, regex.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least: dict[tuple[str, ...], int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


#: Windows as arrays; the smallest document of each by a window function.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, list_aggregate(w[i:i+12], 'string_agg', ' ') AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM h) WHERE least < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, range(13) t(k) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, len(coalesce(gone, [])) AS m, [w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)] AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
