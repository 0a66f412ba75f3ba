"""Column builders and helpers that the training-data operators share.

Words are maximal runs of characters outside space and U+0009..U+000D. A null
text has no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.shared import new_path, stored

__all__ = ["bounded", "let", "new_path", "row_key", "seeded", "stored", "table", "words_of"]

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words_of(text: Column) -> Column:
    """Array of a text's words, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits that depend on a row's id and text alone: a reproducible random key."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


#: Rows that share a prefix of a key, about, and hex digits of a prefix at least.
BUCKET_ROWS, LEAST_DIGITS = 50_000, 3


def digits_for(rows: int) -> int:
    """Hex digits of a key whose prefixes have BUCKET_ROWS rows or fewer, about."""
    return max(LEAST_DIGITS, -(-max(0, (rows // BUCKET_ROWS).bit_length()) // 4))


def key_bucket(key: Column, digits: int) -> Column:
    """One of 16 ** digits equally likely prefixes of a key; prefixes sort as their keys do."""
    return F.substring(key, 1, digits)


def seeded(seed: str, n: int, below: int) -> list[int]:
    """n reproducible numbers in [1, below) that follow from a seed."""
    return [int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8], "big") % (below - 1) + 1 for i in range(n)]


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of one row per source or the like: stored, and broadcast if it has no more than ``rows`` rows."""
    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
