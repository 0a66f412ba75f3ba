"""What several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a small side is broadcast.
SMALL_ROWS = 100_000


def by_label(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join. For tables with rows of every label: Spark takes their size for that of the few columns that texts are made from."""
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """df, hashed by partition in a join, never broadcast, so that the longer side (words) is not sorted. For a few short rows of every label."""
    return df.hint("shuffle_hash")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, broadcast if it has no more than ``rows`` rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
