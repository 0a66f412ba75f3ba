"""Sharding by a keyed permutation of global row numbers. DataFrame functions only.

Rows are numbered without gaps in the order of a hash-random key: counts by key
prefix, whose length follows the number of rows, give every prefix its first
number, and row numbers inside a prefix do the rest. A Feistel permutation with cycle walking takes the number
to a position; the position's remainder by the shard count is the shard, its
quotient the slot. The law is ``rows``: counts differ by one at most.

Defined results: a null text has size 1 and checksum 0; rows with equal id and
text are told apart by their order only, which changes no count; columns shard and
slot that the documents came with are replaced, others passed on, whatever their
names; texts of any length are passed on; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, digits_for, key_bucket, row_key, stored, table
from labelloom.llm.permute import permuted, permuted_sql

SHARDS = 16
KEY = "sharding-1"


def numbered(df: DataFrame, key: str, out: str) -> tuple[DataFrame, int]:
    """Adds a gapless number from 0 in the order of column key (a hex string), and gives the count. Column names b, i and first are taken."""
    digits = digits_for(df.count())
    counts = stored(df.groupBy(key_bucket(F.col(key), digits).alias("b")).agg(F.count("*").alias("n")))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = bounded(counts.select(F.col("b").alias("b0"), (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("first")))  # a row for each prefix
    within = F.row_number().over(W.partitionBy("b").orderBy(key)) - 1
    keyed = df.withColumn("b", key_bucket(F.col(key), digits)).withColumn("i", within)
    return keyed.join(starts, F.col("b") == F.col("b0")).select(*(F.col(c) for c in df.columns), (F.col("first") + F.col("i")).alias(out)), n


def shard(docs: DataFrame, shards: int = SHARDS, key: str = KEY) -> DataFrame:
    """The documents with shard int and slot long."""
    docs = docs.drop("shard", "slot")
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    c = {name: own[f"c{i}"] for i, name in enumerate(docs.columns)}
    rows, n = numbered(own.withColumn("key", row_key(c["doc_id"], c["text"])), "key", "number")
    at = F.col("at")
    placed = rows.withColumn("at", permuted(F.col("number"), max(n, 1), key))
    return placed.select(*own.columns, (at % shards).cast("int").alias("shard"), ((at - at % shards) / shards).cast("long").alias("slot")).toDF(*docs.columns, "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), row_key(F.col("doc_id"), F.col("text")).alias("key")
    )
    rows, n = numbered(narrow, "key", "number")
    rows = rows.withColumn("at", permuted(F.col("number"), max(n, 1), KEY))
    at = F.col("at")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (at % SHARDS).cast("int").alias("shard"),
        ((at - at % SHARDS) / SHARDS).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP9_SQL = rf"""
WITH RECURSIVE crc_step AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
    row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, '')))) - 1 AS number, count(*) OVER () AS n
  FROM documents
), s AS (
  SELECT doc_id, size, number, n,
    xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM d, crc_table
),
{permuted_sql("number", "n", KEY, "s")}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INT) AS shard,
  CAST(p // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM w12
"""
