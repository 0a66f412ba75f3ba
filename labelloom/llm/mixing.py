"""Mixing sources to target weights. DataFrame functions only.

Every source gets a weight; the targets share the size of all documents in
proportion to the weights, but none exceeds ``most`` times its source. What a
source can't take is shared out again by weight. In closed form: with lambda the
common size per unit of weight, target = min(most * size, weight * lambda), and
lambda is the largest value over the sources, in order of size per weight, of
(all - capped before) / (weights from here on).

A source's whole epochs are target // size. The rest is cut from its documents
in the order of a hash-random key: sizes are summed by the key's prefix, whose
length follows the number of rows, prefix sums over these sums find the prefix in
which the budget runs out, and only that prefix's rows are sorted. A document is taken if its middle lies
within the budget, so a source misses its target by half a document at most.
No window or group ever holds a whole source.

Defined results: a null text has size 0 and is never taken; a null source is the
last source; a null doc_id is a key of its text; rows with equal id and text
share a key and are taken together; further columns are passed on, whatever their
names; texts are sized whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import bounded, digits_for, key_bucket, row_key, stored, table, words_of

WEIGHTS = (5, 2, 1)
MOST = 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the random key of every row."""
    key = row_key(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), key.alias("key"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, epochs and rest (what is due beyond whole epochs)."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    i = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    s = s.select("*", F.element_at(F.array(*map(F.lit, weights)), (i % len(weights) + 1).cast("int")).cast("long").alias("weight"), i.alias("i"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "i")
    s = s.select(
        "*",
        F.sum("source_size").over(W.partitionBy()).alias("all"),
        F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("left"),
    )
    s = s.select("*", F.max((F.col("all") - F.col("capped")) / F.col("left")).over(W.partitionBy()).alias("lambda"))
    s = s.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.col("lambda")).alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return s.select("*", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with cut_key: a source's keys up to it are taken once more than ``epochs``. Null: none."""
    targets, digits = bounded(targets), digits_for(rows.count())
    t = targets.select(F.col("source").alias("__source"), "rest")
    sums = rows.groupBy("source", key_bucket(F.col("key"), digits).alias("bucket")).agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = sums.join(t, F.col("source").eqNullSafe(F.col("__source"))).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum")))
    at = at.select("__source", F.col("bucket").alias("__bucket"), "before", "rest")
    near = rows.join(at, rows["source"].eqNullSafe(at["__source"]) & (key_bucket(rows["key"], digits) == at["__bucket"]))
    near = near.groupBy("source", "key", "__bucket", "before", "rest").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(W.partitionBy("source").orderBy("key")) + F.col("before")
    last = near.withColumn("upto", run).groupBy("source").agg(F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), F.col("key"))).alias("last"))
    last = last.withColumnRenamed("source", "__last_source")
    out = targets.join(at.select("__source", "__bucket"), targets["source"].eqNullSafe(F.col("__source")), "left")
    out = out.join(last, targets["source"].eqNullSafe(F.col("__last_source")), "left")
    return out.select(*(targets[c] for c in targets.columns), F.coalesce("last", "__bucket").alias("cut_key"))


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, key and others) with the plan's columns as p_* and copies, the number of times the mix takes each."""
    p = bounded(plan)
    p = p.withColumnsRenamed({c: f"p_{c}" for c in p.columns})
    copies = F.col("p_epochs") + F.when(F.col("key") <= F.col("p_cut_key"), 1).otherwise(0)
    return rows.join(p, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("copies", copies)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns it came with."""
    rows = stored(sized(docs))
    plan = cuts(rows, source_targets(rows, weights, most))
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    c = {name: own[f"c{i}"] for i, name in enumerate(docs.columns)}
    has = F.coalesce(c["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = own.select("*", c["source"].alias("source"), row_key(c["doc_id"], c["text"]).alias("key"), has.alias("has"))
    taken = _with_copies(keyed, plan).filter(F.col("has") & (F.col("copies") > 0))
    repeated = taken.select(*own.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.drop("copy").toDF(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sized(table(spark, sf_dir, "documents", "doc_id", "text", "source")))
    plan = cuts(rows, source_targets(rows))
    out = _with_copies(rows, plan)
    return out.select("doc_id", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
i AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS weight FROM s),
w AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM i
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT max((total - capped) / rest) FROM w)) AS target FROM w
), e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN 2 * sum(size) OVER (PARTITION BY d.source ORDER BY key) - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
