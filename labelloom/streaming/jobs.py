"""Streams: continuous screening, daily trend, and how a stream is run over what is there (see timed for those with state).

Each job takes a streaming DataFrame and gives one. Late events are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_trend(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of each day; days close once the watermark has passed them. events: ts, event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.to_date("window.start").alias("day"), "n", "errors")


def screening(labels: DataFrame) -> DataFrame:
    """Rule checks of labels as they arrive; stateless but for each label's own rows, so made per batch (see replayed)."""
    from labelloom.operators.extraction import declarations
    from labelloom.operators.rules import evaluate

    return evaluate(declarations(labels))


def scored_screening(labels: DataFrame) -> DataFrame:
    """A row for each label of a batch: score, status, risk and its checks (fourteen), to be appended as one."""
    from labelloom.operators.scoring import scores

    checks = screening(labels).withColumnRenamed("label_id", "screening_id")
    own = F.sort_array(F.collect_list(F.struct("rule_id", "status", "reason", "value")))
    return scores(checks, more={"checks": own}).select(F.col("screening_id").alias("label_id"), "score", "status", "risk_level", "risk_score", "checks")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def replayed(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, parts: dict[str, str] | None = None, last: tuple[str, ...] = (), **settings: str) -> DataFrame | dict[str, DataFrame]:
    """Runs a stream over what is there and gives what it wrote below path.

    each: a batch job for every micro-batch. parts: tables by name and condition, instead of one; they are
    given by name. last: keys of which only the rows of the last batch count, for the update mode.
    settings: of the session, while it runs. A batch that is repeated writes its own folders anew.
    """
    spark = stream.sparkSession
    tables = parts or {"out": "true"}

    def write(batch: DataFrame, number: int) -> None:
        made = (each(batch) if each else batch).persist()
        for name, condition in tables.items():
            made.filter(condition).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        made.unpersist()

    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def read(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{name}")
        if last:
            rows = rows.join(rows.groupBy(*last).agg(F.max("batch").alias("batch")), [*last, "batch"], "left_semi")
        return rows.drop("batch")

    return {name: read(name) for name in tables} if parts else read("out")
