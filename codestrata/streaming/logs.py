"""Findings, progress events and compile records as append streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.operators.commands import check_records
from codestrata.operators.findings import extract_id, extract_repo, match_filter, not_null, value_counts
from codestrata.session import work_path

validate_stream = check_records  # stateless: one function for batch and stream


def finding_rows(findings: DataFrame) -> DataFrame:
    """Non-null, id-bearing findings with ``cwe_id`` and ``repo`` (batch or stream)."""
    kept = match_filter(not_null(findings, "cweID"), "cweID")
    return extract_repo(extract_id(kept, "cweID"), "fileName")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Running count per repo and id; state holds one row per (repo, id)."""
    return value_counts(finding_rows(findings), ["repo"], "cwe_id", "cwe_id_occur")


def windowed_counts(findings: DataFrame, lateness: str, window: str = "1 hour") -> DataFrame:
    """Counts per event-time window. A stream drops rows more than ``lateness`` behind the newest
    event once their window closed, which also bounds the state; a batch has no late rows. Rows
    without a time have no window: ``untimed_counts`` has them."""
    stamped = finding_rows(findings).withColumn("ts", F.timestamp_millis("time"))
    return (
        stamped.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "repo", "cwe_id")
        .agg(F.count(F.lit(1)).alias("cwe_id_occur"))
    )


def untimed_counts(findings: DataFrame) -> DataFrame:
    """Counts of the findings that ``windowed_counts`` leaves out, having no time."""
    return value_counts(finding_rows(findings).where(F.col("time").isNull()), ["repo"], "cwe_id", "cwe_id_occur")


def run_status(events: DataFrame, run: str = "run", kind: str = "kind", order: str | Sequence[str] = "seq", error_kind: str = "EncounterError") -> DataFrame:
    """Latest kind per run, number of events, and whether an error was seen."""
    key = F.col(order) if isinstance(order, str) else F.struct(*order)
    return events.groupBy(run).agg(
        F.max_by(kind, key).alias("status"),
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.bool_or(F.col(kind) == error_kind), F.lit(False)).alias("failed"),
    )


def drain_to_table(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Run an aggregating stream over what is available.

    A batch writes the groups it changed, once, to a folder of its own, which replaces what an
    earlier try of the same batch left; ``read_drained`` takes each group from its last batch.
    """

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint or work_path(df.sparkSession, "state"))
        .foreachBatch(changed)
        .trigger(availableNow=True)
        .start()
    )


def read_drained(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table that ``drain_to_table`` keeps: each group as the last batch that changed it has it."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("bigint")).alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def drain_windows(findings: DataFrame, path: str, lateness: str, window: str = "1 hour", checkpoint: str | None = None) -> StreamingQuery:
    """Count a stream by event-time window, and what comes too late for its window apart, over what is available.

    A window closes when it ended ``lateness`` before the newest event of earlier batches; a row of a closed
    window is late. Each batch writes its own sums, and the newest event so far, to folders of its
    own; so nothing stays in memory between batches, and a batch tried again finds the same clock and replaces
    what it left. ``read_windows`` sums them. Rows without a time have no window (``untimed_counts``).
    """

    def book(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first().newest if batch_id else None
        clock = F.lit(known).cast("timestamp")
        sums = (
            finding_rows(batch).withColumn("ts", F.timestamp_millis("time"))
            .groupBy(F.window("ts", window), "repo", "cwe_id")
            .agg(F.count(F.lit(1)).alias("occur"), F.max("ts").alias("newest"))
            .withColumn("late", F.coalesce(_closed(clock, lateness), F.lit(False)))
        )
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")
        written = spark.read.schema(sums.schema).parquet(f"{path}/sums/batch={batch_id}")
        newest = written.agg(F.greatest(F.max("newest"), clock).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")

    return (
        findings.writeStream.option("checkpointLocation", checkpoint or work_path(findings.sparkSession, "state"))
        .foreachBatch(book)
        .trigger(availableNow=True)
        .start()
    )


def _closed(clock: Column, lateness: str) -> Column:
    return F.col("window.end") <= clock - F.expr(f"INTERVAL {lateness}")


def read_windows(spark: SparkSession, path: str, lateness: str) -> DataFrame:
    """What ``drain_windows`` keeps: ``window, repo, cwe_id, cwe_id_occur, late_occur, closed``.

    ``cwe_id_occur`` of a closed window is final; with ``late_occur`` it is the count of a batch over the whole log."""
    newest = spark.read.parquet(f"{path}/clock/batch=*").agg(F.max("newest")).first()[0]
    sums = spark.read.parquet(f"{path}/sums/batch=*")
    return (
        sums.groupBy("window", "repo", "cwe_id")
        .agg(
            F.sum(F.when(F.col("late"), 0).otherwise(F.col("occur"))).alias("cwe_id_occur"),
            F.sum(F.when(F.col("late"), F.col("occur")).otherwise(0)).alias("late_occur"),
        )
        .withColumn("closed", F.coalesce(_closed(F.lit(newest).cast("timestamp"), lateness), F.lit(False)))
    )
