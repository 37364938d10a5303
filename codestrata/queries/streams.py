"""Streaming forms, driven to completion over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.queries import Catalog, table
from codestrata.session import work_path
from codestrata.sources.readers import stream_findings
from codestrata.sources.writers import append_stream, write_findings
from codestrata.streaming.logs import check_records, drain_to_table, drain_windows, finding_counts, read_drained, read_windows, run_status, windowed_counts

CATALOG = Catalog()
query = CATALOG.add


def _event_stream(spark, d):
    """The table's own path, one file or a folder of part files: a pattern that only it matches, as a
    stream of one file must be a pattern."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query(
    """
    SELECT 'user' || user_id AS repo, 'CWE-' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS cwe_id, count(*) AS cwe_id_occur
    FROM events WHERE event_type <> 'signup' GROUP BY ALL
    """
)
def stream_counts(spark, d):
    """Events written as a findings log by one stream, counted per repo and id by another."""
    ident = F.concat(F.lit("<CWE-ID>CWE-"), F.from_json("props", "k bigint")["k"].cast("string"))
    logged = _event_stream(spark, d).select(
        F.when(F.col("event_type") != "signup", ident).alias("cweID"),
        F.concat(F.lit("/data/micros/user"), F.col("user_id").cast("string"), F.lit("/a.c")).alias("fileName"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.col("event_type").alias("msg"),
    )
    log, result = work_path(spark, "log"), work_path(spark, "counts")
    append_stream(logged, log).awaitTermination()
    drain_to_table(finding_counts(stream_findings(spark, log)), result).awaitTermination()
    return read_drained(spark, result, ["repo", "cwe_id"])


@query(
    """
    SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS status, count(*) AS events,
           bool_or(event_type = 'error') AS failed
    FROM events GROUP BY user_id
    """
)
def stream_status(spark, d):
    """Latest event per user, kept up to date by a stream."""
    result = work_path(spark, "status")
    latest = run_status(_event_stream(spark, d), "user_id", "event_type", ["ts", "event_id"], "error")
    drain_to_table(latest, result).awaitTermination()
    return read_drained(spark, result, ["user_id"])


@query(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS cwe_id, count(*) AS cwe_id_occur
    FROM events WHERE event_type <> 'signup' GROUP BY ALL
    """
)
def stream_windows(spark, d):
    """Events per day and kind, by event time; the lateness covers the whole log."""
    logged = _event_stream(spark, d).select(
        F.when(F.col("event_type") != "signup", F.concat(F.lit("CWE-1 "), F.col("event_type"))).alias("cweID"),
        F.concat(F.lit("/data/micros/"), F.col("event_type"), F.lit("/a.c")).alias("fileName"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
    )
    result = work_path(spark, "windows")
    drain_to_table(windowed_counts(logged, "36500 days", "1 day"), result).awaitTermination()
    counts = read_drained(spark, result, ["window", "repo", "cwe_id"])
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("repo").alias("cwe_id"), "cwe_id_occur")


@query(
    """
    WITH e AS (SELECT event_type AS cwe_id, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
                      least(3, (day(ts) + CASE WHEN event_id % 10 = 0 THEN 5 ELSE 0 END) // 8) AS arrival
               FROM events WHERE event_type <> 'signup'),
    c AS (SELECT a.arrival, max(e.ts) AS newest FROM (SELECT DISTINCT arrival FROM e) a LEFT JOIN e ON e.arrival < a.arrival GROUP BY 1),
    m AS (SELECT cwe_id, day, coalesce(day + INTERVAL 1 DAY <= newest - INTERVAL 2 DAY, false) AS late FROM e JOIN c USING (arrival))
    SELECT strftime(day, '%Y-%m-%d') AS day, cwe_id, count(*) FILTER (NOT late) AS cwe_id_occur, count(*) FILTER (late) AS late_occur,
           day + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 2 DAY AS closed
    FROM m GROUP BY m.day, cwe_id
    """
)
def stream_late(spark, d):
    """Events per day and kind, arriving in four deliveries; each tenth event is delivered as if five days later.

    Windows of a day close two days after their end; what comes later is counted apart."""
    delay = F.when(F.col("event_id") % 10 == 0, 5).otherwise(0)
    findings = table(spark, d, "events").select(
        F.when(F.col("event_type") != "signup", F.concat(F.lit("CWE-1 "), F.col("event_type"))).alias("cweID"),
        F.concat(F.lit("/data/micros/"), F.col("event_type"), F.lit("/a.c")).alias("fileName"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.least(F.lit(3), F.floor((F.dayofmonth("ts") + delay) / 8)).alias("arrival"),
    )
    log, result, state = work_path(spark, "log"), work_path(spark, "late"), work_path(spark, "state")
    for delivery in range(4):
        write_findings(findings.where(F.col("arrival") == delivery).drop("arrival"), log)
        drain_windows(stream_findings(spark, log, max_files=None), result, "2 days", "1 day", state).awaitTermination()
    counts = read_windows(spark, result, "2 days")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("repo").alias("cwe_id"), "cwe_id_occur", "late_occur", "closed")


@query(
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WrongFieldValueType' WHEN 2 THEN 'UnknownField' WHEN 3 THEN 'NoCommand' END AS reason
    FROM events
    """
)
def stream_validate(spark, d):
    """Records made of each event: as it is (a number where text must be), right, with an unknown key, and damaged."""
    events = _event_stream(spark, d)
    kind = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"'))
    record = (
        F.when(F.col("event_id") % 4 == 0, F.col("props"))
        .when(F.col("event_id") % 4 == 1, F.concat(kind, F.lit("}")))
        .when(F.col("event_id") % 4 == 2, F.concat(kind, F.lit(',"other":"x"}')))
        .otherwise(kind)
    )
    checked = check_records(events.select("event_id", record.alias("value")), "value", ["k"])
    result = work_path(spark, "checked")
    append_stream(checked.select("event_id", "reason"), result, "parquet").awaitTermination()
    return spark.read.parquet(result)
