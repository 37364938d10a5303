"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.session import work_path


def write_findings(df: DataFrame, path: str, required: str = "cweID", mode: str = "append") -> None:
    """JSON lines; rows without a diagnosis are left out."""
    df.where(F.col(required).isNotNull()).write.mode(mode).json(path)


def report_lines(reports: DataFrame, file: str = "file", report: str = "report") -> DataFrame:
    """One JSON object per file: {"file": ..., "report": {...}}; the report stays an object."""
    quoted = F.to_json(F.array(file))  # a JSON string inside brackets, which are cut off
    name = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return reports.select(
        F.concat(F.lit('{"file":'), name, F.lit(',"report":'), F.col(report), F.lit("}")).alias("value")
    )


def write_reports(reports: DataFrame, path: str, file: str = "file", report: str = "report", mode: str = "append") -> None:
    report_lines(reports, file, report).write.mode(mode).text(path)


def append_stream(df: DataFrame, path: str, fmt: str = "json", checkpoint: str | None = None) -> StreamingQuery:
    """Drain what is available into an append-only file sink (exactly once)."""
    return (
        df.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint or work_path(df.sparkSession, "offsets"))
        .trigger(availableNow=True)
        .start(path)
    )
