"""Findings analytics: filter, extract, count, pivot, ratio."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codestrata.functions.text import (
    CODE_TAG,
    CWE_PATTERN,
    ID_TAG,
    REPO_MARKER,
    clean_code,
    clean_id,
    extract,
    extract_segment,
    tagged_block,
)
from codestrata.operators.skew import salted_join

NULL_GROUP = "null"
OTHER_GROUPS = "other"


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def extract_id(df: DataFrame, source: str, pattern: str = CWE_PATTERN, out: str = "cwe_id") -> DataFrame:
    return df.withColumn(out, extract(F.col(source), pattern))


def extract_repo(df: DataFrame, source: str, marker: str = REPO_MARKER, out: str = "repo") -> DataFrame:
    return df.withColumn(out, extract_segment(F.col(source), marker))


def match_filter(df: DataFrame, column: str, pattern: str = CWE_PATTERN) -> DataFrame:
    """Rows whose column matches anywhere; null rows drop."""
    return df.where(F.col(column).rlike(pattern))


def filter_rows(df: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """A caller's predicate as a Column, so it stays inside the plan."""
    return df.where(predicate(df))


def height(df: DataFrame, out: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def hit_ratio(df: DataFrame, predicate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows that satisfy the predicate, over all rows, in one pass."""
    return (
        df.groupBy(*by)
        .agg(F.count_if(predicate).alias("hits"), F.count(F.lit(1)).alias("total"))
        .withColumn("ratio", F.col("hits") / F.nullif(F.col("total"), F.lit(0)))
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str, out: str = "occurrences") -> DataFrame:
    """Count per (group, value). Row order is given by ``ranked_counts`` where it is wanted."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(out))


def ranked_counts(df: DataFrame, by: Sequence[str], value: str, out: str = "occurrences") -> DataFrame:
    """``value_counts`` sorted by group, then count descending, then value."""
    return value_counts(df, by, value, out).orderBy(*by, F.desc(out), value)


def value_counts_nested(df: DataFrame, by: Sequence[str], value: str, out: str = "occurrences") -> DataFrame:
    """One array<struct(value, count)> per group, count descending, ties by value.

    Only counted values are collected, one element per distinct value of the group; use
    ``value_counts`` where a group may have more values than fit one row.
    """
    counted = value_counts(df, by, value, out)
    by_count = F.sort_array(F.collect_list(F.struct((-F.col(out)).alias("_k"), value, out)))
    return counted.groupBy(*by).agg(
        F.transform(by_count, lambda e: F.struct(e[value].alias(value), e[out].alias(out))).alias(out)
    )


def unnest(df: DataFrame, column: str) -> DataFrame:
    """Explode an array of structs and turn its fields into columns; empty arrays give no rows."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.inline(column))


def pivot_counts(
    df: DataFrame, index: str, on: str, values: Sequence[str] | None = None, fill_zero: bool = True
) -> DataFrame:
    """Rows = ``index``, one count column per ``on`` value (sorted), absent cells 0.

    Counting happens first, so only (index, on, count) rows reach the pivot. With
    ``values`` the plan is fully lazy: rows without a group count in column ``null``, rows of
    groups that are not listed in column ``other``. Without, the distinct group names are
    read once; more than ``spark.sql.pivotMaxValues`` are an error.
    """
    named = F.coalesce(F.col(on).cast("string"), F.lit(NULL_GROUP))
    if values is not None:
        values = sorted({*map(str, values), NULL_GROUP, OTHER_GROUPS})
        named = F.when(named.isin(values), named).otherwise(OTHER_GROUPS)
    counted = value_counts(df.withColumn(on, named), [index], on, "_n")
    if values is None:
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        names = counted.select(on).distinct().limit(limit + 1).collect()
        if len(names) > limit:
            raise ValueError(f"more than {limit} groups: use value_counts, the long form")
        values = [r[0] for r in names]
    values = sorted(values)
    wide = counted.groupBy(index).pivot(on, values).agg(F.sum("_n"))
    return wide.na.fill(0, values) if fill_zero else wide


def unpivot(pivoted: DataFrame, index: str, group: str = "repo", out: str = "occurrences") -> DataFrame:
    """Back to one row per (group, index)."""
    names = [c for c in pivoted.columns if c != index]
    return pivoted.unpivot([index], names, group, out)


def chart_series(pivoted: DataFrame, index: str, group: str = "repo") -> DataFrame:
    """One series per pivot column: ``ids[]`` and ``counts[]``, both in index order."""
    points = F.sort_array(F.collect_list(F.struct(F.col(index).alias("id"), F.col("occurrences").alias("n"))))
    return (
        unpivot(pivoted, index, group)
        .where(F.col(index).isNotNull())
        .groupBy(group)
        .agg(points.alias("_points"))
        .select(
            group,
            F.col("_points")["id"].alias("ids"),
            F.col("_points")["n"].alias("counts"),
        )
    )


def stack_offsets(counts: DataFrame, index: str, group: str, count: str = "occurrences") -> DataFrame:
    """Base of each stacked bar: the sum over earlier groups of the same id.

    Input is counted rows, so a window holds one row per group of an id.
    """
    earlier = (
        Window.partitionBy(index).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("base", F.coalesce(F.sum(count).over(earlier), F.lit(0)))


def distinct_ids(df: DataFrame, column: str, approximate: bool = False, out: str = "ids") -> DataFrame:
    """Number of distinct non-null ids.

    Exact: ids are made distinct by a partial aggregate before the count. ``approximate``
    uses a fixed-size sketch.
    """
    counter = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(counter.alias(out))


def id_counts(df: DataFrame, column: str, out: str = "occurrences") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def adjudicate(findings: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings with the second opinion for their key (null when there is none).

    ``verdicts`` is unique on ``keys``; a problem id that dominates the findings is salted.
    """
    return salted_join(findings, verdicts, keys, "left")


def real_ratio(adjudicated: DataFrame, by: Sequence[str], real: Column) -> DataFrame:
    """Per group: all findings, findings judged real, and their share."""
    return (
        adjudicated.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(real).alias("real"))
        .withColumn("ratio", F.col("real") / F.nullif(F.col("total"), F.lit(0)))
    )


def validated_flag(df: DataFrame, column: str, allowed: Sequence[str] = ("YES", "NO")) -> tuple[DataFrame, DataFrame]:
    """(rows whose trimmed flag is allowed, the other rows)."""
    trimmed = df.withColumn(column, F.btrim(column, F.lit(" \t\r\n")))
    good = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return trimmed.where(good), trimmed.where(~good)


def verdict_tally(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def tagged_blocks(df: DataFrame, source: str, tags: dict[str, str], keep_tag: bool = False) -> DataFrame:
    """One column per tag with its inner text; all are '' unless every block has text."""
    found = {out: tagged_block(F.col(source), tag, keep_tag) for out, tag in tags.items()}
    complete = None
    for block in found.values():
        complete = (block != "") if complete is None else complete & (block != "")
    return df.withColumns({out: F.when(complete, b).otherwise("") for out, b in found.items()})


def diagnoses(responses: DataFrame, source: str = "response") -> DataFrame:
    """Model response text to the two finding columns."""
    return tagged_blocks(responses, source, {"codeWithIssue": CODE_TAG, "cweID": ID_TAG})


def display_columns(df: DataFrame, code: str = "codeWithIssue", ident: str = "cweID") -> DataFrame:
    """The cleaned code and id as the result table shows them."""
    return df.withColumns({code: clean_code(F.col(code)), ident: clean_id(F.col(ident))})


SKETCH_BITS = 14  # registers of a sketch as a power of two: a standard error of about 0.8 %


class DistinctTable:
    """Distinct ids for each group and day, kept as sketches that merge: any period of any groups is answered from
    a few rows, and a new batch is one aggregation of that batch alone.

    A batch adds rows of its own (groups, day, sketch). A sketch is a set: rows that overlap, an id of several days
    or a batch that is added twice change no answer.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], day: str = "day"):
        self.spark, self.path, self.by, self.day = spark, path, list(by), day

    def add(self, rows: DataFrame, ids: str) -> None:
        """Append the sketches of ``rows`` (the groups, the day, the ids; a null id is none)."""
        sketched = rows.groupBy(*self.by, self.day).agg(F.hll_sketch_agg(ids, SKETCH_BITS).alias("sketch"))
        sketched.write.mode("append").parquet(self.path)

    def compact(self, path: str) -> DistinctTable:
        """The same table with one row for each group and day, at ``path``."""
        self.read().groupBy(*self.by, self.day).agg(F.hll_union_agg("sketch").alias("sketch")).write.parquet(path)
        return DistinctTable(self.spark, path, self.by, self.day)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self, by: Sequence[str] | None = None, period: Column | None = None, within: Column | None = None, out: str = "ids") -> DataFrame:
        """Estimated distinct ids of each of ``by`` (the table's groups by default, or fewer) and each ``period``, a
        function of the day; ``within`` picks days."""
        rows = self.read() if within is None else self.read().where(within)
        keys = [*(self.by if by is None else by), *([] if period is None else [period.alias("period")])]
        return rows.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))
