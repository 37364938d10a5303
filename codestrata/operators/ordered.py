"""Operators over ordered rows of a group.

``Window.partitionBy(group)`` sorts a whole group in one task, which fails when one
repository, user or file holds a third of the data. So the groups are counted first, by key
and on the map side. Without a hot group the plain window is the plan. With one, the rows are
dealt by ranges of (group, order): a partition is a run of neighbouring rows, whatever the
type of the order values and however the rows are spread over the groups. The table is
written once with the number of each row's partition, its *cell*. What a cell must know
about the cells before and after it (a row count, "was there a hit", the neighbouring row) is
computed on one row per group and cell and travels with the cell as one extra carry row, so
the big side needs no join and null groups keep together. A group that lies in one cell has
no carry row. With ``chunk``, a non-decreasing function of the first order column, hot groups
are cut by its values instead, and the rows are shuffled once.

``order`` must be a total order inside a group (append the key as tie-break).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.operators import skew
from codestrata.operators.skew import HOT, HotKeys, hot_keys
from codestrata.session import stored

CELL = "_cell"
CARRY = "_carry"
IS_ROW = "_is_row"
LEAST_CELL = 100  # rows of a cell at least, about


def order_key(order: Sequence[str]) -> Column:
    """One comparable value for the order columns; never null itself, nulls inside come first."""
    return F.struct(*order)


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotKeys) -> DataFrame:
    """The rows by ranges of keys and order, stored with their range's number; a range has about half of
    what a task may get, as far as hot groups make up the rows."""
    limit = max(1, skew.HOT_ROWS)
    rows = sum(r[-1] for r in hot.rows) * limit / 2
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + math.ceil(rows / max(LEAST_CELL, limit / 2))
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn(CELL, F.spark_partition_id()), "cells")


def _cells(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    summarise: list[Column],
    carry: Callable[[Window], list[Column]],
    hot: HotKeys | None = None,
):
    """Rows, plus one carry row for each cell of a group that was cut; with the windows over one cell.

    ``_carry`` is null in groups that were not. Without keys all rows are one group.
    """
    hot = hot_keys(df, keys) if hot is None else hot
    inside = (Window.partitionBy(*keys, CELL) if hot else Window.partitionBy(*keys)).orderBy(IS_ROW, *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*keys)
    if hot and chunk is None:
        rows = carriers = _dealt(df, keys, order, hot)
        own_cells = F.count(F.lit(1)).over(group)  # a group in one cell has nothing to carry
    else:
        marked = hot.mark(df) if hot and keys else df.withColumn(HOT, F.lit(1 if hot else None).cast("int"))
        rows = marked.withColumn(CELL, F.when(F.col(HOT).isNotNull(), chunk) if hot else F.lit(None))
        carriers = rows.where(F.col(HOT).isNotNull())
        rows, own_cells = rows.drop(HOT), F.lit(2)
    carried = (
        carriers.groupBy(*keys, CELL)
        .agg(*summarise)
        .select(*keys, CELL, F.struct(*carry(group.orderBy(CELL))).alias(CARRY), own_cells.alias("_cells"))
        .where(F.col("_cells") > 1)
        .drop("_cells")
    )
    rows = rows.withColumn(IS_ROW, F.lit(1))
    if not hot:
        nothing = F.lit(None).cast(carried.schema[CARRY].dataType)
        return rows.withColumn(CARRY, nothing), inside, so_far
    both = rows.unionByName(carried.withColumn(IS_ROW, F.lit(0)), allowMissingColumns=True)
    return both.withColumn(CARRY, F.first(CARRY).over(so_far)), inside, so_far


def _rows_only(df: DataFrame, *dropped: str) -> DataFrame:
    return df.where(F.col(IS_ROW) == 1).drop(CELL, CARRY, IS_ROW, *dropped)


def _place(inside: Window) -> Column:
    """0-based place among the rows of the cell; a carry row, where there is one, comes first."""
    return F.row_number().over(inside) - 1 - F.col(CARRY).isNotNull().cast("int")


def _carried(name: str, default=None) -> Column:
    """A carried value, or the default in groups without carry rows."""
    return F.coalesce(F.col(CARRY)[name], F.lit(default))


def _before(along: Window) -> Window:
    return along.rowsBetween(Window.unboundedPreceding, -1)


def _rows_before(along: Window) -> Column:
    return F.coalesce(F.sum("_n").over(_before(along)), F.lit(0)).alias("base")


def with_position(df, keys, order, out: str = "position", chunk: Column | None = None) -> DataFrame:
    """0-based position of each row in its group."""
    both, inside, _ = _cells(
        df, keys, order, chunk, [F.count(F.lit(1)).alias("_n")], lambda along: [_rows_before(along)]
    )
    place = _carried("base", 0) + _place(inside)
    return _rows_only(both.withColumn(out, place.cast("bigint")))


def running_totals(df, keys, order, totals: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """For each name, the sum of its expression over the rows before (0 for the first row)."""
    own = {name: f"_own_{name}" for name in totals}
    both, inside, _ = _cells(
        df.withColumns({own[name]: value for name, value in totals.items()}),
        keys,
        order,
        chunk,
        [F.sum(c).alias(c) for c in own.values()],
        lambda along: [F.coalesce(F.sum(c).over(_before(along)), F.lit(0)).alias(name) for name, c in own.items()],
    )
    sums = {name: _carried(name, 0) + F.coalesce(F.sum(c).over(_before(inside)), F.lit(0)) for name, c in own.items()}
    return _rows_only(both.withColumns(sums), *own.values())


def cursor(
    df, keys, order, columns: Sequence[str], chunk: Column | None = None, clamp: bool = False
) -> DataFrame:
    """Position, and the previous/next row's columns as ``prev_*`` / ``next_*``.

    Null at the ends; with ``clamp`` going back from the first row stays on the first row.
    """
    key, row = order_key(order), F.struct(*columns)
    both, inside, _ = _cells(
        df,
        keys,
        order,
        chunk,
        [
            F.count(F.lit(1)).alias("_n"),
            F.min_by(row, key).alias("_head"),
            F.max_by(row, key).alias("_tail"),
        ],
        lambda along: [
            _rows_before(along),
            F.lag("_tail").over(along).alias("before"),
            F.lead("_head").over(along).alias("after"),
        ],
    )
    place = _place(inside)
    last = F.lead(IS_ROW).over(inside).isNull()
    out = both.withColumn("position", (_carried("base", 0) + place).cast("bigint"))
    for name in columns:
        prev = F.when(place == 0, F.col(CARRY)["before"][name]).otherwise(F.lag(name).over(inside))
        if clamp:
            prev = F.when(F.col("position") == 0, F.col(name)).otherwise(prev)
        following = F.when(last, F.col(CARRY)["after"][name]).otherwise(F.lead(name).over(inside))
        out = out.withColumn(f"prev_{name}", prev).withColumn(f"next_{name}", following)
    return _rows_only(out)


def take_while(
    df, keys, order, keep: Column, skip: Column | None = None, chunk: Column | None = None
) -> DataFrame:
    """Rows before the first one that fails ``keep``; rows with ``skip`` neither stop it nor stay."""
    if skip is not None:
        df = df.where(~F.coalesce(skip, F.lit(False)))
    failed = (~F.coalesce(keep, F.lit(False))).cast("int")
    both, _, so_far = _cells(
        df.withColumn("_failed", failed),
        keys,
        order,
        chunk,
        [F.max("_failed").alias("_any")],
        lambda along: [F.coalesce(F.max("_any").over(_before(along)), F.lit(0)).alias("stopped")],
    )
    in_cell = F.coalesce(F.max("_failed").over(so_far), F.lit(0))
    return _rows_only(
        both.withColumn("_stopped", F.greatest(_carried("stopped", 0), in_cell)).where(
            F.col("_stopped") == 0
        ),
        "_failed",
        "_stopped",
    )


def skip_until(df, keys, order, hit: Column, chunk: Column | None = None) -> DataFrame:
    """Rows after the first hit; the hit row itself is dropped too. No hit, no rows."""
    both, inside, _ = _cells(
        df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int")),
        keys,
        order,
        chunk,
        [F.max("_hit").alias("_any")],
        lambda along: [F.coalesce(F.max("_any").over(_before(along)), F.lit(0)).alias("seen")],
    )
    earlier = F.coalesce(F.max("_hit").over(_before(inside)), F.lit(0))
    return _rows_only(
        both.withColumn("_seen", F.greatest(_carried("seen", 0), earlier)).where(
            F.col("_seen") == 1
        ),
        "_hit",
        "_seen",
    )


def skipped_steps(df, keys, order, hit: Column, chunk: Column | None = None) -> DataFrame:
    """Per group, the 0-based position of the first hit; groups without one carry an error."""
    placed = with_position(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), keys, order, chunk=chunk)
    return (
        placed.groupBy(*keys)
        .agg(F.min(F.when(F.col("_hit"), F.col("position"))).alias("skipped"))
        .withColumn("error", F.when(F.col("skipped").isNull(), F.lit("CanNotFindFirstCommit")))
    )


def limit_after(df, keys, order, hit: Column, n: int, chunk: Column | None = None) -> DataFrame:
    """The first ``n`` rows after the first hit of each group.

    For a small ``n`` the rank filter becomes a window group limit: at most ``n`` rows per
    group and input task are shuffled for the final ranking. For a large one, where Spark
    would not push the limit down, rows are numbered cell by cell instead.
    """
    after = skip_until(df, keys, order, hit, chunk)
    pushed = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if keys and n <= pushed:
        ranking = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return after.withColumn("_rank", ranking).where(F.col("_rank") <= n).drop("_rank")
    placed = with_position(after, keys, order, "_position", chunk)
    return placed.where(F.col("_position") < n).drop("_position")


def batches(df, keys, order, size: int = 30, out: str = "batch", chunk: Column | None = None) -> DataFrame:
    """Number the rows of each group in consecutive batches of ``size``."""
    placed = with_position(df, keys, order, "_position", chunk)
    return placed.withColumn(out, F.floor(F.col("_position") / size)).drop("_position")


def carry_down(df, keys, order, marks: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """For each mark, its last non-null value up to and including the row (e.g. enclosing scope)."""
    key = order_key(order)
    for name, mark in marks.items():
        df = df.withColumn(f"_mark_{name}", mark)
    both, _, so_far = _cells(
        df,
        keys,
        order,
        chunk,
        [
            F.max_by(f"_mark_{n}", F.when(F.col(f"_mark_{n}").isNotNull(), key)).alias(f"_last_{n}")
            for n in marks
        ],
        lambda along: [
            F.last(f"_last_{n}", ignorenulls=True).over(_before(along)).alias(n) for n in marks
        ],
    )
    for name in marks:
        local = F.last(f"_mark_{name}", ignorenulls=True).over(so_far)
        both = both.withColumn(name, F.coalesce(local, F.col(CARRY)[name]))
    return _rows_only(both, *[f"_mark_{n}" for n in marks])


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key; partial aggregation keeps one row per key and task."""
    return _pick(df, keys, F.min_by, order)


def last_wins(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys, choose, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(choose(F.struct(*rest), order_key(order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )
