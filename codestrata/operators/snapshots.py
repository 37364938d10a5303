"""Keyed comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codestrata.operators.ordered import order_key
from codestrata.operators.skew import salted_join


def snapshot_diff(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    left_order: Sequence[str] | None = None,
) -> DataFrame:
    """Keys, ``change`` and the row's fields.

    right only -> added; both and all fields equal -> common; both but different ->
    modified (right fields); left only -> removed (left fields). Null fields compare equal
    to null; null keys never match.

    Without ``left_order`` both sides must be unique on ``keys``: one full outer join.
    With it, duplicates are allowed: the last left row per key is the one compared with,
    and every right row, and every left row to be removed, is kept.
    """
    fields = list(compare or [c for c in left.columns if c not in keys])
    old = left.select(*keys, F.struct(*fields).alias("_old"))
    new = right.select(*keys, F.struct(*fields).alias("_new"))
    if left_order is None:
        both = old.join(new, list(keys), "full_outer")
        change = (
            F.when(F.col("_old").isNull(), "added")
            .when(F.col("_new").isNull(), "removed")
            .when(F.col("_old").eqNullSafe(F.col("_new")), "common")
            .otherwise("modified")
        )
        kept = F.coalesce("_new", "_old")
        return both.select(*keys, change.alias("change"), *[kept[f].alias(f) for f in fields])

    lookup = left.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), order_key(left_order)).alias("_old")
    )
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "common")
        .otherwise("modified")
    )
    probed = salted_join(new, lookup, keys, "left").select(
        *keys, change.alias("change"), *[F.col("_new")[f].alias(f) for f in fields]
    )
    gone = salted_join(old, right.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit("removed").alias("change"), *[F.col("_old")[f].alias(f) for f in fields]
    )
    return probed.unionByName(gone)


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose key does not occur on the right (rows keep their fields)."""
    return salted_join(left, right.select(*keys).distinct(), keys, "left_anti")


def identical_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows present on both sides, null-safe."""
    return left.select(*right.columns).intersect(right)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns missing in a part are null."""
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined
