"""Finding hot keys, and equi joins that survive them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

HOT = "_hot"
SALT = "_salt"
HOT_ROWS = 1_000_000  # rows of one key that one task may get
MOST_HOT = 100_000  # hot keys at most: what bounds the list that is sent around


class HotKeys(NamedTuple):
    """Hot keys with the number of parts each should be split into."""

    columns: list[str]
    rows: list[tuple]  # key values, then the number of parts

    def __bool__(self) -> bool:
        return bool(self.rows)

    def mark(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of parts in ``_hot``, null for rows of other keys."""
        names = [f"_hot_{c}" for c in self.columns]
        kinds = ", ".join(
            f"`{n}` {df.schema[c].dataType.simpleString()}" for n, c in zip(names, self.columns)
        )
        small = F.broadcast(df.sparkSession.createDataFrame(self.rows, f"{kinds}, {HOT} int"))
        same: Column = F.lit(True)
        for name, column in zip(names, self.columns):
            same = same & df[column].eqNullSafe(small[name])
        return df.join(small, same, "left").drop(*names)


def will_broadcast(df: DataFrame) -> bool:
    """Is the planner's own size estimate below its broadcast threshold?"""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= conf.autoBroadcastJoinThreshold()


def hot_keys(df: DataFrame, keys: Sequence[str]) -> HotKeys:
    """Keys too large for one task, counted by one job, with the parts to split each into.

    A key is hot when it holds more rows than HOT_ROWS, whatever its share; a part gets half of
    that. Only beyond MOST_HOT * HOT_ROWS rows in all does the limit of a task grow, so that
    the list stays below MOST_HOT keys and a few MB. The count reads the key columns only and
    is aggregated on the map side. An input below the broadcast threshold fits one task and is
    not counted.
    """
    keys = list(keys)
    if will_broadcast(df):
        return HotKeys(keys, [])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n")).limit(MOST_HOT).collect()
    limit = HOT_ROWS if len(found) < MOST_HOT else max(HOT_ROWS, found[-1]["_n"])
    return HotKeys(keys, [(*r[:-1], -(-2 * r["_n"] // max(1, limit))) for r in found if r["_n"] > limit])


def salted_join(
    probe: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join ``probe`` with ``lookup`` on ``keys``; no key's probe rows end up in one task.

    ``how``: left, inner, left_semi or left_anti. Three cases, cheapest first:

    * the planner will broadcast one side: a plain join, skew does not matter;
    * no hot key: a plain join, left to Catalyst and AQE;
    * hot keys: their probe rows get their partition number as salt (a retried task computes
      the same salt again) and only the hot lookup rows are copied, once per part. Probe rows
      with a null key match nothing; they are spread as well when they are many.

    ``hot`` takes the ``hot_keys`` of a cheaper frame with the same key distribution, when
    ``probe`` is a long computation that should not run once more just to be counted.
    """
    keys = list(keys)
    if probe.isStreaming or will_broadcast(lookup) or (how == "inner" and will_broadcast(probe)):
        return probe.join(lookup, keys, how)
    hot = hot_keys(probe, keys) if hot is None else hot
    if not hot:
        return probe.join(lookup, keys, how)
    part = F.pmod(F.spark_partition_id(), F.col(HOT))
    salted = hot.mark(probe).withColumn(SALT, F.coalesce(part, F.lit(0))).drop(HOT)
    every = F.sequence(F.lit(0), F.col(HOT) - 1)
    copies = (
        hot.mark(lookup)
        .withColumn(SALT, F.explode(F.when(F.col(HOT).isNotNull(), every).otherwise(F.array(F.lit(0)))))
        .drop(HOT)
    )
    return salted.join(copies, [*keys, SALT], how).drop(SALT)
