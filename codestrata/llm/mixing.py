"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.llm.storage import stored

EPOCHS = 3  # no source is repeated more often
SLICES = 16**3  # of the shuffled order of a source, and of the queue
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_weights(sources: DataFrame) -> DataFrame:
    """5, 2, 1, repeating over the sources by code point, null last."""
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1) % 3
    return sources.withColumn("weight", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), place + 1))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds target to (source, source_size, weight): the whole size shared by weight, no source above
    `epochs` times its size, the excess reshared among the others.

    Sources are capped in order of their allowance per weight. With the k tightest capped, the rest
    share what those leave; the cap ends where the next source's share fits. One row per source.
    """
    every = Window.partitionBy()
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("rank", F.row_number().over(tight))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("fair", F.col("left") / F.col("heavy"))
        .withColumn("full", F.col("fair") * F.col("weight") > F.col("cap"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("rank", "fair"))).over(every)["fair"]
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return ranked.withColumn("level", level).select("source", "source_size", "weight", share.alias("target"))


def _slice(place: Column) -> Column:
    """The first bits of a place (32 hex digits): as many slices as SLICES, in the order of the places."""
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    place = F.md5(F.concat(F.lit(SEED + " "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.withColumns(
        {"_id": F.col(id_col), "_source": F.col(source_col), "_size": words(F.col(text_col)), "_place": place, "_slice": _slice(place)}
    )


def _timed(sized: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds _source_size, _target and _done: what a source has given of its first epoch after this row,
    in shuffled order; epoch e ends it at _done + e * _source_size.

    The shuffled order is md5(seed, doc_id), equal digests by doc_id and size. Running sums go slice
    by slice: the slices of a source are added up first (`heads`), then each slice numbers its own
    rows, so a source with a third of all rows is spread over SLICES tasks.
    """
    own = Window.partitionBy("_source", "_slice").orderBy("_place", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sized.withColumn("_run", F.sum("_size").over(own))
        .join(heads, F.col("_source").eqNullSafe(F.col("head_source")) & (F.col("_slice") == F.col("head_slice")))
        .withColumn("_done", F.col("start") + F.col("_run"))
        .drop("_run", "start", "head_source", "head_slice", "_slice")
    )


def _heads(sized: DataFrame, weights: DataFrame | None) -> DataFrame:
    """For each slice of each source, what the source gives before it; source size and target."""
    slices = sized.groupBy(F.col("_source").alias("source"), F.col("_slice").alias("slice")).agg(F.sum("_size").alias("given"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sources = slices.groupBy("source").agg(F.sum("given").alias("source_size"))
    if weights is None:
        weighed = default_weights(sources)
    else:
        named = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        weighed = sources.join(named, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    aims = targets(weighed).select(F.col("source").alias("aim_source"), "source_size", "target")
    return (
        slices.withColumn("start", F.coalesce(F.sum("given").over(ahead), F.lit(0)))
        .join(aims, F.col("source").eqNullSafe(F.col("aim_source")))
        .select(
            F.col("source").alias("head_source"), F.col("slice").alias("head_slice"), "start",
            F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        )
    )


def _finish(epoch: Column) -> Column:
    return (F.col("_done") + epoch * F.col("_source_size")) / F.col("_target")


def _cut(timed: DataFrame) -> DataFrame:
    """One row: the virtual time of the first copy that the budget, the size of all documents, leaves out.

    The queue is divided into slices of virtual time. Slices are added up, and only the slice in which
    the budget runs out is put in order; it holds about one part in SLICES of the rows.
    """
    copies = timed.where("_size > 0 and _target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    copies = copies.withColumn("finish", _finish(F.col("epoch")))
    sliced = copies.withColumn("slice", F.least(F.floor(F.col("finish") * SLICES), F.lit(2 * SLICES)))
    sums = sliced.groupBy("slice").agg(F.sum("_size").alias("given"))
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    budget = timed.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("budget"))
    crossing = (
        sums.withColumn("before", F.coalesce(F.sum("given").over(ahead), F.lit(0)))
        .join(F.broadcast(budget))
        .where("before <= budget")
        .agg(F.max_by(F.struct("slice", "before", "budget"), "slice").alias("at"))
        .select("at.*")
    )
    order = ["finish", F.col("_source").isNull(), F.col("_source").cast("binary"), "_place", "_id", "_size"]
    run = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.join(F.broadcast(crossing), "slice").withColumn("total", F.col("before") + F.sum("_size").over(run))
    first_out = F.min(F.when(F.col("total") > F.col("budget"), F.col("finish")))
    return inside.agg(F.coalesce(first_out, F.lit(float("inf"))).alias("_cut"))


def _epochs() -> Column:
    """How many copies of a row finish before the cut."""
    each = [F.when(_finish(F.lit(e)) < F.col("_cut"), 1).otherwise(0) for e in range(EPOCHS)]
    return F.when((F.col("_size") > 0) & (F.col("_target") > 0), sum(each[1:], each[0])).otherwise(0)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """How often each document is taken: doc_id, size, source, source_size, target, taken, epochs.

    Every source queues its documents in shuffled order, again for each of up to EPOCHS epochs; a
    copy's virtual finish time is the source's words up to its end divided by the source's target.
    The queue is sorted by that time over all sources and ends before the copy that would exceed
    the size of all documents. (The range-sort is done by summing slices of virtual time; only the
    slice where the budget ends is put in order.) Copies that finish at the same time as the first
    one left out are left out too.

    A null text has size 0; a text without words is never taken (taken 0). A null source is a source,
    last in order. Rows that repeat a doc_id are documents of their own, next to each other in the
    shuffle. Reruns agree: the order depends on doc_id and sizes alone. An empty table gives no rows.
    `weights` (source, weight) replaces the default; a source that it lacks gets no row.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(source_col).alias("_source"))
    sized = stored(_sized(picked, "_id", "text", "_source").drop("text"), "mix-sizes")
    timed = stored(_timed(sized, _heads(sized, weights)), "mix-times")
    return timed.join(F.broadcast(_cut(timed))).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source").alias("source"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * _epochs()).alias("taken"), _epochs().alias("epochs"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """The mixed corpus: the rows of `docs` with their columns, as often as `mix_plan` takes them, in
    the order of the queue (range-sorted by virtual finish time)."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    given = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    sized = _sized(given, names[id_col], names[text_col], names[source_col])
    narrow = stored(sized.select("_id", "_source", "_size", "_place", "_slice"), "mix-sizes")
    heads = _heads(narrow, weights)
    cut = stored(_cut(_timed(narrow, heads)), "mix-cut")
    taken = _timed(sized, heads).join(F.broadcast(cut)).withColumn("_times", _epochs()).where("_times > 0")
    copies = taken.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).withColumn("_finish", _finish(F.col("_epoch")))
    return copies.repartitionByRange("_finish", "_place").sortWithinPartitions("_finish", "_place").select(
        [F.col(n).alias(c) for c, n in names.items()]
    )
