"""Reachability, tree flattening and call paths.

Rounds are Spark jobs over the whole frontier; each round's result is written as a table in
the shared folder, so plans stay short, a lost executor does not replay earlier rounds, and
the planner knows the true size of a frontier when it picks the next join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codestrata.operators.skew import hot_keys, salted_join
from codestrata.session import stored


def ancestors(commits: DataFrame, heads: DataFrame, by: str = "repo", oid: str = "oid", parents: str = "parents") -> DataFrame:
    """All commits reachable from the heads, heads included: ``(by, oid)``.

    First-parent chains are followed by doubling (jump tables of 1, 2, 4, ... steps, one row
    per commit each), so a linear history of n commits takes about log2(n) joins instead of
    n. Other parents start a further round; the number of rounds is how deeply merges nest.
    """
    first = commits.select(
        by, F.col(oid), F.try_element_at(parents, F.lit(1)).alias("target")
    ).where(F.col("target").isNotNull())
    others = commits.select(by, F.col(oid), F.explode(F.slice(parents, 2, 2**30)).alias("target"))
    others = stored(others)

    jumps = []
    jump = stored(first.distinct())
    longest = jump.count()  # no chain has more steps, even if damaged data holds a cycle
    while 2 ** len(jumps) <= longest and not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select(by, F.col(oid).alias("target"), F.col("target").alias("_far"))
        jump = stored(
            jump.join(onward, [by, "target"]).select(by, oid, F.col("_far").alias("target"))
        )

    reached = None
    frontier = stored(heads.select(by, oid).distinct())
    while not frontier.isEmpty():
        closed = frontier
        for table in jumps:
            further = closed.join(table, [by, oid]).select(by, F.col("target").alias(oid))
            closed = stored(closed.union(further).distinct())
        new = closed if reached is None else closed.join(reached, [by, oid], "left_anti")
        new = stored(new)
        reached = new if reached is None else reached.union(new)  # a union of stored rounds
        sideways = new.join(others, [by, oid]).select(by, F.col("target").alias(oid)).distinct()
        frontier = stored(sideways.join(reached, [by, oid], "left_anti"))
    known = commits.select(by, oid).distinct()
    return reached.join(known, [by, oid], "left_semi") if reached is not None else heads.select(by, oid).limit(0)


def generations(commits: DataFrame, by: str = "repo", oid: str = "oid", parents: str = "parents") -> DataFrame:
    """``(by, oid, generation)``: the length of the longest way from a commit down to one without known parents.

    Policy iteration: each commit holds on to one parent, the first to begin with; its steps down that way are
    counted by doubling pointers (about log2 of the depth joins, whatever the history's shape). Then
    a commit whose parent lies lower than another one of its own changes over, and the ways are
    measured again, until none does: then every generation is one more than the largest of its parents.
    Ways only grow longer, and in few turns, since a change raises all commits above at once. A history with
    a cycle (damaged data) raises an error. Parents that are not in the table do not count; repeated commits
    count once.
    """
    known = stored(commits.select(by, oid, parents).dropDuplicates([by, oid]), "commits")
    edges = known.select(by, oid, F.posexplode(parents).alias("_place", "target"))
    edges = stored(salted_join(edges, known.select(by, F.col(oid).alias("target")), [by, "target"], "left_semi"), "edges")
    rounds = known.count().bit_length() + 1
    first = edges.groupBy(by, oid).agg(F.min_by("target", "_place").alias("_next"))
    held = stored(known.select(by, oid).join(first, [by, oid], "left"), "held")
    while True:
        steps = _steps_down(held, by, oid, rounds)
        heights = steps.select(by, F.col(oid).alias("target"), F.col("_steps").alias("_height"))
        ways = salted_join(edges, heights, [by, "target"], "inner")
        best = ways.groupBy(by, oid).agg(F.max(F.struct("_height", -F.col("_place"), "target")).alias("_best"))
        turned = steps.join(best, [by, oid], "left").select(
            by, oid, "_steps", F.when(F.col("_best._height") >= F.col("_steps"), F.col("_best.target")).alias("_other"), "_next"
        )
        turned = stored(turned, "turned")
        if turned.where(F.col("_other").isNotNull()).isEmpty():
            return turned.select(by, oid, F.col("_steps").alias("generation"))
        held = turned.select(by, oid, F.coalesce("_other", "_next").alias("_next"))


def _steps_down(held: DataFrame, by: str, oid: str, rounds: int) -> DataFrame:
    """``held`` (by, oid, _next) with the number of steps along _next to its end."""
    state = stored(held.select(by, oid, "_next", F.col("_next").alias("_far"), F.col("_next").isNotNull().cast("long").alias("_steps")), "steps")
    for _ in range(rounds):
        going = state.where(F.col("_far").isNotNull())
        if going.isEmpty():
            return state.select(by, oid, "_next", "_steps")
        ahead = state.select(by, F.col(oid).alias("_far"), F.col("_far").alias("_beyond"), F.col("_steps").alias("_more"))
        moved = salted_join(going, ahead, [by, "_far"], "inner")
        moved = moved.select(by, oid, "_next", F.col("_beyond").alias("_far"), (F.col("_steps") + F.col("_more")).alias("_steps"))
        state = stored(moved.unionByName(state.where(F.col("_far").isNull())), "steps")
    raise ValueError("the history holds a cycle")


def flatten_trees(roots: DataFrame, entries: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Full path of every blob below each root tree.

    ``roots(keys, tree_oid)``; ``entries(keys, tree_oid, name, oid, kind)`` with kind 'tree'
    for a subtree; anything else, also null, is a file. One round per directory level; a subtree
    shared by very many roots is salted. A tree inside itself (damaged data) is not entered
    again. Result: keys, root, path, oid.
    """
    keys = list(keys)
    nodes = entries.select(*keys, "tree_oid", "name", "oid", "kind")
    frontier = roots.select(
        *keys, F.col("tree_oid").alias("root"), "tree_oid", F.lit("").alias("_prefix")
    ).distinct().withColumn("_above", F.array("tree_oid"))
    found = None
    while True:
        level = stored(
            salted_join(frontier, nodes, [*keys, "tree_oid"], "inner").select(
                *keys, "root", F.coalesce(F.col("kind") == "tree", F.lit(False)).alias("_down"), "oid", F.concat("_prefix", "name").alias("path"), "_above"
            )
        )
        files = level.where(~F.col("_down")).select(*keys, "root", "path", "oid")
        found = files if found is None else found.union(files)
        frontier = level.where(F.col("_down") & ~F.array_contains("_above", F.col("oid"))).select(
            *keys, "root", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("_prefix"), F.array_append("_above", F.col("oid")).alias("_above")
        )
        if frontier.isEmpty():
            return found


def call_edges(calls: DataFrame, by: Sequence[str] = ("module",)) -> DataFrame:
    """(caller, callee) with the number of calls."""
    return calls.groupBy(*by, "caller", "callee").agg(F.count(F.lit(1)).alias("calls"))


def call_degree(edges: DataFrame, by: Sequence[str] = ("module",)) -> DataFrame:
    """Distinct callees and callers per function."""
    pairs = edges.select(*by, "caller", "callee").distinct()
    out = pairs.select(*by, F.col("caller").alias("function"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = pairs.select(*by, F.col("callee").alias("function"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return (
        out.union(into)
        .groupBy(*by, "function")
        .agg(F.sum("o").alias("callees"), F.sum("i").alias("callers"))
    )


def call_paths(edges: DataFrame, roots: DataFrame, by: Sequence[str] = ("module",), max_depth: int | None = None) -> DataFrame:
    """A shortest call path from a root to each reachable function: ``(by, function, path)``.

    Breadth first: a function is entered once, from the smallest of its callers that are one step
    nearer to a root, so cycles end by themselves and the result has one row per function. Rounds carry a
    function and its parent only; the paths are put together at the end by doubling, in about log2 of the
    depth joins. ``roots(by, function)``.
    """
    by = list(by)
    hops = stored(edges.select(*by, F.col("caller").alias("function"), "callee").distinct())
    entered = hops.schema["function"].dataType
    frontier = stored(
        roots.select(*by, F.col("function").cast(entered).alias("function"), F.lit(None).cast(entered).alias("parent")).dropDuplicates([*by, "function"])
    )
    hot = hot_keys(hops, [*by, "function"])
    reached, depth = frontier, 0  # depth: of the deepest function reached
    while max_depth is None or depth < max_depth:
        step = (
            salted_join(hops, frontier.select(*by, "function"), [*by, "function"], "inner", hot)
            .groupBy(*by, F.col("callee").alias("function"))
            .agg(F.min("function").alias("parent"))
        )
        frontier = stored(step.join(reached.select(*by, "function"), [*by, "function"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)  # a union of stored rounds
        depth += 1
    return _paths_up(reached, by, depth)


def _paths_up(tree: DataFrame, by: list[str], depth: int) -> DataFrame:
    """``tree`` (by, function, parent; no cycles, at most ``depth`` steps from a root) as (by, function, path)."""
    state = tree.select(*by, "function", F.array("function").alias("path"), F.col("parent").alias("_above"))
    for turn in range(depth.bit_length()):  # a path holds up to 2 ** turn functions
        whole, rest = state.where(F.col("_above").isNull()), state.where(F.col("_above").isNotNull())
        ahead = state.select(*by, F.col("function").alias("_above"), F.col("path").alias("_front"), F.col("_above").alias("_beyond"))
        grown = salted_join(rest, ahead, [*by, "_above"], "inner").select(
            *by, "function", F.concat("_front", "path").alias("path"), F.col("_beyond").alias("_above")
        )
        state = grown.unionByName(whole)
        if turn + 1 < depth.bit_length():
            state = stored(state, "paths")
    return state.select(*by, "function", "path")
