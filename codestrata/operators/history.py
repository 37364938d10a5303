"""Commit histories and trees as tables.

``commits(repo, oid, parents, ord, tree_oid)``: ``ord`` is the walk position, 0 = newest.
``tree_entries(repo, tree_oid, idx, name, path, oid, kind)``; ``refs(repo, name, oid)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codestrata.functions.text import touches_any
from codestrata.operators import graph
from codestrata.operators.ordered import with_position
from codestrata.operators.skew import salted_join
from codestrata.session import stored


MOST_LEVELS = 1000  # of nested trees


def lookup(table: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested rows, found by key (commit id; tree and name, path or index)."""
    return salted_join(requests, table, keys, "inner")


def missing(table: DataFrame, requests: DataFrame, keys: Sequence[str], message: str = "not found") -> DataFrame:
    """Distinct requested keys without a row, with an error."""
    return (
        requests.select(*keys)
        .distinct()
        .join(table.select(*keys), list(keys), "left_anti")
        .withColumn("error", F.lit(message))
    )


def commit_trees(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """Commit with its root tree; ``trees`` is unique on (repo, tree_oid)."""
    return salted_join(commits, trees, ["repo", "tree_oid"], "inner")


def head_commit(refs: DataFrame, commits: DataFrame, name: str = "HEAD") -> DataFrame:
    """The commit a ref points at, one per repo."""
    return refs.where(F.col("name") == name).select("repo", "oid").join(commits, ["repo", "oid"])


def tips(commits: DataFrame, by: Sequence[str] = ("repo",), order: str = "ord", oid: str = "oid") -> DataFrame:
    """Newest commit per repo, for histories without a refs table."""
    return commits.groupBy(*by).agg(F.min_by(oid, order).alias(oid))


def rev_walk(commits: DataFrame, by: Sequence[str] = ("repo",), order: str = "ord") -> DataFrame:
    """Newest first."""
    return commits.orderBy(*by, order)


def topological_walk(commits: DataFrame, by: str = "repo", oid: str = "oid", parents: str = "parents", newest: Sequence[str] = ()) -> DataFrame:
    """Commits with ``generation`` and ``ord`` (0 = first of the walk), which the walk takes from the parents alone.

    Larger generations come first, so no commit comes before one of its children; among equals those with larger
    values of ``newest`` (times, say), then of the id. Repeated commits and a null id are numbered once.
    """
    known = commits.dropDuplicates([by, oid])
    tall = known.join(graph.generations(known, by, oid, parents), [by, oid])
    newest = [*newest, oid]
    order = [f"_down_{i}" for i in range(len(newest) + 1)]
    # Places are counted from the oldest, which needs no falling order of any type, and turned round by the count.
    placed = with_position(tall.withColumns(dict(zip(order, map(F.col, ["generation", *newest])))), [by], order, "_up").drop(*order)
    sizes = known.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    return salted_join(placed, sizes, [by], "inner").withColumn("ord", F.col("_all") - 1 - F.col("_up")).drop("_all", "_up")


def entry_count(entries: DataFrame, tree: Sequence[str] = ("repo", "tree_oid")) -> DataFrame:
    return entries.groupBy(*tree).agg(F.count(F.lit(1)).alias("entries"))


def tree_diff(
    old: DataFrame, new: DataFrame | None, keys: Sequence[str] = ("path",), oid: str = "oid"
) -> DataFrame:
    """Per path: added, deleted or modified; unchanged paths are left out.

    Both sides are unique on ``keys``. Without ``new`` everything is deleted.
    """
    if new is None:
        new = old.limit(0)
    left = old.select(*keys, F.struct(F.col(oid).alias("oid")).alias("_old"))
    right = new.select(*keys, F.struct(F.col(oid).alias("oid")).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .otherwise("modified")
    )
    return (
        left.join(right, list(keys), "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(
            *keys,
            change.alias("change"),
            F.col("_old")["oid"].alias("old_oid"),
            F.col("_new")["oid"].alias("new_oid"),
        )
    )


def walk_pairs(commits: DataFrame) -> DataFrame:
    """Each commit with the tree of the one visited just before it; equal trees are dropped.

    Both sides of the join are unique on (repo, ord).
    """
    here = commits.select("repo", "ord", F.col("tree_oid").alias("new_tree"))
    before = commits.select(
        "repo", (F.col("ord") + 1).alias("ord"), F.col("tree_oid").alias("old_tree")
    )
    return here.join(before, ["repo", "ord"]).where(F.col("old_tree") != F.col("new_tree"))


def history_diff(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Changed paths of every step of the walk: previously visited tree -> this tree.

    Steps with equal trees are dropped before any entry is read. Both trees of a step fetch
    their entries in one join, and one aggregation by (repo, step, path) puts them side by
    side, so the entries are scanned and shuffled once.
    """
    pairs = walk_pairs(commits)
    wanted = pairs.select(
        "repo",
        "ord",
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("_is_old"), F.col("old_tree").alias("tree_oid")),
                F.struct(F.lit(False).alias("_is_old"), F.col("new_tree").alias("tree_oid")),
            )
        ),
    )
    files = entries.select("repo", "tree_oid", "path", "oid")
    old_oid, new_oid = F.col("old_oid"), F.col("new_oid")
    return (
        salted_join(wanted, files, ["repo", "tree_oid"], "inner")
        .groupBy("repo", "ord", "path")
        .agg(
            F.max(F.when(F.col("_is_old"), F.col("oid"))).alias("old_oid"),
            F.max(F.when(~F.col("_is_old"), F.col("oid"))).alias("new_oid"),
        )
        .where(~old_oid.eqNullSafe(new_oid))
        .select(
            "repo",
            "ord",
            "path",
            F.when(old_oid.isNull(), "added").when(new_oid.isNull(), "deleted").otherwise("modified").alias("change"),
            "old_oid",
            "new_oid",
        )
    )


def nested_history_diff(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """``history_diff`` for nested trees: entries(repo, tree_oid, name, oid, kind), kind 'tree' for a subtree.

    Goes down level by level and only into subtrees whose ids differ, so a step costs what it changed
    and not the size of its trees. Each level is a table in the shared folder. A file that becomes a
    tree is deleted, and the tree's files are added. Damaged trees that hold themselves are an error.
    """
    frontier = walk_pairs(commits).withColumn("_prefix", F.lit(""))
    found, depth = None, 0
    is_tree = F.coalesce(F.col("kind") == "tree", F.lit(False))
    while True:
        sides = F.array(
            F.struct(F.lit(True).alias("_is_old"), F.col("old_tree").alias("tree_oid")),
            F.struct(F.lit(False).alias("_is_old"), F.col("new_tree").alias("tree_oid")),
        )
        wanted = frontier.select("repo", "ord", "_prefix", F.inline(sides)).where(F.col("tree_oid").isNotNull())
        held = salted_join(wanted, entries.select("repo", "tree_oid", "name", "oid", is_tree.alias("_tree")), ["repo", "tree_oid"], "inner")
        side = lambda old: F.max(F.when(F.col("_is_old") == F.lit(old), F.struct("oid", "_tree")))
        level = stored(
            held.groupBy("repo", "ord", "_prefix", "name")
            .agg(side(True).alias("_old"), side(False).alias("_new"))
            .where(~F.col("_old").eqNullSafe(F.col("_new")))
            .select("repo", "ord", F.concat("_prefix", "name").alias("path"), "_old", "_new")
        )
        oid = {s: F.when(~F.col(s)["_tree"], F.col(s)["oid"]) for s in ("_old", "_new")}
        files = level.select("repo", "ord", "path", oid["_old"].alias("old_oid"), oid["_new"].alias("new_oid"))
        change = F.when(F.col("old_oid").isNull(), "added").when(F.col("new_oid").isNull(), "deleted").otherwise("modified")
        files = files.where("old_oid is not null or new_oid is not null").select("repo", "ord", "path", change.alias("change"), "old_oid", "new_oid")
        found = files if found is None else found.union(files)
        tree = {s: F.when(F.col(s)["_tree"], F.col(s)["oid"]) for s in ("_old", "_new")}
        frontier = level.select(
            "repo", "ord", tree["_old"].alias("old_tree"), tree["_new"].alias("new_tree"), F.concat("path", F.lit("/")).alias("_prefix")
        ).where("old_tree is not null or new_tree is not null")
        depth += 1
        if frontier.isEmpty():
            return found
        if depth > MOST_LEVELS:
            raise ValueError(f"trees nest deeper than {MOST_LEVELS} levels: one holds itself")


def touches_build(df: DataFrame, old: str = "old_path", new: str = "new_path", names=None) -> DataFrame:
    """Deltas whose old or new path mentions a build file."""
    paths = [F.col(new), F.col(old)]
    return df.where(touches_any(paths, names) if names else touches_any(paths))


def build_change_steps(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Every commit with ``hit``: did its step change a build file?

    ``hit`` feeds skip_until, skipped_steps and limit_after. Paths are compared one by one, so only
    build files are read from the trees: the filter is below the join.
    """
    hits = (
        history_diff(commits, entries.where(touches_any([F.col("path")])))
        .select("repo", "ord")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    return commits.join(hits, ["repo", "ord"], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def generator_kind(
    entries: DataFrame,
    by: Sequence[str],
    name: str = "name",
    preference: Sequence[tuple[str, str]] = (("CMakeLists.txt", "CMake"), ("meson.build", "Meson")),
    default: str = "Bear",
) -> DataFrame:
    """First preferred build file present per project; one partial aggregate."""
    present = [
        F.coalesce(F.bool_or(F.col(name) == marker), F.lit(False)).alias(f"_p{i}")
        for i, (marker, _) in enumerate(preference)
    ]
    kind = None
    for i, (_, label) in enumerate(preference):
        test = F.col(f"_p{i}")
        kind = F.when(test, label) if kind is None else kind.when(test, label)
    return entries.groupBy(*by).agg(*present).select(*by, kind.otherwise(default).alias("generator"))
