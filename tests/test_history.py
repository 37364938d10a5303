import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import graph as g, history as h, ordered
from codestrata.plans.jobs import commits_to_analyze, each_entry

C = "repo string, oid string, parents array<string>, ord bigint, tree_oid string"
E = "repo string, tree_oid string, idx int, name string, path string, oid string, kind string"


def entries(spark, trees):
    out = []
    for (repo, tree), files in trees.items():
        for i, (path, oid) in enumerate(files.items()):
            out.append((repo, tree, i, path.split("/")[-1], path, oid, "blob"))
    return spark.createDataFrame(out, E)


@pytest.fixture(scope="module")
def repo(spark):
    """Newest first: c0..c5; the build file changes between c2 and c3."""
    trees = {
        ("r", "t0"): {"a.c": "1", "b.c": "1", "CMakeLists.txt": "x"},
        ("r", "t1"): {"a.c": "2", "CMakeLists.txt": "x"},
        ("r", "t3"): {"a.c": "2", "CMakeLists.txt": "y"},
        ("r", "t4"): {"z.c": "1"},
        ("s", "u"): {"only.c": "1"},
    }
    commits = [("r", f"c{i}", [f"c{i + 1}"] if i < 5 else [], i, t) for i, t in enumerate(["t0", "t1", "t1", "t3", "t4", "t4"])]
    commits += [("s", "d0", ["d1"], 0, "u"), ("s", "d1", [], 1, "u")]
    return spark.createDataFrame(commits, C), entries(spark, trees)


def test_tree_diff(spark, repo, rows):
    _, ent = repo
    old, new = (ent.where(F.col("tree_oid") == t) for t in ("t0", "t3"))
    assert rows(h.tree_diff(old, new)) == [
        ("CMakeLists.txt", "modified", "x", "y"), ("a.c", "modified", "1", "2"), ("b.c", "deleted", "1", None),
    ]
    assert rows(h.tree_diff(old, None), "path", "change") == [("CMakeLists.txt", "deleted"), ("a.c", "deleted"), ("b.c", "deleted")]
    assert h.tree_diff(old, old).count() == 0


def test_history_diff_and_start(spark, repo, rows):
    commits, ent = repo
    got = rows(h.history_diff(commits, ent), "repo", "ord", "path", "change")
    assert got == [
        ("r", 1, "a.c", "modified"), ("r", 1, "b.c", "deleted"), ("r", 3, "CMakeLists.txt", "modified"),
        ("r", 4, "CMakeLists.txt", "deleted"), ("r", 4, "a.c", "deleted"), ("r", 4, "z.c", "added"),
    ]
    steps = h.build_change_steps(commits, ent)
    assert rows(ordered.skipped_steps(steps, ["repo"], ["ord"], F.col("hit"))) == [
        ("r", 3, None), ("s", None, "CanNotFindFirstCommit"),
    ]
    assert rows(commits_to_analyze(commits, ent), "repo", "oid") == [("r", "c4"), ("r", "c5")]
    assert rows(commits_to_analyze(commits, ent, 1), "repo", "oid") == [("r", "c4")]


def test_lookups(spark, repo, rows):
    commits, ent = repo
    wanted = spark.createDataFrame([("r", "c1"), ("r", "nope"), ("r", "c1")], "repo string, oid string")
    assert rows(h.lookup(commits, wanted, ["repo", "oid"]), "oid", "ord") == [("c1", 1), ("c1", 1)]
    assert rows(h.missing(commits, wanted, ["repo", "oid"])) == [("r", "nope", "not found")]
    for key, value in [("name", "b.c"), ("path", "b.c"), ("idx", 1)]:
        ask = spark.createDataFrame([("t0", value)], f"tree_oid string, {key} {'int' if key == 'idx' else 'string'}")
        assert rows(h.lookup(ent, ask, ["tree_oid", key]), "path") == [("b.c",)]
    refs = spark.createDataFrame([("r", "HEAD", "c0"), ("r", "tag", "c3")], "repo string, name string, oid string")
    assert rows(h.head_commit(refs, commits), "oid") == [("c0",)]
    assert rows(h.tips(commits)) == [("r", "c0"), ("s", "d0")]
    trees = ent.select("repo", "tree_oid").distinct()
    assert h.commit_trees(commits, trees).count() == commits.count()
    assert rows(h.entry_count(ent), "tree_oid", "entries") == [("t0", 3), ("t1", 2), ("t3", 2), ("t4", 1), ("u", 1)]
    assert [r.ord for r in h.rev_walk(commits.where("repo = 'r'")).collect()] == list(range(6))


def test_generator_kind(spark, rows):
    df = spark.createDataFrame(
        [("a", "meson.build"), ("a", "CMakeLists.txt"), ("b", "meson.build"), ("c", "Makefile"), ("d", None)], "repo string, name string"
    )
    assert rows(h.generator_kind(df, ["repo"])) == [("a", "CMake"), ("b", "Meson"), ("c", "Bear"), ("d", "Bear")]


def test_ancestors_of_a_long_history_with_merges(spark):
    rnd = random.Random(5)
    n = 120
    parents = {i: ([i + 1] if i + 1 < n else []) for i in range(n)}
    for i in range(0, n, 23):  # side branches, some merged back
        side = [f"s{i}_{k}" for k in range(4)]
        for a, b in zip(side, side[1:]):
            parents[a] = [b]
        parents[side[-1]] = [min(n - 1, i + rnd.randrange(5, 20))]
        if rnd.random() < 0.7:
            parents[i] = parents[i] + [side[0]]
    parents["other"] = ["unrelated"]
    parents["unrelated"] = []
    data = [("r", str(k), [str(p) for p in v], 0, "t") for k, v in parents.items()]
    commits = spark.createDataFrame(data, C).repartition(4)

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += [str(p) for p in parents.get(int(c) if c.isdigit() else c, [])]
        return seen

    heads = spark.createDataFrame([("r", "0")], "repo string, oid string")
    got = [r.oid for r in g.ancestors(commits, heads).collect()]
    assert sorted(got) == sorted(reach("0")) and "other" not in got


def test_flatten_trees(spark, rows):
    nodes = spark.createDataFrame(
        [("T1", "src", "S", "tree"), ("T1", "README", "b0", "blob"), ("T2", "src", "S", "tree"), ("S", "a.c", "b1", "blob"),
         ("S", "deep", "D", "tree"), ("D", "x.c", "b2", "blob")],
        "tree_oid string, name string, oid string, kind string",
    ).withColumn("repo", F.lit("r"))
    roots = spark.createDataFrame([("r", "T1"), ("r", "T2")], "repo string, tree_oid string")
    flat = g.flatten_trees(roots, nodes)
    assert rows(flat, "root", "path", "oid") == [
        ("T1", "README", "b0"), ("T1", "src/a.c", "b1"), ("T1", "src/deep/x.c", "b2"), ("T2", "src/a.c", "b1"), ("T2", "src/deep/x.c", "b2"),
    ]
    assert rows(each_entry(flat, lambda df: F.length(df["path"])), "path", "value")[0] == ("README", 6)


def test_trees_without_kind_or_inside_themselves(spark, rows):
    nodes = spark.createDataFrame(
        [("T", "odd", "b", None), ("T", "sub", "S", "tree"), ("S", "up", "T", "tree"), ("S", "x", "c", "blob")], "tree_oid string, name string, oid string, kind string"
    )
    roots = spark.createDataFrame([("T",)], "tree_oid string")
    assert rows(g.flatten_trees(roots, nodes, []), "path", "oid") == [("odd", "b"), ("sub/x", "c")]


def test_call_paths_with_cycle(spark, rows):
    edges = spark.createDataFrame(
        [("m", a, b, 1) for a, b in [("main", "f"), ("main", "g"), ("f", "h"), ("g", "h"), ("h", "main"), ("h", "h"), ("x", "y")]],
        "module string, caller string, callee string, calls int",
    )
    roots = spark.createDataFrame([("m", "main")], "module string, function string")
    assert rows(g.call_paths(edges, roots), "function", "path") == [
        ("f", ["main", "f"]), ("g", ["main", "g"]), ("h", ["main", "f", "h"]), ("main", ["main"]),
    ]
    assert g.call_paths(edges, roots, max_depth=1).count() == 3
    assert ("h", 2, 3) in rows(g.call_degree(edges), "function", "callees", "callers")


def test_call_paths_are_put_together_over_many_levels(spark, rows):
    chain = [(i, i + 1) for i in range(9)] + [(9, 0), (4, 20), (3, 20), (20, 21), (30, 21), (None, 22), (23, None)]
    edges = spark.createDataFrame(chain, "caller int, callee int")
    roots = spark.createDataFrame([(0,), (0,), (30,)], "function int")
    want = [(i, list(range(i + 1))) for i in range(10)] + [(20, [0, 1, 2, 3, 20]), (21, [30, 21]), (30, [30])]
    assert sorted(rows(g.call_paths(edges, roots, []), "function", "path")) == want
    assert g.call_paths(edges, roots.limit(0), []).count() == 0


def test_nested_diff_goes_only_where_ids_differ(spark, rows):
    commits = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 2, "B"), ("r", 3, "C")], "repo string, ord int, tree_oid string")
    same = [("S", "x", "1", "blob"), ("S", "deep", "D", "tree"), ("D", "y", "2", None)]
    nodes = [
        ("A", "src", "S", "tree"), ("A", "lib", "L1", "tree"), ("A", "top", "t1", "blob"), ("L1", "a", "a1", "blob"), ("L1", "b", "b1", "blob"),
        ("B", "src", "S", "tree"), ("B", "lib", "L2", "tree"), ("B", "top", "t1", "blob"), ("L2", "a", "a2", "blob"), ("L2", "b", "b1", "blob"), ("L2", "c", "c1", "blob"),
        ("C", "src", "S", "tree"), ("C", "lib", "now-a-file", "blob"), *same,
    ]
    entries = spark.createDataFrame(nodes, "tree_oid string, name string, oid string, kind string").withColumn("repo", F.lit("r"))
    got = h.nested_history_diff(commits, entries)
    assert rows(got, "ord", "path", "change", "old_oid", "new_oid") == [
        (1, "lib/a", "modified", "a1", "a2"), (1, "lib/c", "added", None, "c1"),
        (3, "lib", "added", None, "now-a-file"), (3, "lib/a", "deleted", "a2", None), (3, "lib/b", "deleted", "b1", None), (3, "lib/c", "deleted", "c1", None),
        (3, "top", "deleted", "t1", None),
    ]
    flat = g.flatten_trees(commits.select("repo", "tree_oid").distinct(), entries).select("repo", F.col("root").alias("tree_oid"), "path", "oid")
    assert rows(h.history_diff(commits, flat)) == rows(got)


def _history(rng, n):
    """Commits with up to three parents among older ones, some of them unknown."""
    return {k: [p if rng.random() < 0.95 else 10**6 + p for p in rng.sample(range(k), min(k, rng.choice([1, 1, 1, 2, 3])))] for k in range(n)}


def test_a_walk_from_parents_alone_has_children_first(spark, hotness):
    rng = random.Random(4)
    repos = {r: _history(rng, 60) for r in ("a", "b")} | {"line": {k: [k - 1] if k else [] for k in range(150)}}
    data = [(r, k, ps) for r, commits in repos.items() for k, ps in commits.items()]
    rng.shuffle(data)
    walk = h.topological_walk(spark.createDataFrame(data + data[:5], "repo string, oid int, parents array<int>")).collect()
    assert len(walk) == len(data)
    place = {(w.repo, w.oid): w.ord for w in walk}
    tall = {(w.repo, w.oid): w.generation for w in walk}
    for r, commits in repos.items():
        assert sorted(place[r, k] for k in commits) == list(range(len(commits)))
        for k, ps in commits.items():
            mine = [p for p in ps if p in commits]
            assert tall[r, k] == max((tall[r, p] + 1 for p in mine), default=0)
            assert all(place[r, k] < place[r, p] for p in mine)


def test_a_cycle_is_an_error(spark):
    damaged = spark.createDataFrame([("r", 1, [2]), ("r", 2, [1]), ("r", 3, [])], "repo string, oid int, parents array<int>")
    with pytest.raises(ValueError, match="cycle"):
        g.generations(damaged)
    assert g.generations(damaged.limit(0)).collect() == []
