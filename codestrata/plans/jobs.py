"""The five end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.operators import commands, corpus, findings as fnd, graph, history, ordered, symbols, variables
from codestrata.operators.snapshots import snapshot_diff
from codestrata.session import stored


class Dashboard(NamedTuple):
    table: DataFrame  # cwe_id, repo, fileName, codeWithIssue of non-null findings
    ratio: DataFrame  # hits, total, ratio
    counts: DataFrame  # repo, cwe_id, cwe_id_occur
    pivot: DataFrame  # cwe_id, one column per repo


def dashboard(logged: DataFrame, repos: Sequence[str] | None = None) -> Dashboard:
    """Findings log to table, hit ratio, counts and pivot.

    Give ``repos`` to keep the pivot lazy; otherwise their names are read once.
    """
    rows = fnd.extract_repo(fnd.extract_id(fnd.not_null(logged, "cweID"), "cweID"), "fileName")
    valid = fnd.match_filter(rows, "cweID")
    shown = ["cwe_id", "repo", "fileName", "codeWithIssue"]
    return Dashboard(
        table=rows.select(*shown),
        ratio=fnd.hit_ratio(rows, F.col("cweID").rlike(r"CWE-\d+")),
        counts=fnd.value_counts(valid, ["repo"], "cwe_id", "cwe_id_occur"),
        pivot=fnd.pivot_counts(valid, "cwe_id", "repo", repos),
    )


def compare_libraries(old_dumps: DataFrame, new_dumps: DataFrame, library: Column | None = None) -> DataFrame:
    """Symbol changes of each library between two sets of listings: library, name, change, fields.

    Listings are paired by ``library``, an expression over the column ``library`` (a path); the file
    name by default. Of duplicates in an old listing the last wins.
    """
    named = F.element_at(F.split("library", "/"), -1) if library is None else library
    old, new = (symbols.parse_symbols(d).withColumn("library", named) for d in (old_dumps, new_dumps))
    fields = ["type", "is_global", "address", "size"]
    return snapshot_diff(old, new, ["library", "name"], fields, left_order=["ord"])


class VariableChanges:
    """Two versions of modules compared; each table is planned when it is asked for."""

    KEYS = ("module", "function", "var")

    def __init__(self, old: DataFrame, new: DataFrame) -> None:
        self.old, self.new = old, new  # module, function, var, op

    @cached_property
    def diff(self) -> DataFrame:
        """module, function, var, change, op: operations that one version lacks, however often the other has them."""
        return variables.variable_diff(self.old, self.new, self.KEYS)

    @cached_property
    def counted(self) -> DataFrame:
        """module, function, var, change, op, n: so many uses of an operation more, or fewer."""
        return variables.variable_count_diff(self.old, self.new, self.KEYS)

    @cached_property
    def renames(self) -> DataFrame:
        """module, function, old_name, new_name; its candidates are stored by a job of their own."""
        return variables.rename_candidates(self.old, self.new, within=["module", "function"])


def scoped_lines(lines: DataFrame) -> DataFrame:
    """Lines with their function and block, written once: declarations, operands, calls and
    reports all start from this table."""
    return stored(variables.with_scope(lines), "scoped")


def _operations(lines: DataFrame) -> DataFrame:
    """Every variable with its operations; a variable without uses has one row with null op.

    The module scope is the function ''.
    """
    names, uses = variables.variable_map(scoped_lines(lines))
    owner = F.coalesce("function", F.lit("")).alias("function")
    return names.select("module", owner, "var", F.lit(None).cast("string").alias("op")).unionByName(
        uses.select("module", owner, "var", "op")
    )


def variable_changes(old_lines: DataFrame, new_lines: DataFrame) -> VariableChanges:
    """Changed operations per common variable, and rename candidates, between two versions of modules."""
    return VariableChanges(_operations(old_lines), _operations(new_lines))


def commits_to_analyze(walk: DataFrame, entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits after the first build-file change of the walk, optionally the first ``limit``."""
    steps = history.build_change_steps(walk, entries)
    hit = F.col("hit")
    if limit is None:
        return ordered.skip_until(steps, ["repo"], ["ord"], hit)
    return ordered.limit_after(steps, ["repo"], ["ord"], hit, limit)


def rw_table(scoped: DataFrame, swap: bool = False) -> DataFrame:
    """Reads and writes of every declared or used variable: module, function, var, reads, writes.

    The primary form, one row per variable whatever the size of a module."""
    declared, uses, _ = variables.rw_uses(scoped, swap)
    counted = variables.rw_counts(uses, ["module", "function", "var"])
    named = declared.select("module", "function", "var").distinct()
    counts = named.withColumns({"reads": F.lit(0), "writes": F.lit(0)}).unionByName(counted)
    return counts.groupBy("module", "function", "var").agg(
        F.sum("reads").alias("reads"), F.sum("writes").alias("writes")
    )


def rw_reports(lines: DataFrame, swap: bool = False) -> DataFrame:
    """``rw_table`` as one nested report per module, for modules whose report fits a row."""
    scoped = scoped_lines(lines)
    return variables.variable_report(rw_table(scoped, swap), ["module"], variables.functions_of(scoped))


def call_graph(lines: DataFrame) -> DataFrame:
    scoped = variables.with_scope(lines)
    return graph.call_edges(variables.calls(variables.instructions(scoped)))


def scan_requests(files: DataFrame, mutate: bool = False) -> DataFrame:
    """Source files (optionally as mutants) to request texts."""
    chosen = corpus.scan_sources(files)
    if mutate:
        chosen = corpus.inject_race(chosen).withColumnRenamed("mutated", "text")
    return corpus.requests(chosen)


Analyzer = Callable[..., DataFrame]
ANALYZERS: dict[str, Analyzer] = {
    "rwop": rw_reports,
    "infer": commands.marked_commands,
}


def analyze(name: str, *inputs: DataFrame, **options) -> DataFrame:
    """Run a registered analyzer over all commits at once."""
    if name not in ANALYZERS:
        raise KeyError(f"unknown analyzer {name!r}; known: {sorted(ANALYZERS)}")
    return ANALYZERS[name](*inputs, **options)


def register(name: str, analyzer: Analyzer) -> None:
    ANALYZERS[name] = analyzer


def each_entry(flattened: DataFrame, expression: Callable[[DataFrame], Column], out: str = "value") -> DataFrame:
    """A caller's expression over every flattened tree entry."""
    return flattened.withColumn(out, expression(flattened))
