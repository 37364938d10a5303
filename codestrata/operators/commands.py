"""Compile-command tables: validation, flags, library resolution, marked commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codestrata.functions.commands import flag_values, rewrite_command, tokens
from codestrata.functions.text import any_of, mentions_flag
from codestrata.operators.ordered import last_wins
from codestrata.operators.skew import salted_join

# The record's fields and the ranked search roots.
COMMAND_FIELDS = ("command", "directory", "file", "output")
SEARCH_ROOTS = ("/usr/lib", "/usr/local/lib", "/lib")


def check_records(df: DataFrame, record: str = "value", allowed: Sequence[str] = COMMAND_FIELDS) -> DataFrame:
    """Add ``reason``: null for a valid record, else why it is rejected.

    A record is one JSON object holding only allowed keys, all with string values.
    Stateless, so the same function serves a batch and a stream.
    """
    text = F.col(record)
    parsed = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    shape = F.schema_of_variant(parsed)
    wrong = any_of(
        [
            F.coalesce(
                F.array_contains(keys, k)
                & (F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) != "STRING"),
                F.lit(False),
            )
            for k in allowed
        ]
    )
    reason = (
        F.when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)) | keys.isNull(), "NoCommand")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "UnknownField")
        .when(wrong, "WrongFieldValueType")
    )
    return df.withColumn("reason", reason)


def validate_records(
    df: DataFrame, record: str = "value", allowed: Sequence[str] = COMMAND_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """(valid records as columns, rejected records with their reason)."""
    checked = check_records(df, record, allowed)
    schema = ", ".join(f"`{k}` string" for k in allowed)
    rest = [c for c in df.columns if c != record]
    good = (
        checked.where(F.col("reason").isNull())
        .withColumn("_r", F.from_json(record, schema))
        .select(*rest, *[F.col("_r")[k].alias(k) for k in allowed])
    )
    return good, checked.where(F.col("reason").isNotNull())


def token_positions(df: DataFrame, column: str = "command") -> DataFrame:
    """One row per token with its position; empty tokens are kept."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(tokens(F.col(column))).alias("pos", "token"))


def library_flags(df: DataFrame, column: str = "command", flag: str = "-l", out: str = "name") -> DataFrame:
    """One row per library flag, duplicates kept."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(flag_values(F.col(column), flag)).alias("flag_pos", out))


def ranked_paths(names: DataFrame, roots: Sequence[str], name: str, prefix: str, suffix: str) -> DataFrame:
    """Distinct names times the fixed root list, with the path each root would give."""
    ranked = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.lit(r).alias("root")) for i, r in enumerate(roots)]
    )
    return (
        names.select(name)
        .distinct()
        .select(name, F.inline(ranked))
        .withColumn("path", F.concat("root", F.lit("/" + prefix), name, F.lit(suffix)))
    )


def resolve_names_to_paths(
    names: DataFrame,
    inventory: DataFrame,
    roots: Sequence[str] = SEARCH_ROOTS,
    name: str = "name",
    prefix: str = "lib",
    suffix: str = ".so",
) -> DataFrame:
    """Each distinct name that exists under a root, with the path of its first root."""
    wanted = ranked_paths(names, roots, name, prefix, suffix)
    return (
        wanted.join(inventory.select("path").distinct(), "path", "left_semi")
        .groupBy(name)
        .agg(F.min_by("path", "rank").alias("path"))
    )


def resolve_ranked(requests: DataFrame, inventory: DataFrame, roots=SEARCH_ROOTS, name="name", **form) -> DataFrame:
    """Request rows with their path; duplicates kept, unresolved requests dropped.

    Names are resolved once each; a name most commands ask for is salted in the join back.
    """
    resolved = resolve_names_to_paths(requests, inventory, roots, name, **form)
    return salted_join(requests, resolved, [name], "inner")


def unresolved(requests: DataFrame, inventory: DataFrame, roots=SEARCH_ROOTS, name="name", **form) -> DataFrame:
    """Distinct names found under no root, with the message for the report."""
    resolved = resolve_names_to_paths(requests, inventory, roots, name, **form)
    return (
        requests.select(name)
        .distinct()
        .join(resolved, name, "left_anti")
        .withColumn(
            "error", F.format_string("Could not find library %s in search paths", F.col(name))
        )
    )


def linked_libraries(commands: DataFrame, inventory: DataFrame, column: str = "command", **options) -> DataFrame:
    """Every resolved library of every command (duplicates kept)."""
    return resolve_ranked(library_flags(commands, column), inventory, **options)


def library_frequency(linked: DataFrame, name: str = "name") -> DataFrame:
    return linked.groupBy(name).agg(F.count(F.lit(1)).alias("occurrences"))


def paths_of(linked: DataFrame, wanted: str, name: str = "name", path: str = "path") -> DataFrame:
    """All paths of one library, duplicates kept."""
    return linked.where(F.col(name) == wanted).select(path)


def rewrite_commands(commands: DataFrame, column: str = "command") -> DataFrame:
    """Replace the command by its IR-emitting form and add the recorded ``outputs``."""
    return (
        commands.withColumn("_r", rewrite_command(F.col(column)))
        .withColumns({column: F.col("_r")["command"], "outputs": F.col("_r")["outputs"]})
        .drop("_r")
    )


def marked_commands(
    commands: DataFrame,
    includes: DataFrame,
    flag: str = "-pthread",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Files whose command has the flag, or that include a file a flagged command includes.

    ``commands(file, command)``, last row per file wins when ``order`` is given;
    ``includes(file, include)``. Result: file, ``via`` in {'flag', 'include'}. A header that
    most files include is reduced to one flagged row before the salted semi join.
    """
    latest = last_wins(commands, ["file"], order) if order else commands
    flagged = latest.where(mentions_flag(F.col("command"), flag)).select("file").distinct()
    shared = (
        salted_join(includes, flagged, ["file"], "left_semi").select("include").distinct()
    )
    through = salted_join(includes, shared, ["include"], "left_semi").select("file").distinct()
    known = latest.select("file").distinct()
    return (
        flagged.withColumn("_by_flag", F.lit(True))
        .join(through.withColumn("_by_include", F.lit(True)), "file", "full_outer")
        .join(known, "file", "left_semi")
        .select("file", F.when(F.col("_by_flag"), "flag").otherwise("include").alias("via"))
    )
