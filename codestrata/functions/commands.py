"""Compile-command scalars: one row in, one value out, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from codestrata.functions.text import flatten_path

# The optimisation flags that are replaced, and where outputs are recorded.
LEVEL_FLAGS = ("-O1", "-O2", "-O3", "-Og", "-o1", "-o2", "-o3", "-og")
DEBUG_FLAG = "-g"
EMIT_FLAG = "-emit-llvm"
OUTPUT_DIR = "build"


def tokens(command: Column) -> Column:
    """Split on single spaces; a double space gives an empty token."""
    return F.split(command, " ", -1)


def flag_values(command: Column, flag: str = "-l") -> Column:
    """Values of a flag in order: ``flag X`` and ``flagX`` both give X, a last bare flag nothing.

    A match starts at a token and takes the value with it, so a token used as a value is
    never read again as a flag.
    """
    name = re.escape(flag)
    used = F.regexp_extract_all(command, F.lit(f"(?:^| ){name}(?: [^ ]*|[^ ]+)"), 0)
    return F.transform(used, lambda m: F.regexp_replace(m, f"^ ?{name} ?", ""))


def rewrite_command(command: Column) -> Column:
    """Turn a compile command into one that emits IR; struct(command, outputs).

    Empty tokens go; a level flag becomes the debug flag; ``-o X`` becomes
    ``-o flat(X) -emit-llvm -g`` and records ``build/flat(X)``; ``-g`` is appended when no
    level flag was seen; ``-o`` as the last token is dropped.
    """
    no_text = F.array().cast("array<string>")
    start = F.struct(
        F.lit(False).alias("expect"),
        F.lit(False).alias("levelled"),
        no_text.alias("kept"),
        no_text.alias("outputs"),
    )

    def step(state: Column, token: Column) -> Column:
        is_out = ~state["expect"] & (token == "-o")
        is_level = ~state["expect"] & token.isin(*LEVEL_FLAGS)
        added = (
            F.when(
                state["expect"],
                F.array(F.lit("-o"), flatten_path(token), F.lit(EMIT_FLAG), F.lit(DEBUG_FLAG)),
            )
            .when(is_out | (token == ""), no_text)
            .when(is_level, F.array(F.lit(DEBUG_FLAG)))
            .otherwise(F.array(token))
        )
        recorded = F.when(
            state["expect"], F.array(F.concat(F.lit(OUTPUT_DIR + "/"), flatten_path(token)))
        ).otherwise(no_text)
        return F.struct(
            is_out.alias("expect"),
            (state["levelled"] | is_level).alias("levelled"),
            F.concat(state["kept"], added).alias("kept"),
            F.concat(state["outputs"], recorded).alias("outputs"),
        )

    def finish(state: Column) -> Column:
        tail = F.when(state["levelled"], no_text).otherwise(F.array(F.lit(DEBUG_FLAG)))
        return F.struct(
            F.array_join(F.concat(state["kept"], tail), " ").alias("command"),
            state["outputs"].alias("outputs"),
        )

    return F.aggregate(tokens(command), start, step, finish)
