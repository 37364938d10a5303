"""Symbol tables from listing text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.functions.symbols import (
    SYMBOL_FIELDS,
    SYMBOL_LINE,
    TABLE_TITLE,
    architecture,
    hex_u64,
    is_exported,
    is_imported,
    symbol_type,
)
from codestrata.functions.text import is_dynamic


def libraries(dumps: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """One header row per listing: path, architecture, is_dynamic."""
    return dumps.select(
        F.col(path).alias("library"),
        architecture(F.col(body)).alias("architecture"),
        is_dynamic(F.col(path)).alias("is_dynamic"),
    )


def parse_symbols(dumps: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """One row per well-formed, named symbol line after the first table title.

    Works inside each row, so a listing is parsed where it was read: no shuffle.
    """
    table = F.substring_index(F.col(body), TABLE_TITLE, 1)
    rest = F.when(
        F.col(body).contains(TABLE_TITLE), F.substr(F.col(body), F.length(table) + 1)
    )
    lines = dumps.select(
        F.col(path).alias("library"), F.posexplode(F.split(rest, "\n")).alias("ord", "line")
    ).where(F.col("line").rlike(SYMBOL_LINE))
    split = F.split(F.ltrim("line"), r"\s+", len(SYMBOL_FIELDS))  # the name is the rest of the line
    field = {name: F.get(F.col("_f"), F.lit(i)) for i, name in enumerate(SYMBOL_FIELDS)}
    lines = lines.select("library", "ord", split.alias("_f"))
    return lines.select(
        "library",
        "ord",
        field["name"].alias("name"),
        symbol_type(field["type"], field["ndx"]).alias("type"),
        (field["bind"] == "GLOBAL").alias("is_global"),
        hex_u64(field["value"]).alias("address"),
        field["size"].try_cast("decimal(20,0)").alias("size"),
    ).where(F.col("address").isNotNull() & F.expr("size < 18446744073709551616BD"))


def exported(symbols: DataFrame) -> DataFrame:
    """Global and not undefined (an undefined FUNC counts as exported, a WEAK one does not)."""
    return symbols.where(is_exported(F.col("is_global"), F.col("type")))


def imported(symbols: DataFrame) -> DataFrame:
    """Undefined, global or not."""
    return symbols.where(is_imported(F.col("type")))
