"""Symbol-table scalars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The listing's field order and its type names.
SYMBOL_LINE = r"^\s*\d+:\s+[0-9a-fA-F]{1,16}\s+\d+(?:\s+\S+){4}[ \t]+\S"
SYMBOL_FIELDS = ("num", "value", "size", "type", "bind", "vis", "ndx", "name")
SYMBOL_TYPES = {"FUNC": "Function", "OBJECT": "Variable", "COMMON": "Common"}
TABLE_TITLE = "Symbol table"
MACHINE_LABEL = "Machine:"


def hex_u64(text: Column) -> Column:
    """Unsigned 64-bit hex to DECIMAL(20,0), null when it is not hex."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, 10).cast("decimal(20,0)"))


def symbol_type(type_name: Column, ndx: Column) -> Column:
    """FUNC, OBJECT and COMMON by name; NOTYPE only when undefined; everything else Other."""
    kind = None
    for name, label in SYMBOL_TYPES.items():
        kind = F.when(type_name == name, label) if kind is None else kind.when(type_name == name, label)
    return kind.when((type_name == "NOTYPE") & (ndx == "UND"), "Undefined").otherwise("Other")


def is_exported(is_global: Column, kind: Column) -> Column:
    return is_global & (kind != "Undefined")


def is_imported(kind: Column) -> Column:
    return kind == "Undefined"


def architecture(body: Column) -> Column:
    """Text after the first ':' of the first line with 'Machine:', trimmed; else 'unknown'."""
    line = F.regexp_extract(body, f"(?md)^.*{MACHINE_LABEL}.*$", 0)
    return F.when(
        body.contains(MACHINE_LABEL), F.btrim(F.regexp_extract(line, ":(.*)$", 1), F.lit(" \t"))
    ).otherwise("unknown")
