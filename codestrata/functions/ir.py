"""IR listing lines as Column expressions (text patterns only, no compiler)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions.text import extract

# The textual forms of the listing.
NAME = r'(?:"[^"]+"|[-a-zA-Z$._0-9]+)'
RESULT_PREFIX = rf"^\s*%{NAME} = "
DEFINE_LINE = rf"^\s*(?:define|declare)\b[^@]*@({NAME})\("
FUNCTION_START = rf"^\s*define\b[^@]*@({NAME})\("
FUNCTION_END = r"^\s*\}"
GLOBAL_LINE = rf"^\s*@({NAME}) = (?:[^,\"]*\s)?(global|constant)\s"
BLOCK_LABEL = rf"^({NAME}):"
PARAMETER = rf"%({NAME})\s*(?:,|\)|$)"
# a name followed by " =" is the line's result, not an operand
OPERAND = r'[%@]((?:"[^"]++"|[-a-zA-Z$._0-9]++)(?! =))'
DEBUG_RECORD = rf"#dbg_value\([^%@,]*[%@]({NAME}), (![0-9]+)"
DEBUG_CALL = rf"@llvm\.dbg\.value\(metadata [^%@,]*[%@]({NAME}), metadata (![0-9]+)"
LOCAL_METADATA = r'^(![0-9]+) = (?:distinct )?!DILocalVariable\(.*?name: "([^"]*)"'
OPCODE_CLASSES = {"call": "Call", "load": "Load", "store": "Store", "alloca": "Alloca"}
MNEMONIC = rf"^\s*(?:%{NAME} = )?(?:(?:tail|musttail|notail) )?([a-z][a-z_.]*)\b"


def unquoted(name: Column) -> Column:
    return F.btrim(name, F.lit('"'))


def is_named(name: Column) -> Column:
    """A numbered value has no name of its own."""
    return (name != "") & ~name.rlike("^[0-9]+$")


def valid_variable(name: Column, is_constant: Column | None = None) -> Column:
    """Named, not starting with '.', and not a constant."""
    valid = F.coalesce(is_named(name) & ~name.startswith("."), F.lit(False))
    return valid if is_constant is None else valid & ~is_constant


def instruction_text(line: Column) -> Column:
    """The line without its result, attached metadata and trailing comment."""
    body = F.regexp_replace(line, RESULT_PREFIX, "")
    body = F.regexp_replace(body, r"(?:, ![-a-zA-Z$._0-9]+ ![0-9]+)+\s*$", "")
    return F.btrim(body)


def mnemonic(line: Column) -> Column:
    """The opcode word; a call's tail marker is skipped."""
    return extract(line, MNEMONIC)


def opcode_class(line: Column) -> Column:
    """Call, Load, Store, Alloca or other."""
    classes = F.create_map(*[F.lit(part) for pair in OPCODE_CLASSES.items() for part in pair])
    return F.coalesce(F.try_element_at(classes, F.regexp_extract(line, MNEMONIC, 1)), F.lit("other"))


def operand_values(line: Column) -> Column:
    """The values an instruction reads, with their sigil, in text order."""
    return F.regexp_extract_all(line, F.lit(OPERAND), 0)


def is_function_start(line: Column) -> Column:
    return F.ltrim(line).startswith("define")


def op_fingerprint(line: Column) -> Column:
    """Equal for two lines with the same opcode, types and flags, whatever their operands.

    Value names and literal constants are blanked; array lengths and alignments stay,
    because they belong to the type and the operation.
    """
    body = instruction_text(line)
    body = F.regexp_replace(body, rf"[%@]{NAME}|![0-9]+|#[0-9]+", "_")
    body = F.regexp_replace(
        body, r"(?<!align )(?<!\[)(?<![\w.@-])-?[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?\b(?! x )", "_"
    )
    body = F.regexp_replace(body, r"\b(?:null|true|false|undef|poison|zeroinitializer)\b", "_")
    return F.sha2(body, 256)
