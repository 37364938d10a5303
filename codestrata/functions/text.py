"""Text extraction and cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# They name the formats found in the logs and build files.
CWE_PATTERN = r"(CWE-\d+)"
CWE_NUMBER_PATTERN = r"CWE-(\d+)"
REPO_MARKER = "micros"
CODE_TAG = "codesContainsIssue"
ID_TAG = "CWE-ID"
CODE_FENCE = "```cpp"
BUILD_FILES = ("meson.build", "CMakeLists.txt")
CPP_SUFFIXES = (".cc", ".cpp", ".cu", ".hpp")
C_SUFFIXES = (".c",)
SCANNED_SUFFIXES = (".cc", ".C", ".c++", ".cpp", ".cu", ".c")
EXCLUDED_NAME_PATTERN = "[tT]est"
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INCLUDE_PATTERN = r'#[ \t]*include\s*[<"]([^>"]+)[>"]'


def any_of(tests: list[Column]) -> Column:
    """OR of several boolean columns."""
    combined = tests[0]
    for test in tests[1:]:
        combined = combined | test
    return combined


def extract(source: Column, pattern: str, group: int = 1) -> Column:
    """The matched group, null without a match (``regexp_extract`` alone would give '')."""
    return F.nullif(F.regexp_extract(source, pattern, group), F.lit(""))


def extract_segment(source: Column, marker: str = REPO_MARKER) -> Column:
    """The path component that follows ``marker/``; needs a closing slash, else null."""
    return extract(source, f"{marker}/([^/]+)/")


def extract_number(source: Column, pattern: str = CWE_NUMBER_PATTERN) -> Column:
    """The matched digits as BIGINT, null without a match."""
    return F.regexp_extract(source, pattern, 1).try_cast("bigint")


def tagged_block(source: Column, tag: str, keep_tag: bool = False) -> Column:
    """Text between ``<tag>`` and the next ``</tag>``, '' when either is missing."""
    group = 0 if keep_tag else 1
    found = F.regexp_extract(source, f"(?s)<{tag}>(.*?)</{tag}>", group)
    if keep_tag:  # the opening tag stays, the closing one never does
        return F.regexp_replace(found, f"</{tag}>$", "")
    return found


def strip_leading(source: Column, prefix: str) -> Column:
    """Remove every repetition of a literal prefix."""
    return F.regexp_replace(source, f"^(?:{prefix})+", "")


def clean_code(source: Column, tag: str = CODE_TAG, fence: str = CODE_FENCE) -> Column:
    """Leading tags, leading fence, backticks at both ends, newlines at both ends, in that order."""
    text = strip_leading(strip_leading(source, f"<{tag}>"), fence)
    return F.btrim(F.btrim(text, F.lit("`")), F.lit("\n"))


def clean_id(source: Column, tag: str = ID_TAG) -> Column:
    return strip_leading(source, f"<{tag}>")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_suffix(path: Column, suffixes) -> Column:
    return any_of([path.endswith(s) for s in suffixes])


def language_of(path: Column) -> Column:
    """'C++', 'C' or 'unsupported', by file extension (case-sensitive)."""
    return (
        F.when(has_suffix(path, CPP_SUFFIXES), "C++")
        .when(has_suffix(path, C_SUFFIXES), "C")
        .otherwise("unsupported")
    )


def is_scanned_source(path: Column) -> Column:
    """A source extension, and a file name that does not mention test/Test."""
    return has_suffix(path, SCANNED_SUFFIXES) & ~basename(path).rlike(EXCLUDED_NAME_PATTERN)


def is_dynamic(path: Column) -> Column:
    """The extension is exactly ``.so``; a versioned ``.so.1`` or a bare dot file is not."""
    return path.rlike(r"[^/]\.so$")


def touches_any(paths: list[Column], names=BUILD_FILES) -> Column:
    """One of the names occurs anywhere in one of the paths; null paths count as no."""
    return any_of([F.coalesce(p.contains(n), F.lit(False)) for p in paths for n in names])


def mentions_flag(command: Column, flag: str = "-pthread") -> Column:
    return command.contains(flag)


def is_uuid(text: Column) -> Column:
    """36 characters, dashes at 8/13/18/23, hex elsewhere; the version digit is not checked."""
    return text.rlike(UUID_PATTERN)


def flatten_path(path: Column) -> Column:
    """Every component prefixed with '_' and no separators: ``lib/a.o`` -> ``_lib_a.o``."""
    return F.concat(F.lit("_"), F.replace(path, F.lit("/"), F.lit("_")))


def included_files(text: Column) -> Column:
    """Array of the files named by include directives, in text order."""
    return F.regexp_extract_all(text, F.lit(INCLUDE_PATTERN), 1)


def render(template: str, *values: Column) -> Column:
    """Fill each ``{}`` of a template with a column; a null value gives a null request."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError("the template needs one {} per value")
    parts: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)
