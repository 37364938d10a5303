"""Source-text corpora: scan rules, includes, call sites, requests, id audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions.text import (
    basename,
    included_files,
    is_scanned_source,
    is_uuid,
    language_of,
    render,
)

# Request texts and the generated names of the mutation templates.
SYSTEM_PROMPT = (
    "You are an Expert in POSIX Thread Model and Linux API, including sync prototype, atomic, "
    "CPU cache and memory corruption. You will check the input source code, point the issues "
    "including: wrong memory order of atomic variables read and write; dead lock; non-thread "
    "safe API uses in thread scope."
)
USER_TEMPLATE = "```C\n{}\n```"
ARG_STRUCT = "_ONLY_FORVUL_ARG"
THREAD_FUNCTION = "ONLY_FOR_VUL"
C_THREAD = "SPECIFIC_THREAD"
CPP_THREAD = "_DETACH_THREAD"

# TYPE ID = FUNC( as the head of a call site.
CALL_HEAD = (
    r"(?<![\w.>])((?:const\s+|unsigned\s+|struct\s+)*[A-Za-z_]\w*(?:\s*\*+\s*|\s+))([A-Za-z_]\w*)"
    r"\s*=\s*([A-Za-z_][\w:.]*)\("
)
# Comments, then string and character literals.
UNREAD = r"//[^\n]*|/\*.*?(?:\*/|\Z)|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
SITE_PARTS = ("statement", "type", "id", "func", "args")
STATEMENT_WORDS = ("return", "else", "goto", "case", "typedef")


def scan_sources(files: DataFrame, path: str = "path", skipped: Sequence[str] = (), root: str | None = None) -> DataFrame:
    """Files with a source extension whose name does not mention test; a skipped root gives none."""
    if root is not None and root in skipped:
        return files.limit(0)
    return files.where(is_scanned_source(F.col(path)))


def find_file(files: DataFrame, name: str, path: str = "path") -> DataFrame:
    """The smallest path with that base name (deterministic, one row, null if none)."""
    return files.where(basename(F.col(path)) == name).agg(F.min(path).alias(path))


def includes(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row per include directive: file, include."""
    return sources.select(F.col(key).alias("file"), F.explode(included_files(F.col(text))).alias("include"))


def _site_scanner():
    """A vectorised function from texts to call sites. All it needs travels inside it."""
    head, unread, words = CALL_HEAD, UNREAD, STATEMENT_WORDS

    def scan(texts):
        import re

        import pandas as pd

        start, skip, paren, after = re.compile(head), re.compile(unread, re.S), re.compile("[()]"), re.compile(r";(?=\s*[^\s}])")
        word = re.compile(rf"(?:{'|'.join(words)})\b")

        def sites(text):
            # Same length, so places agree: comments become blanks, literals one long word.
            code = skip.sub(lambda m: ("_" if m[1] else " ") * len(m[0]), text or "")
            closing, open_ = {}, []
            for m in paren.finditer(code):
                if m[0] == "(":
                    open_.append(m.start())
                elif open_:
                    closing[open_.pop()] = m.start()
            found = []
            for m in start.finditer(code):
                end = closing.get(m.end() - 1)
                if end is not None and after.match(code, end + 1) and not word.match(m[0]):
                    kind = re.sub(r"\s+", " ", m[1]).strip(" ")
                    args, depth, from_ = [], 0, m.end()
                    for k in range(m.end(), end + 1):
                        depth += (code[k] in "([{") - (code[k] in ")]}")
                        if k == end or depth == 0 and code[k] == ",":
                            args.append(text[from_:k].strip(" \t\n"))
                            from_ = k + 1
                    found.append((m.start() + 1, text[m.start() : end + 2], kind, m[2], m[3], text[m.end() : end], [a for a in args if a]))
            return found

        for part in texts:
            yield pd.Series([sites(t) for t in part], dtype=object)

    return scan


def _sites(text: Column) -> Column:
    """Initialising call statements in text order: at (1-based), statement, type, id, func, args. Parentheses are
    matched at any depth; what stands in comments or literals is not code."""
    return F.pandas_udf(
        _site_scanner(), "array<struct<at int, statement string, type string, id string, func string, args string, arguments array<string>>>",
        F.PandasUDFType.SCALAR_ITER,
    )(text)


def call_sites(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Initialising call statements: TYPE ID = FUNC(ARGS); with a following statement."""
    found = sources.select(key, _sites(F.col(text)).alias("_sites"))
    rows = found.select(key, F.posexplode("_sites").alias("pos", "_site"))
    return rows.select(key, "pos", *[F.col("_site")[c].alias(c) for c in SITE_PARTS])


def first_call_site(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Only the first applicable statement of each file, without a shuffle."""
    one = sources.withColumn("_site", F.try_element_at(_sites(F.col(text)), F.lit(1))).where(F.col("_site").isNotNull())
    return one.withColumns({c: F.col("_site")[c] for c in ("at", *SITE_PARTS, "arguments")}).drop("_site")


def _is_literal(arg: Column) -> Column:
    return arg.rlike('^["0-9]')


def _per_argument(args: Column, literal, other) -> Column:
    return F.transform(
        args, lambda a, i: F.when(_is_literal(a), literal(a, i)).otherwise(other(a, i))
    )


def _threaded_c(args: Column) -> Column:
    number = lambda i: i.cast("string")
    fields = _per_argument(
        args,
        lambda a, i: F.concat(F.lit("/* skip "), number(i), F.lit("th "), a, F.lit(" */")),
        lambda a, i: F.concat(F.lit("typeof("), a, F.lit(") var_"), number(i), F.lit(";")),
    )
    copies = F.filter(
        _per_argument(
            args,
            lambda a, i: F.lit(""),
            lambda a, i: F.concat(F.lit("arg.var_"), number(i), F.lit(" = "), a, F.lit(";")),
        ),
        lambda line: line != "",
    )
    passed = _per_argument(args, lambda a, i: a, lambda a, i: F.concat(F.lit("args->var_"), number(i)))
    declared = F.concat_ws(" ", "type", F.concat("id", F.lit(";")))
    call = F.concat(
        F.lit("args->"), "id", F.lit(" = "), "func", F.lit("("), F.array_join(passed, ", "), F.lit(");")
    )
    return F.concat_ws(
        "\n",
        F.lit(f"struct {ARG_STRUCT} {{"),
        F.array_join(F.concat(fields, F.array(declared)), "\n"),
        F.lit("};"),
        F.lit(f"void* {THREAD_FUNCTION}(struct {ARG_STRUCT}* args) {{"),
        call,
        F.lit("return NULL;\n}"),
        F.lit(f"pthread_t {C_THREAD};"),
        declared,
        F.lit(f"struct {ARG_STRUCT} arg;"),
        F.when(F.size(copies) > 0, F.array_join(copies, "\n")),
        F.lit(f"pthread_create(&{C_THREAD}, NULL, (void*){THREAD_FUNCTION}, (void*) &(arg));"),
        F.lit(f"pthread_detach({C_THREAD});"),
    )


def _threaded_cpp() -> Column:
    return F.concat_ws(
        "\n",
        F.concat_ws(" ", "type", F.concat("id", F.lit(";"))),
        F.lit(f"auto {CPP_THREAD} = std::thread([&]() {{"),
        F.concat("id", F.lit(" = "), "func", F.lit("("), "args", F.lit(");")),
        F.lit("});"),
        F.lit(f"{CPP_THREAD}.detach();"),
    )


def inject_race(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Test mutants: the first call site of each C/C++ file moved to a detached thread.

    Literal arguments stay in the call; for C the others are copied into struct fields.
    Files without a site, or in another language, give no row. Result: key, language, mutated.
    """
    sites = (
        first_call_site(sources, key, text)
        .withColumn("language", language_of(F.col(key)))
        .where(F.col("language") != "unsupported")
    )
    new = F.when(F.col("language") == "C", _threaded_c(F.col("arguments"))).otherwise(_threaded_cpp())
    body = F.col(text)
    return sites.select(
        key,
        "language",
        F.concat(
            F.substr(body, F.lit(1), F.col("at") - 1),
            new,
            F.substr(body, F.col("at") + F.length("statement")),
        ).alias("mutated"),
    )


def requests(sources: DataFrame, key: str = "path", text: str = "text", template: str = USER_TEMPLATE) -> DataFrame:
    """Request text per file."""
    return sources.select(
        key, F.lit(SYSTEM_PROMPT).alias("system"), render(template, F.col(text)).alias("request")
    )


def id_audit(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Valid and invalid id counts; null ids are invalid."""
    valid = F.coalesce(is_uuid(F.col(column)), F.lit(False))
    return df.groupBy(*by).agg(
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid")
    )
