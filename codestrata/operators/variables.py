"""Variables and the instructions that use them, from IR listing lines.

``ir_lines(module, line_no, line)``. A value keeps its sigil (``%x`` local, ``@g`` global);
its name has none, and a numbered value has no name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.functions import ir
from codestrata.operators.ordered import carry_down, first_wins
from codestrata.operators.skew import hot_keys, salted_join
from codestrata.operators.snapshots import union_all
from codestrata.session import stored



def with_scope(lines: DataFrame, keys=("module",), order=("line_no",), line: str = "line", chunk: Column | None = None) -> DataFrame:
    """Carry the enclosing function and block down to each line; null outside functions."""
    text = F.col(line)
    starts, ends = ir.is_function_start(text), F.ltrim(text).startswith("}")
    name = ir.unquoted(F.regexp_extract(text, ir.FUNCTION_START, 1))
    label = F.when(text.contains(":"), F.regexp_extract(text, ir.BLOCK_LABEL, 1)).otherwise("")
    scoped = carry_down(
        lines,
        list(keys),
        list(order),
        {
            "function": F.when(starts, name).when(ends, ""),
            "block": F.when(starts, "entry").when(ends, "").when(label != "", label),
        },
        chunk,
    )
    return scoped.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("function", "block")})


def declarations(scoped: DataFrame, include_constants: bool = False) -> DataFrame:
    """Declared variables: (module, function, block, var, kind, line_no).

    Globals, parameters and local allocations; nameless and dot names left out, constants
    too unless asked for. Each line is read once and yields all its declarations; plain
    string tests discard the other lines before any pattern runs.
    """
    line = F.col("line")
    at_global = F.ltrim(line).startswith("@")
    at_function = ir.is_function_start(line)
    at_slot = F.col("function").isNotNull() & line.contains(" alloca ")
    word = F.regexp_extract(line, ir.GLOBAL_LINE, 2)
    is_global = (word == "global") | (F.lit(include_constants) & (word == "constant"))
    result = ir.unquoted(F.regexp_extract(line, rf"^\s*%({ir.NAME}) = ", 1))
    signature = F.regexp_extract(line, rf"{ir.FUNCTION_START}(.*)\)", 2)
    params = F.transform(F.regexp_extract_all(signature, F.lit(ir.PARAMETER), 1), ir.unquoted)
    none = F.array().cast("array<string>")
    names = (
        F.when(at_function, params)
        .when(at_global & is_global, F.array(ir.unquoted(F.regexp_extract(line, ir.GLOBAL_LINE, 1))))
        .when(at_slot & (ir.opcode_class(line) == "Alloca"), F.array(result))
        .otherwise(none)
    )
    kind = F.when(at_function, "FnParam").when(at_global, "Global").otherwise("Block")
    return (
        scoped.where(at_global | at_function | at_slot)
        .select(
            "module",
            F.when(~at_global, F.col("function")).alias("function"),
            F.when(~at_global, F.col("block")).alias("block"),
            kind.alias("kind"),
            "line_no",
            F.explode(names).alias("var"),
        )
        .where(ir.valid_variable(F.col("var")))
        .select("module", "function", "block", "var", "kind", "line_no")
    )


def instructions(scoped: DataFrame) -> DataFrame:
    """Instruction lines inside functions with opcode class and operation fingerprint."""
    text = F.btrim("line")
    is_code = (
        F.col("function").isNotNull()
        & (text != "")
        & ~text.startswith(";")
        & ~text.startswith("#dbg")
        & ~text.contains("@llvm.dbg.")
        & ~ir.is_function_start(F.col("line"))
        & ~F.col("line").rlike(ir.BLOCK_LABEL)
    )
    return scoped.where(is_code).select(
        "module",
        "function",
        "block",
        F.col("line_no").alias("inst_id"),
        ir.opcode_class(F.col("line")).alias("opcode"),
        ir.op_fingerprint(F.col("line")).alias("op"),
        "line",
    )


def operands(insts: DataFrame) -> DataFrame:
    """One row per operand: value (with sigil), name (without) and position."""
    return insts.select(
        "module",
        "function",
        "inst_id",
        "opcode",
        "op",
        F.posexplode(ir.operand_values(F.col("line"))).alias("pos", "value"),
    ).withColumn("name", ir.unquoted(F.substr("value", F.lit(2))))


def debug_bindings(scoped: DataFrame) -> DataFrame:
    """Source variable names bound to values: (module, function, var, value, line_no)."""
    line = F.col("line")
    is_record = line.rlike(ir.DEBUG_RECORD)
    pattern = lambda p: p.replace("[%@]", "([%@]", 1).replace(f"({ir.NAME})", f"{ir.NAME})", 1)
    value = [F.regexp_extract(line, pattern(p), 1) for p in (ir.DEBUG_RECORD, ir.DEBUG_CALL)]
    ident = [F.regexp_extract(line, p, 2) for p in (ir.DEBUG_RECORD, ir.DEBUG_CALL)]
    bound = scoped.where(is_record | line.rlike(ir.DEBUG_CALL)).select(
        "module",
        "function",
        "line_no",
        F.when(is_record, value[0]).otherwise(value[1]).alias("value"),
        F.when(is_record, ident[0]).otherwise(ident[1]).alias("id"),
    )
    names = scoped.where(line.rlike(ir.LOCAL_METADATA)).select(
        "module",
        F.regexp_extract(line, ir.LOCAL_METADATA, 1).alias("id"),
        F.regexp_extract(line, ir.LOCAL_METADATA, 2).alias("var"),
    )
    return (
        salted_join(bound, names, ["module", "id"], "inner")
        .where(ir.valid_variable(F.col("var")))
        .select("module", "function", "var", "value", "line_no")
    )


def variable_map(scoped: DataFrame, scope: str = "function") -> tuple[DataFrame, DataFrame]:
    """(variables, uses): globals, parameters and debug-named locals, and who uses them.

    The first declaration or binding of a name wins. ``scope='function'`` keeps names of
    different functions apart; ``scope='module'`` shares one name map per module.
    """
    keys = ["module", "var"] if scope == "module" else ["module", "function", "var"]
    declared = declarations(scoped).where(F.col("kind") != "Block")
    bound = debug_bindings(scoped)
    every = union_all(
        [
            declared.select("module", "function", "var", "kind", "line_no"),
            bound.withColumn("kind", F.lit("Block")),
        ]
    ).withColumn(
        "rank",
        F.when(F.col("kind") == "Global", 0).when(F.col("kind") == "FnParam", 1).otherwise(2),
    )
    if scope != "module":
        # a parameter's own debug binding names its value; it does not open a second variable
        every = every.withColumn("rank", F.when(F.col("value").isNotNull(), 0).otherwise(1))
    variables = first_wins(every, keys, ["rank", "line_no"])
    users = operands(instructions(scoped)).select("module", "function", "value", "inst_id", "opcode", "op")
    named = variables.where(F.col("value").isNotNull()).select(
        "module", "function", F.col("var"), "value"
    )
    uses = variable_uses(named, users)
    return variables.select("module", "function", "var", "kind"), uses


def variable_uses(named: DataFrame, users: DataFrame) -> DataFrame:
    """Instructions that use a variable's value; each instruction once per variable."""
    return (
        salted_join(users, named, ["module", "function", "value"], "inner")
        .select("module", "function", "var", "inst_id", "opcode", "op")
        .distinct()
    )


def use_counts(variables: DataFrame, uses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct instructions per variable; variables without uses count 0."""
    keys = list(keys)
    counted = (
        uses.select(*keys, "inst_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"))
    )
    joined = variables.select(*keys).distinct().alias("v").join(
        counted.alias("c"),
        on=[F.col(f"v.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys],
        how="left",
    )
    return joined.select(*[F.col(f"v.{k}").alias(k) for k in keys], F.coalesce("c.uses", F.lit(0)).alias("uses"))


def resolve_names(
    uses: DataFrame,
    local_names: DataFrame,
    global_names: DataFrame,
    local_keys: Sequence[str],
    global_keys: Sequence[str],
    value: str,
) -> DataFrame:
    """Look a name up in the local map, else in the global one; ``scope`` says which.

    Both maps are unique on their keys. A name that most uses mention is salted.
    """
    local = local_names.select(*local_keys, F.col(value).alias("_local"))
    shared = global_names.select(*global_keys, F.col(value).alias("_global"))
    near = salted_join(uses, local, local_keys, "left")
    found = salted_join(near, shared, global_keys, "left", hot=hot_keys(uses, global_keys))
    return (
        found.withColumn(
            "scope",
            F.when(F.col("_local").isNotNull(), "local")
            .when(F.col("_global").isNotNull(), "global")
            .otherwise("unresolved"),
        )
        .withColumn(value, F.coalesce("_local", "_global"))
        .drop("_local", "_global")
    )


def rw_uses(scoped: DataFrame, swap: bool = False, include_constants: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variables, uses, unresolved) of loads and stores.

    Per load or store only the first operand that resolves counts. A load reads, a store
    writes; ``swap=True`` exchanges them.
    """
    variables = declarations(scoped, include_constants)
    touched = operands(instructions(scoped)).where(F.col("opcode").isin("Load", "Store"))
    named = variables.select("module", "function", F.col("var").alias("name")).distinct()
    found = resolve_names(
        touched,
        named.where(F.col("function").isNotNull()).withColumn("var", F.col("name")),
        named.where(F.col("function").isNull()).drop("function").withColumn("var", F.col("name")),
        ["module", "function", "name"],
        ["module", "name"],
        "var",
    )
    kinds = ("write", "read") if swap else ("read", "write")
    uses = (
        found.where(F.col("var").isNotNull())
        .groupBy("module", "function", "inst_id")
        .agg(F.min_by(F.struct("var", "scope", "opcode"), "pos").alias("_first"))
        .select(
            "module",
            F.when(F.col("_first")["scope"] == "local", F.col("function")).alias("function"),
            F.col("_first")["var"].alias("var"),
            "inst_id",
            F.col("_first")["opcode"].alias("opcode"),
            F.when(F.col("_first")["opcode"] == "Load", kinds[0]).otherwise(kinds[1]).alias("use_kind"),
        )
    )
    unknown = found.where(F.col("var").isNull() & ir.is_named(F.col("name"))).select(
        "module", "function", "inst_id", "name"
    )
    return variables, uses, unknown


def rw_counts(uses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Read and write count per variable."""
    return uses.groupBy(*keys).agg(
        F.count_if(F.col("use_kind") == "read").alias("reads"),
        F.count_if(F.col("use_kind") == "write").alias("writes"),
    )


def variable_report(counts: DataFrame, by: Sequence[str] = ("module",), functions: DataFrame | None = None) -> DataFrame:
    """``by`` and ``report``: {"global_var": {v: {read, write}}, "function_var": {f: {v: ...}}}.

    ``counts(by, function, var, reads, writes)``; a null function marks a global. A read or
    write list repeats the variable's name, so it is built from the counts and no use row is
    ever collected: what is gathered per report is one element per variable.
    """
    by = list(by)
    entry = F.struct(
        F.col("var").alias("key"),
        F.struct(
            F.array_repeat("var", F.col("reads").cast("int")).alias("read"),
            F.array_repeat("var", F.col("writes").cast("int")).alias("write"),
        ).alias("value"),
    )
    rows = counts.select(*by, "function", "var", "reads", "writes")
    per_function = rows.groupBy(*by, "function").agg(F.sort_array(F.collect_list(entry)).alias("vars"))
    if functions is not None:
        empty = functions.select(*by, "function").where(F.col("function").isNotNull()).distinct()
        per_function = (
            per_function.unionByName(empty.withColumn("vars", F.array().cast(per_function.schema["vars"].dataType)))
            .groupBy(*by, "function")
            .agg(F.max("vars").alias("vars"))
        )
    local = F.col("function").isNotNull()
    no_vars = F.array().cast(per_function.schema["vars"].dataType)
    report = F.struct(
        F.map_from_entries(F.coalesce(F.max(F.when(~local, F.col("vars"))), no_vars)).alias("global_var"),
        F.map_from_entries(
            F.transform(
                F.sort_array(
                    F.collect_list(F.when(local, F.struct(F.col("function").alias("key"), "vars")))
                ),
                lambda f: F.struct(f["key"].alias("key"), F.map_from_entries(f["vars"]).alias("value")),
            )
        ).alias("function_var"),
    )
    return per_function.groupBy(*by).agg(report.alias("report")).select(*by, F.to_json("report").alias("report"))


def _sides(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of both versions with a flag per side; one shuffle, partially aggregated."""
    left = old.select(*columns, F.lit(True).alias("_old"), F.lit(False).alias("_new"))
    right = new.select(*columns, F.lit(False).alias("_old"), F.lit(True).alias("_new"))
    return left.unionByName(right).groupBy(*columns).agg(
        F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new")
    )


def variable_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("function", "var"), op: str = "op") -> DataFrame:
    """Operations of common variables that only one version has: keys, change, op.

    removed = in old, not in new; added = in new, not in old; how often an operation occurs
    does not matter. A variable without operations is a row with a null ``op``; keys must not
    be null (give the module scope a name, such as '').
    """
    keys = list(keys)
    sides = _sides(old, new, [*keys, op])
    in_old, in_new = F.col("_old"), F.col("_new")
    common = (
        sides.groupBy(*keys)
        .agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))
        .where(in_old & in_new)
        .select(*keys)
    )
    changed = sides.where(F.col(op).isNotNull() & (in_old != in_new)).select(
        *keys, F.when(in_old, "removed").otherwise("added").alias("change"), op
    )
    return salted_join(changed, common, keys, "left_semi")


def variable_count_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("function", "var"), op: str = "op") -> DataFrame:
    """Operations that common variables have more often in one version: keys, change, op, n (the difference).

    The multiset form of `variable_diff`: a second use of an equal operation is a change. Each version's rows
    weigh -1 or 1 and one aggregation, combined before its shuffle, leaves their sum for each operation; a
    variable is common if both versions have rows of it, also such without an operation (null).
    """
    keys = list(keys)
    one = F.lit(1).cast("bigint")
    signed = old.select(*keys, op, (-one).alias("_sign")).unionByName(new.select(*keys, op, one.alias("_sign")))
    sums = signed.groupBy(*keys, op).agg(
        F.sum("_sign").alias("_n"), F.bool_or(F.col("_sign") < 0).alias("_old"), F.bool_or(F.col("_sign") > 0).alias("_new")
    )
    common = (
        sums.groupBy(*keys)
        .agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))
        .where(F.col("_old") & F.col("_new"))
        .select(*keys)
    )
    changed = sums.where(F.col(op).isNotNull() & (F.col("_n") != 0)).select(
        *keys, F.when(F.col("_n") < 0, "removed").otherwise("added").alias("change"), op, F.abs("_n").alias("n")
    )
    return salted_join(changed, common, keys, "left_semi")


def changed_names(diff: DataFrame, keys: Sequence[str] = ("function", "var")) -> DataFrame:
    return diff.select(*keys).distinct()


def adds(diff: DataFrame, var: str, op: str = "op") -> DataFrame:
    """Operations added to one variable; no rows when it did not change."""
    return diff.where((F.col("var") == var) & (F.col("change") == "added")).select(op)


def removes(diff: DataFrame, var: str, op: str = "op") -> DataFrame:
    return diff.where((F.col("var") == var) & (F.col("change") == "removed")).select(op)


def one_sided(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("function", "var")) -> DataFrame:
    """Names in one version only, with ``side`` in {'old', 'new'}."""
    only = _sides(old, new, list(keys)).where(F.col("_old") != F.col("_new"))
    return only.select(*keys, F.when(F.col("_old"), "old").otherwise("new").alias("side"))


def rename_candidates(
    old: DataFrame, new: DataFrame, var: str = "var", within: Sequence[str] = ("function",), op: str = "op"
) -> DataFrame:
    """``within``, old_name, new_name: one-sided variables whose operation sets are equal, 1:1.

    Sets are compared by size and two order-free hash sums, which aggregate on the map side
    whatever the size of a set; only the operations of surviving pairs are read again and
    checked one by one.
    Signatures shared by several variables are ambiguous and give no pair. Variables without
    operations are not matched.
    """
    within = list(within)
    keys = [*within, var]
    sides = _sides(old, new, [*keys, op])
    in_old = F.col("_old")
    digest = F.xxhash64(op)
    has_op = F.col(op).isNotNull()
    signed = (
        sides.groupBy(*keys)
        .agg(
            F.bool_or("_old").alias("_old"),
            F.bool_or("_new").alias("_new"),
            F.count(op).alias("_size"),
            F.bit_xor(F.when(has_op, digest)).alias("_xor"),
            F.sum(F.when(has_op, digest.cast("decimal(20,0)"))).alias("_sum"),
        )
        .where((in_old != F.col("_new")) & (F.col("_size") > 0))
    )
    pairs = (
        signed.groupBy(*within, "_size", "_xor", "_sum")
        .agg(
            F.count_if(in_old).alias("_n_old"),
            F.count_if(~in_old).alias("_n_new"),
            F.min(F.when(in_old, F.col(var))).alias("old_name"),
            F.min(F.when(~in_old, F.col(var))).alias("new_name"),
        )
        .where((F.col("_n_old") == 1) & (F.col("_n_new") == 1))
    )
    ends = F.inline(F.array(*[F.struct(F.col(n).alias(var)) for n in ("old_name", "new_name")]))
    labels = stored(pairs.select(*within, "old_name", "new_name", "_size", ends), "renames")
    paired = [salted_join(side.where(has_op).select(*keys, op), labels, keys, "inner") for side in (old, new)]
    same = _sides(*paired, [*within, "old_name", "new_name", "_size", op])
    return (
        same.groupBy(*within, "old_name", "new_name", "_size")
        .agg(F.count_if(in_old & F.col("_new")).alias("_same"))
        .where(F.col("_same") == F.col("_size"))
        .select(*within, "old_name", "new_name")
    )


def calls(insts: DataFrame) -> DataFrame:
    """One row per call: module, caller, inst_id, callee, args[]."""
    body = ir.instruction_text(F.col("line"))
    callee = ir.unquoted(F.regexp_extract(body, rf"@({ir.NAME})\(", 1))
    inside = F.regexp_extract(body, rf"@{ir.NAME}\((.*)\)", 1)
    return insts.where((F.col("opcode") == "Call") & (callee != "")).select(
        "module",
        F.col("function").alias("caller"),
        "inst_id",
        callee.alias("callee"),
        F.transform(F.regexp_extract_all(inside, F.lit(ir.OPERAND), 1), ir.unquoted).alias("args"),
    )


def call_arguments(called: DataFrame) -> DataFrame:
    """(callee, argument name) per call argument."""
    return called.select("module", "caller", "callee", F.posexplode("args").alias("pos", "arg"))


def functions_of(scoped: DataFrame) -> DataFrame:
    """Functions defined or declared in each module."""
    text = F.ltrim("line")
    named = scoped.where(text.startswith("define") | text.startswith("declare"))
    found = ir.unquoted(F.regexp_extract("line", ir.DEFINE_LINE, 1))
    return named.select("module", found.alias("function")).where(F.col("function") != "").distinct()
