import json

from pyspark.sql import functions as F

from codestrata.functions import ir
from codestrata.operators import variables as v
from codestrata.plans import jobs
from codestrata.sources import readers

# A small counting loop as an optimised listing with debug records.
LOOP = """@.str = private constant [4 x i8] c"%d\\00", align 1
@limit = dso_local global i32 4, align 4
@table = dso_local constant i32 4, align 4
define dso_local i32 @main(i32 noundef %0, ptr %1) local_unnamed_addr #0 !dbg !9 {
    #dbg_value(i32 %0, !11, !DIExpression(), !20)
    #dbg_value(ptr %1, !12, !DIExpression(), !20)
  %3 = icmp sgt i32 %0, 1, !dbg !21
  br i1 %3, label %4, label %10

4:                                                ; preds = %2
  %5 = zext nneg i32 %0 to i64
  br label %6

6:
  %7 = phi i64 [ 1, %4 ], [ %9, %6 ]
    #dbg_value(i64 %7, !13, !DIExpression(), !20)
  %8 = tail call i32 (ptr, ...) @printf(ptr noundef @.str, i64 noundef %7), !dbg !22
  %9 = add nuw nsw i64 %7, 1
  %11 = icmp eq i64 %9, %5
  br i1 %11, label %10, label %6

10:
  ret i32 0
}
declare i32 @printf(ptr noundef, ...)
!11 = !DILocalVariable(name: "argc", arg: 1, scope: !9)
!12 = !DILocalVariable(name: "argv", arg: 2, scope: !9)
!13 = !DILocalVariable(name: "INDEX", scope: !14)"""

MEMORY = """@total = dso_local global i32 0, align 4
@.str = private unnamed_addr constant [3 x i8] c"ab\\00"
define i32 @work(i32 %size, ptr %0) {
entry:
  %slot = alloca i32, align 4
  store i32 %size, ptr %slot, align 4
  store i32 7, ptr %slot, align 4
  %a = load i32, ptr %slot, align 4
  %b = load i32, ptr @total, align 4
  store i32 5, ptr @total, align 4
  %c = load i32, ptr %missing, align 4
  %r = tail call i32 @helper(i32 %a, ptr @total)
  ret i32 %r
}
define i32 @helper(i32 %total, ptr %p) {
  %x = load i32, ptr %p, align 4
  store i32 %total, ptr %p, align 4
  call void @work(i32 %x, ptr %p)
  ret i32 %x
}"""


def lines(spark, text, module="m"):
    data = [(module, i, t) for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(data, "module string, line_no bigint, line string").repartition(3)


def test_loop_program(spark, rows):
    names, uses = v.variable_map(v.with_scope(lines(spark, LOOP.replace("@limit = dso_local global", "@.hidden = global"))))
    counts = v.use_counts(names, uses, ["module", "function", "var"])
    assert rows(counts, "var", "uses") == [("INDEX", 2), ("argc", 2), ("argv", 0)]
    whole, _ = v.variable_map(v.with_scope(lines(spark, LOOP)))
    assert rows(whole, "var", "kind") == [("INDEX", "Block"), ("argc", "Block"), ("argv", "Block"), ("limit", "Global")]


def test_module_scope_keeps_the_first_binding(spark, rows):
    twice = LOOP + '\ndefine i32 @two(i32 %0) {\n  #dbg_value(i32 %0, !31, !DIExpression(), !20)\n  %2 = add i32 %0, 1\n  ret i32 %0\n}\n!31 = !DILocalVariable(name: "argc", arg: 1, scope: !9)'
    scoped = v.with_scope(lines(spark, twice))
    names, uses = v.variable_map(scoped, "module")
    assert [r.function for r in names.where("var = 'argc'").collect()] == ["main"]
    assert rows(v.use_counts(names, uses, ["module", "var"]).where("var = 'argc'"), "uses") == [(2,)]
    apart, _ = v.variable_map(scoped)
    assert sorted(r.function for r in apart.where("var = 'argc'").collect()) == ["main", "two"]


def test_older_debug_calls(spark, rows):
    old = LOOP.replace("#dbg_value(i64 %7, !13, !DIExpression(), !20)", "call void @llvm.dbg.value(metadata i64 %7, metadata !13, metadata !DIExpression()), !dbg !20")
    names, uses = v.variable_map(v.with_scope(lines(spark, old)))
    assert rows(v.use_counts(names, uses, ["var"]), "var", "uses") == [("INDEX", 2), ("argc", 2), ("argv", 0), ("limit", 0)]


def test_pure_rename(spark, rows):
    change = jobs.variable_changes(lines(spark, LOOP), lines(spark, LOOP.replace("INDEX", "arg_index")))
    assert change.diff.count() == 0
    assert rows(change.renames, "function", "old_name", "new_name") == [("main", "INDEX", "arg_index")]


def test_added_and_removed_operations(spark, rows):
    after = LOOP.replace("  %9 = add nuw nsw i64 %7, 1", "  %12 = urem i64 %7, 3\n  %9 = add nuw nsw i64 %7, 2")
    change = jobs.variable_changes(lines(spark, LOOP), lines(spark, after))
    assert rows(change.diff, "var", "change") == [("INDEX", "added")]
    assert v.adds(change.diff, "INDEX").count() == 1 and v.removes(change.diff, "INDEX").count() == 0
    assert v.adds(change.diff, "argc").count() == 0
    back = jobs.variable_changes(lines(spark, after), lines(spark, LOOP))
    assert rows(back.diff, "var", "change") == [("INDEX", "removed")]
    assert rows(v.changed_names(back.diff)) == [("main", "INDEX")]
    assert back.diff.columns == ["module", "function", "var", "change", "op"]


def test_modules_do_not_mix(spark, rows):
    """Two modules that swap their contents both change."""
    one, two = LOOP, LOOP.replace("  %9 = add nuw nsw i64 %7, 1", "  %9 = mul i64 %7, 3")
    both = lambda a, b: lines(spark, a).withColumn("module", F.lit("a")).unionByName(lines(spark, b).withColumn("module", F.lit("b")))
    diff = jobs.variable_changes(both(one, two), both(two, one)).diff
    assert rows(diff, "module", "var", "change") == [(m, "INDEX", c) for m in "ab" for c in ("added", "removed")]


USES = "function string, var string, op string"


def test_variable_diff_counts_variables_without_operations(spark, rows):
    old = spark.createDataFrame([("f", "a", None), ("f", "b", "x"), ("f", "gone", "x")], USES)
    new = spark.createDataFrame([("f", "a", "y"), ("f", "b", "x"), ("f", "b", "x"), ("f", "new", "z")], USES)
    assert rows(v.variable_diff(old, new)) == [("f", "a", "added", "y")]
    assert rows(v.one_sided(old, new)) == [("f", "gone", "old"), ("f", "new", "new")]


def test_renames_must_be_one_to_one(spark, rows):
    old = spark.createDataFrame([("f", "a", "1"), ("f", "a", "2"), ("f", "b", "9"), ("g", "p", "3"), ("f", "kept", "1"), ("f", "e", None)], USES)
    new = spark.createDataFrame([("f", "z", "2"), ("f", "z", "1"), ("f", "z", "1"), ("f", "c", "9"), ("f", "d", "9"), ("g", "q", "4"), ("f", "kept", "5"), ("f", "h", None)], USES)
    assert rows(v.rename_candidates(old, new)) == [("f", "a", "z")]


def test_shadowed_names_stay_apart(spark, rows):
    df = v.declarations(v.with_scope(lines(spark, MEMORY)))
    assert rows(df, "function", "var", "kind") == [
        (None, "total", "Global"), ("helper", "p", "FnParam"), ("helper", "total", "FnParam"), ("work", "size", "FnParam"), ("work", "slot", "Block"),
    ]


def test_reads_and_writes(spark, rows):
    scoped = v.with_scope(lines(spark, MEMORY))
    _, uses, unknown = v.rw_uses(scoped)
    got = rows(v.rw_counts(uses, ["function", "var"]))
    assert got == [(None, "total", 1, 1), ("helper", "p", 1, 0), ("helper", "total", 0, 1), ("work", "size", 0, 1), ("work", "slot", 1, 1)]
    assert rows(unknown, "function", "name") == [("work", "missing")]
    _, swapped, _ = v.rw_uses(scoped, swap=True)
    assert ("work", "slot", 1, 1) in rows(v.rw_counts(swapped, ["function", "var"])) and (None, "total", 1, 1) in rows(v.rw_counts(swapped, ["function", "var"]))
    assert ("helper", "p", 0, 1) in rows(v.rw_counts(swapped, ["function", "var"]))


def test_report_is_nested_json(spark):
    report = json.loads(jobs.analyze("rwop", lines(spark, MEMORY)).first().report)
    assert report == {
        "global_var": {"total": {"read": ["total"], "write": ["total"]}},
        "function_var": {
            "helper": {"p": {"read": ["p"], "write": []}, "total": {"read": [], "write": ["total"]}},
            "work": {"size": {"read": [], "write": ["size"]}, "slot": {"read": ["slot"], "write": ["slot"]}},
        },
    }
    loop = json.loads(jobs.rw_reports(lines(spark, LOOP)).first().report)
    assert set(loop["function_var"]) == {"main", "printf"} and set(loop["global_var"]) == {"limit", "table"}


def test_calls(spark, rows):
    insts = v.instructions(v.with_scope(lines(spark, MEMORY)))
    assert rows(v.calls(insts), "caller", "callee", "args") == [("helper", "work", ["x", "p"]), ("work", "helper", ["a", "total"])]
    assert rows(v.call_arguments(v.calls(insts)), "callee", "arg")[0] == ("helper", "a")
    assert rows(jobs.call_graph(lines(spark, MEMORY)), "caller", "callee", "calls") == [("helper", "work", 1), ("work", "helper", 1)]


def test_scope_across_cells(spark, rows):
    df = lines(spark, MEMORY)
    small = v.with_scope(df, chunk=F.floor(F.col("line_no") / 2))
    assert rows(small, "line_no", "function", "block") == rows(v.with_scope(df), "line_no", "function", "block")


def test_line_functions(spark):
    def one(text, function):
        return spark.createDataFrame([(text,)], "l string").select(function(F.col("l"))).first()[0]

    kinds = ["  %r = tail call i32 @f()", "  store i32 1, ptr %p", "%1 = load i32, ptr %p", "  %s = alloca i8", "  ret void", "  call void @g()"]
    assert [one(k, ir.opcode_class) for k in kinds] == ["Call", "Store", "Load", "Alloca", "other", "Call"]
    assert one('  %res = add i32 %a, %"b c"', ir.operand_values) == ["%a", '%"b c"']
    same = [("%1 = add nsw i32 %0, 1", "%x = add nsw i32 %y, 22, !dbg !7"), ("%2 = call i32 @f(ptr %1)", "%3 = call i32 @g(ptr @s)")]
    for a, b in same:
        assert one(a, ir.op_fingerprint) == one(b, ir.op_fingerprint)
    different = [("%1 = add i32 %0, 1", "%1 = sub i32 %0, 1"), ("%1 = add i32 %0, 1", "%1 = add i64 %0, 1"),
                 ("%1 = load i32, ptr %p, align 4", "%1 = load i32, ptr %p, align 8"), ("%1 = alloca [3 x i8]", "%1 = alloca [4 x i8]"),
                 ("%1 = icmp eq i32 %0, 1", "%1 = icmp ne i32 %0, 1")]
    for a, b in different:
        assert one(a, ir.op_fingerprint) != one(b, ir.op_fingerprint), (a, b)


def test_listing_files(spark, tmp_path, rows):
    (tmp_path / "a.ll").write_text(MEMORY)
    (tmp_path / "b.ll").write_text(LOOP)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many splits per file
    try:
        read = readers.read_ir_listings(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    for name, text in (("a.ll", MEMORY), ("b.ll", LOOP)):
        got = sorted((r.line_no, r.line) for r in read if r.module.endswith(name))
        assert [line for _, line in got] == text.split("\n")
        assert [n for n, _ in got] == list(range(len(got)))
    memory = readers.listing_lines(spark.createDataFrame([("m", MEMORY)], "module string, body string"))
    assert rows(memory, "line_no", "line") == rows(lines(spark, MEMORY), "line_no", "line")


def test_a_second_use_of_an_equal_operation_is_a_change(spark, hotness, rows):
    old = spark.createDataFrame([("f", "a", "x"), ("f", "a", "y"), ("f", "b", None), ("f", "gone", "x")], "function string, var string, op string")
    new = spark.createDataFrame([("f", "a", "x"), ("f", "a", "x"), ("f", "a", "x"), ("f", "b", "y"), ("f", "new", "x")], "function string, var string, op string")
    changed = v.variable_count_diff(old, new)
    assert rows(changed) == [("f", "a", "added", "x", 2), ("f", "a", "removed", "y", 1), ("f", "b", "added", "y", 1)]
    assert rows(v.variable_diff(old, new)) == [("f", "a", "removed", "y"), ("f", "b", "added", "y")]
    assert rows(v.variable_count_diff(new, new)) == []
