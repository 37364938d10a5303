import random
import json

import pytest
from pyspark.sql import functions as F

from codestrata.functions import commands as c, text as t
from codestrata.operators import commands as ops
from codestrata.sources import readers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "command, names",
    [
        ("cc a.c -lgit2 -l m -pthread", ["git2", "m"]),
        ("cc -l", []),
        ("cc -lm -l", ["m"]),
        ("cc -l  x", [""]),
        ("cc -l -lm -lz", ["-lm", "z"]),
        ("-lfirst cc", ["first"]),
        ("cc x-lno", []),
        ("", []),
    ],
)
def test_flag_values(spark, command, names):
    assert one(spark, command, c.flag_values) == names


def test_tokens_keep_empty_ones(spark, rows):
    df = spark.createDataFrame([("a  b ",)], "command string")
    assert rows(ops.token_positions(df)) == [(0, "a"), (1, ""), (2, "b"), (3, "")]


@pytest.mark.parametrize(
    "command, rewritten, outputs",
    [
        ("cc -O3 -c a.c -o lib/a.o", "cc -g -c a.c -o _lib_a.o -emit-llvm -g", ["build/_lib_a.o"]),
        ("cc  -c a.c", "cc -c a.c -g", []),
        ("cc -og x -Og -O2", "cc -g x -g -g", []),
        ("cc -o /abs/x.o", "cc -o __abs_x.o -emit-llvm -g -g", ["build/__abs_x.o"]),
        ("cc a.c -o", "cc a.c -g", []),
        ("cc -o -o y", "cc -o _-o -emit-llvm -g y -g", ["build/_-o"]),
        ("cc -o -O3 y", "cc -o _-O3 -emit-llvm -g y -g", ["build/_-O3"]),
        ("cc -O0 -g a.c", "cc -O0 -g a.c -g", []),
    ],
)
def test_rewrite(spark, command, rewritten, outputs):
    got = one(spark, command, c.rewrite_command)
    assert (got.command, got.outputs) == (rewritten, outputs)


def test_rewrite_table(spark, rows):
    df = spark.createDataFrame([("f", "cc -O1 -o a/b")], "file string, command string")
    assert rows(ops.rewrite_commands(df)) == [("f", "cc -g -o _a_b -emit-llvm -g", ["build/_a_b"])]


RECORDS = [
    {"directory": "/b", "command": "cc -pthread a.c", "file": "a.c", "output": "a.o"},
    {"directory": "/b", "file": "b.c"},
    {"command": "cc", "arguments": ["x"]},
    {"command": 5, "file": "c.c"},
    {"command": None, "file": "c.c"},
]


def test_compile_db(spark, tmp_path, rows):
    for name, records in {"zero": [], "one": RECORDS[:1], "two": RECORDS[:2]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(records, indent=1))
    zero, one, two = (readers.read_compile_db(spark, str(tmp_path / f"{n}.json")) for n in ("zero", "one", "two"))
    assert zero[0].count() == 0 and zero[1].count() == 0
    assert rows(one[0], "file", "output") == [("a.c", "a.o")]
    assert two[0].count() == 1 and rows(two[1], "reason") == [("NoCommand",)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_compile_db(spark, str(tmp_path / "none.json"))


def test_strict_records(spark, tmp_path, rows):
    path = tmp_path / "db.json"
    path.write_text(json.dumps(RECORDS))
    records = readers.read_compile_records(spark, str(path)).drop("path")
    more = spark.createDataFrame([("[1]",), ("7",), ("{bad",)], "value string")
    good, rejected = ops.validate_records(records.union(more))
    assert rows(good, "file") == [("a.c",), ("b.c",)]
    assert rows(rejected.groupBy("reason").count()) == [("NoCommand", 3), ("UnknownField", 1), ("WrongFieldValueType", 2)]


def test_library_resolution(spark, rows):
    cmds = spark.createDataFrame([("a.c", "cc -lgit2 -lm"), ("b.c", "cc -lgit2 -lnone")], "file string, command string")
    inventory = spark.createDataFrame([("/lib/libgit2.so",), ("/usr/local/lib/libgit2.so",), ("/lib/libm.so",), ("/opt/libnone.so",)], "path string")
    linked = ops.linked_libraries(cmds, inventory)
    assert rows(linked, "file", "name", "path") == [
        ("a.c", "git2", "/usr/local/lib/libgit2.so"), ("a.c", "m", "/lib/libm.so"), ("b.c", "git2", "/usr/local/lib/libgit2.so"),
    ]
    assert rows(ops.paths_of(linked, "git2")) == [("/usr/local/lib/libgit2.so",)] * 2
    assert rows(ops.library_frequency(linked)) == [("git2", 2), ("m", 1)]
    assert rows(ops.unresolved(ops.library_flags(cmds), inventory)) == [("none", "Could not find library none in search paths")]


def test_marked_commands(spark, rows):
    cmds = spark.createDataFrame(
        [("a.c", "cc -pthread", 1), ("b.c", "cc", 1), ("c.c", "cc", 1), ("d.c", "cc -pthread", 1), ("d.c", "cc", 2)],
        "file string, command string, ord int",
    )
    inc = spark.createDataFrame([("a.c", "pool.h"), ("b.c", "pool.h"), ("c.c", "stdio.h"), ("d.c", "own.h"), ("z.c", "pool.h")], "file string, include string")
    assert rows(ops.marked_commands(cmds, inc, order=["ord"])) == [("a.c", "flag"), ("b.c", "include")]


def test_path_predicates(spark):
    paths = ["a.cc", "a.cpp", "a.cu", "a.hpp", "a.c", "a.h", "a.C", "a.c++", "my_test.c", "Test/a.c", "aTest.cpp"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    lang = {r.p: r.l for r in df.select("p", t.language_of(F.col("p")).alias("l")).collect()}
    assert [lang[p] for p in paths[:7]] == ["C++"] * 4 + ["C", "unsupported", "unsupported"]
    scanned = {r.p for r in df.where(t.is_scanned_source(F.col("p"))).collect()}
    assert scanned == {"a.cc", "a.cpp", "a.cu", "a.c", "a.C", "a.c++", "Test/a.c"}
    for path, flag in [("libx.so", True), ("libx.so.1", False), ("d/.so", False), ("libx.a", False)]:
        assert one(spark, path, t.is_dynamic) is flag
    touch = spark.createDataFrame([("src/meson.build.in", None), (None, "x/CMakeLists.txt"), ("a.c", "b.c")], "o string, n string")
    assert [r[0] for r in touch.select(t.touches_any([F.col("n"), F.col("o")])).collect()] == [True, True, False]


@pytest.mark.parametrize(
    "text, valid",
    [
        ("d0cd8041-0504-40cb-ac8e-d05960d205ec", True),
        ("00000000-0000-0000-0000-000000000000", True),
        ("6B9F53BE-CF46-40E8-8627-6B60DC33DEF8", True),
        ("3df6f0e4-f9b1-4e34-ad70-33206069b99", False),
        ("3df6f0e4-f9b1-4e34-ad70-33206069b9912", False),
        ("3df6f0e4-f9b1-4e34-ad70_33206069b991", False),
        ("zdf6f0e4-f9b1-4e34-ad70-33206069b995", False),
    ],
)
def test_ids(spark, text, valid):
    assert one(spark, text, t.is_uuid) is valid


def test_damaged_databases_are_rows(spark, rows):
    texts = [("ok", '[{"command":"cc","file":"a.c"}]'), ("empty", "[]"), ("cut", '[{"command":"cc"'), ("number", '[{"command":5}]'), ("none", '[{"file":"a.c"}]'), ("key", '[{"command":"c","x":"y"}]'), ("object", "{}")]
    good, bad = readers.parse_compile_db(spark.createDataFrame(texts, "path string, body string"))
    assert rows(good, "path", "command", "file") == [("ok", "cc", "a.c")]
    assert rows(bad, "path", "reason") == [
        ("cut", "NotAnArray"), ("key", "UnknownField"), ("none", "NoCommand"), ("number", "WrongFieldValueType"), ("object", "NotAnArray"),
    ]


ODD_ELEMENTS = ['{"command":"cc \\\\\\"}, {\\\\ ]","file":"a]}.c"}', '5', '"}"', '[{"x":{}}]', 'null', '{"command":"c","directory":{"a":[1,2]}}', '{"file":"only"}', '{"command":"é}\\\\\\\\","file":"b.c"}']


@pytest.mark.parametrize("split", ["64", "1000000"])
def test_a_file_of_any_size_gives_the_records_of_the_whole_text(spark, tmp_path, rows, hotness, split):
    rng = random.Random(5)
    texts = {}
    for name, joint in {"line": ",", "lines": ",\n", "wide": " ,\r\n\t"}.items():
        texts[name] = " [" + joint.join(rng.choice(ODD_ELEMENTS) for _ in range(120)) + "]\n"
    texts |= {"empty": "[]", "blank": " [ \n ] ", "cut": texts["lines"][:-3], "half": texts["line"][:1001], "object": '{"command":"cc"}', "open": '[{"command":"cc"}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    whole = spark.createDataFrame(list(texts.items()), "path string, body string")
    want_good, want_bad = readers.parse_compile_db(whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, bad = readers.read_compile_db(spark, str(tmp_path))
        name = F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("path")
        got_good, got_bad = rows(good.withColumn("path", name), *want_good.columns), rows(bad.select(name, "value", "reason"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got_good == rows(want_good)
    assert got_bad == rows(want_bad.withColumn("value", F.when(F.col("reason") != "NotAnArray", F.col("value"))))
    assert {r[0] for r in got_bad if r[2] == "NotAnArray"} == {"cut", "half", "object", "open"}
