from pyspark.sql import functions as F

from codestrata.operators import corpus as c
from codestrata.plans import jobs
from codestrata.sources import readers

C_FILE = """#include <stdio.h>
  # include "pool.h"
int main(void) {
  return run();
  const char *name = lookup(key, "a, b", 7, (x + 1));
  int n = count(name);
  return n;
}
"""
MUTANT_PARTS = [
    "struct _ONLY_FORVUL_ARG {\ntypeof(key) var_0;\n/* skip 1th \"a, b\" */\n/* skip 2th 7 */\ntypeof((x + 1)) var_3;\nconst char * name;\n};",
    'args->name = lookup(args->var_0, "a, b", 7, args->var_3);',
    "arg.var_0 = key;\narg.var_3 = (x + 1);",
    "pthread_detach(SPECIFIC_THREAD);",
]


def files(spark, data):
    return spark.createDataFrame(list(data.items()), "path string, text string")


def test_source_scan(spark, tmp_path, rows):
    for name in ["a.c", "sub/b.cc", "sub/deep/c.cu", "sub/d.h", "sub/my_test.c", "sub/Tests.cpp", "e.C", "f.hpp", "testdir/g.c++"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}\nint x;\n")
    found = readers.read_sources(spark, str(tmp_path))
    got = sorted(r.path.split(str(tmp_path) + "/")[1] for r in found.collect())
    assert got == ["a.c", "e.C", "sub/b.cc", "sub/deep/c.cu", "testdir/g.c++"]
    assert found.where(F.col("text").contains("\nint x;")).count() == 5  # whole files, not lines
    assert readers.read_sources(spark, str(tmp_path), skipped=[str(tmp_path)]).count() == 0
    listed = readers.list_files(spark, str(tmp_path))
    assert listed.count() == 9
    assert c.find_file(listed, "b.cc").first().path.endswith("/sub/b.cc")
    assert c.find_file(listed, "none").first().path is None


def test_includes(spark, rows):
    assert rows(c.includes(files(spark, {"a.c": C_FILE, "b.c": "int x;"}))) == [("a.c", "pool.h"), ("a.c", "stdio.h")]


def test_call_sites(spark, rows):
    got = rows(c.call_sites(files(spark, {"a.c": C_FILE})), "type", "id", "func", "args")
    assert got == [("const char *", "name", "lookup", 'key, "a, b", 7, (x + 1)'), ("int", "n", "count", "name")]
    last = "void f() {\n  int n = g();\n}\n"  # nothing follows, so there is no site
    assert c.first_call_site(files(spark, {"a.c": last})).count() == 0


def test_mutants(spark):
    cpp = "int f() {\n  auto v = make(a, 1);\n  use(v);\n}\n"
    data = {"a.c": C_FILE, "b.cpp": cpp, "c.py": cpp, "d.c": "int x;"}
    got = {r.path: (r.language, r.mutated) for r in c.inject_race(files(spark, data)).collect()}
    assert set(got) == {"a.c", "b.cpp"}
    language, text = got["a.c"]
    assert language == "C" and all(part in text for part in MUTANT_PARTS)
    assert "lookup(key" not in text and "  int n = count(name);\n  return n;" in text
    assert text.startswith(C_FILE[: C_FILE.index("const char")])
    assert got["b.cpp"][1] == (
        "int f() {\n  auto v;\nauto _DETACH_THREAD = std::thread([&]() {\nv = make(a, 1);\n});\n_DETACH_THREAD.detach();\n  use(v);\n}\n"
    )


def test_requests(spark, rows):
    asked = jobs.scan_requests(files(spark, {"a.c": "int x;", "a_test.c": "y", "b.h": "z"}))
    assert rows(asked, "path", "request") == [("a.c", "```C\nint x;\n```")]
    mutated = jobs.scan_requests(files(spark, {"a.c": C_FILE, "b.c": "int x;"}), mutate=True)
    assert [r.path for r in mutated.collect()] == ["a.c"]


def test_id_audit(spark, rows):
    good, bad = "d0cd8041-0504-40cb-ac8e-d05960d205ec", "d0cd8041-0504-40cb-ac8e_d05960d205ec"
    df = spark.createDataFrame([("g", good), ("g", bad), ("h", None)], "k string, id string")
    assert rows(c.id_audit(df, "id", ["k"])) == [("g", 1, 1), ("h", 0, 1)]


def test_analyzer_registry(spark, rows):
    jobs.register("paths", lambda df: df.select("path"))
    assert rows(jobs.analyze("paths", files(spark, {"a.c": ""}))) == [("a.c",)]
    try:
        jobs.analyze("unknown")
    except KeyError as e:
        assert "infer" in str(e) and "rwop" in str(e)
    cmds = spark.createDataFrame([("a.c", "cc -pthread")], "file string, command string")
    inc = spark.createDataFrame([("a.c", "x.h")], "file string, include string")
    assert rows(jobs.analyze("infer", cmds, inc)) == [("a.c", "flag")]


def test_call_sites_at_any_depth(spark, rows):
    text = '''// int no = comment(1); x
int a = f(g(h(i(j(1)))), k(2, (3)));
char *s = name("a;b)", ')'); /* int b = block(1); y */
int c = open_end(1;
int d = last(4);
}'''
    df = spark.createDataFrame([("a.c", text), ("b.c", None), ("c.c", "")], "path string, text string")
    got = c.call_sites(df).orderBy("pos").collect()
    assert [(r.type, r.id, r.func, r.args) for r in got] == [("int", "a", "f", "g(h(i(j(1)))), k(2, (3))"), ("char *", "s", "name", "\"a;b)\", ')'")]
    first = c.first_call_site(df).first()
    assert first.arguments == ["g(h(i(j(1))))", "k(2, (3))"]
    assert "int no = comment(1);" in c.inject_race(df).first().mutated


def test_the_site_itself_is_edited_not_an_equal_text_before_it(spark):
    text = "// int a = f(1); kept\nint a = f(1);\nint z;\n"
    got = c.inject_race(spark.createDataFrame([("a.cpp", text)], "path string, text string")).first().mutated
    assert got.startswith("// int a = f(1); kept\nint a;\n")
