import json

from pyspark.sql import functions as F

from codestrata.functions import text as t
from codestrata.operators import findings as f
from codestrata.plans.jobs import dashboard
from codestrata.sources import readers, writers

LOG = [
    {"cweID": "<CWE-ID>CWE-362", "fileName": "/x/micros/alpha/src/a.c", "codeWithIssue": "x", "time": 5, "extra": 1},
    {"cweID": "CWE-362 and CWE-667", "fileName": "micros/alpha/b.c", "time": 6},
    {"cweID": "CWE-667", "fileName": "micros/beta/b.c"},
    {"cweID": "CWE-1", "fileName": "elsewhere/c.c"},
    {"cweID": "", "fileName": "micros/beta/empty.c"},
    {"cweID": "none found", "fileName": "micros/beta/d.c"},
    {"cweID": None, "fileName": "micros/beta/e.c"},
    {"fileName": "micros/beta/f.c", "level": 3},
]


def log_dir(tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    lines = [json.dumps(r) for r in LOG] + ["{not json"]
    (path / "a.log").write_text("\n".join(lines) + "\n")
    return str(path)


def test_fixed_schema_and_malformed_line(spark, tmp_path):
    df = readers.read_findings(spark, log_dir(tmp_path))
    assert df.columns == ["cweID", "fileName", "codeWithIssue", "time", "content", "msg", "path", "level", "hostname", "pir"]
    assert df.count() == len(LOG) + 1
    assert readers.read_findings(spark, log_dir_again(tmp_path), "DROPMALFORMED").count() == len(LOG)


def log_dir_again(tmp_path):
    return str(tmp_path / "log")


def test_key_present_keeps_null_values(spark, tmp_path, rows):
    df = readers.read_with_key(spark, log_dir(tmp_path))
    assert df.columns == ["fileName", "codeWithIssue", "cweID"]
    assert df.count() == 7
    assert df.where(F.col("cweID").isNull()).count() == 1


def test_dashboard(spark, tmp_path, rows):
    board = dashboard(readers.read_findings(spark, log_dir(tmp_path)))
    assert rows(board.ratio, "hits", "total") == [(4, 6)]
    assert rows(board.counts) == [
        (None, "CWE-1", 1), ("alpha", "CWE-362", 2), ("beta", "CWE-667", 1),
    ]
    assert board.pivot.columns == ["cwe_id", "alpha", "beta", "null"]
    assert rows(board.pivot) == [("CWE-1", 0, 0, 1), ("CWE-362", 2, 0, 0), ("CWE-667", 0, 1, 0)]
    assert board.table.count() == 6
    lazy = dashboard(readers.read_findings(spark, log_dir_again(tmp_path)), ["alpha", "beta"])
    assert rows(lazy.pivot, "cwe_id", "alpha", "beta") == [("CWE-1", 0, 0), ("CWE-362", 2, 0), ("CWE-667", 0, 1)]
    one = dashboard(readers.read_findings(spark, log_dir_again(tmp_path)), ["alpha"]).pivot
    assert one.columns == ["cwe_id", "alpha", "null", "other"]
    assert rows(one) == [("CWE-1", 0, 1, 0), ("CWE-362", 2, 0, 0), ("CWE-667", 0, 0, 1)]


def test_series_and_stack(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "x")], "repo string, id string")
    wide = f.pivot_counts(df, "id", "repo")
    assert rows(f.chart_series(wide, "id")) == [("a", ["x", "y"], [2, 0]), ("b", ["x", "y"], [1, 1])]
    stacked = f.stack_offsets(f.value_counts(df, ["repo"], "id"), "id", "repo")
    assert rows(stacked, "id", "repo", "occurrences", "base") == [("x", "a", 2, 0), ("x", "b", 1, 2), ("y", "b", 1, 0)]


def test_nested_counts_round_trip(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "b"), ("c", None)], "g string, v string")
    nested = f.value_counts_nested(df, ["g"], "v", "n")
    assert {r.g: [tuple(e) for e in r.n] for r in nested.collect()} == {
        "a": [("y", 2), ("b", 1), ("x", 1)], "c": [(None, 1)],
    }
    assert rows(f.unnest(nested, "n")) == rows(f.value_counts(df, ["g"], "v", "n"))


def test_extract_is_null_without_match(spark, rows):
    df = spark.createDataFrame([("micros/r/x",), ("micros/r",), ("y",), (None,)], "p string")
    assert rows(df.select("p", t.extract_segment(F.col("p")))) == [
        (None, None), ("micros/r", None), ("micros/r/x", "r"), ("y", None),
    ]
    ids = spark.createDataFrame([("CWE-12 x",), ("CWE-",), ("CWE-99999999999999999999",)], "c string")
    assert [r[0] for r in ids.select(t.extract_number(F.col("c"))).collect()] == [12, None, None]


def test_tagged_blocks_and_cleaning(spark, rows):
    code = "<codesContainsIssue>```cpp\n\nint x;\n```</codesContainsIssue>"
    df = spark.createDataFrame(
        [(1, code + "<CWE-ID>CWE-1</CWE-ID>"), (2, code), (3, "<CWE-ID>CWE-1</CWE-ID>"), (4, code + "<CWE-ID></CWE-ID>"),
         (5, "<codesContainsIssue><codesContainsIssue>a</codesContainsIssue>b</codesContainsIssue><CWE-ID>z</CWE-ID>")],
        "n int, response string",
    )
    got = {r.n: (r.codeWithIssue, r.cweID) for r in f.diagnoses(df).collect()}
    assert got[1] == ("```cpp\n\nint x;\n```", "CWE-1")
    assert got[2] == got[3] == got[4] == ("", "")
    assert got[5] == ("<codesContainsIssue>a", "z")
    kept = f.tagged_blocks(df, "response", {"codeWithIssue": "codesContainsIssue", "cweID": "CWE-ID"}, keep_tag=True)
    assert kept.where("n = 1").first().cweID == "<CWE-ID>CWE-1"
    shown = f.display_columns(kept).where("n = 1").first()
    assert (shown.codeWithIssue, shown.cweID) == ("int x;", "CWE-1")


def test_verdicts(spark, rows):
    df = spark.createDataFrame([(1, "YES"), (2, " NO\n"), (3, "maybe"), (4, None), (5, "YES ")], "n int, flag string")
    good, rejected = f.validated_flag(df, "flag")
    assert rows(f.verdict_tally(good, "flag")) == [("NO", 1), ("YES", 2)]
    assert rows(rejected, "n") == [(3,), (4,)]


def test_adjudicated_ratio(spark, rows):
    found = spark.createDataFrame([("r", "CWE-1"), ("r", "CWE-2"), ("s", "CWE-3")], "repo string, cwe_id string")
    said = spark.createDataFrame([("CWE-1", "YES"), ("CWE-2", "NO")], "cwe_id string, verdict string")
    judged = f.adjudicate(found, said, ["cwe_id"])
    assert rows(f.real_ratio(judged, ["repo"], F.col("verdict") == "YES")) == [("r", 2, 1, 0.5), ("s", 1, 0, 0.0)]
    assert f.hit_ratio(found.limit(0), F.lit(True)).first().ratio is None


def test_findings_sink_drops_missing_diagnoses(spark, tmp_path):
    df = spark.createDataFrame([("CWE-1", "a.c"), (None, "b.c")], "cweID string, fileName string")
    out = str(tmp_path / "out")
    writers.write_findings(df, out)
    assert [r.fileName for r in readers.read_findings(spark, out).collect()] == ["a.c"]


def test_report_lines_are_valid_json(spark, tmp_path):
    df = spark.createDataFrame([('a "b".ll', '{"global_var":{"v":{"read":["v"],"write":[]}},"function_var":{}}')], "file string, report string")
    out = str(tmp_path / "reports")
    writers.write_reports(df, out)
    line = json.loads(spark.read.text(out).first().value)
    assert line["file"] == 'a "b".ll' and line["report"]["global_var"]["v"]["read"] == ["v"]


def test_rejected_lines_are_returned(spark, rows):
    df = spark.createDataFrame([(1, '{"cweID":"CWE-1","time":5,"extra":1}'), (2, '{"cweID":'), (3, "[1]"), (4, "  "), (5, None), (6, '{"cweID":null}')], "n int, value string")
    good, bad = readers.parse_findings(df)
    assert rows(good, "n", "cweID", "time") == [(1, "CWE-1", 5), (6, None, None)]
    assert rows(bad, "n", "reason") == [(2, "malformed"), (3, "malformed")]


def test_sketches_merge_over_days_groups_and_batches(spark, tmp_path, rows):
    days = f.DistinctTable(spark, str(tmp_path / "days"), ["kind"])
    seen = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 30).alias("day"), (F.col("id") % 1500).alias("who"))
    seen = seen.union(spark.createDataFrame([(None, 1, 7), ("a", 1, None)], "kind string, day long, who long"))
    days.add(seen.where("day < 20"), "who")
    days.add(seen.where("day >= 10"), "who")
    one = days.compact(str(tmp_path / "one"))
    assert one.read().count() == seen.select("kind", "day").distinct().count() < days.read().count()
    for table in (days, one):
        for got, want in (
            (table.count(), seen.groupBy("kind")),
            (table.count(by=[], period=F.floor(F.col("day") / 7)), seen.groupBy(F.floor(F.col("day") / 7).alias("period"))),
            (table.count(within=F.col("day") < 3), seen.where("day < 3").groupBy("kind")),
        ):
            got, want = rows(got), rows(want.agg(F.count_distinct("who").alias("ids")))
            assert [r[:-1] for r in got] == [r[:-1] for r in want]
            assert all(abs(a[-1] - b[-1]) <= 0.04 * b[-1] for a, b in zip(got, want))
