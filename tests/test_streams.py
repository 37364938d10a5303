import json

from pyspark.sql import functions as F

from codestrata.sources import readers, writers
from codestrata.streaming import logs


def write_log(path, first, last, step=60_000):
    ids = ["CWE-362", "<CWE-ID>CWE-667", "", "nothing"]
    with open(path, "w") as out:
        for i in range(first, last):
            row = {"cweID": ids[i % 4], "fileName": f"/d/micros/r{i % 3}/a.c", "time": i * step}
            out.write(json.dumps(row) + "\n")


def test_batch_and_stream_agree_over_two_runs(spark, tmp_path, rows):
    log, table, marks = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "marks")
    log.mkdir()
    for n in range(2):
        write_log(log / f"{n}.json", n * 200, (n + 1) * 200)
        stream = logs.finding_counts(readers.stream_findings(spark, str(log), max_files=1))
        logs.drain_to_table(stream, table, marks).awaitTermination()
        batch = logs.finding_counts(readers.read_findings(spark, str(log)))
        assert rows(logs.read_drained(spark, table, ["repo", "cwe_id"]), "repo", "cwe_id", "cwe_id_occur") == rows(batch)
    assert batch.count() == 6


def test_windowed_counts(spark, tmp_path, rows):
    log, table = tmp_path / "log", str(tmp_path / "table")
    log.mkdir()
    write_log(log / "0.json", 0, 200)
    stream = logs.windowed_counts(readers.stream_findings(spark, str(log)), "1 hour")
    logs.drain_to_table(stream, table).awaitTermination()
    got = logs.read_drained(spark, table, ["window", "repo", "cwe_id"])
    batch = logs.windowed_counts(readers.read_findings(spark, str(log)), "1 hour")
    pick = [F.col("window.start").alias("s"), "repo", "cwe_id", "cwe_id_occur"]
    assert rows(got.select(pick)) == rows(batch.select(pick))
    assert got.select("window").distinct().count() == 4


def test_late_rows_are_counted_apart(spark, tmp_path, rows):
    log, path, marks = tmp_path / "log", str(tmp_path / "t"), str(tmp_path / "marks")
    log.mkdir()
    late = [0, 0, 60, 0]  # rows of each delivery whose hour closed before
    for n, (first, last) in enumerate([(0, 60), (60, 400), (0, 120), (400, 460)]):
        write_log(log / f"{n}.json", first, last)
        logs.drain_windows(readers.stream_findings(spark, str(log)), path, "1 hour", "1 hour", marks).awaitTermination()
        got = logs.read_windows(spark, path, "1 hour")
        batch = logs.windowed_counts(readers.read_findings(spark, str(log)), "1 hour")
        pick = [F.col("window.start").alias("s"), "repo", "cwe_id"]
        assert rows(got.select(*pick, (F.col("cwe_id_occur") + F.col("late_occur")).alias("n"))) == rows(batch.select(*pick, F.col("cwe_id_occur").alias("n")))
        assert got.agg(F.sum("late_occur")).first()[0] == sum(late[: n + 1])
    assert {(r.s.hour, r.closed) for r in got.select(F.col("window.start").alias("s"), "closed").collect()} == {(h, h < 6) for h in range(8)}
    assert rows(got.where("closed").select(*pick, "cwe_id_occur")) == rows(
        logs.windowed_counts(readers.read_findings(spark, [str(log / "0.json"), str(log / "1.json"), str(log / "3.json")]), "1 hour").where("window.end <= timestamp'1970-01-01 06:00:00'").select(*pick, "cwe_id_occur")
    )


def test_a_batch_tried_again_finds_the_same_clock(spark, tmp_path, rows):
    log, path = tmp_path / "log", str(tmp_path / "t")
    log.mkdir()
    write_log(log / "0.json", 0, 200)
    for marks in ("first", "again"):  # a lost checkpoint repeats batch 0
        logs.drain_windows(readers.stream_findings(spark, str(log)), path, "1 hour", "1 hour", str(tmp_path / marks)).awaitTermination()
        assert logs.read_windows(spark, path, "1 hour").agg(F.sum("cwe_id_occur"), F.sum("late_occur")).first() == (100, 0)


EVENTS = [("a", 0, "Init"), ("a", 1, "OpeningFile"), ("a", 2, "Done"), ("b", 0, "Init"), ("b", 1, "EncounterError"), ("b", 2, "AnalyzingFile"), ("c", 0, "Init")]


def test_run_status(spark, tmp_path, rows):
    want = [("a", "Done", 3, False), ("b", "AnalyzingFile", 3, True), ("c", "Init", 1, False)]
    df = spark.createDataFrame(EVENTS, "run string, seq bigint, kind string")
    assert rows(logs.run_status(df)) == want
    src, table = str(tmp_path / "events"), str(tmp_path / "table")
    df.repartition(3).write.json(src)
    stream = spark.readStream.schema(df.schema).json(src)
    logs.drain_to_table(logs.run_status(stream), table).awaitTermination()
    assert rows(logs.read_drained(spark, table, ["run"]), "run", "status", "events", "failed") == want


def test_record_stream_equals_batch(spark, tmp_path, rows):
    records = ['{"command":"cc","file":"a.c"}', '{"command":1}', '{"x":"y"}', "[]", "{", '{"command":null}']
    src = tmp_path / "records"
    src.mkdir()
    (src / "r.txt").write_text("\n".join(records))
    out = str(tmp_path / "out")
    stream = logs.validate_stream(spark.readStream.text(str(src)))
    writers.append_stream(stream, out, "parquet").awaitTermination()
    batch = logs.check_records(spark.read.text(str(src)))
    assert rows(spark.read.parquet(out), "value", "reason") == rows(batch)
    assert {r.value: r.reason for r in batch.collect()} == {
        records[0]: None, records[1]: "WrongFieldValueType", records[2]: "UnknownField",
        records[3]: "NoCommand", records[4]: "NoCommand", records[5]: "WrongFieldValueType",
    }


def test_findings_sink_as_stream(spark, tmp_path, rows):
    log, out = tmp_path / "log", str(tmp_path / "copy")
    log.mkdir()
    write_log(log / "0.json", 0, 40)
    writers.append_stream(readers.stream_findings(spark, str(log)), out).awaitTermination()
    assert rows(logs.finding_counts(readers.read_findings(spark, out))) == rows(logs.finding_counts(readers.read_findings(spark, str(log))))


def test_rows_without_a_time_are_counted_apart(spark):
    df = spark.createDataFrame([("CWE-1", "/micros/a/x.c", 5), ("CWE-1", "/micros/a/x.c", None)], "cweID string, fileName string, time bigint")
    assert [r.cwe_id_occur for r in logs.windowed_counts(df, "1 hour").collect()] == [1]
    assert [r.cwe_id_occur for r in logs.untimed_counts(df).collect()] == [1]


def test_a_batch_tried_again_changes_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    for batch, value in ((0, 1), (0, 1), (1, 5)):
        spark.createDataFrame([("a", value), (f"b{batch}", 2)], "k string, n int").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    assert rows(logs.read_drained(spark, path, ["k"])) == [("a", 5), ("b0", 2), ("b1", 2)]


def test_file_and_folder_tables_stream(spark, tmp_path):
    from codestrata.queries.streams import _event_stream

    df = spark.range(10).selectExpr("id AS event_id")
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for kind in ("folder", "file"):
        out = str(tmp_path / f"out-{kind}")
        writers.append_stream(_event_stream(spark, str(tmp_path / kind)), out, "parquet").awaitTermination()
        assert spark.read.parquet(out).count() == 10
