"""Readers, writers and listings end to end: texts are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import corpus, findings as fnd, history, variables, symbols
from codestrata.plans import jobs
from codestrata.queries import Catalog, table
from codestrata.queries.corpus import _ir_listings, _symbol_dumps
from codestrata.session import work_path
from codestrata.sources import readers, writers

CATALOG = Catalog()
query = CATALOG.add


@query(
    """
    SELECT event_type AS msg, count(*) AS n, CAST(sum(epoch_ms(date_trunc('second', ts))) AS DOUBLE) AS times FROM events WHERE event_id % 7 <> 0 GROUP BY 1
    """
)
def findings_log(spark, d):
    """Events as a findings log: those with a diagnosis are written, read back and counted."""
    logged = table(spark, d, "events").select(
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("CWE-"), F.col("user_id").cast("string"))).alias("cweID"),
        F.lit("/data/micros/a/b.c").alias("fileName"),
        F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("time"),
        F.col("event_type").alias("msg"),
    )
    path = work_path(spark, "findings")
    writers.write_findings(logged, path)
    return readers.read_findings(spark, path).groupBy("msg").agg(F.count("cweID").alias("n"), F.sum("time").cast("double").alias("times"))


def _log_lines(spark, d):
    """One line in five is cut off, one in five is not an object."""
    line = F.concat(F.lit('{"cweID":"CWE-'), F.col("event_id").cast("string"), F.lit('","msg":"'), F.col("event_type"), F.lit('"'))
    kind = F.col("event_id") % 5
    whole = F.when(kind == 1, line).when(kind == 2, F.col("event_id").cast("string")).otherwise(F.concat(line, F.lit("}")))
    return table(spark, d, "events").select("event_id", whole.alias("value"))


@query("SELECT event_id, 'CWE-' || event_id AS \"cweID\", event_type AS msg FROM events WHERE event_id % 5 NOT IN (1, 2)")
def findings_parsed(spark, d):
    return readers.parse_findings(_log_lines(spark, d))[0].select("event_id", "cweID", "msg")


@query("SELECT event_id, 'malformed' AS reason FROM events WHERE event_id % 5 IN (1, 2)")
def findings_malformed(spark, d):
    return readers.parse_findings(_log_lines(spark, d))[1].select("event_id", "reason")


def _compile_dbs(spark, d):
    """A database for each order: whole, with a number as command, without a command, or cut off."""
    order = F.col("o_orderkey").cast("string")
    record = F.concat(F.lit('{"directory":"/b","file":"f'), order, F.lit('.c","command":'))
    text = F.concat(F.lit('"cc -c f'), order, F.lit('.c"}'))
    kind = F.col("o_orderkey") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("["), record, text, F.lit(","), record, F.lit("5}]")))
        .when(kind == 1, F.concat(F.lit("["), record, text, F.lit("]")))
        .when(kind == 2, F.concat(F.lit('[{"file":"f'), order, F.lit('.c"},'), record, text, F.lit("]")))
        .otherwise(F.concat(F.lit("["), record, text))
    )
    return table(spark, d, "orders").select(F.concat(F.lit("db"), order).alias("path"), body.alias("body"))


@query("SELECT 'db' || o_orderkey AS path, 'cc -c f' || o_orderkey || '.c' AS command, 'f' || o_orderkey || '.c' AS file FROM orders WHERE o_orderkey % 4 <> 3")
def compile_db(spark, d):
    return readers.parse_compile_db(_compile_dbs(spark, d))[0].select("path", "command", "file")


@query(
    """
    SELECT 'db' || o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'WrongFieldValueType' WHEN 2 THEN 'NoCommand' ELSE 'NotAnArray' END AS reason
    FROM orders WHERE o_orderkey % 4 <> 1
    """
)
def compile_db_rejected(spark, d):
    return readers.parse_compile_db(_compile_dbs(spark, d))[1].select("path", "reason")


@query(
    """
    SELECT o_orderpriority AS kind, 'f' || o_orderkey || '.c' AS file, 'cc "}{" -c f' || o_orderkey || '.c' AS command, '' AS reason
    FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderpriority <> '5-LOW'
    UNION ALL SELECT o_orderpriority, NULL, NULL, 'WrongFieldValueType' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority <> '5-LOW'
    UNION ALL SELECT DISTINCT o_orderpriority, NULL, NULL, 'NoCommand' FROM orders WHERE o_orderpriority <> '5-LOW'
    UNION ALL SELECT DISTINCT o_orderpriority, NULL, NULL, 'NotAnArray' FROM orders WHERE o_orderpriority = '5-LOW'
    """
)
def compile_db_files(spark, d):
    """One compile database for all orders of a priority, as a file that many tasks read; braces stand in its strings, and
    one file is never closed."""
    path = work_path(spark, "databases")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"))
    number = F.col("o_orderkey").cast("string")
    command = F.when(F.col("o_orderkey") % 3 == 0, "5").otherwise(F.concat(F.lit('"cc \\"}{\\" -c f'), number, F.lit('.c"')))
    records = orders.select("kind", "o_orderkey", F.concat(F.lit(',{"file":"f'), number, F.lit('.c","command":'), command, F.lit("}")).alias("line"))
    kinds = orders.select("kind").distinct()
    first = kinds.select("kind", F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit('[{"file":"none"}').alias("line"))
    last = kinds.where("kind <> '5-LOW'").select("kind", F.lit(2**62).alias("o_orderkey"), F.lit("]").alias("line"))
    lines = records.union(first).union(last).repartition("kind").sortWithinPartitions("kind", "o_orderkey")
    lines.select("kind", "line").write.partitionBy("kind").text(path)
    good, bad = readers.read_compile_db(spark, path)
    kind = F.url_decode(F.regexp_extract("path", "kind=([^/]+)/", 1)).alias("kind")
    nothing = F.lit(None).cast("string")
    return good.select(kind, "file", "command", F.lit("").alias("reason")).union(bad.select(kind, nothing.alias("file"), nothing.alias("command"), "reason"))


@query(
    """
    SELECT 'conv' || conv_id AS module, CAST(sum(6 + CAST(role = 'user' AS INT) + CAST(length(text) > 100 AS INT)
           + CAST(turn > 0 AS INT) + CASE WHEN turn = 0 THEN 2 ELSE 0 END) AS BIGINT) AS lines
    FROM conversations GROUP BY 1
    """
)
def ir_lines_read(spark, d):
    """IR listings written as one file for each module and read back with line numbers."""
    path = work_path(spark, "listings")
    lines = _ir_listings(spark, d).repartition("module").sortWithinPartitions("module", "line_no")
    lines.select("module", "line").write.partitionBy("module").text(path)
    read = readers.read_ir_listings(spark, path)
    module = F.regexp_extract("module", "module=([^/]+)/", 1)
    return read.groupBy(module.alias("module")).agg((F.max("line_no") + 1).alias("lines"))


@query(
    """
    SELECT 'lib' || s_suppkey || '.so' AS library, count(l_partkey) FILTER (WHERE s_acctbal >= 0) AS symbols,
           CAST(sum(l_partkey) FILTER (WHERE s_acctbal >= 0) AS BIGINT) AS size, CASE WHEN s_acctbal < 0 THEN 'io_error' END AS error
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal
    """
)
def symbol_files(spark, d):
    """A symbol listing in a file for each supplier, read back and parsed; those in debt have a blank one."""
    path = work_path(spark, "symbols")
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("blank"))
    titles = owners.select("l_suppkey", F.lit(-1).cast("bigint").alias("n"), F.when(F.col("blank"), "").otherwise("Symbol table '.symtab'").alias("line"))
    number = F.concat_ws("_", "l_orderkey", "l_linenumber")
    line = F.concat_ws(" ", F.lit("   1:"), F.lpad(F.hex("l_orderkey"), 16, "0"), F.col("l_partkey"), F.lit("FUNC GLOBAL DEFAULT 7"), F.concat(F.lit("order_"), number))
    items = table(spark, d, "lineitem").join(owners.where(~F.col("blank")), "l_suppkey").select("l_suppkey", F.col("l_orderkey").alias("n"), line.alias("line"))
    lines = titles.union(items).withColumn("library", F.concat(F.lit("lib"), "l_suppkey", F.lit(".so")))
    lines.repartition("library").sortWithinPartitions("library", "n").select("library", "line").write.partitionBy("library").text(path)
    listings, empty = readers.read_symbol_dumps(spark, path)
    sizes = symbols.parse_symbols(listings).groupBy("library").agg(F.count(F.lit(1)).alias("symbols"), F.sum("size").cast("bigint").alias("size"))
    found = symbols.libraries(listings).select("library").join(sizes, "library", "left")
    found = found.select("library", F.coalesce("symbols", F.lit(0)).alias("symbols"), "size", F.lit(None).cast("string").alias("error"))
    both = found.union(empty.select("path", F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), "error"))
    return both.withColumn("library", F.regexp_extract("library", "library=([^/]+)/", 1))


@query("""SELECT '{"file":' || to_json(source) || ',"report":{"n":' || count(*) || '}}' AS value FROM documents GROUP BY source""")
def report_lines(spark, d):
    counted = table(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return writers.report_lines(counted.select("file", F.to_json(F.struct("n")).alias("report")))


@query("SELECT page_id FROM pages WHERE page_id % 2 = 0")
def skipped_roots(spark, d):
    """Pages as source files under two roots, one of them on the skip list."""
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("/r/"), F.col("page_id").cast("string"), F.lit(".c")).alias("path"))
    even = files.where(F.col("page_id") % 2 == 0)
    odd = files.where(F.col("page_id") % 2 != 0)
    kept = [corpus.scan_sources(part, "path", ["/odd"], root) for part, root in ((even, "/even"), (odd, "/odd"))]
    return kept[0].unionByName(kept[1]).select("page_id")


@query("SELECT o_orderkey AS oid, c_name AS tree FROM orders JOIN customer ON o_custkey = c_custkey")
def commit_tree(spark, d):
    """Each commit (order) with its root tree (customer)."""
    commits = table(spark, d, "orders").select(F.lit("r").alias("repo"), F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("tree_oid"))
    trees = table(spark, d, "customer").select(F.lit("r").alias("repo"), F.col("c_custkey").alias("tree_oid"), F.col("c_name").alias("tree"))
    return history.commit_trees(commits, trees).select("oid", "tree")


def _symbols(spark, d, new: bool):
    """Each library as its order's rows; the new version has larger parts, fewer rows, and rows of the old one's absence."""
    items = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    rows = items.where(flag != "N" if new else flag != "R").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity")
    )
    size = F.col("l_partkey") + F.when(F.lit(new) & (F.col("l_quantity") > 25), 1).otherwise(0)
    line = F.concat_ws(
        " ", F.concat(F.col("l_linenumber").cast("string"), F.lit(":")), F.lpad(F.hex("l_orderkey"), 16, "0"), size.cast("string"), F.lit("FUNC GLOBAL DEFAULT 7"),
        F.concat(F.lit("part_"), F.col("l_linenumber").cast("string")),
    )
    body = F.concat(F.lit("Symbol table '.symtab'\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    side = "/new/lib" if new else "/old/lib"
    return rows.groupBy("l_orderkey").agg(body.alias("body")).select(F.concat(F.lit(side), F.col("l_orderkey").cast("string"), F.lit(".so")).alias("path"), "body")


@query(
    """
    WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS size FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
         w AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) + CAST(max(l_quantity) > 25 AS INT) AS size FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
    SELECT 'lib' || coalesce(o.k, w.k) || '.so' AS library, 'part_' || coalesce(o.n, w.n) AS name,
           CASE WHEN o.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' WHEN o.size = w.size THEN 'common' ELSE 'modified' END AS change,
           coalesce(w.size, o.size) AS size
    FROM o FULL JOIN w ON o.k = w.k AND o.n = w.n
    """
)
def library_changes(spark, d):
    """Symbol names are the same in all libraries: only the library tells them apart."""
    changes = jobs.compare_libraries(_symbols(spark, d, False), _symbols(spark, d, True))
    return changes.select("library", "name", "change", F.col("size").cast("bigint").alias("size"))


def _debug_listings(spark, d, new: bool):
    """A module for each conversation, a function for each turn with one variable bound to a value that two
    instructions use; in the new version every third turn multiplies by another type, every fifth uses it once more, and
    of those the even ones twice, by an equal operation."""
    turn = F.col("turn").cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    changed, more = F.lit(new) & (F.col("turn") % 3 == 0), F.lit(new) & (F.col("turn") % 5 == 1)
    lines = F.array_compact(
        F.array(
            text("define i32 @turn_", turn, "(i32 %size) {"),
            F.lit("  %7 = add i64 %6, 1"),
            text("    #dbg_value(i64 %7, !", turn, ", !DIExpression(), !900)"),
            F.when(changed, "  %8 = mul i32 %7, 3").otherwise("  %8 = mul i64 %7, 3"),
            F.when(more, "  %9 = urem i64 %7, 5"),
            F.when(more & (F.col("turn") % 2 == 0), "  %10 = urem i64 %7, 9"),
            F.lit("  ret i32 0"),
            F.lit("}"),
            text("!", turn, ' = !DILocalVariable(name: "', F.col("role"), '", scope: !800)'),
        )
    )
    return (
        table(spark, d, "conversations")
        .select(text("conv", F.col("conv_id").cast("string")).alias("module"), "turn", F.posexplode(lines).alias("i", "line"))
        .select("module", (F.col("turn") * 16 + F.col("i")).alias("line_no"), "line")
    )


@query(
    """
    SELECT 'conv' || conv_id AS module, 'turn_' || turn AS function, role AS var,
           CAST(1 + CAST(turn % 5 = 1 AS INT) + CAST(turn % 10 = 6 AS INT) AS BIGINT) AS uses FROM conversations
    UNION ALL SELECT 'conv' || conv_id, 'turn_' || turn, 'size', 0 FROM conversations
    """
)
def ir_variable_uses(spark, d):
    """Variables named by debug records, with the number of instructions that use their value."""
    names, uses = variables.variable_map(jobs.scoped_lines(_debug_listings(spark, d, True)))
    return variables.use_counts(names, uses, ["module", "function", "var"])


@query(
    """
    SELECT 'conv' || conv_id AS module, 'turn_' || turn AS function, role AS var, change, sha256(f.op) AS op,
           CAST(CASE WHEN f.op LIKE 'urem%' AND turn % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS uses
    FROM conversations, (VALUES ('added', 'mul i32 _, _'), ('removed', 'mul i64 _, _'), ('added', 'urem i64 _, _')) AS f(change, op)
    WHERE CASE WHEN f.op LIKE 'mul%' THEN turn % 3 = 0 ELSE turn % 5 = 1 END
    """
)
def ir_variable_changes(spark, d):
    """Uses of operations, by fingerprint, that one of two versions has more of; names and turns repeat in many modules."""
    changes = jobs.variable_changes(_debug_listings(spark, d, False), _debug_listings(spark, d, True))
    return changes.counted.select("module", "function", "var", "change", "op", F.col("n").alias("uses"))


@query("SELECT count(*) AS added FROM conversations WHERE role = 'user' AND (turn % 3 = 0 OR turn % 5 = 1)")
def added_to_variable(spark, d):
    """Functions in which an operation was added to the variable ``user``."""
    diff = jobs.variable_changes(_debug_listings(spark, d, False), _debug_listings(spark, d, True)).diff
    owners = variables.changed_names(diff.where(F.col("change") == "added"), ["module", "function", "var"])
    wanted = variables.adds(diff, "user").select(F.lit("user").alias("var")).distinct()
    return fnd.height(owners.join(wanted, "var", "left_semi"), "added")


@query(
    """
    WITH u AS (
      SELECT conv_id, 'turn_' || turn AS function, 'size' AS var, 0 AS r, 1 AS w FROM conversations
      UNION ALL SELECT conv_id, 'turn_' || turn, role, 0, 0 FROM conversations
      UNION ALL SELECT conv_id, NULL, 'total', CAST(role = 'user' AS INT), CAST(length(text) > 100 AS INT) FROM conversations)
    SELECT 'conv' || conv_id AS module, function, var, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(w) AS BIGINT) AS writes FROM u GROUP BY ALL
    """
)
def ir_rw_table(spark, d):
    """Reads and writes of all variables, also of those never used."""
    return jobs.rw_table(jobs.scoped_lines(_ir_listings(spark, d)))


@query("SELECT page_id, CAST(length(url) AS INTEGER) AS value FROM pages")
def each_entry(spark, d):
    entries = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return jobs.each_entry(entries, lambda df: F.length(df["path"])).select("page_id", "value")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def registered_analyzer(spark, d):
    """A caller's analyzer run by name."""
    jobs.register("per user", lambda df, by: fnd.id_counts(df, by, "n"))
    return jobs.analyze("per user", table(spark, d, "events"), by="user_id")
