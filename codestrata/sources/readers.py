"""Readers for findings logs, compile databases, listings and source trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codestrata.operators.commands import COMMAND_FIELDS, validate_records
from codestrata.operators.corpus import scan_sources
from codestrata.operators.ordered import running_totals, with_position
from codestrata.operators.skew import salted_join
from codestrata.session import stored

# The log's field names and types.
FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField("cweID", T.StringType()),
        T.StructField("fileName", T.StringType()),
        T.StructField("codeWithIssue", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("level", T.LongType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("pir", T.LongType()),
    ]
)


def read_findings(spark: SparkSession, path, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON lines with the fixed schema; unknown keys are ignored, missing ones are null."""
    return spark.read.schema(FINDINGS_SCHEMA).option("mode", mode).json(path)


def parse_findings(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(findings, rejected lines with ``reason``) of a text column; other columns stay, blank lines are left out.

    Damaged JSON, and JSON that is no object, is rejected as ``malformed``.
    """
    rest = [c for c in lines.columns if c != column]
    written = lines.where(F.col(column).rlike(r"\S"))
    fine = F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False))
    good = written.where(fine).withColumn("_f", F.from_json(column, FINDINGS_SCHEMA)).select(*rest, "_f.*")
    return good, written.where(~fine).withColumn("reason", F.lit("malformed"))


def stream_findings(spark: SparkSession, path: str, max_files: int | None = 1000) -> DataFrame:
    """The same log as an append stream of files, ``max_files`` to a batch (None: all there are)."""
    files = spark.readStream.schema(FINDINGS_SCHEMA)
    return (files.option("maxFilesPerTrigger", max_files) if max_files else files).json(path)


def keep_with_key(lines: DataFrame, key: str, schema: str, column: str = "value") -> DataFrame:
    """Parse the JSON objects that have ``key`` (its value may be null)."""
    return (
        lines.where(F.array_contains(F.json_object_keys(column), key))
        .withColumn("_j", F.from_json(column, schema))
        .select(*[c for c in lines.columns if c != column], "_j.*")
    )


def read_with_key(spark: SparkSession, path, key: str = "cweID", columns: Sequence[str] = ("fileName", "codeWithIssue", "cweID")) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return keep_with_key(spark.read.text(path), key, schema)


def read_compile_db(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(records, rejected elements) of compile databases, a JSON array in each file, as `parse_compile_db` gives them.

    A file of any size is read by many tasks: it falls into pieces that end with a closing brace, whatever
    its lines. A piece alone shows how many quotes it holds and, for each of the two states in which it may begin
    (inside a string or not), how far its brackets go up or down. Running sums of the quotes, then of the
    brackets, give each piece its true state; where the depth falls to the array's, an element ends. Only
    an element's pieces meet in a row. A file that is not a closed array is rejected as a whole (``NotAnArray``,
    with a null value), a damaged element alone.
    """
    text = spark.read.option("lineSep", "}").text(path)
    clean = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')

    def rise(odd: int):
        """How far the brackets between the even, or the odd, quotes go up."""
        outside = F.array_join(F.filter(clean, lambda _, i: i % 2 == odd), "")
        return F.char_length(F.regexp_replace(outside, r"[^\[{]", "")) - F.char_length(F.regexp_replace(outside, r"[^\]}]", ""))

    pieces = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
        (F.size(clean) - 1).cast("bigint").alias("quotes"),
        F.array(rise(0), rise(1)).alias("rise"),
    )
    place, split = ["split", "seq"], F.col("split")
    pieces = running_totals(pieces, ["path"], place, {"before": F.col("quotes")}, split)
    # Brackets in a piece that begins inside a string are those after its odd quotes; so is the brace that ends it.
    pieces = pieces.withColumn("up", F.get("rise", (F.col("before") % 2).cast("int")))
    brace = (F.col("before") + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("step", F.col("up") - F.when(brace, 1).otherwise(0))
    pieces = running_totals(pieces, ["path"], place, {"depth": F.col("step")}, split)
    pieces = pieces.withColumn("ends", brace & (F.col("depth") + F.col("up") == 2))
    pieces = running_totals(pieces, ["path"], place, {"element": F.col("ends").cast("bigint")}, split)
    pieces = stored(pieces.select("path", *place, "value", "quotes", "step", "ends", "element"), "pieces")

    # The last piece of an array is followed by no brace: one that is counted there leaves the sum at -1.
    files = pieces.groupBy("path").agg(
        F.sum("step").alias("sum"), F.sum("quotes").alias("quotes"), F.min_by(F.regexp_extract("value", r"^\s*(.)", 1), F.struct(*place)).alias("first")
    )
    broken = files.where((F.col("sum") != -1) | (F.col("quotes") % 2 != 0) | (F.col("first") != "[")).select("path")
    gathered = pieces.groupBy("path", "element").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, "value"))), lambda p: p["value"]), "}").alias("text"), F.bool_or("ends").alias("whole")
    )
    text = F.when(F.col("whole"), F.concat("text", F.lit("}"))).otherwise(F.regexp_replace("text", r"\]\s*$", ""))
    text = F.when(F.col("element") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    gathered = gathered.withColumn("text", text).where(F.col("text").rlike(r"\S"))
    gathered = salted_join(gathered, broken, ["path"], "left_anti")
    values = F.coalesce(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.array("text"))
    good, bad = _commands(gathered.select("path", F.explode(values).alias("value")))
    return good, bad.unionByName(broken.select("path", F.lit(None).cast("string").alias("value"), F.lit("NotAnArray").alias("reason")))


def _commands(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected ones with ``path``, ``value`` and ``reason``) of array elements (path, value)."""
    good, bad = validate_records(elements)
    nameless = good.where(F.col("command").isNull()).select(
        "path", F.to_json(F.struct(*COMMAND_FIELDS)).alias("value"), F.lit("NoCommand").alias("reason")
    )
    return good.where(F.col("command").isNotNull()), bad.select("path", "value", "reason").unionByName(nameless)


def parse_compile_db(texts: DataFrame, path: str = "path", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(records, rejected elements with ``path``, ``value`` and ``reason``) of databases held as texts.

    A text that is not a JSON array is rejected whole as ``NotAnArray``; an element without a command as
    ``NoCommand``, others by the strict check of records.
    """
    fine = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("ARRAY"), F.lit(False))
    elements = texts.where(fine).select(F.col(path).alias("path"), F.explode(F.from_json(body, "array<string>")).alias("value"))
    good, bad = _commands(elements)
    whole = texts.where(~fine).select(F.col(path).alias("path"), F.col(body).alias("value"), F.lit("NotAnArray").alias("reason"))
    return good, bad.unionByName(whole)


def read_compile_records(spark: SparkSession, path) -> DataFrame:
    """Array elements as JSON text (path, value), for strict validation."""
    whole = _whole_text(spark, path)
    return whole.select("path", F.explode(F.from_json("body", "array<string>")).alias("value"))


def _whole_text(spark: SparkSession, path, **options) -> DataFrame:
    whole = spark.read.options(**options).text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_symbol_dumps(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(listings, empty listings with an error); a missing path fails when the plan is built."""
    whole = _whole_text(spark, path)
    empty = ~F.col("body").rlike(r"\S")
    return whole.where(~empty), whole.where(empty).select("path", F.lit("io_error").alias("error"))


def read_ir_listings(spark: SparkSession, path, line_numbers: bool = True) -> DataFrame:
    """Lines of IR listings: module, line_no, line. A file may be read by many tasks.

    Lines are ordered by split start and by their place in the split; that order is turned
    into line numbers per file without gathering the file in one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("module"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    if not line_numbers:
        return lines
    numbered = with_position(lines, ["module"], ["split", "seq"], "line_no", chunk=F.col("split"))
    return numbered.drop("split", "seq")


def listing_lines(texts: DataFrame, module: str = "module", body: str = "body") -> DataFrame:
    """Listings already held as one text per row."""
    return texts.select(
        F.col(module).alias("module"), F.posexplode(F.split(body, "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths and lengths below a root; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def read_sources(spark: SparkSession, root: str, skipped: Sequence[str] = ()) -> DataFrame:
    """Source files below a root: path, text. A skipped root gives no rows."""
    files = _whole_text(spark, root, recursiveFileLookup=True).withColumnRenamed("body", "text")
    return scan_sources(files, "path", skipped, root)
