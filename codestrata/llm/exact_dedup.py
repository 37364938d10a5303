"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codestrata.llm.storage import new_dir, shuffle_parts, stored


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text, a null as empty, each `[\\x20\\x09-\\x0D]+` as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest) of all rows, stored: texts are read and hashed once, all further steps are narrow."""
    return stored(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests-rows")


class DigestIndex:
    """A table (digest, keep_id) in `buckets` buckets by digest, each file sorted by it.

    Incoming digests meet it in a sort-merge join; the index side is read bucket by bucket and is
    not shuffled. Each batch is appended in the same bucketing.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = buckets or shuffle_parts(spark)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def create(self, id_type: str = "bigint") -> None:
        """The empty table, unless it is there."""
        place = f"LOCATION '{self.path}'" if self.path else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}"
        )

    def fresh(self, entries: DataFrame) -> DataFrame:
        """Those of `entries` (digest, keep_id; a digest once) that the index does not hold, by sort-merge anti join."""
        return entries.join(self.read().hint("merge"), "digest", "left_anti")

    def add(self, keyed: DataFrame) -> None:
        """Append the new digests of a batch (doc_id, digest), each with its smallest doc_id.

        Groups are stored before they meet the index: the optimizer would move the anti join below an
        aggregate, and the rows of a large group would go to one task unsummed."""
        self.create(keyed.schema["doc_id"].dataType.simpleString())
        entries = stored(keyed.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "digests-batch")
        (
            # One task writes one bucket, so a batch adds one file to each.
            self.fresh(entries).repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table)
        )

    def decide(self, keyed: DataFrame) -> DataFrame:
        """The decision on each row of `keyed`, whose digests the index holds.

        Groups meet the index bucket by bucket and are stored, so that the way back to the rows is a join of
        two plain shuffles: adaptive execution may split the rows of a large group."""
        groups = keyed.groupBy("digest").agg(F.count("*").alias("group_size"))
        held = stored(groups.join(self.read().hint("merge"), "digest"), "digests-groups")
        return keyed.join(held, "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
        )

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide on a batch and remember its new texts.

        One row per row of `docs`: doc_id, keep_id (the row that stays: the one stored by an earlier
        batch, else the smallest doc_id of the batch), group_size (rows of the batch with this text),
        kept, text_sha256. A null text is empty. A null doc_id never stays before another one and is
        kept only if its text has no other; rows that repeat doc_id and text count as one document
        and share its decision. An empty batch gives no rows. Other columns are not read.
        """
        keyed = keyed_rows(docs, id_col, text_col)
        self.add(keyed)
        return self.decide(keyed)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of `docs` (doc_ids are numbers) through a new index in the shared folder; rows as DigestIndex.dedup gives them.

    The lower half of the doc_ids enters first; the upper half (and null ids) meets it in the index and
    adds only what it does not hold, so the smallest doc_id of a group is the one stored."""
    spark = docs.sparkSession
    path = new_dir(spark, "digests")
    index = DigestIndex(spark, "digests_" + path.rpartition("-")[2], path)
    keyed = keyed_rows(docs, id_col, text_col)
    middle = keyed.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    lower = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    index.add(keyed.where(lower))
    index.add(keyed.where(~lower))
    decided = index.decide(keyed)
    spark.sql(f"DROP TABLE {index.table}")  # the entry in the catalog; its files stay with the other tables of the run
    return decided
