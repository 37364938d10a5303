"""Token counts kept in a digest cache: each distinct text is encoded once for each tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.storage import new_dir, ship
from codestrata.llm.tokens import file_digest, word_coder

OPTIONS = "no special tokens added; special strings as the library's default; whole texts"


def _encoder(path: str):
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = word_coder(path)
            counts = np.array([len(coder.packed(t.as_py())) // 4 for t in batch["text"]], np.int64)
            yield pa.RecordBatch.from_arrays([batch["digest"].cast(pa.binary()), pa.array(counts)], schema=schema)

    return run


class TokenCache:
    """A table of counts (digest, n_tokens), one folder for each tokenizer version, appended batch by batch.

    The version is the SHA-256 of the tokenizer's file and options, so another vocabulary never meets
    these counts. The content is normalised only by taking a null as empty: any other change of a
    text could change its count.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.tokenizer = spark, tokenizer
        self.version = file_digest(tokenizer)
        self.path = f"{folder.rstrip('/')}/{self.version[:16]}"

    def read(self) -> DataFrame:
        schema = "digest binary, n_tokens long"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def count(self, docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per row of `docs`.

        Digests meet the cache in a join; of the texts it lacks, the row with the smallest doc_id is
        encoded for all its copies, and the new counts are appended before the result reads them. A
        null text is empty and has no tokens. Null or repeated doc_ids are kept as they are. Other
        columns are not read. An empty table gives no rows.
        """
        ship(self.spark)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        content = F.unhex(F.sha2(F.concat(F.lit(self.version + OPTIONS).cast("binary"), text.cast("binary")), 256))
        keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("digest"))
        misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(self.read(), "digest", "left_anti")
        texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        # Only the row to encode carries its text further: the join is on its id, and a copy that
        # repeats the id is filtered by nothing but its digest, made again from the text.
        texts = texts.join(misses, texts["doc_id"].eqNullSafe(misses["first_id"])).where(
            F.unhex(F.sha2(F.concat(F.lit(self.version + OPTIONS).cast("binary"), F.col("text").cast("binary")), 256)) == F.col("digest")
        )
        fresh = texts.select("digest", "text").mapInArrow(_encoder(self.tokenizer), "digest binary, n_tokens long")
        fresh.dropDuplicates(["digest"]).write.mode("append").parquet(self.path)
        counts = self.read().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a batch tried again may repeat rows
        return keyed.join(counts, "digest").select(
            "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
        )


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, folder: str | None = None) -> DataFrame:
    """TokenCache.count with the cache in `folder`, a new one in the shared folder by default."""
    spark = docs.sparkSession
    return TokenCache(spark, folder or new_dir(spark, "token-cache"), tokenizer).count(docs, limit)
