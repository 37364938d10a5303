"""A training corpus from raw documents: quality, near copies, benchmark leaks, source mix, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.binary_tokens import binary_tokens
from codestrata.llm.decontaminate import decontaminate
from codestrata.llm.mixing import mix
from codestrata.llm.ngram_join import near_dedup
from codestrata.llm.quality import ACCEPT, learn, score
from codestrata.llm.queries import END_ID, table, vocabulary
from codestrata.llm.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("score") >= ACCEPT).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return binary_tokens(docs, vocabulary("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("token_shards", token_shards),
]

# A learned model, tokenizer ids and SimHash are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
