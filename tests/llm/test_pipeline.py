import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import passage
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_quality import sample

FOLDER = contract.SMOKE_DIR


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = sample(300, seed=9)
    rows = [(i, t, f"s{i % 3}") for i, t in rows]
    item = " ".join(passage(40, 3))
    rows += [(1000 + k, rows[k][1] + " and one", "s1") for k in range(0, 60, 3)] + [(2000, rows[5][1] + " " + item, "s2"), (2001, None, None), (2002, "", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, dict(labels), item


def test_stages_by_brute_force(spark, tables):
    folder, rows, labels, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder), name)
        steps[name] = docs.collect()
        assert name == "token_shards" or docs.columns == columns
    good = {r.doc_id for r in steps["quality"]}
    assert all((i in good) == bool(y) for i, y in labels.items())
    texts = [(r.doc_id, r.text) for r in steps["quality"]]
    assert sorted(r.doc_id for r in steps["near_copies"]) == sorted(i for i, _, first in near_brute(texts) if i == first)
    left = [r for r in steps["near_copies"] if item not in (r.text or "")]
    assert sorted(r.doc_id for r in steps["benchmark_leaks"]) == sorted(r.doc_id for r in left) and len(left) < len(steps["near_copies"])
    size = {r.doc_id: len((r.text or "").split()) for r in left}
    assert {r.doc_id for r in steps["source_mix"]} <= set(size) and 0.8 * sum(size.values()) <= sum(size[r.doc_id] for r in steps["source_mix"]) <= sum(size.values())
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(pipeline.vocabulary("word_bpe_49k.json"))
    start = 0
    text_of = {r.doc_id: r.text for r in steps["source_mix"]}
    got = sorted(steps["token_shards"], key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in steps["source_mix"])
    for r in got:
        ids = np.array([*tokenizer.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    again = sorted(map(tuple, pipeline.run(spark, folder).collect()))
    assert again == sorted(map(tuple, steps["token_shards"]))


def test_stages_on_odd_and_empty_tables(spark, odd, tables):
    folder = tables[0]
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0, name
    docs = odd
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder), name)
        docs.count()


def test_registered():
    names = contract.queries()
    assert names["pipeline"] is pipeline.run and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_copies", "benchmark_leaks", "source_mix", "token_shards"]


def test_stages_do_not_keep_the_coder_of_an_earlier_one():
    from codestrata.llm import storage, tokens
    from codestrata.llm.queries import vocabulary

    pytest.importorskip("public_tokenizers")
    tokens.word_coder(vocabulary("word_bpe_49k.json"))
    storage.lean()
    assert tokens._loaded.cache_info().currsize == 0
