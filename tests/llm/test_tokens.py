import os
import random
import zlib

import numpy as np
import pytest

from codestrata.llm import binary_tokens as bt, token_counts as tc
from codestrata.llm.queries import vocabulary
from codestrata.llm.tokens import WordCoder

pytest.importorskip("public_tokenizers")
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD_TEXTS = [
    "", "  a", "a  b", "a\n\nb", " x ", "it's can't we'll 's", "<|endoftext|> a<|endoftext|>b", "é é é ́x", "İstanbul ΑΣ Σ", "a b 　c", "x\x1cy \x1d z", "a\tb", "a\rb",
    "ﬁ ½ ² 日本語 test", "hello,world. foo.bar !!! a.", "don't THE&&& %%% x***", "ÀÉß ÿ Ÿ ×÷", "a \nb", "a\n b", "\n", "tab\t", "<|startoftext|>", "a|b <| c", "\x00\x01 \x7f", "\U0001f600\U0001f468‍\U0001f469",
]


@pytest.fixture(scope="module")
def coders():
    return {n: WordCoder(vocabulary(n)) for n in NAMES}


def library(coder, text):
    return coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_words_give_the_library_s_ids(coders, name):
    for text in ODD_TEXTS:
        assert coders[name].ids(text).tolist() == library(coders[name], text), text


@pytest.mark.parametrize("name", NAMES)
def test_any_text_gives_the_library_s_ids(coders, name):
    rng = random.Random(8)
    common = " \n\t.,'!aAbZéÉßsStT1|<> \u0301 \x1f\u00a0"
    for _ in range(2000):
        text = "".join(rng.choice(common) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(40)))
        assert coders[name].ids(text).tolist() == library(coders[name], text), text


def test_forgetting_words_changes_nothing(monkeypatch, coders):
    monkeypatch.setattr("codestrata.llm.tokens.CACHED_WORDS", 2)
    coder = WordCoder(vocabulary(NAMES[1]))
    text = "one two three, two. One four THREE one"
    assert coder.ids(text).tolist() == library(coder, text)


def test_counts_of_odd_texts(odd, coders):
    path = vocabulary(NAMES[0])
    got = sorted((tuple(r) for r in tc.token_counts(odd, path, limit=3).collect()), key=str)
    want = []
    for r in odd.collect():
        n = len(library(coders[NAMES[0]], r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 3))
    assert got == sorted(want, key=str)
    assert tc.token_counts(odd.limit(0), path).count() == 0


def test_only_misses_are_encoded_and_appended(spark, docs, tmp_path):
    cache = tc.TokenCache(spark, str(tmp_path), vocabulary(NAMES[0]))
    cache.count(docs((1, "a b"), (2, "a b"), (3, "c"))).collect()
    assert cache.read().count() == 2
    spark.range(1).selectExpr("unhex(sha2('none', 256)) AS digest", "99L AS n_tokens").write.mode("append").parquet(cache.path)
    got = {r.doc_id: r.n_tokens for r in cache.count(docs((7, "a b"), (8, "d e f"), (9, None))).collect()}
    assert got == {7: 2, 8: 3, 9: 0}
    assert cache.read().count() == 5


def test_another_tokenizer_has_another_cache(spark, tmp_path):
    assert tc.TokenCache(spark, str(tmp_path), vocabulary(NAMES[0])).path != tc.TokenCache(spark, str(tmp_path), vocabulary(NAMES[1])).path


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 10_001, dtype=np.uint32)
    packed = bt.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert bt.unpack_bits(packed, bits, len(ids)).tolist() == ids.tolist()


def test_width():
    assert [bt.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_shard_random_access():
    rng = np.random.default_rng(1)
    sizes = [1, 5000, 3, 9000, 1, 4096]
    ids = rng.integers(0, 2**13, sum(sizes), dtype=np.uint32)
    ends = np.cumsum(sizes)
    shard = bt.Shard(bt.write_shard(ids, ends, 13))
    for k, end in enumerate(ends):
        assert shard.doc(k).tolist() == ids[end - sizes[k] : end].tolist()
    assert shard.ids(4000, 4200).tolist() == ids[4000:4200].tolist()
    assert len(bt.Shard(bt.write_shard(ids[:0], ends[:0], 13)).ids(0, 0)) == 0
    with pytest.raises(ValueError):
        bt.Shard(b"x" * 64)


@pytest.mark.parametrize("shard_ids", [1 << 21, 8])
def test_files_read_back(odd, coders, monkeypatch, shard_ids):
    """Also with many small shards."""
    path = vocabulary(NAMES[1])
    folder_rows = bt.binary_tokens(odd, path, 2).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(folder_rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    sums = {}
    for i, text in rows:
        ids = np.array([*library(coders[NAMES[1]], text), 2], "<u4")
        sums.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in sums[r.doc_id]
        start += r.n_tokens
    assert bt.binary_tokens(odd.limit(0), path, 2).count() == 0


def test_tokenizers_are_not_in_the_repository():
    here = os.path.dirname(os.path.abspath(__file__))
    assert not any(n in files for _, _, files in os.walk(os.path.join(here, "..", "..", "codestrata")) for n in NAMES)


def test_trailing_marks_are_no_words_of_their_own(coders):
    coder = WordCoder(vocabulary(NAMES[1]))
    text = "Zorble, zorble. ZORBLE*** zorble&&& \u00c9z\u00fa, it's, don't. x-ray! zorble'. a.\u0338 b,"
    assert coder.ids(text).tolist() == library(coder, text)
    assert [w for w in coder.words if w.startswith("zorble")] == ["zorble", "zorble'."]


def test_index_goes_through_one_worker(docs, tmp_path):
    folder = str(tmp_path / "t")
    bt.write_tokens(docs((1, "one two"), (2, None)), folder, vocabulary(NAMES[1]), 2)
    index = bt.token_index(docs((0, "")).sparkSession, folder)
    assert index._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.doc_id for r in index.collect()) == [1, 2]
