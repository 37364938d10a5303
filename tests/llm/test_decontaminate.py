import random

import numpy as np
import pytest

from codestrata.llm import decontaminate as dc

ITEM = [(1, "word"), (2, None), (3, "")]


@pytest.fixture
def bench(spark):
    return lambda *rows: spark.createDataFrame(list(rows) + ITEM, "item_id long, text string")


def passage(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]


def test_whole_changed_and_foreign_passages(docs, bench, words):
    item, other = passage(60, 1), passage(20, 2)
    near = item[:30] + ["changed"] + item[31:]
    far = [w if k % 6 else "changed" for k, w in enumerate(item)]
    rows = [
        (10, " ".join(words(50) + item + words(50, 100))), (11, "(" + ", ".join(w.upper() for w in item) + ")!"), (12, " ".join(words(300) + near)), (13, " ".join(far)),
        (14, " ".join(words(500))), (15, " ".join(item[:25])), (16, " ".join(other + words(9) + item)), (17, " ".join(other[1:])), (None, " ".join(other)),
    ]
    benchmark = bench((7, " ".join(item)), (8, " ".join(other)))
    got = dc.find_leaks(docs(*rows), benchmark).collect()
    found = sorted(((r.doc_id, r.item_id) for r in got), key=str)
    assert found == sorted([(10, 7), (11, 7), (12, 7), (16, 7), (16, 8), (17, 8), (None, 8)], key=str)
    assert {r.doc_id: r.first_word for r in got if r.item_id == 7}[10] == 50
    assert all(0.8 <= r.similarity <= 1 for r in got)
    clean = dc.decontaminate(docs(*rows), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [13, 14, 15]


def test_blocks_of_the_benchmark_give_the_same(docs, bench, monkeypatch):
    items = [(k, " ".join(passage(20 + k, k))) for k in range(10, 20)]
    rows = [(k, "before it " + text + " after") for k, text in items]
    monkeypatch.setattr(dc, "BLOCK_BYTES", 400)
    got = dc.find_leaks(docs(*rows), bench(*items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k, _ in items]
    assert dc.decontaminate(docs(*rows), bench(*items)).count() == 0


def test_similar_windows_are_found_as_by_comparing_all():
    """Against all windows of all items' lengths, by exact similarity."""
    rng = random.Random(4)
    items = [passage(rng.randrange(12, 40), k) for k in range(12)]
    benchmark = dc.Benchmark(list(range(12)), [" ".join(i) for i in items])

    def hashes(words):
        for _, data, offsets in dc.textkit.chunks(dc.pa.array([" ".join(words)])):
            return dc.textkit.word_hashes(data, *dc.textkit.word_spans(data, offsets, dc._BREAKS)[:2])

    for _ in range(150):
        k = rng.randrange(12)
        item = list(items[k])
        for _ in range(rng.randrange(3)):
            item[rng.choice([0, 1, len(item) - 1])] = "other"
        text = hashes(passage(rng.randrange(30), 99) + item[rng.randrange(3) :] + passage(rng.randrange(30), 98))
        shingles = dc.textkit.shingle_hashes(text, 5)
        want = set()
        for j, own in enumerate(items):
            bag = dc.Counter(dc.textkit.shingle_hashes(hashes(own), 5).tolist())
            n = min(len(own), len(text)) - 4
            if any(dc.similarity(bag, dc.Counter(shingles[p : p + n].tolist())) >= 0.8 for p in range(len(shingles) - n + 1)):
                want.add(j)
        assert {leak[0] for leak in benchmark.leaks(text)} == want


def test_hamming_index_is_whole():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False)) for _ in prints], np.uint64)
    asked = prints ^ flips
    for radius in (0, 3, 18):
        got = set(zip(*(x.tolist() for x in dc.HammingIndex(prints, radius).near(asked)[:2])))
        assert got == {(a, b) for a in range(300) for b in range(300) if int(asked[a] ^ prints[b]).bit_count() <= radius}


def test_odd_texts(odd, bench):
    assert sorted(dc.find_leaks(odd, bench((5, "ab " * 8), (6, "a b c d"))).select("doc_id", "item_id").collect()) == [(6, 6), (7, 5)]
    assert dc.decontaminate(odd, bench()).count() == odd.count()
    assert dc.find_leaks(odd.limit(0), bench()).count() == 0 and dc.find_leaks(odd, bench().limit(0)).count() == 0


def numbered(shingles):
    seen = dc.Counter()
    out = []
    for s in shingles.tolist():
        out.append(int(dc.again(np.array([s], np.uint64), seen[s])[0]))
        seen[s] += 1
    return np.array(out, np.uint64)


def test_fingerprints_of_windows_are_those_of_their_bags():
    rng = np.random.default_rng(7)
    for kinds, n, size in ((2, 7, 90), (1, 5, 40), (9, 30, 200), (1000, 12, 100)):
        shingles = rng.integers(0, 2**64, kinds, dtype=np.uint64)[rng.integers(0, kinds, size)]
        places = np.flatnonzero(rng.random(size - n + 1) < 0.4)
        want = [dc.fingerprint(dc.signs(numbered(shingles[p : p + n])).sum(axis=0)) for p in places]
        assert dc.windows(shingles, places, n).tolist() == [int(w) for w in want]


def test_recall_of_bags_with_repeats():
    """Bags of exactly 0.8 weighted Jaccard similarity, a shingle of any weight on each side."""
    rng = np.random.default_rng(8)
    for common, weight in ((16, 2), (24, 3), (40, 5), (80, 10)):
        lost = 0
        for _ in range(1000):
            own = rng.integers(0, 2**64, common + 2, dtype=np.uint64)
            a, b = (dc.windows(np.concatenate([own[:common], np.repeat(own[k], weight)]), np.zeros(1, np.int64), common + weight)[0] for k in (common, common + 1))
            lost += int(a ^ b).bit_count() > dc.RADIUS
        assert lost <= 10


def test_short_items_are_found_whole(docs, bench):
    rows = [(1, "before Alpha, beta after"), (2, "alpha gamma beta"), (3, "alpha beta"), (4, "alpha"), (5, "one two three four"), (6, "so one two three four five"), (None, "x alpha beta alpha beta")]
    benchmark = bench((11, "alpha beta"), (12, "one two three four"))
    got = sorted(((r.doc_id or 0, r.item_id, r.similarity, r.first_word, r.n_words) for r in dc.find_leaks(docs(*rows), benchmark).collect()))
    assert got == [(0, 11, 1.0, 1, 2), (1, 11, 1.0, 1, 2), (3, 11, 1.0, 0, 2), (5, 12, 1.0, 0, 4), (6, 12, 1.0, 1, 4)]
    assert sorted(r.doc_id for r in dc.decontaminate(docs(*rows), benchmark).collect()) == [2, 4]


def test_one_item_in_many_rows(docs, bench, monkeypatch):
    item = " ".join(passage(30, 9))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1000)
    got = dc.find_leaks(docs((1, f"a {item} b"), (2, "none")), bench(*[(k if k else None, item) for k in range(200)])).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, k) for k in range(200)]


def test_pairs_are_compared_in_pieces(monkeypatch):
    monkeypatch.setattr(dc, "PAIRS", 500)
    test_hamming_index_is_whole()
