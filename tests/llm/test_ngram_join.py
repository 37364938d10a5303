import itertools
import random
import re

import numpy as np
import pytest

from codestrata.llm import ngram_join as nj

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=80):
    """(size, component) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = of[a], of[b]
            of = [x if c == y else c for c in of]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.sort(rng.choice(16, int(rng.integers(1, 14)), replace=False)).astype(np.uint64) for _ in range(int(rng.integers(1, 30)))]
        sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        got = sorted((int(a), int(b)) for x, y in nj.Trie(sets, sizes).matches(sets, sizes, 60) for a, b in zip(x, y))
        common = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert got == [(a, b) for a in range(len(sets)) for b in range(len(sets)) if 100 * common[a][b] >= 60 * (sizes[a] + sizes[b] - common[a][b])]


@pytest.mark.parametrize("block", [512, 3])
def test_families_of_near_copies(docs, words, monkeypatch, block):
    """Also with blocks of three: links between blocks must be found as well."""
    monkeypatch.setattr(nj, "BLOCK", block)
    rng = random.Random(5)
    rows, shared = [], words(60, 10_000)
    for family in range(4):
        base = words(120, 1000 * family) + shared
        for copy in range(12):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"new{rng.random()}"
            rows.append((100 * family + copy, " ".join(text)))
    rows += [(900 + k, " ".join(words(40, 5000 + 100 * k) + shared)) for k in range(10)]
    rows += [(950, rows[0][1].upper()), (951, rows[0][1].replace(" ", "\n\t")), (None, rows[0][1]), (0, rows[0][1])]
    rng.shuffle(rows)
    got = nj.ngram_join(docs(*rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = nj.ngram_join(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_no_rows(docs):
    assert nj.ngram_join(docs()).count() == 0
    assert nj.near_dedup(docs()).count() == 0


def test_one_of_each_group_stays(odd, docs, words):
    text = " ".join(words(30))
    got = nj.near_dedup(docs((5, text), (3, text + " end"), (3, text + " end"), (None, text), (8, "other"), (9, None))).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, text + " end"), (8, "other"), (9, None)], key=str)
    kept = nj.near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 1, 2, 3, 4, 5, 6, 7], key=str)


def test_link_threshold_is_exact(docs, words):
    """20 shingles against 25 that hold them are 0.8, against 26 less."""
    a, b, c = words(24), words(29), words(30)
    got = {r.doc_id: r.component_id for r in nj.ngram_join(docs((1, " ".join(a)), (2, " ".join(b)))).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.doc_id: r.component_id for r in nj.ngram_join(docs((1, " ".join(a)), (2, " ".join(c)))).collect()}
    assert got == {1: 1, 2: 2}


def test_tasks_for_each_partition(spark, docs, words, monkeypatch):
    """Small tables in many partitions cost a task for each partition and exchange, so there must be few exchanges."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(nj, "BLOCK", 3)
    rows = []
    for family in range(3):
        base = words(80, 1000 * family)
        rows += [(100 * family + copy, " ".join([*base[:copy], f"new{copy}", *base[copy:]])) for copy in range(12)]
    sc = spark.sparkContext
    for k, v in conf.items():
        spark.conf.set(k, v)
    sc.setJobGroup("few tasks", "few tasks")
    try:
        got = nj.ngram_join(docs(*rows)).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=str) == brute(rows)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 0 < tasks < 50 * 24
