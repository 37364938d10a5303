import hashlib
import re
from collections import Counter, defaultdict

import pytest

from codestrata.llm import mixing


def brute(rows, epochs=3):
    """(doc_id, size, source, taken) by one queue in memory."""
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sources = sorted({s for _, _, s in sized}, key=lambda s: (s is None, (s or "").encode()))
    whole = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(whole.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * whole[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(epochs * whole[s])
            left -= target[s]
        free -= over
    copies = []
    for s in sources:
        done = 0
        queue = sorted((hashlib.md5(f"mix-1 {'null' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n) for i, n, x in sized if x == s)
        for place, i, n in queue:
            done += n
            copies += [((done + e * whole[s]) / target[s], s is None, (s or "").encode(), place, i, n) for e in range(epochs) if n and target[s]]
    total, taken = 0, Counter()
    for copy in sorted(copies):
        total += copy[-1]
        if total > sum(whole.values()):
            break
        taken[copy[4], copy[2], copy[5]] += copy[5]
    return target, whole, taken


def rows_of(n):
    return [(k, "w " * (k * 37 % 50), None if k % 9 == 8 else f"s{'0' if k % 3 else k % 7}") for k in range(n)]


@pytest.mark.parametrize("n", [3, 40, 600])
def test_against_one_queue(docs, n):
    rows = rows_of(n)
    got = mixing.mix_plan(docs(*rows)).collect()
    target, whole, taken = brute(rows)
    assert len(got) == n
    for r in got:
        assert r.source_size == whole[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == taken[r.doc_id, (r.source or "").encode(), r["size"]] and r.taken <= 3 * r["size"]
    if n == 600:
        by = defaultdict(int)
        for r in got:
            by[r.source] += r.taken
        assert all(abs(by[s] - target[s]) <= 100 for s in by)


def test_mixed_rows_follow_the_plan(docs):
    frame = docs(*rows_of(60), (3, "same id", "s0"), (None, "no id", "s0"))
    plan = Counter()
    for r in mixing.mix_plan(frame).collect():
        plan[r.doc_id, r.source, r["size"]] += r.epochs
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == +plan


def test_odd_texts(odd, docs):
    got = sorted((r.doc_id is None, r.doc_id, r["size"], r.taken <= 3 * r["size"]) for r in mixing.mix_plan(odd).collect() if r.doc_id is not None)
    assert [(i, n) for _, i, n, ok in got if ok] == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 5), (6, 4), (7, 30000)]
    assert mixing.mix_plan(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0
    blank = docs((1, None), (2, " "))
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0] and mixing.mix(blank).count() == 0


def test_given_weights(spark, docs):
    frame = docs(*[(k, "a b", "x" if k % 2 else "y") for k in range(200)])
    weights = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "source string, weight double")
    target = {r.source: r.target for r in mixing.mix_plan(frame, weights=weights).collect()}
    assert target == {"x": 300.0, "y": 100.0}


def test_no_python_in_the_plan(docs):
    plan = mixing.mix(docs(*rows_of(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
