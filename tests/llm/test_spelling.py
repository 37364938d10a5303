"""Spelling variants against pairs compared letter by letter."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import spelling
from codestrata.llm.spelling import one_edit_pairs, spelling_variants


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(u) + 1 == len(v) and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in counts.items():
        close = sorted((-counts[v], v) for v in counts if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 10 * n else None
        out[w] = [form, None, n, len(close), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return sorted((w, *rest) for w, rest in out.items())


def texts(seed, n=400):
    rng = random.Random(seed)
    stems = ["Receive", "Seperate", "wordsmith", "wordsmiths", "aaaaaaaa", "naïveté", "Übergang", "connection", "connexion"]
    stems += ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(40)]

    def word():
        w = stems[min(int(rng.expovariate(0.15)), len(stems) - 1)]
        if rng.random() < 0.2:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :]
        return w

    chain = [(n + k, "harbour" + " harbours" * (k < 25) + " harboursy" * (k % 13 == 0 and k < 26)) for k in range(320)]
    return [(k, " ".join(word() for _ in range(30)) + rng.choice([".", "1x", "\n"])) for k in range(n)] + chain


@pytest.mark.parametrize("limit", [200_000, 3])
def test_matches_brute_force_with_and_without_large_partitions(spark, docs, rows, monkeypatch, limit):
    monkeypatch.setattr(spelling, "GROUP_WORDS", limit)
    data = texts(limit)
    found = spelling_variants(docs(*data))
    want = brute(data)
    assert sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)


def test_pairs_of_random_partitions():
    for seed in range(150):
        rng = random.Random(seed)
        data = sorted({(rng.randint(0, 2), "".join(rng.choice("abé") for _ in range(rng.randint(0, 6)))) for _ in range(40)})
        group, strings = np.array([g for g, _ in data]), [s for _, s in data]
        got = sorted(tuple(sorted(p)) for p in zip(*(x.tolist() for x in one_edit_pairs(group, strings))))
        want = [(i, j) for i in range(len(data)) for j in range(i + 1, len(data)) if group[i] == group[j] and near(strings[i], strings[j])]
        assert got == want


def test_small_chunks_keep_partitions_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_WORDS", 5)
    data = texts(7)
    assert sorted(tuple(r) for r in spelling_variants(docs(*data)).collect()) == brute(data)


def test_odd_rows_and_empty_tables(spark, docs, odd):
    assert spelling_variants(odd).collect() == []
    assert spelling_variants(odd.limit(0)).collect() == []
    long = "q" * 3000
    data = [(1, f"{long} {long} {long}x"), (None, f"{long}x Éclairs éclairs Éclairs"), (None, None), (2, "")] * 2
    assert sorted(tuple(r) for r in spelling_variants(docs(*data)).collect()) == brute(data)
