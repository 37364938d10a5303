"""Language-model scores against the network walked word by word."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import lm_score as lm
from codestrata.llm.lm_score import lm_score


def corpus(n, seed=0):
    rng = random.Random(seed)
    for k in range(n):
        tongue = [["der", "Hund", "lief", "nach", "Haus"], ["the", "dog", "ran", "home", "Again"]][k % 2]
        yield k, " ".join(w for _ in range(rng.randint(1, 12)) for w in (*tongue, rng.choice(["", f"name{rng.randint(0, 40)}"])) if w)


def base_scores(data):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t in data if not held(d) for w in [*lm.tokens(t), lm.END])
    total, distinct = sum(counts.values()), len(counts)
    for d, t in data:
        words = [*lm.tokens(t), lm.END]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        yield (str(d), held(d), len(words), sum(counts[w] > 0 for w in words), total, round(base, 6))


@pytest.mark.parametrize("counted", [lm.COUNTED, 12])
def test_counts_and_base_scores(docs, monkeypatch, counted):
    monkeypatch.setattr(lm, "COUNTED", counted)
    data = [*corpus(200), (None, None), (None, "the\tNEW \x0b dog"), (3, ""), (3, " \n"), (4, "É " * 5000)]
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm_score(docs(*data)).collect()]
    assert sorted(got) == sorted(base_scores(data))


def test_learns_from_the_corpus(docs):
    scored = lm_score(docs(*corpus(1500))).toPandas()
    held = scored[scored["held_out"]]
    assert held["score"].sum() > 0.8 * held["base_score"].sum()
    assert (scored["score"] < 0).all()


def small_network():
    rng = np.random.default_rng(1)
    counts = sorted(rng.integers(1, 50, 70).tolist(), reverse=True)
    words = lm.Words([(b"w%d" % k, n) for k, n in enumerate(counts)], 30, sum(counts) + 30, 71)
    words.head = 61  # the rest is beyond the network
    words.classes = 2
    words.rest = words.total + 0.5 * 72 - (words.counts[:61] + 0.5).sum()
    network = lm.Network(lm.first_weights(words), words)
    docs = [np.append(np.minimum(rng.integers(1, 71, rng.integers(0, 60)), 61), 0) for _ in range(300)]
    return words, network, docs


def slow(weights, head, doc):
    """One document, word by word, in plain formulas."""
    w = {k: v.astype(float) for k, v in weights.items()}
    h, before, total, n = np.zeros(lm.HIDDEN), 0, 0.0, lm.HIDDEN
    for word in doc:
        x, u = w["inputs"][before], h @ w["recur"]
        z, r = (1 / (1 + np.exp(-(x[k * n : k * n + n] + u[k * n : k * n + n]))) for k in (0, 1))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        group = len(w["to_word"]) if word >= head else word // lm.GROUP
        logits = w["to_class"] @ h + w["class_bias"]
        total += logits[group] - np.log(np.exp(logits).sum())
        if word < head:
            logits = w["to_word"][group] @ h + w["word_bias"][group]
            total += logits[word % lm.GROUP] - np.log(np.exp(logits).sum())
        before = word
    return total / np.log(10)


def test_whole_documents_side_by_side_equal_one_word_at_a_time():
    words, network, docs = small_network()
    lm.walk(docs, network, True)
    docs.append(np.append(np.full(3000, 7), 0))
    assert np.allclose(lm.walk(docs, network, False), [slow(network.w, words.head, d) for d in docs], rtol=1e-4)


def test_gradients_are_those_of_the_likelihood():
    words, network, docs = small_network()
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    rng = np.random.default_rng(2)
    before, targets = rng.integers(0, 62, (5, 8)), rng.integers(0, 62, (5, 8))
    targets[3:, 6:] = -1
    fresh, state = before == 0, rng.normal(0, 0.5, (8, lm.HIDDEN)).astype(np.float32)
    grads = {}
    network.update = grads.update
    network.learn(before, targets, fresh, state)

    def loss():
        states, _ = network.states(before, fresh, state, False)
        real = targets >= 0
        return -network.likelihood(states[real].astype(np.float64), targets[real], False).sum() / lm.WINDOW

    for name, grad in grads.items():
        for place in np.argsort(-np.abs(grad).ravel())[:3]:
            at = np.unravel_index(place, grad.shape)
            own = network.w[name][at]
            network.w[name][at] = own + 1e-2
            up = loss()
            network.w[name][at] = own - 1e-2
            down = loss()
            network.w[name][at] = own
            assert abs((up - down) / 2e-2 - grad[at]) < 0.03 * abs(grad[at]) + 1e-7, name


def test_probabilities_of_a_next_word_add_up_to_one():
    words, network, _ = small_network()
    state = np.random.default_rng(3).normal(0, 0.5, (1, lm.HIDDEN)).astype(np.float32)
    inside = np.exp(network.likelihood(np.repeat(state, 62, 0), np.arange(62), False))
    shares = 10 ** (words.base[61:] + np.log10((words.total + 0.5 * 72) / words.rest))
    unseen = 0.5 / words.rest
    assert abs(inside[:61].sum() + inside[61] * (shares.sum() + unseen) - 1) < 1e-3


def test_empty_and_odd_tables(odd):
    assert lm_score(odd.limit(0)).collect() == []
    assert lm_score(odd).count() == odd.count()


def test_word_numbers_are_bytes(docs):
    data = [(1, "the dog the"), (2, "The dog"), (3, None), (4, "the cat")]
    frame = docs(*data).select("doc_id", "text")
    words = lm.frequent_words(lm.word_counts(frame))
    rows = {r["doc_id"]: r["ids"] for r in lm.encode(frame, words).collect()}
    assert all(np.frombuffer(rows[d], lm.NUMBER).tolist() == [words.number.get(w, words.head) for w in lm.tokens(t)] + [0] for d, t in data)


def test_a_task_hands_counts_on_in_parts(docs, monkeypatch):
    monkeypatch.setattr(lm, "GATHERED", 3)
    data = list(corpus(60))
    got = {bytes(r["word"]): r["n"] for r in lm.word_counts(docs(*data)).collect()}
    assert got == Counter(w for d, t in data if zlib.crc32(str(d).encode()) % 5 != 1 for w in [*lm.tokens(t), lm.END])
