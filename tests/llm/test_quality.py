import random
import zlib

import numpy as np
import pytest

from codestrata.llm import quality as q, textkit

import pyarrow as pa


def sample(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(20, 90))]
        rows.append((k, " ".join(w if good else w + rng.choice("#$%*") * 3 for w in words) + "."))
        labels.append((k, int(good)))
    return rows, labels


def test_learns_what_is_junk(spark, docs):
    rows, labels = sample(600)
    frame, marks = docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.learn(frame, marks)
    got = {r.doc_id: r.score for r in q.score(frame, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= q.ACCEPT) == bool(dict(labels)[i]) for i in held)
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, quality int")
    again = q.learn(frame.repartition(7), flipped)
    assert all(a.tolist() == b.tolist() for a, b in zip(model.tables + model.pair_tables, again.tables + again.pair_tables)), "held-out labels or row order matter"
    assert {r.doc_id for r in frame.where(q.held_out(frame.doc_id)).collect()} == set(held)


def test_interactions_are_learned():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


def test_odd_texts_and_labels(spark, odd):
    none = q.learn(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in q.score(odd, none).collect()} == {0.5}
    one = q.learn(odd, spark.createDataFrame([(1, 1), (2, 1), (4, None), (6, 7)], "doc_id long, quality int"))
    assert all(0.5 < r.score < 1 for r in q.score(odd, one).collect())
    scored = q.score(odd.withColumnRenamed("source", "score"), none)
    assert scored.columns == ["doc_id", "text", "row", "size", "score"] and scored.count() == odd.count()
    assert q.score(odd.limit(0), none).count() == 0


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["one Two, two two, !", "", None, "ünï | 12\n### x", " "]
    whole = [row for _, d, o in textkit.chunks(pa.array(texts)) for row in q.features(d, o)]
    alone = [q.features(d, o)[0] for t in texts for _, d, o in textkit.chunks(pa.array([t], pa.string()))]
    assert np.allclose(whole, alone) and not np.any(whole[1]) and not np.any(whole[2])
    named = dict(zip(q.FEATURES, whole[0]))
    assert named["unique_words"] == pytest.approx(4 / 5) and named["top_word"] == pytest.approx(2 / 5) and named["repeated_next"] == 0


def test_rows_that_repeat_a_labelled_doc_id_count_once(docs, spark, monkeypatch):
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5][:4]
    texts = [(ids[0], f"words of row {k} stand here") for k in range(200)] + [(i, f"other words {i}") for i in ids[1:]]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, y: seen.append((len(x), len(y))))
    q.learn(docs(*texts), labels, max_rows=4)
    assert seen == [(4, 4)]
