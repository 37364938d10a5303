import hashlib
import re
import uuid

from pyspark.sql import functions as F

from codestrata.llm.exact_dedup import DigestIndex, exact_dedup


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_odd_texts(odd):
    rows = [(r.doc_id, digest(r.text)) for r in odd.collect()]
    groups = {}
    for i, d in rows:
        groups.setdefault(d, []).append(i)
    want = []
    for i, d in rows:
        keep = min((x for x in groups[d] if x is not None), default=None)
        want.append((i, keep, len(groups[d]), i == keep, d))
    assert sorted((tuple(r) for r in exact_dedup(odd).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup(odd.limit(0)).count() == 0


def test_later_batches_meet_the_index(spark, docs, tmp_path):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", str(tmp_path / "index"))
    first = index.dedup(docs((5, "a  b"), (6, "a\tb"), (7, "c"))).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in first) == [(5, 5, True), (6, 5, False), (7, 7, True)]
    second = index.dedup(docs((1, "a b"), (2, "new"), (3, "new"))).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept, r.group_size) for r in second) == [(1, 5, False, 1), (2, 2, True, 2), (3, 2, False, 2)]
    assert index.read().count() == 3


def test_the_second_half_meets_the_index(spark, docs, monkeypatch):
    frame = docs((1, "a b"), (2, "c"), (3, "a  b"), (4, "d"), (5, "c"), (6, "a\tb"), (None, "e"), (None, "c"))
    added = []
    fresh = DigestIndex.fresh
    monkeypatch.setattr(DigestIndex, "fresh", lambda self, entries: added.append(fresh(self, entries).collect()) or fresh(self, entries))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame).collect()}
    assert got == {(1, 1, 3, True), (2, 2, 3, True), (3, 1, 3, False), (4, 4, 1, True), (5, 2, 3, False), (6, 1, 3, False), (None, None, 1, True), (None, 2, 3, False)}
    assert [sorted(r.keep_id or 0 for r in rows) for rows in added] == [[1, 2], [0, 4]]
    # An index that is not asked stores later copies as texts of their own, and rows double.
    monkeypatch.setattr(DigestIndex, "fresh", lambda self, entries: entries)
    assert exact_dedup(frame).count() > frame.count()


def test_index_side_is_not_shuffled(spark, docs, tmp_path, capsys):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", str(tmp_path / "index"))
    keyed = docs((5, "a"), (6, "b")).select("doc_id", F.sha2("text", 256).alias("digest"))
    index.add(keyed)
    capsys.readouterr()
    index.fresh(keyed.select("digest", F.col("doc_id").alias("keep_id"))).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == 1  # of the batch
