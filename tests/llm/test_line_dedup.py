import re

import numpy as np

from codestrata.llm import line_dedup as ld

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(rows):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    first = {k: min(h, key=lambda i: (i is None, i or 0)) for k, h in holders.items() if len(h) > 1}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in frame.collect()), key=str)


LONG = "a line that is long enough"
ROWS = [
    (3, f"{LONG}\nown line of three\n{LONG}"), (1, f"x\n {LONG.upper()}\t\nshort"), (2, "short\nÄÖÜ äöü €€\nshort"), (5, "ÄÖÜ äöü €€\n\n\nown line of five"),
    (6, "äöü äöü €€"), (7, "123456789\nabcdefghié"), (8, "123456789\nabcdefghié\r"), (9, ""), (10, None),
]


def test_against_brute_force(docs):
    assert result(ld.line_dedup(docs(*ROWS))) == brute(ROWS)


def test_odd_texts(odd):
    frame = odd.withColumnRenamed("size", "n_lines")
    got = ld.line_dedup(frame)
    assert got.columns == ["doc_id", "text", "source", "row", "n_lines", "n_dropped"]
    assert result(got) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ld.line_dedup(odd.limit(0)).count() == 0


def test_batches_and_deletions_leave_what_one_batch_would(spark, docs, tmp_path):
    index = ld.LineIndex(spark, str(tmp_path), shards=3)
    index.add(docs(*ROWS[:4]))
    index.add(docs(*ROWS[4:]))
    assert result(index.clean(docs(*ROWS))) == brute(ROWS)
    index.delete(docs((1, ""), (2, "")).select("doc_id"))
    rest = [r for r in ROWS if r[0] not in (1, 2)]
    assert result(index.clean(docs(*rest))) == brute(rest)
    index.add(docs(*ROWS[1:3]))
    assert result(index.clean(docs(*ROWS))) == brute(ROWS)
    filters = {r.shard: ld.ShardFilter(r.filter) for r in index._filters().collect()}
    held = {r.key for r in index.holders().select("key").collect()}
    shard = {r.key: r.shard for r in index.holders().withColumn("shard", index._shard()).collect()}
    assert all(filters[shard[k]].contains(np.frombuffer(k[:8], "<u8"))[0] for k in held)
    assert sum(np.count_nonzero(p.table) for f in filters.values() for p in f.parts) == len(held)


def test_the_filters_decide_what_meets_the_references(docs, monkeypatch):
    # Without the filters' word on the second batch, lines that only one of its documents holds would stay.

    def blind(keys, filters):
        return ld.pa.table({"key": keys["key"].cast(ld.pa.binary()), "shared": keys["shared"], "seen": ld.pa.array([False] * len(keys))})

    monkeypatch.setattr(ld, "_probe", blind)
    assert result(ld.line_dedup(docs((1, LONG), (2, "x"), (3, LONG)))) == [(1, LONG, 1, 0), (2, "x", 1, 0), (3, LONG, 1, 0)]
    monkeypatch.undo()
    assert result(ld.line_dedup(docs((1, LONG), (2, "x"), (3, LONG)))) == [(1, LONG, 1, 0), (2, "x", 1, 0), (3, "", 1, 1)]


def test_repeated_rows_are_deleted_whole(spark, docs, tmp_path):
    index = ld.LineIndex(spark, str(tmp_path))
    index.add(docs((1, LONG), (1, LONG), (2, LONG)))
    index.delete(docs((1, "")).select("doc_id"))
    assert result(index.clean(docs((2, LONG)))) == [(2, LONG, 1, 0)]


def test_columns_with_any_names_pass_through(docs):
    frame = docs((1, LONG), (2, LONG)).withColumnsRenamed({"row": "_drop", "source": "_doc"})
    got = ld.line_dedup(frame)
    assert got.columns == ["doc_id", "text", "_doc", "_drop", "size", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r._drop) for r in got.collect()) == [(1, LONG, "x"), (2, "", "x")]


def test_deletion_never_takes_a_fingerprint_of_another_part():
    rng = np.random.default_rng(1)
    first = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    later = first ^ np.uint64(1 << 40)  # same fingerprints, same buckets: each part seems to hold both
    held = ld.ShardFilter()
    held.insert(first)
    held.parts.append(ld.CuckooFilter(ld.buckets_for(len(later))))
    assert held.parts[-1].insert(later)
    held.delete(later)
    assert held.contains(first).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64))
    f = ld.ShardFilter()
    for part in np.array_split(keys[:5000], 7):
        f.insert(part)
    f = ld.ShardFilter(f.dump())
    assert f.contains(keys[:5000]).all() and f.contains(keys[5000:]).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:5000]).all() and f.contains(keys[:2500]).mean() < 0.01
    full = ld.CuckooFilter(64)
    assert not full.insert(keys[:1000])
