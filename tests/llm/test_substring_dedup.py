import random
import re

import numpy as np
import pyarrow as pa

from codestrata.llm import substring_dedup as sd, textkit


def text(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 11))) for _ in range(n))


def chunks_of(texts):
    """Each text's chunks, as bytes, when all are read together."""
    out = [[] for _ in texts]
    for row, data, offsets in textkit.chunks(pa.array(texts)):
        c = sd.chunks_of(data, offsets, *textkit.word_spans(data, offsets))
        for k, start, stop in zip(c.text, c.start, c.stop):
            out[row + k].append(data[start:stop].tobytes())
    return out


def plain_hashes(raw):
    h, out = 0, []
    for byte in raw:
        h = (2 * h + int(sd._GEAR[byte])) % 2**32
        out.append(h)
    return out


def test_rolling_hash():
    raw = text(40, 1).encode()
    assert sd.gear_hashes(np.frombuffer(raw, np.uint8)).tolist() == plain_hashes(raw)


def test_chunks_depend_on_the_text_alone_and_cover_it():
    texts = [text(200, 2), "", "x", text(51, 3), text(50, 4), "a " * 300, text(500, 5)]
    together = chunks_of(texts)
    assert together == [chunks_of([t])[0] for t in texts]
    assert [len(c) > 0 for c in together] == [len(t.split()) >= sd.RUN_WORDS for t in texts]
    for t, own in zip(texts, together):
        assert all(c.decode() in t and sd.RUN_WORDS <= len(c.split()) < 2 * sd.RUN_WORDS - sd.SEED_WORDS + 1 for c in own)
        # every run of words lies in one chunk, and in one only
        assert sum(len(c.split()) - sd.RUN_WORDS + 1 for c in own) == max(0, len(t.split()) - sd.RUN_WORDS + 1)


def test_an_insertion_changes_only_the_chunks_next_to_it():
    base = text(600, 5)
    moved = base[:1500] + " inserted " + base[1500:]
    a, b = (set(c) for c in chunks_of([base, moved]))
    assert len(a & b) > 15 and len(a - b) <= 8 and len(b - a) <= 8


def test_repeated_passages_are_found_and_cut(docs):
    shared, short = text(60, 6), text(8, 7)
    rows = [
        (1, text(100, 8) + " " + shared + " " + text(50, 9)), (2, shared + text(30, 10)), (3, text(120, 11) + short), (4, short + " " + text(90, 12) + short),
        (5, text(40, 13) + " " + shared), (6, text(70, 14) + " " + text(70, 14)), (None, shared), (7, text(40, 15) + shared.upper()),
    ]
    got = sd.repeated_spans(docs(*rows)).collect()
    assert sorted((str(r.doc_id), r.first_doc) for r in got) == [("2", 1), ("5", 1), ("None", 1)]
    for r in got:
        raw = dict(rows)[r.doc_id].encode()
        assert raw[r.start : r.stop].decode() in shared and r.n_words == (59 if r.doc_id == 2 else 60) and r.n_chunks >= 1
    cut = {r.doc_id: r.text for r in sd.substring_dedup(docs(*rows)).collect()}
    assert cut[1] == rows[0][1] and cut[3] == rows[2][1] and cut[4] == rows[3][1] and cut[6] == rows[5][1]
    assert all(len(cut[i]) < len(dict(rows)[i]) - 100 for i in (2, 5, None))


def test_odd_texts(odd):
    assert sd.repeated_spans(odd).count() == 0
    frame = sd.substring_dedup(odd)
    assert frame.columns == odd.columns
    assert sorted(map(str, frame.collect())) == sorted(map(str, odd.collect()))
    assert sd.repeated_spans(odd.limit(0)).count() == 0 and sd.substring_dedup(odd.limit(0)).count() == 0


def plain_spans(rows, size=51):
    """Brute force: (doc_id, start, stop, words) of the runs of words of which every `size` stand in a smaller doc_id."""
    held, spans = {}, []
    for i, raw in sorted(rows):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", raw)]
        runs = [raw[words[k][0] : words[k + size - 1][1]] for k in range(len(words) - size + 1)]
        again = [held.get(r, i) < i for r in runs] + [False]
        begin = None
        for k, yes in enumerate(again):
            if yes and begin is None:
                begin = k
            elif not yes and begin is not None:
                spans.append((i, words[begin][0], words[k + size - 2][1], k - begin + size - 1))
                begin = None
        for r in runs:
            held.setdefault(r, i)
    return sorted(spans)


def test_every_passage_of_51_words_is_found_to_its_edges(docs):
    rows, rng = [], random.Random(0)
    for seed in range(300):
        n = rng.randrange(49, 61)
        shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, rng.choice([2, 4, 11])))) for _ in range(n))
        for k in range(2):
            rows.append((2 * seed + k, f"{text(rng.randrange(90), (seed, k, 0).__hash__())} {shared} {text(rng.randrange(90), (seed, k, 1).__hash__())}"))
    got = sorted((r.doc_id, r.start, r.stop, r.n_words) for r in sd.repeated_spans(docs(*rows)).collect())
    assert got == plain_spans(rows) and len(got) > 200


def test_a_passage_whose_parts_stand_in_other_documents_is_found(docs):
    shared = text(160, 20).split()
    phrase = " ".join(shared[60:95])
    rows = [(1, f"{text(40, 21)} {phrase} {text(40, 22)}"), (2, " ".join(shared)), (3, f"{text(9, 23)} {' '.join(shared[50:105])}\t{text(9, 24)}"), (4, "one two " * 90), (5, f"{text(30, 25)} {'one two ' * 40}")]
    got = sorted((r.doc_id, r.first_doc, r.n_words) for r in sd.repeated_spans(docs(*rows)).collect())
    assert got == [(3, 2, 55), (5, 4, 80)]


def test_texts_that_share_a_doc_id_keep_their_own_spans(docs):
    shared, more = text(80, 30), text(70, 31)
    rows = [(1, f"{shared} end"), (2, more), (None, f"{text(20, 32)} {shared}"), (None, f"{text(300, 33)} {more} {text(9, 34)}"), (None, text(200, 35)), (5, f"{text(5, 36)} {more}"), (5, shared), (5, shared)]
    got = sd.repeated_spans(docs(*rows)).collect()
    assert sorted((str(r.doc_id), r.first_doc, r.n_words) for r in got) == [("5", 1, 80), ("5", 2, 70), ("None", 1, 80), ("None", 2, 70)]
    cut = sorted(r.text.strip() for r in sd.substring_dedup(docs(*rows)).collect())
    left = [rows[0][1], more, text(20, 32), f"{text(300, 33)}  {text(9, 34)}", text(200, 35), text(5, 36), "", ""]
    assert cut == sorted(left)


def test_a_passage_and_a_third_of_all_rows_on_one_id(docs):
    passage, rows = text(60, 40), []
    for k in range(150):
        rows.append((None if k % 3 == 0 else k, f"{text(30, (41, k).__hash__())} {passage if k % 2 else text(60, (42, k).__hash__())} {text(30, (43, k).__hash__())}"))
    got = sorted((r.doc_id if r.doc_id is not None else sd.NO_ID, r.start, r.stop, r.n_words) for r in sd.repeated_spans(docs(*rows)).collect())
    own = plain_spans([(sd.NO_ID if i is None else i, t) for i, t in rows])
    assert got == own and len(got) == 74


def test_columns_of_any_name_are_kept(docs):
    shared = text(60, 50)
    frame = docs((1, shared), (2, f"x {shared}")).selectExpr("*", "1 AS spans", "2 AS spans_", "3 AS _spans", "4 AS text_hash", "5 AS _doc")
    got = {r.doc_id: r for r in sd.substring_dedup(frame).collect()}
    assert got[1].asDict() == {**got[2].asDict(), "doc_id": 1, "text": shared} and got[2].text == "x " and got[2]._doc == 5
