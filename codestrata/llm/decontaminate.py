"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codestrata.llm import textkit
from codestrata.llm.storage import lean, ship, stored

SHINGLE = 5
PERCENT = 80
RADIUS = 18  # bits of 64; bags of similarity 0.8 differ in 10 on average, in more than 18 about once in 400
BLOCK_BYTES = 16 << 20  # of benchmark text sent to the tasks at a time
SPAN = 4096  # windows whose fingerprints are made together
PAIRS = 1 << 21  # of fingerprints compared at a time

_BREAKS = np.ones(256, bool)  # words are runs of letters, digits and what is beyond ASCII
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False
_ONE = np.uint64(1)
_BITS = np.arange(64, dtype=np.uint64)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return ((shingles[:, None] >> _BITS) & _ONE).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """The bits whose sum of signs is positive."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


def again(shingles: np.ndarray, nth: np.ndarray | int) -> np.ndarray:
    """The hash of a shingle's nth repetition in a bag; its first occurrence (nth 0) keeps its own hash. As sets of
    these, bags have their weighted Jaccard similarity as a plain one, so SimHash tells it as well as for distinct shingles."""
    return np.where(np.equal(nth, 0), shingles, textkit.mix(shingles + np.asarray(nth, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def previous(shingles: np.ndarray) -> np.ndarray:
    """The place of each shingle's last occurrence before, or -1."""
    order = np.argsort(shingles, kind="stable")
    before = np.full(len(shingles), -1)
    same = shingles[order[1:]] == shingles[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def windows(shingles: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles at ascending places, as bags; windows side by side share running sums."""
    out = np.zeros(len(places), np.uint64)
    cuts = np.flatnonzero((np.diff(places) > n) | (np.diff((places - places[:1]) // SPAN) > 0)) + 1
    for own in np.split(np.arange(len(places)), cuts) if len(places) else ():
        first, last = places[own[0]], places[own[-1]] + n
        part, at = shingles[first:last], places[own] - first
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(signs(part), axis=0, out=sums[1:])
        found = sums[at + n] - sums[at]
        # In the windows that reach back to its kth occurrence before, a shingle counts as the kth repetition.
        before = previous(part)
        place, back, k = np.arange(len(part)), before, 1
        while len(place := place[near := (back >= 0) & (place - back < n)]):
            back = back[near]
            turned = signs(again(part[place], k)) - signs(again(part[place], k - 1))
            change = np.zeros((len(part) + 1, 64), np.int32)
            np.add.at(change, np.maximum(0, place - n + 1), turned)
            np.subtract.at(change, back + 1, turned)
            found += np.cumsum(change, axis=0)[at]
            back, k = before[back], k + 1
        out[own] = fingerprint(found)
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles; a shingle weighs as often as it occurs."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / max(1, a.total() + b.total() - common)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array that is not empty."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class HammingIndex:
    """Fingerprints by the value of each of radius + 1 bit blocks: two within the radius agree on a block."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, []
        n, at = radius + 1, 0
        for k in range(n):
            bits, used = 64 // n + (k < 64 % n), min(16, 64 // n + (k < 64 % n))  # of a wide block the first 16 are looked up
            order = np.argsort(self._value(prints, at, used), kind="stable")
            starts = np.searchsorted(self._value(prints, at, used)[order], np.arange(2**used + 1))
            self.blocks.append((at, used, order, starts))
            at += bits

    @staticmethod
    def _value(prints: np.ndarray, at: int, bits: int) -> np.ndarray:
        return ((prints >> np.uint64(at)) & np.uint64(2**bits - 1)).astype(np.int64)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked, stored, distance) of all pairs within the radius; about PAIRS are compared at a time."""
        pairs = np.zeros(len(asked), np.int64)
        for at, bits, _, starts in self.blocks:
            value = self._value(asked, at, bits)
            pairs += starts[value + 1] - starts[value]
        parts = np.split(np.arange(len(asked)), np.flatnonzero(np.diff(np.cumsum(pairs) // PAIRS)) + 1)
        found = [(own[who], what, distance) for own in parts if len(own) for who, what, distance in [self._near(asked[own])]]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def _near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = []
        for at, bits, order, starts in self.blocks:
            value = self._value(asked, at, bits)
            n = starts[value + 1] - starts[value]
            who = np.repeat(np.arange(len(asked)), n)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(who * len(self.prints) + order[np.repeat(starts[value], n) + nth])
        pairs = np.unique(np.concatenate(pairs))
        who, what = pairs // len(self.prints), pairs % len(self.prints)
        distance = np.bitwise_count(asked[who] ^ self.prints[what]).astype(np.int64)
        close = distance <= self.radius
        return who[close], what[close], distance[close]


class Benchmark:
    """Items by length; those of fewer than `SHINGLE` words are one shingle each."""

    def __init__(self, ids: list, texts: list, percent: int = PERCENT, radius: int = RADIUS):
        self.percent = percent
        self.by_length: dict[int, tuple[list, list[Counter], HammingIndex]] = {}
        items: dict[int, list] = {}
        for _, data, offsets in textkit.chunks(pc.utf8_lower(pa.array(texts, pa.string())), 1 << 62):
            starts, ends, upto = textkit.word_spans(data, offsets, _BREAKS)
            words = textkit.word_hashes(data, starts, ends)
            for item, a, b in zip(ids, np.concatenate(([0], upto[:-1])), upto):
                if b > a:
                    items.setdefault(int(b - a), []).append((item, textkit.shingle_hashes(words[a:b], min(SHINGLE, int(b - a)))))
        self.short: dict[int, dict[int, list]] = {}
        for length in sorted(n for n in items if n < SHINGLE):
            for item, own in items.pop(length):
                self.short.setdefault(length, {}).setdefault(int(own[0]), []).append(item)
        for length, own in items.items():
            prints = np.concatenate([windows(s, np.zeros(1, np.int64), len(s)) for _, s in own])
            self.by_length[length] = [i for i, _ in own], [Counter(s.tolist()) for _, s in own], HammingIndex(prints, radius)
        every = [s for own in items.values() for _, s in own]
        self.own = {length: np.unique(np.concatenate([s for _, s in own])) for length, own in items.items()}
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingles >> np.uint64(44)).astype(np.int64)] = True

    def has(self, shingles: np.ndarray) -> np.ndarray:
        found = self.maybe[(shingles >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(found)
        found[at] = len(at) and _among(shingles[at], self.shingles)
        return found

    def leaks(self, words: np.ndarray) -> list[tuple]:
        """(item, similarity, first word, words) of a document's words, one for each item it holds."""
        shingles = textkit.shingle_hashes(words, SHINGLE)
        shared = shingles[self.has(shingles)]
        found = []
        for length, own in self.short.items():
            runs = textkit.shingle_hashes(words, length)
            for run in np.intersect1d(runs, np.fromiter(own, np.uint64, len(own))).tolist():
                found += [(item, 1.0, int(np.argmax(runs == np.uint64(run))), length) for item in own[run]]
        for length, (ids, bags, index) in self.by_length.items():
            if not _among(shared, self.own[length]).any():
                continue
            marked = np.concatenate(([0], np.cumsum(_among(shingles, self.own[length]))))
            # A document shorter than the item is one window.
            n = min(length, len(words)) - SHINGLE + 1
            places = np.arange(len(shingles) - n + 1)
            # As much of a window as similarity needs must be shingles of items that long: others cannot match.
            places = places[100 * (marked[places + n] - marked[places]) >= self.percent * max(n, length - SHINGLE + 1)]
            hits: dict[int, list] = {}
            for a in range(0, len(places), SPAN):
                own = places[a : a + SPAN]
                for who, what, distance in zip(*index.near(windows(shingles, own, n))):
                    hits.setdefault(int(what), []).append((int(distance), int(own[who])))
            for what, near in hits.items():
                for _, place in sorted(near):
                    same = similarity(bags[what], Counter(shingles[place : place + n].tolist()))
                    if 100 * same >= self.percent:
                        found.append((ids[what], same, place, n + SHINGLE - 1))
                        break
        return found


def _documents(batch: pa.RecordBatch, column: str, items: Benchmark) -> Iterator[tuple[int, list[tuple]]]:
    """(row, leaks) of the rows that share a shingle with the benchmark."""
    for first, data, offsets in textkit.chunks(pc.utf8_lower(batch[column])):
        starts, ends, upto = textkit.word_spans(data, offsets, _BREAKS)
        words = textkit.word_hashes(data, starts, ends)
        shared = [np.flatnonzero(items.has(textkit.shingle_hashes(words, SHINGLE)))]
        shared += [np.flatnonzero(np.isin(textkit.shingle_hashes(words, n), np.fromiter(own, np.uint64, len(own)))) for n, own in items.short.items()]
        for k in np.unique(np.searchsorted(upto, np.concatenate(shared), "right")):
            found = items.leaks(words[upto[k - 1] if k else 0 : upto[k]])
            if found:
                yield first + int(k), found


def _blocks(benchmark: DataFrame, text_col: str) -> Iterator[Benchmark]:
    """The different texts of the benchmark in blocks of bounded size, each small enough to go to every task;
    an item is known by `_item` of its text."""
    texts = stored(benchmark.select(F.col(text_col).cast("string").alias("text")).where("text is not null").distinct(), "benchmark-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select(_item("text").alias("id"), "text").orderBy("id").toArrow()
        yield Benchmark(rows["id"].to_pylist(), rows["text"].to_pylist())


def _item(text):
    return F.xxhash64(text, F.lit("item"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item, whole or nearly: doc_id, item_id, similarity, first_word, n_words.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case; a shingle
    is five words; an item of fewer words is one shingle, found wherever its words stand in a row. Each
    run of as many words as an item has is a window. Windows that share enough shingles with the benchmark get a 64-bit SimHash, in
    which a shingle's repetitions are numbered (`again`); all items of that length whose SimHash is within
    RADIUS bits are found by block, and verified: at least 0.8 weighted Jaccard similarity of the bags
    of shingles. Of windows at exactly 0.8 about 1 in 400 is lost, with or without repetitions; copies never are.
    One row for each row of `docs` and item, at the window of least Hamming distance
    that passes. Whole texts are searched, whatever their length.

    The different texts of the benchmark are sent around, in blocks of BLOCK_BYTES, each block against
    all documents; the documents are not shuffled. Null or empty texts and items match nothing. Repeated rows are
    matched each: items of one text share its search. Null ids stay null; other columns are not read, and
    may have any names. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, _item long, similarity double, first_word long, n_words long"
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            lean()
            for batch in batches:
                ids = batch["doc_id"].to_pylist()
                rows = [(ids[k], *leak) for k, found in _documents(batch, "text", sent.value) for leak in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                    ["doc_id", "_item", "similarity", "first_word", "n_words"],
                )

        out = out.unionByName(picked.mapInArrow(run, schema))
    ids = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("_text")).where("_text is not null")
    ids = ids.select("item_id", _item("_text").alias("_item"))
    return out.join(ids, "_item").select("doc_id", "item_id", "similarity", "first_word", "n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, as `find_leaks` tells; all columns stay, whatever their names."""
    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for items in _blocks(benchmark, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            lean()
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[k for k, _ in _documents(batch, text_col, sent.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, fields)
    return docs
