"""Spelling variants: words of a corpus that differ by one letter, and the frequent form each stands for."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.storage import ship, stored
from codestrata.llm.textkit import mix
from codestrata.operators.skew import salted_join

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS = 7
MIN_COUNT = 2
FORM_FACTOR = 10  # a form is at least so many times as frequent
DAMAGED = 31  # one run in so many loses a letter
GROUP_WORDS = 200_000  # words of one partition of the composition
CHUNK_CELLS = 4_000_000  # letters that one acceptor is built from, about
CHUNK_WORDS = 100_000

_SYMBOLS = np.int64(1 << 21)


class Acceptor:
    """Minimal acyclic acceptor of (partition, string) rows in order: each partition is an initial state.

    The prefix tree of the rows is numbered level by level; states with equal right languages (compared
    by a 64-bit hash of final mark and arcs, computed bottom-up) become one. The number of rows that
    come before a path's rows, summed along its arcs, is the index of the word the path spells.
    """

    def __init__(self, group: np.ndarray, strings: list[str]):
        n = len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        width = int(lengths.max()) if n else 0
        letters = np.array(strings, f"U{max(width, 1)}").view(np.uint32).reshape(n, -1)
        fresh = np.ones(n, bool)  # the row begins a partition
        fresh[1:] = group[1:] != group[:-1]
        shared = np.zeros(n, np.int64)  # letters shared with the row before
        if n > 1:
            same = letters[1:] == letters[:-1]
            same &= np.arange(letters.shape[1]) < np.minimum(lengths[1:], lengths[:-1])[:, None]
            shared[1:] = np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1))
        shared[fresh] = -1
        rows, parents, symbols, finals, sizes = [], [], [], [], []
        above = np.zeros(0, np.int64)
        base = 0
        for depth in range(width + 1):
            at = np.flatnonzero(lengths >= depth)
            new = shared[at] < depth
            node = np.cumsum(new) - 1 + base  # node of each row that reaches this depth
            first = at[new]
            rows.append(first)
            finals.append(lengths[first] == depth)
            if depth:
                parents.append(above[first])
                symbols.append(letters[first, depth - 1].astype(np.int64))
            else:
                parents.append(np.full(len(first), -1))
                symbols.append(np.zeros(len(first), np.int64))
            sizes.append(len(first))
            above = np.empty(n, np.int64)
            above[at] = node
            base += len(first)
        self.row = np.concatenate(rows)
        self.symbol = np.concatenate(symbols)
        parent = np.concatenate(parents)
        final = np.concatenate(finals)
        self.children = np.bincount(parent[parent >= 0], minlength=base)
        self.first = np.searchsorted(parent, np.arange(base), "left")  # nodes are in order of their parents
        language = np.where(final, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        edges = np.cumsum([0, *sizes])
        for depth in range(width, -1, -1):
            lo, hi = edges[depth], edges[depth + 1]
            language[lo:hi] = mix(language[lo:hi])
            if depth and hi > lo:
                arcs = mix(language[lo:hi] + self.symbol[lo:hi].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                owner = parent[lo:hi]
                cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                language[owner[cut]] += np.add.reduceat(arcs, cut)
        _, self.node, self.state = np.unique(language, return_index=True, return_inverse=True)  # a state's first node
        self.final = final[self.node]
        self.degree = self.children[self.node]
        self.arc = self.first[self.node]  # a state's arcs are those of its first node
        words = np.zeros(base + 1, np.int64)  # rows below a node: bottom-up sums
        below = final.astype(np.int64)
        for depth in range(width, 0, -1):
            lo, hi = edges[depth], edges[depth + 1]
            below += np.bincount(parent[lo:hi], below[lo:hi], minlength=base).astype(np.int64)
        words[:base] = below
        self.words = words[self.node]
        order, where = _expand(self.arc, self.degree)
        self.arc_key = order * _SYMBOLS + self.symbol[where]
        self.arc_node = where

    def follow(self, state: np.ndarray, index: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and word index after the arc to `node` (a child of the state's first node)."""
        return self.state[node], index + self.row[node] - self.row[self.node[state]]


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, count[k] numbers from start[k] on: (the k of each, the numbers)."""
    owner = np.repeat(np.arange(len(start)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, start[owner] + within


def one_edit_pairs(group: np.ndarray, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (shorter or smaller row, other row) of all rows of one partition that differ by one edit.

    Rows are distinct and in order of (partition, string). The composition of the acceptor, a transducer
    with states "no edit yet" and "one edit made", and the acceptor again: before the edit both copies
    are in the same node, so all nodes are its states; the edit leads to two arcs of a node, or to a node
    and one of its arcs; from then on both copies read the same letters. A pair of equal states accepts
    all its words at once. An inserted letter counts at the end of a run of that letter only.
    """
    machine = Acceptor(group, strings)
    nodes = np.arange(len(machine.row))
    owner, child = _expand(machine.first, machine.children)
    sides = [(machine.state[nodes[owner]], machine.row[owner], machine.state[child], machine.row[child], machine.symbol[child])]
    later = machine.first[owner] + machine.children[owner] - 1 - child
    left, right = _expand(child + 1, later)  # each arc with the later arcs of its node
    one = child[left]
    sides.append((machine.state[one], machine.row[one], machine.state[right], machine.row[right], np.full(len(one), -1)))
    q1, i1, q2, i2, banned = (np.concatenate(x) for x in zip(*sides))
    found = []
    while len(q1):
        alike = q1 == q2
        if alike.any():
            k, step = _expand(np.zeros(alike.sum(), np.int64), machine.words[q1[alike]])
            found.append((i1[alike][k] + step, i2[alike][k] + step))
            q1, i1, q2, i2, banned = (x[~alike] for x in (q1, i1, q2, i2, banned))
        both = machine.final[q1] & machine.final[q2]
        found.append((i1[both], i2[both]))
        swap = machine.degree[q1] > machine.degree[q2]
        few, many = np.where(swap, q2, q1), np.where(swap, q1, q2)
        pair, arc = _expand(machine.arc[few], machine.degree[few])
        letter = machine.symbol[arc]
        key = many[pair] * _SYMBOLS + letter
        place = np.searchsorted(machine.arc_key, key)
        place[place == len(machine.arc_key)] = 0
        meet = (letter != banned[pair]) & (machine.arc_key[place] == key if len(machine.arc_key) else False)
        pair, arc, other = pair[meet], arc[meet], machine.arc_node[place[meet]]
        swap = swap[pair]
        arc1, arc2 = np.where(swap, other, arc), np.where(swap, arc, other)
        q1, i1, q2, i2 = *machine.follow(q1[pair], i1[pair], arc1), *machine.follow(q2[pair], i2[pair], arc2)
        banned = np.full(len(q1), -1)
    if not found:
        return nodes[:0], nodes[:0]
    return tuple(np.concatenate(x) for x in zip(*found))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) in both directions, from rows in order of (part, rest); whole partitions at a time."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        parts = table["part"].combine_chunks().dictionary_encode()
        least, words, counts = table["least"].to_numpy(), table["word"].to_pylist(), table["n"].to_numpy()
        a, b = one_edit_pairs(parts.indices.to_numpy(), table["rest"].to_pylist())
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        right = np.minimum(sizes[a], sizes[b]) == least[a]  # two longer words meet in the next length's partition
        a, b = a[right], b[right]
        half = least[a] // 2
        backward = table["backward"].to_numpy(zero_copy_only=False)[a]
        once = np.fromiter((not r or words[i][:h] != words[j][:h] for r, i, j, h in zip(backward, a, b, half)), bool, len(a))
        a, b = np.concatenate((a[once], b[once])), np.concatenate((b[once], a[once]))
        column = pa.array(words)
        return pa.RecordBatch.from_arrays([column.take(pa.array(a)), column.take(pa.array(b)), pa.array(counts[b])], ["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    rows = cells = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        cells = max(cells, pc.max(pc.utf8_length(batch["rest"])).as_py())
        if rows >= CHUNK_WORDS or rows * cells >= CHUNK_CELLS:
            table = pa.Table.from_batches(held)
            last = table["part"][rows - 1]
            cut = pc.index(table["part"], last).as_py()
            if cut:
                yield pairs(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
                cells = max(pc.max(pc.utf8_length(b["rest"])).as_py() for b in held)
    if rows:
        yield pairs(pa.Table.from_batches(held))


def word_runs(docs: DataFrame) -> DataFrame:
    """(word) of each run of letters of the texts, A-Z in lower case, one letter deleted from one run in DAMAGED.

    The letter goes by the crc32 of "doc_id:run"; a null doc_id counts as an empty one. Runs that cannot
    give a word of MIN_LETTERS are left out."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_own")
    runs = docs.select(own, F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"))).alias("_run"))
    runs = runs.where(F.char_length("_run") >= MIN_LETTERS).withColumn("_run", F.translate("_run", UPPER, LOWER))
    runs = runs.withColumn("_h", F.crc32(F.concat("_own", F.lit(":"), "_run").cast("binary")))
    place = (F.col("_h") % F.char_length("_run")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), place), F.substring("_run", place + 2, F.char_length("_run")))
    return runs.select(F.when(F.col("_h") % DAMAGED == 0, less).otherwise(F.col("_run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least MIN_LETTERS letters and MIN_COUNT occurrences."""
    words = word_runs(docs).where(F.char_length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _memberships(words: DataFrame) -> DataFrame:
    """Each word in the partitions where its near words are: of two words that differ by one edit, the shorter
    of m letters, either the first m // 2 letters are equal or the last m - m // 2."""
    size = F.char_length("word")
    each = words.withColumn("least", F.explode(F.array(size.cast("long"), (size - 1).cast("long")))).where(F.col("least") >= MIN_LETTERS)
    each = each.withColumn("backward", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("least") / 2).cast("int")
    tail = (F.col("least") - half).cast("int")
    fixed = F.when(F.col("backward"), F.substring("word", size - tail + 1, tail)).otherwise(F.substring("word", F.lit(1), half))
    rest = F.when(F.col("backward"), F.reverse(F.substring("word", F.lit(1), size - tail))).otherwise(F.substring("word", half + 1, size))
    part = F.concat(F.lpad(F.col("least").cast("string"), 10, "0"), F.when(F.col("backward"), ">").otherwise("<"), fixed)
    return each.select(part.alias("part"), rest.alias("rest"), "word", "n", "least", "backward")


def _by_place(members: DataFrame) -> DataFrame:
    """The rows of partitions with too many words, in a partition for each place of the edit: all else is equal there.

    A longer word joins the partition of a letter's first place in a run only, so each pair meets once."""
    size = F.char_length("rest")
    long = F.char_length("word") > F.col("least")
    place = F.explode(F.sequence(F.lit(1), size + 1)).alias("_at")
    rows = members.select("*", place)
    here, before = F.substring("rest", F.col("_at"), F.lit(1)), F.substring("rest", F.col("_at") - 1, F.lit(1))
    without = F.concat(F.substring("rest", F.lit(1), F.col("_at") - 1), F.lit("*"), F.substring("rest", F.col("_at") + 1, size))
    grown = F.concat(F.substring("rest", F.lit(1), F.col("_at") - 1), F.lit("*"), F.substring("rest", F.col("_at"), size + 1))
    inside = F.col("_at") <= size
    first = (F.col("_at") == 1) | (here != before)
    part = lambda kind, rest: F.concat("part", F.lit(f" {kind}"), F.col("_at").cast("string"), F.lit(" "), rest)
    replaced = rows.where(inside & ~long).select(part("=", without).alias("part"), here.alias("rest"), "word", "n", "least", "backward")
    longer = rows.where(inside & long & first).select(part("+", without).alias("part"), here.alias("rest"), "word", "n", "least", "backward")
    shorter = rows.where(~long).select(part("+", grown).alias("part"), F.lit("").alias("rest"), "word", "n", "least", "backward")
    return replaced.union(longer).union(shorter)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of `words` (word, n; distinct words of MIN_LETTERS letters or more) that differ by one
    inserted, deleted or replaced code point, in both directions."""
    ship(words.sparkSession)
    members = _memberships(words)
    large = stored(members.groupBy("part").count().where(F.col("count") > GROUP_WORDS).select("part"), "large-parts")
    if not large.isEmpty():
        members = salted_join(members, large, ["part"], "left_anti").union(_by_place(salted_join(members, large, ["part"], "left_semi")))
    dealt = members.repartition("part").sortWithinPartitions("part", "rest")
    return dealt.mapInArrow(_compose, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of docs (doc_id, text) with the frequent form each is a variant of.

    Columns: word; form (the near word of largest n, ties by code points, if its n is FORM_FACTOR times
    the word's), root (the last of the chain of forms, the word itself without one), n, n_near, form_n.
    Null and empty texts and those without words give none; an empty table gives no rows; repeated rows
    count again; a very long run is a word like others; columns other than doc_id and text are not read.

    The vocabulary is written once. Words are dealt to partitions by the half of their letters that an
    edit leaves alone, in both directions; a partition is an initial state of the acceptor that is
    composed with the one-edit transducer and itself. Partitions of more than GROUP_WORDS words are split
    by the place of the edit. Chains of forms are followed by doubling: n grows FORM_FACTOR times a step.
    """
    docs = docs.select("doc_id", "text")
    words = stored(vocabulary(docs), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("_top"))
    high = -F.col("_top.less") >= FORM_FACTOR * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", F.when(high, F.col("_top.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, -F.col("_top.less")).alias("form_n")
    )
    rows = stored(rows, "forms")
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 0
    steps = int(math.log(max(top, 1), FORM_FACTOR)) + 1  # forms in a chain at most
    for _ in range((steps - 1).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
