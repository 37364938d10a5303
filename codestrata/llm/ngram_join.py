"""N-gram Jaccard join by prefix tree, and the groups of near copies it links.

Which documents share enough n-grams to be linked at all is found by two exchanges of packed
n-gram hashes; the few that remain are ordered globally by document frequency and joined by tries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codestrata.llm import textkit
from codestrata.llm.components import components
from codestrata.llm.storage import lean, ship, shuffle_parts, stored

FLUSH_HASHES = 1 << 19  # n-gram hashes a task packs at a time
BLOCK = 512  # documents of one trie
PROBES = 512  # documents that probe one trie in one task
TABLE_CELLS = 1 << 20  # n-grams of a trie's edges, times the probes that go down them together
NO_ID = -(2**63)  # a null id inside packed arrays

_PACKED = pa.schema(
    [("slot", pa.int32()), ("known", pa.bool_()), ("rows", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())]
)
_PACKED_SQL = "slot int, known boolean, rows binary, lens binary, ids binary, marks binary, sizes binary, grams binary"
_SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("size", pa.int64()), ("grams", pa.binary())])
_SETS_SQL = "row long, doc_id long, mark long, size long, grams binary"


def needed(size_x, size_y, percent: int):
    """The smallest intersection of two sets of these sizes with a Jaccard similarity of percent / 100."""
    return -((-percent * (size_x + size_y)) // (100 + percent))


def _slots(values: np.ndarray, slots: int) -> np.ndarray:
    return (textkit.mix(values.astype(np.uint64)) % np.uint64(slots)).astype(np.int64)


def _ranges(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return starts, np.append(starts[1:], len(sorted_keys))


def _by_slot(slots: np.ndarray, rows: np.ndarray, grams: np.ndarray, known: bool) -> list[dict]:
    """Packed rows, one for each slot, of (row, gram) pairs; pairs of a row are together."""
    order = np.argsort(slots.astype(np.uint32), kind="stable")
    slots, rows, grams = slots[order], rows[order], grams[order]
    out = []
    for a, b in zip(*_ranges(slots)):
        starts, ends = _ranges(rows[a:b])
        out.append(
            {"slot": int(slots[a]), "known": known, "rows": rows[a:b][starts].tobytes(), "lens": (ends - starts).astype(np.int32).tobytes(),
             "ids": b"", "marks": b"", "sizes": b"", "grams": grams[a:b].tobytes()}
        )
    return out


def _pack(size: int, slots: int):
    """Texts to packed n-gram sets. A hash found in two texts of the same flush is known to be shared:
    it goes with its texts, and only once (row -1) to its slot, so a frequent n-gram costs a slot one
    entry for each flush and not one for each document."""

    def flush(rows, ids, marks, sizes, grams) -> pa.RecordBatch:
        rows, ids, marks, sizes = (np.array(x, np.int64) for x in (rows, ids, marks, sizes))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(rows, sizes)
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        same = np.zeros(len(grams) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        shared = np.zeros(len(grams), bool)
        shared[order] = same[1:] | same[:-1]
        first = ordered[same[1:] & ~same[:-1]]
        out = _by_slot(
            np.concatenate([_slots(grams[~shared], slots), _slots(first, slots)]),
            np.concatenate([owner[~shared], np.full(len(first), -1, np.int64)]),
            np.concatenate([grams[~shared], first]),
            False,
        )
        kept = np.concatenate(([0], np.cumsum(shared)))
        ends = np.cumsum(sizes)
        home = _slots(rows, slots)
        ordered_home = np.argsort(home, kind="stable")
        for a, b in zip(*_ranges(home[ordered_home])):
            own = ordered_home[a:b]
            out.append(
                {"slot": int(home[own[0]]), "known": True, "rows": rows[own].tobytes(), "ids": ids[own].tobytes(), "marks": marks[own].tobytes(), "sizes": sizes[own].tobytes(),
                 "lens": (kept[ends[own]] - kept[ends[own] - sizes[own]]).astype(np.int32).tobytes(),
                 "grams": b"".join(grams[ends[k] - sizes[k] : ends[k]][shared[ends[k] - sizes[k] : ends[k]]].tobytes() for k in own)}
            )
        return pa.RecordBatch.from_pylist(out, _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rows, ids, marks, sizes, grams, held = [], [], [], [], [], 0
        for batch in batches:
            row, doc, mark = batch["row"].to_numpy(), batch["doc_id"].fill_null(NO_ID).to_numpy(), batch["mark"].to_numpy()
            for first, data, offsets in textkit.chunks(batch["text"]):
                sets, counts = textkit.shingle_sets(data, offsets, size)
                rows.extend(row[first : first + len(counts)])
                ids.extend(doc[first : first + len(counts)])
                marks.extend(mark[first : first + len(counts)])
                sizes.extend(counts)
                grams.append(sets)
                held += len(sets)
                if held >= FLUSH_HASHES:
                    yield flush(rows, ids, marks, sizes, grams)
                    rows, ids, marks, sizes, grams, held = [], [], [], [], [], 0
        if rows:
            yield flush(rows, ids, marks, sizes, grams)

    return run


def _arrays(table: pa.Table, column: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table[column].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _find_shared(slots: int):
    """One slot of n-gram hashes: tells each document which of its hashes another document has."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        known = table["known"].to_numpy()
        through = table.filter(pa.array(known))
        loose = table.filter(pa.array(~known))
        grams, rows = _arrays(loose, "grams", np.uint64), np.repeat(_arrays(loose, "rows", np.int64), _arrays(loose, "lens", np.int32))
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        same = np.zeros(len(grams) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        hit = order[same[1:] | same[:-1]]
        hit = hit[rows[hit] >= 0]
        hit = hit[np.argsort(rows[hit], kind="stable")]
        return pa.concat_tables([through.cast(_PACKED), pa.Table.from_pylist(_by_slot(_slots(rows[hit], slots), rows[hit], grams[hit], False), _PACKED)])

    return run


def _gather(percent: int):
    """One slot of documents: their shared hashes, where they are enough for any link."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        heads = table.filter(table["known"])
        rows, ids, marks, sizes = (_arrays(heads, c, np.int64) for c in ("rows", "ids", "marks", "sizes"))
        owner, grams = np.repeat(_arrays(table, "rows", np.int64), _arrays(table, "lens", np.int32)), _arrays(table, "grams", np.uint64)
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        first, last = np.searchsorted(owner, rows, "left"), np.searchsorted(owner, rows, "right")
        enough = (100 * (last - first) >= percent * sizes) & (sizes > 0)
        return pa.Table.from_arrays(
            [
                pa.array(rows),
                pa.array(ids, mask=ids == NO_ID),
                pa.array(marks),
                pa.array(sizes),
                pa.array([grams[a:b].tobytes() if e else None for a, b, e in zip(first, last, enough)], pa.binary()),
            ],
            schema=_SETS,
        )

    return run


def shared_sets(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, mark, size, grams) for each document: a hash of its text, its set's size, and the sorted hashes that occur in
    other documents, null unless they are percent of the set (less cannot be linked)."""
    slots = 2 * shuffle_parts(docs.sparkSession)
    picked = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _mark(F.col(text_col)).alias("mark"),
        F.col(text_col).cast("string").alias("text"),
    )
    packed = picked.mapInArrow(_pack(size, slots), _PACKED_SQL)
    told = packed.groupBy("slot").applyInArrow(_find_shared(slots), _PACKED_SQL)
    return told.groupBy("slot").applyInArrow(_gather(percent), _SETS_SQL)


def _mark(text):
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges starts to ends, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Trie:
    """A path-compressed prefix tree of globally ordered n-gram sets, none empty.

    Nodes are numbered level by level, so the children of a node are side by side, and arrays hold for
    each node: the grams on its edge (as numbers in `known`), its children, the sets that end at it, and of the sets at or
    below it the smallest size and the most grams that follow the edge.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())
        lengths = np.array([len(sets[k]) for k in order], np.int64)
        lcp = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = sets[order[i - 1]], sets[order[i]]
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            lcp[i] = other[0] if len(other) else n
        sizes = np.asarray(sizes)[order]
        edges, edge, child, ends, smallest, rest = [], [0], {}, [], [], []
        level, made = ([(-1, 0, len(sets), 0)] if sets else []), 0
        while level:
            below = []
            for parent, lo, hi, depth in level:
                cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == depth)), hi]
                first = made
                for a, b in zip(cuts, cuts[1:]):
                    end = int(lcp[a + 1 : b].min()) if b - a > 1 else int(lengths[a])
                    here = int((lengths[a:b] == end).sum())  # sets that end here sort first
                    edges.append(sets[order[a]][depth:end])
                    edge.append(edge[-1] + end - depth)
                    ends.append((a, a + here))
                    smallest.append(int(sizes[a:b].min()))
                    rest.append(int(lengths[a:b].max()) - end)
                    if a + here < b:
                        below.append((made, a + here, b, end))
                    made += 1
                child[parent] = first, made
            level = below
        self.roots = child.get(-1, (0, 0))[1]
        self.order, self.sizes = np.array(order, np.int64), sizes
        grams = np.concatenate(edges) if edges else np.zeros(0, np.uint64)
        self.known, self.grams = np.unique(grams, return_inverse=True)
        self.edge = np.array(edge, np.int64)
        self.ends = np.array(ends, np.int64).reshape(-1, 2)
        self.smallest, self.rest = np.array(smallest, np.int64), np.array(rest, np.int64)
        self.child = np.zeros((made, 2), np.int64)
        for node, span in child.items():
            if node >= 0:
                self.child[node] = span

    def matches(self, probes: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, set) of all pairs whose similarity reaches percent, some probes at a time.

        Goes down level by level, with many probes side by side. Overlap is counted once for all sets
        that share a path. A probe leaves a subtree when even all that remains, of the probe after its
        last match or of the longest set below, cannot reach what the smallest set there needs."""
        # A level's edges hold at most all of the trie's n-grams, which near copies repeat: `known` is far fewer.
        step = max(1, TABLE_CELLS // max(1, len(self.grams)))
        for a in range(0, len(probes) if len(self.known) else 0, step):
            who, what = self._descend(probes[a : a + step], np.asarray(sizes[a : a + step]), percent)
            yield who + a, self.order[what]

    def _descend(self, probes: list[np.ndarray], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        # places[p, g]: where probe p has gram g of the trie, -1 if it has not.
        places = np.full((len(probes), len(self.known)), -1, np.int32)
        for p, grams in enumerate(probes):
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            has = np.flatnonzero(self.known[at] == grams)
            places[p, at[has]] = has
        lengths = np.array([len(g) for g in probes])
        nodes, who = np.tile(np.arange(self.roots), len(probes)), np.repeat(np.arange(len(probes)), self.roots)
        overlap, last = np.zeros(len(nodes), np.int64), np.full(len(nodes), -1, np.int64)
        found = []
        while len(nodes):
            starts, stops = self.edge[nodes], self.edge[nodes + 1]
            at = places[np.repeat(who, stops - starts), self.grams[_spread(starts, stops)]]
            cut = np.concatenate(([0], np.cumsum(stops - starts)[:-1]))
            overlap = overlap + np.add.reduceat(at >= 0, cut, dtype=np.int64)
            last = np.maximum(last, np.maximum.reduceat(at, cut))
            own = self.ends[nodes]
            sets = _spread(own[:, 0], own[:, 1])
            if len(sets):
                n = own[:, 1] - own[:, 0]
                shared, asked = np.repeat(overlap, n), np.repeat(who, n)
                same = 100 * shared >= percent * (sizes[asked] + self.sizes[sets] - shared)
                found.append((asked[same], sets[same]))
            reach = overlap + np.minimum(lengths[who] - 1 - last, self.rest[nodes])
            go = (reach >= needed(sizes[who], self.smallest[nodes], percent)) & (self.child[nodes, 1] > 0)
            down = self.child[nodes[go]]
            n = down[:, 1] - down[:, 0]
            nodes, who, overlap, last = _spread(down[:, 0], down[:, 1]), np.repeat(who[go], n), np.repeat(overlap[go], n), np.repeat(last[go], n)
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)


class _Union:
    def __init__(self):
        self.of: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.of.setdefault(x, x) != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.of[max(x, y)] = min(x, y)


def _link(percent: int):
    """One block: probes against the trie of its members. Emits, for each component that is linked here, the smallest one it is tied to."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows, comps, sizes = (table[c].to_numpy() for c in ("row", "comp", "size"))
        probe = table["probe"].to_numpy()
        sets = [np.frombuffer(x, np.int64).view(np.uint64) for x in table["grams"].to_pylist()]
        members = np.flatnonzero(~probe)
        members = members[np.unique(rows[members], return_index=True)[1]]
        probes = np.flatnonzero(probe)
        if not len(probes):
            probes = members
        trie = Trie([sets[k] for k in members], sizes[members])
        tied = _Union()
        for who, what in trie.matches([sets[p] for p in probes], sizes[probes], percent):
            for p, k in zip(probes[who].tolist(), members[what].tolist()):
                if tied.find(int(comps[k])) != tied.find(int(comps[p])):
                    tied.join(int(comps[p]), int(comps[k]))
        links = [(x, y) for x in tied.of if (y := tied.find(x)) != x]
        return pa.Table.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def _to_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, size, grams binary) to (row, size, gram): one row for each n-gram."""
    schema = pa.schema([("row", pa.int64()), ("size", pa.int64()), ("gram", pa.int64())])
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            grams = [np.frombuffer(x, np.int64) for x in part["grams"].to_pylist()]
            n = [len(g) for g in grams]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part["row"].to_numpy(), n)), pa.array(np.repeat(part["size"].to_numpy(), n)), pa.array(np.concatenate(grams))],
                schema=schema,
            )


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, size, ordered array of longs) with the array as bytes."""
    schema = pa.schema([("row", pa.int64()), ("size", pa.int64()), ("grams", pa.binary())])
    for batch in batches:
        lists = batch["grams"]
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        packed = [values[a:b].astype(np.int64).tobytes() for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch["row"], batch["size"], pa.array(packed, pa.binary())], schema=schema)


def _blocks(sets: DataFrame, groups: DataFrame, probes: DataFrame | None, percent: int) -> DataFrame:
    """Links found in each group. groups: (home, block, row, comp) members; probes: (home, block, row, comp)."""
    members = groups.withColumn("probe", F.lit(False))
    if probes is None:
        asked = members.withColumn("turn", F.lit(0))
    else:
        many = probes.groupBy("home", "block").agg(F.ceil(F.count("*") / PROBES).alias("turns"))
        turned = probes.join(many, ["home", "block"]).select(
            "home", "block", "row", "comp", F.lit(True).alias("probe"), F.expr("int(pmod(xxhash64(row), turns))").alias("turn")
        )
        asked = members.join(many, ["home", "block"]).select(
            "home", "block", "row", "comp", "probe", F.explode(F.expr("sequence(0, int(turns) - 1)")).alias("turn")
        ).unionByName(turned)
    return (
        asked.join(sets, "row")
        .select("home", "block", "turn", "row", "comp", "size", "probe", "grams")
        .groupBy("home", "block", "turn")
        .applyInArrow(_link(percent), "u long, v long")
    )


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of `size`-word shingles have a Jaccard similarity of percent / 100.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; sets and similarity are exact up to
    collisions of 64-bit hashes. Returns one row per row of `docs`: doc_id, n_shingles, component_id
    (the smallest doc_id reachable by links), and mark (a hash of the text), row (tells rows
    apart) and group (a number for each component).

    A null or empty text, or one without words, has the empty set and no link; fewer words than
    `size` are one shingle. Rows that repeat a doc_id are documents of their own, linked if alike. A
    null doc_id stays null in the result and is not counted as the smallest. Other columns of
    `docs` are not read. An empty table gives an empty result.

    1. Packed hashes of all sets are exchanged twice. A document keeps those of its hashes that
       another document has; with less than percent of its set it has no link. Most end here.
    2. Equal sets become one. What is left is ordered globally by (document frequency, hash).
       Documents that share one of their rarest hashes, as many as a link cannot do without, are
       candidates (prefix filter).
    3. A document goes with one of the candidates that are the first with a rare hash, the one most
       documents share, in blocks of bounded size; each block's trie is probed (`Trie`). Links give
       components.
    4. Candidates still in different components, if any, are checked likewise, block by block, so
       that no link is lost; a large group of near copies was tied before and needs no pairs.
    """
    ship(docs.sparkSession)
    every = stored(shared_sets(docs, size, percent, id_col, text_col), "ngram-sets")
    near = every.where("grams is not null")
    whole = F.length("grams") == 8 * F.col("size")
    keyed = near.select("row", "doc_id", F.when(whole, F.md5("grams")).otherwise(F.concat(F.lit("row "), F.col("row"))).alias("same"))
    firsts = keyed.groupBy("same").agg(F.min("row").alias("first"))
    members = stored(keyed.join(firsts, "same").select("row", "doc_id", "first"), "ngram-copies")

    lone = near.join(members.where("row = first").select("row"), "row", "left_semi").select("row", "size", "grams")
    single = lone.mapInArrow(_to_longs, "row long, size long, gram long")
    # A first copy's hashes may have been shared by its copies only: count again without them.
    frequent = single.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ordered = (
        single.join(frequent, "gram")
        .groupBy("row", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("by_df"))
        .where(F.expr(f"100 * size(by_df) >= {percent} * size"))
    )
    # The missing hashes, which no other document has, would come first in the order.
    rarest = F.expr(f"slice(by_df, 1, int(size - ceil({percent} * size / 100) + 1 - (size - size(by_df))))")
    rare_first = stored(
        ordered.select(
            "row", "size", F.transform(rarest, lambda x: x["gram"]).alias("rare"), F.reverse(F.transform("by_df", lambda x: x["gram"])).alias("grams")
        ),
        "ngram-ordered",
    )
    sets = rare_first.select("row", "size", "grams").mapInArrow(_pack_sets, "row long, size long, grams binary")
    rare = rare_first.select("row", F.explode("rare").alias("gram"))

    centers = rare.groupBy("gram").agg(F.min("row").alias("home"), F.count("*").alias("n")).where("n > 1").drop("n")
    votes = stored(rare.join(centers, "gram").groupBy("row", "home").agg(F.count("*").alias("votes")), "ngram-votes")
    popular = votes.groupBy("home").agg(F.count("*").alias("fans"))
    best = stored(votes.join(popular, "home").groupBy("row").agg(F.max_by("home", F.struct("fans", "votes", -F.col("home"))).alias("home")), "ngram-best")
    many = best.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.max(F.expr("row = home")).alias("inside"))
    homes = stored(
        best.join(many, "home").select("home", F.expr("int(pmod(xxhash64(row), blocks))").alias("block"), "row", F.lit(True).alias("own"))
        # Each block also has the document that the group is named after.
        .unionByName(
            many.where("blocks > 1 or not inside")
            .select("home", F.explode(F.expr("sequence(0, int(blocks) - 1)")).alias("block"), F.col("home").alias("row"), F.lit(False).alias("own"))
        ),
        "ngram-blocks",
    )
    # A document may be in a block twice, as a member and as the name: `_link` takes it once.
    tied = components(stored(_blocks(sets, homes.select("home", "block", "row", F.col("row").alias("comp")), None, percent), "ngram-links"))

    def labelled(df: DataFrame, key: str, ties: DataFrame) -> DataFrame:
        ties = ties.select(F.col("node").alias(key), F.col("component").alias("tie"))
        return df.join(ties, key, "left").withColumn("comp", F.coalesce("tie", key)).drop("tie")

    # Labels and blocks are joined to documents, before these become a row for each of their rare hashes.
    where = stored(labelled(rare_first.select("row", "rare").join(homes.where("own").drop("own"), "row"), "row", tied), "ngram-seats")
    apart = where.select("row", "comp", "home", "block", F.explode("rare").alias("gram"))
    mixed = apart.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("gram")
    apart = stored(apart.join(mixed, "gram"), "ngram-apart")
    # Which blocks hold, under the same rare hash, a document of a larger component? Put together for each
    # hash first, then for each document, as near copies share many hashes.
    seats = apart.groupBy("gram", "home", "block").agg(F.max("comp").alias("top"))
    seats = seats.groupBy("gram").agg(F.collect_list(F.struct("home", "block", "top")).alias("seats"))
    larger = F.transform(F.filter("seats", lambda s: s["top"] > F.col("comp")), lambda s: F.struct(s["home"].alias("home"), s["block"].alias("block")))
    asks = apart.select("gram", "row", "comp").join(seats, "gram").select("row", "comp", larger.alias("seats")).where("size(seats) > 0").groupBy("row", "comp").agg(
        F.array_distinct(F.flatten(F.collect_list("seats"))).alias("seats")
    ).select("row", "comp", F.inline("seats")).select("home", "block", "row", "comp")
    asked = stored(asks, "ngram-asks")
    # These links are between components, so only those are put together, not all documents again.
    more = components(stored(_blocks(sets, where.select("home", "block", "row", "comp"), asked, percent), "ngram-links"))

    labels = labelled(labelled(members, "first", tied), "comp", more).select("row", "doc_id", F.col("comp").alias("component"))
    smallest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(smallest, "component").select("row", "component_id", "component")
    return every.join(labels, "row", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark", "row",
        F.coalesce("component", "row").alias("group"),
    )


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay when one document of each group of linked ones does, the one of
    smallest doc_id, null last; all columns stay. Of rows that repeat doc_id and text one stays, unless
    they have no words: those are linked with nothing, so all stay."""
    linked = ngram_join(docs, size, percent, id_col, text_col)
    no_id = F.lit(NO_ID)
    # A group is named by its smallest doc_id; a group without any, by nothing: then texts tell.
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    groups = linked.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("group")).alias("group")).agg(F.min(first).alias("first"))
    stay = groups.select(F.coalesce("first.doc_id", no_id).alias("_id"), F.col("first.mark").alias("_mark"), F.lit(1).alias("_most"))
    bare = linked.where("n_shingles = 0").select(F.coalesce("doc_id", no_id).alias("_id"), F.col("mark").alias("_mark"), F.lit(None).cast("int").alias("_most"))
    stay = stay.unionByName(bare).groupBy("_id", "_mark").agg(F.max("_most").alias("_most"))
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.coalesce(F.col(id_col).cast("long"), no_id).alias("_id"), _mark(F.col(text_col)).alias("_mark")
    )
    same = Window.partitionBy("_id", "_mark").orderBy("_mark")
    kept = given.join(stay, ["_id", "_mark"]).withColumn("_nth", F.row_number().over(same)).where("_most is null or _nth <= _most")
    return kept.select([F.col(n).alias(c) for c, n in names.items()])
