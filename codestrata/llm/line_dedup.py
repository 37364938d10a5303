"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.llm.storage import new_dir, ship, shuffle_parts, stored
from codestrata.llm.textkit import mix

MIN_CHARS = 10
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1  # stands for a null doc_id: after all others
SLOTS = 4
KICKS = 500
SHARD_LINES = 1_000_000


class CuckooFilter:
    """Set of 64-bit hashes with deletion: 16-bit fingerprints in buckets of four, each in one of two
    buckets. May report a hash it does not hold; never misses one it holds."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (hashes & mask).astype(np.int64)
        return prints, first, self._other(prints, first)

    def _other(self, prints, buckets):
        return buckets ^ (mix(np.asarray(prints).astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(hashes)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def _fill(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Put what fits into free slots; returns which did."""
        order = np.argsort(buckets, kind="stable")
        sorted_buckets = buckets[order]
        starts = np.searchsorted(sorted_buckets, sorted_buckets, "left")
        rank = np.arange(len(order)) - starts
        free = np.cumsum(self.table[sorted_buckets] == 0, axis=1) == (rank + 1)[:, None]
        free &= self.table[sorted_buckets] == 0
        fits = free.any(axis=1)
        self.table[sorted_buckets[fits], free[fits].argmax(axis=1)] = prints[order][fits]
        done = np.zeros(len(order), bool)
        done[order[fits]] = True
        return done

    def insert(self, hashes: np.ndarray) -> bool:
        """Add hashes, each once. False if the filter is too full: then it must be built anew, larger."""
        prints, a, b = self._places(hashes)
        left = ~self._fill(prints, a)
        prints, a, b = prints[left], a[left], b[left]
        left = ~self._fill(prints, b)
        rng = np.random.default_rng(len(hashes))
        for fingerprint, bucket in zip(prints[left], b[left]):
            for _ in range(KICKS):
                slot = int(rng.integers(SLOTS))
                fingerprint, self.table[bucket, slot] = self.table[bucket, slot], fingerprint
                bucket = int(self._other(np.array([fingerprint]), bucket)[0])
                empty = np.flatnonzero(self.table[bucket] == 0)
                if len(empty):
                    self.table[bucket, empty[0]] = fingerprint
                    break
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Remove hashes that were added."""
        for fingerprint, *pair in zip(*self._places(hashes)):
            for bucket in pair:
                held = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def buckets_for(n: int) -> int:
    """A power of two that n hashes fill to at most three quarters."""
    return 1 << max(6, int(np.ceil(np.log2(max(1, n) / (0.75 * SLOTS)))))


class ShardFilter:
    """The cuckoo filters of one shard: as a filter cannot grow, a larger one is opened when the last is
    three quarters full. Stored as a count, the sizes and the filters' tables."""

    def __init__(self, data: bytes | None = None):
        self.parts: list[CuckooFilter] = []
        if data:
            n = int(np.frombuffer(data, "<i8", 1)[0])
            at = 8 + 8 * n
            for size in np.frombuffer(data, "<i8", n, 8):
                self.parts.append(CuckooFilter.load(data[at : at + int(size)]))
                at += int(size)

    def dump(self) -> bytes:
        tables = [p.dump() for p in self.parts]
        return b"".join([np.array([len(tables), *map(len, tables)], "<i8").tobytes(), *tables])

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for part in self.parts:
            found |= part.contains(hashes)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        size = buckets_for(len(hashes))
        if self.parts:
            last = self.parts[-1].table
            size = max(size, 2 * len(last))
            if np.count_nonzero(last) + len(hashes) <= 0.75 * last.size:
                grown = CuckooFilter(table=last.copy())
                if grown.insert(hashes):
                    self.parts[-1] = grown
                    return
        while not (opened := CuckooFilter(size)).insert(hashes):
            size *= 2
        self.parts.append(opened)

    def delete(self, hashes: np.ndarray) -> None:
        """Remove hashes that were added. The part that holds a hash always says so; where a second one
        seems to, neither is touched: a fingerprint too many costs a false alarm, one too few a miss."""
        held = np.array([part.contains(hashes) for part in self.parts]).reshape(len(self.parts), len(hashes))
        sure = held.sum(axis=0) == 1
        for part, own in zip(self.parts, held):
            part.delete(hashes[own & sure])


def line_key(line: bytes) -> bytes | None:
    """Digest of a line, stripped of white space and with A-Z in lower case; None if it is too short to count."""
    line = line.strip(BLANKS).lower()
    if len(line) < MIN_CHARS or len(line) < 4 * MIN_CHARS and len(line.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return hashlib.md5(line).digest()


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (key, doc_id), each once for a document."""
    for batch in batches:
        for a in range(0, len(batch), 512):
            keys, docs = [], []
            for doc, text in zip(batch["doc_id"][a : a + 512].to_pylist(), batch["text"].slice(a, 512).cast(pa.binary())):
                own = set(map(line_key, (text.as_py() or b"").split(b"\n"))) - {None}
                keys += own
                docs += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], ["key", "doc_id"])


def _hashes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in table["key"].to_pylist()), "<u8")


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Which keys of a shard its filters may hold."""
    seen = np.zeros(len(keys), bool)
    if len(filters) and len(keys):
        seen = ShardFilter(filters["filter"][0].as_py()).contains(_hashes(keys))
    return pa.table({"key": keys["key"].cast(pa.binary()), "shared": keys["shared"], "seen": pa.array(seen, pa.bool_())})


def _update(changes: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filters after its new keys (change 1) and gone keys (change -1)."""
    change, hashes = changes["change"].to_numpy(), _hashes(changes)
    held = ShardFilter(filters["filter"][0].as_py() if len(filters) else None)
    held.delete(hashes[change < 0])
    held.insert(hashes[change > 0])
    shard = (changes if len(changes) else filters)["shard"][0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([held.dump()], pa.binary())})


class LineIndex:
    """Which lines are held by which documents, in a folder on shared storage.

    refs-n      (key, doc_id, change): lines of documents, change 1 when added, below 0 when deleted.
    repeats-n   keys of a batch that two of its documents hold or that the filters may hold.
    filters-n   after n changes: for each shard of the keys, cuckoo filters of the keys with a reference.

    A new batch asks the filters first; only keys that they may hold meet the stored references, and
    only `repeats` do when documents are cleaned. The number of shards follows from the first batch,
    SHARD_LINES references to one, unless it is given.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int | None = None):
        self.spark, self.folder, self.shards = spark, folder.rstrip("/"), shards
        self.version = 0
        self.added: list[int] = []  # the versions that are batches of documents
        ship(spark)

    def _shard(self):
        return F.expr(f"int(pmod(xxhash64(key), {self.shards}))").alias("shard")

    def _filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, filter binary")
        return self.spark.read.schema("shard int, filter binary").parquet(f"{self.folder}/filters-{self.version}")

    def _log(self, versions: int) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], "key binary, doc_id long, change int")
        paths = [f"{self.folder}/refs-{k}" for k in range(1, versions + 1)]
        return self.spark.read.schema("key binary, doc_id long, change int").parquet(*paths)

    def references(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Live (key, doc_id, n), exact; as of a version; of some keys only.

        Rows of those keys are stored before they are summed: their join is one of plain shuffles, which adaptive
        execution may split, and the sums then shuffle by key and document."""
        log = self._log(self.version if version is None else version)
        if keys is not None:
            log = stored(log.join(keys, "key", "left_semi"), "lines-asked")
        return log.groupBy("key", "doc_id").agg(F.sum("change").cast("int").alias("n")).where("n > 0")

    def holders(self) -> DataFrame:
        """(key, first_doc, last_doc) of live keys: the exact counts behind the filters."""
        return self.references().groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    def repeats(self) -> DataFrame:
        """Keys that a batch or the filters reported as held by several documents, once for each batch that did;
        all such keys and some more."""
        if not self.added:
            return self.spark.createDataFrame([], "key binary")
        return self.spark.read.schema("key binary").parquet(*(f"{self.folder}/repeats-{k}" for k in self.added))

    def _advance(self, changed: DataFrame) -> None:
        """Write the next version of the filters. changed: (key, change)."""
        rows = changed.withColumn("shard", self._shard())
        new = rows.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_update, "shard int, filter binary")
        new.write.parquet(f"{self.folder}/filters-{self.version + 1}")
        self.version += 1

    def _write(self, changes: DataFrame) -> DataFrame:
        """Append (key, doc_id, change) to the references and read them."""
        path = f"{self.folder}/refs-{self.version + 1}"
        changes.write.parquet(path)
        return self.spark.read.schema("key binary, doc_id long, change int").parquet(path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Insert documents whose doc_ids the index does not hold yet.

        The batch's keys are counted on the map side, so a line in a third of all documents is one key
        of its shard. Keys the filter has not seen are new; those it may hold are looked up in the
        stored references, which settles its false alarms."""
        picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        refs = picked.mapInArrow(_references, "key binary, doc_id long").withColumn("change", F.lit(1))
        refs = self._write(refs)
        if self.shards is None:
            self.shards = max(shuffle_parts(self.spark), -(-refs.count() // SHARD_LINES))
        keys = refs.groupBy("key").agg((F.min("doc_id") < F.max("doc_id")).alias("shared"))
        if self.version:
            asked = keys.withColumn("shard", self._shard())
            keys = asked.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_probe, "key binary, shared boolean, seen boolean")
        else:
            keys = keys.withColumn("seen", F.lit(False))
        keys = stored(keys, "lines-told")
        keys.where("shared or seen").select("key").write.parquet(f"{self.folder}/repeats-{self.version + 1}")
        fresh = keys.where("not seen").select("key")
        if self.version:  # false alarms: seen by a filter, but without a live reference
            alarms = keys.where("seen").select("key")
            fresh = fresh.union(alarms.join(self.references(keys=alarms).select("key").distinct(), "key", "left_anti"))
        self.added.append(self.version + 1)
        self._advance(fresh.withColumn("change", F.lit(1)))

    def delete(self, doc_ids: DataFrame) -> None:
        """Take back documents (one column of doc_ids): a key that no document holds any more leaves its filter."""
        named = doc_ids.select(F.coalesce(F.col(doc_ids.columns[0]).cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        gone = self.references().join(named, "doc_id", "left_semi").select("key", "doc_id", (-F.col("n")).alias("change"))
        touched = self._write(gone).select("key").distinct()
        live = self.references(self.version + 1).select("key").distinct()
        self._advance(touched.join(live, "key", "left_anti").withColumn("change", F.lit(-1)))

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """`docs` without the lines that an indexed document with a smaller doc_id holds; adds n_lines, n_dropped.

        A line counts by its key: stripped of `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case, of at
        least 10 code points. Of a key held by two documents or more, all lines go except those of
        the smallest doc_id. Other lines stay, joined by newlines. A null or empty text is one empty
        line (and stays null or empty). Rows that repeat a doc_id are one document here: each keeps
        what the document keeps. All rows with a null doc_id are one document after all others.
        Other columns pass through, but for those named n_lines and n_dropped. An empty table gives no rows.

        Only keys in `repeats` meet the references. What they decide is stored, so that the join of a line
        held by a third of all documents is one of plain shuffles.
        """
        docs = docs.drop(*({"n_lines", "n_dropped"} & set(docs.columns)))
        mark = "_" * max(map(len, docs.columns))  # longer than any of their names
        gone, doc = f"{mark}_gone", f"{mark}_doc"
        live = stored(self.references(keys=self.repeats()).select("key", "doc_id"), "lines-live")
        repeated = live.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        repeated = stored(repeated.where("first_doc <> last_doc").select("key", "first_doc"), "lines-repeated")
        drops = live.join(repeated, "key").where("doc_id <> first_doc")
        drops = drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("key").alias(gone))
        joined = docs.join(drops, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(doc), "left").drop(doc)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return joined.mapInArrow(_clean(text_col, gone), f"{fields}, n_lines long, n_dropped long")


def _clean(text_col: str, gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                at = batch.schema.get_field_index(text_col)
                texts, lines, dropped = [], [], []
                for text, drop in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch[gone].to_pylist()):
                    own = (text or b"").split(b"\n")
                    lines.append(len(own))
                    if drop:
                        lost = set(drop)
                        kept = [x for x in own if line_key(x) not in lost]
                        texts.append(b"\n".join(kept))
                        dropped.append(len(own) - len(kept))
                    else:
                        texts.append(text)
                        dropped.append(0)
                columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != gone}
                columns[text_col] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                columns |= {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def line_dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Index `docs` in `folder` (a new one in the shared folder by default) in two batches, the lower and the
    upper half of the doc_ids (null ids with the upper), and clean them."""
    index = LineIndex(docs.sparkSession, folder or new_dir(docs.sparkSession, "lines"))
    middle = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), 0.5)).first()[0]
    lower = F.coalesce(F.col("doc_id").cast("long") <= F.lit(middle), F.lit(False))
    index.add(docs.where(lower))
    index.add(docs.where(~lower))
    return index.clean(docs)
