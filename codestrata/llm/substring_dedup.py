"""Substring dedup by content-defined chunking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codestrata.llm import textkit
from codestrata.llm.storage import ship, stored

REACH = 32  # bytes that decide about a cut
RUN_WORDS = 51  # a repeated passage counts from so many words on
SEED_WORDS = 17  # of a seed: they have 33 bytes at least, so its hash, over REACH bytes, sees nothing else
NO_ID = 2**63 - 1  # stands for a null doc_id: after all others

_GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash, h = 2 * h + gear[byte] mod 2 ** 32, after each byte: the sum over the last 32 bytes
    of gear[byte] shifted by their distance, built by doubling the reach."""
    sums = _GEAR[data]
    reach = 1
    while reach < REACH:
        grown = sums.copy()
        grown[reach:] += sums[:-reach] << np.uint32(reach)
        sums, reach = grown, 2 * reach
    return sums


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word of the seed) of every run of `run_words` words within one text: of the seeds in the
    run, the one whose gear hash is least, of equal ones the last. Only the run's own bytes decide."""
    n, wide = len(starts) - run_words + 1, run_words - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = gear_hashes(data)[ends - 1].astype(np.uint64) << np.uint64(32) | np.arange(len(ends), dtype=np.uint64)[::-1]
    reach = 1
    while reach < wide:  # the least of `reach` neighbours, from two that may overlap
        step = min(reach, wide - reach)
        least, reach = np.minimum(least[:-step], least[step:]), reach + step
    first = np.arange(n)
    text = np.searchsorted(upto, first, "right")
    first = first[first + run_words <= upto[text]]
    return first, len(ends) - 1 - (least[first + SEED_WORDS - 1] & np.uint64(2**32 - 1)).astype(np.int64)


class Chunks(NamedTuple):
    """The content-defined chunks of texts laid end to end."""

    text: np.ndarray  # whose chunk it is
    first: np.ndarray  # its first word, counted over all texts
    runs: np.ndarray  # how many runs of words it holds; they begin at first, first + 1, ...
    seed: np.ndarray  # the last word of its seed
    start: np.ndarray  # its bytes, counted over all texts
    stop: np.ndarray


def chunks_of(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray, run_words: int = RUN_WORDS) -> Chunks:
    """The words covered by the neighbouring runs of `run_words` words whose gear hashes agree on one cut.

    Neighbouring chunks overlap by `run_words` - 1 words, so every run lies in one chunk whole. A chunk has
    at most run_words - SEED_WORDS + 1 runs. Only the words at most `run_words` away decide about
    it, so an insertion changes the chunks around it and no others.
    """
    first, seed = _anchors(data, starts, ends, upto, run_words)
    begins = np.flatnonzero(np.diff(seed, prepend=-1))
    runs = np.diff(begins, append=len(first))
    head = first[begins]
    return Chunks(np.searchsorted(upto, head, "right"), head, runs, seed[begins], starts[head], ends[head + runs + run_words - 2])


def _chunk_rows(run_words: int):
    """(doc_id, row, text) to a row for each chunk: the hashes of its seed and of all its bytes, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch["doc_id"].to_numpy(), batch["row"].to_numpy()
            for at, data, offsets in textkit.chunks(batch["text"]):
                starts, ends, upto = textkit.word_spans(data, offsets)
                c = chunks_of(data, offsets, starts, ends, upto, run_words)
                if not len(c.text):
                    continue
                seeds = textkit.word_hashes(data, starts[c.seed - SEED_WORDS + 1], ends[c.seed], textkit.CASED)
                chunks = textkit.word_hashes(data, c.start, c.stop, textkit.CASED)
                base = offsets[c.text]
                columns = [
                    seeds.view(np.int64), chunks.view(np.int64), ids[at + c.text], rows[at + c.text], (c.first - np.concatenate(([0], upto[:-1]))[c.text]).astype(np.int32),
                    c.runs.astype(np.int32), (c.start - base).astype(np.int32), (c.stop - base).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["seed", "chunk", "doc_id", "row", "word", "runs", "start", "stop"])

    return run


def _run_rows(run_words: int):
    """(doc_id, text, words) to (chunk, doc_id, runs) of the chunks that begin at one of `words`: for each run
    of a chunk its hash, and its bytes counted from the chunk's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch["doc_id"].to_numpy(), batch["words"]
            for at, data, offsets in textkit.chunks(batch["text"]):
                starts, ends, upto = textkit.word_spans(data, offsets)
                c = chunks_of(data, offsets, starts, ends, upto, run_words)
                asked = np.zeros(len(starts) + 1, bool)
                for k, before in enumerate([0, *upto[:-1].tolist()]):
                    asked[before + lists[at + k].values.to_numpy()] = True
                c = Chunks(*(x[asked[c.first]] for x in c))
                if not len(c.text):
                    continue
                of = np.repeat(np.arange(len(c.text)), c.runs)
                bounds = np.concatenate(([0], np.cumsum(c.runs)))
                first = c.first[of] + np.arange(len(of)) - bounds[of]
                a, b = starts[first], ends[first + run_words - 1]
                hashes = textkit.word_hashes(data, a, b, textkit.CASED).view(np.int64)
                runs = pa.StructArray.from_arrays([pa.array(hashes), pa.array((a - c.start[of]).astype(np.int32)), pa.array((b - c.start[of]).astype(np.int32))], ["run", "begin", "end"])
                chunks = textkit.word_hashes(data, c.start, c.stop, textkit.CASED).view(np.int64)
                columns = [pa.array(chunks), pa.array(ids[at + c.text]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "runs"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def repeated_spans(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that documents with a smaller doc_id hold too: doc_id, first_doc, start, stop (bytes of the
    UTF-8 text), n_words, n_chunks, text_hash.

    A span is a longest run of words of which every `run_words` in a row stand, byte for byte, in a document
    with a smaller doc_id; first_doc is the smallest of these. Every passage of `run_words` whole words (17
    at least) that two documents share is found, and to its edges; shorter ones are left alone.

    1. Content-defined chunks: of the words of each run of `run_words`, the gear hash (of the 32 bytes up to a word's
       end) picks one, the least, where the text is cut; the neighbouring runs with the same cut make a chunk (`chunks_of`), and
       the SEED_WORDS words up to the cut are its seed. Equal runs have equal seeds wherever they stand.
    2. Chunks are deduplicated by digest. A chunk whose seed no other document has repeats nothing. Where all
       chunks with a seed are equal, the first document with one holds every run of the others.
    3. What is left are seeds with different chunks: the edges of passages. Each different chunk is looked at once,
       in its first document, and its runs (35 at most) are compared by hash. Every later copy of that chunk is repeated whole.

    Hashes have 64 bits and count as exact. n_chunks counts the chunks that a span touches. Spans of
    one document that overlap hold different passages.

    Null or empty texts have no span. Rows that repeat a doc_id are one document and repeat nothing to each other;
    all null doc_ids are one document after all others (given back as null). Spans belong to one text: text_hash,
    Spark's xxhash64 of it, tells the texts of a repeated doc_id apart, and equal texts of one doc_id count once. A
    passage repeated within one document only is left alone. Other columns are not read. An empty table
    gives no rows. Counting is combined on the map side, and joins have stored tables on both sides, so that
    adaptive execution can split a passage that stands in any share of the documents.
    """
    if run_words < SEED_WORDS:
        raise ValueError(f"run_words must be {SEED_WORDS} at least")
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    chunks = texts.mapInArrow(_chunk_rows(run_words), "seed long, chunk long, doc_id long, row long, word int, runs int, start int, stop int")
    chunks = stored(chunks, "chunks")
    seeds = chunks.groupBy("seed").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), (F.min("chunk") != F.max("chunk")).alias("mixed")
    ).where("first_doc <> last_doc").drop("last_doc")
    shared = stored(chunks.join(stored(seeds, "seeds"), "seed").drop("seed"), "shared-chunks")

    place = F.struct("word", "runs", "start", "stop", "first_doc")
    alike = shared.where("not mixed and doc_id > first_doc").select("doc_id", "row", F.col("word").alias("chunk_word"), place.alias("piece"))
    differing = shared.where("mixed").join(_different_chunks(texts, shared, run_words), "chunk")
    whole = F.struct("word", "runs", "start", "stop", F.least("held_by", "least_doc").alias("first_doc"))
    each = F.transform(
        "again", lambda r: F.struct((F.col("word") + r.nth).alias("word"), F.lit(1).alias("runs"), (F.col("start") + r.begin).alias("start"), (F.col("start") + r.end).alias("stop"), r.first_doc.alias("first_doc"))
    )
    differing = differing.select("doc_id", "row", F.col("word").alias("chunk_word"), F.explode(F.when(F.col("doc_id") > F.col("held_by"), F.array(whole)).otherwise(each)).alias("piece"))
    pieces = alike.union(differing).select("doc_id", "row", "chunk_word", "piece.*").dropDuplicates(["doc_id", "row", "word"])

    order = Window.partitionBy("doc_id", "row").orderBy("word")
    apart = F.coalesce(F.lag(F.col("word") + F.col("runs")).over(order) < F.col("word"), F.lit(True))
    pieces = pieces.withColumn("_apart", apart).withColumn("_other", F.col("_apart") | (F.lag("chunk_word").over(order) != F.col("chunk_word")))
    pieces = pieces.withColumn("_span", F.sum(F.col("_apart").cast("int")).over(order))
    spans = pieces.groupBy("doc_id", "row", "_span").agg(
        F.min("first_doc").alias("first_doc"), F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"),
        (F.max(F.col("word") + F.col("runs")) - F.min("word") + run_words - 1).cast("long").alias("n_words"), F.sum(F.col("_other").cast("long")).alias("n_chunks"),
    )
    return spans.select(F.expr(f"nullif(doc_id, {NO_ID}L)").alias("doc_id"), "first_doc", "start", "stop", "n_words", "n_chunks", F.col("row").alias("text_hash"))


def _different_chunks(texts: DataFrame, shared: DataFrame, run_words: int) -> DataFrame:
    """(chunk, held_by, least_doc, again) of the chunks whose seed has several: the first document with the chunk, the smallest
    with one of its runs, and those runs (nth, begin, end, first_doc) that a smaller document than held_by has."""
    held = shared.where("mixed").groupBy("chunk").agg(F.min(F.struct("doc_id", "row", "word")).alias("held"))
    held = stored(held.select("chunk", "held.*"), "different-chunks")
    asked = stored(held.groupBy("doc_id", "row").agg(F.collect_set("word").alias("words")), "asked")
    found = texts.join(asked, ["doc_id", "row"]).select("doc_id", "text", "words")
    found = stored(found.mapInArrow(_run_rows(run_words), "chunk long, doc_id long, runs array<struct<run: long, begin: int, end: int>>"), "runs")
    runs = found.select("chunk", "doc_id", F.posexplode("runs").alias("nth", "at"))
    firsts = runs.groupBy(F.col("at.run").alias("run")).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    firsts = stored(firsts.select("run", "first_doc"), "first-runs")
    again = runs.select("chunk", "doc_id", "nth", "at.*").join(firsts, "run").where("first_doc < doc_id")
    # A text in several rows gives its runs several times: a set keeps one of each.
    again = again.groupBy("chunk").agg(F.min("first_doc").alias("least_doc"), F.collect_set(F.struct("nth", "begin", "end", "first_doc")).alias("again"))
    return stored(held.select("chunk", F.col("doc_id").alias("held_by")).join(again, "chunk", "left"), "chunk-runs")


def _without(text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for text, spans in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch[spans_col].to_pylist()):
                if spans and text:
                    kept, done = [], 0
                    for span in spans:
                        kept.append(text[done : span["start"]])
                        done = max(done, span["stop"])
                    text = b"".join([*kept, text[done:]]).decode("utf-8", "ignore").encode()
                texts.append(text)
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != spans_col}
            columns[text_col] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def substring_dedup(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all rows and columns, with the spans of `repeated_spans` cut out of their texts (a character cut through
    goes with them). Each text of a repeated or null doc_id loses its own spans. Columns may have any names."""
    spans_col = max(["spans", *docs.columns], key=len) + "_"  # longer than every column's name
    spans = repeated_spans(docs, run_words, id_col, text_col)
    spans = spans.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(spans_col))
    spans = stored(spans, "spans")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    of = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == spans["doc_id"]) & (F.xxhash64(text) == spans["text_hash"])
    joined = docs.join(spans, of, "left").select(docs["*"], spans[spans_col])
    return joined.mapInArrow(_without(text_col, spans_col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
