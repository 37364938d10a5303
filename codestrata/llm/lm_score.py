"""Log-likelihood of whole documents under a gated recurrent language model learned from the corpus."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from codestrata.llm.storage import ship, stored
from codestrata.operators.skew import salted_join

HELD_OUT, HELD_REST = 5, 1
END = b""  # the end of a document; no word is empty
HEAD = 767  # words that the network tells apart, besides the end
GROUP = 48  # words of a class
GATHERED = 100_000  # different words that a task counts before it hands their counts on
COUNTED = 65_536  # most frequent words whose counts go to every task, at most
STEPS_OF_COUNT = 64
LONG_WORD = 64  # bytes; longer words are never sent to every task
HIDDEN = 16
STREAMS, STEPS = 256, 16  # documents side by side, and words between two weight updates
SCORED = 512  # documents side by side when nothing is learned
WINDOW = STREAMS * STEPS
PIECE = 1024  # words of a long document that are learned from in one go
POOL = 4_000_000  # words that a task holds at a time
ROUNDS = 4  # parts of the corpus between two averages of the weights
RATE = 0.05
FIRST_SQUARE = 1e-6
CLIP = 5.0
NUMBER = np.dtype("<i2")  # of a word, in the bytes of encoded documents
PIECES = 16  # parts that a task's weights are averaged in

NAMES = ("inputs", "recur", "to_class", "class_bias", "to_word", "word_bias")


def held_out(doc_id: Column) -> Column:
    """Is the document never learned from? A null doc_id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT == HELD_REST


def tokens(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; both of these methods of bytes know ASCII only."""
    return text.encode().lower().split() if text else []


class Words:
    """The most frequent words: number (0 is the end) and count; a number from `head` on is beyond the network."""

    def __init__(self, rows: list[tuple[bytes, int]], ends: int, total: int, distinct: int):
        self.head = min(HEAD, len(rows)) + 1
        self.classes = -(-self.head // GROUP)  # the class after them is all other words
        self.number = {END: 0} | {word: k + 1 for k, (word, _) in enumerate(rows)}
        self.counts = np.array([ends, *(n for _, n in rows)], np.float64)
        self.total, self.distinct = total, distinct
        mass = total + 0.5 * (distinct + 1)
        self.base = np.log10((self.counts + 0.5) / mass)  # of each counted word
        self.rest = max(mass - (self.counts[: self.head] + 0.5).sum(), 0.5)  # beyond the head, unseen words included
        self.shift = np.log10(mass / self.rest)  # from the base of such a word to its share of the last class


# ---- the network


def first_weights(words: Words) -> dict[str, np.ndarray]:
    """Weights that give each word its share of the corpus whatever came before."""
    random = np.random.Generator(np.random.PCG64(12))
    counts = np.zeros(words.classes * GROUP)
    counts[: words.head] = words.counts[: words.head] + 0.5
    groups = counts.reshape(-1, GROUP)
    with np.errstate(divide="ignore"):
        word_bias = np.maximum(np.log(groups / groups.sum(axis=1, keepdims=True)), -1e4)  # no word there: never
    shares = np.log(np.append(groups.sum(axis=1), max(words.rest, 0.5)))
    small = lambda *shape: random.normal(0, 0.1, shape)
    weights = {
        "inputs": small(words.head + 1, 3 * HIDDEN),  # the last row stands for all words beyond the head
        "recur": small(HIDDEN, 3 * HIDDEN),
        "to_class": small(words.classes + 1, HIDDEN) * 0.1,
        "class_bias": shares - np.log(np.exp(shares).sum()),
        "to_word": small(words.classes, GROUP, HIDDEN) * 0.1,
        "word_bias": word_bias,
    }
    return {name: value.astype(np.float32) for name, value in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(logits: np.ndarray, targets: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """log softmax of logits (units x words; their size is kept small by RATE and CLIP) at the targets, and with learn the
    gradient of its negative."""
    picked = logits[targets, np.arange(len(targets))]
    odds = np.exp(logits, out=logits)
    total = odds.sum(axis=0)
    out = picked - np.log(total)
    if learn:
        odds /= total
        odds[targets, np.arange(len(targets))] -= 1
        odds /= WINDOW
    return out, odds


class Network:
    """A gated recurrent layer and a softmax in two steps: the class of the next word, then the word in it."""

    def __init__(self, weights: dict[str, np.ndarray], words: Words):
        self.w, self.head, self.classes = weights, words.head, words.classes
        self.squares = {name: np.full_like(value, FIRST_SQUARE) for name, value in weights.items()}

    def states(self, before: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """The state after each word of a window (steps x streams), from the state carried in; a fresh document
        begins with none. With keep, also what learning needs."""
        out = np.empty((*before.shape, HIDDEN), np.float32)
        kept = []
        begins = fresh.any(axis=1)
        for t in range(len(before)):
            if begins[t]:
                state = state.copy()
                state[fresh[t]] = 0
            inputs = self.w["inputs"][before[t]]
            drive = state @ self.w["recur"]
            gates = _sigmoid(inputs[:, : 2 * HIDDEN] + drive[:, : 2 * HIDDEN])
            hold, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = reset * drive[:, 2 * HIDDEN :]
            new += inputs[:, 2 * HIDDEN :]
            np.tanh(new, out=new)
            if keep:
                kept.append((state, hold, reset, new, drive[:, 2 * HIDDEN :]))
            state = state - new
            state *= hold
            state += new
            out[t] = state
        return out, kept

    def likelihood(self, states: np.ndarray, targets: np.ndarray, learn: bool):
        """Natural log-probability of each target; with learn also the gradients of their negative sum, a WINDOW-th of it."""
        across = np.ascontiguousarray(states.T)
        group = np.minimum(targets // GROUP, self.classes)
        group[targets >= self.head] = self.classes
        out, error = _softmax(self.w["to_class"] @ across + self.w["class_bias"][:, None], group, learn)
        if learn:
            grads = {"to_class": error @ states, "class_bias": error.sum(axis=1), "to_word": np.zeros_like(self.w["to_word"]), "word_bias": np.zeros_like(self.w["word_bias"])}
            back = error.T @ self.w["to_class"]
        order = np.argsort(group.astype(np.int16), kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            own = order[edges[c] : edges[c + 1]]
            if not len(own):
                continue
            inside = states[own]
            logs, error = _softmax(self.w["to_word"][c] @ inside.T + self.w["word_bias"][c][:, None], targets[own] - c * GROUP, learn)
            out[own] += logs
            if learn:
                grads["to_word"][c] = error @ inside
                grads["word_bias"][c] = error.sum(axis=1)
                back[own] += error.T @ self.w["to_word"][c]
        return (out, grads, back) if learn else out

    def learn(self, before: np.ndarray, targets: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step on a window, its error carried back to the window's first word; the state after it. Targets below 0 are
        past a stream's end."""
        states, kept = self.states(before, fresh, state, True)
        begins = fresh.any(axis=1)
        real = targets >= 0
        back = np.zeros_like(states)
        if not real.any():
            return states[-1]
        _, grads, back[real] = self.likelihood(states[real], targets[real], True)
        # What the error is multiplied by at each word needs no error: for the whole window at once.
        old, hold, reset, new, drive = map(np.array, zip(*kept))
        to_hold = (old - new) * hold * (1 - hold)
        to_reset = drive * reset * (1 - reset)
        to_new = (1 - hold) * (1 - new * new)
        onward, back_through = np.zeros_like(state), np.ascontiguousarray(self.w["recur"].T)
        drives = np.empty((*before.shape, 3 * HIDDEN), np.float32)  # of the recurrent part
        inner = np.empty_like(to_new)
        for t in range(len(before) - 1, -1, -1):
            error = back[t] + onward
            d, own = drives[t], np.multiply(error, to_new[t], out=inner[t])
            np.multiply(error, to_hold[t], out=d[:, :HIDDEN])
            np.multiply(own, to_reset[t], out=d[:, HIDDEN : 2 * HIDDEN])
            np.multiply(own, reset[t], out=d[:, 2 * HIDDEN :])
            onward = d @ back_through
            error *= hold[t]
            onward += error
            if begins[t]:
                onward[fresh[t]] = 0
        grads["recur"] = old.reshape(-1, HIDDEN).T @ drives.reshape(-1, 3 * HIDDEN)
        drives[:, :, 2 * HIDDEN :] = inner  # of the words' part
        flat, where = drives.reshape(-1, 3 * HIDDEN), before.ravel()
        order = np.argsort(where, kind="stable")
        seen, cut = np.unique(where[order], return_index=True)
        grads["inputs"] = np.zeros_like(self.w["inputs"])
        grads["inputs"][seen] = np.add.reduceat(flat[order], cut)
        self.update(grads)
        return states[-1]

    def update(self, grads: dict[str, np.ndarray]) -> None:
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = np.float32(min(1.0, CLIP / max(norm, 1e-12)))
        for name, grad in grads.items():
            grad = grad * shrink
            self.squares[name] += grad * grad
            self.w[name] -= np.float32(RATE) * grad / np.sqrt(self.squares[name])


# ---- documents side by side


LAST = 1 << 20  # marks the last word of a document or piece; no number of a word is as large


def streams(sizes: np.ndarray, most: int = STREAMS) -> list[list[int]]:
    """The documents of a pool dealt to `most` streams of about equal length, longest first."""
    heap = [(0, k) for k in range(min(most, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for doc in np.argsort(-sizes, kind="stable"):
        length, k = heapq.heappop(heap)
        out[k].append(int(doc))
        heapq.heappush(heap, (length + int(sizes[doc]), k))
    return sorted(out, key=lambda docs: -sum(int(sizes[d]) for d in docs))


def walk(docs: list[np.ndarray], network: Network, learn: bool) -> np.ndarray:
    """Goes through whole documents (word numbers, the end last) window by window, the state carried from
    one window to the next. Returns the log10 probability of each document, or learns: then a long document
    is dealt in pieces of PIECE words, each beginning without a state, so that no stream is much longer than others."""
    if learn:
        docs = [doc[k : k + PIECE] for doc in docs for k in range(0, len(doc), PIECE)]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    dealt = streams(sizes, STREAMS if learn else SCORED)
    length = np.array([sizes[line].sum() for line in dealt], np.int64)
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # streams that go on beyond a step
    start = np.concatenate(([0], np.cumsum(live)))  # all streams' words step by step
    words = np.zeros(start[-1], np.int32)
    for k, line in enumerate(dealt):
        words[start[: length[k]] + k] = np.concatenate([docs[d] for d in line])
        words[start[np.cumsum(sizes[line]) - 1] + k] |= LAST
    scores = np.zeros(0 if learn else len(words))
    state = np.zeros((len(dealt), HIDDEN), np.float32)
    last = np.full(len(dealt), LAST)
    for first in range(0, len(live), STEPS):
        steps, width = min(STEPS, len(live) - first), live[first]
        targets = np.full((steps, width), -1, np.int64)
        for t in range(steps):
            targets[t, : live[first + t]] = words[start[first + t] : start[first + t + 1]]
        before = np.concatenate((last[None, :width], targets[:-1]))
        last = targets[-1]
        fresh = before & LAST != 0  # nothing came before, or another document
        before[fresh] = 0
        targets = np.where(targets < 0, -1, targets & (LAST - 1))
        if learn:
            state = network.learn(before, targets, fresh, state[:width])
            continue
        states, _ = network.states(before, fresh, state[:width], False)
        state = states[-1]
        real = targets >= 0
        scores[start[first] : start[first + steps]] = network.likelihood(states[real], targets[real], False)
    total = np.zeros(len(docs))
    if not learn:
        for k, line in enumerate(dealt):
            total[line] = np.add.reduceat(scores[start[: length[k]] + k], np.cumsum([0, *sizes[line[:-1]]]))
    return total / np.log(10)


def _pools(batches: Iterable[pa.RecordBatch], column: str = "ids") -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows gathered until their word numbers reach POOL."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch[column])).as_py() // NUMBER.itemsize
        if size >= POOL:
            yield _pool(held, column)
            held, size = [], 0
    if held:
        yield _pool(held, column)


def _pool(held: list[pa.RecordBatch], column: str) -> tuple[pa.Table, list[np.ndarray]]:
    table = pa.Table.from_batches(held)
    return table.drop_columns([column]), [np.frombuffer(own.as_buffer(), NUMBER) for own in table[column]]


# ---- Spark


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) of the training documents' words and ends; each task counts its own first, GATHERED words at a time."""

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(tokens(text))
            seen[END] += batch.num_rows
            if len(seen) >= GATHERED:
                yield counted(seen)
                seen = Counter()
        if seen:
            yield counted(seen)

    seen = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(count, "word binary, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> Words:
    """The most frequent words, at most COUNTED, and four sums; no more reaches the driver.

    Words are taken by steps of frequency (STEPS_OF_COUNT to a power of two), whole steps from the top."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    fit = counts.where((F.col("word") != F.lit(END)) & (F.length("word") <= LONG_WORD))
    step = F.floor(F.log2("n") * STEPS_OF_COUNT)
    least, taken = None, 0
    for row in fit.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        taken += row["count"]
        if taken > COUNTED:
            break
        least = row["step"]
    top = fit.where(step >= least).collect() if least is not None else []
    rows = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda r: (-r[1], r[0]))
    return Words(rows, ends["n"] if ends else 0, total, distinct)


ENCODED = "doc_id {id}, held_out boolean, round int, n_tokens long, n_known long, base double, beyond long, beyond_base double, ids binary, rare array<binary>, rare_n array<long>"


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """One row for each document: word numbers for the network (NUMBER; HEAD and more: any other word), the sums over its
    counted words, and its words that are not counted."""
    sent = docs.sparkSession.sparkContext.broadcast((words.number, words.base, words.head, words.counts[0] > 0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base, head, ends = sent.value
        none = len(base)
        for batch in batches:
            sums, ids, rare, rare_n = [], [], [], []
            for text in batch["text"].to_pylist():
                found = tokens(text)
                own = np.array([number.get(word, none) for word in found] + [0], np.int64)
                known = own[own < none]
                others = Counter([word for word, k in zip(found, own) if k == none]) if len(known) < len(own) else {}
                sums.append((len(own), len(known) - (not ends), base[known].sum(), int((own >= head).sum()), base[known[known >= head]].sum()))
                ids.append(np.minimum(own, head).astype(NUMBER).tobytes())
                rare.append(list(others.keys()))
                rare_n.append(list(others.values()))
            sums = [pa.array(c, k) for c, k in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], batch["round"], *sums, pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64()))],
                names,
            )

    schema = ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    turn = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS)).cast("int").alias("round")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), turn, "text").mapInArrow(rows, schema)


def train(encoded: DataFrame, words: Words) -> dict[str, np.ndarray]:
    """Weights learned from all training documents: in each round every task walks its documents of that round
    from the common weights, and the tasks' weights are averaged by the words they saw.

    The weights are averaged in Spark, in PIECES groups; only their means reach the driver."""
    spark = encoded.sparkSession
    weights = first_weights(words)
    shapes = {name: value.shape for name, value in weights.items()}
    shape = _Shape(words.head, words.classes)

    def split(flat: np.ndarray) -> dict[str, np.ndarray]:
        edges = np.cumsum([int(np.prod(shape)) for shape in shapes.values()])[:-1]
        return {name: part.reshape(shape).copy() for (name, shape), part in zip(shapes.items(), np.split(flat, edges))}

    for turn in range(ROUNDS):
        flat = np.concatenate([weights[name].ravel() for name in shapes])
        sent = spark.sparkContext.broadcast(flat)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            network = Network(split(sent.value), shape)
            seen = 0
            for _, docs in _pools(batches):
                docs = [d.astype(np.int64) for d in docs]
                walk(docs, network, True)
                seen += sum(map(len, docs))
            if seen:
                own = np.concatenate([network.w[name].ravel() for name in shapes])
                pieces = np.array_split(own.astype(np.float64) * seen, PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array(pieces, pa.list_(pa.float64()))], ["piece", "seen", "sums"])

        def mean(table: pa.Table) -> pa.Table:
            sums = np.zeros(len(table["sums"][0]))
            for row in table["sums"]:
                sums += row.values.to_numpy()
            seen = pc.sum(table["seen"]).as_py()
            return pa.table({"piece": table["piece"][:1], "means": pa.array([sums / seen], pa.list_(pa.float64()))})

        own = encoded.where((F.col("round") == turn) & ~F.col("held_out")).select("ids").mapInArrow(task, "piece int, seen long, sums array<double>")
        means = own.groupBy("piece").applyInArrow(mean, "piece int, means array<double>").toArrow().sort_by("piece")
        sent.unpersist()
        if means.num_rows:
            weights = split(np.concatenate([m.values.to_numpy() for m in means["means"]]).astype(np.float32))
    return weights


class _Shape:
    """What a network must know about the words."""

    def __init__(self, head: int, classes: int):
        self.head, self.classes = head, classes


def score(encoded: DataFrame, weights: dict[str, np.ndarray], words: Words) -> DataFrame:
    """The encoded rows without word numbers, with `inside`: log10 probability of each document's head words, and of the
    last class for each word beyond them."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    shape = _Shape(words.head, words.classes)
    fields = [f for f in encoded.schema.fields if f.name != "ids"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(sent.value, shape)
        for table, docs in _pools(batches):
            scores = walk([d.astype(np.int64) for d in docs], network, False)
            yield from table.append_column("inside", pa.array(scores)).to_batches()

    return encoded.select(*[f.name for f in fields], "ids").mapInArrow(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", inside double")


def lm_score(docs: DataFrame) -> DataFrame:
    """Language-model scores of docs (doc_id, text), learned from the documents that are not held out.

    One row for each row of docs: doc_id, held_out, n_tokens (words and the end), n_known (those found in training
    documents), train_tokens, base_score (log10 probability under smoothed word frequencies) and score (log10
    probability under the network; words beyond its HEAD most frequent ones by their class and, inside
    it, their smoothed frequency, so all probabilities of a next word add up to one).
    Null and empty texts have the end only; a null doc_id counts as an empty text and is learned from;
    repeated rows count and are scored each; texts of any length are read to their end; other columns are
    not read; an empty table gives no rows, and without training documents all words are unseen.

    Counts cover all training documents. At most COUNTED words are sent to every task; others, rare by
    construction, meet their counts in a join. Encoded documents are written once and read by each round.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counts = stored(word_counts(docs), "word-counts")
    words = frequent_words(counts)
    encoded = stored(encode(docs, words).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    weights = train(encoded, words)
    uncounted = encoded.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("_w")).select("_row", F.col("_w.rare").alias("word"), F.col("_w.rare_n").alias("_times"))
    joined = salted_join(uncounted, counts, ["word"], "left")
    share = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(words.total + 0.5 * (words.distinct + 1)))
    sums = joined.groupBy("_row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("_times")).otherwise(0)).alias("_known"), F.sum(share * F.col("_times")).alias("_base"))
    whole = score(encoded.drop("round", "rare", "rare_n"), weights, words).join(sums, "_row", "left")
    known, rest = F.coalesce("_known", F.lit(0)), F.coalesce("_base", F.lit(0.0))
    beyond = F.col("beyond_base") + rest + F.col("beyond") * F.lit(float(words.shift))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"), (F.col("inside") + beyond).alias("score"),
    )
