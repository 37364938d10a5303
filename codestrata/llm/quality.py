"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codestrata.llm import textkit
from codestrata.llm.storage import lean, ship

MAX_ROWS = 20_000  # labelled rows a model is fitted on at most
BINS = 32
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS = 150, 60
PAIRS = 8
RATE = 0.1
HELD_OUT = 5  # one part in so many is never learned from
ACCEPT = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "line_ends", "stops", "shouts", "bars", "symbols", "marks",
    "beyond_ascii", "unique_words", "top_word", "repeated_next", "symbol_ends",
)

_KINDS = 11
_KIND = np.zeros(256, np.uint8)  # 0: lower case and the rest
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[10] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[[46, 44]] = 5  # . ,
_KIND[[33, 63]] = 6  # ! ?
_KIND[124] = 7  # |
_KIND[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 126, 123, 125, 91, 93]] = 8
_KIND[[34, 39, 40, 41, 45, 58, 59]] = 9
_KIND[192:] = 10  # first byte of a character beyond ASCII


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text, one row each; shares are of bytes or words. An empty text has zeros."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    kinds = _KIND[data]
    starts, ends, upto = textkit.word_spans(data, offsets)
    hashes = textkit.word_hashes(data, starts, ends)
    lengths = ends - starts
    odd_end = np.isin(kinds[ends - 1], (6, 7, 8)) if len(ends) else np.zeros(0, bool)
    first = 0
    for k in range(len(out)):
        last = int(upto[k])
        n_bytes, n = int(offsets[k + 1] - offsets[k]), last - first
        if n:
            share = np.bincount(kinds[offsets[k] : offsets[k + 1]], minlength=_KINDS) / n_bytes
            words = hashes[first:last]
            alike = np.sort(words)
            runs = np.flatnonzero(np.concatenate(([True], alike[1:] != alike[:-1], [True])))
            out[k] = (
                np.log1p(n_bytes), np.log1p(n), lengths[first:last].mean(), share[1], share[2], share[3], share[5], share[6], share[7],
                share[8], share[9], share[10], (len(runs) - 1) / n, np.diff(runs).max() / n, (words[1:] == words[:-1]).sum() / n,
                odd_end[first:last].mean(),
            )
        first = last
    return out


@dataclass
class AdditiveModel:
    """logit(score) = base + one table entry for each feature's bin + one for each pair's cell."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher: label 1 likelier."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[cells[i], cells[j]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad / (hess + 1.0)


def _best_cut(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in two."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, 0
    all_g, all_h = grad.sum(), hess.sum()
    gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins, as a value for each bin."""
    values = np.zeros(len(grad))
    gain, cut = _best_cut(grad, hess)
    for a, b in ((0, cut), (cut, len(grad))) if gain > 1e-6 else ((0, len(grad)),):
        gain, inner = _best_cut(grad[a:b], hess[a:b])
        for c, d in ((a, a + inner), (a + inner, b)) if gain > 1e-6 else ((a, b),):
            values[c:d] = _step(grad[c:d].sum(), hess[c:d].sum())
    return values


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on each axis, chosen together: gain and a value for each cell."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (grad, hess))
    best, at = -1.0, (1, 1)
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            gain = 0.0
            for (a, b), (c, d) in (((0, i), (0, j)), ((0, i), (j, -1)), ((i, -1), (0, j)), ((i, -1), (j, -1))):
                g = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
                h = ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]
                gain += g * g / (h + 1)
            if gain > best:
                best, at = gain, (i, j)
    values = np.zeros(grad.shape)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for columns in (slice(0, at[1]), slice(at[1], None)):
            values[rows, columns] = _step(grad[rows, columns].sum(), hess[rows, columns].sum())
    return best - grad.sum() ** 2 / (hess.sum() + 1), values


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets a small step of a shallow tree on its
    bins; then, with these fixed, the pairs whose cells explain most of the rest get theirs. Without
    rows the model scores 0.5, with one label only it scores that label's smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def rest():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            r, h = rest()
            step = RATE * _tree(np.bincount(bins[j], r, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]

    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def grids(i, j, r, h):
        at, n = cells[i] * shape[j] + cells[j], shape[i] * shape[j]
        return (np.bincount(at, v, n).reshape(shape[i], shape[j]) for v in (r, h))

    r, h = rest()
    ranked = sorted(((_pair_tree(*grids(i, j, r, h))[0], i, j) for i in range(len(cells)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            r, h = rest()
            step = RATE * _pair_tree(*grids(i, j, r, h))[1]
            table += step
            total += step[cells[i], cells[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text, mod 5, is 0. A null doc_id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(data, offsets) for _, data, offsets in textkit.chunks(batch["text"])]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.int32()), flat], ["label", "x"])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on at most `max_rows` labelled rows that are not held out, those with the smallest hash of
    doc_id. Only their features come to the driver. Of rows that repeat a doc_id the one with the smallest hash
    of its text counts. A doc_id with several labels takes the largest; labels
    other than 0 and 1 and null doc_ids are left out."""
    ship(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    # One row for each chosen doc_id, so that max_rows bounds what comes to the driver.
    rows = rows.groupBy("id").agg(F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text")).alias("row")).select("row.*")
    table = rows.select("label", "text").mapInArrow(_measured, "label int, x array<double>").toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy() if len(table) else np.zeros(0)
    x, y = x.reshape(-1, len(FEATURES)), table["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # whatever order the rows arrive in
    return fit(x[order], y[order])


def _scorer(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for whole in batches:
            at = whole.schema.get_field_index("__text")
            rest = [k for k in range(whole.num_columns) if k != at]
            for first, data, offsets in textkit.chunks(whole.column(at)):
                scores = model.score(features(data, offsets))
                part = whole.slice(first, len(scores))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(scores)], [*(whole.schema.names[k] for k in rest), "score"])

    return run


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """`docs` with a column score (one of that name is replaced). Whole texts are read; a null text
    scores as an empty one. Nothing but the text decides. An empty table gives no rows."""
    ship(docs.sparkSession)
    kept = docs.drop("score") if text_col != "score" else docs
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "score")
    asked = kept.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return asked.mapInArrow(_scorer(model), f"{fields}, score double")
