"""Vectorised words and word shingles of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SPACES = (32, 9, 10, 11, 12, 13)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # words are compared with A-Z in lower case
_PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_STEP = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes of the rows together, offsets of the rows) for runs of whole texts of about
    `limit` bytes; a null counts as an empty text."""
    texts = texts.fill_null("").cast(pa.large_binary()) if texts.type != pa.large_binary() else texts.fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the number of words up to each text's end.
    `breaks` may name other bytes that part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ink = ~breaks[data]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets[1:], "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit polynomial hash of each word, A-Z in lower case (with CASED as they are), from running sums over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * _power_table(_STEP, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table(pow(_STEP, -1, 2**64), len(data))[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = words[:n] * _PLACE[0]
    for k in range(1, size):
        sums += words[k : n + k] * _PLACE[k]
    return mix(sums)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of `size`-word shingles: sorted hashes one text after the other, and set sizes.
    A text of fewer words has its whole sequence as one shingle, one without words the empty set."""
    starts, ends, upto = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = shingle_hashes(words, size)
    texts = len(offsets) - 1
    parts, counts = [], np.zeros(texts, np.int64)
    first = 0
    for k in range(texts):
        last = int(upto[k])
        n = last - first
        if n >= size:
            own = np.sort(runs[first : last - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = mix((words[first:last] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            own = words[:0]
        parts.append(own)
        counts[k] = len(own)
        first = last
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts
