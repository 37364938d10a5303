"""Encoding with a public tokenizer: the library's ids, words cached by each task."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np

CACHED_WORDS = 200_000  # words a worker remembers

# Letters that NFC leaves alone and whose lower case is one letter: ASCII and Latin-1. After them ASCII marks but the
# apostrophe, which may begin an ending: between a letter and white space both vocabularies take them as one piece.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_PLAIN = re.compile(f"({_LETTER}+)({_MARK}*)")
_TRAILING = re.compile(rf"({_MARK}(?<={_LETTER}{_MARK}){_MARK}*)(?=\s|\Z)")
_RARE_GAP = re.compile("[\x1c-\x1f]")  # white space to Python only
_GAPS = re.compile(r"[^\S ]")  # white space other than a space


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_TO_CHARS = dict(enumerate(_byte_chars()))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Remembered(dict):
    """What `make` gave for each word; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = self.make(word)
        return ids


def _lower(text: str) -> str:
    """A text of ASCII and Latin-1 in lower case, letter by letter as the library does; others as they are."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class WordCoder:
    """Ids of whole texts exactly as tokenizers' encode(text, add_special_tokens=False) gives them.

    Both kinds of vocabulary split a text into words before merging, so a text is the sequence of its
    words' ids. Words of plain letters go straight to the library's merge model, others through the
    whole encoder; each word once while it is remembered. Texts with unusual white space, and those
    that may hold special tokens, are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.gaps_matter = self.tokenizer.normalizer is None  # else white space only separates
        self.lead = _TO_CHARS[32] if self.gaps_matter else ""
        self.gap = self.encode("\n")
        self.words = _Remembered(self._word)
        self.marks = _Remembered(self.encode)
        self.firsts = _Remembered(self.encode)

    def encode(self, text: str) -> bytes:
        """The library's own ids, as little-endian unsigned 32-bit integers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word after one space (gaps_matter), or a word between white space."""
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return self.encode(" " + word if self.gaps_matter else word)
        letters, marks = plain.groups()
        if not self.gaps_matter:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_TO_CHARS)
        ids = array("I", [t.id for t in self.merges(self.lead + letters)]).tobytes()
        return ids + self.marks[marks] if marks else ids

    def packed(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if "<|" in text or _RARE_GAP.search(text):
            return self.encode(text)
        if not self.gaps_matter:
            # Marks apart from their words: far fewer different words to remember.
            return b"".join(map(self.words.__getitem__, _TRAILING.sub(r" \1", _lower(text)).split()))
        # Single white space only: a space goes with the word that follows it, a line end stands alone.
        lines = []
        for line in text.split("\n"):
            if not line or line[0].isspace() or line[-1].isspace() or "  " in line or _GAPS.search(line):
                return self.encode(text)
            words = line.split(" ")
            lines.append(self.firsts[words[0]] + b"".join(map(self.words.__getitem__, words[1:])))
        return self.gap.join(lines)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


def word_coder(path: str) -> WordCoder:
    """The coder of a tokenizer's file: loaded once for each worker process, which keeps its remembered words."""
    state = os.stat(path)
    return _loaded(path, state.st_mtime_ns, state.st_size)


def forget_coder() -> None:
    """Let go of the coder that an earlier task of this worker process used."""
    _loaded.cache_clear()


@lru_cache(1)
def _loaded(path: str, *_state: int) -> WordCoder:
    return WordCoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
