"""Encoding whole texts with the vocabulary of word ends, word by word through a cache.

Its tokenizer drops white space, and none of its pre-tokens, and no composition of characters, spans a space, tab, line
feed or carriage return. So a text is parted at these, each part is encoded once for a worker, and the ids are joined.
"""

from __future__ import annotations

from array import array

import numpy as np

from .common import tokenizer_path
from .encode import _BEYOND_LATIN, _MARKS, CACHED_CHARS, byte_letters

#: Parts that a worker keeps at most; beyond them they are encoded again.
CACHED_PARTS = 500_000


class WordEncoder(dict):
    """Texts to little-endian unsigned 32-bit ids, as bytes; by part, those seen so far."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.latin = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, ord(_BEYOND_LATIN))}

    def __missing__(self, part: str) -> bytes:
        ids = self._ids(part)
        if len(part) <= CACHED_CHARS:
            self[part] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, part: str) -> bytes:
        word = part.rstrip(_MARKS)
        if word != part and word.lower().isalpha() and max(word) < _BEYOND_LATIN:  # letters, then a run of marks: two pre-tokens
            return self[word] + self[part[len(word) :]]
        low = part.lower()
        if low.isalpha() and max(low) < _BEYOND_LATIN and max(part) < _BEYOND_LATIN:  # a word of letters is one pre-token
            word = low if low.isascii() else low.translate(self.latin)
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return self.whole(part)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > CACHED_PARTS:
            self.clear()
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, filter(None, parts)))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(name: str) -> WordEncoder:
    """One encoder for each worker process."""
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[name] = WordEncoder(name)
    return _encoders[name]
