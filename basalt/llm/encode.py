"""Encoding whole texts with public tokenizers, word by word through a cache.

A byte-level BPE never merges across its pre-token boundaries, and a space after a character that isn't white space
always is such a boundary. So a text is parted at single spaces, each part is encoded once for a worker, and the ids
are joined. Texts in which white space comes before a space (or which start with one) go to the tokenizer whole.
The same holds for sentence pieces, as no piece of the vocabulary has a space sign after another character.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np

from .common import tokenizer_path

END_ID = 2
#: Parts that a worker keeps at most, and the longest that it keeps; beyond them they are encoded again.
CACHED_PARTS = 700_000
CACHED_CHARS = 64

#: White space before a space. U+180E and U+200B count as white space in some Unicode versions.
_UNSAFE_ASCII = tuple(f"{c} " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
_UNSAFE_OTHER = tuple(f"{chr(c)} " for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_LINE_FEED = "\n"
_ODD = frozenset("\u180e\u200b")
#: Marks that never join a letter before them; the apostrophe does (as in 's).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this one are letters in every Unicode version.
_BEYOND_LATIN = "\u0250"


def unsafe(text: str) -> bool:
    """Whether some space of a text isn't a boundary of its own."""
    return text[0] == " " or any(x in text for x in _UNSAFE_ASCII) or (not text.isascii() and any(x in text for x in _UNSAFE_OTHER))


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Parts(dict):
    """Parts of texts and the bytes of their ids; a part that is missing is encoded when it is asked for.

    A word of letters, with the space before it, is one pre-token: the model encodes it at once, past the tokenizer's
    passes over texts. So is a run of marks after it, and a line feed between two words. All else takes the long way.
    """

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, part: str) -> bytes:
        ids = self._ids(part)
        if len(part) <= CACHED_CHARS:
            self[part] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        e = self.encoder
        if part.isalpha() and (part.isascii() or max(part) < _BEYOND_LATIN):
            word = part if part.isascii() else part.translate(e.latin)
            return array("I", [t.id for t in e.model.tokenize((e.space if self.lead else "") + word)]).tobytes()
        word = part.rstrip(_MARKS)
        if word != part and word.isalpha() and max(word) < _BEYOND_LATIN:
            return self[word] + e.marks[part[len(word) :]]
        if part.count(_LINE_FEED) == 1 and part.isprintable() is False and part.replace(_LINE_FEED, "").isprintable():
            a, b = part.split(_LINE_FEED)
            if a and b and " " not in a + b and not _ODD.intersection(part) and not any(map(str.isspace, a + b)):
                return self[a] + e.marks[_LINE_FEED] + e.first[b]
        return e.whole(self.lead + part)


class Marks(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.whole(part)
        if len(part) <= CACHED_CHARS:
            self[part] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        letters = byte_letters()
        self.space = letters[32]
        self.latin = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, ord(_BEYOND_LATIN))}
        self.marks, self.first, self.later = Marks(self), Parts(self, ""), Parts(self, " ")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for t in texts:
            if not t:
                out.append(b"")
            elif unsafe(t):
                out.append(self.whole(t))
            else:
                parts = t.split(" ")
                out.append(self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:])))
            for cache in (self.first, self.later, self.marks):
                if len(cache) > CACHED_PARTS:
                    cache.clear()
        return out


END = np.asarray([END_ID], "<u4").tobytes()


def closed(ids: bytes) -> bytes:
    """The ids of a document with its end."""
    return ids + END


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each worker process."""
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[name] = Encoder(name)
    return _encoders[name]


def forget() -> None:
    """Drops this process's encoders and what they keep: for tasks that encode nothing.

    A worker outlives a stage, and would hold up to ``CACHED_PARTS`` parts of each kind beside whatever it runs next.
    """
    if not _encoders:
        return
    import pyarrow as pa

    for e in _encoders.values():  # they refer to each other, so they would wait for the collector
        for cache in (e.first, e.later, e.marks):
            cache.clear()
    _encoders.clear()
    pa.default_memory_pool().release_unused()
