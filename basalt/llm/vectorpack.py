"""Vector bin packing of training examples into sequences, by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces that it holds) and loss-bearing tokens. An example has a
demand in each: its tokens, one segment, and the tokens of its response (all of it, if it has no prompt). Sequences are
filled one after another: of the examples that fit in all three, the one goes in whose demand has the largest dot
product with what the sequence has left, each dimension in units of its limit and weighted by its mean demand. Where
nothing fits any more and cutting is allowed, the head of the example with the largest product fills the gap, and its
tail waits with the others. What is left when the examples end is cut into sequences of power-of-two lengths, which need
no padding.

Every task packs the examples of its own partition, from a pool of at most ``POOL_EXAMPLES`` examples or ``POOL_TOKENS``
tokens (beside one whole example) which is filled again as sequences take from it. So nothing is shuffled or collected,
and a task holds no more than the pool, whatever the table and its keys; it leaves at most one sequence of each power of
two. A lost task packs its partition again, in the same way.

Defined results: a null or empty text (and prompt) is its end token alone; rows are packed one by one, also where ids
are null or repeat; an example longer than a sequence is cut even if cutting isn't allowed, into whole sequences first;
texts are taken whole, however long; ties go to the example that came first; an empty table gives no rows; columns
beside id, text and prompt are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import small_batches
from .encode import closed, crc
from .wordparts import word_encoder

TOKENIZER = "word_bpe_49k.json"
POOL_EXAMPLES = 2048
POOL_TOKENS = 1 << 21
#: Rows that a task gathers before it gives them on.
OUT_ROWS = 4000


@dataclass(frozen=True)
class Limits:
    """Of one sequence. Segments are bounded by the cost of masks between them; loss tokens by none but the length."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


@dataclass
class Example:
    """One example: its id, its ids as bytes, all its tokens, those of its prompt, and where its next piece starts."""

    doc_id: object
    ids: bytes
    n: int
    prompt: int
    start: int = 0

    def loss(self, length: int) -> int:
        """Loss-bearing tokens among the next ``length`` ones."""
        return max(0, self.start + length - max(self.start, self.prompt))

    def within(self, tokens: int, loss: int) -> int:
        """The longest head that has at most so many tokens and loss-bearing ones."""
        return min(tokens, self.n - self.start, max(0, self.prompt - self.start) + loss)


#: (example, start, length, loss) in the order of the offsets
Sequence = list[tuple[Example, int, int, int]]


class Pool:
    """Examples that wait, with their demands as arrays."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.waiting: list[Example] = []
        self.tokens = 0
        self._stale = True

    def add(self, e: Example) -> None:
        self.waiting.append(e)
        self.tokens += e.n - e.start
        self._stale = True

    def full(self) -> bool:
        return len(self.waiting) >= POOL_EXAMPLES or self.tokens >= POOL_TOKENS

    def low(self) -> bool:
        return len(self.waiting) < POOL_EXAMPLES // 2 and self.tokens < POOL_TOKENS // 2

    def _measure(self) -> None:
        self.t = np.array([e.n - e.start for e in self.waiting], np.float64)
        self.l = np.array([e.loss(e.n - e.start) for e in self.waiting], np.float64)
        limits, many = self.limits, max(1, len(self.waiting))
        # Mean demand times the two units of a product: demand and what is left are both in parts of the limit.
        self.w = (self.t.sum() / many / limits.tokens**3, 1 / limits.segments**3, self.l.sum() / many / limits.loss**3)
        self.here = np.ones(len(self.waiting), bool)
        self._stale = False

    def sequence(self) -> Sequence:
        """One more sequence; the pool must not be empty."""
        if self._stale:
            self._measure()
        limits, out = self.limits, []
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        while segments and tokens and self.tokens:
            product = self.w[0] * tokens * self.t + self.w[1] * segments + self.w[2] * loss * self.l
            fits = self.here & (self.t <= tokens) & (self.l <= loss)
            k = int(np.argmax(np.where(fits, product, -1.0)))
            if fits[k]:
                length = self.waiting[k].n - self.waiting[k].start
            else:
                if self.cut:
                    k = int(np.argmax(np.where(self.here, product, -1.0)))
                else:  # only what no empty sequence holds is cut, and only into empty ones
                    long = self.here & ((self.t > limits.tokens) | (self.l > limits.loss))
                    if out or not long.any():
                        break
                    k = int(np.argmax(long))
                length = self.waiting[k].within(tokens, loss)
                if not length:
                    break
            e = self.waiting[k]
            bearing = e.loss(length)
            out.append((e, e.start, length, bearing))
            tokens, segments, loss = tokens - length, segments - 1, loss - bearing
            e.start += length
            self.tokens -= length
            self.t[k], self.l[k] = e.n - e.start, e.loss(e.n - e.start)
            self.here[k] = e.start < e.n
        if self.here.sum() * 2 < len(self.waiting):
            self.waiting = [e for e in self.waiting if e.start < e.n]
            self._stale = True
        return out


def powers(sequence: Sequence) -> Iterator[Sequence]:
    """A sequence as sequences whose lengths are different powers of two, the longest first."""
    todo = [(e, start, length) for e, start, length, _ in reversed(sequence)]
    total = sum(length for _, _, length in todo)
    while total:
        room = size = 1 << (total.bit_length() - 1)
        out: Sequence = []
        while room:
            e, start, length = todo.pop()
            if length > room:
                todo.append((e, start + room, length - room))
                length = room
            out.append((e, start, length, max(0, start + length - max(start, e.prompt))))
            room -= length
        total -= size
        yield out


def sequences(examples: Iterator[Example], limits: Limits, cut: bool = True) -> Iterator[Sequence]:
    """Sequences of a stream of examples through one pool."""
    pool = Pool(limits, cut)
    for e in examples:
        pool.add(e)
        if pool.full():
            while not pool.low():
                yield pool.sequence()
    while pool.tokens:
        last = pool.sequence()
        if cut and not pool.tokens:
            yield from powers(last)
        else:
            yield last


def pack_examples(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, cut: bool = True, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``prompt`` names the column of text that comes before ``text`` and bears no loss; without it all tokens do.
    ``cut=False`` leaves examples whole that fit in a sequence.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("every limit must be at least 1")
    small_batches(docs.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, kinds, number = word_encoder(tokenizer).encode, [], TaskContext.get().partitionId() << 33

        def read() -> Iterator[Example]:
            for batch in batches:
                if not kinds:
                    kinds.append(batch.schema.field(0).type)
                before = batch.column(2).to_pylist() if prompt else [None] * batch.num_rows
                for i, t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), before, strict=True):
                    head = encode(p)
                    ids = closed(head + encode(t))
                    yield Example(i, ids, len(ids) // 4, len(head) // 4)

        def rows(out: list[tuple]):
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
            return pa.RecordBatch.from_arrays([pa.array(x, kinds[0] if k == 0 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=names)

        out: list[tuple] = []
        for sequence in sequences(read(), limits, cut):
            offset = 0
            for e, start, length, bearing in sequence:
                out.append((e.doc_id, start, length, crc(e.ids[4 * start : 4 * (start + length)]), e.n, number, offset, bearing))
                offset += length
            number += 1
            if len(out) >= OUT_ROWS:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    kind = docs.schema[doc_id].dataType.simpleString()
    wanted = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text", *([f"`{prompt}` AS prompt"] if prompt else []))
    return wanted.mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
