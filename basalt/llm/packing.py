"""Best-fit packing of documents into sequences, with dominance reduction.

A packing depends on lengths only, and there are no more lengths than a sequence has places. So the driver gets one
count for each length, whatever the corpus, and solves the instance over these counts:

1. Martello-Toth dominance reduction, from the longest piece down: a piece that nothing fits beside stands alone; one
   that leaves room for one more piece at most, or whose largest partner fills the sequence exactly, is fixed with that
   partner; so is one that leaves room for two at most, if its largest partner is no shorter than any two that fit.
   If two fit, it is fixed with its largest partner and the largest piece that then fits, provided these two dominate
   every other pair: the longer of a pair fits in the place of the one and the shorter in that of the other, or both in
   the place of the longer one.
2. Best-fit decreasing over what remains, on runs of equal sequences instead of single ones.

The solution is a list of patterns with multiplicities (a few for each length). Pieces of one length are numbered by
sums over partitions, and number r of a length looks up its pattern, sequence and offset.

Defined results: a null or empty text is its end token alone; documents that repeat an id are packed like any others;
only documents longer than a sequence are cut, the first piece being the shorter one; an empty table gives no rows;
columns beside id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .encode import closed, crc, encoder

CAPACITY = 1024
#: (times, [(length, copies), ...]) in the order of the offsets
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns, and the counts that remain."""
    left = {n: c for n, c in counts.items() if c}
    fixed: list[Pattern] = []
    for n in sorted(left, reverse=True):
        while left.get(n):
            room = capacity - n
            others = {m: c - (m == n) for m, c in left.items() if c - (m == n) > 0}
            small: list[int] = []
            for m in sorted(others):
                small += [m] * min(others[m], 3 - len(small))
                if len(small) == 3:
                    break
            if not small or small[0] > room:
                _fix(fixed, left, ((n, 1),), left[n])
                continue
            best = max(m for m in others if m <= room)
            pair_fits = len(small) > 1 and small[0] + small[1] <= room
            if not pair_fits or best == room or (not (len(small) > 2 and sum(small) <= room) and best >= _best_pair(others, room)):
                times = left[n] // 2 if best == n else min(left[n], left[best])
                _fix(fixed, left, ((n, 2),) if best == n else ((n, 1), (best, 1)), times)
                continue
            if len(small) > 2 and sum(small) <= room:  # three fit
                break
            third = max((m for m in others if m <= room - best and others[m] > (m == best)), default=0)
            if not third or not _dominates(others, room, best, third):
                break
            # What is fixed takes pieces away and adds none, so the pattern holds until one of its lengths runs out.
            need = Counter((n, best, third))
            _fix(fixed, left, tuple(sorted(need.items(), reverse=True)), min(left[m] // k for m, k in need.items()))
    return fixed, left


def _dominates(counts: dict[int, int], room: int, a: int, b: int) -> bool:
    """Whether every pair r >= s that fits in the room has s <= b, or r + s <= a; a is the largest piece that fits."""
    for s in (m for m in counts if m > b):
        for r in (m for m in counts if s <= m <= room - s and m + s > a):
            if r != s or counts[r] > 1:
                return False
    return True


def _fix(fixed: list[Pattern], left: dict[int, int], parts: tuple[tuple[int, int], ...], times: int) -> None:
    fixed.append((times, parts))
    for n, k in parts:
        left[n] -= k * times
        if not left[n]:
            del left[n]


def _best_pair(counts: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that fits."""
    sizes, best = sorted(counts), 0
    i, j = 0, len(sizes) - 1
    while i <= j:
        if sizes[i] + sizes[j] > room:
            j -= 1
        else:
            if i < j or counts[sizes[i]] > 1:
                best = max(best, sizes[i] + sizes[j])
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing: exactly what it does piece by piece, on runs of sequences with equal contents."""
    open_: dict[int, list[Pattern]] = defaultdict(list)  # by room
    for n in sorted(counts, reverse=True):
        todo = counts[n]
        for room in [r for r in sorted(open_) if r >= n]:
            if not todo:
                break
            runs, open_[room] = open_[room], []
            for times, parts in runs:
                each = room // n
                full = min(times, todo // each)
                todo -= full * each
                if full:
                    open_[room - n * each].append((full, (*parts, (n, each))))
                if times > full and todo:
                    open_[room - n * todo].append((1, (*parts, (n, todo))))
                    full, todo = full + 1, 0
                if times > full:
                    open_[room].append((times - full, parts))
        each = capacity // n
        if todo // each:
            open_[capacity - n * each].append((todo // each, ((n, each),)))
        if todo % each:
            open_[capacity - n * (todo % each)].append((1, ((n, todo % each),)))
    return [run for runs in open_.values() for run in runs]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def lookup_tables(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each segment, its first sequence, copies in a sequence, offset of the first copy."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, parts in patterns:
        offset = 0
        for n, copies in parts:
            rows[n].append((ranks[n], sequence, copies, offset))
            ranks[n] += copies * times
            offset += n * copies
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def pieces_of(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (part, rank): a number among the pieces of this length in the part."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            where: list[int] = []
            for row, data in enumerate(enc.encode(batch.column(1).to_pylist())):
                data = closed(data)
                n = len(data) // 4
                start, length = 0, n % capacity or capacity
                piece = 0
                while start < n:
                    where.append(row)
                    rows.append((piece, start, length, crc(data[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
                    piece, start, length = piece + 1, start + length, capacity
            if rows:
                piece, start, length, sums, rank = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(where)), piece, start, length, sums, pa.array([part] * len(rows), pa.int32()), rank], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stored(pieces_of(docs, tokenizer, capacity, doc_id, text), "pieces")
    by_part = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    tables = spark.sparkContext.broadcast(lookup_tables(solve(counts, capacity)))
    # One row a part, with the ranks that its pieces of each length start from: a part's pieces meet it by part, so no task
    # gets all pieces of a length.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select(F.col("length").alias("_l"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.groupBy("_p").agg(F.map_from_entries(F.collect_list(F.struct("_l", "base"))).alias("_of"))
    bases = stored(bases.select("_p", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(capacity).cast("long")), lambda n: F.element_at("_of", n)).alias("_bases")), "bases")

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                mine = length == n
                first, seq, copies, off = tables.value[int(n)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                r = rank[mine] - first[k]
                sequence[mine], offset[mine] = seq[k] + r // copies[k], off[k] + r % copies[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    ranked = pieces.join(bases, F.col("part") == F.col("_p")).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.get("_bases", (F.col("length") - 1).cast("int"))).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
