"""Phrase collocations by suffix-sigma.

Every word starts a suffix, which ends with its piece of text or after ``max_n`` words. Suffixes go to tasks by language
and first word; there they are sorted reverse-lexicographically, so that a phrase's extensions come before it, and one
stack counts all prefixes. A phrase's parts are joined to it afterwards.

What makes this hold at size:

* A task numbers its words, sorts suffixes as numbers, and puts those of one first word in one row (distinct ones with their
  counts, in reverse order, at most ``CHUNK`` a row): what is shuffled are words' rows and not a row for each suffix.
* A word that holds more than a quarter of a partition's share (found in a first pass over all texts, at most four such
  words a partition) is dealt out by its second word, and if that is such a word too, by the second and third. Counts of
  prefixes that are so parted are partial, and summed afterwards; all others are complete in their task.
* Rows of a word come in the order of their first suffix, so a task merges them as sorted runs: what lies before the next
  row's first suffix is final and counted. A task holds one row of each writing task at most, beside ``PENDING`` suffixes.

Scores are quotients of exact decimals (38 digits, enough for counts of 10^15).

Defined results: null and empty texts have no words; a null language is ``und``, together with that language itself;
rows count one by one, also those that repeat; texts are read whole, however long, and words of any length count; an
empty table gives no rows; other columns are left out, whatever their names. Equal scores go by count, then by the bytes of
the phrase.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

MAX_N = 3
LEAST = 10
TOP = 2000
UNKNOWN = "und"
#: Words and bytes of text that a task gathers before it writes rows; suffixes in a row; suffixes that a merge holds.
GATHERED, GATHERED_BYTES = 1 << 21, 1 << 25
CHUNK = 4096
PENDING = 1 << 18
#: Words in a task's summary of frequent ones.
SUMMARY = 1 << 17
OUT_ROWS, OUT_BYTES = 5000, 1 << 22

#: Ends of pieces become line feeds, tabs spaces and A-Z lower case; then nothing but spaces and line feeds parts words.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Ends a word within a suffix, and a suffix within a row; neither occurs in words.
_WORD, _SUFFIX = b"\n", b"\r"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, with a line feed between pieces, and empty strings anywhere."""
    return (text or "").encode().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")


def hot_words(docs: DataFrame, parts: int) -> set[tuple[str, bytes]]:
    """(lang, word) of more than a quarter of a partition's share of all words; at most 4 * ``parts``.

    Only how work is dealt out depends on it: a word that a task's bounded summary loses changes no count.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[str, Counter] = defaultdict(Counter)
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(words := (text or "").encode().translate(_PLAIN).split())
                total += len(words)
            if sum(map(len, seen.values())) > SUMMARY:
                each = SUMMARY // 2 // len(seen) + 1
                seen = defaultdict(Counter, {lang: Counter(dict(c.most_common(each))) for lang, c in seen.items()})
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items() if n * 16 * parts > total]
        rows.append((None, b"", total))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    summed = stored(docs.mapInArrow(work, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    total = summed.where("lang is null").first()  # one row
    least = total["n"] / (4 * parts) if total else 0
    return {(r["lang"], bytes(r["word"])) for r in summed.where("lang is not null").where(F.col("n") > least).collect()}


class Numbers(dict):
    """Numbers of words, in the order in which they come; 0 parts pieces, and empty strings have none."""

    def __init__(self):
        super().__init__({_WORD: 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def distinct(columns: list[np.ndarray], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of columns of numbers up to ``most``, the largest first, and how often each occurs."""
    bits = int(most).bit_length()
    if bits * len(columns) > 63:
        rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return [rows[::-1, k] for k in range(len(columns))], n[::-1]
    packed = columns[0].astype(np.int64)
    for c in columns[1:]:
        packed = packed << bits | c
    rows, n = np.unique(packed, return_counts=True)
    rows = rows[::-1]
    return [rows >> bits * k & (1 << bits) - 1 for k in reversed(range(len(columns)))], n[::-1]


class Gathered:
    """Words of one language that a task has read, as numbers."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.read, self.many = lang, Numbers(), [], 0

    def add(self, text: str | None) -> int:
        words = tokens(text)
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        found = found[found >= 0]
        self.read += [found, np.zeros(1, np.int32)]
        self.many += len(found)
        return len(found)

    def rows(self, hot: set[tuple[str, bytes]], salts: int, max_n: int, chunk: int) -> Iterator:
        """Record batches of the distinct suffixes, in reverse order within (word, salt)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        numbers = self.numbers
        names = [w for w, n in numbers.items() if n > 0]
        if not names:
            return
        ends = [w + _WORD for w in names]  # as suffixes have them: bytes below the end of a word sort before it
        order = sorted(range(len(names)), key=ends.__getitem__)
        ordered = [names[k] for k in order]
        rank = np.zeros(len(names) + 1, np.int32)  # of each number; no word has rank 0
        rank[np.asarray(order, np.int64) + 1] = np.arange(1, len(names) + 1, dtype=np.int32)
        text = rank[np.concatenate(self.read)]
        columns = [text]
        for k in range(1, max_n):
            after, some = np.zeros_like(text), max(len(text) - k, 0)
            after[:some] = np.where(columns[-1][:some] > 0, text[k:], 0)  # nothing follows the end of a piece
            columns.append(after)
        starts = text > 0
        columns, n = distinct([c[starts] for c in columns], len(names))
        is_hot = np.zeros(len(names) + 1, bool)
        is_hot[[int(rank[numbers[w]]) for lang, w in hot if lang == self.lang and w in numbers]] = True
        salt = np.zeros(len(n), np.int64)
        parted = np.flatnonzero(is_hot[columns[0]])
        if max_n > 1 and len(parted):
            sums = np.fromiter(map(zlib.crc32, [b"", *ordered]), np.int64, len(names) + 1)
            second, third = columns[1][parted], columns[2][parted] if max_n > 2 else np.zeros(len(parted), np.int64)
            salt[parted] = np.where(is_hot[second], 1 + salts + (31 * sums[second] + sums[third]) % salts, 1 + sums[second] % salts)
        group = columns[0].astype(np.int64) * (2 * salts + 2) + salt
        by = np.argsort(-group, kind="stable")
        group, salt, n = group[by], salt[by], n[by].astype(np.int32)
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        inside = np.arange(len(group)) - np.repeat(new, np.diff(np.r_[new, len(group)]))
        first = np.flatnonzero(inside % chunk == 0)
        ended = pa.array([b"", *(ends[k] for k in order)], pa.binary())
        parts = [ended.take(pa.array(c[by])) for c in columns[1:]]
        rest = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary())) if parts else pa.array([b""] * len(n), pa.binary())
        offsets = pa.array(np.r_[first, len(n)].astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, rest), pa.scalar(_SUFFIX, pa.binary()))
        words = pa.array([b"", *ordered], pa.binary()).take(pa.array(columns[0][by][first]))
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(first), pa.string()), words, pa.array(salt[first].astype(np.int32)), rest.take(pa.array(first)), joined, pa.ListArray.from_arrays(offsets, pa.array(n))],
            names=["lang", "word", "salt", "first", "rests", "counts"],
        )
        size = np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False) + 64)
        at = 0
        while at < len(first):
            end = max(at + 1, min(at + OUT_ROWS, int(np.searchsorted(size, size[at] + OUT_BYTES))))
            yield out.slice(at, end - at)
            at = end


def suffix_rows(docs: DataFrame, hot: set[tuple[str, bytes]], salts: int, max_n: int = MAX_N, gathered: int = GATHERED, chunk: int = CHUNK) -> DataFrame:
    """lang, word, salt, first, rests, counts: what follows a word in its suffixes, in reverse order, at most ``chunk`` a row."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator) -> Iterator:
        of: dict[str, Gathered] = {}
        many = size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in of:
                    of[lang] = Gathered(lang)
                many += of[lang].add(text)
                size += len(text or "")
                if many >= gathered or size >= GATHERED_BYTES:
                    for one in of.values():
                        yield from one.rows(shared.value, salts, max_n, chunk)
                    of, many, size = {}, 0, 0
        for one in of.values():
            yield from one.rows(shared.value, salts, max_n, chunk)

    return docs.mapInArrow(work, "lang string, word binary, salt int, first binary, rests binary, counts array<int>")


class Prefixes:
    """Counts all prefixes of one word's suffixes, which come in reverse-lexicographic order, with one stack.

    The stack holds the open prefixes, the shortest (the word alone) below; a prefix is closed, and its count goes to the one
    below it, when a suffix comes that it doesn't begin. A suffix itself never opens: what it begins came before it.
    """

    def __init__(self, least: int, parted: int, emit):
        self.open, self.counts, self.least, self.parted, self.emit = [b""], [0], least, parted, emit

    def add(self, order: Iterable[bytes], n_of) -> None:
        open_, counts, least, parted, emit = self.open, self.counts, self.least, self.parted, self.emit
        for rest in order:
            n = n_of(rest)
            while not rest.startswith(open_[-1]):
                done = counts.pop()
                if done >= least or len(open_) <= parted:
                    emit(open_[-1], len(open_), done)
                open_.pop()
                counts[-1] += done
            at, end = len(open_[-1]), len(rest)
            if at < end:
                while (cut := rest.find(_WORD, at) + 1) < end:
                    open_.append(rest[:cut])
                    counts.append(0)
                    at = cut
                if n >= least or len(open_) < parted:
                    emit(rest, len(open_) + 1, n)
            counts[-1] += n

    def end(self) -> int:
        """Closes the rest; gives the word's own count."""
        while True:
            n = self.counts.pop()
            if n >= self.least or len(self.open) <= self.parted:
                self.emit(self.open[-1], len(self.open), n)
            self.open.pop()
            if not self.open:
                return n
            self.counts[-1] += n


class Merge:
    """Suffixes of one word from sorted rows, given on in order as soon as no later row can hold one before them."""

    def __init__(self, least: int, parted: int, pending: int, emit):
        self.to, self.limit, self.rows, self.held = Prefixes(least, parted, emit), pending, [], {}
        self.many = self.total = 0
        self.needed = least if not parted else 0

    def add(self, first: bytes, rests: bytes, counts: list[int]) -> None:
        self.rows.append((rests, counts))
        self.many += len(counts)
        self.total += sum(counts)
        if self.many > self.limit:
            self._merge()
            order = sorted(self.held, reverse=True)
            final = [s for s in order if s > first]
            self.to.add(final, self.held.pop)
            self.many = len(self.held)

    def _merge(self) -> None:
        held = self.held
        for rests, counts in self.rows:
            for s, n in zip(rests.split(_SUFFIX), counts, strict=True):
                held[s] = held.get(s, 0) + n
        self.rows = []

    def end(self) -> int:
        """Counts what is left; gives the word's own count. A word that is too rare has no prefix that isn't."""
        if self.total < self.needed:
            return self.total
        if not self.held and len(self.rows) == 1:  # one row is in order, and has no suffix twice
            rests, counts = self.rows[0]
            self.held = dict(zip(rests.split(_SUFFIX), counts, strict=True))
            self.to.add(self.held, self.held.__getitem__)
        else:
            self._merge()
            self.to.add(sorted(self.held, reverse=True), self.held.__getitem__)
        return self.to.end()


def counted(rows: DataFrame, salts: int, least: int = LEAST, pending: int = PENDING) -> DataFrame:
    """lang, phrase, k, f, partial of all prefixes with enough occurrences; of those that salts part, all (``partial``).

    k = 0 has the number of all words of a language in this task.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
        out: list[tuple] = []
        totals: Counter[str] = Counter()
        key, merge, parted, lang, word = None, None, 0, None, b""

        def emit(rest: bytes, k: int, n: int) -> None:
            out.append((lang, b" ".join([word, *rest.split(_WORD)[:-1]]), k, n, k <= parted))

        def batch_of(some: list[tuple]):
            lang, phrase, *rest = (pa.array(x, t) for x, t in zip(zip(*some, strict=True), types, strict=True))
            return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), *rest], names=["lang", "phrase", "k", "f", "partial"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            n, ends = batch.column(5).flatten().to_pylist(), np.cumsum(batch.column(5).value_lengths().to_numpy()).tolist()
            at = 0
            for i, (found, first, rests) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if found != key:
                    if merge:
                        totals[lang] += merge.end()
                    key, (lang, word, salt) = found, found
                    parted = 0 if salt == 0 else 1 if salt <= salts else 2
                    merge = Merge(least, parted, pending, emit)
                merge.add(first, rests, n[at : ends[i]])
                at = ends[i]
                if len(out) >= OUT_ROWS:
                    yield batch_of(out)
                    out.clear()
        if merge:
            totals[lang] += merge.end()
        out += [(lang, b"", 0, n, True) for lang, n in totals.items()]
        if out:
            yield batch_of(out)

    sorted_ = rows.repartition("lang", "word", "salt").sortWithinPartitions("lang", "word", "salt", F.desc("first"))
    return sorted_.mapInArrow(work, "lang string, phrase string, k int, f long, partial boolean")


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, lang: str = "lang", text: str = "text", parts: int | None = None, gathered: int = GATHERED, chunk: int = CHUNK, pending: int = PENDING) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``max_n`` words with at least ``least`` occurrences, and (lang, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(counted(suffix_rows(docs, hot_words(docs, parts), parts, max_n, gathered, chunk), parts, least, pending), "phrases")
    whole = found.where("not partial").drop("partial")
    summed = found.where("partial and k > 0").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return whole.unionByName(summed), found.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))


def _joined(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def maximal(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """lang, phrase, k, a of the candidates (two words and more) that no longer one of at least half their count contains."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _joined(words, i, m))))
    inside = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("a"), F.col("f").alias("longer"))
    own = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.lit(None).cast("long").alias("longer"))
    both = own.unionByName(inside).groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.max("a").alias("a"), F.max("longer").alias("longer"))
    return both.where(F.col("a").isNotNull() & (F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))).drop("longer")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text", **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    phrases, totals = phrase_counts(docs, max_n, least, lang, text, **sizes)
    words = F.split("phrase", " ")
    cuts = maximal(phrases).select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(words, F.lit(1), F.col("cut")).alias("left"), _joined(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]).drop(part)
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns({"_top": exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)"), "_below": exact["l"] * exact["r"]}).withColumn("score", F.expr("_top div _below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
