"""Token counts by a two-tier lookup on the map side.

First tier: a broadcast table of frequent pre-tokens and their numbers of tokens, at most ``TABLE_ENTRIES`` entries of at
most ``TABLE_CHARS`` characters. Every task counts the pre-tokens of all its documents in a summary of bounded size and
gives its heavy hitters; sums of these make the table. Second tier: a cache in each worker that encodes what the table
lacks, once. Neither tier changes a count; a pre-token that neither holds is encoded. No pre-token is shuffled: what a
task sends are at most ``TASK_ENTRIES`` sums, however many documents it reads.

The pieces of the vocabulary hold no space sign after another character, so a text's count is the sum over its parts
between single spaces. Texts with other runs of spaces, or with the space sign itself, are encoded whole.

Defined results: null and empty texts have 0 tokens; rows that repeat an id are counted one by one; an empty table gives
no rows; columns beside id and text are left out, whatever their names. The parts of a text are all of it, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_ENTRIES = 1 << 15
TABLE_CHARS = 24
#: Entries that a task's summary ends with, and that it may reach before rare ones go.
TASK_ENTRIES, SUMMARY_ENTRIES = 1 << 13, 1 << 17
CACHED_PARTS = 500_000
CACHED_CHARS = 64
SPACE_SIGN = "▁"

_models: dict[str, object] = {}


def model(name: str = MODEL):
    """The sentence-piece model, once for each process."""
    if name not in _models:
        import sentencepiece

        _models[name] = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    return _models[name]


def whole(text: str) -> bool:
    """Whether spaces of a text don't simply part it."""
    return text.startswith(" ") or text.endswith(" ") or "  " in text or SPACE_SIGN in text


def heavy_hitters(docs: DataFrame, text: str = "text") -> DataFrame:
    """part, n: the most frequent pre-tokens of each task over all its documents, with their counts there."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter[str] = Counter()
        for batch in batches:
            some: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t and not whole(t):
                    some.update(t.split(" "))
            seen.update({p: n for p, n in some.items() if len(p) <= TABLE_CHARS})
            if len(seen) > SUMMARY_ENTRIES:
                seen = Counter(dict(seen.most_common(SUMMARY_ENTRIES // 2)))
        top = [(p, n) for p, n in seen.most_common(TASK_ENTRIES) if n > 1]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"])

    return docs.select(text).mapInArrow(work, "part string, n long")


def frequent_lengths(docs: DataFrame, name: str = MODEL, entries: int = TABLE_ENTRIES, text: str = "text") -> dict[str, int]:
    """The first tier: lengths of the most frequent pre-tokens of all documents."""
    top = heavy_hitters(docs, text).groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(entries).collect()
    parts = sorted(r["part"] for r in top)
    return dict(zip(parts, map(len, model(name).encode(parts, num_threads=1)), strict=True)) if parts else {}


class Counting:
    """Counts of whole texts through both tiers."""

    def __init__(self, name: str, table: dict[str, int]):
        self.name, self.table = name, table
        self.cache = dict(table)

    def count(self, texts: list[str | None]) -> list[int]:
        encode = model(self.name).encode
        out = [0] * len(texts)
        for k in range(0, len(texts), 200):
            parted, alone = [], []
            for i in range(k, min(k + 200, len(texts))):
                if t := texts[i]:
                    (alone if whole(t) else parted).append((i, t))
            for i, t in alone:
                out[i] = len(encode(t))
            parts = [(i, t.split(" ")) for i, t in parted]
            if len(self.cache) > CACHED_PARTS:
                self.cache = dict(self.table)
            missing = list(set().union(*(p for _, p in parts)).difference(self.cache))
            got = dict(zip(missing, map(len, encode(missing, num_threads=1)), strict=True)) if missing else {}
            self.cache.update(got)
            get = self.cache.__getitem__
            for i, p in parts:
                out[i] = sum(map(get, p))
            for p in got:
                if len(p) > CACHED_CHARS:
                    del self.cache[p]
        return out


def token_counts(docs: DataFrame, name: str = MODEL, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, name, text=text))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counting = Counting(name, table.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counting.count(batch.column(2).to_pylist()), pa.int64())], names=[doc_id, "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    sized = docs.select(doc_id, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    return sized.mapInArrow(count, f"{doc_id} {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
