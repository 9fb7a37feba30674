"""Ranked lexical search over a tiered index.

The index has one posting for each term and document, with its impact: what the term adds to a document's score. A term's
postings are dealt to tiers by impact: the first tier holds its highest ones, ``TIERS[0]`` at most, the next one further
ones, up to ``TIERS[1]`` in all, and so on; the last holds all others. For each tier, a term has a residual bound: the
largest impact that the tiers below hold.

All items search the first tier together. An item's best documents there are scored exactly (from the forward table), and
the k-th of these scores is a threshold. No document that the tier lacks can reach more than the sum of the residual
bounds of the item's terms; if that is below the threshold, the result is proven to lie among the documents found, and of
these only the ones whose bound reaches the threshold are scored. Items without this proof fall through to the next tier,
which adds its postings to those above. In the last tier bounds are zero and every result is exact.

The index holds the terms of the items that it is built for, by a bitmap of fixed size (so a few more terms), over all
documents and their whole texts. Statistics count all documents and terms.

Rows are found by number, so ids may be null or repeat: every row is a document, and every item row an item. Nothing is
moved by term but sums: postings stay in the tasks that made them, and meet the items' terms, which Spark sends to them while
they are below its broadcast threshold.

Defined results: null and empty texts have no terms, and an item without any gets no rows; texts are read whole, however
long; equal scores go by document id, null last, then by row; empty tables give no rows; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

#: Postings of a term down to each tier but the last.
TIERS = (1_000, 30_000)
K = 10
#: Weight of a document's length, in hundredths, and of it against the term's frequency.
LENGTH, SATURATION = 75, 8
#: Impacts are put in order by this many levels.
LEVELS = 64
#: Bits of the bitmap of terms; terms of which a worker remembers whether they are in it.
BITS = 1 << 21
CACHED = 1 << 19
#: Documents of each item that are scored to find its threshold.
SEEDS = 30

#: Letters and digits stay, A-Z in lower case, and so does all that isn't ASCII; the rest parts terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


class Wanted(dict):
    """Whether terms are in a bitmap."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, term: bytes) -> bool:
        h = bit(term)
        self[term] = found = bool(self.bitmap[h >> 3] >> (h & 7) & 1)
        return found


def bit(term: bytes) -> int:
    return zlib.crc32(term) % BITS


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (its number), item_id, term, q (occurrences)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                rows += [(number, row, t, q) for t, q in Counter(terms(text)).items()]
                number += 1
            for k in range(0, len(rows), 10_000):
                number_, row, term, q = zip(*rows[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number_, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(term, pa.binary()).cast(pa.string()), pa.array(q, pa.int64())], names=["item", "item_id", "term", "q"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(item_id, text).mapInArrow(work, f"item long, item_id {kind}, term string, q long")


def bitmap_of(wanted: DataFrame) -> bytes:
    """The bitmap of terms: each task makes one of its own, of fixed size, and the driver gets their union."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = set()
        for batch in batches:
            bits.update(bit(t.encode()) for t in batch.column(0).to_pylist())
        some = sorted(bits)
        for k in range(0, len(some), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 10_000], pa.int32())], names=["b"])

    out = bytearray(BITS >> 3)
    for r in wanted.select("term").mapInArrow(work, "b int").distinct().toLocalIterator():  # at most BITS
        out[r["b"] >> 3] |= 1 << (r["b"] & 7)
    return bytes(out)


def forward(docs: DataFrame, bitmap: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, n, terms, tfs of every document that has a term; only terms of the bitmap are listed."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        wanted, rid = Wanted(shared.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, lengths, ends, found, tfs = [], [], [0], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                all_ = terms(t)
                if not all_:
                    continue
                counts = Counter(all_)
                mine = [x for x in counts if wanted[x]]
                found += mine
                tfs += map(counts.__getitem__, mine)
                rows.append(row)
                lengths.append(len(all_))
                ends.append(len(found))
            if len(wanted) > CACHED:
                wanted.clear()
            if rows:
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(found, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + len(rows)), pa.int64()), batch.column(0).take(pa.array(rows)), pa.array(lengths, pa.int64()), *lists], names=["rid", "doc_id", "n", "terms", "tfs"])
                rid += len(rows)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(work, f"rid long, doc_id {kind}, n long, terms array<string>, tfs array<long>")


@dataclass(frozen=True)
class Index:
    """docs: the forward table; terms: term, w and a residual bound for each tier; postings: term, rid, impact, tier."""

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    tiers: int
    n_docs: int
    n_terms: int

    def exact(self, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        """item, rid, doc_id, score of (item, rid), from the forward table."""
        rows = self.docs.join(pairs.select("item", "rid"), "rid").select("item", "rid", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        rows = rows.select("item", "rid", "doc_id", F.col("x.terms").alias("term"), saturation(F.col("x.tfs"), F.col("n"), self.n_docs, self.n_terms).alias("s"))
        # Ids may be null or of any type: they are carried along with their row.
        return rows.join(wanted, ["item", "term"]).groupBy("item", "rid").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("q") * F.col("w") * F.col("s")).alias("score"))


def saturation(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """(10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L, in 64-bit integers."""
    m = F.lit(100 - LENGTH) + _div(n * F.lit(LENGTH * n_docs).cast("long"), F.lit(n_terms).cast("long"))
    return _div(tf * 1_000_000_000, tf * 1000 + m * SATURATION)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return F.call_function("div", a, b)


def build(docs: DataFrame, wanted: DataFrame, tiers: tuple[int, ...] = TIERS, doc_id: str = "doc_id", text: str = "text") -> Index | None:
    """The index of all documents for the terms of items (as ``item_terms`` gives them); None if no document has a term."""
    spark = docs.sparkSession
    small_batches(spark)
    table = stored(forward(docs, bitmap_of(wanted), doc_id, text), "forward")
    sums = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all")).first()  # one row
    if not sums["n"]:
        return None
    n_docs, n_terms = sums["n"], sums["all"]
    single = table.select("rid", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("rid", F.col("x.terms").alias("term"), saturation(F.col("x.tfs"), F.col("n"), n_docs, n_terms).alias("s"))
    single = single.withColumn("level", _div(F.col("s") * LEVELS, F.lit(1_000_000).cast("long")).cast("int"))
    levels = single.groupBy("term", "level").agg(F.count(F.lit(1)).alias("many"), F.max("s").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("down", F.sum("many").over(down))
    df = F.sum("many")
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * df + 1).cast("double"))).cast("long")
    froms = [F.coalesce(F.min(F.when(F.col("down") <= most, F.col("level"))), F.lit(LEVELS + 1)).alias(f"from{i}") for i, most in enumerate(tiers)]
    rests = [F.coalesce(F.max(F.when(F.col("down") > most, F.col("top"))), F.lit(0)).alias(f"rest{i}") for i, most in enumerate(tiers)]
    known = stored(levels.groupBy("term").agg(weight.alias("w"), *froms, *rests), "terms")
    tier: Column = F.lit(len(tiers))
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col("level") >= F.col(f"from{i}"), i).otherwise(tier)
    placed = single.join(known.select("term", "w", *[f"from{i}" for i in range(len(tiers))]), "term")
    path = shared_dir(spark, "postings")
    placed.where("w > 0").select("term", "rid", (F.col("w") * F.col("s")).alias("impact"), tier.alias("tier")).write.partitionBy("tier").parquet(path)
    postings = spark.read.schema("term string, rid long, impact long, tier int").parquet(path)
    bounds = known.select("term", "w", *[F.col(f"rest{i}") for i in range(len(tiers))], F.lit(0).cast("long").alias(f"rest{len(tiers)}"))
    return Index(table, bounds, postings, len(tiers) + 1, n_docs, n_terms)


def _best(scored: DataFrame, k: int, order: list) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def ranked(index: Index, wanted: DataFrame, k: int = K, proofs: list[int] | None = None) -> DataFrame:
    """item, rank, rid, doc_id, score: the first k documents of each item. ``proofs`` gets the items proven by each tier."""
    spark = index.docs.sparkSession
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid"]
    todo = stored(wanted.join(index.terms, "term"), "wanted")
    results = []
    for tier in range(index.tiers):
        rest = F.col("q") * F.col("w") * F.col(f"rest{tier}")
        postings = index.postings.where(F.col("tier") <= tier)
        found = postings.join(todo.select("item", "term", "q", rest.alias("rest")), "term").groupBy("item", "rid").agg(F.sum(F.col("q") * F.col("impact")).alias("low"), F.sum("rest").alias("seen"))
        if tier == index.tiers - 1:  # bounds are zero, so sums are scores
            if proofs is not None:
                proofs.append(todo.select("item").distinct().count())
            ties = found.withColumn("_r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("_r") <= k)
            ties = ties.select("item", "rid", F.col("low").alias("score")).join(index.docs.select("rid", "doc_id"), "rid")
            results.append(_best(ties, k, order).select("item", "rank", "rid", "doc_id", "score"))
            break
        found = stored(found, "found")
        seeds = stored(_best(found, max(k, SEEDS), [F.desc("low"), "rid"]).select("item", "rid"), "seeds")
        kth = index.exact(seeds, todo.select("item", "term", "q", "w")).withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("_r") == k).select("item", F.col("score").alias("threshold"))
        bounds = todo.groupBy("item").agg(F.sum(rest).alias("bound")).join(kth, "item", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))
        bounds = stored(bounds.withColumn("proven", (F.col("bound") == 0) | (F.col("bound") < F.col("threshold"))), "bounds")
        proven = bounds.where("proven").select("item", "bound", "threshold")
        pairs = stored(found.join(proven, "item").where("low + bound - seen >= threshold").select("item", "rid"), "pairs")
        results.append(stored(_best(index.exact(pairs, todo.select("item", "term", "q", "w")), k, order).select("item", "rank", "rid", "doc_id", "score"), "ranked"))
        if proofs is not None:
            proofs.append(proven.count())
        todo = stored(todo.join(bounds.where("not proven").select("item"), "item", "left_semi"), "wanted")
        if todo.isEmpty():
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, tiers: tuple[int, ...] = TIERS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", proofs: list[int] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest above 0 for each item, over all documents."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    wanted = stored(item_terms(items, item_id, item_text), "items")
    index = build(docs, wanted, tiers, doc_id, text)
    if index is None:
        return wanted.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    names = wanted.groupBy("item").agg(F.first("item_id").alias("item_id"))
    return ranked(index, wanted, k, proofs).where("score > 0").join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
