"""Indexed search over several fields: BM25 per field (the best one counts) and across fields, for many queries at once.

The index is three tables: postings (term, document, what the term adds to it), blocks (for each term and block of
documents, the most that its postings add), terms. A query's bound for a block is what its documents could reach at most;
the blocks with the highest bounds are scored first, the k-th score there is a threshold, and of all other blocks only those
whose bound reaches it are read. The result is that of scoring every document.

A document's score is the sum of two clauses, as a query with both as alternatives gives it:

* best fields: BM25 in each field with its own frequencies; the best field counts, by its boost.
* across fields: each term counts in the field where it is best, with one document frequency for all fields (the largest
  of them), as if they were one field.

Documents are numbered where they are read, once, so postings are made without a shuffle and texts aren't stored; frequencies are
partial sums by term. Statistics meet postings by term, which Spark does by broadcast or splits where a term is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..storage import remove, shared_dir, stored

K1, B = 1.2, 0.75
BLOCK = 128
#: Folders that postings are dealt to by block; a search opens those that hold a wanted block.
PARTS = 32
#: Blocks of each query that are scored to find its threshold.
SEEDS = 2
#: Scores are equal if they are so to this many digits; then the key decides.
DIGITS = 6
#: Scores that a task makes at a time.
CELLS = 1 << 18
#: Wanted terms that are looked for as texts are counted; more of them are met by a join.
ASKED = 200_000


@dataclass(frozen=True)
class FieldIndex:
    """postings: part, block, key, term, best (by field), cross. blocks: term, block, part and the maxima of both."""

    postings: DataFrame
    blocks: DataFrame
    fields: int


def occurrences(docs: DataFrame, fields: list[str], key: str, asked=None) -> DataFrame:
    """key, block, term, tf and dl (by field) of every document and term; for the term "", which no text has, how many documents
    a batch has (key is null) and their lengths in all.

    ``asked`` is a broadcast of the terms that are wanted, or None for all.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted = asked.value if asked else None
        for batch in batches:
            rows, terms, tfs, dls = [], [], [], []
            texts = [batch.column(2 + i).to_pylist() for i in range(len(fields))]
            whole = [[[batch.num_rows] * len(fields)], [[sum(map(len, t)) for t in texts]]]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.array([0], pa.int64()), pa.array([""]), *[pa.array(x, pa.list_(pa.int32())) for x in whole]], names=["key", "block", "term", "tf", "dl"])
            for row in range(batch.num_rows):
                counts = [Counter(t[row] if wanted is None else [w for w in t[row] if w in wanted]) for t in texts]
                lengths = [len(t[row]) for t in texts]
                for term in dict.fromkeys(w for c in counts for w in c):
                    rows.append(row)
                    terms.append(term)
                    tfs.append([c[term] for c in counts])
                    dls.append(lengths)
            for k in range(0, len(rows), 20_000):
                at = pa.array(rows[k : k + 20_000], pa.int32())
                some = [pa.array(x[k : k + 20_000], t) for x, t in ((terms, pa.string()), (tfs, pa.list_(pa.int32())), (dls, pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *some], names=["key", "block", "term", "tf", "dl"])

    kind = docs.schema[key].dataType.simpleString()
    parted = docs.select(F.col(key).alias("key"), "block", *[T.terms(F.coalesce(F.col(f), F.lit(""))).alias(f"_{i}") for i, f in enumerate(fields)])
    return parted.mapInArrow(work, f"key {kind}, block long, term string, tf array<int>, dl array<int>")


def build(docs: DataFrame, best: dict[str, float], cross: dict[str, float], key: str = "doc_id", block: int = BLOCK, parts: int = PARTS, terms: DataFrame | None = None) -> FieldIndex:
    """The index of all terms of ``best``'s fields, of which ``cross`` names some, each with its boost in the clause.

    Null fields are empty. Keys may be of any type and should differ. With ``terms`` (term) the index holds these only, over
    all documents: searches for them find what they find in the whole index.
    """
    spark, fields = docs.sparkSession, list(best)
    if not set(cross) <= set(best):
        raise ValueError("cross fields must be among the best fields")
    ship(spark)
    rows = docs.select(key, *fields).withColumn("block", F.expr(f"monotonically_increasing_id() div {block}"))
    asked = None
    if terms is not None:
        terms = stored(terms.select("term").distinct(), "asked")
        some = [r["term"] for r in terms.limit(ASKED + 1).collect()]
        asked = spark.sparkContext.broadcast(frozenset(some)) if len(some) <= ASKED else None
    found = occurrences(rows, fields, key, asked)
    known_terms = None if terms is None or asked else terms.union(spark.createDataFrame([("",)], "term string"))
    at = shared_dir(spark, "occurrences")
    (found if known_terms is None else found.join(known_terms, "term", "left_semi").select(*found.columns)).write.parquet(at)
    found = spark.read.schema(found.schema).parquet(at)
    n = len(fields)
    lengths = found.where("term = ''").agg(F.sum(F.get("tf", F.lit(0))).alias("n"), *[F.sum(F.get("dl", F.lit(i))).alias(f"l{i}") for i in range(n)]).first()  # one row
    many = float(lengths["n"] or 0)
    average = [(lengths[f"l{i}"] or 0) / many if lengths[f"l{i}"] else 1.0 for i in range(n)]
    found = found.where("term <> ''")
    df = found.groupBy("term").agg(*[F.sum((F.get("tf", F.lit(i)) > 0).cast("long")).alias(f"df{i}") for i in range(n)])
    blended = reduce(F.greatest, [F.col(f"df{i}") for i, f in enumerate(fields) if f in cross]) if len(cross) > 1 else F.col(f"df{fields.index(next(iter(cross)))}") if cross else F.lit(0)

    def idf(d: Column) -> Column:
        return F.log(1.0 + (F.lit(many) - d + 0.5) / (d + 0.5))

    known = stored(df.select("term", F.array(*[idf(F.col(f"df{i}").cast("double")) for i in range(n)]).alias("idf"), idf(blended.cast("double")).alias("idf_cross")), "terms")

    def part(i: int) -> Column:
        tf, dl = F.get("tf", F.lit(i)).cast("double"), F.get("dl", F.lit(i)).cast("double")
        return F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average[i]))).otherwise(0.0)

    weights = [part(i) for i in range(n)]
    each = F.array(*[best[f] * F.get("idf", F.lit(i)) * weights[i] for i, f in enumerate(fields)])
    over = [cross[f] * F.col("idf_cross") * weights[i] for i, f in enumerate(fields) if f in cross] or [F.lit(0.0)]
    scored = found.join(known, "term").select("key", "block", (F.col("block") % parts).cast("int").alias("part"), "term", each.alias("best"), (reduce(F.greatest, over) if len(over) > 1 else over[0]).alias("cross"))
    path = shared_dir(spark, "postings")
    scored.sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(path)
    postings = spark.read.schema(scored.schema).parquet(path)
    tops = [F.max(F.get("best", F.lit(i))).alias(f"b{i}") for i in range(n)]
    remove(spark, at)
    blocks = stored(postings.groupBy("term", "block", "part").agg(*tops, F.max("cross").alias("c")), "blocks")
    return FieldIndex(postings, blocks, n)


def _total(n: int) -> Column:
    """The best field's sum, and the sum across fields."""
    return (reduce(F.greatest, [F.col(f"b{i}") for i in range(n)]) if n > 1 else F.col("b0")) + F.col("c")


def search(index: FieldIndex, queries: DataFrame, k: int, query: str = "query", text: str = "text", seeds: int = SEEDS, reads: list[tuple[int, int]] | None = None) -> DataFrame:
    """query, key, score, rank (from 1) of the k best documents of every query; ``reads`` gets (blocks read, blocks with a term).

    A document needs one of a query's terms, each of which counts once. Queries without terms get no rows.
    """
    spark, n = queries.sparkSession, index.fields
    ship(spark)
    asked = stored(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(T.terms(F.coalesce(F.col(text), F.lit(""))))).alias("term")), "queries")
    tops = asked.join(index.blocks, "term").groupBy("query", "block", "part").agg(*[F.sum(f"b{i}").alias(f"b{i}") for i in range(n)], F.sum("c").alias("c"))
    bounds = stored(tops.select("query", "block", "part", _total(n).alias("bound")), "bounds")
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = stored(bounds.withColumn("_r", F.row_number().over(highest)).where(F.col("_r") <= seeds).drop("_r"), "seeds")
    order = [F.desc("score"), "key"]
    kth = Window.partitionBy("query").orderBy(*order)
    threshold = _scored(index, asked, first.withColumn("threshold", F.lit(None).cast("double")), k).withColumn("_r", F.row_number().over(kth)).where(F.col("_r") == k).select("query", F.col("score").alias("threshold"))
    wanted = stored(bounds.join(threshold, "query", "left").where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - 10.0**-DIGITS)).select("query", "block", "part", "threshold"), "wanted")
    if reads is not None:
        reads.append((wanted.count(), bounds.count()))
    return _scored(index, asked, wanted, k).withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k).select("query", "key", "score", "rank")


def _scorer(n: int, k: int) -> Callable:
    """Scores of a block's documents for the queries that want the block: those that may be among the query's k best."""
    slack = 2 * 10.0**-DIGITS  # scores are rounded later

    def work(postings, asked):
        import pyarrow as pa
        import pyarrow.compute as pc

        at = lambda c: c.combine_chunks().dictionary_encode("encode")
        docs, queries, terms = at(postings.column("key")), at(asked.column("query")), at(postings.column("term"))
        doc, term = docs.indices.to_numpy(), terms.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))])
        values = [np.asarray(postings.column(f"b{i}"))[order] for i in range(n)] + [np.asarray(postings.column("c"))[order]]
        doc, nd = doc[order], len(docs.dictionary)
        code = pc.index_in(asked.column("term").combine_chunks(), terms.dictionary).fill_null(-1).to_numpy()
        query, least = queries.indices.to_numpy(), np.asarray(asked.column("threshold").fill_null(-np.inf))
        by = np.argsort(query, kind="stable")
        some = by[code[by] >= 0]
        ends = np.searchsorted(query[some], np.arange(len(queries.dictionary) + 1))
        floor = np.full(len(queries.dictionary), -np.inf)
        np.maximum.at(floor, query, least)
        out, step = [], max(1, CELLS // nd)
        for a in range(0, len(queries.dictionary), step):
            b = min(a + step, len(queries.dictionary))
            mine = some[ends[a] : ends[b]]
            many = first[code[mine] + 1] - first[code[mine]]
            total = np.concatenate([[0], np.cumsum(many)])
            hit = np.arange(total[-1]) + np.repeat(first[code[mine]] - total[:-1], many)
            cell = np.repeat((query[mine] - a) * nd, many) + doc[hit]
            *best, cross = [np.bincount(cell, v[hit], (b - a) * nd) for v in values]
            score = np.where(np.bincount(cell, minlength=(b - a) * nd) > 0, reduce(np.maximum, best) + cross, -np.inf).reshape(b - a, nd)
            lowest = floor[a:b] if nd <= k else np.maximum(floor[a:b], np.partition(score, nd - k, axis=1)[:, nd - k])
            q, d = np.nonzero((score >= lowest[:, None] - slack) & (score > -np.inf))
            out.append((q + a, d, score[q, d]))
        q, d, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([queries.dictionary.take(pa.array(q)), docs.dictionary.take(pa.array(d)), pa.array(score)], names=["query", "key", "total"])

    return work


def _scored(index: FieldIndex, asked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query, key, score of documents of the wanted blocks (query, block, part, threshold) that hold a term: at least the k best of each query.

    Postings and queries meet by block, where whole scores are made; so no row of a query, a document and a term leaves a task.
    """
    n = index.fields
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]  # at most PARTS
    pairs = asked.join(wanted.select("query", "block", "threshold"), "query")
    postings = index.postings.where(F.col("part").isin(parts)) if parts else index.postings.limit(0)
    read = postings.join(wanted.select("block").distinct(), "block", "left_semi").select("block", "key", "term", *[F.get("best", F.lit(i)).alias(f"b{i}") for i in range(n)], F.col("cross").alias("c"))
    kinds = {"query": asked.schema["query"].dataType.simpleString(), "key": index.postings.schema["key"].dataType.simpleString()}
    met = read.groupBy("block").cogroup(pairs.select("block", "query", "term", "threshold").groupBy("block"))
    found = met.applyInArrow(_scorer(n, k), f"query {kinds['query']}, key {kinds['key']}, total double")
    return found.select("query", "key", F.round("total", DIGITS).alias("score"))
