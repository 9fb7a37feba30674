"""A corpus pipeline of five stages: toxicity, quality rules, n-gram Jaccard join, mixing of sources, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to shared storage as Parquet and reads
again as the next stage's docs. All stages but the last return the columns of documents. Labels come from the table of
that name beside the documents; a stage fits on rows of its own input only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import n_words, stored, table
from basalt.llm.jaccard import jaccard_join
from basalt.llm.mixing import copies, mixed, sized
from basalt.llm.packing import pack
from basalt.llm.quality import quality
from basalt.llm.toxicity import fit, scored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    docs = docs.select(*COLUMNS)
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).where("score < 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram model keep.

    A filter is never pushed below a drawn number, so the rules are evaluated once, in the projections that share them,
    and not again in a filter that repeats all their expressions.
    """
    judged = quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).withColumn("_drawn", F.rand(0))
    return judged.where("kept and _drawn >= 0").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``_key``, by which they are told apart and ordered: id (null last), then a hash of all columns.

    Ids may be null or repeat. Rows of one key are equal in every column, but for two rows of one id (or without one) whose
    64-bit hashes agree.
    """
    whole = [c for name in COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.xxhash64(*whole).alias("hash")).alias("_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, null last, and of equal ids with the smallest hash.

    Rows are judged one by one, with or without an id of their own. Rows without words link with nothing and all stay.
    """
    docs = keyed(docs)
    first = jaccard_join(docs, doc_id="_key").where("doc_id = class_id").select(F.col("doc_id").alias("_key")).distinct()
    alone = F.when(n_words(F.col("text")) == 0, F.monotonically_increasing_id())
    return docs.withColumn("_alone", alone).hint("merge").join(first, "_key", "left_semi").dropDuplicates(["_key", "_alone"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: a document that it takes k times over is k rows.

    Every row counts by itself, with or without an id of its own. Rows that are equal in all columns are one, with the
    copies of all of them.
    """
    docs = keyed(docs)
    rows = docs.select(F.col("_key").alias("doc_id"), "source", "text")
    times = copies(mixed(stored(sized(rows), "sizes"))).where("copies > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").alias("copies"))
    # Both sides are shuffled by key, which serves the join and the rows that are equal: texts move once.
    taken = docs.hint("merge").join(times, "_key").dropDuplicates(["_key"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
