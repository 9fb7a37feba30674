"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed word n-grams (one and two words) are counted, one over every document and one over
trusted documents. The log ratio of an n-gram is that of its count in trusted documents to the count that it would have
there at the raw corpus's rate, both with the same pseudo-count, so that what is rare in the raw corpus says little if
trusted documents lack it. A document's verdict is the mean log ratio of its n-grams against a fixed threshold. All of it
is built-in expressions: no Python runs on executors.

Log ratios are rounded to integers (in 1/10,000 nats), so that sums don't depend on the order of rows.

Defined results: null or blank text has no words and fails the base rule; without any trusted document every ratio is
0 and the base rule decides alone; repeated rows are judged one by one and counted as often as they occur; an empty
table gives no rows. Columns beside the id and the text pass through, but those with the name of an output (the base
figures, ratio_sum, n_ngrams, kept) are replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words

#: A power of two.
BUCKETS = 1 << 18
#: Counts in one column.
SLOTS = 1 << 16
SCALE = 10_000
#: Mean log ratio, in nats, from which a document is kept; the mean counts PRIOR_NGRAMS more n-grams of ratio 0, so that
#: a few rare words don't decide on a short text.
THRESHOLD = -0.08
PRIOR_NGRAMS = 60
#: Most trusted documents that the target multinomial is fitted on; taken in the order of a hash of their ids.
TRUSTED_ROWS = 20_000
SMOOTHING = 16.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SHINGLE = 5
SYMBOLS = "#*$%&|<>"


def repeated_positions(word_array: Column, width: int = SHINGLE) -> Column:
    """How many words lie in windows of ``width`` words that occur at least twice in the array, the first one included.

    Sorting the windows by hash puts equal ones side by side: n log n for the longest text, and nothing leaves the row.
    """
    n = F.size(word_array)
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(word_array, i + k) for k in range(width)]))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))

    def twice(pairs: Column) -> Column:
        same = lambda p, i, k: F.coalesce(F.get(pairs, i + k)["h"] == p["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda p, i: (i > 0) & same(p, F.greatest(i, F.lit(1)), -1) | same(p, i, 1)), lambda p: p["i"]))

    def covered(hs: Column) -> Column:
        at = _let(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)
        return F.aggregate(at, nothing, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs)))


def _let(value: Column, body) -> Column:
    """Binds a value once for an expression that uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_quality_words``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    out = docs.withColumn("_quality_words", words(F.col(text)))
    out = out.withColumn("_quality_hashes", F.transform(F.col("_quality_words"), lambda w: F.crc32(w.cast("binary"))))
    return (
        out.withColumn("n_words", F.size("_quality_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"))
        .withColumn("n_repeat_words", repeated_positions(F.col("_quality_words")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def _single(h: Column, buckets: int) -> Column:
    """The bucket of a word, by its hash."""
    return h.bitwiseAND(F.lit(buckets - 1).cast("long"))


def _double(a: Column, b: Column, buckets: int) -> Column:
    """The bucket of two neighbours; null without a second one."""
    return (a * 31 + b * 1_000_003 + 7).bitwiseAND(F.lit(buckets - 1).cast("long"))


def _after(hashes: Column) -> Column:
    return F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS, doc_id: str = "doc_id") -> DataFrame:
    """Ids of at most ``rows`` documents labelled as good, in the order of a hash: a bounded sample that a broadcast can carry."""
    return labels.where(F.col("quality") == 1).select(F.col(doc_id).alias("_trusted")).where("_trusted is not null").distinct().orderBy(F.crc32(F.col("_trusted").cast("string").cast("binary")), "_trusted").limit(rows)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, text: str = "text", doc_id: str = "doc_id") -> list[int]:
    """One integer for each bucket; what comes to the driver is as long as the bucket table, whatever the corpus."""
    raw = _counts(docs.select(F.col(text).alias("_text")), buckets)
    # The trusted documents are few, and are counted apart: most rows then carry nothing but their text.
    few = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"))
    target = _counts(few.select("_text"), buckets)
    return ratios_of(raw, target, smoothing).tolist()


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket.

    Words meet their successors in the row and become rows of two hashes; all that follows is generated code. Counts are
    kept ``SLOTS`` to a column, as many as the generated hash map of a task's partial sums holds.
    """
    slots = min(SLOTS, buckets)
    hashed = texts.select(F.transform(words(F.col("_text")), lambda w: F.crc32(w.cast("binary"))).alias("h"))
    pairs = hashed.select(F.explode(F.arrays_zip("h", _after(F.col("h")))).alias("x")).select("x.*").toDF("a", "b")
    both = pairs.select(_single(F.col("a"), buckets).alias("u"), _double(F.col("a"), F.col("b"), buckets).alias("v"))
    grams = both.select(F.stack(F.lit(2), "u", "v").alias("k")).where("k is not null")
    columns = [F.sum((F.shiftright("k", slots.bit_length() - 1) == i).cast("long")).alias(f"n{i}") for i in range(buckets // slots)]
    counts = grams.groupBy(_single(F.col("k"), slots).alias("slot")).agg(*columns).toArrow()
    out, at = np.zeros(buckets, np.int64), counts.column("slot").to_numpy()
    for i in range(buckets // slots):
        out[at + i * slots] = counts.column(f"n{i}").to_numpy()
    return out


def ratios_of(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """Rounded log ratios of each bucket's trusted count to the one expected at the raw rate; 0 without trusted n-grams."""
    raw_all, target_all = float(raw.sum()), float(target.sum())
    if not target_all:
        return np.zeros(len(raw), np.int64)
    return np.rint(np.log((target + smoothing) / (raw * target_all / raw_all + smoothing)) * SCALE).astype(np.int64)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, the base figures, ``ratio_sum`` (in 1/10,000 nats over all n-grams), n_ngrams and kept."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    table = log_ratios(docs, trusted_ids(labels, trusted_rows, doc_id), buckets, text=text, doc_id=doc_id)
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    out = base_rules(docs, text)

    def ratio(t: Column) -> Column:
        """The sum over a row's words, each with the pair that it begins."""
        at = lambda k: F.get(t, k.cast("int"))
        both = lambda a, b: at(_single(a, buckets)) + F.coalesce(at(_double(a, b, buckets)), F.lit(0))
        return F.aggregate(F.zip_with("_quality_hashes", _after(F.col("_quality_hashes")), both), F.lit(0).cast("long"), lambda s, v: s + v)

    n = F.size("_quality_hashes")
    return (
        out.withColumn("n_ngrams", (n + F.greatest(n - 1, F.lit(0))).cast("long"))
        .withColumn("ratio_sum", _let(known, ratio))
        .withColumn("kept", ~F.col("base_failed") & (F.col("ratio_sum") >= F.lit(round(threshold * SCALE)) * (F.col("n_ngrams") + PRIOR_NGRAMS)))
        .drop("_quality_words", "_quality_hashes")
    )
