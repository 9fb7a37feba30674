"""Mixing sources to target weights: fixed-length blocks, drawn counts for each output shard, permuted block indices.

The words of each source are one stream, cut into blocks of ``block`` words (the last one may be shorter). An output
shard holds about ``shard_slots`` slots, and every slot draws its source: the k-th slot of shard s takes the variate

    u(s, k) = (permutation_k(s) + v_k) / shards

with a pseudorandom permutation of the shards and a pseudorandom v_k in [0, 1) for each k. A source gets the slots whose
variates lie in its interval of [0, 1), as long as its share. Within one shard the variates are independent and uniform,
so the counts of its sources are a multinomial draw. Between shards the k-th variates are evenly spaced, so a source's
total over all shards misses its expectation by less than one slot for each k, whatever the number of shards: that keeps
sources near their targets.

Evenly spaced variates also mean that a source's slots of one k are a run of whole numbers, so they need no join and no
sort: runs are numbered by sums over k. Number j of a source with n blocks reads block perm(j mod n) of pass j div n,
where perm is a pseudorandom permutation of the source in that pass. Slots and blocks then meet in one join by (source,
block).

Shares are whole numbers (fixed point), so sums don't depend on the order of rows, and all draws are functions of the
seed: reruns agree. Sources are numbered by ranges, the targets' level is found by Newton steps over three sums, and
positions in a source's stream come from two levels of sums, over hashed groups of documents and within a group. So no
task walks a whole source or all sources, and the driver sees a few numbers only. Everything is built-in expressions.

Defined results: null text or text without words has size 0 and takes nothing; null is a source of its own, the last;
with no words at all every target is 0; rows that repeat an id are documents of their own (of rows equal in id, source
and size, which are alike to a mix, each gets its own place); columns beside id, source and size are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

BLOCK = 64
SHARD_SLOTS = 16
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Slots or equal rows that one row stands for until it has been dealt to a task, and slots that a task makes.
RUN = 4096
TASK_SLOTS = 200_000
#: Shares are counted in 2^-20 slots, variates in 2^-20 of their stratum.
UNIT = 1 << 20
_PLACES, _SHARDS, _BLOCKS = 11, 12, 13  # kinds of draws


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``source_no`` by code point, null last, and ``_part``: parts of consecutive numbers.

    Rows are dealt by ranges, numbered in their part, and moved on by the sizes of the parts before (one row a part).
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = stored(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sources")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_at", inside).join(parts.select("_part", before.alias("_before")), "_part").withColumn("source_no", F.col("_at") + F.col("_before")).drop("_at", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size -> the same with ``source_no``, ``_part``, weight and target; stored.

    The target is the smaller one of level x weight and ``most_times`` the size, with the level at which targets add up
    to all sizes. The sum of targets is concave in the level, so Newton steps from below end at it after a few sums.
    """
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no"), F.lit(len(weights))).cast("int"))
    rows = stored(numbered(sizes).withColumn("weight", weight.cast("long")), "weights")
    cap, level, total = F.col("source_size") * most_times, 0.0, None
    while True:
        full = cap < F.col("weight") * F.lit(level)
        r = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, cap).otherwise(0)).alias("capped"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free")).first()
        total = r["total"] or 0
        above = (total - (r["capped"] or 0)) / r["free"] if r["free"] else level
        if above <= level:
            break
        level = above
    return stored(rows.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double"))), "targets")


def placed(docs: DataFrame, shares: DataFrame) -> DataFrame:
    """doc_id, source, size -> each different row once, with its number of rows ``_c``, where the words of the first one
    ``start`` in their source, and the columns of ``shares``; stored."""
    groups = max(1, int(docs.count() ** 0.5))
    rows = docs.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)))
    words = F.coalesce(F.col("size"), F.lit(0)) * F.col("_c")
    sums = rows.groupBy("source", "_g").agg(F.sum(words).alias("_sum"))
    before = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_g").alias("_h"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_g").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_g") == F.col("_h"))).withColumn("start", F.col("_at") + F.col("_base")).drop("_s", "_h", "_g", "_at", "_base")
    known = shares.select(F.col("source").alias("_s"), "source_no", F.col("source_size").cast("long").alias("source_size"), "target")
    return stored(rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "placed")


def each(rows: DataFrame) -> DataFrame:
    """The rows that ``_c`` counts, one by one with a ``start`` of its own; long runs are dealt to tasks first."""
    runs = rows.where(F.col("_c") > RUN).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1, F.lit(RUN).cast("long"))))
    runs = runs.withColumn("_c", F.least(F.lit(RUN), F.col("_c") - F.col("_i"))).withColumn("start", F.col("start") + F.col("_i") * F.coalesce("size", F.lit(0))).drop("_i")
    runs = runs.repartition("source_no", "start", "_c").unionByName(rows.where(F.col("_c") <= RUN))
    return runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1))).withColumn("start", F.col("start") + F.col("_i") * F.coalesce("size", F.lit(0))).drop("_i", "_c")


def _hash(seed: int, kind: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), F.lit(kind).cast("long"), *keys)


def slots(shares: DataFrame, seed: int = 0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most_times: int = MOST_TIMES) -> DataFrame:
    """One row for each drawn slot: shard, slot (in its shard), source_no, number (in its source), block_no.

    ``shares`` is what ``targets`` gives. The driver reads one sum.
    """
    long = lambda x: F.lit(x).cast("long")
    blocks = F.ceil(F.col("source_size") / block)
    used = shares.where("source_size > 0").withColumn("_blocks", blocks).withColumn("_share", F.round(F.col("target") * blocks / F.col("source_size") * UNIT).cast("long"))
    whole = used.agg(F.sum("_share")).first()[0] or 0
    total = round(whole / UNIT)
    shards = max(1, -(-total // shard_slots))
    base, extra = divmod(total, shards)
    if not total:
        used = used.limit(0)
    # The interval of each source, by sums over parts and within them.
    parts = used.groupBy("_part").agg(F.sum("_share").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_share").over(Window.partitionBy("_part").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = used.withColumn("_in", inside).join(parts.select("_part", before.alias("_before")), "_part").withColumn("_low", F.col("_in") + F.col("_before"))

    # Runs: the strata of each k that fall to a source. All shards have a k-th slot for k < base, the first ``extra`` one more.
    rows = used.select("source_no", "_blocks", "_low", (F.col("_low") + F.col("_share")).alias("_high"), F.explode(F.sequence(long(0), long(base - (extra == 0)))).alias("slot"))
    strata = F.when(F.col("slot") < base, long(shards)).otherwise(long(extra))
    variate = (F.pmod(_hash(seed, _PLACES, F.col("slot")), long(UNIT)) + 0.5) / UNIT
    edge = lambda at: F.when(at >= whole, strata).otherwise(F.ceil(at * strata.cast("double") / float(whole or 1) - variate))
    rows = rows.withColumn("_from", edge(F.col("_low"))).withColumn("_to", edge(F.col("_high"))).where("_to > _from")
    past = Window.partitionBy("source_no").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.col("_to") - F.col("_from")).over(past), F.lit(0)))

    # Long runs are parted and dealt to tasks before they become slots.
    rows = rows.withColumn("_j", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, long(RUN))))
    a, b = sides(F.col("_blocks"))
    rows = rows.select("source_no", "slot", "_blocks", a.alias("_a"), b.alias("_b"), "_j", F.least(F.col("_to") - F.col("_j"), long(RUN)).alias("_n"), (F.col("_first") + F.col("_j") - F.col("_from")).alias("_first"))
    rows = rows.repartition(max(1, -(-total // TASK_SLOTS)), "source_no", "slot", "_j").withColumn("_i", F.explode(F.sequence(long(0), F.col("_n") - 1)))
    rows = rows.withColumn("number", F.col("_first") + F.col("_i")).where(F.col("number") < F.col("_blocks") * most_times)
    rows = rows.withColumn("_strata", strata).withColumn("_pass", F.expr("number div _blocks"))
    shard = permuted(F.col("_j") + F.col("_i"), F.col("_strata"), seed, _SHARDS, F.col("slot"))
    block_no = permuted(F.pmod("number", "_blocks"), F.col("_blocks"), seed, _BLOCKS, F.col("source_no"), F.col("_pass"), ab=(F.col("_a"), F.col("_b")))
    return rows.select(shard.alias("shard"), "slot", "source_no", "number", block_no.alias("block_no"))


def sides(n: Column) -> tuple[Column, Column]:
    """floor(sqrt(n)) and how often it goes into n."""
    a = F.floor(F.sqrt(n))
    return a, F.call_function("div", n, a)


def permuted(index: Column, n: Column, seed: int, kind: int, *keys: Column, ab: tuple[Column, Column] | None = None, rounds: int = 8) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, evaluated at one index.

    With a = floor(sqrt(n)) and b = n div a, the indices below a x b are pairs (x, y). Every round is a half of a Feistel
    network on pairs, x or y in turn moved on by a keyed hash of the other, modulo a or b; the fewer than a indices that
    are no pair stay. Then all indices are moved on by a keyed number modulo n, so that others are left out in the next
    round. Each step is a permutation for any n. ``ab`` are the two sides, where a column has them.
    """
    a, b = ab or sides(n)

    def one(i: Column, r: Column) -> Column:
        hashed = lambda *x: _hash(seed, kind, *keys, r, *x)
        x, y = F.call_function("div", i, b), i % b
        pair = F.when(r % 2 == 0, x * b + F.pmod(y + F.pmod(hashed(x), b), b)).otherwise(F.pmod(x + F.pmod(hashed(y), a), a) * b + y)
        return (F.when(i < a * b, pair).otherwise(i) + F.pmod(hashed(), n)) % n

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")), index, one)


def mixed(docs: DataFrame, seed: int = 0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """doc_id, source, size -> every row with source_size, target and ``taken``, the words that the mix reads from it.

    ``docs`` is read several times: give it as stored rows, or as something that is cheap to compute again.
    """
    docs = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"))
    shares = targets(docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")), weights, most_times)
    times = slots(shares, seed, block, shard_slots, most_times).groupBy("source_no", "block_no").agg(F.count(F.lit(1)).alias("times"))
    rows = placed(docs, shares)
    full = each(rows.where("size > 0"))
    start, end = F.col("start"), F.col("start") + F.col("size")
    pieces = (
        full.select("source_no", "start", end.alias("_end"), F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))).alias("block_no"))
        .withColumn("overlap", F.least("_end", (F.col("block_no") + 1) * block) - F.greatest("start", F.col("block_no") * block))
    )
    # Both sides of these joins grow with the corpus: never broadcast, however small one looks.
    taken = pieces.hint("merge").join(times, ["source_no", "block_no"]).groupBy("source_no", "start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    found = full.hint("merge").join(taken, ["source_no", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return found.unionByName(each(rows.where("size = 0 or size is null")).select(*columns, F.lit(0).cast("long").alias("taken")))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and ``size``, the number of words."""
    return docs.select("doc_id", "source", n_words(F.col(text)).alias("size"))


def copies(mix: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``copies``: taken over size as a whole number, rounded up with the odds of its fraction by a hash of the id."""
    share = F.col("taken") / F.col("size")
    drawn = F.shiftrightunsigned(_hash(seed, 17, F.col("doc_id")), 11).cast("double") / float(1 << 53)
    return mix.withColumn("copies", F.when(F.col("size") > 0, F.floor(share) + (drawn < share - F.floor(share)).cast("int")).otherwise(0).cast("int"))
