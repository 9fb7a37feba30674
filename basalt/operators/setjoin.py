"""Similarity joins of token sets by prefixes: all pairs of a group whose Jaccard similarity reaches a threshold, exactly.

Tokens are ordered by how few rows of their group have them. Two sets of similarity t share a token among the first
n - ceil(t n) + 1 of each, and their sizes lie within a factor t of each other; so rows meet by the tokens of their prefixes,
where frequent ones are the last to come, and only pairs of fitting sizes are compared. What is left of two sets after the
token that they meet by, and how much their prefixes share, bounds what they can share in all, which drops most of the rest.

A token that many rows of a group have in their prefixes is dealt out: its rows go to blocks, and each pair of blocks is a cell
of its own, so no task gets all of them. A row is in as many cells as there are blocks, so these are at most ``BLOCKS``, and grow
beyond that: what moves is in proportion to the prefixes. Rows with equal sets are one row until the pairs are found.

Pairs that meet are many more than those that are similar, so a bitmap of each set's tokens travels with it: every bit in which two
bitmaps differ stands for a token that only one set has. That bounds what they share before a pair leaves the task where it met.
How many rows are similar to each (``linked_rows``) is counted without moving any pairs, by ``linked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import linked

#: Rows of a block of a frequent token, and its blocks at most.
BLOCK, BLOCKS = 512, 4
#: 64-bit numbers of a bitmap.
WORDS = 4


def _least_common(size: Column, threshold: float) -> Column:
    """ceil(t n), safe against rounding."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def _bitmap(tokens: Column) -> Column:
    """A bit for the hash of each token, in ``WORDS`` numbers."""
    h = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * WORDS)).cast("int"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)))
    word = lambda h, w: F.aggregate(h, F.lit(0).cast("long"), lambda a, k: F.when(F.floor(k / 64) == w, a.bitwiseOR(bit(k))).otherwise(a))
    return F.get(F.transform(F.array(h), lambda h: F.struct(*[word(h, w).alias(f"b{w}") for w in range(WORDS)])), F.lit(0))


def prepared(rows: DataFrame, group: str, key: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(set, group, tokens by rarity, size, bitmap) of the different sets of each group, and (group, key, set). Empty sets are left out."""
    base = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))).alias("tokens")).where((F.size("tokens") > 0) & F.col("group").isNotNull())
    base = stored(base.withColumn("set", F.xxhash64("group", "tokens")), "sets")
    sets = base.groupBy("set", "group").agg(F.first("tokens").alias("tokens"))
    each = sets.select("set", "group", F.explode("tokens").alias("token"))
    df = each.groupBy("group", "token").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(df, ["group", "token"]).groupBy("set", "group").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
    return stored(ordered.withColumn("size", F.size("tokens")).withColumn("bits", _bitmap(F.col("tokens"))), "ordered"), base.select("group", "key", "set")


def dealt(prefix: DataFrame, block: int = BLOCK) -> DataFrame:
    """Prefix rows whose token others have, once in each cell of their block: at most ``BLOCKS`` times."""
    many = prefix.groupBy("group", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.least(F.ceil(F.col("n") / block), F.lit(BLOCKS)).cast("int"))
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j")))
    return prefix.join(many, ["group", "token"]).withColumn("mine", mine).withColumn("cell", F.explode(cells)).select("group", "token", "cell", "mine", "set", "size", "at", "bits")


def candidates(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of sets (a < b) that meet by a token and that the filters can't rule out."""
    width = F.col("size") - _least_common(F.col("size"), threshold) + 1
    prefix = sets.select("set", "group", "size", "bits", F.posexplode(F.slice("tokens", 1, width)).alias("at", "token"))
    rows = dealt(prefix, block)
    other = rows.select("group", "token", "cell", *[F.col(c).alias(f"{c}_b") for c in ("mine", "set", "size", "at", "bits")])
    least = F.ceil((F.col("size") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-9)
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    fits = (F.col("size") >= F.col("size_b") * threshold - 1e-9) & (F.col("size_b") >= F.col("size") * threshold - 1e-9)
    differ = sum((F.bit_count(F.col(f"bits.b{w}").bitwiseXOR(F.col(f"bits_b.b{w}"))) for w in range(WORDS)), F.lit(0))
    # Both rows of a block meet in its own cell only.
    apart = (F.col("cell.i") == F.col("cell.j")) | (F.col("mine") != F.col("mine_b"))
    # Tokens before this one that both have aren't counted, so what they share is bounded by it and what follows, if it is the first.
    met = rows.join(other, ["group", "token", "cell"]).where((F.col("set") < F.col("set_b")) & fits & apart & (left + F.least("at", "at_b") >= least) & (differ <= F.col("size") + F.col("size_b") - 2 * least))
    # All shared tokens of the prefix that ends first lie in the other one too, so what two sets share is what their prefixes
    # share and what follows that prefix, at most.
    rest = lambda size: size - (size - _least_common(size, threshold) + 1)
    pairs = met.groupBy(F.col("set").alias("a"), F.col("set_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first("size").alias("size"), F.first("size_b").alias("size_b"))
    return pairs.where(F.col("shared") + F.greatest(rest(F.col("size")), rest(F.col("size_b"))) >= least).select("a", "b")


def similar_sets(rows: DataFrame, group: str, key: str, tokens: Column, threshold: float, strict: bool = False, block: int = BLOCK, compared: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, a, b, jaccard) of different sets with at least (``strict``: more than) the threshold, and (group, key, set) of all rows.

    Rows of one set are equal, with a similarity of 1 among each other and the links of their set. Rows without tokens or group
    are in neither. ``compared`` gets the number of pairs that were compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    sets, members = prepared(rows, group, key, tokens)
    found = candidates(sets, threshold, block)
    if compared is not None:
        found = stored(found, "candidates")
        compared.append(found.count())
    one = sets.select(F.col("set").alias("a"), "group", F.col("tokens").alias("_a"))
    two = sets.select(F.col("set").alias("b"), F.col("tokens").alias("_b"))
    pairs = found.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    scored = pairs.withColumn("jaccard", shared / (F.size("_a") + F.size("_b") - shared))
    return scored.where(F.col("jaccard") > threshold if strict else F.col("jaccard") >= threshold).select("group", "a", "b", "jaccard"), members


def similar_rows(rows: DataFrame, group: str, key: str, tokens: Column, threshold: float, strict: bool = False, block: int = BLOCK, compared: list[int] | None = None) -> DataFrame:
    """(group, a, b, jaccard) of rows, a < b: what ``similar_sets`` finds, with the rows of each set; quadratic in equal rows."""
    sets, members = similar_sets(rows, group, key, tokens, threshold, strict, block, compared)
    a, b = (members.select(F.col("set").alias(s), F.col("key").alias(f"_{s}")) for s in "ab")
    different = sets.join(a, "a").join(b, "b").select("group", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "jaccard")
    equal = members.join(members.select(F.col("group").alias("_g"), F.col("set").alias("_s"), F.col("key").alias("_k")), (F.col("set") == F.col("_s")) & (F.col("group") == F.col("_g")) & (F.col("key") < F.col("_k")))
    equal = equal.select("group", F.col("key").alias("a"), F.col("_k").alias("b"), F.lit(1.0).alias("jaccard"))
    return different.unionByName(equal if not strict or threshold < 1 else equal.limit(0))


def linked_rows(rows: DataFrame, group: str, key: str, tokens: Column, threshold: float, strict: bool = False, block: int | None = None) -> DataFrame:
    """group, key, set, n_similar: how many other rows of its group are similar to each row; equal rows are never paired.

    Only counts leave a task, no pairs: see ``linked``. ``block``: sets of a block, at most.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    members, links = linked.counted(rows, group, key, tokens, threshold, strict, block or linked.SETS)
    size = members.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    own = F.lit(0) if strict and threshold >= 1 else F.col("n") - 1
    return members.join(size, "set").join(links, "set", "left").select("group", "key", "set", (own + F.coalesce("others", F.lit(0))).cast("long").alias("n_similar"))
