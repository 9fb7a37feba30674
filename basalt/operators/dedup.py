"""Deduplication and similarity: exact keys, greedy leaders, either-key folds, near-duplicate children, fuzzy matches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored
from .retrieval import dot

BLOCK = 1024
PIVOTS = 1024
#: Blocks of a cell, at most: each of its vectors is copied so often, however many they are.
BLOCKS = 48
#: Rows of a block whose products are made at once.
ROWS = 1024
#: Share of all pivots that a vector may visit on average. Where thresholds are so low that it would be more, pivots rule out
#: too little to be worth the copies, and all vectors meet by blocks, each stored once.
VISITS = 0.25
TRIED = 256


def first_wins(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the first in order; rows whose key is null or blank go."""
    by = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", T.blank_to_null(key.cast("string"))).where("_key is not null").withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_key", "_r")


def visited(vectors: np.ndarray, pivots: np.ndarray, angle: float) -> float:
    """The share of pivots that vectors visit."""
    far = np.arccos(np.clip(vectors @ pivots.T, -1, 1))
    return float((far <= far.min(1)[:, None] + 2 * angle).mean())


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """a, b, similarity of all pairs a < b of unit vectors of one dimension with a cosine of at least the threshold, exactly.

    Every vector has its home with the nearest of at most ``PIVOTS`` pivots (vectors with the smallest hashes), and visits
    each pivot whose angle is at most twice the threshold's angle above that of its home: by the triangle inequality it
    meets there all vectors that are similar to it. What is far apart never meets. A cell with many members is dealt over
    pairs of blocks, whose pairs are a matrix product. A pair counts in the home of its smaller id. Vectors visit a share
    ``VISITS`` of the pivots at most, on average over ``TRIED`` of them, or there is one pivot only. A cell has at most
    ``BLOCKS`` blocks, so what is moved grows with the vectors; only the products, and the pairs, grow with their square.
    """
    # Vectors of floats are moved as such, and multiplied in double precision.
    number = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{number}>").alias("v")).where("v is not null")
    many = max(1, min(PIVOTS, rows.count() // block))
    first = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(many + TRIED).collect()]
    pivots, tried = first[:many], first[many:]
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    if many > 1 and tried and visited(np.array(tried), np.array(pivots), angle) > VISITS:
        pivots = pivots[:1]

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = np.array(pivots)
        for pdf in batches:
            if len(pdf):
                far = np.arccos(np.clip(np.stack(pdf["v"].to_numpy()).astype(np.float64) @ p.T, -1, 1))
                home = far.argmin(1)
                i, cell = np.nonzero(far <= far[np.arange(len(far)), home][:, None] + 2 * angle + 1e-6)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "cell": cell, "home": home[i] == cell})

    kind = vectors.schema[key].dataType.simpleString()
    met = stored(rows.mapInPandas(visits, f"id {kind}, v array<{number}>, cell int, home boolean"), "visits")
    sizes = met.groupBy("cell").agg(F.least(F.lit(BLOCKS), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"), F.max("home").alias("_any")).where("_any")
    met = met.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # a row a pivot
    cells = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "id", "v", "home", "block", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"))

    def pairs(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, own, home = rows["id"].to_numpy(), rows["block"].to_numpy(), rows["home"].to_numpy()
        m = np.stack(rows["v"].to_numpy()).astype(np.float64)
        out = []
        for k in range(0, len(m), ROWS):
            part = slice(k, k + ROWS)
            sim = m[part] @ m.T
            keep = (sim >= threshold) & (ids[part, None] < ids[None, :]) & home[part, None]
            if cell[1] != cell[2]:
                keep &= own[part, None] != own[None, :]
            i, j = np.nonzero(keep)
            out.append(pd.DataFrame({"a": ids[part][i], "b": ids[j], "similarity": sim[i, j]}))
        return pd.concat(out)

    return cells.groupBy("cell", "x", "y").applyInPandas(pairs, f"a {kind}, b {kind}, similarity double")


def greedy(vectors: DataFrame, threshold: float = 0.9, key: str = "id", vector: str = "vector") -> DataFrame:
    """key, kept, duplicate_of, similarity: rows in the order of key; a row stays unless it resembles a kept earlier one.

    The kept rows are the first maximal independent set in order. Rounds decide all rows at once whose earlier
    neighbours are decided: those with a kept neighbour go, those without any stay.
    """
    pairs = stored(similar_pairs(vectors, threshold, key, vector), "pairs")
    rows = vectors.select(F.col(key).alias("id"))
    open_ = stored(pairs.select(F.col("b").alias("id")).distinct(), "open")
    kept = rows.join(open_, "id", "left_anti")
    while not open_.isEmpty():
        early = pairs.select(F.col("a").alias("_a"), F.col("b").alias("id"))
        gone = early.join(kept.select(F.col("id").alias("_a")), "_a", "left_semi").select("id").distinct()
        left = stored(open_.join(gone, "id", "left_anti"), "left")
        waiting = early.join(left.select(F.col("id").alias("_a")), "_a", "left_semi").select("id").distinct()
        kept = stored(kept.unionByName(left.join(waiting, "id", "left_anti")), "kept")
        open_ = stored(left.join(waiting, "id", "left_semi"), "open")
    best = pairs.join(kept.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.max_by("a", F.struct("similarity", -F.col("a"))).alias("duplicate_of"), F.max("similarity").alias("similarity"))
    flags = kept.select("id", F.lit(True).alias("_k"))
    out = rows.join(flags, "id", "left").join(best, "id", "left").withColumn("kept", F.coalesce("_k", F.lit(False)))
    return out.select(F.col("id").alias(key), "kept", F.when(~F.col("kept"), F.col("duplicate_of")).alias("duplicate_of"), F.when(~F.col("kept"), F.col("similarity")).alias("similarity"))


def either_key(rows: DataFrame, group: str, order: str, first: str, second: str) -> DataFrame:
    """In each group, in order, rows whose first or second key a kept row had before go; blank keys never match.

    Decided in rounds over all groups at once: the rows that come first under both of their keys stay, those that share a key
    with one of them go, and the others are looked at again. Each round takes minima by key and joins them, so neither a
    group nor a key has to fit in a task. There are as many rounds as the longest chain of rows of which each waits for the
    one before; a dropped row blocks nothing. Rows that are equal in the order go by the hash of their columns.
    """
    place = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), F.xxhash64(*rows.columns).alias("hash"), F.monotonically_increasing_id().alias("row"))
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    open_ = stored(rows.select("*", F.struct(F.col(group).isNull().alias("absent"), F.col(group).alias("id")).alias("_g"), blank(first).alias("_1"), blank(second).alias("_2"), place.alias("_at")), "open")
    kept = []
    while not open_.isEmpty():
        for k in ("_1", "_2"):
            least = open_.where(F.col(k).isNotNull()).groupBy("_g", k).agg(F.min("_at").alias(f"_min{k}"))
            open_ = open_.join(least, ["_g", k], "left")
        leads = (F.col("_1").isNull() | (F.col("_at") == F.col("_min_1"))) & (F.col("_2").isNull() | (F.col("_at") == F.col("_min_2")))
        marked = stored(open_.withColumn("_leads", leads), "marked")
        stay = marked.where("_leads")
        kept.append(stay.select(*rows.columns))
        open_ = marked.where("not _leads").drop("_leads", "_min_1", "_min_2")
        for k in ("_1", "_2"):
            open_ = open_.join(stay.where(F.col(k).isNotNull()).select("_g", k).distinct(), ["_g", k], "left_anti")
        open_ = stored(open_, "open")
    out = rows.limit(0)
    for one in kept:
        out = out.unionByName(one)
    return out


def distinct_structs(values: Column, *fields: str) -> Column:
    """Structs of an array, the first of each combination of fields (without case)."""
    key = lambda v: F.lower(F.concat_ws("\x1f", *[F.coalesce(v[f].cast("string"), F.lit("")) for f in fields]))
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)


def anchor_boost(rows: DataFrame, anchors: list[list[float]], vector: str = "vector", base: float = 0.45, scale: float = 25.0) -> DataFrame:
    """Adds boost: the best cosine with an anchor above ``base``, times ``scale``, as a whole number."""
    v = F.col(vector).cast("array<double>")
    best = F.array_max(F.array(*[dot(v, F.array(*map(F.lit, a))) for a in anchors]))
    return rows.withColumn("boost", F.floor(F.greatest(F.lit(0.0), (best - base) * scale)).cast("int"))


def min_max(rows: DataFrame, value: str, name: str = "score") -> DataFrame:
    """Adds the value scaled to 0..1 over all rows; 1 where all are (nearly) equal."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.abs(F.col("_hi") - F.col("_lo")) <= 1e-9 * F.greatest(F.abs("_hi"), F.abs("_lo"))
    return rows.join(F.broadcast(ends)).withColumn(name, F.when(flat, 1.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 0 for none."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def near_duplicate_ratio(a: str, b: str) -> float:
    """Length ratio if one text holds the other, else Jaccard of their words."""
    a, b = " ".join(a.split()), " ".join(b.split())
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return len(short) / len(long)
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y)


def distinct_children(children: DataFrame, parent: str = "parent_id", order: str = "pos", text: str = "text", threshold: float = 0.92) -> DataFrame:
    """Children of each parent without near copies: of two alike the longer stays, in the place of the first."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order).to_dict("records")
        kept: list[dict] = []
        for row in rows:
            at = next((k for k, other in enumerate(kept) if near_duplicate_ratio(row[text], other[text]) >= threshold), None)
            if at is None:
                kept.append(row)
            elif len(row[text]) > len(kept[at][text]):
                kept[at] = row
        return pd.DataFrame(kept, columns=pdf.columns)

    return children.groupBy(parent).applyInPandas(fold, children.schema)


def closest(values: Column, choices: list[str], cutoff: float = 0.72) -> Column:
    """Each value's match: equal after normalising, else the closest by matching blocks with a ratio of at least the cutoff."""
    keys = {"".join(c.lower().split()): c for c in choices}

    @F.pandas_udf("string")
    def match(s: pd.Series) -> pd.Series:
        def one(v):
            k = "".join((v or "").lower().split())
            if k in keys:
                return keys[k]
            near = difflib.get_close_matches(k, list(keys), 1, cutoff)
            return keys[near[0]] if near else None

        return s.map(one)

    return match(values)


def span(parent: Column, part: Column) -> Column:
    """struct(first, last) of a part in its parent: exact, else anchored by its first and last 40 characters; else null."""
    exact = F.instr(parent, part)
    head, tail = F.instr(parent, F.left(part, F.lit(40))), F.instr(parent, F.right(part, F.lit(40)))
    anchored = (head > 0) & (tail >= head) & (F.length(part) >= 40)
    return F.when((exact > 0) & (part != ""), F.struct((exact - 1).alias("first"), (exact - 1 + F.length(part)).alias("last"))).when(anchored, F.struct((head - 1).alias("first"), (tail - 1 + 40).alias("last")))


def content_hash(text: Column, n: int = 64) -> Column:
    return F.left(F.sha2(text, 256), F.lit(n))
