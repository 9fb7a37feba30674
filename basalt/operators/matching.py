"""Finding quoted texts in their parents, and names among known ones, by rows of tables.

``spans`` finds where a quoted part lies in its parent although white space differs; ``closest`` finds the known name that is
most like a given one by matching blocks. Both give results for every row and hold one batch of rows.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stored

#: Characters of a part by whose place it is found if the whole isn't there.
ANCHOR = 80
CUTOFF = 0.72
#: Parts of one parent that a task gets, about.
TOGETHER = 1000
#: Known names that a value is compared with at once.
BLOCK = 2000


class Collapsed:
    """A text with each run of white space as one space and none at the ends, and the place of each character in the text."""

    def __init__(self, text: str):
        self.source = text
        self.text = " ".join(text.split())
        self.at: np.ndarray | None = None

    def places(self) -> np.ndarray:
        """The place in the text of each character of the collapsed one."""
        if self.at is None:
            chars = np.array([c.isspace() for c in self.source], bool)
            word = ~chars
            starts = np.r_[True, chars[:-1]] & word  # of words
            first = np.flatnonzero(starts)
            gaps = first[1:] - 1  # the last white space before each word but the first
            self.at = np.sort(np.r_[np.flatnonzero(word), gaps])
        return self.at


def span(parent: Collapsed, part: str, anchor: int = ANCHOR) -> tuple[int, int, str] | None:
    """(first, last, how): where a part lies in a parent.

    ``exact``: as it is, without white space around it. ``space``: with other white space in it. ``anchor``: its first
    ``anchor`` characters are there, with any white space, and it ends where a text of its length would.
    """
    bare = part.strip()
    if not bare or not parent.text:
        return None
    if (at := parent.source.find(bare)) >= 0:
        return at, at + len(bare), "exact"
    small = " ".join(bare.split())
    if (at := parent.text.find(small)) >= 0:
        places = parent.places()
        return int(places[at]), int(places[at + len(small) - 1]) + 1, "space"
    if (at := parent.text.find(small[:anchor].rstrip())) >= 0:
        first = int(parent.places()[at])
        return first, min(len(parent.source), first + len(bare)), "anchor"
    return None


def spans(parents: DataFrame, parts: DataFrame, parent: str = "parent_id", text: str = "text", part: str = "part", anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``parts`` (with the parent's key) with first, last, how and found (the parent's own characters); null if it isn't there.

    Null or blank parts, and parts whose parent doesn't exist, are nowhere. Places are in code points, from 0.
    """
    ship(parents.sparkSession)
    names = parts.columns
    counts = parts.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("_salts"))
    own = parts.select("*", F.monotonically_increasing_id().alias("_row")).join(counts, F.col(parent) == F.col("_p"), "left")
    asked = own.select(F.col(parent).alias("_p"), F.pmod(F.xxhash64("_row"), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_text"), *names)
    given = parents.select(F.col(parent).alias("_q"), F.col(text).alias("_text")).join(counts, F.col("_q") == F.col("_p"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in parts.schema]
    given = given.select("_p", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), "_text", *none)
    # A parent comes before its parts, once for each share of them.
    rows = given.unionByName(asked).repartition("_p", "_salt").sortWithinPartitions("_p", "_salt", "_kind")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, held = None, None
        for batch in batches:
            keys, kinds, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            quoted = batch.column(batch.schema.get_field_index(part)).to_pylist()
            out, where = [], []
            for i, (key, kind, whole, one) in enumerate(zip(keys, kinds, texts, quoted, strict=True)):
                if kind == 0:
                    of, held = key, None if whole is None else Collapsed(whole)
                    continue
                at = span(held, one, anchor) if held and one is not None and key == of else None
                out.append((*at, held.source[at[0] : at[1]]) if at else (None, None, None, None))
                where.append(i)
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(where, pa.int32())) for c in batch.columns[4:]] + columns, names=[*names, "first", "last", "how", "found"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", first int, last int, how string, found string"
    return rows.mapInArrow(work, schema)


def folded(name: str | None) -> str:
    return "".join((name or "").lower().split())


class Known:
    """A block of known names, with the counts of their characters."""

    def __init__(self, names: list[str]):
        self.names, self.keys = names, [folded(n) for n in names]
        self.where = {c: i for i, c in enumerate(sorted(set("".join(self.keys))))}
        self.sizes = np.array([len(k) for k in self.keys])
        self.counts = np.zeros((len(names), len(self.where)), np.int16)
        for i, k in enumerate(self.keys):
            for c, n in Counter(k).items():
                self.counts[i, self.where[c]] = n

    def best(self, key: str, cutoff: float) -> tuple[float, str, int] | None:
        """(ratio, name, names whose blocks were matched) of the most similar name; of equal ones the larger key, then the first name."""
        mine = Counter(key)
        of = [(self.where[c], n) for c, n in mine.items() if c in self.where]
        if not of or not len(self.names):
            return None
        shared = np.minimum(self.counts[:, [i for i, _ in of]], np.array([n for _, n in of], np.int16)).sum(axis=1)
        bound = 2.0 * shared / (self.sizes + len(key))  # matching blocks share no more characters than the two have in common
        best: tuple[float, str, int] | None = None
        matcher, tried = difflib.SequenceMatcher(), 0
        matcher.set_seq2(key)
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < max(cutoff, best[0] if best else 0.0):
                break
            matcher.set_seq1(self.keys[i])
            tried += 1
            ratio = matcher.ratio()
            if ratio >= cutoff and (best is None or (ratio, self.keys[i]) > (best[0], self.keys[best[2]])):
                best = ratio, self.names[i], int(i)
        return (best[0], best[1], tried) if best else None


def closest(values: DataFrame, known: DataFrame, value: str = "value", name: str = "name", cutoff: float = CUTOFF, block: int = BLOCK) -> DataFrame:
    """value, name, ratio: for every different value the known name that equals it without case and white space, or else the most similar one.

    Similarity is the ratio of matching blocks and must reach the cutoff; of equal ones the larger name without case and white
    space counts. What two names have in common at most, by counts of their characters, rules most out. Known names lie in
    blocks, and a value meets one block after another. A value without any match has null.
    """
    spark = values.sparkSession
    ship(spark)
    asked = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    choices = known.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    blocks = choices.withColumn("_b", F.pmod(F.xxhash64("name"), F.greatest(F.lit(1), F.lit(-(-choices.count() // block)))))
    blocks = stored(blocks.groupBy("_b").agg(F.sort_array(F.collect_list("name")).alias("names")), "names")  # about ``block`` names each
    numbers = F.array([F.lit(r["_b"]) for r in blocks.select("_b").collect()] or [F.lit(0).cast("long")])
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = blocks.select("_b", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(None).cast("string").alias("value"), "names")
    meet = asked.select(F.explode(numbers).alias("_b"), F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("_salt"), "value", F.lit(None).cast("array<string>").alias("names"))
    # A block of names comes before the values that meet it, once for each share of them.
    meet = given.unionByName(meet).repartition("_b", "_salt").sortWithinPartitions("_b", "_salt", F.asc_nulls_first("value"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one, same = Known([]), {}
        for batch in batches:
            out = []
            for v, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if v is None:
                    one = Known(names)
                    same = {k: n for k, n in zip(reversed(one.keys), reversed(one.names), strict=True)}
                    continue
                key = folded(v)
                found = (2.0, same[key], 0) if key in same else one.best(key, cutoff)
                if found:
                    out.append((v, found[1], found[0], folded(found[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)], names=["value", "name", "ratio", "key"])

    found = meet.mapInArrow(work, "value string, name string, ratio double, key string")
    first = Window.partitionBy("value").orderBy(F.desc("ratio"), F.desc("key"), "name")
    best = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("value", "name", F.least("ratio", F.lit(1.0)).alias("ratio"))
    return asked.join(best, "value", "left")
