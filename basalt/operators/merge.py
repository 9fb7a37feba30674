"""Table changes as DataFrames: insert-if-absent, merges, deletes, retention. A change gives the new table; the caller swaps it in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING = "pending:"


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Incoming rows with created = whether each is new: the first of its key that the target doesn't have."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    known = target.select(*keys, F.lit(True).alias("_known")).distinct()
    return incoming.withColumn("_first", first).join(known, keys, "left").withColumn("created", F.col("_first") & F.col("_known").isNull()).drop("_first", "_known")


def replace_by_key(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The target with every group that the incoming rows have replaced by them."""
    return target.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key doesn't exist yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent doesn't exist; those without a parent id aren't orphans."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] | None = None, valid: Column | None = None, in_window: Column | None = None) -> DataFrame:
    """Full merge of a snapshot: rows with ``action`` insert, update, delete or keep, and the merged values.

    Source values win but for the ``keep`` columns, where the target's are preserved. A source row that isn't ``valid``
    deletes. A target row without a source row goes if it is ``in_window`` and its id isn't pending, else it stays.
    """
    keep = keep or []
    others = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in others], F.lit(True).alias("_t"))
    s = source.withColumn("_valid", F.lit(True) if valid is None else valid)
    s = s.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in others if c in source.columns], "_valid", F.lit(True).alias("_s"))
    joined = t.join(s, keys, "full_outer")
    pending = F.col(keys[-1]).cast("string").startswith(PENDING)
    inside = F.lit(True) if in_window is None else in_window
    have_t, have_s = F.col("_t").isNotNull(), F.col("_s").isNotNull()

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"_t_{c}")
        if c in keep:
            return F.coalesce(F.col(f"_t_{c}"), F.col(f"_s_{c}"))
        return F.when(have_s, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}"))

    values = joined.select(*keys, *[value(c).alias(c) for c in others], have_t.alias("_have_t"), have_s.alias("_have_s"), F.coalesce("_valid", F.lit(True)).alias("_valid"))
    action = (
        F.when(F.col("_have_s") & ~F.col("_valid"), F.when(F.col("_have_t"), "delete").otherwise("ignore"))
        .when(F.col("_have_s") & F.col("_have_t"), "update").when(F.col("_have_s"), "insert")
        .when(inside & ~pending, "delete").otherwise("keep")
    )
    return values.withColumn("action", action).drop("_have_t", "_have_s", "_valid").where("action != 'ignore'")


def claim_pending(target: DataFrame, source: DataFrame, key: str, match: list[str]) -> DataFrame:
    """source rows with ``claims``: the pending row of the target that an unmatched source row takes over, at most one each way."""
    unmatched = source.join(target.select(key), key, "left_anti")
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*match).orderBy(key)))
    waiting = number(target.where(F.col(key).startswith(PENDING)).select(*match, key)).withColumnRenamed(key, "claims")
    claimed = number(unmatched.select(*match, key)).join(waiting, [*match, "_n"]).select(key, "claims")
    return source.join(claimed, key, "left")


def pending_id(organizer_id: Column) -> Column:
    return F.concat(F.lit(PENDING), F.left(organizer_id, F.lit(48)))


def purge(rows: DataFrame, rules: dict[str, int], as_of: str, status: str = "status", at: str = "created_at") -> DataFrame:
    """Rows that stay: a row goes if it is older than its status' days; a negative number of days skips the rule."""
    now = F.lit(as_of).cast("timestamp_ntz")
    old = [(F.col(status) == s) & (F.col(at) < now - F.make_interval(days=F.lit(d))) for s, d in rules.items() if d >= 0]
    return rows.where(~reduce(lambda a, b: a | b, old, F.lit(False)))


def keep_newest_dates(rows: DataFrame, n: int, dataset: str, day: str) -> DataFrame:
    """Rows of all but the newest n different dates of each dataset: what a cleanup deletes.

    Dates are made distinct before they are ranked, so a window holds dates, not rows.
    """
    ranked = rows.select(dataset, day).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(dataset).orderBy(F.desc(day))))
    return rows.join(ranked.where(F.col("_r") > n).select(dataset, day), [dataset, day], "left_semi")


def fill_empty(target: DataFrame, incoming: DataFrame, key: str, fill: list[str], replace: list[str]) -> DataFrame:
    """Get-or-create: ``fill`` columns only where the target's are blank, ``replace`` columns where they differ without case; new keys are added."""
    s = incoming.select(key, *[F.col(c).alias(f"_s_{c}") for c in (*fill, *replace)])
    joined = target.join(s, key, "left")
    for c in fill:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_s_{c}")))
    for c in replace:
        joined = joined.withColumn(c, F.when(F.lower(F.coalesce(f"_s_{c}", F.lit(""))) == F.lower(F.coalesce(c, F.lit(""))), F.col(c)).otherwise(F.coalesce(f"_s_{c}", c)))
    return joined.select(*target.columns).unionByName(new_rows(incoming, target, key).select(key, *fill, *replace), allowMissingColumns=True)


def apply_actions(target: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """A list of (action, id, fields): create adds, update replaces what is given, deprecate sets the status."""
    fields = [c for c in actions.columns if c not in ("action", key)]
    a = actions.where("action in ('update', 'deprecate')").select(F.col(key).alias("_k"), F.col("action").alias("_a"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = target.join(a, F.col(key) == F.col("_k"), "left")
    for c in fields:
        joined = joined.withColumn(c, F.when(F.col("_a") == "update", F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    joined = joined.withColumn("status", F.when(F.col("_a") == "deprecate", F.lit("deprecated")).otherwise(F.col("status")))
    return joined.select(*target.columns).unionByName(actions.where("action = 'create'").select(key, *fields).withColumn("status", F.lit("active")), allowMissingColumns=True)


def merge_by_key(values: Column, key, order=None) -> Column:
    """Structs of an array, the last of each key."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == key(v)))
