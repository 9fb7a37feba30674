"""News, notices and attendance: keyword scores, tiers, unions of sources, qualification, day summaries, rosters, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from .numbering import numbered

# Weights of the keyword score and of tiers and fits.
TIER_BONUS = {"A": 5, "B": 4, "C": 0}
TIER_PRIORITY = {"S": 6, "A": 4, "B": 2, "C": 1}
FIT_ORDER = {"high": 0, "medium": 1}
LEAVE = ("leave", "half_leave", "sick_leave")


def cased(value: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default)


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule one of whose keywords the text contains."""
    out = None
    for name, words in rules:
        hit = T.contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def keyword_score(rows: DataFrame, text: Column, tier: Column, primary: list[str], boost: list[str], negative: list[str], domain: list[str]) -> DataFrame:
    """Rows with a primary hit, fewer than two negative hits and, in tier C, a domain hit; score beside the hits, best first.

    score = 10 + tier bonus + tier priority + 4 * boost + primary - 3 * negative.
    """
    n = lambda words: F.size(T.matched(text, words))
    out = rows.select("*", n(primary).alias("n_primary"), n(boost).alias("n_boost"), n(negative).alias("n_negative"), n(domain).alias("n_domain"), tier.alias("_tier"))
    out = out.where((F.col("n_primary") > 0) & (F.col("n_negative") < 2) & ((F.col("_tier") != "C") | (F.col("n_domain") > 0)))
    score = 10 + cased(F.col("_tier"), TIER_BONUS, 0) + cased(F.col("_tier"), TIER_PRIORITY, 1) + 4 * F.col("n_boost") + F.col("n_primary") - 3 * F.col("n_negative")
    return out.withColumn("score", score).drop("_tier")


def white_black(rows: DataFrame, title: str, white: list[str], black: list[str]) -> DataFrame:
    """Titles with any white and no black term, literally and without case."""
    return rows.where(F.col(title).rlike(T.literal_any(white)) & ~F.col(title).rlike(T.literal_any(black)))


def union_sources(a: DataFrame, b: DataFrame, source_a: str, source_b: str) -> DataFrame:
    """Both sources by column names, missing columns null, with the name of each row's source."""
    return a.withColumn("source", F.lit(source_a)).unionByName(b.withColumn("source", F.lit(source_b)), allowMissingColumns=True)


def display_columns(rows: DataFrame) -> DataFrame:
    """'nan' and blanks become ''; org is the department or the agency; period is given or start ~ end."""
    clean = lambda c: F.when(F.lower(F.trim(F.col(c))).isin("nan", "none"), F.lit("")).otherwise(F.coalesce(F.trim(c), F.lit("")))
    out = rows
    for c in ("dept", "agency", "period", "start_date", "end_date"):
        out = out.withColumn(c, clean(c))
    return out.withColumn("org", T.first_filled(F.col("dept"), F.col("agency"))).withColumn("period", F.when(F.col("period") != "", F.col("period")).otherwise(T.joined_filled(" ~ ", F.col("start_date"), F.col("end_date"))))


def qualified(screens: DataFrame) -> DataFrame:
    return screens.where(F.col("eligible") & F.col("fit").isin(*FIT_ORDER))


def best_of_program(rows: DataFrame, title: str, order: tuple[Column, ...]) -> DataFrame:
    """One row of each program (cleaned title): the first in order."""
    return rows.withColumn("_key", T.title_key(F.col(title))).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_r = 1").drop("_key", "_r")


def twins(rows: DataFrame, title: str, key: str, value: str) -> DataFrame:
    """value filled from the row itself, else from another row of the same cleaned title (smallest key), else ''."""
    keyed = rows.withColumn("_key", T.title_key(F.col(title)))
    filled = keyed.where(T.strip(F.coalesce(F.col(value), F.lit(""))) != "").groupBy("_key").agg(F.min_by(value, key).alias("_v"))
    return keyed.join(filled, "_key", "left").withColumn(value, T.first_filled(F.coalesce(F.col(value), F.lit("")), F.coalesce("_v", F.lit("")))).drop("_key", "_v")


def match_notices(rows: DataFrame, key: str, title: str, wanted_key: int | None, keyword: str, stripped: bool = True) -> DataFrame:
    """A key match alone, if there is one; else titles that contain the keyword, equal ones first; a blank keyword takes all.

    The keyword counts without white space at its ends, or (``stripped=False``) as it is.
    """
    hit_key = F.lit(False) if wanted_key is None else F.col(key) == wanted_key
    has = rows.agg(F.max(hit_key.cast("int")).alias("_has"))
    word = (keyword.strip() if stripped else keyword).lower()
    contains = F.contains(F.lower(title), F.lit(word)) if word else F.lit(True)
    found = rows.join(F.broadcast(has)).where(F.when(F.coalesce("_has", F.lit(0)) == 1, hit_key).otherwise(contains)).drop("_has")
    return found.withColumn("exact", F.lower(F.trim(title)) == word)


def batched_fallback(rows: DataFrame, order: Column, size: int = 50, share: float = 0.6, least: int = 10) -> DataFrame:
    """Of each batch of so many rows in order, the first max(least, share) stay. Rows are numbered by ranges, not in one task."""
    out = numbered(rows, order, name="_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int"))
    in_batch = Window.partitionBy("batch")
    out = out.withColumn("_b", F.row_number().over(in_batch.orderBy("_n"))).withColumn("_c", F.count(F.lit(1)).over(in_batch))
    return out.where(F.col("_b") <= F.greatest(F.lit(least), F.floor(F.col("_c") * share))).drop("_n", "_b", "_c")


def flat_attendance(months: DataFrame) -> DataFrame:
    """members x days x items as rows; a day without items is one row with nulls."""
    members = months.select("year_month", F.explode_outer("members").alias("m"))
    days = members.select("year_month", F.col("m.user.name").alias("name"), F.col("m.user.role").alias("role"), F.explode_outer("m.days").alias("d"))
    return days.select("year_month", "name", "role", F.col("d.date").alias("date"), F.explode_outer("d.items").alias("i")).select("year_month", "name", "role", "date", "i.*")


def day_summary(items: Column) -> Column:
    """struct(total_minutes, primary_type, total): the sum (null if 0), the type of the first longest item, as text."""
    total = F.aggregate(items, F.lit(0), lambda a, x: a + F.coalesce(x["duration_minutes"], F.lit(0)))
    longest = F.array_max(F.transform(items, lambda x, i: F.struct(F.coalesce(x["duration_minutes"], F.lit(0)).alias("d"), (-i).alias("p"), x["type"].alias("t"))))
    return F.struct(F.nullif(total, F.lit(0)).alias("total_minutes"), longest["t"].alias("primary_type"), F.when(total > 0, D.duration_text(total)).alias("total"))


def roster(statuses: DataFrame, kind: str = "type", name: str = "name", pos: str = "pos") -> DataFrame:
    """type -> names in order, for planned blocks."""
    names = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(name).alias("n"))))
    return statuses.groupBy(kind).agg(F.array_join(F.transform(names, lambda x: x["n"]), ", ").alias("names"), F.count(F.lit(1)).alias("n"))


def member_key(record_id: Column, uid: Column, name: Column) -> Column:
    """id: or uid: or name:, the first that is filled."""
    filled = lambda p, c: F.when(T.strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(p), T.strip(c)))
    return F.coalesce(filled("id:", record_id), filled("uid:", uid), filled("name:", name))


def merged_members(members: DataFrame, pos: str = "pos") -> DataFrame:
    """Members of several captures as one row a member: the first filled name and role, days united by date, items distinct."""
    keyed = members.withColumn("member", member_key(F.col("record_id"), F.col("uid"), F.col("name")))
    first = lambda c: F.min_by(c, F.when(T.strip(F.coalesce(c, F.lit(""))) != "", F.col(pos))).alias(c)
    who = keyed.groupBy("member").agg(first("name"), first("role"))
    # Items are made distinct as rows: in an array each would be compared with all others. A day without items stays.
    items = keyed.select("member", F.explode("days").alias("d")).select("member", "d.date", F.explode_outer(F.transform("d.items", lambda x: F.struct(x.alias("item")))).alias("i")).distinct()
    days = items.groupBy("member", "date").agg(F.transform(F.sort_array(F.collect_list("i")), lambda i: i["item"]).alias("items"))
    days = days.select("member", F.struct("date", "items", day_summary(F.col("items")).alias("summary")).alias("d")).groupBy("member").agg(F.sort_array(F.collect_list("d")).alias("days"))
    return who.join(days, "member", "left")


def best_planned(rows: DataFrame, key: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """The best planned block of each person and type: both times count 100, a morning or afternoon text 20, then hours; the first of equals."""
    filled = lambda c: (T.strip(F.coalesce(F.col(c), F.lit(""))) != "").cast("int")
    score = 100 * (filled("start_time") * filled("end_time")) + 20 * F.coalesce(F.col("raw_text").rlike(f"{D.AFTERNOON}|{D.MORNING}").cast("int"), F.lit(0)) + F.coalesce(F.floor(F.col("duration_minutes") / 60), F.lit(0)).cast("int")
    return rows.withColumn("_s", score).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_s"), "pos"))).where("_r = 1").drop("_s", "_r")
