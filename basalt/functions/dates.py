"""Date, clock and duration expressions. The reference time is always an argument; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for dates and the clock in the supported languages.
NEXT_WEEK = r"(?i)다음\s*주|차주|next\s+week"
THIS_WEEK = r"(?i)이번\s*주|금주|this\s+week"
LAST_WEEK = r"(?i)지난\s*주|저번\s*주|last\s+week"
RECENT_DAYS = r"(?i)(?:최근|지난|last)\s*(\d{1,3})\s*(?:일|days?)"
TODAY_WORDS = r"(?i)^(오늘|today|방금|\d+\s*(분|시간)\s*전)"
AFTERNOON = r"(?i)오후|pm"
MORNING = r"(?i)오전|am"


def week_start(day: Column, offset: int | Column = 0) -> Column:
    """The Monday of a day's week, ``offset`` weeks on."""
    return F.date_add(F.date_trunc("week", day).cast("date"), F.lit(offset) * 7)


def week_bounds(day: Column, offset: int | Column = 0) -> Column:
    """struct(first, last): Monday and Sunday."""
    first = week_start(day, offset)
    return F.struct(first.alias("first"), F.date_add(first, 6).alias("last"))


def phrase_range(text: Column, reference: Column) -> Column:
    """struct(first, last) of next, this or last week (in this precedence) or the last N days, today included; else null."""
    n = F.nullif(F.regexp_extract(text, RECENT_DAYS, 1), F.lit("")).cast("int")
    recent = F.struct(F.date_sub(reference, n - 1).alias("first"), reference.cast("date").alias("last"))
    return F.when(text.rlike(NEXT_WEEK), week_bounds(reference, 1)).when(text.rlike(THIS_WEEK), week_bounds(reference, 0)).when(text.rlike(LAST_WEEK), week_bounds(reference, -1)).when(n > 0, recent)


def parsed_date(text: Column, reference: Column) -> Column:
    """Y.M.D, YY.M.D or M.D (of the reference's year) with any of . - /, or a word for today; null if it isn't a date."""
    t = F.trim(text)
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    full, short, month = r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})", r"^(\d{2})[./-](\d{1,2})[./-](\d{1,2})", r"^(\d{1,2})[./-](\d{1,2})\.?$"
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return (
        F.when(t.rlike(TODAY_WORDS), reference.cast("date"))
        .when(t.rlike(full), made(part(full, 1), part(full, 2), part(full, 3)))
        .when(t.rlike(short), made(F.concat(F.lit("20"), part(short, 1)), part(short, 2), part(short, 3)))
        .when(t.rlike(month), made(F.year(reference).cast("string"), part(month, 1), part(month, 2)))
    )


def dashed(text: Column) -> Column:
    """The first ten characters with dashes for dots and slashes."""
    return F.left(F.regexp_replace(F.trim(text), r"[./]", "-"), F.lit(10))


def minutes_of(clock: Column) -> Column:
    """Minutes of the day of ``9:30``, ``오후 2시 30분``, ``2:30 pm``, ``14``; null if there is no hour or it is out of range."""
    h = F.nullif(F.regexp_extract(clock, r"(\d{1,2})", 1), F.lit("")).cast("int")
    m = F.coalesce(F.nullif(F.regexp_extract(clock, r"\d{1,2}\s*(?::|시)\s*(\d{1,2})", 1), F.lit("")).cast("int"), F.lit(0))
    hour = F.when(clock.rlike(AFTERNOON) & (h < 12), h + 12).when(clock.rlike(MORNING) & (h == 12), F.lit(0)).otherwise(h)
    return F.when((hour <= 24) & (m < 60), hour * 60 + m)


def clock_of(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def clock_range(text: Column) -> Column:
    """struct(first, last, minutes) of ``a ~ b``; minutes is null unless b is after a."""
    ends = F.split(text, r"\s*[~–-]\s*")
    a, b = minutes_of(F.get(ends, F.lit(0))), minutes_of(F.get(ends, F.lit(1)))
    return F.struct(a.alias("first"), b.alias("last"), F.when(b > a, b - a).alias("minutes"))


def duration_minutes(text: Column) -> Column:
    """Minutes of ``9h 30m``, ``9시간 30분``, ``90m`` or ``9:30``; null if there is none."""
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    h, m = number(r"(\d+)\s*(?:h|시간)"), number(r"(\d+)\s*(?:m|분)")
    clock = number(r"^\s*(\d+):\d{2}") * 60 + number(r"^\s*\d+:(\d{2})")
    return F.coalesce(F.when(h.isNotNull() | m.isNotNull(), F.coalesce(h, F.lit(0)) * 60 + F.coalesce(m, F.lit(0))), clock)


def duration_text(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.when(m == 0, F.format_string("%dh", h)).when(h == 0, F.format_string("%dm", m)).otherwise(F.format_string("%dh %dm", h, m))


def zero_duration(text: Column) -> Column:
    return strip_spaces(text).rlike(r"^(0+[:：]0+|0+시간0+분|0+h0+m)$")


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def style_minutes(style: Column) -> Column:
    """struct(first, last) in minutes of a day of ``left: x%; right: y%``."""
    left = F.nullif(F.regexp_extract(style, r"left:\s*([\d.]+)%", 1), F.lit("")).cast("double")
    right = F.nullif(F.regexp_extract(style, r"right:\s*([\d.]+)%", 1), F.lit("")).cast("double")
    return F.struct(F.round(left / 100 * 1440).cast("int").alias("first"), F.round((100 - right) / 100 * 1440).cast("int").alias("last"))


def in_work_window(first: Column, last: Column, opens: int = 360, closes: int = 1380) -> Column:
    return (first >= opens) & (last <= closes) & (first < last)


def is_live(last: Column, now: Column, slack: int = 2) -> Column:
    return F.abs(last - now) <= slack


def shifted_month(month: Column, n: int | Column) -> Column:
    """yyyy-MM shifted by n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), F.lit(n)), "yyyy-MM")


def months_between(first: Column, last: Column) -> Column:
    """yyyy-MM of every month from the first day's to the last day's."""
    days = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))


def years(text: Column) -> Column:
    """The largest 20xx in a text, as an integer."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), 1), lambda y: y.cast("int")))


def reference_year(text: Column, reference: Column) -> Column:
    return F.coalesce(years(text), F.when(text.rlike(r"(?i)올해|금년|this\s+year"), F.year(reference)))


def backoff_seconds(attempt: Column, base: int = 5, most: int = 300) -> Column:
    """Doubling delays: base, base, 2 base, 4 base ... up to ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(base), base * F.pow(F.lit(2.0), F.least(F.greatest(F.lit(0), attempt - 1), F.lit(30))))).cast("int")


def due_again(last: Column, now: Column, seconds: int | Column) -> Column:
    """Whether so many seconds have passed; true if it never ran."""
    return F.coalesce(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last.cast("timestamp")) >= seconds, F.lit(True))


def is_workday(day: Column, holidays: list[str] | None = None) -> Column:
    return (F.weekday(day) < 5) & ~F.date_format(day, "yyyy-MM-dd").isin(holidays or [""])


def ordered_range(first: Column, last: Column, reference: Column, days: int = 7) -> Column:
    """struct(first, end): reversed ends are swapped, missing ones default to the reference and ``days`` on; end is exclusive."""
    a = F.coalesce(first, last, reference.cast("date"))
    b = F.coalesce(last, F.when(first.isNull(), F.date_add(reference, days - 1)), first)
    return F.struct(F.least(a, b).alias("first"), F.date_add(F.greatest(a, b), 1).alias("end"))


def clamped_slot(first: Column, last: Column, now: Column) -> Column:
    """struct(first, last, error): a slot in the past is an error, a start in the past is now, a missing end is an hour on."""
    end = F.coalesce(last, first + F.expr("interval 1 hour"))
    past = end <= now
    return F.struct(F.when(~past, F.greatest(first, now)).alias("first"), F.when(~past, end).alias("last"), F.when(past, F.lit("past")).when(end <= first, F.lit("reversed")).alias("error"))


def in_retention(start: Column, reference: Column, back: int = 7, ahead: int = 31) -> Column:
    """Whether the day in a start text lies in [reference - back, reference + ahead); false if it is no date."""
    day = F.try_to_date(F.left(start, F.lit(10)), "yyyy-MM-dd")
    return F.coalesce((day >= F.date_sub(reference, back)) & (day < F.date_add(reference, ahead)), F.lit(False))
