"""Requests and events around the tables: routing signals, tool arguments, webhooks, admission, schedules, outcomes.

Language-model decisions are input columns; these operators parse, normalise, check and route them.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

# Event names, categories and defaults of the formats that are read.
PAGE_EVENTS = ["page_created", "page_updated", "page_removed", "page_trashed", "page_restored"]
SLOT = r"(\d{1,2})\s*(?::(\d{2})|시(?:\s*(\d{1,2})분)?)?\s*(?:~|-|–|부터)\s*(\d{1,2})\s*(?::(\d{2})|시(?:\s*(\d{1,2})분)?)?"
HOUR = r"(\d{1,2})\s*(?::(\d{2})|시(?:\s*(\d{1,2})분)?)"
SELF = r"(?i)\b(my|mine|me)\b|내\s|나의|제\s"


# Routing and signals


def signals(text: Column, table: dict[str, list[str]]) -> Column:
    """domain -> matched keywords, for domains that match."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), T.matched(text, words).alias("v")) for k, words in table.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["v"]) > 0))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is found: teams from roles, modes from requests."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def attachment_mode(query: Column, has_document: Column, has_image: Column) -> Column:
    """Which attachments a request takes: both, documents, images or none, by what it asks for and what there is."""
    asks_image, asks_document = query.rlike(r"(?i)image|photo|picture|사진|이미지"), query.rlike(r"(?i)document|file|pdf|문서|파일")
    return F.when(asks_image & asks_document & has_document & has_image, "both").when(asks_image & has_image, "image").when(asks_document & has_document, "document").when(has_document & has_image, "both").when(has_document, "document").when(has_image, "image").otherwise("none")


def decision(payload: Column, allowed: list[str], default: str) -> Column:
    """struct(decision, flagged): the decision of a JSON object in a text, in lower case; the default, flagged, if it isn't allowed."""
    found = F.lower(F.trim(F.get_json_object(T.json_object(payload), "$.decision")))
    fine = F.coalesce(found.isin(*allowed), F.lit(False))
    return F.struct(F.when(fine, found).otherwise(default).alias("decision"), (~fine).alias("flagged"))


def blank_words(value: Column) -> Column:
    """'' for words that mean nothing: none, null, n/a, 없음."""
    return F.when(F.lower(T.strip(F.coalesce(value, F.lit("")))).isin("none", "null", "n/a", "-", "없음"), "").otherwise(T.strip(F.coalesce(value, F.lit(""))))


def tool_arguments(raw: Column) -> Column:
    """A JSON object as a map of strings; anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.trim(raw).rlike(r"(?s)^\{.*\}$"), F.coalesce(F.from_json(raw, "map<string,string>"), empty)).otherwise(empty)


def with_date_range(args: Column, query: Column, reference: Column) -> Column:
    """Arguments with first and last day of the weeks or days that a query names, which take the place of a month."""
    r = D.phrase_range(query, reference)
    made = F.map_from_arrays(F.array(F.lit("date"), F.lit("end_date")), F.array(r["first"].cast("string"), r["last"].cast("string")))
    return F.when(r.isNotNull(), F.map_concat(F.map_filter(args, lambda k, v: k != "year_month"), made)).otherwise(args)


def time_slot(text: Column, day: Column) -> Column:
    """struct(first, last) of ``h:mm ~ h:mm``, hours in words, or one hour (an hour long) on a day; null if there is none."""
    # Every value that is used again is bound by a lambda: as columns, each use would hold all of its expression.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    parts = lambda found, pattern, n: F.array(*[F.nullif(F.regexp_extract(found, pattern, k), F.lit("")).cast("int") for k in range(1, n + 1)])
    # The parts of a match are looked for in the match only.
    numbers = lambda pattern, n: bound(F.regexp_extract(text, pattern, 0), lambda found: F.when(found != "", parts(found, pattern, n)))

    def at(h: Column, m: Column) -> Column:
        return F.when((h <= 23) & (m <= 59), day.try_cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, m))

    def clock(x: Column, k: int) -> Column:
        return at(x[k], F.coalesce(x[k + 1], x[k + 2], F.lit(0)))

    ranged = bound(numbers(SLOT, 6), lambda x: F.struct(clock(x, 0).alias("first"), clock(x, 3).alias("last")))
    single = bound(bound(numbers(HOUR, 3), lambda x: clock(x, 0)), lambda one: F.struct(one.alias("first"), (one + F.expr("interval 1 hour")).alias("last")))
    return bound(ranged, lambda r: F.when(r["first"].isNotNull() & r["last"].isNotNull(), r).otherwise(bound(single, lambda s: F.when(s["first"].isNotNull(), s))))


def room_arguments(args: Column, query: Column) -> Column:
    """Aliased actions become their names; a question about a state covers the whole day; an end is an hour after the start."""
    action = F.coalesce(F.try_element_at(args, F.lit("action")), F.lit("check"))
    named = F.when(action.isin("list_mine", "my_list", "mine"), "list").when(action.isin("status", "state"), "check").otherwise(action)
    start = F.try_element_at(args, F.lit("start_time"))
    end = F.coalesce(F.try_element_at(args, F.lit("end_time")), F.when(start.isNotNull(), D.clock_of(D.minutes_of(start) + 60)))
    whole_day = query.rlike(r"(?i)현황|status|whole day|하루") & start.isNull()
    return F.struct(named.alias("action"), F.when(whole_day, F.lit("00:00")).otherwise(start).alias("start_time"), F.when(whole_day, F.lit("23:59")).otherwise(end).alias("end_time"), whole_day.alias("whole_day"))


def requested_person(query: Column, people: list[str]) -> Column:
    """An explicit roster name, none for words that mean oneself, else null."""
    names = F.filter(F.array(*map(F.lit, people)), lambda n: F.contains(query, n))
    return F.when(F.size(names) > 0, F.get(names, F.lit(0))).when(query.rlike(SELF), F.lit(""))


# Webhooks and admission


def notification_path(resource: Column) -> Column:
    """struct(mailbox, event_id) of users/{mailbox}/.../events/{id}, decoded; null if it isn't one."""
    pattern = r"(?i)users(?:/|\(')([^/')]+)(?:'\))?/(?:.*/)?events(?:/|\(')([^/')]+)"
    mailbox, event = F.regexp_extract(resource, pattern, 1), F.regexp_extract(resource, pattern, 2)
    return F.when(mailbox != "", F.struct(F.try_url_decode(mailbox).alias("mailbox"), F.try_url_decode(event).alias("event_id")))


def page_event(body: Column, header: Column) -> Column:
    """The event of a page webhook: the header, the body's event, the trigger that is set, or created for a first version."""
    triggers = [F.when(F.get_json_object(body, f"$.{name}").isNotNull(), F.lit(name)) for name in PAGE_EVENTS]
    version = F.get_json_object(body, "$.page.version").cast("int")
    return F.coalesce(T.blank_to_null(header), T.blank_to_null(F.get_json_object(body, "$.event")), *triggers, F.when(version == 1, "page_created").when(version > 1, "page_updated"))


def allowed_space(body: Column, spaces: list[str]) -> Column:
    return F.coalesce(F.upper(F.get_json_object(body, "$.page.spaceKey")).isin(*[s.upper() for s in spaces]), F.lit(False)) if spaces else F.lit(True)


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Whether an address lies in any network; false for what isn't an address."""
    made = [ipaddress.ip_network(n, strict=False) for n in networks]

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            try:
                a = ipaddress.ip_address((v or "").strip())
            except ValueError:
                return False
            return any(a in n for n in made if n.version == a.version)

        return s.map(one)

    return run(ip)


def valid_event_id(value: Column) -> Column:
    """Calendar ids have eighty characters or more once dots of an ellipsis are off."""
    return F.length(F.regexp_replace(F.trim(value), r"(…|\.\.\.)$", "")) >= 80


def valid_booking(value: Column) -> Column:
    return T.uuid_like(F.trim(value)) & ~F.lower(value).rlike("00000000-0000|xxxx")


def outcome(removed: Column, ignored: Column, error: Column, n_warnings: Column) -> Column:
    """removed, ignored, error, partial (warnings) or success, in this order."""
    return F.when(removed, "removed").when(ignored, "ignored").when(T.strip(F.coalesce(error, F.lit(""))) != "", "error").when(n_warnings > 0, "partial").otherwise("success")


def failure_reason(status: Column, raw: Column, n_rows: Column) -> Column:
    """Why a model's chunking gave nothing, by ordered rules; null if it gave rows."""
    return F.when(n_rows > 0, F.lit(None).cast("string")).when(status == "timeout", "timeout").when(T.strip(F.coalesce(raw, F.lit(""))) == "", "empty_response").when(T.json_object(raw).isNull(), "no_json").otherwise("no_evidence")


def link_route(url: Column, skip: list[str], documents: list[str], videos: list[str], own: list[str], has_file: Column) -> Column:
    """struct(status, source_method) of a link by its host, in this order: skipped, document, video, own page, else scraped."""
    h = T.host(url)
    row = lambda s, m: F.struct(F.lit(s).alias("status"), F.lit(m).alias("source_method"))
    hit = lambda hosts: h.isin(*hosts) if hosts else F.lit(False)
    return F.when(hit(skip), row("skipped", "list")).when(hit(documents) & has_file, row("ok", "local_file")).when(hit(documents), row("ok", "context")).when(hit(videos), row("ok", "title")).when(hit(own), row("skipped", "internal")).otherwise(row("pending", "scrape"))


# Attendance schedules


def item_type(label: Column, background: Column, accent: Column, labels: dict[str, str], colours: dict[str, str]) -> Column:
    """struct(type, type_source): the label, the longest known label in it, the background colour, the accent colour, else other."""
    exact, by_colour = (F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*map(F.lit, m.values()))) for m in (labels, colours))
    inside = None
    for name in sorted(labels, key=lambda n: (-len(n), n)):
        hit = F.contains(label, F.lit(name))
        inside = F.when(hit, labels[name]) if inside is None else inside.when(hit, labels[name])
    found = [(F.try_element_at(exact, label), "label"), (inside, "contained"), (F.try_element_at(by_colour, F.lower(background)), "background"), (F.try_element_at(by_colour, F.lower(accent)), "accent")]
    rows = [F.when(c.isNotNull(), F.struct(c.alias("type"), F.lit(s).alias("type_source"))) for c, s in found]
    return F.coalesce(*rows, F.struct(F.lit("other").alias("type"), F.lit("none").alias("type_source")))


def item_minutes(duration: Column, first: Column, last: Column, tooltip: Column) -> Column:
    """Minutes of an item: its duration text, else the time difference, else its tooltip."""
    a, b = D.minutes_of(first), D.minutes_of(last)
    return F.coalesce(D.duration_minutes(duration), F.when(b > a, b - a), D.clock_range(tooltip)["minutes"])


def schedule_lines(items: DataFrame, person: str = "name", day: str = "date", pos: str = "pos", closing: str = "18:00") -> DataFrame:
    """One text a person: a line a day of its items; an afternoon leave without an end lasts until closing time."""
    end = F.when((F.col("type") == "leave") & (T.first_filled(F.coalesce("end_time", F.lit(""))) == "") & (D.minutes_of(F.col("start_time")) >= 720), F.lit(closing)).otherwise(F.coalesce("end_time", F.lit("")))
    span = F.when(F.coalesce("start_time", F.lit("")) != "", F.concat(F.lit(" "), F.col("start_time"), F.lit("~"), end)).otherwise("")
    per_day = items.groupBy(person, day).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.concat(F.col("type"), span).alias("t")))), lambda x: x["t"]), ", ").alias("t"))
    return per_day.groupBy(person).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.col("t")))), lambda x: F.concat(x["d"], F.lit(": "), x["t"])), "\n").alias("schedule"))


def overlaid(history: DataFrame, today: DataFrame, as_of: Column, person: str = "name", day: str = "date") -> DataFrame:
    """History with today's snapshot: for people who have one, its rows take the place of history's of that day."""
    now = as_of.cast("date").cast("string")
    fresh = today.where(F.col(day) == now)
    return history.join(fresh.select(person, day).distinct(), [person, day], "left_anti").unionByName(fresh, allowMissingColumns=True)


def newest_source(sources: list[DataFrame], key: str, stamp: str) -> DataFrame:
    """Rows of the first source that has a key, of its newest file."""
    rows = None
    for k, s in enumerate(sources):
        one = s.withColumn("_p", F.lit(k))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_p", F.desc(stamp)))).where("_r = 1").drop("_p", "_r")


def roster_names(people: DataFrame, teams: list[str], roles: list[str], pos: str = "pos") -> DataFrame:
    """Distinct names of people in the teams whose role holds any of the aliases, in order."""
    role = F.lit(False)
    for r in roles:
        role = role | F.contains(F.lower("role"), F.lit(r.lower()))
    kept = people.where((F.col("team").isin(*teams) if teams else F.lit(True)) & (role if roles else F.lit(True)))
    return kept.groupBy("name").agg(F.min(pos).alias(pos)).orderBy(pos)


def with_teams(people: DataFrame, previous: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """People with the team they had, else the one that their role tells; a new role wins over the old one."""
    p = previous.select(F.col("name").alias("_n"), F.col("team").alias("_team"), F.col("role").alias("_role"))
    role = T.first_filled(F.coalesce("role", F.lit("")), F.coalesce("_role", F.lit("")))
    return people.join(p, F.col("name") == F.col("_n"), "left").select("name", role.alias("role"), F.coalesce(T.blank_to_null(F.col("_team")), first_match(role, rules, default)).alias("team"))


def month_gaps(rows: DataFrame, first: str, last: str, month: str = "year_month") -> DataFrame:
    """Months from first to last (yyyy-MM-dd) with the number of rows; 0 where one is missing."""
    wanted = rows.sparkSession.range(1).select(F.explode(D.months_between(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(month))
    return wanted.join(rows.groupBy(month).agg(F.count(F.lit(1)).alias("n")), month, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def next_workday(calendar: DataFrame, after: Column, day: str = "day", is_open: str = "is_open") -> DataFrame:
    return calendar.where(F.col(is_open) & (F.col(day) > after)).agg(F.min(day).alias("next_day"))


# Histories


def booking_mentions(messages: DataFrame, n: int = 12, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Booking ids in the last n messages of a session, oldest first, distinct, with the section heading above each line."""
    last = messages.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    lines = last.select(session, order, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    heading = F.nullif(F.regexp_extract("line", r"^\s*#*\s*\[?(owned|attending)\]?\s*:?\s*$", 1), F.lit(""))
    by = Window.partitionBy(session).orderBy(order, "line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last(heading, True).over(by), F.lit("owned")))
    ids = lines.select(session, order, "line_no", "section", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})"), 1)).alias("booking_id"))
    return ids.withColumn("_r", F.row_number().over(Window.partitionBy(session, "booking_id").orderBy(order, "line_no"))).where("_r = 1").select(session, "booking_id", "section", F.row_number().over(Window.partitionBy(session).orderBy(order, "line_no")).alias("position"))


def followup_query(question: Column, missing: Column, hints: Column, prior: Column, year: Column, cut: int = 400) -> Column:
    """struct(direct, policy): the question with the missing terms, and hints with them and the prior policy; cut, the year put on."""
    suffix = F.coalesce(F.concat(F.lit(" "), year.cast("string")), F.lit(""))
    join = lambda *parts: F.concat(F.left(F.array_join(T.distinct_folded(F.concat(*parts)), " "), F.lit(cut)), suffix)
    return F.struct(join(F.array(question), missing).alias("direct"), join(F.slice(hints, 1, 5), missing, F.array(F.coalesce(prior, F.lit("")))).alias("policy"))


def still_ahead(events: DataFrame, as_of: Column, person: str = "organizer") -> DataFrame:
    """Per person, whether any of their events ends in the future."""
    return events.groupBy(person).agg((F.max("last") > as_of).alias("actionable"))


def matched_bookings(bookings: DataFrame, subject: str, start: str) -> DataFrame:
    """Bookings with the subject and the start to the minute, else with the start alone: the first tier that has any."""
    minute = F.left("start_time", F.lit(16)) == start[:16]
    tier = F.when((F.col("subject") == subject) & minute, 1).when(minute, 2)
    found = bookings.withColumn("tier", tier).where("tier is not null")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("_t"))), F.col("tier") == F.col("_t")).drop("_t")
