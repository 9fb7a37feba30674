from datetime import date, datetime

from pyspark.sql import functions as F

from basalt.operators import assistant as A


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def test_signals_and_modes(spark):
    assert value(spark, A.signals(F.col("t"), {"a": ["room", "desk"], "b": ["leave"]}), t="A  ROOM please") == {"a": ["room"]}
    assert value(spark, A.first_match(F.col("t"), [("dev", "(?i)engineer"), ("ops", "(?i)manager")], "other"), t="Site Manager") == "ops"
    for q, d, i, want in (("show the image", True, True, "image"), ("x", True, True, "both"), ("pdf and photo", True, True, "both"), ("x", False, False, "none"), ("photo", True, False, "document")):
        assert value(spark, A.attachment_mode(F.col("q"), F.lit(d), F.lit(i)), q=q) == want
    assert tuple(value(spark, A.decision(F.col("t"), ["answer", "expand"], "answer"), t='x {"decision": "EXPAND"}')) == ("expand", False)
    assert tuple(value(spark, A.decision(F.col("t"), ["answer", "expand"], "answer"), t="junk")) == ("answer", True)
    assert value(spark, A.blank_words(F.col("t")), t=" None ") == "" and value(spark, A.blank_words(F.col("t")), t=" x ") == "x"


def test_arguments(spark):
    assert value(spark, A.tool_arguments(F.col("t")), t='{"a": "b", "n": 1}') == {"a": "b", "n": "1"}
    assert value(spark, A.tool_arguments(F.col("t")), t="[1]") == {}
    args = F.create_map(F.lit("year_month"), F.lit("2026-06"), F.lit("worker"), F.lit("kim"))
    assert value(spark, A.with_date_range(args, F.col("t"), F.lit(date(2026, 6, 10))), t="next week") == {"worker": "kim", "date": "2026-06-15", "end_date": "2026-06-21"}
    assert value(spark, A.with_date_range(args, F.col("t"), F.lit(date(2026, 6, 10))), t="june") == {"year_month": "2026-06", "worker": "kim"}
    day = F.lit(date(2026, 6, 10))
    for t, want in {"14:00 ~ 15:30": (14, 0, 15, 30), "9시 30분 ~ 11시": (9, 30, 11, 0), "at 16시": (16, 0, 17, 0)}.items():
        got = value(spark, A.time_slot(F.col("t"), day), t=t)
        assert tuple(got) == (datetime(2026, 6, 10, *want[:2]), datetime(2026, 6, 10, *want[2:])), t
    assert value(spark, A.time_slot(F.col("t"), day), t="no time") is None
    m = F.create_map(F.lit("action"), F.lit("list_mine"), F.lit("start_time"), F.lit("14:00"))
    assert tuple(value(spark, A.room_arguments(m, F.lit("x")))) == ("list", "14:00", "15:00", False)
    assert tuple(value(spark, A.room_arguments(F.create_map().cast("map<string,string>"), F.lit("room status")))) == ("check", "00:00", "23:59", True)
    assert value(spark, A.requested_person(F.col("t"), ["Kim", "Lee"]), t="Lee and Kim") == "Kim" and value(spark, A.requested_person(F.col("t"), ["Kim"]), t="my day") == ""


def test_webhooks(spark):
    assert tuple(value(spark, A.notification_path(F.col("t")), t="Users/a%40b/Events/E%3D1")) == ("a@b", "E=1")
    assert value(spark, A.notification_path(F.col("t")), t="groups/x") is None
    assert value(spark, A.page_event(F.col("b"), F.lit("")), b='{"page_removed": {"x": 1}}') == "page_removed"
    assert value(spark, A.page_event(F.col("b"), F.lit(None).cast("string")), b='{"page": {"version": 1}}') == "page_created"
    assert value(spark, A.allowed_space(F.col("b"), ["dev"]), b='{"page": {"spaceKey": "Dev"}}') and not value(spark, A.allowed_space(F.col("b"), ["dev"]), b="{}")
    ips = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("::1",), ("x",), (None,)], "ip string")
    assert [r[0] for r in ips.select(A.in_networks(F.col("ip"), ["10.0.0.0/8", "::1"])).collect()] == [True, False, True, False, False]
    assert value(spark, A.valid_booking(F.col("t")), t="12345678-1234-1234-1234-123456789abc") and not value(spark, A.valid_booking(F.col("t")), t="x")
    assert value(spark, A.valid_event_id(F.lit("a" * 80 + "..."))) and not value(spark, A.valid_event_id(F.lit("a" * 79 + "...")))


def test_outcomes(spark):
    assert value(spark, A.outcome(F.lit(False), F.lit(False), F.lit(""), F.lit(2))) == "partial"
    assert value(spark, A.failure_reason(F.lit("ok"), F.lit("text"), F.lit(0))) == "no_json"
    r = value(spark, A.link_route(F.lit("https://docs.x/1"), ["s.x"], ["docs.x"], ["v.x"], ["w.x"], F.lit(True)))
    assert tuple(r) == ("ok", "local_file")


def test_schedule(spark):
    got = value(spark, A.item_type(F.col("l"), F.lit("#FF0000"), F.lit(""), {"leave": "leave", "sick leave": "sick"}, {"#ff0000": "work"}), l="my sick leave day")
    assert tuple(got) == ("sick", "contained")
    assert tuple(value(spark, A.item_type(F.lit("?"), F.lit("#FF0000"), F.lit(""), {"leave": "leave"}, {"#ff0000": "work"}))) == ("work", "background")
    assert value(spark, A.item_minutes(F.lit(""), F.lit("9:00"), F.lit("10:30"), F.lit(""))) == 90
    items = spark.createDataFrame([("Kim", "2026-06-10", 1, "leave", "14:00", ""), ("Kim", "2026-06-09", 1, "work", "", ""), ("Kim", "2026-06-10", 0, "work", "9:00", "12:00")], "name string, date string, pos int, type string, start_time string, end_time string")
    assert A.schedule_lines(items).collect()[0]["schedule"] == "2026-06-09: work\n2026-06-10: work 9:00~12:00, leave 14:00~18:00"
    today = spark.createDataFrame([("Kim", "2026-06-10", 0, "live", "", "")], items.schema)
    assert sorted(r["type"] for r in A.overlaid(items, today, F.lit(date(2026, 6, 10))).collect()) == ["live", "work"]


def test_rosters(spark):
    people = spark.createDataFrame([("Kim", "A", "Lead engineer", 2), ("Lee", "B", "engineer", 1), ("Kim", "A", "engineer", 3), ("Cho", "A", "designer", 0)], "name string, team string, role string, pos int")
    assert [r["name"] for r in A.roster_names(people, ["A"], ["Engineer"]).collect()] == ["Kim"]
    old = spark.createDataFrame([("Kim", "Z", "old")], "name string, team string, role string")
    new = spark.createDataFrame([("Kim", ""), ("Lee", "data engineer")], "name string, role string")
    assert sorted(map(tuple, A.with_teams(new, old, [("data", "data")], "none").collect())) == [("Kim", "old", "Z"), ("Lee", "data engineer", "data")]
    a = spark.createDataFrame([("Kim", "1")], "name string, stamp string")
    b = spark.createDataFrame([("Kim", "9"), ("Lee", "2"), ("Lee", "3")], "name string, stamp string")
    assert sorted(map(tuple, A.newest_source([a, b], "name", "stamp").collect())) == [("Kim", "1"), ("Lee", "3")]
    m = spark.createDataFrame([("2026-01",), ("2026-03",)], "year_month string")
    assert sorted(map(tuple, A.month_gaps(m, "2026-01-20", "2026-03-02").collect())) == [("2026-01", 1), ("2026-02", 0), ("2026-03", 1)]
    cal = spark.createDataFrame([(date(2026, 6, 13), False), (date(2026, 6, 15), True)], "day date, is_open boolean")
    assert A.next_workday(cal, F.lit(date(2026, 6, 12))).collect()[0][0] == date(2026, 6, 15)


def test_histories(spark):
    i = ["12345678-1234-1234-1234-12345678900%d" % k for k in range(3)]
    rows = [("c", 1, f"[owned]\nroom {i[0]}"), ("c", 2, f"attending:\n{i[1]} and {i[0]}"), ("c", 0, i[2])]
    got = A.booking_mentions(spark.createDataFrame(rows, "conv_id string, turn int, text string"), 2).orderBy("position").collect()
    assert [(r["booking_id"], r["section"]) for r in got] == [(i[0], "owned"), (i[1], "attending")]
    f = value(spark, A.followup_query(F.lit("q"), F.array(F.lit("m")), F.array(F.lit("h"), F.lit("Q")), F.lit(None).cast("string"), F.lit(2026)))
    assert tuple(f) == ("q m 2026", "h Q m 2026")
    e = spark.createDataFrame([("a", "2026-01-01"), ("a", "2026-09-01"), ("b", "2026-01-01")], "organizer string, last string")
    assert {r["organizer"]: r["actionable"] for r in A.still_ahead(e, F.lit("2026-06-01")).collect()} == {"a": True, "b": False}
    b = spark.createDataFrame([("x", "2026-06-10T10:00:00"), ("y", "2026-06-10T10:00:30"), ("x", "2026-06-11T10:00:00")], "subject string, start_time string")
    assert A.matched_bookings(b, "x", "2026-06-10T10:00").count() == 1 and A.matched_bookings(b, "zz", "2026-06-10T10:00").count() == 2
