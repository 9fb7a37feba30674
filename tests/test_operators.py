import random

from pyspark.sql import functions as F

from basalt.operators import chunking as K
from basalt.operators import conversation as C
from basalt.operators import dedup, feeds
from basalt.operators import evaluation as E
from basalt.operators import merge as M
from basalt.operators import operations as O
from basalt.operators import retrieval as R


def test_neighbours(spark):
    catalog = spark.createDataFrame([(i, "p", f"s{k}") for k, i in enumerate("abcde")] + [("z", "q", "s0")], "id string, page string, section_order string")
    seeds = spark.createDataFrame([("c", 1)], "id string, pos int")
    assert [r["id"] for r in R.neighbours(seeds, catalog).orderBy("position").collect()] == list("cabde")
    assert R.neighbours(seeds, catalog, total=3).count() == 3


def plain_diverse(hits, total, min_pages, per_page):
    """The rule in three plain phases."""
    order = sorted(hits, key=lambda h: (-h[2], h[0]))
    pages, taken = [], []
    for h in order:
        if h[1] not in pages:
            pages.append(h[1])
    for p in pages[:min_pages]:
        taken.append(next(h for h in order if h[1] == p))
    for h in order:
        if h not in taken and sum(t[1] == h[1] for t in taken) < per_page:
            taken.append(h)
    return [t[0] for t in taken[:total]]


def test_diverse(spark):
    r = random.Random(3)
    for _ in range(6):
        hits = [(i, f"p{r.randint(0, 3)}", r.randint(0, 5) / 5) for i in range(r.randint(1, 12))]
        args = (r.randint(1, 6), r.randint(1, 3), r.randint(1, 3))
        df = spark.createDataFrame(hits, "doc_id int, page string, score double")
        got = [x["doc_id"] for x in R.diverse(df, *args).orderBy("position").collect()]
        assert got == plain_diverse(hits, *args)


def test_greedy(spark):
    r = random.Random(5)
    for _ in range(2):
        raw = [[r.gauss(0, 1) for _ in range(3)] for _ in range(25)]
        vs = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in raw]
        kept, want = [], {}
        for i, v in enumerate(vs):
            near = [(-round(sum(a * b for a, b in zip(v, vs[j], strict=True)), 9), j) for j in kept]
            best = min(near, default=(0, None))
            want[i] = best[1] if -best[0] >= 0.8 else None
            if want[i] is None:
                kept.append(i)
        df = spark.createDataFrame(list(enumerate(vs)), "id int, vector array<double>")
        assert {x["id"]: x["duplicate_of"] for x in dedup.greedy(df, 0.8).collect()} == want


def test_either_key_and_children(spark):
    rows = spark.createDataFrame([(0, 0, "a", "u"), (0, 1, "a", "v"), (0, 2, "b", "v"), (0, 3, "", "")], "g int, n int, title string, url string")
    assert sorted(x["n"] for x in dedup.either_key(rows, "g", "n", "title", "url").collect()) == [0, 2, 3]
    kids = spark.createDataFrame([("p", 0, "one two three four"), ("p", 1, "one two three four."), ("p", 2, "other")], "parent_id string, pos int, text string")
    assert sorted(x["text"] for x in dedup.distinct_children(kids).collect()) == ["one two three four.", "other"]


def test_fuzzy_and_span(spark):
    df = spark.createDataFrame([("meeting rom a",), ("Meeting Room A",), ("zzz",)], "t string")
    assert [x[0] for x in df.select(dedup.closest(F.col("t"), ["Meeting Room A", "Lab"])).collect()] == ["Meeting Room A", "Meeting Room A", None]
    assert tuple(spark.range(1).select(dedup.span(F.lit("abcdef"), F.lit("cd")).alias("x")).collect()[0]["x"]) == (2, 4)


def test_merge_and_pending(spark):
    t = spark.createDataFrame([("r", "1", "old", "bot"), ("r", "2", "gone", None), ("r", "pending:x", "wait", "bot")], "room string, id string, subject string, owner string")
    s = spark.createDataFrame([("r", "1", "new", None), ("r", "3", "add", None)], "room string, id string, subject string, owner string")
    got = {x["id"]: (x["action"], x["subject"], x["owner"]) for x in M.merge(t, s, ["room", "id"], keep=["owner"]).collect()}
    assert got == {"1": ("update", "new", "bot"), "2": ("delete", "gone", None), "3": ("insert", "add", None), "pending:x": ("keep", "wait", "bot")}
    target = spark.createDataFrame([("pending:a", "o", "t1"), ("9", "o", "t1")], "id string, organizer string, first string")
    source = spark.createDataFrame([("5", "o", "t1"), ("6", "o", "t1"), ("9", "o", "t1")], "id string, organizer string, first string")
    assert {x["id"]: x["claims"] for x in M.claim_pending(target, source, "id", ["organizer", "first"]).collect()} == {"5": "pending:a", "6": None, "9": None}


def test_actions_and_fill(spark):
    t = spark.createDataFrame([(1, "a", "active"), (2, "b", "active")], "id int, title string, status string")
    a = spark.createDataFrame([("update", 1, "A"), ("deprecate", 2, None), ("create", 3, "c")], "action string, id int, title string")
    assert sorted(map(tuple, M.apply_actions(t, a).collect())) == [(1, "A", "active"), (2, "b", "deprecated"), (3, "c", "active")]
    users = spark.createDataFrame([(1, "", "x@A"), (2, "n", "y@b")], "id int, name string, email string")
    fresh = spark.createDataFrame([(1, "new", "X@a"), (2, "other", "z@b"), (3, "m", "q@b")], "id int, name string, email string")
    assert sorted(map(tuple, M.fill_empty(users, fresh, "id", ["name"], ["email"]).collect())) == [(1, "new", "x@A"), (2, "n", "z@b"), (3, "m", "q@b")]


def test_job_machine():
    s = O.fold_state([("claim", 0), ("fail", 1), ("claim", 2), ("claim", 7), ("fail", 8), ("claim", 20), ("fail", 21)])
    assert (s["status"], s["attempts"]) == ("failed", 3)
    s = O.fold_state([("claim", 0), ("timeout", 100), ("timeout", 1000), ("claim", 1001), ("complete", 1002), ("fail", 1003)])
    assert (s["status"], s["attempts"]) == ("completed", 2)


def test_overlap(spark):
    rows = [(1, "r", "2026-01-01 09:00", "2026-01-01 10:00"), (2, "r", "2026-01-01 10:00", "2026-01-01 11:00"), (3, "r", "2026-01-01 22:00", "2026-01-03 01:00")]
    e = spark.createDataFrame(rows, "event_id int, room string, f string, l string").select("event_id", "room", F.col("f").cast("timestamp_ntz").alias("first"), F.col("l").cast("timestamp_ntz").alias("last"))
    slots = spark.createDataFrame([(1, "r", "2026-01-01 09:30", "2026-01-01 10:00"), (2, "r", "2026-01-01 08:00", "2026-01-04 00:00"), (3, "q", "2026-01-01 09:30", "2026-01-01 10:00")], "slot_id int, room string, f string, l string").select("slot_id", "room", F.col("f").cast("timestamp_ntz").alias("first"), F.col("l").cast("timestamp_ntz").alias("last"))
    assert sorted((x["slot_id"], x["event_id"]) for x in O.conflicts(slots, e, "room").collect()) == [(1, 1), (2, 1), (2, 2), (2, 3)]
    assert {x["slot_id"]: x["event_id"] for x in O.first_conflict(slots, e, "room").collect()} == {1: 1, 2: 1, 3: None}


def test_parsed_event(spark):
    kind = "id string, subject string, start struct<dateTime:string>, end struct<dateTime:string>, organizer struct<emailAddress:struct<address:string,name:string>>, attendees array<struct<emailAddress:struct<address:string,name:string>,type:string>>"
    row = ("e1", "[BOT] Weekly", ("2026-06-10T10:00:00.000",), ("2026-06-10T11:00:00.000",), (("Me@X.org", "Me"),), [(("room@x.org", "R"), "resource"), (("You@x.org", "You"), "required"), (("me@x.org", "Me"), "required")])
    got = spark.createDataFrame([row], kind).select(O.parsed_event(F.struct("*"), ["room@x.org"]).alias("x")).collect()[0]["x"]
    assert (got["subject"], got["first"], got["people"]) == ("Weekly", "2026-06-10T10:00:00", ["me@x.org", "you@x.org"])


def test_people(spark):
    users = spark.createDataFrame([("U1", "Kim Min", "kim@x"), ("U2", "Lee Min", "lee@x")], "user_id string, user_name string, email string")
    names = spark.createDataFrame([("U1",), ("LEE@x",), ("Kim",), ("Min",)], "name string")
    assert {x["name"]: x["email"] for x in O.resolved_people(names, users).collect()} == {"U1": "kim@x", "LEE@x": "lee@x", "Kim": "kim@x", "Min": None}
    assert [x["user_name"] for x in O.tiered_match(users, "user_name", "Kim Min").collect()] == ["Kim Min"]
    assert O.tiered_match(users, "user_name", "XXin").count() == 2


def test_chunking():
    assert K.pack_paragraphs("a\n\nb", 10) == ["a\n\nb"]
    assert K.pack_paragraphs("aaaa\n\nbbbb\n\ncc", 6, 2) == ["aaaa", "bbbb", "cc"]
    assert K.pack_paragraphs("x" * 10, 6, 2) == ["x" * 6, "x" * 6, "xx"]
    text = "word " * 500
    assert all(len(p) <= 700 for p in K.split_by_policy(text, 450, 700))
    assert "".join(K.split_by_policy(text, 450, 700)).replace(" ", "") == text.replace(" ", "")
    table = "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 100
    assert K.split_by_policy(f"x\n\n{table}\ny", 100, 150)[1] == table.strip()
    assert K.injected("see a.pdf and b.pdf", [("a.pdf", "[A]"), ("b.pdf", "[B]")]) == ("see a.pdf [A] and b.pdf [B]", 2)


def test_evaluation(spark):
    df = spark.createDataFrame([(0.9, 0.6), (0.8, None), (None, None)], "a double, b double").select(E.judged([F.col("a"), F.col("b")]).alias("j"))
    assert [(x["j"]["score"], x["j"]["passed"]) for x in df.collect()] == [(0.75, False), (0.8, True), (None, None)]
    rows = spark.createDataFrame([("c", "l", None, True)], "case string, layer string, score double, passed boolean")
    assert E.verdicts(rows, "case").collect()[0]["passed"] is False and E.rollup(rows).count() == 0 and E.rollup(rows, True).count() == 1


def test_attendance(spark):
    kind = "record_id string, uid string, name string, role string, pos int, days array<struct<date:string,items:array<struct<type:string,duration_minutes:int>>>>"
    rows = [("7", "", "", "dev", 1, [("d1", [("work", 60)])]), ("7", "", "Kim", "", 2, [("d1", [("work", 60), ("leave", 30)])])]
    got = feeds.merged_members(spark.createDataFrame(rows, kind)).collect()[0]
    assert (got["member"], got["name"], got["role"], got["days"][0]["summary"]["total_minutes"]) == ("id:7", "Kim", "dev", 90)


def test_topic_and_quality(spark):
    m = spark.createDataFrame([("s", 1, "user", "alpha beta gamma"), ("s", 2, "user", "alpha beta gamma delta"), ("s", 3, "user", "omega psi")], "conv_id string, turn int, role string, text string")
    assert [x["topic_change"] for x in C.topic_changes(m).orderBy("turn").collect()] == [False, False, True]
    assert [x["n_similar"] for x in C.repeated_questions(m).orderBy("turn").collect()] == [0, 1, 0]
