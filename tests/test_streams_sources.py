import json

from pyspark.sql import functions as F

from basalt.sources import readers as S
from basalt.sources import writers as W
from basalt.streaming import streams


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def event(**x):
    return {"source": "chat", "event_type": "message", "team": "T", "channel": "C", "ts": "2026-01-01T00:00:00Z", "text": "hi"} | x


def test_enqueue_is_idempotent(spark, tmp_path):
    put(tmp_path / "in/a.json", [event(event_id="1"), event(event_id="1"), event(event_id="2", thread="9")])
    table = str(tmp_path / "jobs")
    read = lambda: streams.read_json(spark, str(tmp_path / "in"))
    streams.drain(streams.enqueue(read(), table, str(tmp_path / "c1")))
    put(tmp_path / "in/b.json", [event(event_id="2"), event(event_id="3"), event(event_id=None, page="P", event_type="page_updated", version=4)])
    streams.drain(streams.enqueue(read(), table, str(tmp_path / "c1")))
    streams.drain(streams.enqueue(read(), table, str(tmp_path / "c1")))
    got = spark.read.parquet(table)
    assert sorted(r["source_event_id"] for r in got.collect()) == ["1", "2", "3", "P:page_updated:4"]
    assert {r["conversation_key"] for r in got.collect()} == {"T:C:-", "T:C:9"}


def test_admitted(spark):
    rows = [("a", None, None), ("", None, None), ("b", "file_share", None), ("c", "edited", None), ("d", None, "B1")]
    df = spark.createDataFrame(rows, "text string, subtype string, bot string")
    assert sorted(r["text"] for r in streams.admitted(df).collect()) == ["a", "b"]


def test_debounce_stream(spark, tmp_path):
    at = lambda s: f"2026-01-01T00:0{s // 60}:{s % 60:02d}Z"
    put(tmp_path / "in/a.json", [event(page="p", event_type=f"e{s}", ts=at(s)) for s in (0, 10, 40, 200)] + [event(page="q", event_type="late", ts="2026-01-01T01:00:00Z")])
    put(tmp_path / "in/b.json", [event(page="r", event_type="x", ts="2026-01-01T02:00:00Z")])
    out = streams.in_memory(streams.debounced(streams.read_json(spark, str(tmp_path / "in"), files=1)), "bursts")
    assert sorted((r["page"], r["n"], r["event_type"]) for r in out.collect() if r["page"] == "p") == [("p", 1, "e200"), ("p", 3, "e40")]


def test_job_stream(spark, tmp_path):
    put(tmp_path / "in/a.json", [{"job_id": 1, "name": n, "at": t} for n, t in (("claim", 0.0), ("fail", 1.0))])
    put(tmp_path / "in/b.json", [{"job_id": 1, "name": n, "at": t} for n, t in (("claim", 3.0), ("claim", 9.0), ("complete", 10.0))])
    stream = spark.readStream.schema("job_id long, name string, at double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = streams.in_memory(streams.job_states(stream), "job_changes").orderBy("at").collect()
    assert [(r["status"], r["attempts"]) for r in got] == [("processing", 1), ("queued", 1), ("processing", 2), ("completed", 2)]


def test_counted(spark, tmp_path):
    put(tmp_path / "in/a.json", [{"session": "s", "role": r} for r in ("user", "assistant", "user")])
    put(tmp_path / "in/b.json", [{"session": "s", "role": "user"} for _ in range(3)])
    stream = spark.readStream.schema("session string, role string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert sorted(r["turns"] for r in streams.in_memory(streams.counted(stream, 2), "counted").collect()) == [2, 4]


def test_json_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    path = str(tmp_path / "x.jsonl")
    assert sorted(r["a"] for r in S.json_lines(spark, path, "a int").collect()) == [1, 2]
    assert S.json_lines(spark, path, "a int", "report").cache().where("_corrupt_record is not null").count() == 1
    (tmp_path / "12345_p.json").write_text('{"id": "",\n "html": "<p>x</p>", "titles": ["t"]}')
    docs = S.json_documents(spark, str(tmp_path / "*_p.json"), "id string, html string, titles array<string>")
    assert S.page_index(docs, F.col("id"), F.col("html"), F.col("titles")).collect()[0]["page_id"] == "12345"
    assert S.json_documents(spark, str(tmp_path / "none/*.json"), "id string", "empty").count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\nhow || fact | wiki | cite\nwhy\n")
    assert sorted(map(tuple, S.questions(spark, str(tmp_path / "q.txt")).collect())) == [("how", "fact", "wiki", "cite"), ("why", "Unknown", "", "")]
    (tmp_path / "k.csv").write_bytes("이름,나이\n김,3\n".encode("cp949"))
    got = S.decoded_csv(spark, str(tmp_path / "k.csv")).orderBy("row_no").collect()
    assert got[0]["encoding"] == "euc-kr" and got[0]["cells"] == ["이름", "나이"]
    rows = spark.createDataFrame([("s", "/d/20260101T000000Z/l"), ("s", "/d/20260102T000000Z/l"), ("t", "/d/20260101T000000Z/l")], "session_id string, file string")
    assert sorted((r["session_id"], r["run"]) for r in S.newest_run(S.runs(rows)).collect()) == [("s", "20260102T000000Z"), ("t", "20260101T000000Z")]
    assert [r[0] for r in spark.createDataFrame([("a.PDF",), ("b.hwp",), ("c.zip",)], "n string").select(S.parser_of(F.col("n"))).collect()] == ["pdf", "hwp", None]


def test_tree_with_cycle(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "id int, parent_id int")
    assert sorted(map(tuple, S.tree(spark, nodes, 1).collect())) == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("g1", 1), ("g2", 2)], "g string, x int")
    W.replace_partitions(rows, str(tmp_path / "t"), "g")
    W.replace_partitions(spark.createDataFrame([("g1", 9)], "g string, x int"), str(tmp_path / "t"), "g")
    assert sorted((r["g"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("g1", 9), ("g2", 2)]
    chunks = spark.createDataFrame([("a", "parent"), ("b", "child")], "id string, chunk_type string")
    assert {r["chunk_type"]: r["n"] for r in W.index(chunks, str(tmp_path / "i"), chunks.where("id = 'a'")).collect()} == {"child": 1}
    assert W.csv_with_mark(rows.limit(0), str(tmp_path / "c")) is False and W.csv_with_mark(rows, str(tmp_path / "c"))
    W.report(rows, str(tmp_path / "r"), "Day", "g", "x")
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["# Day", "rows: 2", "g1", "g2"]
