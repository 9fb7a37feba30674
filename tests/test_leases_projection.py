"""Timed leases, changes by bucket, and keys without a horizon."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from basalt.streaming import admission, leases, projection, streams


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def at(seconds):
    return f"2026-01-01T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}Z"


START = 1_767_225_600_000


def changes(spark, tmp_path, name, files):
    for i, rows in enumerate(files):
        one = tmp_path / f"in/{name}{i}.json"
        put(one, [{"job_id": j, "name": n, "ts": at(s)} for j, n, s in rows])
        os.utime(one, (1_700_000_000 + 100 * ord(name) + i,) * 2)  # files come in the order of these times
    leases.with_timers(spark)
    stream = spark.readStream.schema("job_id long, name string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = leases.job_changes(stream).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(leases.CHANGE).json(str(tmp_path / "out")).collect()
    return sorted((r["job_id"], (r["at"] - START) // 1000, r["status"], r["attempts"], r["code"]) for r in got)


def test_a_lease_ends_without_an_event_of_its_own(spark, tmp_path):
    first = [[(1, "claim", 10), (2, "claim", 20)], [(2, "complete", 30), (1, "note", 31)], [(9, "claim", 5000)]]
    got = changes(spark, tmp_path, "a", first)
    assert (1, 10, "processing", 1, None) in got and (2, 30, "completed", 1, None) in got
    assert (1, 910, "queued", 1, "stale_lock") in got  # 900 s after the claim; job 9 only moves time on
    # The stream goes on from its checkpoint: the job is claimed again, and its second lease ends too.
    got = changes(spark, tmp_path, "b", [[(1, "claim", 6000)], [(9, "complete", 9000)], [(8, "claim", 20_000)]])
    assert [x for x in got if x[0] == 1] == [(1, 10, "processing", 1, None), (1, 910, "queued", 1, "stale_lock"), (1, 6000, "processing", 2, None), (1, 6900, "queued", 2, "stale_lock")]
    assert (9, 5900, "queued", 1, "stale_lock") in got and not any(x[0] == 9 and x[2] == "completed" for x in got)


def test_events_out_of_order(spark, tmp_path):
    got = changes(spark, tmp_path, "a", [[(1, "complete", 50), (1, "claim", 45)], [(1, "fail", 12), (1, "claim", 10)], [(2, "claim", 4000)]])
    assert [x for x in got if x[0] == 1] == [(1, 10, "processing", 1, None), (1, 12, "queued", 1, None), (1, 45, "processing", 2, None), (1, 50, "completed", 2, None)]


def test_states_of_a_table(spark):
    r = random.Random(2)
    events = [(r.randrange(30), r.choice(["claim", "fail", "complete", "claim", "x"]), r.randrange(10_000) * 1000) for _ in range(900)]
    want = {}
    for j in {e[0] for e in events}:
        job, stale = leases.Job(), 0
        for _, name, t in sorted((e for e in events if e[0] == j), key=lambda e: (e[2], e[1])):
            if job.status == "processing" and t - job.locked > 900_000:
                job.status, stale = "queued", stale + 1
            list(job.apply(name, t, 3))
        if job.status == "processing" and 10_500_000 - job.locked > 900_000:
            job.status, stale = "queued", stale + 1
        want[j] = (job.status, job.attempts, job.next_run, stale)
    rows = spark.createDataFrame(events + [(None, "claim", 1), (99, None, 1), (98, "claim", 99_000_000)], "job_id long, name string, at long").repartition(3)
    assert {x["job_id"]: (x["status"], x["attempts"], x["next_run"], x["n_stale"]) for x in leases.leased_states(rows, 10_500_000).collect()} == want
    assert leases.leased_states(rows.limit(0), 1).count() == 0


SCHEMA = "event_id string, subject string, deleted boolean, changed_at long"


def size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    path, n = str(tmp_path / "t"), 20_000
    base = spark.range(n).select(F.col("id").cast("string").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("subject"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("changed_at"))
    assert projection.apply(base, path, 0, "event_id", "changed_at", buckets=100) == 100
    some = base.where(projection.bucket("event_id", 100) == 42).withColumn("subject", F.lit("new")).withColumn("changed_at", F.lit(2).cast("long"))
    assert projection.apply(some, path, 1, "event_id", "changed_at", buckets=100) == 1
    whole = size(tmp_path / "t/data/version=0")
    assert 0 < size(tmp_path / "t/data/version=2") < 0.02 * whole
    assert projection.read(spark, path).count() == n and projection.read(spark, path).where("subject = 'new'").count() == some.count() > 100
    # Once more: nothing changes.
    before = projection.manifest(spark, path, 2)
    projection.apply(some, path, 1, "event_id", "changed_at", buckets=100)
    assert projection.manifest(spark, path, 2) == before and projection.read(spark, path).where("subject = 'new'").count() == some.count()
    assert projection.read(spark, path, before=1).where("subject = 'new'").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_changes_in_any_order(spark, tmp_path, seed):
    """Later changes win, whatever batch they come in; deletions hold against older changes."""
    r, path = random.Random(seed), str(tmp_path / "t")
    rows = [(str(r.randrange(40)), f"s{k}", r.random() < 0.3, k) for k in range(300)]
    r.shuffle(rows)
    for number in range(6):
        batch = spark.createDataFrame(rows[number * 50 : number * 50 + 50], SCHEMA)
        projection.apply(batch, path, number, "event_id", "changed_at", buckets=7)
        if number == 3:
            projection.apply(batch, path, number, "event_id", "changed_at", buckets=7)
            projection.vacuum(spark, path)
    last = {}
    for key, subject, deleted, k in sorted(rows, key=lambda x: x[3]):
        last[key] = None if deleted else (key, subject, k)
    want = sorted(x for x in last.values() if x)
    assert sorted(map(tuple, projection.read(spark, path).collect())) == want
    assert projection.compact(spark, path, "event_id", "changed_at", 10**6, buckets=7) > 0
    assert projection.compact(spark, path, "event_id", "changed_at", 10**6, buckets=7) == 0
    assert sorted(map(tuple, projection.read(spark, path).collect())) == want
    assert projection.vacuum(spark, path, 1) > 0
    assert sorted(map(tuple, projection.read(spark, path).collect())) == want
    projection.apply(spark.createDataFrame([("0", "end", False, 999), (None, "x", None, 1), ("new", "y", None, 1)], SCHEMA), path, 6, "event_id", "changed_at", buckets=7)
    got = {x["event_id"]: x["subject"] for x in projection.read(spark, path).collect()}
    assert got["0"] == "end" and got["new"] == "y" and len(got) == len({w[0] for w in want} | {"0", "new"})


def test_projection_stream(spark, tmp_path):
    put(tmp_path / "in/a.json", [{"event_id": "1", "subject": "a", "deleted": False, "changed_at": 1}, {"event_id": "2", "subject": "b", "deleted": False, "changed_at": 1}, {"event_id": "1", "subject": "c", "deleted": False, "changed_at": 2}])
    read = lambda: spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    table, wrote = str(tmp_path / "t"), []
    streams.drain(projection.project(read(), table, str(tmp_path / "c"), then=lambda n, k: wrote.append((n, k))))
    put(tmp_path / "in/b.json", [{"event_id": "2", "subject": "", "deleted": True, "changed_at": 3}, {"event_id": "3", "subject": "d", "deleted": False, "changed_at": 3}])
    streams.drain(projection.project(read(), table, str(tmp_path / "c"), then=lambda n, k: wrote.append((n, k))))
    assert sorted((r["event_id"], r["subject"]) for r in projection.read(spark, table).collect()) == [("1", "c"), ("3", "d")]
    assert [n for n, _ in wrote] == [0, 1] and all(1 <= k <= 3 for _, k in wrote)
    assert projection.read(spark, str(tmp_path / "none")) is None


def test_no_key_is_admitted_twice(spark, tmp_path):
    path, r, seen, admitted = str(tmp_path / "jobs"), random.Random(5), [], []
    for number in range(5):
        ids = [f"e{r.randrange(400)}" for _ in range(120)]
        batch = spark.createDataFrame([("chat", i, k) for k, i in enumerate(ids)] + [(None, "x", 0), ("chat", None, 0)], "source string, source_event_id string, ts long")
        for _ in range(2 if number == 3 else 1):  # a batch that runs again admits the same rows
            got = admission.admit(batch, path, number, buckets=16, bits=1 << 12, seen=seen.append).collect()
        assert all(x["ts"] == ids.index(x["source_event_id"]) for x in got)
        admitted += [(number, x["source_event_id"]) for x in got]
        assert {x["source_event_id"] for x in got} == set(ids) - {i for n, i in admitted if n < number}
    assert len({i for _, i in admitted}) == len(admitted)


def test_new_keys_read_no_key_files(spark, tmp_path):
    path, seen = str(tmp_path / "jobs"), []
    frame = lambda ids: spark.createDataFrame([("chat", i, 0) for i in ids], "source string, source_event_id string, ts long")
    admission.admit(frame([f"a{k}" for k in range(3000)]), path, 0, buckets=32, bits=1 << 16, seen=seen.append).count()
    assert admission.admit(frame([f"b{k}" for k in range(20)]), path, 1, buckets=32, bits=1 << 16, seen=seen.append).count() == 20
    assert admission.admit(frame(["a7", "b3", "c1"]), path, 2, buckets=32, bits=1 << 16, seen=seen.append).count() == 1
    assert seen[1]["read"] <= 1 and seen[2]["maybe"] == 2 and seen[2]["read"] <= 2 and seen[2]["buckets"] <= 3


def test_jobs_without_a_handler(spark, tmp_path):
    put(tmp_path / "in/a.json", [{"source": "chat", "event_type": "message"}, {"source": "wiki", "event_type": "page"}])
    read = lambda: spark.readStream.schema("source string, event_type string").json(str(tmp_path / "in"))
    got = []
    take = lambda name: lambda rows: got.extend((name, x["source"]) for x in rows.collect())
    query = streams.dispatched(read(), {("chat", "message"): take("h")}, str(tmp_path / "c1"), others=take("o"))
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [("h", "chat"), ("o", "wiki")]
    query = streams.dispatched(read(), {("chat", "message"): take("h")}, str(tmp_path / "c2"))
    with pytest.raises(Exception, match="no handler"):
        query.processAllAvailable()
