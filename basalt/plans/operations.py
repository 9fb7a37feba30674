"""Job-queue and calendar queries over events and orders.

An event is a job (status by id), a calendar entry (room = user_id % 3, from ts for ``value`` minutes) or a notification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import merge as M
from ..operators import operations as O
from .registry import query, table

AS_OF = "2024-01-20 12:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), F.col("ts").alias("next_run_at"), F.col("ts").alias("locked_at"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("error_code"))


_JOBS = "j AS (SELECT event_id AS id, event_type AS source, ['queued','processing','completed','failed'][(event_id % 4 + 1)::INT] AS status, (event_id % 3)::INT AS attempt_count, 3 AS max_attempts, ts AS next_run_at, ts AS locked_at, ts AS created_at FROM events)"


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 3).alias("room"), F.col("ts").alias("first"), (F.col("ts") + F.make_interval(mins=F.floor(F.col("value")).cast("int"))).alias("last"), "user_id", "event_type")


_BOOKINGS = "b AS (SELECT event_id, user_id % 3 AS room, ts AS first, ts + to_minutes(floor(value)::INT) AS last, user_id, event_type FROM events)"


@query("""SELECT event_type, user_id, min(event_id) AS event_id, count(*) AS n_seen FROM events WHERE event_id >= 500 AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_id < 500 AND t.event_type = events.event_type AND t.user_id = events.user_id) GROUP BY event_type, user_id""")
def q_enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    marked = M.insert_if_absent(e.where("event_id < 500"), e.where("event_id >= 500"), ["event_type", "user_id"], F.asc("event_id"))
    new = marked.where("created").select("event_type", "user_id", "event_id")
    seen = e.where("event_id >= 500").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n_seen"))
    return new.join(seen, ["event_type", "user_id"])


@query(f"""WITH {_JOBS} SELECT id, row_number() OVER (ORDER BY next_run_at, id)::INT AS worker, attempt_count + 1 AS attempt_count FROM j WHERE status = 'queued' AND next_run_at <= {_NOW} ORDER BY next_run_at, id LIMIT 4""")
def q_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.claim(jobs(spark, sf_dir), 4, _now()).select("id", "worker", "attempt_count")


@query(f"""WITH {_JOBS} SELECT id, CASE WHEN attempt_count < max_attempts THEN 'queued' ELSE 'failed' END AS status, least(300, greatest(5, 5 * pow(2, greatest(0, attempt_count - 1))))::INT AS delay FROM j WHERE status = 'processing'""")
def q_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.failed(jobs(spark, sf_dir).where("status = 'processing'"), _now())
    return rows.select("id", "status", D.backoff_seconds(F.col("attempt_count")).alias("delay"))


@query(f"""WITH {_JOBS} SELECT id, CASE WHEN status = 'processing' AND locked_at < {_NOW} - INTERVAL 900 SECOND THEN 'queued' ELSE status END AS status, CASE WHEN status = 'processing' AND locked_at < {_NOW} - INTERVAL 900 SECOND THEN 'stale_lock' END AS error_code FROM j""")
def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reclaim_stale(jobs(spark, sf_dir), _now()).select("id", "status", "error_code")


@query(f"""WITH {_JOBS} SELECT status, count(*) AS n FROM j WHERE NOT (status = 'completed' AND created_at < {_NOW} - INTERVAL 3 DAY) AND NOT (status = 'failed' AND created_at < {_NOW} - INTERVAL 7 DAY) GROUP BY status""")
def q_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.purge(jobs(spark, sf_dir), {"completed": 3, "failed": 7, "queued": -1}, AS_OF).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, ['claim', 'fail', 'complete', 'timeout'][event_id % 4 + 1] AS name, floor(epoch(ts))::DOUBLE AS t FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, name) AS i FROM e),
f AS (SELECT DISTINCT job_id, 0::BIGINT AS i, 'queued' AS status, 0 AS attempts, 0.0::DOUBLE AS next_run, NULL::DOUBLE AS locked FROM e UNION ALL
SELECT job_id, i, CASE act WHEN 'claim' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'last' THEN 'failed' WHEN 'again' THEN 'queued' WHEN 'timeout' THEN 'queued' ELSE status END, attempts + (act = 'claim')::INT,
CASE WHEN act = 'again' THEN t + least(300, greatest(5, 5 * pow(2, attempts - 1))) ELSE next_run END, CASE act WHEN 'claim' THEN t WHEN '' THEN locked END FROM (
SELECT r.job_id, r.i, r.t, f.status, f.attempts, f.next_run, f.locked, CASE WHEN name = 'claim' AND status = 'queued' AND t >= next_run THEN 'claim' WHEN name = 'complete' AND status = 'processing' THEN 'complete'
WHEN name = 'fail' AND status = 'processing' AND attempts >= 3 THEN 'last' WHEN name = 'fail' AND status = 'processing' THEN 'again' WHEN name = 'timeout' AND status = 'processing' AND t - locked > 900 THEN 'timeout' ELSE '' END AS act FROM f JOIN r ON r.job_id = f.job_id AND r.i = f.i + 1))
SELECT job_id, status, attempts, next_run FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1""")
def q_job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("claim", "fail", "complete", "timeout"))), (F.col("event_id") % 4 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), name.alias("name"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return O.job_states(events)


@query("""WITH g AS (SELECT user_id, event_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n, arg_max(event_type, ts) AS event_type FROM i GROUP BY user_id, k""")
def q_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.debounced(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600, ("event_type",))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'S' AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, t.o_orderkey AS tk, s.o_orderkey AS sk, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS p, coalesce(t.o_orderstatus, s.o_orderstatus) AS st FROM t FULL OUTER JOIN s ON t.o_orderkey = s.o_orderkey)
SELECT o_orderkey, round(p, 2) AS o_totalprice, st AS o_orderstatus, CASE WHEN sk IS NOT NULL AND sk % 7 = 0 THEN CASE WHEN tk IS NOT NULL THEN 'delete' ELSE 'ignore' END WHEN sk IS NOT NULL AND tk IS NOT NULL THEN 'update' WHEN sk IS NOT NULL THEN 'insert' ELSE 'delete' END AS action FROM j
WHERE NOT (sk IS NOT NULL AND sk % 7 = 0 AND tk IS NULL)""")
def q_projection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    source = orders.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderstatus", F.lit("S"))
    merged = M.merge(orders.where("o_orderkey % 3 <> 0"), source, ["o_orderkey"], keep=["o_orderstatus"], valid=F.col("o_orderkey") % 7 != 0)
    return merged.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderstatus", "action")


@query(f"""WITH {_BOOKINGS} SELECT a.event_id AS slot_id, x.event_id AS event_id, a.room FROM b a JOIN b x ON a.room = x.room AND a.first < x.last AND a.last > x.first AND a.last > a.first AND x.last > x.first WHERE x.event_id <> a.event_id""")
def q_overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bookings(spark, sf_dir)
    slots = b.withColumnRenamed("event_id", "slot_id")
    return O.conflicts(slots, b, "room").where("slot_id <> event_id").select("slot_id", "event_id", "room")


@query(f"""WITH {_BOOKINGS}, s AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-10 09:00:00', TIMESTAMP '2024-01-10 09:05:00'), (1, TIMESTAMP '2024-01-10 10:00:00', TIMESTAMP '2024-01-10 10:30:00'), (2, TIMESTAMP '2024-01-11 23:50:00', TIMESTAMP '2024-01-12 00:20:00')) AS v(slot_no, sf, sl)),
g AS (SELECT DISTINCT room, slot_no, sf, sl FROM b, s)
SELECT g.room, g.slot_no, arg_min(b.event_id, {{'f': b.first, 'e': b.event_id}}) AS event_id, count(b.event_id) = 0 AS free FROM g LEFT JOIN b ON g.room = b.room AND sf < b.last AND sl > b.first AND b.last > b.first GROUP BY g.room, g.slot_no""")
def q_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bookings(spark, sf_dir)
    times = [(0, "2024-01-10 09:00:00", "2024-01-10 09:05:00"), (1, "2024-01-10 10:00:00", "2024-01-10 10:30:00"), (2, "2024-01-11 23:50:00", "2024-01-12 00:20:00")]
    return O.availability(b.select("room").distinct(), times, b)


_PEOPLE = "e AS (SELECT event_id, ts AS first, 'u' || (user_id % 50) || '@x.org' AS organizer_email, 'User ' || (user_id % 50) AS organizer_name, ['u' || ((user_id + 1) % 50) || '@x.org', 'U' || ((user_id + 2) % 50) || '@x.org'] AS attendees FROM events)"


def people_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = lambda n, p="u": F.concat(F.lit(p), ((F.col("user_id") + n) % 50).cast("string"), F.lit("@x.org"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("first"), mail(0).alias("organizer_email"), F.concat(F.lit("User "), (F.col("user_id") % 50).cast("string")).alias("organizer_name"), F.array(mail(1), mail(2, "U")).alias("attendees"))


@query(f"""WITH {_PEOPLE}, h AS (SELECT *, organizer_email = 'u7@x.org' AS ow, list_contains(list_transform(attendees, lambda a: lower(a)), 'u7@x.org') AS att, contains(lower(organizer_name), 'user 9') AS nm FROM e)
SELECT event_id, first, CASE WHEN ow THEN 'owned' WHEN att THEN 'attended' ELSE 'owned' END AS role FROM h WHERE ow OR att OR nm ORDER BY first, event_id LIMIT 40""")
def q_person_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.person_events(people_events(spark, sf_dir), ["u7@x.org"], ["User 9"]).select("event_id", "first", "role")


@query(f"""WITH {_PEOPLE}, f AS (SELECT * FROM e WHERE organizer_email <> 'u7@x.org' ORDER BY first, event_id LIMIT 90) SELECT event_id, first FROM f WHERE list_contains(list_transform(attendees, lambda a: lower(a)), 'u7@x.org') ORDER BY first, event_id LIMIT 30""")
def q_attended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.attended_events(people_events(spark, sf_dir), "u7@x.org", 30).select("event_id", "first")


@query("""SELECT event_id, ts AS first FROM events WHERE user_id % 50 = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 30""")
def q_owned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("user_id") % 50 == 7) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return e.orderBy("ts", "event_id").limit(30).select("event_id", F.col("ts").alias("first"))


@query(f"""SELECT event_id, ts AS first FROM events WHERE ts > {_NOW} AND {_NOW} >= ts - to_minutes((event_id % 600)::INT) AND event_id % 600 > 0""")
def q_reminders_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("first"), (F.col("event_id") % 600).cast("int").alias("minutes"))
    return O.reminders_due(rows, _now()).select("event_id", "first")


@query("""WITH o AS (SELECT DISTINCT o_orderpriority AS dataset, o_orderdate::DATE AS d FROM orders), r AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY d DESC) AS k FROM o)
SELECT dataset, strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM orders JOIN r ON dataset = o_orderpriority AND d = o_orderdate::DATE WHERE k > 100 GROUP BY dataset, d""")
def q_top_n_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").cast("date").alias("day"))
    return M.keep_newest_dates(rows, 100, "dataset", "day").groupBy("dataset", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS monday, strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday, strftime(date_trunc('week', ts) + INTERVAL 7 DAY, '%Y-%m-%d') AS next_monday FROM events""")
def q_week_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.week_bounds(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", w["first"].cast("string").alias("monday"), w["last"].cast("string").alias("sunday"), D.week_start(F.col("ts"), 1).cast("string").alias("next_monday"))


@query("""WITH m AS (SELECT event_id, (event_id * 7 % 1440)::INT AS n FROM events) SELECT event_id, printf('%02d:%02d', n // 60, n % 60) AS clock, n AS minutes, CASE WHEN n % 60 = 0 THEN printf('%dh', n // 60) WHEN n // 60 = 0 THEN printf('%dm', n % 60) ELSE printf('%dh %dm', n // 60, n % 60) END AS duration FROM m""")
def q_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 1440).cast("int").alias("n"))
    rows = rows.withColumn("clock", D.clock_of(F.col("n"))).withColumn("duration", D.duration_text(F.col("n")))
    return rows.select("event_id", "clock", D.minutes_of(F.col("clock")).alias("minutes"), "duration")


@query("""WITH m AS (SELECT event_id, (event_id * 7 % 1440)::INT AS n FROM events) SELECT event_id, CASE WHEN n % 60 = 0 THEN n // 60 * 60 ELSE n END AS minutes FROM m""")
def q_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", D.duration_text((F.col("event_id") * 7 % 1440).cast("int")).alias("t"))
    return rows.select("event_id", D.duration_minutes(F.col("t")).alias("minutes"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m') AS next_month, strftime(o_orderdate, '%Y-%m-%d') AS dotted FROM orders""")
def q_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy.M.d")
    return o.select("o_orderkey", D.parsed_date(text, F.col("o_orderdate")).cast("string").alias("day"), D.shifted_month(F.date_format("o_orderdate", "yyyy-MM"), 1).alias("next_month"), D.dashed(F.date_format("o_orderdate", "yyyy/MM/dd HH")).alias("dotted"))


@query(f"""SELECT event_id, ts::DATE >= ({_NOW})::DATE - 7 AND ts::DATE < ({_NOW})::DATE + 31 AS inside FROM events""")
def q_retention_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.in_retention(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), _now()).alias("inside"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IN (1, 3, 5)""")
def q_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where(F.col("k").isin(1, 3, 5))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, strftime(min(ts), '%Y-%m') AS first_month FROM events WHERE event_type <> '' GROUP BY event_type""")
def q_partition_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> ''").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.date_format(F.min("ts"), "yyyy-MM").alias("first_month"))
