"""Queries over changing tables: timed leases, changes by key, admission, similar texts, feeds without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, setjoin
from ..storage import shared_dir
from ..streaming import admission, leases, projection
from .registry import query, table

LEASE_HOURS = 12
#: 2024-01-31 00:00 UTC.
AS_OF = 1_706_659_200_000
_LEASE = LEASE_HOURS * 3_600_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'claim' WHEN 'view' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'note' END AS name, epoch_us(ts) // 1000 AS t FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, name) AS i FROM e WHERE t <= {AS_OF}),
f AS (SELECT DISTINCT job_id, 0::BIGINT AS i, 'queued' AS status, 0 AS attempts, 0::BIGINT AS next_run, -1::BIGINT AS locked, 0::BIGINT AS n_stale FROM r UNION ALL
SELECT job_id, i, CASE act WHEN 'claim' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'last' THEN 'failed' WHEN 'again' THEN 'queued' ELSE status END, attempts + (act = 'claim')::INT,
CASE WHEN act = 'again' THEN t + 1000 * least(300, greatest(5, 5 * pow(2, attempts - 1)))::BIGINT ELSE next_run END, CASE act WHEN 'claim' THEN t WHEN '' THEN locked ELSE -1 END, n_stale FROM (
SELECT *, CASE WHEN name = 'claim' AND status = 'queued' AND t >= next_run THEN 'claim' WHEN name = 'complete' AND status = 'processing' THEN 'complete' WHEN name = 'fail' AND status = 'processing' AND attempts >= 3 THEN 'last' WHEN name = 'fail' AND status = 'processing' THEN 'again' ELSE '' END AS act FROM (
SELECT r.job_id, r.i, r.t, r.name, f.attempts, f.next_run, f.locked, CASE WHEN f.status = 'processing' AND r.t - f.locked > {_LEASE} THEN 'queued' ELSE f.status END AS status, f.n_stale + (f.status = 'processing' AND r.t - f.locked > {_LEASE})::INT AS n_stale FROM f JOIN r ON r.job_id = f.job_id AND r.i = f.i + 1)))
SELECT job_id, CASE WHEN status = 'processing' AND {AS_OF} - locked > {_LEASE} THEN 'queued' ELSE status END AS status, attempts, next_run, (n_stale + (status = 'processing' AND {AS_OF} - locked > {_LEASE})::INT)::BIGINT AS n_stale
FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1""")
def q_leased_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as those of jobs, whose leases end by time."""
    kind = F.col("event_type")
    name = F.when(kind.isin("click", "purchase"), "claim").when(kind == "view", "complete").when(kind == "error", "fail").otherwise("note")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), name.alias("name"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return leases.leased_states(events, AS_OF, _LEASE)


@query("""SELECT key, event_id, value FROM (SELECT user_id || '-' || event_type AS key, event_id, value FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1 AND value >= 5""")
def q_changes_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of (user, type): three batches out of order, the last one twice; low values delete."""
    changes = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "value", (F.col("value") < 5).alias("deleted"))
    path = shared_dir(spark, "projection")
    batches = [changes.where(F.col("event_id") % 3 == k) for k in (1, 0, 2)]
    projection.replayed(batches, path, "key", "event_id", buckets=32)
    projection.apply(batches[2], path, 2, "key", "event_id", buckets=32)
    projection.compact(spark, path, "key", "event_id", 1 << 40, buckets=32)
    return projection.read(spark, path)


@query("""SELECT source, source_event_id, event_id, event_id % 3 AS batch FROM (SELECT event_type AS source, user_id || '/' || hour(ts) AS source_event_id, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY source, source_event_id ORDER BY event_id % 3, event_id) = 1""")
def q_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs with a key of type, user and hour, in three batches: each key is admitted once."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.hour("ts").cast("string"))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), key.alias("source_event_id"), "event_id", (F.col("event_id") % 3).alias("batch"))
    path = shared_dir(spark, "admission")
    parts = [admission.admit(events.where(F.col("batch") == k), path, k, order="event_id", buckets=16, bits=1 << 16) for k in range(3)]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH d AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND len(a.t) >= 0.6::DOUBLE * len(b.t) AND len(b.t) >= 0.6::DOUBLE * len(a.t) WHERE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.6::DOUBLE)
SELECT doc_id, count(b)::BIGINT AS n_similar FROM d LEFT JOIN p ON a = doc_id WHERE len(t) > 0 GROUP BY doc_id""")
def q_similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of its language share more than 0.6 of all words with each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return setjoin.linked_rows(docs, "lang", "doc_id", T.terms(F.col("text")), 0.6, strict=True).select(F.col("key").alias("doc_id"), "n_similar")


@query("""WITH RECURSIVE p AS (SELECT page_id, lower(left(regexp_extract(html, '<title>([^<]*)', 1), 3)) AS a, regexp_extract(url, '://([^/]+)', 1) AS b, row_number() OVER (ORDER BY page_id) AS i FROM pages),
g(i, x, y, kept) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[] UNION ALL SELECT i, CASE WHEN ok THEN list_append(x, a) ELSE x END, CASE WHEN ok THEN list_append(y, b) ELSE y END, CASE WHEN ok THEN list_append(kept, page_id) ELSE kept END FROM (
SELECT p.i, a, b, page_id, x, y, kept, NOT (a <> '' AND list_contains(x, a)) AND NOT (b <> '' AND list_contains(y, b)) AS ok FROM g JOIN p ON p.i = g.i + 1))
SELECT unnest(kept) AS page_id FROM g WHERE i = (SELECT max(i) FROM g)""")
def q_feed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as one feed: a page goes if a kept one had the beginning of its title, or its host."""
    title = F.lower(F.left(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(3)))
    pages = table(spark, sf_dir, "pages").select(F.lit("news").alias("feed"), "page_id", title.alias("title"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return dedup.either_key(pages, "feed", "page_id", "title", "host").select("page_id")
