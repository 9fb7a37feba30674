"""Evaluation and latency queries over labels, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import query, table

_CASES = "c AS (SELECT doc_id, quality, toxic, (n_chars / 400.0)::DOUBLE AS seconds, (n_chars * 10)::BIGINT AS tokens, text, source FROM labels JOIN documents USING (doc_id))"
_LAYERS = f"""{_CASES}, l AS (
SELECT doc_id, 'routing' AS layer, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, quality = 1 AS passed FROM c
UNION ALL SELECT doc_id, 'citation', CASE WHEN doc_id % 2 = 0 THEN CASE WHEN contains(text, 'the') THEN 1.0 ELSE 0.0 END END::DOUBLE, doc_id % 2 = 1 OR contains(text, 'the') FROM c
UNION ALL SELECT doc_id, 'judge', NULL::DOUBLE, true FROM c
UNION ALL SELECT doc_id, 'ops', CASE WHEN seconds <= 30 AND tokens <= 50000 THEN 1.0 ELSE 0.5 END::DOUBLE, seconds <= 30 AND tokens <= 50000 FROM c)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.withColumn("seconds", F.col("n_chars") / 400.0).withColumn("tokens", F.col("n_chars") * 10)


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, cited = F.col("quality") == 1, F.contains("text", F.lit("the"))
    even = F.col("doc_id") % 2 == 0
    ops = E.ops_layer(F.col("seconds"), F.col("tokens"))
    return E.layers(cases(spark, sf_dir), "doc_id", {
        "routing": (F.when(fine, 1.0).otherwise(0.0), fine),
        "citation": (F.when(even, F.when(cited, 1.0).otherwise(0.0)), ~even | cited),
        "judge": (F.lit(None).cast("double"), F.lit(True)),
        "ops": (ops, ops == 1.0),
    })


@query(f"WITH {_LAYERS} SELECT * FROM l")
def q_eval_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer_rows(spark, sf_dir)


@query(f"WITH {_LAYERS} SELECT layer, count(*) AS n, count(*) FILTER (passed) AS n_passed, round((count(*) FILTER (passed))::DOUBLE / count(*), 4) AS pass_rate, round(avg(score), 4) AS mean_score FROM l GROUP BY layer HAVING count(score) > 0")
def q_eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rollup(layer_rows(spark, sf_dir))


@query(f"WITH {_LAYERS} SELECT doc_id, coalesce(bool_and(passed) FILTER (score IS NOT NULL), false) AS passed, count(score) AS n_layers FROM l GROUP BY doc_id")
def q_eval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdicts(layer_rows(spark, sf_dir), "doc_id")


@query(f"WITH {_LAYERS}, v AS (SELECT doc_id, coalesce(bool_and(passed) FILTER (score IS NOT NULL), false) AS passed FROM l GROUP BY doc_id) SELECT count(*) AS n, count(*) FILTER (passed) AS n_passed, round((count(*) FILTER (passed))::DOUBLE / count(*), 4) AS pass_rate FROM v")
def q_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_summary(E.verdicts(layer_rows(spark, sf_dir), "doc_id"))


@query("""SELECT event_type, count(value) AS n, round(min(value), 3) AS min, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max, round(avg(value), 3) AS mean, round(sum(value), 3) AS total FROM events GROUP BY event_type""")
def q_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency(table(spark, sf_dir, "events"), "value", "event_type")


@query("""SELECT event_type, count(value) AS n, round(min(value), 3) AS min, round(max(value), 3) AS max, round(avg(value), 3) AS mean, round(sum(value), 3) AS total, true AS p50_near, true AS p95_near FROM events GROUP BY event_type""")
def q_latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies kept by day as sketches and merged; whether their quantiles lie within the stated error is asked of all values."""
    e = table(spark, sf_dir, "events")
    merged = E.merged_latency(E.latency_sketches(e, "value", F.to_date("ts"), "event_type"), "event_type")
    of = e.select(F.col("event_type").alias("_t"), "value").join(merged, F.col("_t") == F.col("event_type"))
    near = lambda c, q: (F.avg((F.round("value", 3) < F.col(c)).cast("int")) <= q + E.SKETCH_ERROR) & (F.avg((F.round("value", 3) <= F.col(c)).cast("int")) >= q - E.SKETCH_ERROR)
    return of.groupBy("event_type", "n", "min", "max", "mean", "total").agg(near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))


@query("""WITH j AS (SELECT event_type AS strategy, value / 10 AS inference_sec, (event_id % 5) / 10.0::DOUBLE AS wait_sec, 60.0::DOUBLE AS wall_sec, CASE WHEN event_id % 9 = 0 THEN 'x' END AS error FROM events)
SELECT strategy, count(*) AS n_jobs, count(error) AS n_errors, round(quantile_cont(inference_sec, 0.5) FILTER (error IS NULL), 3) AS p50, round(quantile_cont(inference_sec, 0.95) FILTER (error IS NULL), 3) AS p95, round(quantile_cont(wait_sec, 0.5) FILTER (wait_sec > 0), 3) AS wait_p50, round(count(*) / max(wall_sec), 3) AS per_second FROM j GROUP BY strategy""")
def q_strategy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), (F.col("value") / 10).alias("inference_sec"), (F.col("event_id") % 5 / 10.0).alias("wait_sec"), F.lit(60.0).alias("wall_sec"), F.when(F.col("event_id") % 9 == 0, "x").alias("error"))
    return E.strategy_report(jobs)


@query("""WITH r AS (SELECT event_type AS run, count(DISTINCT user_id) AS n FROM events GROUP BY event_type) SELECT run, n FROM r ORDER BY n DESC, run DESC LIMIT 1""")
def q_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_run(table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("session_id")))


@query("""SELECT user_id AS session_id, arg_max(event_id, ts) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id""")
def q_last_of_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    phase = e.agg(F.min("event_type")).collect()[0][0]
    return E.last_of_phase(e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("phase"), F.col("ts").alias("pos"), F.col("event_id").alias("value")), phase)


@query("""WITH h AS (SELECT doc_id, text, 'the,zzz,of' AS hints FROM documents) SELECT doc_id, round(1 - ((NOT contains(lower(text), 'the'))::INT + (NOT contains(lower(text), 'zzz'))::INT + (NOT contains(lower(text), 'of'))::INT) / 3.0::DOUBLE, 4) AS score FROM h""")
def q_hint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.hint_score(F.col("text"), F.lit("the,zzz,of")).alias("score"))


@query("""SELECT doc_id, quality = 1 AS routed FROM labels""")
def q_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("quality") == 1, "RAG").otherwise("calendar")
    return table(spark, sf_dir, "labels").select("doc_id", E.same_intent(F.lit("wiki"), found).alias("routed"))
