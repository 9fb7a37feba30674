"""Layered evaluation, rollups and latency reports. Scores of language-model judges are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Service levels and thresholds.
MAX_SECONDS, MAX_TOKENS, JUDGE = 30.0, 50_000, 0.70
ALIASES = {"wiki": ["wiki", "rag", "docs"], "schedule": ["schedule", "calendar", "attendance"], "notice": ["notice", "gov", "project"]}


def same_intent(expected: Column, found: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """A blank expectation passes; otherwise both map to the same alias set or are equal."""
    table = [(a, k) for k, names in (aliases or ALIASES).items() for a in names]
    kinds = F.map_from_arrays(F.array(*[F.lit(a) for a, _ in table]), F.array(*[F.lit(k) for _, k in table]))
    name = lambda c: F.coalesce(F.try_element_at(kinds, F.lower(F.trim(c))), F.lower(F.trim(c)))
    return F.coalesce(F.trim(expected) == "", F.lit(True)) | (name(expected) == name(found))


def ops_layer(seconds: Column, tokens: Column) -> Column:
    """Within both levels: 1, else 0.5; no tokens is fine."""
    return F.when((seconds <= MAX_SECONDS) & (tokens <= MAX_TOKENS), 1.0).otherwise(0.5)


def hint_score(answer: Column, hints: Column) -> Column:
    """1 - failed / all of the hints that an answer must contain (4 digits); 1 without hints."""
    wanted = F.filter(F.split(F.coalesce(hints, F.lit("")), r"\s*,\s*"), lambda h: h != "")
    failed = F.size(F.filter(wanted, lambda h: ~F.contains(F.lower(answer), F.lower(h))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.round(1 - failed / F.size(wanted), 4))


def judged(scores: list[Column], threshold: float = JUDGE) -> Column:
    """struct(score, passed): the mean of the scores that are there; every one of them reaches the threshold."""
    found = F.array_compact(F.array(*scores))
    mean = F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(found), F.lit(0))
    return F.struct(mean.alias("score"), F.when(F.size(found) > 0, F.forall(found, lambda x: x >= threshold)).alias("passed"))


def layers(cases: DataFrame, key: str, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row a case and layer: (layer, score, passed); a null score means that the layer was skipped."""
    rows = F.array(*[F.struct(F.lit(n).alias("layer"), s.cast("double").alias("score"), p.cast("boolean").alias("passed")) for n, (s, p) in parts.items()])
    return cases.select(key, F.inline(rows))


def rollup(rows: DataFrame, include_unscored: bool = False) -> DataFrame:
    """Per layer: n, n_passed, pass_rate (4 digits), mean score; layers without any score are left out unless asked for."""
    out = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.count_if("passed") / F.count(F.lit(1)), 4).alias("pass_rate"), F.round(F.avg("score"), 4).alias("mean_score"), F.count("score").alias("_s"))
    return (out if include_unscored else out.where("_s > 0")).drop("_s")


def verdicts(rows: DataFrame, key: str) -> DataFrame:
    """A case passes if all layers that weren't skipped pass; with every layer skipped it fails."""
    counted = F.col("score").isNotNull()
    return rows.groupBy(key).agg(F.coalesce(F.bool_and(F.when(counted, F.col("passed"))), F.lit(False)).alias("passed"), F.count_if(counted).alias("n_layers"))


def run_summary(verdict: DataFrame) -> DataFrame:
    return verdict.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.coalesce(F.count_if("passed") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 4).alias("pass_rate"))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, p50, p95, max, mean and total (3 digits), with linear interpolation between ranks."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 3)
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), r(F.min(v)).alias("min"), r(F.percentile(v, F.lit(0.5))).alias("p50"), r(F.percentile(v, F.lit(0.95))).alias("p95"), r(F.max(v)).alias("max"), r(F.avg(v)).alias("mean"), r(F.sum(v)).alias("total"))


#: Size of a quantile sketch; its ranks are off by less than SKETCH_ERROR (of all values), with 99 % confidence.
SKETCH_K, SKETCH_ERROR = 800, 0.005


def latency_sketches(rows: DataFrame, value: str, day: Column, *keys: str, k: int = SKETCH_K) -> DataFrame:
    """For each day and key: n, least, most, total and a quantile sketch; what is kept of a day's values, whatever their number.

    Null values don't count; a key without any has no row.
    """
    v = F.col(value).cast("double")
    found = rows.where(v.isNotNull()).groupBy(day.alias("day"), *keys)
    return found.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged_latency(sketches: DataFrame, *keys: str, k: int = SKETCH_K) -> DataFrame:
    """n, min, p50, p95, max, mean and total (3 digits) over days, from their sketches: p50 and p95 within ``SKETCH_ERROR``, the others exact."""
    r = lambda c: F.round(c, 3)
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("min"), F.max("most").alias("max"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    at = lambda q: r(F.kll_sketch_get_quantile_double("_s", F.lit(q)))
    return merged.select(*keys, "n", r("min").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), r("max").alias("max"), r(F.col("total") / F.col("n")).alias("mean"), r("total").alias("total"))


def strategy_report(jobs: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Per strategy: jobs, errors, inference p50/p95 without errors, p50 of waits above zero, jobs per second of the wall time."""
    fine = F.col("error").isNull() | (F.col("error") == "")
    return jobs.groupBy(strategy).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_if(~fine).alias("n_errors"),
        F.round(F.percentile(F.when(fine, F.col("inference_sec")), F.lit(0.5)), 3).alias("p50"),
        F.round(F.percentile(F.when(fine, F.col("inference_sec")), F.lit(0.95)), 3).alias("p95"),
        F.round(F.percentile(F.when(F.col("wait_sec") > 0, F.col("wait_sec")), F.lit(0.5)), 3).alias("wait_p50"),
        F.round(F.count(F.lit(1)) / F.max("wall_sec"), 3).alias("per_second"),
    )


def token_totals(usage: Column) -> Column:
    """struct of summed prompt, completion and total tokens of an array of usage structs; missing counts are 0."""
    add = lambda f: F.aggregate(usage, F.lit(0).cast("long"), lambda a, u: a + F.coalesce(u[f].cast("long"), F.lit(0).cast("long")))
    return F.struct(*[add(f).alias(f) for f in ("prompt_tokens", "completion_tokens", "total_tokens")])


def best_run(found: DataFrame, run: str = "run", session: str = "session_id") -> DataFrame:
    """The run with the most matching sessions; of equal ones the newest."""
    per = found.groupBy(run).agg(F.countDistinct(session).alias("n"))
    return per.orderBy(F.desc("n"), F.desc(run)).limit(1)


def last_of_phase(rows: DataFrame, phase: str, session: str = "session_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """The last row of a phase of each session."""
    return rows.where(F.col("phase") == phase).groupBy(session).agg(F.max_by(value, pos).alias(value))
