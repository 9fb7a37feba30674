"""Conversation and answer-quality analytics: recent messages, turns, triggers, repeats, topics, memories, quality events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Thresholds of the triggers.
REPEAT_JACCARD, REPEAT_BACK, REPEAT_TIMES = 0.6, 9, 2
TOPIC_OVERLAP, TOPIC_LENGTH = 0.25, 4
SUMMARY_TURNS, SUMMARY_NEW, MEMORY_EVERY = 4, 10, 10
LOW_SCORE = 0.1


def recent(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn", after: str | None = None) -> DataFrame:
    """The last n messages of each session, strictly after an anchor column if one is given."""
    rows = messages.where(F.col(order) > F.col(after)) if after else messages
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def turn_counts(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    return messages.groupBy(session).agg(F.count_if(F.col("role") == "user").alias("n_turns"), F.count(F.lit(1)).alias("n_messages"))


def user_turns(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """User messages with their number in the session."""
    return messages.where("role = 'user'").withColumn("user_turn", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def repeated_questions(messages: DataFrame, threshold: float = REPEAT_JACCARD, back: int = REPEAT_BACK, times: int = REPEAT_TIMES, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user message with the number of similar ones among the ``back`` before it in its session; repeated from ``times`` on."""
    rows = user_turns(messages, session, order).select(session, order, "user_turn", F.array_distinct(T.terms(F.col("text"))).alias("tokens"))
    before = F.collect_list("tokens").over(Window.partitionBy(session).orderBy("user_turn").rowsBetween(-back, -1))
    out = rows.withColumn("_b", before).withColumn("n_similar", F.size(F.filter("_b", lambda p: T.jaccard(p, F.col("tokens")) > threshold)))
    return out.withColumn("repeated", F.col("n_similar") >= times).drop("_b", "tokens")


def topic_changes(messages: DataFrame, overlap: float = TOPIC_OVERLAP, least: int = TOPIC_LENGTH, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user message with topic_change: few of its tokens occur in the user message before it."""
    rows = user_turns(messages, session, order).withColumn("tokens", F.array_distinct(T.terms(F.col("text"))))
    previous = F.lag("tokens").over(Window.partitionBy(session).orderBy("user_turn"))
    rows = rows.withColumn("_p", previous).withColumn("_o", F.when((F.size("tokens") > 0) & F.col("_p").isNotNull(), F.size(F.array_intersect("tokens", "_p")) / F.size("tokens")).otherwise(0.0))
    change = F.col("_p").isNotNull() & (F.length("text") >= least) & (F.col("_o") < overlap)
    return rows.select(session, order, "user_turn", F.round("_o", 6).alias("overlap"), change.alias("topic_change"))


def summary_triggers(turns: DataFrame, session: str = "conv_id", covered: str = "covered") -> DataFrame:
    """When a session is summarised: from four turns on, if the topic changes or ten turns are new; memories every tenth turn.

    ``covered`` is the number of turns that the last summary covers.
    """
    new = F.col("user_turn") - F.col(covered)
    return turns.withColumn("summarise", (F.col("user_turn") >= SUMMARY_TURNS) & (F.col("topic_change") | (new >= SUMMARY_NEW))).withColumn("remember", F.col("user_turn") % MEMORY_EVERY == 0)


def scoped_top(memories: DataFrame, k: int, scope: Column, user: str = "user_id", order: tuple[Column, ...] = ()) -> DataFrame:
    """Per user, the first k in scope among the first max(4k, 40): the scope is asked after that limit, so fewer may come."""
    by = Window.partitionBy(user).orderBy(*order)
    fetched = memories.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= max(4 * k, 40))
    return fetched.where(scope).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")


def quality_events(answers: DataFrame, phrases: list[str], text: str = "text", n_docs: str = "n_docs", best: str = "best_score") -> DataFrame:
    """One row for each rule that an answer breaks: (event_type, severity) beside the answer's columns."""
    rules = [
        ("fallback_answer", "medium", T.contains_any(F.col(text), phrases)),
        ("no_documents", "high", F.col(n_docs) == 0),
        ("low_score", "low", (F.col(n_docs) > 0) & (F.col(best) < LOW_SCORE)),
        ("short_answer", "low", F.length(T.strip(F.col(text))) < 20),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("event_type"), F.lit(s).alias("severity"))) for n, s, c in rules]), lambda x: x.isNotNull())
    return answers.select("*", F.inline(found))


def facet_coverage(terms: DataFrame, hits: DataFrame, answers: DataFrame, session: str = "session_id", generic: list[str] | None = None, limit: int = 8) -> DataFrame:
    """Terms (session, term, pos) that some hit has and the answer lacks, the first ``limit`` of each session."""
    in_hits = terms.join(hits.select(session, F.lower("text").alias("_h")), session).groupBy(session, "term", "pos").agg(F.bool_or(F.contains("_h", F.lower("term"))).alias("in_hits"))
    both = in_hits.join(answers.select(session, F.lower("answer").alias("_a")), session).withColumn("in_answer", F.contains("_a", F.lower("term")))
    missing = both.where(F.col("in_hits") & ~F.col("in_answer") & ~F.col("term").isin(generic or [""]))
    return missing.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy("pos"))).where(F.col("_r") <= limit).select(session, "term", "pos")


def transcript(messages: DataFrame, n: int, limits: dict[str, int] | None = None, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One text a session: its last n user and assistant messages in order, each cut by its role's limit."""
    limits = limits or {"user": 500, "assistant": 200}
    rows = recent(messages.where(F.col("role").isin(*limits)), n, session, order)
    cut = F.coalesce(*[F.when(F.col("role") == r, T.truncated(F.col("text"), k)) for r, k in limits.items()])
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col("role"), F.lit(": "), cut).alias("line"))))
    return rows.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
