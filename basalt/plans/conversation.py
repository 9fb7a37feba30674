"""Conversation queries over conversations (a session is a conv_id) and events (memories)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation as C
from .registry import query, table

_USER = "u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tk FROM conversations WHERE role = 'user')"


@query("""SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
def q_recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id""")
def q_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(table(spark, sf_dir, "conversations"), "conv_id", F.desc("turn")).select("conv_id", "turn", "role")


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_turns, count(*) AS n_messages FROM conversations GROUP BY conv_id""")
def q_turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.turn_counts(table(spark, sf_dir, "conversations"))


@query(f"""WITH {_USER}, p AS (SELECT a.conv_id, a.turn, a.user_turn, len(list_intersect(a.tk, b.tk))::DOUBLE / len(list_distinct(list_concat(a.tk, b.tk))) AS j FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.user_turn BETWEEN a.user_turn - 9 AND a.user_turn - 1)
SELECT conv_id, turn, user_turn::INT AS user_turn, count(*) FILTER (j > 0.05)::INT AS n_similar, count(*) FILTER (j > 0.05) >= 2 AS repeated FROM p GROUP BY conv_id, turn, user_turn""")
def q_repeated_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated_questions(table(spark, sf_dir, "conversations"), threshold=0.05)


@query(f"""WITH {_USER}, p AS (SELECT *, lag(tk) OVER (PARTITION BY conv_id ORDER BY turn) AS pv FROM u),
o AS (SELECT *, CASE WHEN len(tk) > 0 THEN coalesce(len(list_intersect(tk, pv))::DOUBLE / len(tk), 0) ELSE 0 END AS ov FROM p)
SELECT conv_id, turn, user_turn::INT AS user_turn, round(ov, 6) AS overlap, pv IS NOT NULL AND length(text) >= 4 AND ov < 0.25 AS topic_change FROM o""")
def q_topic_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.topic_changes(table(spark, sf_dir, "conversations"))


@query(f"""WITH {_USER}, p AS (SELECT *, lag(tk) OVER (PARTITION BY conv_id ORDER BY turn) AS pv FROM u),
o AS (SELECT *, pv IS NOT NULL AND length(text) >= 4 AND CASE WHEN len(tk) > 0 THEN len(list_intersect(tk, pv))::DOUBLE / len(tk) ELSE 0 END < 0.25 AS ch FROM p)
SELECT conv_id, turn, coalesce(user_turn >= 4 AND (ch OR user_turn - 1 >= 10), false) AS summarise, user_turn % 10 = 0 AS remember FROM o""")
def q_summary_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.topic_changes(table(spark, sf_dir, "conversations")).withColumn("covered", F.lit(1))
    return C.summary_triggers(turns).select("conv_id", "turn", F.coalesce("summarise", F.lit(False)).alias("summarise"), "remember")


@query("""WITH a AS (SELECT conv_id, turn, text, (turn % 3)::INT AS n_docs, (turn % 7) / 20.0 AS best FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, 'fallback_answer' AS event_type, 'medium' AS severity FROM a WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'the of')
UNION ALL SELECT conv_id, turn, 'no_documents', 'high' FROM a WHERE n_docs = 0
UNION ALL SELECT conv_id, turn, 'low_score', 'low' FROM a WHERE n_docs > 0 AND best < 0.1
UNION ALL SELECT conv_id, turn, 'short_answer', 'low' FROM a WHERE length(trim(text)) < 20) SELECT * FROM e""")
def q_quality_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", (F.col("turn") % 3).cast("int").alias("n_docs"), (F.col("turn") % 7 / 20.0).alias("best_score"))
    return C.quality_events(answers, ["the of"]).select("conv_id", "turn", "event_type", "severity")


@query("""WITH m AS (SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r2 FROM m WHERE r <= 40 AND k % 2 = 0)
SELECT user_id, event_id, round(value, 6) AS value FROM s WHERE r2 <= 3""")
def q_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return C.scoped_top(memories, 3, F.col("k") % 2 == 0, order=(F.desc("value"), F.asc("event_id"))).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')),
l AS (SELECT conv_id, turn, role || ': ' || CASE WHEN role = 'user' AND length(text) > 500 THEN left(text, 500) || '…' WHEN role = 'assistant' AND length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS line FROM m WHERE r <= 4)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM l GROUP BY conv_id""")
def q_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcript(table(spark, sf_dir, "conversations"), 4)


@query("""SELECT conv_id, turn, concat_ws(':', 't', CASE WHEN trim(role) = '' THEN '-' ELSE role END, '-') AS key FROM conversations""")
def q_conversation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.conversation_key(F.lit("t"), F.col("role"), F.lit(None).cast("string")).alias("key"))


@query("""WITH t AS (SELECT conv_id, term, pos FROM (VALUES ('tion', 0), ('heon', 1), ('nted', 2), ('the', 3)) AS v(term, pos), (SELECT DISTINCT conv_id FROM conversations)),
h AS (SELECT conv_id, lower(text) AS h FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS a FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
m AS (SELECT t.conv_id, term, pos FROM t JOIN h USING (conv_id) JOIN a USING (conv_id) GROUP BY t.conv_id, term, pos, a HAVING bool_or(contains(h, term)) AND NOT contains(a, term)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS rn FROM m WHERE term <> 'the') SELECT conv_id AS session_id, term, pos FROM r WHERE rn <= 2""")
def q_facet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    terms = c.select("session_id").distinct().select("session_id", F.posexplode(F.array(*map(F.lit, ("tion", "heon", "nted", "the")))).alias("pos", "term"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    answers = c.where("role = 'assistant'").groupBy("session_id").agg(F.array_join(ordered, " ").alias("answer"))
    return C.facet_coverage(terms, c.where("role = 'user'"), answers, generic=["the"], limit=2)
