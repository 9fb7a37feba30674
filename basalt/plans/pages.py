"""Queries over pages, links, requests and schedules, on the tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant as A
from ..operators import chunking as K
from ..operators import feeds
from ..operators import merge as M
from ..operators import operations as O
from ..operators import pages as P
from ..sources import readers
from .registry import query, table


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^http:', 'https:') AS url FROM pages), l AS (SELECT page_id % 20 AS page, url, min(page_id) AS pos FROM u WHERE NOT contains(lower(url), '/de/') AND NOT contains(lower(url), 'example.net') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS k FROM l) SELECT page, url, pos FROM r WHERE k <= 3""")
def q_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("page"), F.regexp_replace("url", "^http:", "https:").alias("url"), F.col("page_id").alias("pos"))
    return P.link_candidates(links, "page", "url", "pos", [], ["/de/", "example.net"], 3).select("page", "url", "pos")


@query(r"""WITH d AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages) SELECT page_id, NOT regexp_matches(lower(url), '/de/|/fr/') AND length(trim(title)) >= 8 AS likely FROM d""")
def q_article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", P.article_url(F.col("url"), title, ["/de/", "/fr/"], [], F.col("url")).alias("likely"))


@query()
def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(P.markdown(F.col("html")), 256).alias("markdown_hash"))


@query()
def q_content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", P.content_with_links(F.col("html"), F.col("url")).alias("c"))
    return rows.select("page_id", F.length("c.text").alias("n_chars"), F.size("c.urls").alias("n_urls"))


@query("""SELECT doc_id, left('[' || source || '] ' || text, 900) AS passage FROM documents""")
def q_rerank_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.rerank_passage(F.col("source"), F.col("text")).alias("passage"))


@query("""SELECT doc_id, (contains(lower(text), 'tion')::INT + contains(lower(text), 'heon')::INT + contains(lower(text), 'zz')::INT)::INT AS n FROM documents""")
def q_evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.evidence_scores(F.lit("tion heon a zz Tion"), F.col("text")).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber AS section_order FROM lineitem""")
def q_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.chunk_id(F.col("l_orderkey").cast("string"), F.lit("parent_section"), F.lit("s1"), F.col("l_linenumber"), F.lit("x"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.section_order(made).alias("section_order"))


@query("""WITH x AS (SELECT conv_id AS request_id, CASE WHEN conv_id % 3 = 0 THEN 'd ' || conv_id ELSE '' END AS d, CASE WHEN conv_id % 3 = 1 THEN 'p ' || conv_id ELSE '' END AS p FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT request_id, 0 AS query_no, 'direct' AS role, CASE WHEN d <> '' THEN d WHEN p <> '' THEN p ELSE 'q' END AS query FROM x UNION ALL SELECT request_id, 1, 'policy', CASE WHEN p <> '' THEN p WHEN d <> '' THEN d ELSE 'q' END FROM x""")
def q_retrieval_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id")).distinct()
    part = lambda k, p: F.when(F.col("request_id") % 3 == k, F.concat(F.lit(p), F.col("request_id").cast("string"))).otherwise("")
    return P.retrieval_specs(c.withColumn("direct", part(0, "d ")).withColumn("policy", part(1, "p ")).withColumn("question", F.lit("q")).withColumn("legacy", F.array().cast("array<string>")))


@query("""WITH h AS (SELECT DISTINCT user_id % 20 AS r, event_type AS p FROM events), a AS (SELECT r AS request_id, list_sort(list(p)) AS al FROM h GROUP BY r)
SELECT request_id, array_to_string(CASE WHEN list_contains(al, 'view') AND request_id % 2 = 0 THEN ['view'] ELSE al END, ',') AS pages FROM a""")
def q_planner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("request_id"), F.col("event_type").alias("page_id"))
    plan = hits.select("request_id").distinct().withColumn("page_ids", F.when(F.col("request_id") % 2 == 0, F.array(F.lit("zz"), F.lit("view"))).otherwise(F.array(F.lit("zz"))))
    return P.planner_pages(plan, hits).select("request_id", F.array_join("page_ids", ",").alias("pages"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'page_removed' WHEN event_type = 'view' THEN 'page_created' ELSE 'page_updated' END AS event FROM events""")
def q_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_type") == "click", F.lit('{"page_removed": 1}')).when(F.col("event_type") == "view", F.lit('{"page": {"version": 1}}')).otherwise(F.lit('{"event": "page_updated"}'))
    return table(spark, sf_dir, "events").select("event_id", A.page_event(body, F.lit("")).alias("event"))


@query("""WITH t AS (SELECT event_id, (event_id % 24)::INT AS h, (event_id % 60)::INT AS m FROM events) SELECT event_id, printf('%02d:%02d', h, m) AS first, printf('%02d:%02d', (h + 1) % 24, m) AS last FROM t""")
def q_time_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 24).cast("int").alias("h"), (F.col("event_id") % 60).cast("int").alias("m"))
    slot = A.time_slot(F.format_string("at %d:%02d please", F.col("h"), F.col("m")), F.lit("2026-06-10").cast("date"))
    made = rows.select("event_id", F.explode(F.array(slot)).alias("slot"))  # a generator binds it
    return made.select("event_id", F.date_format("slot.first", "HH:mm").alias("first"), F.date_format("slot.last", "HH:mm").alias("last"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'tion') THEN 'a' WHEN contains(lower(text), 'lich') THEN 'b' ELSE 'c' END AS team FROM documents""")
def q_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", A.first_match(F.col("text"), [("a", "(?i)tion"), ("b", "(?i)lich")], "c").alias("team"))


@query("""SELECT doc_id, contains(lower(text), 'tion') AS has_a, contains(lower(text), 'lich') AS has_b FROM documents""")
def q_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.signals(F.col("text"), {"a": ["tion"], "b": ["lich"]})
    return table(spark, sf_dir, "documents").select("doc_id", F.map_contains_key(s, "a").alias("has_a"), F.map_contains_key(s, "b").alias("has_b"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS name, strftime(ts, '%Y-%m-%d') AS d, event_id, event_type FROM events), p AS (SELECT name, d, string_agg(event_type, ', ' ORDER BY event_id) AS t FROM e GROUP BY name, d)
SELECT name, string_agg(d || ': ' || t, chr(10) ORDER BY d) AS schedule FROM p GROUP BY name""")
def q_schedule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("pos"), F.col("event_type").alias("type"), F.lit("").alias("start_time"), F.lit("").alias("end_time"))
    return A.schedule_lines(items)


@query("""SELECT c_name AS name, min(c_custkey) AS pos FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (contains(c_nationkey::VARCHAR, '1')) GROUP BY c_name""")
def q_roster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), F.col("c_nationkey").cast("string").alias("role"), F.col("c_custkey").alias("pos"))
    return A.roster_names(people, ["BUILDING", "MACHINERY"], ["1"]).select("name", "pos")


@query("""WITH m AS (SELECT strftime(m, '%Y-%m') AS year_month FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1996-06-01', INTERVAL 1 MONTH)) AS m)) SELECT year_month, (SELECT count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m') = year_month )::BIGINT AS n FROM m""")
def q_month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    return A.month_gaps(rows, "1995-01-10", "1996-06-20")


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'Z' ELSE c_mktsegment END AS email FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'S' FROM supplier""")
def q_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_name", "c_mktsegment")
    target = c.select("id", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("email"))
    given = c.select("id", F.lit("new").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "Z").otherwise(F.lower("c_mktsegment")).alias("email"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("S").alias("email"))
    return M.fill_empty(target, given.unionByName(suppliers), "id", ["name"], ["email"])


@query("""SELECT n_nationkey, n_name FROM nation WHERE CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_1') THEN n_name = 'NATION_1' WHEN EXISTS (SELECT 1 FROM nation WHERE contains(n_name, 'NATION_1')) THEN contains(n_name, 'NATION_1') ELSE ends_with(n_name, '_1') END""")
def q_tiered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tiered_match(table(spark, sf_dir, "nation"), "n_name", "NATION_1").select("n_nationkey", "n_name")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')""")
def q_match_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.match_notices(table(spark, sf_dir, "part"), "p_partkey", "p_name", -1, "Ring").select("p_partkey", "p_name")


@query("""WITH RECURSIVE t(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION SELECT p.p_partkey, depth + 1 FROM part p JOIN t ON p.p_partkey // 3 = t.id WHERE p.p_partkey > 1) SELECT id, min(depth)::INT AS depth FROM t GROUP BY id""")
def q_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("parent_id")).where("id <> parent_id")
    return readers.tree(spark, nodes, 1)


@query(r"""SELECT doc_id, text = '' AS blank, left(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), 90) AS slug FROM documents""")
def q_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("text") == "").alias("blank"), T.slug(F.lower("source")).alias("slug"))
