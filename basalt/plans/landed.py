"""Queries over sources and sinks, landed responses, files, calls and helpers, on the tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant as A
from ..operators import batching, dedup
from ..operators import landed as L
from ..operators import pages as P
from ..operators import retrieval as R
from ..sources import readers, writers
from ..storage import shared_dir
from .registry import query, table

_s = lambda c: F.col(c).cast("string")
AT = "2026-06-10 12:00:00"


def _now():
    return F.lit(AT).cast("timestamp_ntz")


# Sources and sinks: written, and read again


@query("SELECT doc_id, lang, source FROM documents")
def q_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "json")
    writers.overwrite_json(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), path)
    return readers.json_lines(spark, path, "doc_id long, lang string, source string")


@query("SELECT CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, event_id % 7 = 0 AS bad FROM events")
def q_json_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "lines")
    line = F.concat(F.lit('{"event_id": '), _s("event_id"), F.when(F.col("event_id") % 7 == 0, "").otherwise("}"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows = readers.json_lines(spark, path, "event_id long", "report").select("event_id", F.col(readers.CORRUPT).isNotNull().alias("bad"))
    return rows.select(F.when(~F.col("bad"), F.col("event_id")).alias("event_id"), "bad")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "documents")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("maxRecordsPerFile", 1).json(path)
    return readers.json_documents(spark, path, "n_nationkey long, n_name string, n_regionkey long").drop("file")


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'p' || page_id ELSE (page_id + 100000)::VARCHAR END AS page_id, url AS titles, CASE WHEN contains(html, '<') THEN length(html) END AS n FROM pages")
def q_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages").withColumn("file", F.concat(F.lit("/x/"), (F.col("page_id") + 100_000).cast("string"), F.lit(".json")))
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p"), _s("page_id"))).otherwise("")
    return readers.page_index(docs, own, F.col("html"), F.col("url")).select("page_id", "titles", F.length("html").cast("long").alias("n"))


@query("SELECT 'what about ' || n_name AS question, CASE WHEN n_nationkey % 3 = 0 THEN 'Unknown' ELSE 'kind ' || n_regionkey END AS question_type, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'wiki' END AS expected_intent, CASE WHEN n_nationkey % 3 = 1 THEN 'hint ' || n_nationkey ELSE '' END AS pass_hint FROM nation")
def q_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = shared_dir(spark, "questions"), F.col("n_nationkey")
    fields = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit(" || kind "), _s("n_regionkey"), F.lit(" | wiki | hint "), _s("n_nationkey"))).otherwise(F.concat(F.lit("||kind "), _s("n_regionkey"), F.lit("|wiki")))
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("what about "), "n_name", fields).alias("value"))
    lines.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return readers.questions(spark, path)


@query("SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region")
def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    writers.csv_with_mark(table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1), path)
    return readers.decoded_csv(spark, f"{path}/*.csv").where("row_no > 0").select(F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


@query("SELECT doc_id, length(left(text, 2000)) AS n FROM documents UNION ALL SELECT doc_id, length(left(text, 2000)) FROM documents")
def q_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = shared_dir(spark, "log"), table(spark, sf_dir, "documents").select("doc_id", "text")
    for _ in range(2):
        writers.append(docs, path, ("text",))
    return spark.read.parquet(path).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS version FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0")
def q_replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, o = shared_dir(spark, "parts"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    writers.replace_partitions(o.withColumn("version", F.lit(0)), path, "status")
    writers.replace_partitions(o.where("status = 'F' AND o_orderkey % 2 = 0").withColumn("version", F.lit(1)), path, "status")
    return spark.read.schema("o_orderkey long, version int, status string").parquet(path).select("o_orderkey", "status", "version")


@query("SELECT '# regions' AS line UNION ALL SELECT 'rows: ' || count(*) FROM region UNION ALL SELECT r_regionkey || ' ' || r_name FROM region")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "report")
    writers.report(table(spark, sf_dir, "region").select("r_regionkey", F.concat_ws(" ", _s("r_regionkey"), "r_name").alias("l")), path, "regions", "l", "r_regionkey")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT lang AS kind, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang")
def q_index_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    return writers.index(docs, shared_dir(spark, "index"), docs.where("doc_id % 3 = 0"), "doc_id", "kind")


@query("SELECT n_nationkey, n_name = 'NATION_3' OR regexp_matches(n_name, '_1\\d$') AS excluded FROM nation")
def q_excluded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", readers.excluded(F.col("n_name"), ["NATION_3"], [r"_1\d$"]).alias("excluded"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def q_search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("child_evidence", "faq_evidence", "attachment_evidence", "page_summary", "parent_section", "x", "y"))), F.col("l_linenumber").cast("int"))
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("page"), kind.alias("chunk_type"))
    return R.search_scope(chunks, table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("page"))).select("l_orderkey", "l_linenumber")


@query("SELECT page_id, (contains(html, 'content') OR contains(html, 'article'))::INT + contains(html, 'zq-17')::INT AS n FROM pages")
def q_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"))
    both = F.array(item("", "article.pdf"), item("zq-17", "qqqqqq.doc"), item("", ""))
    either = F.when(F.contains("html", F.lit("content")), F.array(item("", "content"), item("zq-17", "qqqqqq.doc"))).otherwise(both)
    return table(spark, sf_dir, "pages").select("page_id", F.size(P.referenced(either, F.col("html"))).alias("n"))


# Projections and lookups


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS first, c_mktsegment || ' > ' || c_name AS path FROM customer")
def q_filled_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.first_filled(name, F.col("c_mktsegment")).alias("first"), T.title_path(F.array("c_mktsegment", "c_name")).alias("path"))


@query("""WITH m AS (SELECT s_nationkey AS page_id, s_suppkey AS id, 'F' || s_suppkey || '.PDF' AS t FROM supplier), f AS (SELECT s_nationkey AS page_id, 'd/f' || s_suppkey || '.pdf' AS path, lower('F' || s_suppkey || '.pdf') AS k FROM supplier WHERE s_suppkey % 2 = 0)
SELECT m.page_id, m.id, CASE WHEN f.k IS NOT NULL THEN 'T' || m.id ELSE m.t END AS title, f.path AS saved_path, 'u' || m.id AS download_url FROM m LEFT JOIN f ON m.page_id = f.page_id AND lower(m.t) = f.k""")
def q_merged_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("k", _s("s_suppkey"))
    meta = s.select(F.col("s_nationkey").alias("page_id"), F.col("s_suppkey").alias("id"), F.concat(F.lit("F"), "k", F.lit(".PDF")).alias("title"), F.concat(F.lit("u"), "k").alias("download_url"))
    files = s.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("page_id"), F.concat(F.lit("T"), "k").alias("title"), F.concat(F.lit("d/f"), "k", F.lit(".pdf")).alias("path"))
    return P.merged_attachments(meta, files)


@query("""SELECT s_nationkey AS page_id, 'N' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'attachment' WHEN s_suppkey % 3 = 1 THEN 'link' ELSE 'stub' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN 'a' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'l' || s_suppkey END AS url FROM supplier""")
def q_matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("k", _s("s_suppkey")).withColumnRenamed("s_nationkey", "page_id")
    attachments = s.where("s_suppkey % 3 = 0").select("page_id", F.concat(F.lit("n"), "k").alias("title"), F.concat(F.lit("a"), "k").alias("url"), F.lit(0).alias("pos"))
    links = s.where("s_suppkey % 3 < 2").select("page_id", F.concat(F.lit(" n"), "k").alias("filename"), F.concat(F.lit("l"), "k").alias("url"), F.lit(0).alias("pos"))
    return P.matched_files(s.select("page_id", F.concat(F.lit("N"), "k").alias("name")), attachments, links).select("page_id", "name", "kind", "url")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'by url' WHEN page_id % 3 = 1 THEN 'by name' END AS description FROM pages")
def q_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h/F"), _s("page_id"), F.lit(".pdf")).alias("url"))
    index = p.where("page_id % 3 = 0").select("url", F.lit(None).cast("string").alias("name"), F.lit("by url").alias("text")).unionByName(p.where("page_id % 3 = 1").select(F.lit(None).cast("string").alias("url"), F.concat(F.lit("f"), _s("page_id"), F.lit(".PDF")).alias("name"), F.lit("by name").alias("text")))
    return P.described(p, index).select("page_id", "description")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'kept' WHEN c_custkey % 4 = 1 THEN 'lead' ELSE 'rest' END AS team, CASE WHEN c_custkey % 4 = 1 THEN 'team lead' ELSE 'old' END AS role FROM customer")
def q_with_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    people = c.select(F.col("c_name").alias("name"), F.when(k == 1, "team lead").otherwise("").alias("role"))
    before = c.select(F.col("c_name").alias("name"), F.when(k == 0, "kept").otherwise("").alias("team"), F.lit("old").alias("role"))
    return A.with_teams(people, before, [("lead", "lead")], "rest").select("name", "team", "role")


@query("""WITH cited AS (SELECT DISTINCT o_custkey AS answer_id, o_orderkey % 5 + 1 AS doc_no FROM orders), links AS (SELECT DISTINCT o_custkey AS answer_id, o_orderkey % 7 AS doc_no, 'l' || o_orderkey AS link FROM orders)
SELECT answer_id, doc_no, link FROM links SEMI JOIN cited USING (answer_id, doc_no) WHERE doc_no <> 0 UNION SELECT l.answer_id, c.doc_no, link FROM links l JOIN cited c ON l.answer_id = c.answer_id WHERE l.doc_no = 0""")
def q_cited_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "answer_id")
    links = o.select("answer_id", (F.col("o_orderkey") % 7).alias("doc_no"), F.concat(F.lit("l"), _s("o_orderkey")).alias("link")).distinct()
    cited = o.select("answer_id", (F.col("o_orderkey") % 5 + 1).alias("doc_no")).distinct()
    return P.cited_links(links, cited).select("answer_id", "doc_no", "link")


@query("""WITH a AS (SELECT l_orderkey AS g, lower('T' || l_suppkey % 4) AS k, l_linenumber AS pos, 'T' || l_suppkey % 4 AS title, 'p' || l_linenumber AS path, repeat('s', l_linenumber::INT) AS summary FROM lineitem)
SELECT g, any_value(title) AS title, arg_min(path, pos) AS path, arg_max(summary, pos) AS summary FROM a GROUP BY g, k""")
def q_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.concat(F.lit("T"), (F.col("l_suppkey") % 4).cast("string")).alias("title"), F.concat(F.lit("p"), _s("l_linenumber")).alias("path"), F.lit("").alias("url"), F.repeat(F.lit("s"), F.col("l_linenumber").cast("int")).alias("summary"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("a")))).alias("x"))
    return P.resources(rows.select("g", F.transform("x", lambda x: x["a"]).alias("attachments")), "g").select("g", "title", "path", "summary")


@query("SELECT event_id, 2 AS tier FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M') = (SELECT strftime(min(ts), '%Y-%m-%dT%H:%M') FROM events)")
def q_matched_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.lit("a meeting").alias("subject"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"))
    start = e.agg(F.min("start_time")).first()[0]
    return A.matched_bookings(e, "another", start).select("event_id", "tier")


@query("SELECT doc_id, left(text, 50) AS first FROM documents WHERE length(text) >= 120 AND position(substr(text, 61, 50) IN text) = 61")
def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("length(text) >= 120").withColumn("s", dedup.span(F.col("text"), F.substring("text", 61, 50)))
    return docs.where(F.instr("text", F.substring("text", 61, 50)) == 61).select("doc_id", F.substring("text", F.lit(1), F.col("s.last") - 60).alias("first"))



# Text ETL


@query("SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS t, count(*) + 1 AS n_rows FROM nation GROUP BY n_regionkey")
def q_markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking as K

    made = K.markdown_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], "n_nationkey", "n_regionkey")
    return made.select("n_regionkey", F.col("table").alias("t"), F.size(K.table_rows(F.col("table"))).cast("long").alias("n_rows"))


@query("SELECT n_nationkey AS page_id, 0 AS section_no, 1 AS child_no, 's ' || n_name AS summary, 'c ' || n_nationkey AS text, 2 AS n_keywords FROM nation")
def q_model_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('Here it is: {"page_summary": "p", "sections": [{"title": "t", "summary": "s '), "n_name", F.lit('", "child_evidence": [{"text": " "}, {"text": "c '), _s("n_nationkey"), F.lit('", "keywords": ["a", "b"]}]}]} Done.'))
    made = P.chunked_by_model(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), raw.alias("raw")))
    return made.select("page_id", "section_no", "child_no", "summary", "text", F.size("keywords").alias("n_keywords"))


@query("SELECT n_nationkey, ['| a | b |' || chr(10) || '| - | - |' || chr(10) || '| ' || n_name || ' | 1 |'] [1] AS hint, 'x ' || n_name || ' [m] y' AS marked, 1 AS n FROM nation")
def q_tables_and_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking as K

    text = F.concat(F.lit("before\n| a | b |\n| - | - |\n| "), "n_name", F.lit(" | 1 |\nafter"))
    anchors = F.array(F.struct(F.col("n_name").alias("anchor"), F.lit("[m]").alias("marker")), F.struct(F.lit("absent").alias("anchor"), F.lit("[z]").alias("marker")))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.get(P.table_hints(text), F.lit(0)).alias("hint"), K.with_markers(F.concat(F.lit("x "), "n_name", F.lit(" y")), anchors).alias("m"))
    return rows.select("n_nationkey", "hint", F.col("m.text").alias("marked"), "m.n")


# Landed responses, calls and schedules


@query("""WITH r AS (SELECT user_id AS k, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS p FROM events), g AS (SELECT * FROM r WHERE NOT (k % 3 = 0 AND p = 2) AND NOT (k % 3 = 1 AND p = 1 AND event_id % 2 = 0)),
s AS (SELECT k, p, count(*) AS n FROM g GROUP BY k, p), e AS (SELECT k, min(q) AS stop FROM (SELECT k, p + 1 AS q FROM s WHERE n < 10 UNION ALL SELECT k, p + 1 FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.p = a.p + 1)) GROUP BY k)
SELECT g.k, g.event_id, g.p FROM g JOIN e ON g.k = e.k WHERE g.p < stop""")
def q_offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.floor(place / 10).alias("p"))
    rows = rows.where("NOT (k % 3 = 0 AND p = 2) AND NOT (k % 3 = 1 AND p = 1 AND event_id % 2 = 0)")
    return L.offset_pages(rows, "k", "p", 10).select("k", "event_id", "p")


@query("SELECT min(event_id) AS pos FROM events WHERE event_id % 11 <> 0 AND event_id % 50 <= 30 GROUP BY user_id")
def q_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("https://News.example/A"), _s("user_id"), F.lit("/")).alias("url"), F.when(e % 11 == 0, " ").otherwise("title").alias("title"), (e % 50).alias("at"), e.alias("pos"))
    return L.crawled(rows.withColumn("page_no", F.when(F.col("at") <= 30, 1).otherwise(2)), most_pages=1).select("pos")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'detail ' || event_id ELSE 'subject' END AS subject FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-05'""")
def q_calendar_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("first"), (F.col("ts") + F.expr("interval 1 hour")).alias("last"), F.lit("subject").alias("subject"), (F.col("event_id") % 2 == 0).alias("private"))
    details = events.where("event_id % 4 = 0 OR event_id % 2 = 1").select("event_id", F.concat(F.lit("detail "), _s("event_id")).alias("subject"))
    return L.calendar_view(events, details, at("2024-01-05"), at("2024-01-20")).select("event_id", "subject")


@query("SELECT event_id, event_id = (SELECT min(event_id) FROM events) AS fine FROM events")
def q_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import hmac

    events = table(spark, sf_dir, "events").select("event_id")
    first = events.agg(F.min("event_id")).first()[0]
    good = hmac.new(b"secret", f"body {first}".encode(), hashlib.sha256).hexdigest()
    return events.select("event_id", L.signed(F.concat(F.lit("body "), _s("event_id")), "secret", F.lit(f" SHA256={good}")).alias("fine"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS p FROM events")
def q_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(L.sigmoid((F.col("value") - 50) / 10), 9).alias("p"))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS l FROM embeddings) SELECT vec_id, round(v[1] / l, 9) AS first, round(list_sum(list_transform(v, lambda x: x * x)) / (l * l), 6) AS length FROM n")
def q_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", L.unit(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(R.dot(F.col("v"), F.col("v")), 6).alias("length"))


@query("""WITH c AS (SELECT l_orderkey AS request_id, l_linenumber AS pos, l_suppkey % 3 = 0 AS w FROM lineitem), m AS (SELECT *, NOT w OR sum(w::INT) OVER (PARTITION BY request_id ORDER BY pos) = 1 AS may FROM c)
SELECT request_id, pos, may AND sum(may::INT) OVER (PARTITION BY request_id ORDER BY pos) <= 3 AS executed FROM m""")
def q_allowed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 3 == 0).alias("is_write"))
    return L.allowed_calls(calls).select("request_id", "pos", "executed")


@query("SELECT l_orderkey AS request_id, l_returnflag AS domain, string_agg('r' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber) AS results FROM lineitem GROUP BY ALL")
def q_joined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.joined_results(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("r"), _s("l_linenumber")).alias("result")))


_FOLD = """RECURSIVE r AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, event_id, t, t AS began, 1 AS n, 0 AS batch FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, r.event_id, r.t, CASE WHEN r.t - f.began >= {s} OR f.n >= {m} THEN r.t ELSE f.began END, CASE WHEN r.t - f.began >= {s} OR f.n >= {m} THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN r.t - f.began >= {s} OR f.n >= {m} THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)"""


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("u")).select("user_id", "event_id", (F.col("u") / 1e6).alias("at"))


@query("WITH " + _FOLD.format(s=172800, m=4) + " SELECT event_id, batch::BIGINT AS batch FROM f")
def q_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.windows(_times(spark, sf_dir), "user_id", "at", 172_800, 4).select("event_id", "batch")


@query("WITH " + _FOLD.format(s=86400, m=1000000000) + ' SELECT user_id, min(t) AS "at", min(i)::BIGINT AS n FROM f GROUP BY user_id, batch')
def q_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = _times(spark, sf_dir).withColumn("delta", F.lit("x"))
    return batching.throttled(deltas, "user_id", "at", 86_400).select("user_id", "at", F.length("text").cast("long").alias("n"))


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 555 AND event_id % 3 <> 0 AS due FROM events")
def q_due_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    last = F.when(e == 0, F.to_date("ts")).when(e == 1, F.date_sub(F.to_date("ts"), 1))
    return table(spark, sf_dir, "events").select("event_id", L.due_daily(F.col("ts"), "09:15", last).alias("due"))


# Files, notices, articles


@query("""WITH x AS (SELECT s_suppkey AS i FROM supplier) SELECT i AS notice_idx, '공고문' AS category, 'b ' || i || '.pdf' AS title, 'https://h/2026-06-10/' || i || '/b%20' || i || '.pdf' AS download_url, 1 AS position FROM x WHERE i % 2 = 0
UNION ALL SELECT i, '공고문', 'A' || i || '.hwp', 'https://h/2026-06-10/' || i || '/A' || i || '.hwp', 1 FROM x WHERE i % 2 = 1 UNION ALL SELECT i, '공고문', 'b ' || i || '.pdf', 'https://h/2026-06-10/' || i || '/b%20' || i || '.pdf', 2 FROM x WHERE i % 2 = 1
UNION ALL SELECT i, '신청양식', 'f.hwp', 'https://h/2026-06-10/' || i || '/f.hwp', CASE WHEN i % 2 = 0 THEN 2 ELSE 3 END FROM x""")
def q_file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.format_string("/a/%03d_x", F.col("s_suppkey")).alias("archive")).withColumn("i", _s("idx"))
    first, second = L.FOLDERS.values()
    place = lambda folder, name: F.concat(F.col("archive"), F.lit(f"/{folder}/"), name)
    files = F.array(place(first, F.concat(F.lit("b "), "i", F.lit(".pdf"))), place(first, F.concat(F.lit("A"), "i", F.lit(".hwp"))), place(first, F.lit("meta.json")), place(second, F.lit("sub/f.hwp")), place(second, F.lit("f.hwp")))
    indexed = F.when(F.col("idx") % 2 == 0, F.create_map(F.lit("공고문"), F.array(F.lit("/gone.pdf"), place(first, F.concat(F.lit("b "), "i", F.lit(".pdf"))))))
    notices = s.select("idx", F.lit("2026-06-10").alias("day"), "archive", indexed.alias("indexed"))
    return L.file_entries(notices, s.select(F.explode(files).alias("path")), "https://h")


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS served FROM supplier")
def q_served_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    folder = next(iter(L.FOLDERS.values()))
    asked = F.when(k == 0, " x\\b.pdf ").when(k == 1, "../b.pdf").otherwise("c.pdf")
    return table(spark, sf_dir, "supplier").select("s_suppkey", L.served_file(asked, F.lit("/a/001_x"), F.lit(f"/a/001_x/{folder}/b.pdf")).alias("served"))


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_name) AS idx, c_name AS name, '[segment]' || chr(10) || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '[nation]' || chr(10) || c_nationkey ELSE '' END AS detail FROM customer")
def q_enriched_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_acctbal", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, _s("c_nationkey")).otherwise(" ").alias("nation"))
    return L.enriched(c, F.col("c_acctbal"), {"segment": "segment", "nation": "nation"}).select("idx", "name", "detail")


@query("""WITH f AS (SELECT s_nationkey AS p, lpad(s_suppkey::VARCHAR, 5, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '.PNG' ELSE '.pdf' END AS n FROM supplier), g AS (SELECT p, list(n ORDER BY n) AS ns FROM f GROUP BY p)
SELECT p::VARCHAR AS page_id, CASE WHEN p = 1 THEN 'given' ELSE '로컬 첨부 page ' || p END AS title, 'local://added_attachments/' || p AS page_url, '로컬 추가 첨부 (' || len(ns) || '개): ' || array_to_string(ns[1:8], ', ') AS body_text, len(list_filter(ns, lambda n: ends_with(n, 'PNG')))::INT AS n_images FROM g""")
def q_local_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lpad(_s("s_suppkey"), 5, "0"), F.when(F.col("s_suppkey") % 2 == 0, ".PNG").otherwise(".pdf"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/data/added_attachments/"), _s("s_nationkey"), F.lit("/"), name).alias("path"))
    extra = spark.createDataFrame([("1", "given", "", None)], "page_id string, title string, body_text string, page_url string")
    return L.local_pages(files, extra).select("page_id", "title", "page_url", "body_text", F.size(F.filter("attachments", lambda a: a["media_type"] == "image")).alias("n_images"))


@query("SELECT c_nationkey, string_agg(k || '. title=' || c_name || ' | url=u' || c_custkey || ' | category=' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' | summary=' || repeat('s', 80) ELSE '' END, chr(10) ORDER BY c_custkey) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) GROUP BY c_nationkey")
def q_article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), F.concat(F.lit(" "), "c_name").alias("title"), F.concat(F.lit("u"), _s("c_custkey")).alias("url"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_custkey") % 2 == 0, F.repeat(F.lit("s"), F.lit(90))).alias("summary"))
    return L.numbered_lines(a, "c_nationkey")


@query(f"SELECT doc_id, left(text, 70) || '...' AS summary, CASE WHEN doc_id % 2 = 0 THEN '2026-01-05' ELSE '2026-06-09' END AS day, 'T ' || doc_id || ' body' AS filtered FROM documents WHERE text <> '' UNION ALL SELECT doc_id, '{L.NO_SUMMARY}', CASE WHEN doc_id % 2 = 0 THEN '2026-01-05' ELSE '2026-06-09' END, 'T ' || doc_id || ' body' FROM documents WHERE coalesce(text, '') = ''")
def q_article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 2 == 0, "2026-01-05")
    return table(spark, sf_dir, "documents").select("doc_id", L.fallback_summary(F.col("text")).alias("summary"), L.target_day(given, _now()).cast("string").alias("day"), L.article_text(F.concat(F.lit("T  "), _s("doc_id")), F.lit(" body ")).alias("filtered"))


@query("""WITH r AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL)
SELECT k AS request_id, CASE k % 5 WHEN 0 THEN 'answerable' WHEN 1 THEN 'need_parent_expansion' WHEN 2 THEN 'need_external_search' WHEN 3 THEN 'need_parent_expansion' ELSE 'answerable' END AS decision,
CASE k % 5 WHEN 1 THEN 'p2' WHEN 3 THEN 'p1' ELSE '' END AS pages, CASE WHEN k % 5 = 2 THEN 'rules 2025년' ELSE '' END AS direct, CASE WHEN k % 5 = 2 THEN 'rules 2025년' ELSE '' END AS policy, CASE WHEN k % 5 = 3 THEN 'bonus' ELSE '' END AS missing FROM r""")
def q_search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("request_id")).distinct()
    k, none = F.col("request_id") % 5, F.array().cast("array<string>")
    decision = F.when(k == 1, "need_parent_expansion").when(k == 2, "need_external_search").otherwise("answerable")
    question = F.when(k == 2, "the rules of 2025").when(k == 3, "grade bonus").otherwise("grade")
    plans = r.select("request_id", decision.alias("decision"), F.when(k == 1, F.array(F.lit("zz"), F.lit("p2"))).otherwise(none).alias("page_ids"), F.when(k == 2, "rules").otherwise("").alias("direct"), F.lit(" ").alias("policy"), none.alias("missing"), (k != 0).alias("parsed"), question.alias("question"))
    plans = plans.withColumn("policy", F.lit(""))
    hits = r.select("request_id", F.explode(F.array(F.struct(F.lit("p1").alias("page_id"), F.lit(True).alias("hinted"), F.lit("a grade").alias("snippet")), F.struct(F.lit("p2").alias("page_id"), F.lit(False).alias("hinted"), F.lit("text").alias("snippet")))).alias("h")).select("request_id", "h.*")
    out = L.search_plan(plans, hits, _now(), ["the", "of"])
    return out.select("request_id", "final.decision", F.array_join("final.page_ids", ",").alias("pages"), "final.direct", "final.policy", F.array_join("final.missing", ",").alias("missing"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'daily' ELSE 'daily' END AS layout FROM pages")
def q_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    html = F.when(k == 1, f'<div class="x {L.MONTH_CLASS}">').when(k == 2, f'<div class="{L.DAY_CLASS}">').otherwise("<p>")
    return table(spark, sf_dir, "pages").select("page_id", L.layout(html, F.when(k == 0, "http://h/?period=monthly")).alias("layout"))


@query("SELECT n_nationkey, '2026-' || printf('%02d', n_nationkey % 12 + 1) AS year_month, 2 AS n_days, '2026-' || printf('%02d', n_nationkey % 12 + 1) || '-06' AS weekend, n_name AS person, 'r' || n_nationkey AS record_id FROM nation")
def q_month_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda day, name, weekend: F.lit(f'<div data-role="header-row-cell" class="c period-monthly"><div class="w-isWeekend-{weekend}"><span>{day}</span><span>{name}</span></div></div>')
    month = (F.col("n_nationkey") % 12 + 1).cast("string")
    html = F.concat(F.lit('<div data-role="corner-cell">'), month, F.lit("월 근무</div>"), head(5, "금", "false"), head(6, "토", "true"), F.lit('<div><div data-role="header-column-cell"><a href="/work-record/r'), _s("n_nationkey"), F.lit('?user_profile_uid=u1"><span data-scope="avatar-meta"><b data-part="title">'), F.col("n_name"), F.lit("</b></span></a></div></div>"))
    g = L.month_grids(table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), 2026).select("n_nationkey", "grid.*")
    return g.select("n_nationkey", "year_month", F.size("days").alias("n_days"), F.get(F.filter("days", lambda d: d["is_weekend"]), F.lit(0))["date"].alias("weekend"), F.get("people", F.lit(0))["name"].alias("person"), F.get("people", F.lit(0))["record_id"].alias("record_id"))


# Helpers


@query("SELECT c_name AS name, '2026-06-10' AS date, CASE WHEN c_custkey % 3 = 0 THEN 'today' ELSE 'history' END AS source FROM customer UNION ALL SELECT c_name, '2026-06-09', 'history' FROM customer")
def q_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    history = c.select("name", F.explode(F.array(F.lit("2026-06-10"), F.lit("2026-06-09"))).alias("date"), F.lit("history").alias("source"))
    today = c.where("c_custkey % 3 = 0").select("name", F.lit("2026-06-10").alias("date"), F.lit("today").alias("source"))
    return A.overlaid(history, today, _now()).select("name", "date", "source")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS source, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 9 END AS stamp FROM customer")
def q_newest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    first = c.where("key % 2 = 0").withColumn("source", F.lit("first")).withColumn("stamp", F.lit(1))
    second = c.withColumn("source", F.lit("second")).withColumn("stamp", F.explode(F.array(F.lit(5), F.lit(9))))
    return A.newest_source([first, second], "key", "stamp").select("key", "source", "stamp")


@query("SELECT user_id AS organizer, max(ts) + INTERVAL 1 HOUR > (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS actionable FROM events GROUP BY user_id")
def q_still_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    rows = e.select(F.col("user_id").alias("organizer"), (F.col("ts") + F.expr("interval 1 hour")).alias("last"))
    return A.still_ahead(rows, F.lit(last).cast("timestamp_ntz") - F.expr("interval 1 day"))
