"""Document ETL, deduplication and feed queries over documents, pages, benchmark and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from ..operators import dedup, feeds
from ..operators import merge as M
from .registry import query, table

WHITE, BLACK = ["red", "blue", "hot"], ["gear", "bolt"]
PRIMARY, BOOST, NEGATIVE, DOMAIN = ["tion", "heon"], ["nted", "ander"], ["worthless", "idiot"], ["ing"]
RULES = [("drive", ["gear", "bolt"]), ("round", ["ring", "disc"]), ("other kind", ["gizmo"])]


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', chr(10), 'g'), '(?is)<style\b.*?</style\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g') AS h FROM pages),
t AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM p),
l AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r\f]+', ' ', 'g'))), lambda s: s <> '') AS ls FROM t)
SELECT page_id, array_to_string(list_filter(ls, lambda s, i: i = 1 OR s <> ls[i - 1]), chr(10)) AS text FROM l""")
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href="([^"]*)"', 1)) AS link FROM pages) SELECT DISTINCT page_id, link FROM l""")
def q_links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))


@query(r"""SELECT page_id, lower(regexp_replace(url, '#.*$', '')) AS key, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages""")
def q_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("key"), T.host(F.col("url")).alias("host"))


@query("""SELECT doc_id, sha256(text) AS full_hash, left(sha1(text), 12) AS short_id, source || ':' || printf('%05d', doc_id) AS id FROM documents""")
def q_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("full_hash"), F.left(F.sha1("text"), F.lit(12)).alias("short_id"), F.format_string("%s:%05d", F.col("source"), F.col("doc_id")).alias("id"))


@query(r"""SELECT doc_id, left(concat_ws(chr(10), source, lang, CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN NULL ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END), 6000) AS embedding_text FROM documents""")
def q_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = K.embedding_text(F.col("source"), F.col("lang"), F.upper("source"), F.col("text"), F.lit("child_evidence"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("embedding_text"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')""")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.new_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT count(*) AS n, sum(CASE WHEN lang = 'new' THEN 1 ELSE 0 END)::BIGINT AS n_new, count(DISTINCT source) AS n_sources FROM (SELECT source, lang FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0) UNION ALL SELECT source, 'new' FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0)""")
def q_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    fresh = docs.where("source in ('src1', 'src2') and doc_id % 2 = 0").withColumn("lang", F.lit("new"))
    return M.replace_by_key(docs, fresh, "source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == "new").cast("long")).alias("n_new"), F.countDistinct("source").alias("n_sources"))


@query("""SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY sha256(text)""")
def q_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As the SQL's trim: spaces of any width are blank, tabs and ends of lines aren't. Texts count as they are, not as their hashes.
    filled = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\p{Zs}]"))
    keyed = filled.select("doc_id", F.sha2("text", 256).alias("h"))
    n = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return dedup.first_wins(keyed, F.col("h"), F.asc_nulls_last("doc_id")).join(n, "h").select("doc_id", "n")


@query(r"""WITH d AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM conversations)
SELECT a.conv_id, a.turn AS a, b.turn AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.1""")
def q_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.terms(F.col("text"))).alias("t"))
    other = rows.select(F.col("conv_id").alias("_c"), F.col("turn").alias("b"), F.col("t").alias("_t"))
    pairs = rows.join(other, (F.col("conv_id") == F.col("_c")) & (F.col("turn") < F.col("b")))
    return pairs.select("conv_id", F.col("turn").alias("a"), "b", T.jaccard(F.col("t"), F.col("_t")).alias("jaccard")).where("jaccard >= 0.1").withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS x, ['A', 'B', 'C'][(doc_id % 3 + 1)::INT] AS tier FROM documents),
k AS (SELECT doc_id, tier, (contains(x, 'tion')::INT + contains(x, 'heon')::INT) AS p, (contains(x, 'nted')::INT + contains(x, 'ander')::INT) AS b, (contains(x, 'worthless')::INT + contains(x, 'idiot')::INT) AS n, contains(x, 'ing')::INT AS d FROM t)
SELECT doc_id, 10 + CASE tier WHEN 'A' THEN 5 WHEN 'B' THEN 4 ELSE 0 END + CASE tier WHEN 'A' THEN 4 WHEN 'B' THEN 2 ELSE 1 END + 4 * b + p - 3 * n AS score FROM k WHERE p > 0 AND n < 2 AND (tier <> 'C' OR d > 0)""")
def q_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.element_at(F.array(*map(F.lit, "ABC")), (F.col("doc_id") % 3 + 1).cast("int"))
    return feeds.keyword_score(table(spark, sf_dir, "documents"), F.col("text"), tier, PRIMARY, BOOST, NEGATIVE, DOMAIN).select("doc_id", "score")


@query("""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)red|blue|hot') AND NOT regexp_matches(p_name, '(?i)gear|bolt')""")
def q_white_black(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.white_black(table(spark, sf_dir, "part"), "p_name", WHITE, BLACK).select("p_partkey", "p_name")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'gear') OR contains(lower(p_name), 'bolt') THEN 'drive' WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'disc') THEN 'round' WHEN contains(lower(p_name), 'gizmo') THEN 'other kind' ELSE 'other' END AS category FROM part""")
def q_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", feeds.first_rule(F.col("p_name"), RULES, "other").alias("category"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 6 WHEN 'MACHINERY' THEN 4 ELSE 1 END AS priority FROM customer""")
def q_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", feeds.cased(F.col("c_mktsegment"), {"BUILDING": 6, "MACHINERY": 4}, 1).alias("priority"))


@query("""SELECT c_name AS name, c_acctbal AS balance, 'customer' AS source, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier', NULL FROM supplier""")
def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return feeds.union_sources(a, b, "customer", "supplier").select("name", "balance", "source", "segment")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(regexp_replace(p_name, '\\[[^\\]]*\\]', '', 'g'), '[^\\w]+|_', '', 'g')) ORDER BY p_size, p_partkey) AS rn FROM part) SELECT p_partkey, p_size FROM r WHERE rn = 1""")
def q_program_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.best_of_program(table(spark, sf_dir, "part"), "p_name", (F.asc("p_size"), F.asc("p_partkey"))).select("p_partkey", "p_size")


@query("""WITH c AS (SELECT doc_id, unnest(CASE WHEN length(text) <= 2500 THEN [0] ELSE range(0, length(text), 2250) END) AS s, text FROM documents) SELECT doc_id, (s // 2250)::INT AS chunk_no, length(substr(text, s + 1, 2500))::BIGINT AS n_chars, sha256(substr(text, s + 1, 2500)) AS chunk_hash FROM c""")
def q_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.fixed_pieces(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_hash"))


@query()
def q_chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(table(spark, sf_dir, "documents"), separator="\n").select("doc_id", "chunk_no", "n_chunks", "chunk_hash")


@query()
def q_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hierarchy(table(spark, sf_dir, "documents").withColumn("title", F.col("source"))).select("doc_id", "order", "chunk_type", "id", F.length("text").alias("n_chars"))


@query("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang""")
def q_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.countDistinct("source").alias("n_sources"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g'), '[^A-Za-z]+', '_', 'g') AS key, length(text)::BIGINT AS n FROM documents""")
def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(T.collapsed(F.col("text")), "[^A-Za-z]+", "_").alias("key"), F.length("text").cast("long").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[가-힣]{2,}|[a-z0-9]{3,}')) AS k FROM documents) SELECT doc_id, len(k)::INT AS n_tokens, array_to_string(list_sort(k)[1:3], ' ') AS first FROM t""")
def q_topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.topic_tokens(F.col("text")).alias("k"))
    return found.select("doc_id", F.size("k").alias("n_tokens"), F.array_join(F.slice(F.array_sort("k"), 1, 3), " ").alias("first"))


@query("""WITH n AS (SELECT n_name, n_regionkey, n_nationkey FROM nation) SELECT r_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names, count(*) AS n FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def q_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return feeds.roster(rows, "r_name", "n_name", "n_nationkey")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events nested as months of members with days of items."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("year_month"), "user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.struct(F.col("event_id").alias("pos"), F.col("event_type").alias("type"), F.floor("value").cast("int").alias("duration_minutes")).alias("item"))
    days = e.groupBy("year_month", "user_id", "date").agg(F.sort_array(F.collect_list("item")).alias("items"))
    members = days.groupBy("year_month", "user_id").agg(F.sort_array(F.collect_list(F.struct("date", "items"))).alias("days"))
    member = F.struct(F.struct(F.col("user_id").cast("string").alias("name"), F.lit("staff").alias("role")).alias("user"), "days")
    return members.groupBy("year_month").agg(F.collect_list(member).alias("members"))


@query("""SELECT strftime(ts, '%Y-%m') AS year_month, user_id::VARCHAR AS name, strftime(ts, '%Y-%m-%d') AS date, event_id AS pos, event_type AS type, floor(value)::INT AS duration_minutes FROM events""")
def q_flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.flat_attendance(_months(spark, sf_dir)).select("year_month", "name", "date", "pos", "type", "duration_minutes")


@query("""WITH i AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, event_id, event_type, floor(value)::INT AS d FROM events),
s AS (SELECT user_id, date, sum(d)::INT AS t, arg_max(event_type, {'d': d, 'p': -event_id}) AS primary_type FROM i GROUP BY user_id, date)
SELECT user_id::VARCHAR AS name, date, nullif(t, 0) AS total_minutes, primary_type, CASE WHEN t = 0 THEN NULL WHEN t % 60 = 0 THEN printf('%dh', t // 60) WHEN t // 60 = 0 THEN printf('%dm', t % 60) ELSE printf('%dh %dm', t // 60, t % 60) END AS total FROM s""")
def q_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _months(spark, sf_dir).select(F.explode("members").alias("m")).select(F.col("m.user.name").alias("name"), F.explode("m.days").alias("d"))
    s = feeds.day_summary(F.col("d.items"))
    return days.select("name", F.col("d.date").alias("date"), s["total_minutes"].alias("total_minutes"), s["primary_type"].alias("primary_type"), s["total"].alias("total"))


@query("""WITH m AS (SELECT event_id % 200 AS k, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'n' || event_id END AS name FROM events) SELECT 'id:' || k AS member, arg_min(name, event_id) FILTER (name <> '') AS name, count(*) AS n FROM m GROUP BY k""")
def q_entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") % 200).cast("string").alias("record_id"), F.lit("").alias("uid"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("name"), F.lit("r").alias("role"))
    rows = rows.withColumn("days", F.array(F.struct(F.lit("2024-01-01").alias("date"), F.array(F.struct(F.col("pos").alias("pos"), F.lit("w").alias("type"), F.lit(1).alias("duration_minutes"))).alias("items"))))
    merged = feeds.merged_members(rows)
    return merged.select("member", "name", F.aggregate("days", F.lit(0).cast("long"), lambda a, d: a + F.size(d["items"])).alias("n"))


@query("""WITH p AS (SELECT DISTINCT doc_id % 7 AS k FROM documents) SELECT k FROM p WHERE k NOT IN (SELECT doc_id % 5 FROM documents)""")
def q_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") % 7).alias("k")).distinct().join(d.select((F.col("doc_id") % 5).alias("k")), "k", "left_anti")


@query("""SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def q_set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@query("""SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION SELECT s_suppkey, 'supplier' FROM supplier""")
def q_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))).distinct()


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.(pdf|docx?|xlsx?)($|[?#])') THEN 'document' WHEN regexp_matches(lower(url), '\.(png|jpe?g|gif)($|[?#])') THEN 'image' ELSE 'other' END AS kind FROM pages""")
def q_file_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_class(F.col("url")).alias("kind"))


@query(r"""WITH t AS (SELECT conv_id, turn, '<answer>' || text || '</answer> x <answer> b [2][1][9][2] </answer><sources_used>3, 1, 12</sources_used>' AS raw FROM conversations)
SELECT conv_id, turn, length(text)::BIGINT AS n_text, '3,1' AS sources FROM (SELECT t.*, regexp_replace(c.text, '^\s+|\s+$', '', 'g') AS text FROM t JOIN conversations c USING (conv_id, turn))""")
def q_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("<answer>"), F.col("text"), F.lit("</answer> x <answer> b [2][1][9][2] </answer><sources_used>3, 1, 12</sources_used>"))
    body = T.answer_text(raw)
    return c.select("conv_id", "turn", (F.length(body) - F.length(F.lit("\n\nb [2][1][9][2]"))).cast("long").alias("n_text"), F.array_join(T.numbers_used(raw, "sources_used", F.lit(5)).cast("array<string>"), ",").alias("sources"))
