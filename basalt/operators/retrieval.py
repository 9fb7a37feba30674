"""Hybrid retrieval: BM25 and cosine candidates, reciprocal rank fusion, page ranking, gap filter, parents, diversity.

Ranking windows without a partition only ever run over what a limit has bounded (25 candidates a list, a pool of 20).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What the ranking formulas use.
RRF_K = 60
CANDIDATES = 25
POOL = 20
PAGES = 5
GAP, GAP_KEEP = 0.14, 3
DEFAULT_RANK = 9999
CHUNK_WEIGHTS = {"child_evidence": 1.10, "faq_evidence": 1.10, "attachment_evidence": 0.75, "attachment_summary": 0.60, "attachment_collection": 0.35, "reference_link": 0.55, "page_summary": 0.35}
SEARCHABLE = ("child_evidence", "faq_evidence", "attachment_evidence")
CLOSED, PAST_YEAR, SAME_YEAR = 0.35, 0.45, 1.15


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", fields: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, least: int = 1) -> DataFrame:
    """key, score of the documents that hold at least ``least`` query terms: the best weighted field of each counts.

    One pass counts the few query terms in each document (no postings of other terms are made), one aggregate gives
    document frequencies and average lengths (a missing field has no length), and its single row is broadcast. A document is
    parted into terms once in each pass: the counts of a field are one value, and a generator, below which no filter moves, drops what has no hit.
    """
    fields = fields or {"text": 1.0}
    query = list(dict.fromkeys(query))
    counts = {f: _counts(T.terms(F.coalesce(F.col(f), F.lit(""))), query) for f in fields}
    every = docs.select(*[F.when(F.col(f).isNotNull(), c).alias(f"_c_{f}") for f, c in counts.items()])
    stats = every.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.get(f"_c_{f}", F.lit(0))).alias(f"_avg_{f}") for f in fields], *[F.sum((F.get(f"_c_{f}", F.lit(i + 1)) > 0).cast("int")).alias(f"_df_{f}_{i}") for f in fields for i in range(len(query))])

    def part(f: str, i: int) -> Column:
        tf, df = F.get(F.col(f"_c_{f}"), F.lit(i + 1)).cast("double"), F.col(f"_df_{f}_{i}").cast("double")
        idf = F.log(1.0 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.get(F.col(f"_c_{f}"), F.lit(0)) / F.col(f"_avg_{f}")))).otherwise(0.0)

    def hits(c: Column) -> Column:
        return sum(((sum((F.get(c[f"_c_{f}"], F.lit(i + 1)) for f in fields), F.lit(0)) > 0).cast("int") for i in range(len(query))), F.lit(0)) >= least

    one = F.array(F.struct(*[c.alias(f"_c_{f}") for f, c in counts.items()]))
    found = docs.select(key, F.explode(F.filter(one, hits)).alias("_c")).select(key, "_c.*").join(F.broadcast(stats))  # one row
    scores = [w * sum((part(f, i) for i in range(len(query))), F.lit(0.0)) for f, w in fields.items()]
    return found.select(key, (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score"))


def _counts(terms: Column, query: list[str]) -> Column:
    """The number of a text's terms, and of those that equal each query term; the terms are bound once."""
    return F.get(F.transform(F.array(terms), lambda ws: F.array(F.size(ws), *[F.size(_equal(ws, q)) for q in query])), F.lit(0))


def _equal(words: Column, term: str) -> Column:
    return F.filter(words, lambda w: w == term)


def knn(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding", k: int | None = CANDIDATES) -> DataFrame:
    """key, score: cosine of unit vectors with the query, exact; the k nearest (None: all)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(key), dot(F.col(vector).cast("array<double>"), q).alias("score"))
    return top(scored, k, F.desc("score"), F.asc(key)) if k else scored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds 1-based ranks to a list that is already bounded."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def chunk_weight(kind: Column, stored: Column) -> Column:
    """The weight of a chunk's kind, else its stored weight, else 1."""
    out = None
    for name, w in CHUNK_WEIGHTS.items():
        out = F.when(kind == name, w) if out is None else out.when(kind == name, w)
    return out.otherwise(F.coalesce(stored, F.lit(1.0)))


def fuse(semantic: DataFrame, keyword: DataFrame, key: str = "doc_id", k: int = RRF_K, weight: Column | None = None) -> DataFrame:
    """Full outer join of two ranked lists (key, rank): score = (1/(k+rank) summed over the lists) * weight; a missing rank adds nothing."""
    s = semantic.select(F.col(key), F.col("rank").alias("semantic_rank"))
    w = keyword.select(F.col(key), F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return s.join(w, key, "full_outer").withColumn("score", (part("semantic_rank") + part("keyword_rank")) * (F.lit(1.0) if weight is None else weight))


def fused_order(key: str = "doc_id") -> list[Column]:
    """By score; ties go to the semantic list's order, then the keyword list's."""
    return [F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), F.asc(key)]


def merge_queries(hits: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """Hits of several queries (query_no) as one row a document: best score, best ranks, the queries that found it."""
    return hits.groupBy(key, page).agg(F.max("score").alias("score"), F.min("semantic_rank").alias("semantic_rank"), F.min("keyword_rank").alias("keyword_rank"), F.sort_array(F.collect_set("query_no")).alias("queries"))


def page_stats(hits: DataFrame, page: str = "page", query: str | None = None) -> DataFrame:
    """Per page: hits, hits of each list, queries, best score, best and mean of all ranks of both lists (9999 without any)."""
    ranks = F.array_compact(F.array("semantic_rank", "keyword_rank"))
    total = F.sum(F.aggregate(ranks, F.lit(0).cast("long"), lambda a, x: a + x))
    n = F.sum(F.size(ranks))
    return hits.groupBy(page).agg(
        F.count(F.lit(1)).alias("n"), F.count("semantic_rank").alias("n_semantic"), F.count("keyword_rank").alias("n_keyword"),
        (F.countDistinct(query) if query else F.lit(1).cast("long")).alias("n_queries"), F.max("score").alias("max_score"),
        F.coalesce(F.min(F.array_min(ranks)), F.lit(DEFAULT_RANK)).alias("min_rank"), F.coalesce(total / n, F.lit(float(DEFAULT_RANK))).alias("mean_rank"),
    )


def page_scores(stats: DataFrame, n_queries: int = 1) -> DataFrame:
    """Adds page_score: at most 1, more for several hits, for both lists and for covering the queries."""
    both = F.when((F.col("n_semantic") > 0) & (F.col("n_keyword") > 0), 1.1).otherwise(1.0)
    score = F.col("max_score") * (1 + 0.05 * F.least("n", F.lit(5))) * both * (1 + 0.05 * F.col("n_queries") / float(max(1, n_queries)))
    return stats.withColumn("page_score", F.least(score, F.lit(1.0)))


def temporal(pages: DataFrame, year: int | None, text: Column, closed: str = r"(?i)\b(closed|종료|마감)\b") -> DataFrame:
    """Scales page_score by the age that a page's text tells, if a reference year is given."""
    if year is None:
        return pages
    newest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), 1), lambda y: y.cast("int")))
    factor = F.when(text.rlike(closed), CLOSED).when(newest < year, PAST_YEAR).when(newest == year, SAME_YEAR).otherwise(1.0)
    return pages.withColumn("page_score", F.least(F.col("page_score") * factor, F.lit(1.0)))


def gap_filter(pages: DataFrame, best: str, gap: float = GAP, keep: int = GAP_KEEP, page: str = "page") -> DataFrame:
    """The first ``keep`` pages by page_score, and those whose best score is within ``gap`` of the best of all; gap <= 0 keeps all."""
    if gap <= 0:
        return pages
    first = F.row_number().over(Window.orderBy(F.desc("page_score"), F.asc(page))) <= keep
    near = F.round(F.max(best).over(Window.partitionBy()) - F.col(best), 6) <= gap
    return pages.withColumn("_keep", first | near).where("_keep").drop("_keep")


def hit_gap_filter(hits: DataFrame, gap: float, keep: int, key: str = "doc_id") -> DataFrame:
    order = Window.orderBy(F.desc("score"), F.asc(key))
    return hits.withColumn("_keep", (F.row_number().over(order) <= keep) | (F.max("score").over(Window.partitionBy()) - F.col("score") <= gap)).where("_keep").drop("_keep")


def collapse(hits: DataFrame, parent: str = "parent_id", key: str = "doc_id") -> DataFrame:
    """One row a parent (the hit itself without one): score = best * (1 + .03 * hits, at most 5), at most 1; the best hit; all hits by score."""
    by = F.coalesce(F.col(parent), F.col(key))
    grouped = hits.withColumn("_p", by).groupBy("_p").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"), F.max_by(key, F.struct("score", -F.col(key))).alias("best_hit"), F.sort_array(F.collect_list(F.struct(-F.col("score"), F.col(key)))).alias("_h"))
    score = F.least(F.col("best") * (1 + 0.03 * F.least("n_hits", F.lit(5))), F.lit(1.0))
    return grouped.select(F.col("_p").alias(parent), score.alias("score"), "n_hits", "best_hit", F.transform("_h", lambda h: h[key]).alias("hits"))


def with_parents(collapsed: DataFrame, parents: DataFrame, parent: str = "parent_id", columns: tuple[str, ...] = ("page", "title")) -> DataFrame:
    """Parent fields where the parent exists, the row's own otherwise."""
    p = parents.select(F.col(parent).alias("_p"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = collapsed.join(p, F.col(parent) == F.col("_p"), "left")
    for c in columns:
        own = F.col(c) if c in collapsed.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(T.blank_to_null(F.col(f"_{c}")), own))
    return out.drop("_p", *[f"_{c}" for c in columns])


def keep_best(hits: DataFrame, key: str, order: tuple[Column, ...]) -> DataFrame:
    """One row of each key: the first in the given order, with the best score of all."""
    by = Window.partitionBy(key)
    return hits.withColumn("_r", F.row_number().over(by.orderBy(*order))).withColumn("score", F.max("score").over(by)).where("_r = 1").drop("_r")


def evidence_key(parent: Column, text: Column) -> Column:
    return F.when(T.strip(F.coalesce(parent, F.lit(""))) != "", F.concat(F.lit("parent:"), parent)).otherwise(F.left(F.sha2(T.collapsed(text), 256), F.lit(16)))


def diverse(hits: DataFrame, total: int = PAGES, min_pages: int = 2, per_page: int = 3, page: str = "page", key: str = "doc_id") -> DataFrame:
    """The best hit of each of the first ``min_pages`` pages, then the others by score, at most ``per_page`` of a page."""
    order = [F.desc("score"), F.asc(key)]
    out = hits.withColumn("_global", F.row_number().over(Window.orderBy(*order))).withColumn("_in_page", F.row_number().over(Window.partitionBy(page).orderBy(*order)))
    out = out.withColumn("_page", F.min("_global").over(Window.partitionBy(page)))
    out = out.withColumn("_page", F.dense_rank().over(Window.orderBy("_page")))
    first = (F.col("_in_page") == 1) & (F.col("_page") <= min_pages)
    out = out.where(F.col("_in_page") <= per_page).withColumn("_phase", F.when(first, 0).otherwise(1)).withColumn("_pos", F.when(first, F.col("_page")).otherwise(F.col("_global")))
    return out.orderBy("_phase", "_pos").limit(total).withColumn("position", F.row_number().over(Window.orderBy("_phase", "_pos"))).drop("_global", "_in_page", "_page", "_phase", "_pos")


def neighbours(seeds: DataFrame, catalog: DataFrame, radius: int = 2, total: int = 12, per_page: int = 6, key: str = "id", page: str = "page", order: str = "section_order") -> DataFrame:
    """Seeds (key, pos) and what lies within ``radius`` sections of them on their page, in the order of first appearance.

    Seeds don't count against the cap of a page; the total does count them.
    """
    numbered = catalog.select(key, page, F.row_number().over(Window.partitionBy(page).orderBy(order, key)).alias("index"))
    at = seeds.join(numbered, key).select(F.col(page).alias("_page"), F.col("index").alias("_index"), F.col("pos").alias("_pos"), F.col(key).alias("_seed"))
    near = numbered.join(at, (F.col(page) == F.col("_page")) & (F.abs(F.col("index") - F.col("_index")) <= radius))
    rank = F.struct(F.col("_pos").alias("p"), (F.col(key) != F.col("_seed")).cast("int").alias("o"), F.col("index").alias("i"))
    first = near.groupBy(key, page).agg(F.min(rank).alias("rank"), F.max((F.col(key) == F.col("_seed")).cast("int")).alias("is_seed"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("rank"))).where((F.col("is_seed") == 1) | (F.col("_n") <= per_page))
    kept = kept.orderBy("rank").limit(total)
    return kept.select(key, page, "is_seed", F.row_number().over(Window.orderBy("rank")).alias("position"))


def per_page_cap(rows: DataFrame, k: int, page: str = "page", preferred: str = "preferred", pos: str = "pos") -> DataFrame:
    """At most k rows of a page, preferred ones first, then in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(page).orderBy(F.desc(preferred), pos))).where(F.col("_r") <= k).drop("_r")


def rerank(hits: DataFrame, scores: DataFrame, pool: int = POOL, key: str = "evidence", doc: str = "doc_id") -> DataFrame:
    """Scores (evidence, rerank_score) of the pool's evidence go to all its rows; other rows keep their score. rerank_score is an input."""
    pool_keys = keep_best(hits, key, (F.desc("score"), F.asc(doc))).orderBy(F.desc("score"), F.asc(doc)).limit(pool).select(key)
    known = pool_keys.join(scores, key)
    return hits.join(known, key, "left").withColumn("score", F.coalesce("rerank_score", "score"))


def search_scope(chunks: DataFrame, excluded: DataFrame, kind: str = "chunk_type", page: str = "page") -> DataFrame:
    """Searchable chunks of pages that aren't excluded; a null page is never excluded."""
    return chunks.where(F.col(kind).isin(*SEARCHABLE)).join(excluded.select(page).where(F.col(page).isNotNull()), page, "left_anti")


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: list[str], query_vector: list[float], candidates: int = CANDIDATES, pool: int = POOL, pages: int = PAGES) -> DataFrame:
    """The whole read path over docs (doc_id, page, parent_id, text) and vectors (vec_id, embedding), as one plan."""
    order = (F.desc("score"), F.asc("doc_id"))
    keyword = ranked(top(bm25(docs, query), candidates, *order), *order)
    semantic = ranked(knn(vectors.withColumnRenamed("vec_id", "doc_id"), query_vector, "doc_id", k=candidates), *order)
    fused = fuse(semantic, keyword).orderBy(*fused_order()).limit(pool).join(docs.select("doc_id", "page", "parent_id"), "doc_id")
    best = gap_filter(page_scores(page_stats(fused)), "max_score").orderBy(F.desc("page_score"), "page").limit(pages)
    hits = fused.join(F.broadcast(best.select("page", "page_score")), "page", "left_semi")
    parents = collapse(hits).join(docs.select(F.col("doc_id").alias("parent_id"), "page"), "parent_id")
    return diverse(parents, key="parent_id").select("position", "parent_id", "page", "score", "n_hits", "best_hit")
