"""Operators that no query of the tables reaches."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.functions import dates as D
from basalt.functions import text as T
from basalt.operators import chunking as K
from basalt.operators import dedup, feeds
from basalt.operators import evaluation as E
from basalt.operators import merge as M
from basalt.operators.numbering import numbered
from basalt.operators.operations import resolved_people
from basalt.operators import retrieval as R
from basalt.sources import readers as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_display_and_qualification(spark):
    rows = spark.createDataFrame([("nan", "Agency", " ", "2026-01-01", "2026-02-01"), ("Dept", "A", "all year", None, None)], "dept string, agency string, period string, start_date string, end_date string")
    assert [(r["org"], r["period"]) for r in feeds.display_columns(rows).collect()] == [("Agency", "2026-01-01 ~ 2026-02-01"), ("Dept", "all year")]
    screens = spark.createDataFrame([(True, "high"), (True, "low"), (False, "high")], "eligible boolean, fit string")
    assert feeds.qualified(screens).count() == 1
    t = spark.createDataFrame([(1, "[A] Plan", ""), (2, "plan", "big"), (3, "other", "")], "idx int, title string, scale string")
    assert {r["idx"]: r["scale"] for r in feeds.twins(t, "title", "idx", "scale").collect()} == {1: "big", 2: "big", 3: ""}


def test_planned_and_batches(spark):
    rows = [("Kim", "leave", 0, "", "", "오후 반차", 240), ("Kim", "leave", 1, "9:00", "18:00", "", 480), ("Kim", "leave", 2, "9:00", "18:00", "", 480)]
    df = spark.createDataFrame(rows, "name string, type string, pos int, start_time string, end_time string, raw_text string, duration_minutes int")
    assert [r["pos"] for r in feeds.best_planned(df).collect()] == [1]
    n = feeds.batched_fallback(spark.range(70), F.col("id"), 50).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in n) == [(0, 30), (1, 12)]


def test_tokens_and_hints(spark):
    usage = F.from_json(F.lit('[{"prompt_tokens": 1, "total_tokens": 3}, {"prompt_tokens": 2, "completion_tokens": 5, "total_tokens": 7}]'), "array<struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>")
    assert tuple(one(spark, E.token_totals(usage))) == (3, 5, 10)
    assert one(spark, E.hint_score(F.lit("Alpha beta"), F.lit("alpha, gamma"))) == 0.5


def test_chunk_rows(spark):
    assert one(spark, K.problems(F.lit("child_evidence"), F.lit(""), F.lit(" "), F.lit(True), F.lit(None).cast("string"))) == ["missing_id", "empty_evidence", "expand_without_parent"]
    assert one(spark, K.table_rows(F.lit("| a | b |\n|---|:-:|\n| 1 | 2 |\nx"))) == [["a", "b"], ["1", "2"]]
    assert one(spark, K.page_document(F.lit("a"), F.lit(" "), F.lit("b"))) == "a\n\nb"
    rows = spark.createDataFrame([(1, 1, "x|y", "l1\nl2"), (1, 0, "a", None)], "g int, pos int, c string, d string")
    assert K.markdown_table(rows, ["c", "d"], "pos", "g").collect()[0]["table"] == "| c | d |\n| --- | --- |\n| a |  |\n| x\\|y | l1 l2 |"
    docs = spark.createDataFrame([(1, 1, "T", "x" * 10), (1, 2, None, "y" * 10)], "g int, rank int, title string, text string")
    assert K.context(docs, "g", "rank", "title", "text", (5, 3)).collect()[0]["context"] == "[1] T\nxxxxx\n\n[2] \nyyy"
    assert K.split_attachment("word " * 900)[1].startswith(K.split_attachment("word " * 900)[0][-200:])
    assert all(len(p) <= 50 for p in K.budget_split("para one here\n\n" * 9 + "z" * 120, 50))
    got = spark.createDataFrame([("see a.pdf", [("a.pdf", "[A]")])], "t string, a array<struct<anchor:string,marker:string>>").select(K.with_markers(F.col("t"), F.col("a")).alias("x")).collect()[0]["x"]
    assert tuple(got) == ("see a.pdf [A]", 1)


def test_retrieval_parts(spark):
    chunks = spark.createDataFrame([("1", "child_evidence", "p"), ("2", "parent_section", "p"), ("3", "faq_evidence", "q"), ("4", "faq_evidence", None)], "id string, chunk_type string, page string")
    assert sorted(r["id"] for r in R.search_scope(chunks, spark.createDataFrame([("q",), (None,)], "page string")).collect()) == ["1", "4"]
    hits = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.8), (3, "b", 0.3)], "doc_id int, evidence string, score double")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.7)], "evidence string, rerank_score double")
    assert {r["doc_id"]: r["score"] for r in R.rerank(hits, scores, 1).collect()} == {1: 0.1, 2: 0.1, 3: 0.3}
    assert R.hit_gap_filter(hits, 0.05, 1).count() == 1 and R.hit_gap_filter(hits, 0.2, 1).count() == 2
    docs = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, "beta", "alpha alpha"), (3, "x", "y")], "doc_id int, title string, text string")
    got = {r["doc_id"]: r["score"] for r in R.bm25(docs, ["alpha"], fields={"title": 5.0, "text": 1.0}).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]
    assert R.temporal(docs, None, F.col("text")) is docs


def test_sets_of_structs(spark):
    values = F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("u")) for a, b in (("A", 1), ("a", 2), ("b", 1))])
    assert [tuple(x) for x in one(spark, dedup.distinct_structs(values, "t"))] == [("A", 1), ("b", 1)]
    assert [tuple(x) for x in one(spark, M.merge_by_key(values, lambda v: F.lower(v["t"])))] == [("a", 2), ("b", 1)]
    assert one(spark, dedup.overlap_ratio(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert M.delete_by_key(spark.range(3), spark.range(1, 2), "id").count() == 2
    assert one(spark, M.pending_id(F.lit("x" * 60))) == "pending:" + "x" * 48


def test_more_dates(spark):
    day = F.lit(date(2026, 6, 10))
    assert tuple(one(spark, D.style_minutes(F.lit("left: 37.5%; right: 25%")))) == (540, 1080)
    assert one(spark, D.in_work_window(F.lit(360), F.lit(1380))) and not one(spark, D.in_work_window(F.lit(300), F.lit(400)))
    assert one(spark, D.is_live(F.lit(542), F.lit(540))) and one(spark, D.months_between(F.lit(date(2025, 12, 31)), day))[0] == "2025-12"
    assert one(spark, D.reference_year(F.lit("2024 and 2025"), day)) == 2025 and one(spark, D.reference_year(F.lit("this year"), day)) == 2026
    assert tuple(one(spark, D.ordered_range(F.lit(date(2026, 6, 9)), F.lit(date(2026, 6, 1)), day))) == (date(2026, 6, 1), date(2026, 6, 10))
    assert tuple(one(spark, D.ordered_range(F.lit(None).cast("date"), F.lit(None).cast("date"), day))) == (date(2026, 6, 10), date(2026, 6, 17))
    now = F.lit(datetime(2026, 6, 10, 12))
    assert one(spark, D.due_again(F.lit(None).cast("timestamp"), now, 60)) and not one(spark, D.due_again(F.lit(datetime(2026, 6, 10, 11, 59, 30)), now, 60))
    assert one(spark, D.is_workday(day)) and not one(spark, D.is_workday(day, ["2026-06-10"])) and not one(spark, D.is_workday(F.lit(date(2026, 6, 13))))


def test_more_text(spark):
    assert one(spark, T.phrases(F.lit("자료 Data, data 조사 the"), ["the"])) == ["자료", "Data", "data", "조사"]
    assert one(spark, T.cell(F.lit("a\n b|c"))) == "a b/c" and one(spark, T.same_folded(F.lit(" A "), F.lit("a")))
    assert one(spark, T.file_markers(F.lit("[A.pdf | x] [a.PDF | y] [b | c]"))) == ["a.pdf"]
    assert one(spark, T.urls(F.lit("see https://a.b/c, (https://a.b/c) http://x.y."))) == ["https://a.b/c", "http://x.y"]
    assert one(spark, T.renumbered(F.array(F.lit(4), F.lit(2)))) == {4: 1, 2: 2}
    assert one(spark, T.without_marks(F.lit("a {x} b"), r"\{[^}]*\}")) == "a b"


def test_descriptions_and_blocks(spark):
    df = spark.createDataFrame([([("A.pdf", "", "", "text"), ("b.png", "r", "d", ""), ("c", "", "", " ")],)], "items array<struct<name:string,refined:string,description:string,text:string>>")
    assert sorted((r["name"], r["text"]) for r in S.descriptions(df, "items").collect()) == [("a.pdf", "text"), ("b.png", "r")]
    blocks = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(t).alias("text")) for y, x, t in ((2.0, 1.0, "c"), (1.01, 5.0, "b"), (1.04, 1.0, "a"))])
    assert one(spark, S.ordered_blocks(blocks)) == "a\nb\nc" and one(spark, S.confidence(F.lit("short"))) == 0.3
    assert S.has_rows(spark, "no_such_table") is False


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_similar_pairs_over_pivots(spark, threshold):
    """Clusters, copies and noise over many homes and blocks: the pairs are those of brute force."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 6))
    v = np.concatenate([centres[r.integers(0, 12, 150)] + 0.2 * r.normal(size=(150, 6)), np.repeat(centres[:1], 40, 0), r.normal(size=(60, 6))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(999, None)], "id long, vector array<double>")
    got = {(x["a"], x["b"]): x["similarity"] for x in dedup.similar_pairs(df, threshold, block=16).collect()}
    sim = v @ v.T
    want = {(i, j) for i in range(250) for j in range(i + 1, 250) if sim[i, j] >= threshold}
    near = {(i, j) for i in range(250) for j in range(i + 1, 250) if abs(sim[i, j] - threshold) < 1e-9}
    assert set(got) - near == want - near and all(abs(got[p] - sim[p]) < 1e-9 for p in got)


def test_numbers_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 3 END AS g").repartition(5)
    got = [tuple(x) for x in numbered(df, F.col("g"), F.col("k")).orderBy("number").collect()]
    assert [x[2] for x in got] == list(range(1, 1001)) and [x[:2] for x in got] == sorted((x[:2] for x in got), key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert numbered(df.limit(0), F.col("k")).count() == 0


def test_parts_of_names(spark):
    """Names meet users by their first characters; what lies in several user names, or is too short, stays open."""
    users = spark.createDataFrame([("1", "Ann Lee", "a@x"), ("2", "Joanne Li", "j@x"), ("3", "Bo", "b@x"), ("4", "Zoe Zimmermann", ""), ("5", None, "n@x")], "user_id string, user_name string, email string")
    names = spark.createDataFrame([(n,) for n in ("ann", "ann l", "li", "bo", "b", "zimmermann", "JOANNE", "xyz", "", None)], "name string")
    got = {x["name"]: x["email"] for x in resolved_people(names, users).collect()}
    assert got == {"ann": None, "ann l": "a@x", "li": "j@x", "bo": "b@x", "b": None, "zimmermann": None, "JOANNE": "j@x", "xyz": None, "": None, None: None}


def test_latency_sketches(spark):
    """Merging days gives what one pass gives, within the stated error of the ranks; everything but the quantiles is exact."""
    import random

    from basalt.operators import evaluation as E

    r = random.Random(3)
    rows = [(f"k{i % 3}", i % 40, r.lognormvariate(1, 1 + i % 3)) for i in range(60_000)] + [("k0", 1, None), ("only null", 2, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double").repartition(5)
    by_day = E.latency_sketches(df, "v", F.col("day"), "k")
    assert by_day.count() == 3 * 40 and by_day.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    once = {x["k"]: x for x in E.merged_latency(E.latency_sketches(df, "v", F.lit(0), "k"), "k").collect()}
    for x in E.merged_latency(by_day, "k").collect():
        values = sorted(v for k, _, v in rows if k == x["k"] and v is not None)
        assert (x["n"], x["min"], x["max"]) == (len(values), round(values[0], 3), round(values[-1], 3))
        assert abs(x["mean"] - sum(values) / len(values)) < 2e-3 and abs(x["total"] - sum(values)) < 1e-2
        for c, q in (("p50", 0.5), ("p95", 0.95)):
            for y in (x, once[x["k"]]):
                assert abs(sum(v <= y[c] for v in values) / len(values) - q) < E.SKETCH_ERROR + 1e-3
