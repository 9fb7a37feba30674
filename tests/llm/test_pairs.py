"""The Jaccard join and the nearest-neighbour search against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import jaccard, nearest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(class, links) of each row by comparing all of them."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], min(x for x in groups[find(i)] if x is not None) if any(x is not None for x in groups[find(i)]) else None, links[i]) for i in range(len(rows))]


def key(x):
    return tuple((v is None, v or 0) for v in x)


def check(spark, rows):
    got = [tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def near(r, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"n{r.random()}"
    return " ".join(ws)


def test_groups(spark):
    r = random.Random(4)
    rows, n = [], iter(range(10_000))
    passage = [f"p{i}" for i in range(60)]
    for _ in range(12):
        ws = [f"w{r.random()}" for _ in range(r.choice((5, 12, 80, 300)))]
        rows += [(next(n), near(r, ws, r.randint(0, 1 + len(ws) // 25))) for _ in range(r.randint(1, 9))]
        rows += [(next(n), " ".join(ws))] * r.randint(1, 3)
    rows += [(next(n), " ".join(passage + [f"q{r.random()}" for _ in range(r.randint(0, 60))])) for _ in range(30)]
    rows += [(next(n), t) for t in (None, "", " \n", "one", "one", "one two", "two one", "a b c d", "a b c d", "a b c d e", "a b c d e f")]
    r.shuffle(rows)
    check(spark, rows)


def test_chain(spark):
    """Neighbours on a chain of edits link; its ends don't, but are of one class."""
    ws = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(ws)))
        ws = ws[3:] + [f"x{k}{j}" for j in range(3)]
    check(spark, rows)


def test_repeated_rows_and_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (1, t), (2, t + " end"), (3, "other words are in here now"), (3, t)]
    got = sorted(tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 4 - 1), (1, 1, 3), (2, 1, 3), (3, 1, 3), (3, 3, 0)]
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shared", [None, 7])
def test_many_rows_of_one_id(spark, shared):
    """Rows meet the classes of their own text only, not all classes of their id."""
    r = random.Random(4)
    texts = []
    for _ in range(400):
        ws = [f"v{r.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(ws), " ".join([*ws[:-1], "end"])]
    docs = spark.createDataFrame([(shared, t) for t in texts] + [(shared, texts[0])] * 50, "doc_id long, text string").repartition(4)
    rows = jaccard.signed(docs).where("node is not null")
    wanted = rows.groupBy("node").agg(F.first("doc_id").alias("first_id"), F.first("text_key").alias("first_text"), F.count(F.lit(1)).alias("n_docs")).withColumn("root", F.col("node"))
    assert wanted.count() == 800 and jaccard.class_texts(docs, wanted).count() == 850
    got = Counter(map(tuple, jaccard.jaccard_join(docs).collect()))
    assert got == {(shared, shared, 1): 798, (shared, shared, 51): 52}


def test_large_group_in_blocks(spark, monkeypatch):
    """Groups that are dealt over many cells give the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", 4)
    r = random.Random(9)
    ws = [f"w{i}" for i in range(120)]
    check(spark, [(k, near(r, ws, r.randint(0, 3))) for k in range(60)])


def test_pruning_keeps_what_reaches_the_threshold():
    least = jaccard.least_matches()
    r = np.random.default_rng(0)
    agree = r.random((20_000, 128)) < 0.8 + 0.2 / 256
    kept = np.ones(20_000, bool)
    for k, m in enumerate(least):
        kept &= agree[:, : (k + 1) * jaccard.STEP].sum(1) >= m
    assert kept.mean() > 0.9999
    assert least == sorted(least) and least[-1] > 60


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40])
def test_small_searches(spark, n):
    r = np.random.default_rng(n)
    rows = [(k, [float(x) for x in r.normal(size=3)]) for k in range(n)]
    rows += [(50 + k, v) for k, v in rows[:6]]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, float("nan"), 0.0]), (104, [1.0, None, 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in nearest.search(df, df.where("vec_id % 2 = 0"), 5).orderBy("query_id", "rank").collect()]
    fine = [(k, np.array(v)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    want = []
    for k, v in fine:
        if k % 2 == 0:
            near_ = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in fine if j != k and len(w) == len(v))[:5]
            want += [(k, i + 1, j, round(-s, 9)) for i, (s, j) in enumerate(near_)]
    assert [(a, b, c, round(d, 9)) for a, b, c, d in got] == sorted(want)


def test_copies_and_ties(spark):
    rows = [(k, [1.0, 0.0]) for k in range(50)] + [(100 + k, [float(k), 1.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [x["vec_id"] for x in nearest.search(df, df.where("vec_id = 2"), 5).orderBy("rank").collect()]
    assert got == [0, 1, 3, 4, 5]


def test_search_with_clashing_columns(spark):
    plain = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 9)] + [(20, None), (21, [0.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    wide = plain.selectExpr("*", "'x' AS query_id", "'x' AS rank", "'x' AS score", "'x' AS shard", "'x' AS ids")
    got, want = (nearest.search(df, df.where("vec_id in (2, 20, 21)"), 3) for df in (wide, plain))
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[0] for r in rows} == {2}


def test_recall(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(10, 32))
    x = np.concatenate([r.normal(size=(1500, 32)), centres[r.integers(0, 10, 700)] + 0.05 * r.normal(size=(700, 32))])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for row in nearest.search(df, df.where("vec_id % 20 = 0"), 5, shard_rows=800).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 20):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9
    g = nearest.Graph(nearest.unit(x[:500]))
    assert g.edges.shape == (500, nearest.DEGREE) and (g.edges < 500).all() and all(len(set(e[e >= 0])) == (e >= 0).sum() for e in g.edges)


def test_recall_of_a_large_shard():
    """20,000 vectors without any structure, the hardest case, in one shard."""
    x = np.random.default_rng(4).normal(size=(20_000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = nearest.Graph(x)
    q = x[::100]
    g.visits = 0
    found, _ = g.search(q, nearest.beam_of(len(x)))
    truth = np.argsort(-(q @ x.T), axis=1)[:, 1:6]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), truth.tolist(), strict=True)]) >= 0.9
    assert g.visits / len(q) < 0.4 * len(x)


def test_shards_grow_with_the_index():
    assert [nearest.shard_count(n, 64) for n in (0, 1, 4000, 4001, 256_000)] == [1, 1, 1, 2, 64]
    assert 30_000 < 10**9 / nearest.shard_count(10**9, 64) <= 32_000
    assert 8 * 4096 * 10**9 / nearest.shard_count(10**9, 4096) <= nearest.SHARD_BYTES


def test_queries_in_many_batches(spark, monkeypatch):
    """All rows ask, in Arrow batches and blocks much smaller than their number; other columns have the result's names."""
    monkeypatch.setattr(nearest, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17))
    x = np.random.default_rng(5).normal(size=(300, 4))
    df = spark.createDataFrame([(i, [float(y) for y in v], "a", -1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, shard string, rank int")
    got = {}
    for row in nearest.search(df, df, 3, shard_rows=100).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :3]
    assert np.mean([[got[i][k + 1] == want[i][k] for k in range(3)] for i in range(300)]) > 0.95
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pruning_loses_less_than_the_bands():
    agree = 0.8 + 0.2 / 256
    alive, lost = np.ones(1), 0.0
    step = np.array([1.0])
    for _ in range(jaccard.STEP):
        step = np.convolve(step, [1 - agree, agree])
    for least in jaccard.least_matches():
        alive = np.convolve(alive, step)
        lost += alive[:least].sum()
        alive[:least] = 0
    assert lost < (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS


def test_one_group_of_half_the_rows(spark, monkeypatch):
    """The members of one large component are dealt over tasks, and get its smallest id all the same."""
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", 8)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    r = random.Random(4)
    ws = [f"w{i}" for i in range(150)]
    other = [(1000 + k, " ".join(f"x{k}y{j}" for j in range(30))) for k in range(60)]
    check(spark, [(k, near(r, ws, r.randint(0, 2))) for k in range(60)] + other)


def test_links_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "n"), (2, "a b c d e f", 8, "m"), (3, None, 9, None)], "doc_id long, text string, class_id int, node string")
    got = jaccard.jaccard_join(df)
    assert got.columns == ["doc_id", "class_id", "n_links"] and sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
