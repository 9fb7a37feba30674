"""Similarity joins of sets, and dedup by either key, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.operators import dedup, setjoin


def pairs(rows, threshold, strict=False):
    out = []
    for i, (g, a, x) in enumerate(rows):
        for h, b, y in rows[i + 1 :]:
            x_, y_ = set(x or []) - {None}, set(y or []) - {None}
            if g is not None and g == h and x_ and y_:
                j = len(x_ & y_) / len(x_ | y_)
                if j > threshold if strict else j >= threshold:
                    out.append((g, min(a, b), max(a, b), round(j, 9)))
    return sorted(out)


@pytest.mark.parametrize("threshold,block,strict", [(0.1, 4, False), (0.5, 8, False), (0.6, 3, True), (0.8, 512, False), (1.0, 5, False)])
def test_all_pairs(spark, threshold, block, strict):
    r = random.Random(int(threshold * 10))
    rows = []
    for k in range(220):
        base = [f"t{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randrange(0, 14))]
        rows.append((r.choice(["g", "g", "h", None]), k, r.choice([base, base, rows[-1][2] if rows else base, [*(rows[-1][2] or []), "x"] if rows else None, None, [None, "t1"]])))
    df = spark.createDataFrame(rows, "g string, k long, t array<string>").repartition(3)
    compared = []
    got = setjoin.similar_rows(df, "g", "k", F.col("t"), threshold, strict, block, compared)
    want = pairs(rows, threshold, strict)
    assert sorted((x["group"], x["a"], x["b"], round(x["jaccard"], 9)) for x in got.collect()) == want
    n = {}
    for g, a, b, _ in want:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    links = {x["key"]: x["n_similar"] for x in setjoin.linked_rows(df, "g", "k", F.col("t"), threshold, strict, block).collect()}
    assert links == {k: n.get(k, 0) for g, k, t in rows if g is not None and set(t or []) - {None}}


def test_one_large_group_compares_few(spark):
    """20,000 messages of one conversation, a quarter of them one text, all with the same two frequent words."""
    r = random.Random(1)
    texts = [" ".join(["the", "of", *(f"w{r.randrange(4000)}" for _ in range(10))]) for _ in range(15_000)]
    texts = [*texts[:14_000], *(t + " again" for t in texts[:1000]), *["one text that comes again"] * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", F.lit("c").alias("g"), F.split("text", " ").alias("t"))
    compared = []
    sets, members = setjoin.similar_sets(rows, "g", "k", F.col("t"), 0.6, True, compared=compared)
    assert sets.count() >= 1000 and members.count() == 20_000
    assert compared[0] < 100_000  # of 200 million pairs
    with pytest.raises(ValueError):
        setjoin.similar_sets(rows, "g", "k", F.col("t"), 0.0)


@pytest.mark.parametrize("threshold,one", [(0.95, False), (0.3, True)])
def test_vectors_visit_few_pivots_or_one(spark, threshold, one):
    """Clusters at a high threshold keep their pivots apart; at a low one all vectors meet by blocks. Pairs are those of all products."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 24))
    x = np.repeat(centres, 25, axis=0) + 0.1 * r.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    angle = float(np.arccos(threshold))
    assert (dedup.visited(x, x[::25], angle) > dedup.VISITS) is one
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = {(p["a"], p["b"]) for p in dedup.similar_pairs(df, threshold, block=20).collect()}
    sim = x @ x.T
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if sim[i, j] >= threshold}


def fold(rows):
    seen, out = {}, []
    for g, n, a, b in sorted(rows, key=lambda x: x[1]):
        x, y = seen.setdefault(g, (set(), set()))
        if (a and a in x) or (b and b in y):
            continue
        x.add(a)
        y.add(b)
        out.append((g, n, a, b))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_either_key(spark, seed):
    r = random.Random(seed)
    some = lambda p, m: r.choice([None, "", *[f"{p}{r.randrange(m)}"] * 12])
    rows = [(r.choice(["f", "f", None]), n, some("t", 25), some("u", 25)) for n in range(150)]
    # A chain in which each row waits for the one before.
    rows += [("chain", n, f"t{n // 2}", f"u{(n + 1) // 2}") for n in range(12)]
    df = spark.createDataFrame(rows, "g string, n long, title string, url string").repartition(3)
    assert sorted(map(tuple, dedup.either_key(df, "g", "n", "title", "url").collect()), key=str) == fold(rows)
    assert dedup.either_key(df.limit(0), "g", "n", "title", "url").count() == 0


def test_one_feed_of_all_rows(spark):
    rows = [("f", n, f"t{n % 50}", f"u{n % 2000}") for n in range(6000)] + [("f", 6000 + n, "t0", "") for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, n long, title string, url string").repartition(4)
    assert sorted(map(tuple, dedup.either_key(df, "g", "n", "title", "url").collect()), key=str) == fold(rows)
