"""Tiered search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from basalt.llm import lexical

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """item_id, rank, doc_id, score by the docstring's rules, document by document."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        q, scores = Counter(terms(text)), []
        for row, (i, c, length) in enumerate(counted):
            m = 25 + 75 * length * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, row, i))
        out += [(item, rank, s[-1], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    common, rare = ["the", "OF", "and", "a1", "é"], [f"w{k}" for k in range(300)]
    text = lambda n: "".join((r.choice(common) if r.random() < 0.5 else r.choice(rare)) + r.choice([" ", ", ", "-", "\n", "\x7f"]) for _ in range(n))
    docs = [(k, text(r.randrange(1, 120))) for k in range(700)]
    docs += [(9_000 + k, docs[5][1]) for k in range(60)] + [(None, docs[5][1]), (None, None), (4, ""), (4, "... !"), (4, "É É the"), (4, docs[7][1])]
    items = [(k, docs[k * 7][1][:200] + " unseen") for k in range(40)] + [(40, "the the of"), (40, "w5"), (41, None), (42, "none of it é"), (None, "w7 w8")]
    return docs, items


@pytest.mark.parametrize("tiers,k", [((1_000, 30_000), 10), ((150, 400), 10), ((5, 60), 10), ((3, 10, 100), 4), ((0,), 10), ((), 3)])
def test_all_tiers_agree(spark, corpus, tiers, k):
    docs, items = corpus
    proofs = []
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2), k, tiers, proofs=proofs)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows, want = sorted(map(tuple, got.collect()), key=str), plain(docs, items, k)
    # Rows of equal scores and ids (and items of one id) have no order of their own.
    assert sorted((r[0], r[1], r[3]) for r in rows if r[0] is not None) == sorted((r[0], r[1], r[3]) for r in want if r[0] is not None)
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sum(proofs) == 44  # items with a term that some document has
    if tiers == (150, 400):
        assert proofs == [44]  # nothing falls through
    if tiers in ((0,), (3, 10, 100)):
        assert proofs[0] < 44 and proofs[-1]


def test_postings_hold_what_bounds_say(spark, corpus):
    docs, items = corpus
    wanted = lexical.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), wanted, (4, 40))
    by, bounds = {}, {r["term"]: r for r in index.terms.collect()}
    for r in index.postings.collect():
        by.setdefault(r["term"], []).append((r["tier"], r["impact"]))
    for term, posts in by.items():
        assert sum(t == 0 for t, _ in posts) <= 4 and sum(t <= 1 for t, _ in posts) <= 40
        for tier in (0, 1, 2):
            below = [x for t, x in posts if t > tier]
            assert bounds[term]["w"] * bounds[term][f"rest{tier}"] == max(below, default=0)
            assert not below or min((x for t, x in posts if t <= tier), default=max(below)) >= max(below)


def test_odd_rows(spark):
    d, i = "doc_id long, text string", "item_id long, text string"
    some, item = spark.createDataFrame([(1, "a b"), (2, "b" * 100_000), (3, None)], d), spark.createDataFrame([(1, "a b c")], i)
    assert lexical.search(spark.createDataFrame([], d), item).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None), (2, "!")], d), item).count() == 0
    assert lexical.search(some, spark.createDataFrame([], i)).count() == 0
    assert [tuple(r) for r in lexical.search(some, item).collect()] == plain([(1, "a b"), (2, "b" * 100_000)], [(1, "a b c")])
    wide = some.selectExpr("*", "7 AS rid", "'x' AS term", "1 AS n", "'y' AS item", "1 AS score", "1 AS tier", "1 AS item_id")
    wider = item.selectExpr("*", "'x' AS item", "1 AS q", "1 AS w", "1 AS doc_id", "1 AS rank")
    assert lexical.search(wide, wider).collect() == lexical.search(some, item).collect()
