"""Indexed search over fields against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from basalt.operators import postings as P

BEST, CROSS = {"title": 5.0, "tags": 4.0, "text": 2.0}, {"title": 3.0, "text": 1.0}


def terms(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, queries, k):
    """query -> [(key, score)], document by document."""
    fields = list(BEST)
    rows = [(key, [Counter(terms(x)) for x in texts], [len(terms(x)) for x in texts]) for key, *texts in docs]
    n = len(rows)
    avg = [sum(r[2][i] for r in rows) / n or 1.0 for i in range(3)]
    df = [Counter(t for r in rows for t in r[1][i]) for i in range(3)]
    idf = lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5))
    out = {}
    for query, text in queries:
        scored = []
        for key, counts, lengths in rows:
            part = lambda i, t: counts[i][t] * 2.2 / (counts[i][t] + 1.2 * (0.25 + 0.75 * lengths[i] / avg[i]))  # noqa: B023, E731
            ts = [t for t in dict.fromkeys(terms(text)) if any(c[t] for c in counts)]
            if not ts:
                continue
            best = max(BEST[f] * sum(idf(df[i][t]) * part(i, t) for t in ts) for i, f in enumerate(fields))
            cross = sum(max(CROSS[f] * idf(max(df[0][t], df[2][t])) * part(i, t) for i, f in enumerate(fields) if f in CROSS) for t in ts)
            scored.append((-round(best + cross, 6), key))
        out[query] = [(key, -s) for s, key in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    some = lambda a, b: " ".join(words[min(int(r.expovariate(0.02)), 399)] for _ in range(r.randrange(a, b)))
    docs = [(i, some(1, 6), some(0, 3) or None, some(0, 60)) for i in range(900)]
    docs += [(1000 + i, *docs[3][1:]) for i in range(20)] + [(2000, None, None, None)]
    queries = [(i, some(1, 5)) for i in range(60)] + [(100, docs[3][1]), (101, "w399 W398, w1"), (102, None), (103, "nothing"), (104, "w5 w5 w5")]
    return docs, queries


@pytest.mark.parametrize("k,block,seeds", [(10, 16, 2), (3, 64, 1), (50, 7, 5), (2000, 128, 2)])
def test_as_scoring_everything(spark, corpus, k, block, seeds):
    docs, queries = corpus
    index = P.build(spark.createDataFrame(docs, "doc_id long, title string, tags string, text string").repartition(3), BEST, CROSS, block=block, parts=5)
    reads = []
    got = {}
    for r in P.search(index, spark.createDataFrame(queries, "query long, text string"), k, seeds=seeds, reads=reads).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"], r["score"]))
    want = plain(docs, queries, k)
    for query, rows in want.items():
        mine = sorted(got.get(query, []))
        assert [(key, pytest.approx(score, abs=2e-6)) for key, score in rows] == [(key, score) for _, key, score in mine]
        assert [rank for rank, _, _ in mine] == list(range(1, len(rows) + 1))
    ((read, all_),) = reads
    assert read <= all_
    if (k, block) == (3, 64):
        assert read < all_


def test_rare_terms_read_few_blocks(spark):
    docs = [(i, None, None, f"common word {'rare' if i % 500 == 7 else 'other'} x{i % 3}") for i in range(4000)]
    index = P.build(spark.createDataFrame(docs, "doc_id long, title string, tags string, text string").coalesce(1), BEST, CROSS, block=32)
    reads = []
    got = P.search(index, spark.createDataFrame([(1, "common rare")], "query long, text string"), 5, seeds=5, reads=reads).collect()
    assert {r["key"] % 500 for r in got} == {7}
    assert reads[0][0] <= 10 and reads[0][1] == 125


def test_fields_must_be_known(spark, corpus):
    with pytest.raises(ValueError):
        P.build(spark.createDataFrame(corpus[0][:3], "doc_id long, title string, tags string, text string"), {"text": 1.0}, {"title": 1.0})
    empty = P.build(spark.createDataFrame([], "doc_id long, title string, tags string, text string"), BEST, CROSS)
    assert P.search(empty, spark.createDataFrame([(1, "a")], "query long, text string"), 5).count() == 0
