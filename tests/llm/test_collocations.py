"""Collocations against a plain count of every phrase."""

import random
from collections import Counter, defaultdict

import pytest

from basalt.llm import collocations as C


def plain(rows, max_n, least, top):
    """What the docstring says, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            t = t.replace(c, "\n")
        for piece in t.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(ws)
            for m in range(1, max_n + 1):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k, lo, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), lo, r))
        for rank, (s, a, p, lo, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, lo, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("max_n,parts,gathered,chunk,pending", [(3, 4, 1 << 20, 4096, 1 << 18), (3, 50, 300, 3, 5), (2, 3, 100, 2, 1), (4, 20, 1000, 7, 20), (5, 1, 50, 1, 0)])
def test_against_a_plain_count(spark, max_n, parts, gathered, chunk, pending):
    r = random.Random(max_n)
    words = ["the", "of", "New", "york", "é", "É", "a\x01", "a", "\x01", "zz\x1f", "日本", "x" * 50, "a b", "\x00"]
    rows = []
    for _ in range(300):
        lang = r.choice(["en", "en", "en", "de", None, "und", "", "a\nb"])
        t = "".join(r.choice(words[: r.choice([3, 5, 14])]) + r.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b", "; "]) for _ in range(r.randrange(60)))
        rows.append((lang, r.choice([t, t, t, "the of new york " * 5, None, "", " .,"])))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((3, 10_000), (10, 7)):
        got = C.collocations(docs, max_n, least, top, parts=parts, gathered=gathered, chunk=chunk, pending=pending)
        assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
        assert sorted(map(tuple, got.collect())) == plain(rows, max_n, least, top)


def test_one_word_holds_a_third(spark):
    rows = [("en", " ".join(["hot", "pair", f"w{i % 97}", f"v{i % 13}"] * 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    hot = C.hot_words(docs.select("lang", "text"), 8)
    assert {("en", b"hot"), ("en", b"pair")} <= hot and len(hot) <= 32
    salts = {bytes(w): set() for w in (b"hot", b"pair", b"w1")}
    for r in C.suffix_rows(docs, hot, 8).where("word in (X'686f74', X'70616972', X'7731')").collect():
        salts[bytes(r["word"])].add(r["salt"])
    assert salts[b"hot"] == set(range(9, 17)) and len(salts[b"pair"]) > 4 and max(salts[b"pair"]) <= 8 and salts[b"w1"] == {0}
    assert sorted(map(tuple, C.collocations(docs, parts=8).collect())) == plain(rows, 3, 10, 2000)


def test_scores_past_64_bits(spark):
    n = 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, n), ("en", "a", 1, 3 * n), ("en", "b", 1, 7 * n)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 9 * n)], "lang string, n long")
    real = C.phrase_counts
    try:
        C.phrase_counts = lambda *a, **k: (phrases, totals)
        (row,) = C.collocations(phrases).collect()
    finally:
        C.phrase_counts = real
    assert row["score"] == 1_000_000 * n * n // (21 * n * n)


def test_odd_rows(spark):
    schema = "lang string, text string"
    assert C.collocations(spark.createDataFrame([], schema)).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None), (None, "")], schema)).count() == 0
    rows = [("en", "a b c " * 12), (None, "q r " * 30), ("en", "a b c " * 12), ("en", "y" * 300_000 + " a b")]
    base = spark.createDataFrame(rows, schema)
    wide = base.selectExpr("*", "'x' AS word", "7 AS k", "'x' AS phrase", "1 AS f", "1 AS n", "'y' AS salt", "1 AS score")
    assert sorted(map(tuple, C.collocations(wide).collect())) == plain(rows, 3, 10, 2000)
