"""HTML extraction, WARC archives, toxicity and the pipeline."""

import hashlib
import io
import math
import random
import time
import zlib

import numpy as np
import pytest

from basalt.llm import html, toxicity, warc
from basalt.llm.common import shared_dir


@pytest.fixture(scope="module")
def weights():
    return html.train(*html.labelled_pages())


PAGES = {
    "plain": ("<html><body><nav class=menu><ul><li><a href=/>Home</a></li><li><a href=/b>Other</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  paragraph\n of <b>text</b>.<p>Second &eacute;, it has several words in it.</article><footer>&copy; 2024 someone</footer>", "Title & more\nFirst paragraph of text.\nSecond é, it has several words in it."),
    "scripts": ("<body><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><main><p>Only this paragraph is the text of the page.</p></main><noscript>no</noscript>", "Only this paragraph is the text of the page."),
    "comments": ("<body><header><h2>Site</h2></header><div class='entry-content'><p>Content of the page, as it was written, with a few sentences. And more of it.</p></div><section id='comments'><h3>3 comments</h3><div class='comment'><p>I don't agree with this at all, said a reader.</p></div></section><div class='cookie-banner'>We use cookies.</div>", "Content of the page, as it was written, with a few sentences. And more of it."),
    "form": ("<body><div class='sidebar'><h3>Popular</h3><ul><li><a href=/1>One thing</a></li><li><a href=/2>Two things</a></li></ul></div><article><p>The article begins here and goes on for a while, with commas, and stops.</p><form><p>Subscribe to us:</p><input name=q><button>Go</button></form><div class='ad'>Buy this now.</div><p>It ends here after all of the other things.</p></article>", "The article begins here and goes on for a while, with commas, and stops.\nIt ends here after all of the other things."),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(weights, name):
    page, want = PAGES[name]
    assert html.extract([page], weights) == [want]


def test_held_out_layouts(weights):
    pages, labels = html.labelled_pages(150, seed=77)
    f = html.forest(pages)
    p, _ = html.marginals(f, weights)
    truth = np.array([x for page in labels for x in page])
    assert ((p[f.run] > 0.5) == truth).mean() > 0.95


def test_marginals_against_enumeration():
    r = random.Random(0)
    page = html.parse("<div><p>a</p><section><p>b</p></section></div>")
    w = html.Weights(np.array([r.gauss(0, 1) for _ in range(html.FEATURES)]), np.array([[[r.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(html.KINDS)]))
    f = html.forest([page])
    n = len(page.parent)
    score = np.array([sum(w.unary[x] for x in fs) for fs in page.features])
    total, marginal = 0.0, np.zeros(n)
    for state in np.ndindex(*[2] * n):
        e = sum(score[i] for i in range(n) if state[i]) + sum(w.pair[page.kind[i], state[page.parent[i]], state[i]] for i in range(n) if page.parent[i] >= 0)
        total += np.exp(e)
        marginal += np.exp(e) * np.array(state)
    assert np.allclose(html.marginals(f, w)[0], marginal / total)


@pytest.mark.parametrize("bad", [None, "", "<", "<p", "<p>a<div", "</div></p>x", "<a href='>'>y</a>", "<script>never ends", "<!-- never ends", "<p><p><p>", "&#xZZ; &amp &", "<table><td>1<td>2</table>", "<LI>a<LI>b", "\x00<p>\x00", "<p " + "a" * 10_000])
def test_any_markup(weights, bad):
    (text,) = html.extract([bad], weights)
    assert isinstance(text, str)


@pytest.mark.parametrize(
    "page,runs",
    [
        ("<p title=it's>text one</p><p>don't stop</p><p>tail</p>", ["text one", "don't stop", "tail"]),
        ('<p title="a>text one</p>', ["text one"]),
        ('<p title="a>b" class=\'c>d\'>one</p>', ["one"]),
        ("<p data-x=a/b>one</p><p a=1 b=\"2\">two</p>", ["one", "two"]),
        ("<!-->one<!--->two<!-- x --!>three</ >four<?php x ?>five<!DOCTYPE x>six", ["onetwothreefourfivesix"]),
        ("<p>one</p><p class=", ["one"]),
        ("<p>a < b and c > d</p>", ["a < b and c > d"]),
        ("<p>x<math>y</math></p><object>fallback</object>", ["xy", "fallback"]),
    ],
)
def test_attributes(page, runs):
    assert "".join(t for _, t in html.parse(page).runs) == "".join(runs)


def test_all_words_of_an_attribute():
    page = html.parse(f"<div class='{' '.join(f'u{k}' for k in range(40))} sidebar' title='class=ad'>x</div>")
    assert html._feature("word sidebar") in page.features[1] and html._feature("word ad") not in page.features[1]


@pytest.mark.parametrize("bad", ["<div>" * 100_000 + "x", "<p><table><td>" * 30_000, "<div><p>" * 50_000, "<p a='" * 50_000, "<p =\"x>\" " * 50_000, "<ul><li>" * 50_000, "<" * 200_000, "<!--" * 50_000, "</p>" * 100_000, "<a" * 100_000])
def test_deep_and_long_markup_in_linear_time(weights, bad):
    began = time.monotonic()
    html.extract([bad], weights)
    assert time.monotonic() - began < 30


def test_blocks():
    assert [t for _, t in html.parse("<p>a<br>b<p>c <b>d</b>e<ul><li>x<li>y</ul><td>z").runs] == ["a b", "c de", "x", "y", "z"]
    assert [t for _, t in html.parse("<p>a&nbsp; b</p>").runs] == ["a b"]


def test_main_text_of_a_table(spark, weights):
    rows = [(k, "u", p) for k, (p, _) in enumerate(PAGES.values())] + [(9, None, None), (9, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df, weights).collect())
    assert got == sorted([(k, t, len(t)) for k, (_, t) in enumerate(PAGES.values())] + [(9, "", 0), (9, "", 0)])
    assert html.main_text(df.limit(0), weights).count() == 0


PAYLOADS = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "z" * 20_000, "z" * 20_000, "a\r\n\r\nb\r\n0\r\n\r\n" * 900, "long" * 30_000]


@pytest.mark.parametrize("segment", [64, 1000, 8192])
def test_archives(spark, segment):
    rows = [(k, f"http://h/{k}\n x", p) for k, p in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write(warc.with_responses(df), shared_dir(spark, "t"), segment, 3000)
    got = {r["page_id"]: r for r in warc.read_pages(manifest).collect()}
    first = {}
    for k, p in enumerate(PAYLOADS):
        data = (p or "").encode()
        first.setdefault(data, k)
        again = len(data) >= 100 and first[data] != k
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None)
        assert r["payload"] == (None if again else data)


def test_archives_of_odd_rows(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.round_trip(spark.createDataFrame([(3, None, "q" * 200), (3, "u", "q" * 200), (None, "u", "q" * 200), (5, "u", "q" * 200)], schema)).collect())
    assert got == [("3", "response", "None"), ("3", "response", "None"), ("5", "revisit", "3"), ("None", "revisit", "3")]
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.round_trip(spark.createDataFrame([(None, "u", "q" * 200), (None, "v", "q" * 200), (7, "u", "r" * 99), (8, "u", "r" * 99)], schema)).collect())
    assert got == [("7", "response", "None"), ("8", "response", "None"), ("None", "response", "None"), ("None", "response", "None")]


def test_archives_with_clashing_columns(spark):
    plain = spark.createDataFrame([(1, "u", "q" * 200), (2, None, "q" * 200), (3, "v", None)], "page_id long, url string, html string")
    wide = plain.selectExpr("*", "'x' AS payload", "7 AS payload_bytes", "'x' AS payload_digest", "'x' AS record_type", "7 AS refers_to", "'x' AS data")
    assert sorted(map(tuple, warc.round_trip(wide).collect())) == sorted(map(tuple, warc.round_trip(plain).collect()))
    assert warc.round_trip(wide).columns == warc.round_trip(plain).columns


def test_chunked():
    for n in (0, 1, 4096, 4097, 20_000):
        body = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\ntrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nab", b"2\r\nabX\r\n0\r\n\r\n"):
        with pytest.raises(warc.Damaged):
            warc.unchunked(bad)


def test_reassembly():
    assert warc.reassembled([(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")], "o") == b"abc"
    for parts in ([(1, None, b"a"), (3, 2, b"c")], [(1, None, b"a"), (1, None, b"a"), (2, 3, b"c")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a")]):
        with pytest.raises(warc.Damaged):
            warc.reassembled(parts, "o")


def test_cut_archive():
    whole = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"x" * 500)
    assert len(list(warc.parse(io.BytesIO(whole * 3)))) == 3
    with pytest.raises(warc.Damaged):
        list(warc.parse(io.BytesIO(whole + whole[:-9])))


def plain_buckets(word):
    """Buckets of one word's n-grams, one by one."""
    mask, factor = (1 << 64) - 1, int(toxicity._FACTOR)

    def bucket(h):
        h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & mask
        return (h ^ h >> 32) & (toxicity.BUCKETS - 1)

    def hashed(gram):
        return sum(ord(c) * factor ** (len(gram) - i) for i, c in enumerate(gram))

    w = f"<{word}>"
    return [bucket((hashed(w[i : i + k]) + k) & mask) for k in (3, 4, 5) for i in range(len(w) - k + 1)] + [bucket((hashed(w) + 7 * len(w)) & mask)]


def test_scores_against_plain_python():
    r = np.random.default_rng(0)
    logits, offset = r.normal(size=toxicity.BUCKETS), -1.5
    scorer = toxicity.Scorer(logits, offset)
    texts = [None, "", "a", "Ab ab AB, the (word) 日本 é", "stupid " * 9 + "x", " ".join(f"w{k}" for k in range(50)), "z" * 300 + " y"]

    def score(text):
        ws = [w for w, before in zip(toxicity.tokens(text), [None, *toxicity.tokens(text)], strict=False) if w != before]
        each = [np.mean([logits[b] for b in plain_buckets(w)]) for w in ws]
        best = max((np.mean(each[a : a + 8]) for a in range(0, max(1, len(each) - 4), 4)), default=0.0) if each else 0.0
        return 1 / (1 + math.exp(-best - offset))

    for _ in range(2):  # the second time from the cache
        assert np.allclose(scorer.score(texts), [score(t) for t in texts], atol=1e-12)


def test_cached_words_change_no_score(monkeypatch):
    logits = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    texts = [" ".join(f"w{(k * j) % 50}" for j in range(1, 30)) for k in range(40)]
    want = toxicity.Scorer(logits, 0.0).score(texts)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 7)
    small = toxicity.Scorer(logits, 0.0)
    assert np.array_equal(np.concatenate([small.score([t]) for t in texts]), want)


GOOD = [f"{a}{b}{c}" for a in ("lo", "ma", "ti", "re") for b in ("ne", "do", "su", "vi") for c in ("n", "t", "ra", "lo")]
BAD = ["stupid", "worthless", "pathetic"]


def toxic_rows(n, r):
    rows = []
    for i in range(n):
        ws = [r.choice(GOOD) for _ in range(r.randint(5, 120))]
        toxic = i % 3 == 0
        for _ in range(r.randint(1, 4) if toxic else 0):
            w = r.choice(BAD)
            k = r.randrange(len(w) - 1)
            ws.insert(r.randrange(len(ws)), r.choice([w, w.upper(), w[:k] + w[k] + w[k:], w + "!!", w[:-1] if len(w) > 6 else w]))
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(700, random.Random(3))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(10_000, None), (10_001, ""), (10_002, " ".join(GOOD * 400)), (10_003, " ".join(GOOD * 200) + " stupid worthless " + " ".join(GOOD * 200))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (10_000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 704
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.95
    assert [got[k]["predicted"] for k in (10_000, 10_001, 10_002, 10_003)] == [0, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_are_never_read(spark):
    rows = toxic_rows(60, random.Random(1))
    flip = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.toxicity(docs, spark.createDataFrame(x, schema)).orderBy("doc_id").collect() for x in ([(i, 1, y) for i, _, y in rows], flip))
    assert a == b


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 9.0, 1), (1, "a b", 9.0, 0)], "doc_id long, text string, score double, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    from basalt.llm.common import stored, table

    docs, seen = table(spark, small, "documents"), []
    for name, stage in p.STAGES:
        out = stored(stage(spark, docs, small), name)
        if name != "best_fit_packing":
            assert out.columns == columns
        seen.append((name, docs, out))
        docs = out
    assert [s[0] for s in seen] == ["toxicity", "quality_rules", "near_duplicates", "mix_sources", "best_fit_packing"]
    for _, before, after in seen[:3]:
        assert after.count() == after.join(before, "doc_id", "left_semi").count() == after.select("doc_id").distinct().count()
    from tests.llm.test_pairs import brute

    before = [(r["doc_id"], r["text"]) for r in seen[2][1].collect()]
    assert sorted(r["doc_id"] for r in seen[2][2].collect()) == sorted({c for _, c, _ in brute(before)})
    from basalt.llm.quality import quality

    judged = quality(seen[1][1].select("doc_id", "text"), table(spark, small, "labels"))
    assert sorted(r["doc_id"] for r in judged.where("kept").collect()) == sorted(r["doc_id"] for r in seen[1][2].collect())
    from tests.llm.test_tokens import check_places

    assert check_places(seen[4][2].collect()) > 0
    assert p.run(spark, small).count() == seen[4][2].count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], COLUMNS).repartition(3)


def test_near_duplicates_by_row(spark, small):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a, "s"), (2, a, "t"), (2, b, "s"), (None, a, "s"), (None, c, "s"), (None, c, "t"), (None, c, "s"), (3, d, "s"), (3, d, "s"), (4, "", "s"), (4, "", "s")]
    got = [sorted((r["doc_id"] or 0, r["text"]) for r in p.near_duplicates(spark, made(spark, rows), small).collect()) for _ in range(2)]
    assert got[0] == got[1] == sorted([(1, a), (2, b), (0, c), (3, d), (4, ""), (4, "")])


def test_mix_sources_by_row(spark, small):
    import corpus_pipeline as p
    from basalt.llm.mixing import copies, mixed, sized

    r = random.Random(9)
    rows = [(None if k % 3 == 0 else k // 4, " ".join(f"w{k}x{j}" for j in range(r.randrange(40, 160))), "st"[k % 2]) for k in range(600)]
    rows += rows[:20]
    docs = made(spark, rows)
    out = [(x["doc_id"], x["text"], x["source"]) for x in p.mix_sources(spark, docs, small).collect()]
    assert set(out) <= set(rows)
    # Every row is one document: what the mix takes of rows with distinct ids is about what it takes of these.
    plain = made(spark, [(k, t, s) for k, (_, t, s) in enumerate(rows)])
    want = {x["source"]: x["n"] for x in copies(mixed(sized(plain))).groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    for s in "st":
        assert abs(sum(x[2] == s for x in out) - want[s]) < 0.1 * want[s]
    without = sum(x[0] is None for x in out) / len(out)
    assert abs(without - sum(x[0] is None for x in rows) / len(rows)) < 0.1


def test_pipeline_of_nothing_and_of_odd_columns(spark, tmp_path):
    """Every stage of an empty table is empty; columns beside those of documents are left out, whatever their names."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)), "en", "s", 9, "x", 1, 2.0), (None, None, None, None, None, None, None, None)], f"{schema}, _key string, kept int, score double")
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(p.COLUMNS), name
        assert out.count() <= 3


@pytest.mark.parametrize("name", ["op6_warc_archives", "op7_quality_rules", "op8_jaccard_join", "op11_collocations", "op13_lexical_search"])
def test_registered_sql(spark, small, name):
    import duckdb

    from basalt.llm import queries
    from tests.test_oracle import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
