from pyspark.sql import functions as F

from basalt.operators import pages as P


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def test_referenced_and_typed_links(spark):
    kind = "html string, attachments array<struct<id:string,title:string>>"
    row = ('<a href="/d/plan%202026.pdf">x</a> id-77 <img src="logo.png">', [("1", "plan 2026.pdf"), ("id-77", "zz.pdf"), ("3", "logo.png"), ("4", "none.doc")])
    got = spark.createDataFrame([row], kind).select(P.referenced(F.col("attachments"), F.col("html")).alias("x")).collect()[0]["x"]
    assert [a["title"] for a in got] == ["plan 2026.pdf", "zz.pdf", "logo.png"]
    html = '<a href="a.pdf"></a><img src="b.png"><a href="a.pdf?x=1"></a><a href="c.html"></a><i data-file-src="a.pdf"></i>'
    assert value(spark, P.typed_links(F.col("h"), [".pdf", ".png"]), h=html) == ["b.png", "a.pdf?x=1", "a.pdf"]


def test_link_candidates(spark):
    rows = [("p", "https://a.com/1", 3), ("p", "https://a.com/1", 1), ("p", "https://www.bad.com/2", 0), ("p", "mailto:x", 2), ("p", "https://a.com/login", 4), ("p", "https://a.com/5", 5)]
    df = spark.createDataFrame(rows, "page string, url string, pos int")
    assert sorted(r["url"] for r in P.link_candidates(df, "page", "url", "pos", ["bad.com"], ["/login"], 2).collect()) == ["https://a.com/1", "https://a.com/5"]
    assert value(spark, P.article_url(F.lit("https://m.a.com/n/1"), F.lit("A long title"), ["/tag/"], ["Home page"], F.lit("http://www.a.com")))
    assert not value(spark, P.article_url(F.lit("https://a.com/tag/1"), F.lit("A long title"), ["/tag/"], [], F.lit("http://www.a.com")))


def test_attachment_joins(spark):
    m = spark.createDataFrame([("p", "1", "A.pdf", "u1"), ("p", "2", "b.pdf", "u2")], "page_id string, id string, title string, download_url string")
    f = spark.createDataFrame([("p", "a (final).pdf", "/x/a.PDF"), ("p", "c", "/x/c.doc")], "page_id string, title string, path string")
    assert sorted((r["id"] or "", r["title"], r["saved_path"] or "") for r in P.merged_attachments(m, f).collect()) == [("", "c", "/x/c.doc"), ("1", "a (final).pdf", "/x/a.PDF"), ("2", "b.pdf", "")]
    names = spark.createDataFrame([("p", "A.pdf"), ("p", "l.png"), ("p", "none")], "page_id string, name string")
    a = spark.createDataFrame([("p", "a.pdf", "ua", 1)], "page_id string, title string, url string, pos int")
    ln = spark.createDataFrame([("p", "A.pdf", "ul", 0), ("p", "l.png", "up", 1)], "page_id string, filename string, url string, pos int")
    assert {r["name"]: (r["kind"], r["url"]) for r in P.matched_files(names, a, ln).collect()} == {"A.pdf": ("attachment", "ua"), "l.png": ("link", "up"), "none": ("stub", None)}
    index = spark.createDataFrame([("https://h/x.pdf", None, "by url"), (None, "y.pdf", "by name")], "url string, name string, text string")
    u = spark.createDataFrame([("https://h/x.pdf",), ("https://h/Y.pdf?v=1",), ("https://h/z",)], "url string")
    assert {r["url"]: r["description"] for r in P.described(u, index).collect()} == {"https://h/x.pdf": "by url", "https://h/Y.pdf?v=1": "by name", "https://h/z": None}
    docs = spark.createDataFrame([("d", "see https://h/x.pdf, and https://h/z or h/Y.pdf", ["h/Y.pdf", "h/none"])], "id string, text string, urls array<string>")
    assert [(x["url"], x["description"]) for x in P.annotated_urls(docs, index).collect()[0]["urls"]] == [("https://h/x.pdf", "by url"), ("h/Y.pdf", "by name")]


def test_resources_and_citations(spark):
    kind = "g int, attachments array<struct<title:string,path:string,url:string,summary:string>>"
    df = spark.createDataFrame([(1, [("A", "", "u", "s"), ("a", "p", "", "longer"), ("", "q", "", "")])], kind)
    assert sorted((r["title"] or "", r["path"], r["url"] or "", r["summary"]) for r in P.resources(df, "g").collect()) == [("", "q", "", ""), ("A", "p", "u", "longer")]
    links = spark.createDataFrame([("a", 0, "w"), ("a", 1, "x"), ("a", 3, "y")], "answer_id string, doc_no int, link string")
    cited = spark.createDataFrame([("a", 1), ("a", 2)], "answer_id string, doc_no int")
    assert sorted((r["doc_no"], r["link"]) for r in P.cited_links(links, cited).collect()) == [(1, "w"), (1, "x"), (2, "w")]
    assert value(spark, P.citation_url(F.lit(None).cast("string"), F.lit(" "), F.lit("l"))) == "l"


def test_markdown(spark):
    html = "<h2>T</h2><p>a <b>b</b></p><script>x</script><ul><li>one</li><li>two</li></ul><table><tr><th>A</th><th>B|C</th></tr><tr><td colspan=2>1\n2</td></tr></table><img src='/f/p.png?x=1'>"
    want = "## T\n\na b\n\n- one\n\n- two\n\n| A | B\\|C |\n| --- | --- |\n| 1 2 | |\n[p.png | /f/p.png?x=1]"
    assert P.to_markdown(html) == want
    assert value(spark, P.markdown(F.col("h")), h=html) == want
    text, urls = P.replaced_links("<p>see <a href='/a b'>this page</a> now</p>", "https://h/x/")
    assert text == "see [this page] now" and urls == [{"text": "this page", "url": "https://h/a%20b"}]
    got = value(spark, P.content_with_links(F.col("h"), F.lit("https://h")), h="<a href='/q'>go</a>")
    assert (got["text"], got["urls"][0]["url"]) == ("[go]", "https://h/q")
    assert P.to_markdown("<td>x</td></table><p>y") == "x\n\ny" or "y" in P.to_markdown("<td>x</td></table><p>y")


def test_markers_and_tables(spark):
    assert value(spark, P.without_nested(F.col("t")), t="a (b (c) d) e") == "a  e"
    assert value(spark, P.normalised_markers(F.col("t")), t="[a.png | x] [b.pdf | y] [http://h/c.pdf | z]") == "[image: a.png | x] [document: b.pdf | y] [http://h/c.pdf | z]"
    assert value(spark, P.table_hints(F.col("t")), t="x\n| a |\n| - |\n| 1 |\ny") == ["| a |\n| - |\n| 1 |"]
    assert value(spark, P.consolidated(F.col("t"), ["drop"]), t="# head\nkeep\n[drop]\nno\n\n[other]\nyes") == "keep\nyes"
    assert value(spark, P.numbered_items(F.col("t")), t="1. one\n2) two\nx\n3. three\n4. four") == "one / two / three"


def test_model_output(spark):
    raw = '```json\n{"page_summary": "ps", "sections": [{"title": "t", "summary": "", "text": "x", "child_evidence": [{"text": " a ", "keywords": ["k"]}, {"text": ""}]}, {"title": "u", "summary": "s", "child_evidence": []}]}\n```'
    df = spark.createDataFrame([("p", raw), ("q", "no json")], "page_id string, raw string")
    assert [tuple(r) for r in P.chunked_by_model(df).collect()] == [("p", 0, 0, "t", "ps", "a", ["k"])]
    assert value(spark, P.parsed_lines(F.col("t"), ["Pages", "Reason"]), t="pages: a, b\nx\nReason : why: so") == {"pages": "a, b", "reason": "why: so"}


def test_search_texts(spark):
    kind = "request_id int, direct string, policy string, question string, legacy array<string>"
    df = spark.createDataFrame([(1, "d", "", "q", None), (2, "", None, "q", ["x", " ", "y"]), (3, None, None, "q", None)], kind)
    assert sorted((r["request_id"], r["query_no"], r["role"], r["query"]) for r in P.retrieval_specs(df).collect()) == [(1, 0, "direct", "d"), (1, 1, "policy", "d"), (2, 0, "q_0", "x"), (2, 1, "q_1", "y"), (3, 0, "direct", "q"), (3, 1, "policy", "q")]
    plan = spark.createDataFrame([(1, ["b", "z"]), (2, ["z"])], "request_id int, page_ids array<string>")
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "a")], "request_id int, page_id string")
    assert {r["request_id"]: r["page_ids"] for r in P.planner_pages(plan, hits).collect()} == {1: ["b"], 2: ["a", "c"]}
    assert value(spark, P.rerank_query(F.lit("User q"), F.array(F.lit("one"), F.lit("user  Q"), F.lit("three")))) == "one user  Q"
    assert value(spark, P.rerank_passage(F.lit("S"), F.lit("body"))) == "[S] body"
    assert value(spark, P.evidence_scores(F.lit("alpha b beta"), F.lit("Alpha and BETA"))) == 2
    assert value(spark, P.section_order(F.lit("p:s:s1:00012:abc"))) == 12
