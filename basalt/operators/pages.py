"""Page ETL beyond chunking: links and attachments, markdown, markers, nested model output, citations, trims, context.

What needs a parser's state (markdown, placeholders, fixpoints) is a plain function on one text, run in a pandas UDF;
everything else is built-in expressions and joins.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Limits of link lists and texts.
MAX_LINKS = 40
MIN_STEM = 5
SUMMARY_CHARS = 12_000
RERANK_QUERY, RERANK_PASSAGE = 480, 900
_SKIPPED = {"script", "style", "noscript", "head", "template"}
_BLOCKS = {"p", "div", "section", "article", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre", "br"}


# Links and attachments


def referenced(attachments: Column, html: Column) -> Column:
    """Attachments (structs with id, title) that a page's HTML refers to: by title, by encoded title, by id, or by a long stem."""

    def used(a: Column) -> Column:
        title = F.coalesce(a["title"], F.lit(""))
        stem = F.regexp_replace(title, r"\.[^.]+$", "")
        encoded = F.regexp_replace(F.url_encode(title), r"\+", "%20")
        return (title != "") & (F.contains(html, title) | F.contains(html, encoded) | (F.coalesce(a["id"], F.lit("")) != "") & F.contains(html, a["id"]) | (F.length(stem) >= MIN_STEM) & F.contains(html, stem))

    return F.filter(attachments, used)


def link_candidates(links: DataFrame, page: str, url: str, pos: str, hosts: list[str], parts: list[str], most: int = MAX_LINKS) -> DataFrame:
    """http(s) links without excluded hosts and fragments, the first of each URL, at most ``most`` a page by position."""
    u = F.col(url)
    kept = links.where(F.lower(u).rlike("^https?://") & ~T.host(u).isin(hosts or [""]))
    for part in parts:
        kept = kept.where(~F.contains(F.lower(u), F.lit(part.lower())))
    first = kept.groupBy(page, url).agg(F.min(pos).alias(pos))
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(page).orderBy(pos))).where(F.col("_r") <= most).drop("_r")


def typed_links(html: Column, extensions: list[str]) -> Column:
    """Targets of a, img and data-file-src with one of the extensions; of equal ones the last stays."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:<a\b[^>]*?href|<img\b[^>]*?src|data-file-src)\s*=\s*\"([^\"]+)\""), 1)
    wanted = F.filter(found, lambda u: T.extension(u).isin(*extensions))
    return F.reverse(F.array_distinct(F.reverse(wanted)))


def article_url(url: Column, title: Column, bad: list[str], stop: list[str], site: Column) -> Column:
    """Whether a link looks like an article: no bad fragment, a title of eight characters that isn't a stop title, the same site."""
    out = ~F.lower(url).rlike(T.pattern_of(*bad)) if bad else F.lit(True)
    return out & (F.length(F.trim(title)) >= 8) & ~F.trim(title).isin(stop or [""]) & T.same_site(url, site)


def merged_attachments(metadata: DataFrame, files: DataFrame, page: str = "page_id") -> DataFrame:
    """Metadata and files of a page joined on lower-case base names; a file's title and path win."""
    m = metadata.select(page, F.lower(T.base_name(F.col("title"))).alias("_k"), F.col("id"), F.col("title").alias("_m"), F.col("download_url"))
    f = files.select(page, F.lower(T.base_name(F.col("path"))).alias("_k"), F.col("title").alias("_f"), F.col("path"))
    return m.join(f, [page, "_k"], "full_outer").select(page, "id", T.first_filled(F.coalesce("_f", F.lit("")), F.coalesce("_m", F.lit(""))).alias("title"), F.col("path").alias("saved_path"), "download_url")


def matched_files(names: DataFrame, attachments: DataFrame, links: DataFrame, page: str = "page_id") -> DataFrame:
    """Each file name with its attachment, else its extracted link, else a stub: (kind, title, url), the first by position."""
    key = lambda c: F.lower(F.trim(c))
    first = lambda df, name, kind: df.groupBy(page, key(F.col(name)).alias("_k")).agg(F.min_by(F.struct(F.lit(kind).alias("kind"), F.col(name).alias("title"), F.col("url").alias("url")), "pos").alias(f"_{kind}"))
    out = names.withColumn("_k", key(F.col("name"))).join(first(attachments, "title", "attachment"), [page, "_k"], "left").join(first(links, "filename", "link"), [page, "_k"], "left")
    stub = F.struct(F.lit("stub").alias("kind"), F.col("name").alias("title"), F.lit(None).cast("string").alias("url"))
    return out.select(page, "name", F.coalesce("_attachment", "_link", stub).alias("m")).select(page, "name", "m.*")


def described(urls: DataFrame, index: DataFrame, url: str = "url") -> DataFrame:
    """Adds description by exact URL, else by lower-case base name. index: url, name, text."""
    by_url = index.where("url is not null").groupBy(F.col("url").alias("_u")).agg(F.max("text").alias("_by_url"))
    by_name = index.where("name is not null").groupBy(F.lower("name").alias("_n")).agg(F.max("text").alias("_by_name"))
    return urls.withColumn("_n", F.lower(T.base_name(F.col(url)))).join(by_url, F.col(url) == F.col("_u"), "left").join(by_name, "_n", "left").withColumn("description", F.coalesce("_by_url", "_by_name")).drop("_n", "_u", "_by_url", "_by_name")


def resources(payloads: DataFrame, group: str) -> DataFrame:
    """Attachments of several payloads as one row each: by lower-case title, else path, else URL; fields filled up, the longest summary kept."""
    rows = payloads.select(group, F.posexplode("attachments").alias("pos", "a")).select(group, "pos", "a.*")
    rows = rows.withColumn("_k", F.coalesce(T.blank_to_null(F.lower("title")), T.blank_to_null(F.col("path")), T.blank_to_null(F.col("url")))).where("_k is not null")
    fill = lambda c: F.min_by(c, F.when(T.strip(F.coalesce(c, F.lit(""))) != "", F.col("pos"))).alias(c)
    longest = F.max_by("summary", F.struct(F.length(F.coalesce("summary", F.lit(""))), -F.col("pos"))).alias("summary")
    return rows.groupBy(group, "_k").agg(fill("title"), fill("path"), fill("url"), longest).drop("_k")


def citation_url(page_url: Column, attachment_url: Column, link_url: Column) -> Column:
    return T.first_filled(F.coalesce(page_url, F.lit("")), F.coalesce(attachment_url, F.lit("")), F.coalesce(link_url, F.lit("")))


def cited_links(links: DataFrame, cited: DataFrame, answer: str = "answer_id") -> DataFrame:
    """Links (answer, doc_no, link) of cited documents (answer, doc_no); those of document 0 count for all cited ones."""
    everywhere = links.where("doc_no = 0").drop("doc_no").join(cited, answer)
    return links.where("doc_no <> 0").join(cited, [answer, "doc_no"], "left_semi").unionByName(everywhere.select(*links.columns)).distinct()


# Markdown, placeholders, markers


class _Markdown(HTMLParser):
    """Collects text with headings, lists, tables and file markers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.rows: list[list[list[str]]] = []
        self.links: list[tuple[str, str]] = []
        self.open_links: list[tuple[str, int]] = []

    def sink(self) -> list[str]:
        return self.rows[-1][-1] if self.rows and self.rows[-1] and isinstance(self.rows[-1][-1], _Cell) else self.out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in _SKIPPED:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "table":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            cell = _Cell()
            cell.span = int(a["colspan"]) if a.get("colspan", "").isdigit() else 1
            self.rows[-1].append(cell)
        elif tag == "tr" and self.rows:
            self.rows[-1].append(_Break())
        elif tag == "img" or "data-file-src" in a:
            source = a.get("data-file-src") or a.get("src", "")
            name = a.get("alt") or source.split("?")[0].rsplit("/", 1)[-1]
            self.sink().append(f"[{name} | {source}]")
        elif re.fullmatch(r"h[1-6]", tag):
            self.sink().append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.sink().append("\n- ")
        elif tag == "a":
            self.open_links.append((a.get("href", ""), len(self.sink())))
        elif tag in _BLOCKS:
            self.sink().append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "table" and self.rows:
            table = markdown_of(self.rows.pop())
            self.sink().append(f"\n{table}\n" if table else "")
        elif tag == "a" and self.open_links:
            url, at = self.open_links.pop()
            text = " ".join("".join(self.sink()[at:]).split())
            if url and text:
                self.links.append((text, url))
        elif tag in _BLOCKS:
            self.sink().append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.sink().append(re.sub(r"\s+", " ", data))


class _Cell(list):
    span = 1


class _Break(list):
    pass


def markdown_of(parts: list) -> str:
    """A table as markdown: line feeds become spaces, pipes are escaped, spans are padded, short rows filled up."""
    rows: list[list[str]] = []
    for p in parts:
        if isinstance(p, _Break):
            rows.append([])
        else:
            if not rows:
                rows.append([])
            rows[-1] += [" ".join("".join(p).split()).replace("|", "\\|")] + [""] * (p.span - 1)
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def markdown(html: Column) -> Column:
    """HTML as markdown with file markers ``[name | source]`` and tables."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: to_markdown(h or ""))

    return run(html)


def replaced_links(html: str, base: str) -> tuple[str, list[dict]]:
    """Text with links as [text], and their absolute URLs in order."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = to_markdown(html)
    found = []
    for label, url in parser.links:
        text = text.replace(label, f"[{label}]", 1) if f"[{label}]" not in text else text
        found.append({"text": label, "url": urljoin(base, quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))})
    return text, found


def content_with_links(html: Column, base: Column) -> Column:
    """struct(text, urls array<struct<text, url>>)."""

    @F.pandas_udf("text string, urls array<struct<text:string,url:string>>")
    def run(h: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replaced_links(x or "", y or "") for x, y in zip(h, b, strict=True)], columns=["text", "urls"])

    return run(html, base)


def fixpoint(text: str, pattern: re.Pattern) -> str:
    """A text without a pattern, removed until nothing changes. Every round but the last shortens the text."""
    while len(shorter := pattern.sub("", text)) < len(text):
        text = shorter
    return text.strip()


def without_nested(text: Column, pattern: str = r"\([^()]*\)") -> Column:
    """Removes matches inside out, such as nested parentheses."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        made = re.compile(pattern)
        return s.map(lambda t: fixpoint(t or "", made))

    return run(text)


def normalised_markers(text: Column) -> Column:
    """Markers ``[name.ext | d]`` labelled by kind: image or document; http markers stay as they are."""
    image = r"(?i)\[((?!https?:)[^\[\]|]+\.(?:png|jpe?g|gif|webp|bmp|svg))\s*\|\s*([^\[\]]*)\]"
    document = r"(?i)\[((?!https?:|image: )[^\[\]|]+\.(?:pdf|docx?|hwp|pptx?|xlsx?|csv|txt|md))\s*\|\s*([^\[\]]*)\]"
    return F.regexp_replace(F.regexp_replace(text, image, "[image: $1 | $2]"), document, "[document: $1 | $2]")


def annotated_urls(docs: DataFrame, index: DataFrame, key: str = "id", text: str = "text", extra: str = "urls") -> DataFrame:
    """key, urls: URLs of the text, then listed ones that occur in it, each with its description; those without one go."""
    rows = docs.select(key, F.posexplode(F.array_distinct(F.concat(T.urls(F.col(text)), F.filter(F.coalesce(extra, F.array()), lambda u: F.contains(F.col(text), u))))).alias("pos", "url"))
    found = described(rows, index).where("description is not null")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "url", "description")))
    return found.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["url"].alias("url"), x["description"].alias("description"))).alias("urls"))


def table_hints(text: Column, cut: int = 2000) -> Column:
    """Markdown tables of a text, each cut."""
    return F.transform(F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(r"((?:^|(?<=\n))(?:\|[^\n]*\|[ \t]*\n){2,})"), 1), lambda t: F.left(T.strip(t), F.lit(cut)))


# Model output, summaries, search texts

SECTIONS = "struct<page_summary:string,sections:array<struct<title:string,summary:string,text:string,child_evidence:array<struct<text:string,keywords:array<string>>>>>>"


def chunked_by_model(raw: DataFrame, key: str = "page_id", text: str = "raw") -> DataFrame:
    """Rows of nested model output: sections, their children, at most ten keywords; children without text go."""
    parsed = raw.select(key, F.from_json(T.json_object(F.col(text)), SECTIONS).alias("o"))
    sections = parsed.select(key, F.col("o.page_summary").alias("page_summary"), F.posexplode_outer("o.sections").alias("section_no", "s"))
    children = sections.select(key, "section_no", T.first_filled(F.coalesce("s.summary", F.lit("")), F.coalesce("page_summary", F.lit(""))).alias("summary"), F.col("s.title").alias("title"), F.posexplode_outer("s.child_evidence").alias("child_no", "c"))
    return children.where(T.strip(F.coalesce("c.text", F.lit(""))) != "").select(key, "section_no", "child_no", "title", "summary", T.strip(F.col("c.text")).alias("text"), F.slice(F.coalesce("c.keywords", F.array().cast("array<string>")), 1, 10).alias("keywords"))


def consolidated(raw: Column, drop: list[str], cut: int = SUMMARY_CHARS) -> Column:
    """Lines without header lines and without the blocks of dropped ``[sections]``; blank lines squeezed, cut."""
    lines = F.split(raw, r"\r?\n")
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        name = F.regexp_extract(line, r"^\s*\[([^\]]+)\]\s*$", 1)
        section = F.when(name != "", name).otherwise(a["section"])
        keep = (name == "") & ~section.isin(drop or [""]) & ~line.rlike(r"^\s*#{1,6}\s")
        return F.struct(section.alias("section"), F.when(keep, F.concat(a["kept"], F.array(line))).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(lines, start, step, lambda a: F.array_join(a["kept"], "\n"))
    return F.left(T.normalised(kept), F.lit(cut))


def numbered_items(text: Column, most: int = 3, cut: int = 50) -> Column:
    """The first numbered items of a text, each cut, joined."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s*(.+)$"), 1)
    return F.array_join(F.slice(F.transform(found, lambda x: F.left(F.trim(x), F.lit(cut))), 1, most), " / ")


def rerank_query(user: Column, focus: Column) -> Column:
    """At most two focus queries and the user's, distinct, cut."""
    return F.left(F.array_join(T.distinct_folded(F.concat(F.slice(focus, 1, 2), F.array(user))), " "), F.lit(RERANK_QUERY))


def rerank_passage(section: Column, body: Column) -> Column:
    return F.left(F.concat(F.when(T.strip(F.coalesce(section, F.lit(""))) != "", F.concat(F.lit("["), section, F.lit("] "))).otherwise(""), body), F.lit(RERANK_PASSAGE))


def retrieval_specs(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """One row a query: direct, policy (each filled from the other, then from the question), or the legacy list."""
    clean = lambda c: T.collapsed(F.coalesce(c, F.lit("")))
    direct, policy = T.first_filled(clean("direct"), clean("policy"), clean("question")), T.first_filled(clean("policy"), clean("direct"), clean("question"))
    pair = F.array(F.struct(F.lit("direct").alias("role"), F.left(direct, F.lit(400)).alias("query")), F.struct(F.lit("policy").alias("role"), F.left(policy, F.lit(400)).alias("query")))
    legacy = F.transform(F.filter(F.coalesce("legacy", F.array().cast("array<string>")), lambda q: T.strip(q) != ""), lambda q, i: F.struct(F.concat(F.lit("q_"), i.cast("string")).alias("role"), F.left(T.collapsed(q), F.lit(400)).alias("query")))
    given = (clean("direct") != "") | (clean("policy") != "")
    return rows.select(key, F.posexplode(F.when(~given & (F.size(legacy) > 0), legacy).otherwise(pair)).alias("query_no", "s")).select(key, "query_no", "s.role", "s.query")


def planner_pages(plan: DataFrame, hits: DataFrame, key: str = "request_id") -> DataFrame:
    """Page ids that a plan names and the hits have, in the plan's order; all pages of the hits if none is left."""
    pages = hits.groupBy(key).agg(F.array_sort(F.collect_set("page_id")).alias("_all"))
    both = plan.join(pages, key, "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<string>")))
    named = F.filter(F.array_distinct(F.coalesce("page_ids", F.array().cast("array<string>"))), lambda p: F.array_contains("_all", p))
    return both.select(key, F.when(F.size(named) > 0, named).otherwise(F.col("_all")).alias("page_ids"))


def evidence_scores(query: Column, text: Column) -> Column:
    """How many distinct query tokens of two characters or more a text contains."""
    tokens = F.filter(F.array_distinct(T.terms(query)), lambda t: F.length(t) >= 2)
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t)))


def section_order(id_: Column) -> Column:
    """The five-digit order inside a chunk id."""
    return F.nullif(F.regexp_extract(id_, r":(\d{5}):", 1), F.lit("")).cast("int")


def parsed_lines(text: Column, keys: list[str]) -> Column:
    """``key: value`` lines of a text as a map, for the given keys."""
    pairs = F.regexp_extract_all(text, F.lit(rf"(?mi)^\s*({'|'.join(map(re.escape, keys))})\s*:\s*(.*)$"), 0)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v"))))
