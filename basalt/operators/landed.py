"""What others have fetched and landed: responses, pages of listings, captures, files; and rules around calls and files."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from .numbering import numbered

OFFSET_PAGE = 50
# Words of links that are no names, folders of a notice's files, names that a scan skips.
LINK_WORDS = ("바로보기", "다운로드", "새창열림", "보기")
FOLDERS = {"공고문": "공고문_및_요약", "신청양식": "신청양식_및_참고자료"}
SKIPPED_FILES = ("공고안내_상세요약.txt", "meta.json")
MONTH_CLASS, DAY_CLASS = "c-fQnhbx", "c-gNZGXI"
WEEKEND = ("토", "일")
NO_SUMMARY = "정형외과 AI SaMD/의료기기 사업과 연관 가능한 뉴스입니다."
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif")


# Responses and listings


def fetched(status: Column, body: Column) -> Column:
    """The body of a response; null for a status of 400 and above, or none."""
    return F.when(status < 400, body)


def offset_pages(rows: DataFrame, key: str, page: str, size: int = OFFSET_PAGE) -> DataFrame:
    """Rows of listings that were fetched page by page: up to the first page that is short or missing, as a reader would stop there."""
    sizes = rows.groupBy(key, page).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(key).orderBy(page)
    full = F.min(((F.col("_n") >= size) & (F.col(page) == F.row_number().over(by) - 1)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    read = sizes.withColumn("_place", F.row_number().over(by) - 1).withColumn("_read", (F.coalesce(full, F.lit(1)) == 1) & (F.col(page) == F.col("_place"))).where("_read")
    return rows.join(read.select(key, page), [key, page], "left_semi")


def crawled(rows: DataFrame, url: str = "url", title: str = "title", most_pages: int | None = None, page: str = "page_no", pos: str = "pos") -> DataFrame:
    """Items of landed result pages: those with a title and an address, of the first pages, each address once, the first."""
    rows = rows.where(F.col(page) <= most_pages) if most_pages else rows
    rows = rows.withColumn("_key", T.url_key(F.col(url))).where((T.strip(F.coalesce(F.col(title), F.lit(""))) != "") & (F.col("_key") != ""))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(page, pos))).where("_r = 1").drop("_key", "_r")


def calendar_view(events: DataFrame, details: DataFrame, first: Column, end: Column, private: str = "private") -> DataFrame:
    """Events that touch [first, end); the subject of private ones is that of their details, if there are any."""
    inside = events.where((F.col("first") < end) & (F.col("last") > first))
    known = details.select(F.col("event_id").alias("_id"), F.col("subject").alias("_subject"))
    out = inside.join(known, (F.col("event_id") == F.col("_id")) & F.col(private), "left")
    return out.withColumn("subject", F.coalesce("_subject", "subject")).drop("_id", "_subject")


# Names of files


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header, decoded; '' without one."""
    found = lambda pattern: T.blank_to_null(F.regexp_extract(header, pattern, 1))
    after = F.substring_index(found(r"(?i)filename\*=([^;]+)"), "''", -1)
    name = F.coalesce(found(r"(?i)filename\*=UTF-8''(.+?)(?:;|$)"), after, found(r'(?i)filename="?([^";]+)"?'))
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name, F.lit(""))


def repaired(name: Column) -> Column:
    """A name whose bytes were taken for Latin-1, as the text that they are; others, and names with a percent sign, stay."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        def one(v):
            if not v or "%" in v:
                return v
            for encoding in ("utf-8", "cp949"):
                try:
                    fixed = v.encode("latin-1").decode(encoding)
                except (UnicodeDecodeError, UnicodeEncodeError):
                    continue
                if fixed != v:
                    return fixed
            return v

        return names.map(one)

    return run(name)


def safe_name(name: Column) -> Column:
    """A name without characters that file systems forbid."""
    clean = F.trim(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))
    return F.when(clean == "", "unnamed_file").otherwise(clean)


def extension_of(content_type: Column) -> Column:
    """The extension that a media type suggests."""
    has = lambda *words: content_type.rlike("|".join(words))
    return F.when(has("pdf"), ".pdf").when(has("hwp"), ".hwp").when(has("spreadsheet", "excel"), ".xlsx").when(has("zip"), ".zip").when(has("jpeg", "jpg"), ".jpg").when(has("text/plain"), ".txt").otherwise(".bin")


def file_name(hint: Column, header: Column, content_type: Column, url: Column) -> Column:
    """A name to store a download by: a hint with an extension, the header's name, any hint, else a hash of the address."""
    hint, named = repaired(safe_name(F.coalesce(hint, F.lit("")))), repaired(safe_name(disposition_name(F.coalesce(header, F.lit("")))))
    fine = lambda n: ~n.isin(*LINK_WORDS, "unnamed_file")
    made = F.concat(F.lit("attachment_"), F.left(F.md5(url), F.lit(8)), extension_of(F.coalesce(content_type, F.lit(""))))
    name = F.when(fine(hint) & F.contains(hint, F.lit(".")), hint).when(fine(named), named).when(fine(hint), hint).otherwise(made)
    ending = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    stem = F.left(name, F.length(name) - F.length(ending))
    return F.when(F.length(name) > 120, F.concat(F.left(stem, F.lit(100)), ending)).otherwise(name)


# Signatures, scores, vectors


def signed(body: Column, secret: str, header: Column) -> Column:
    """Whether ``algorithm=hex`` is the keyed digest (sha256 or sha1) of a body. The digest is made of built-in hashes."""
    key = secret.encode()

    def digest(kind: str) -> Column:
        import hashlib

        k = (hashlib.new(kind, key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in k).hex()))
        hashed = (lambda c: F.sha2(c, 256)) if kind == "sha256" else F.sha1
        return hashed(F.concat(pad(0x5C), F.unhex(hashed(F.concat(pad(0x36), body.cast("binary"))))))

    head = F.trim(F.coalesce(header, F.lit("")))
    kind, given = F.lower(F.trim(F.substring_index(head, "=", 1))), F.trim(F.substring(head, F.instr(head, "=") + 1, F.lit(1 << 20)))
    if not secret:
        return F.lit(False)
    return F.coalesce(F.when(kind == "sha256", given == digest("sha256")).when(kind == "sha1", given == digest("sha1")), F.lit(False))


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def unit(vector: Column) -> Column:
    """A vector of length one; a vector of zeros stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


# Limits of calls, batches in time, schedules


def allowed_calls(calls: DataFrame, most: int = 3, request: str = "request_id", pos: str = "pos", write: str = "is_write") -> DataFrame:
    """Adds ``executed``: of each request's calls in order, the first ``most`` that may run; of writes only the first one may."""
    by = Window.partitionBy(request).orderBy(pos)
    may = ~F.col(write) | (F.sum(F.col(write).cast("int")).over(by) == 1)
    out = calls.withColumn("_may", may)
    return out.withColumn("executed", F.col("_may") & (F.sum(F.col("_may").cast("int")).over(by) <= most)).drop("_may")


def joined_results(results: DataFrame, request: str = "request_id", domain: str = "domain", pos: str = "pos", text: str = "result") -> DataFrame:
    """One text for each request and domain: its results in order, by empty lines."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return results.groupBy(request, domain).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("results"))


def due_daily(now: Column, clock: str, last_day: Column) -> Column:
    """Whether a daily run is due: its time of day has come, and it hasn't run on this day."""
    hours, minutes = map(int, clock.split(":"))
    today = F.to_date(now)
    come = F.hour(now) * 60 + F.minute(now) >= 60 * hours + minutes
    return come & (last_day.isNull() | (last_day < today))


# Files of notices


def file_entries(notices: DataFrame, files: DataFrame, base_url: str, category: str | None = None) -> DataFrame:
    """notice_idx, category, title, download_url of each notice's files, each address once.

    ``notices``: idx, day, archive (its folder), indexed (map of category to paths). ``files``: path. Indexed paths that
    exist count in their order; a category without any is its folder below the archive, by name without case.
    """
    wanted = [c for c in FOLDERS if category in (None, "", "전체", c)]
    there = files.select(F.col("path").alias("_path")).distinct()
    each = notices.select("idx", "day", "archive", "indexed", F.explode(F.array(*map(F.lit, wanted))).alias("category")) if wanted else notices.limit(0).withColumn("category", F.lit(""))
    indexed = each.select("idx", "day", "category", F.posexplode(F.coalesce(F.try_element_at("indexed", F.col("category")), F.array().cast("array<string>"))).alias("pos", "path"))
    indexed = indexed.join(there, F.col("path") == F.col("_path"), "left_semi").select("idx", "day", "category", "path", F.col("pos").cast("string").alias("_order"), F.col("pos").alias("_pos"))
    folder = F.concat("archive", F.lit("/"), F.element_at(F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair]), F.col("category")))
    # Files meet folders by equality, at every folder above them.
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("_path", "/")) - 1), lambda n: F.call_function("substring_index", F.col("_path"), F.lit("/"), n))
    scanned = each.join(indexed.select("idx", "category").distinct(), ["idx", "category"], "left_anti").withColumn("_folder", folder)
    scanned = scanned.join(there.withColumn("_above", F.explode(above)), F.col("_folder") == F.col("_above")).withColumn("path", F.col("_path"))
    scanned = scanned.where(~T.base_name(F.col("path")).isin(*SKIPPED_FILES)).select("idx", "day", "category", "path", F.lower(T.base_name(F.col("path"))).alias("_order"), F.lit(0).alias("_pos"))
    out = indexed.unionByName(scanned).withColumn("title", T.base_name(F.col("path")))
    out = out.withColumn("download_url", F.concat_ws("/", F.lit(base_url), "day", "idx", F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20"))))
    rank = F.when(F.col("category") == next(iter(FOLDERS)), 0).otherwise(1)
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("idx", "download_url").orderBy(rank, "_pos", "_order", "path"))).where("_r = 1")
    place = F.row_number().over(Window.partitionBy("idx").orderBy(rank, "_pos", "_order", "path"))
    return out.select(F.col("idx").alias("notice_idx"), "category", "title", "download_url", place.alias("position"))


def served_file(asked: Column, archive: Column, path: Column) -> Column:
    """Whether a stored path answers a request for a file of an archive: the same base name in one of its two folders; names with .. never."""
    raw = F.replace(F.trim(F.coalesce(asked, F.lit(""))), F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(raw, "/"), -1)
    below = F.greatest(*[F.startswith(path, F.concat(archive, F.lit(f"/{f}/"))) for f in FOLDERS.values()])
    return (base != "") & ~F.array_contains(F.split(raw, "/"), "..") & ~F.array_contains(F.split(path, "/"), "..") & below & (F.element_at(F.split(path, "/"), -1) == base)


def enriched(notices: DataFrame, order: Column, sections: dict[str, str], name: str = "name") -> DataFrame:
    """Adds idx by order from 1, and ``detail``: the filled sections of a notice below their names in brackets."""
    parts = [F.when(T.strip(F.coalesce(F.col(c), F.lit(""))) != "", F.concat(F.lit(f"[{title}]\n"), T.strip(F.col(c)))) for title, c in sections.items()]
    return numbered(notices, order, F.col(name), name="idx").withColumn("detail", F.concat_ws("\n\n", *parts))


def local_pages(files: DataFrame, extra: DataFrame | None = None, root: str = "added_attachments") -> DataFrame:
    """page_id, title, page_url, body_text, attachments of pages made of files in folders named after them.

    ``extra`` (page_id, title, body_text, page_url) fills what it has. The default body lists the first eight names.
    """
    found = files.select(F.regexp_extract("path", rf"(?:^|/){re.escape(root)}/([^/]+)/([^/]+)$", 1).alias("page_id"), T.base_name(F.col("path")).alias("name"), "path").where("page_id <> ''")
    ending = F.lower(F.regexp_extract("name", r"[^.](\.[^.]*)$", 1))
    item = F.struct("name", ending.alias("extension"), F.when(ending.isin(*IMAGES), "image").otherwise("file").alias("media_type"), "path")
    pages = found.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("attachments"))
    names = F.array_join(F.slice(F.transform("attachments", lambda a: a["name"]), 1, 8), ", ")
    body = F.concat(F.lit("로컬 추가 첨부 ("), F.size("attachments").cast("string"), F.lit("개): "), names)
    given = extra.select("page_id", *[F.col(c).alias(f"_{c}") for c in ("title", "body_text", "page_url")]) if extra is not None else pages.limit(0).select("page_id", *[F.lit("").alias(f"_{c}") for c in ("title", "body_text", "page_url")])
    out = pages.join(given, "page_id", "left")
    filled = lambda c, default: F.coalesce(T.blank_to_null(F.col(f"_{c}")), default).alias(c)
    return out.select("page_id", filled("title", F.concat(F.lit("로컬 첨부 page "), F.col("page_id"))), filled("page_url", F.concat(F.lit(f"local://{root}/"), F.col("page_id"))), filled("body_text", body), "attachments")


# Texts of articles


def article_text(title: Column, body: Column) -> Column:
    """Title and body on one line."""
    return T.collapsed(F.concat_ws(" ", F.coalesce(title, F.lit("")), T.strip(F.coalesce(body, F.lit("")))))


def numbered_lines(articles: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """key, lines: each group's articles as numbered lines in order, with category and summary (80 characters) where filled."""
    flat = lambda c: T.collapsed(F.coalesce(F.col(c), F.lit("")))
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f" | {name}="), c)).otherwise("")
    line = F.concat(F.lit("title="), flat("title"), F.lit(" | url="), flat("url"), part("category", flat("category")), part("summary", F.left(flat("summary"), F.lit(80))))
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("t"))))
    return articles.groupBy(key).agg(F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n").alias("lines"))


def fallback_summary(body: Column) -> Column:
    """The first 70 characters of a body, or a fixed sentence."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.left(body, F.lit(70)), F.lit("..."))).otherwise(NO_SUMMARY)


def target_day(given: Column, now: Column) -> Column:
    """A given day, else the day before now."""
    return F.coalesce(F.to_date(given), F.date_sub(F.to_date(now), 1))


# Plans of a search


def with_year(query: Column, year: Column) -> Column:
    """A query with the year that a question is about, unless it names one."""
    q = T.strip(F.coalesce(query, F.lit("")))
    return F.when((q == "") | year.isNull() | q.rlike(r"20\d{2}"), q).otherwise(F.concat(q, F.lit(" "), year.cast("string"), F.lit("년")))


def search_plan(plans: DataFrame, hits: DataFrame, now: Column, stop: list[str], key: str = "request_id", most: int = 400) -> DataFrame:
    """Adds ``final`` = struct(decision, page_ids, direct, policy, missing): a planner's decision as it is carried out.

    ``plans``: decision, page_ids, direct, policy, missing, parsed, question. ``hits``: page_id, hinted, snippet. What couldn't be
    parsed is answerable. An expansion keeps the pages that were hit, else takes all of them. Queries of an outer search
    stand in for each other, get the question's year, and are cut. An answerable plan becomes an expansion of hinted
    pages if a word of the question is in no snippet.
    """
    page = lambda c: F.when(T.strip(F.coalesce(c, F.lit(""))) != "", T.strip(c))
    found = hits.groupBy(key).agg(F.array_sort(F.collect_set(page(F.col("page_id")))).alias("_all"), F.array_sort(F.collect_set(F.when(F.col("hinted"), page(F.col("page_id"))))).alias("_hinted"), F.array_join(F.collect_list("snippet"), " ").alias("_text"))
    none = F.array().cast("array<string>")
    rows = plans.join(found, key, "left").withColumn("_all", F.coalesce("_all", none)).withColumn("_hinted", F.coalesce("_hinted", none)).withColumn("_text", F.coalesce("_text", F.lit("")))
    named = F.filter(F.coalesce("page_ids", none), lambda p: F.array_contains("_all", p))
    filled = lambda a, b: F.coalesce(T.blank_to_null(F.col(a)), T.blank_to_null(F.col(b)), F.lit(""))
    direct, policy = filled("direct", "policy"), filled("policy", "direct")
    year = F.greatest(*[D.reference_year(F.coalesce(c, F.lit("")), now) for c in (F.col("question"), direct, policy)])
    focus = F.filter(T.phrases(F.col("question"), stop), lambda w: ~F.contains(F.col("_text"), w))
    expands = (F.col("decision") == "answerable") & (F.size("_hinted") > 0) & (F.size(focus) > 0)
    missing = F.coalesce("missing", none)
    plan = lambda d, p, a, b, m: F.struct(F.lit(d).alias("decision") if isinstance(d, str) else d.alias("decision"), p.alias("page_ids"), a.alias("direct"), b.alias("policy"), m.alias("missing"))
    empty = F.lit("")
    cut = lambda q: F.left(with_year(q, year), F.lit(most))
    final = (
        F.when(~F.col("parsed"), plan("answerable", none, empty, empty, missing))
        .when(F.col("decision") == "need_parent_expansion", plan("need_parent_expansion", F.when(F.size(named) > 0, named).otherwise(F.col("_all")), empty, empty, missing))
        .when(F.col("decision") == "need_external_search", plan("need_external_search", none, cut(direct), cut(policy), missing))
        .when(expands, plan("need_parent_expansion", F.col("_hinted"), empty, empty, focus))
        .otherwise(plan(F.col("decision"), F.coalesce("page_ids", none), F.coalesce("direct", empty), F.coalesce("policy", empty), missing))
    )
    return rows.withColumn("final", final).drop("_all", "_hinted", "_text")


# Grids of attendance


def layout(html: Column, url: Column) -> Column:
    """monthly or daily, by the address, then by marks in the page."""
    month = F.contains(html, F.lit(MONTH_CLASS))
    day = F.contains(html, F.lit(DAY_CLASS))
    monthly = F.contains(html, F.lit("period=monthly")) | (month & ~day) | html.rlike(rf'data-role="header-row-cell"|class="[^"]*\b{MONTH_CLASS}\b')
    return F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("period=monthly")), "monthly").when(monthly, "monthly").when(day, "daily").otherwise("daily")


class _Grid(HTMLParser):
    """Cells of a month's head and people of its rows."""

    def __init__(self):
        super().__init__()
        self.open: list[dict] = []
        self.heads: list[dict] = []
        self.people: list[dict] = []
        self.corner, self.label, self.links = "", "", []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        role = a.get("data-role", "")
        if role == "header-row-cell" and "period-monthly" in a.get("class", ""):
            self.heads.append({"spans": [], "classes": a.get("class", "")})
        elif role == "header-column-cell":
            self.people.append({"name": "", "role": "", "record_id": "", "uid": ""})
        if self.heads and any(o["role"] == "header-row-cell" for o in self.open) and "isWeekend" in a.get("class", ""):
            self.heads[-1]["classes"] += " " + a["class"]
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
            if self.people and any(o["role"] == "header-column-cell" for o in self.open):
                record, uid = re.search(r"/work-record/([^?/#]+)", a["href"]), re.search(r"[?&]user_profile_uid=([^&#]+)", a["href"])
                if record:
                    self.people[-1] |= {"record_id": record[1], "uid": uid[1] if uid else ""}
        self.open.append({"tag": tag, "role": role, "part": a.get("data-part", ""), "class": a.get("class", "")})

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text:
            return
        roles = {o["role"] for o in self.open}
        if "header-row-cell" in roles and self.heads and any(o["tag"] == "span" for o in self.open):
            self.heads[-1]["spans"].append(text)
        if "corner-cell" in roles:
            self.corner += text + " "
        if any("periodType-monthly" in o["class"] for o in self.open):
            self.label += text + " "
        if "header-column-cell" in roles and self.people:
            part = self.open[-1]["part"]
            if part in ("title", "subtext"):
                self.people[-1]["name" if part == "title" else "role"] += text


def month_grid(html: str | None, year_now: int) -> dict:
    """year_month, days (day, weekday, date, is_weekend) and people of a landed month page.

    The month is that of the navigation's label, else of an address in the page, else the corner's with the year given.
    """
    grid = _Grid()
    grid.feed(html or "")
    grid.close()
    label = re.search(r"(20\d{2})\s*[년.\-/]\s*(\d{1,2})", grid.label)
    address = re.search(r"date=(\d{4})-(\d{2})-\d{2}", entities.unescape(html or ""))
    corner = re.search(r"(\d{1,2})\s*월", grid.corner)
    year, month = (int(label[1]), int(label[2])) if label else (int(address[1]), int(address[2])) if address else (year_now, int(corner[1])) if corner else (None, None)
    days = []
    for head in grid.heads:
        if head["spans"] and head["spans"][0].isdigit():
            day, weekday = int(head["spans"][0]), head["spans"][1] if len(head["spans"]) > 1 else None
            days.append({"day": day, "weekday": weekday, "date": f"{year:04d}-{month:02d}-{day:02d}" if year and month else None, "is_weekend": "isWeekend-true" in head["classes"] or weekday in WEEKEND})
    return {"year_month": f"{year:04d}-{month:02d}" if year and month else None, "days": days, "people": grid.people}


GRID = "struct<year_month:string,days:array<struct<day:int,weekday:string,date:string,is_weekend:boolean>>,people:array<struct<name:string,role:string,record_id:string,uid:string>>>"


def month_grids(pages: DataFrame, year_now: int, html: str = "html", name: str = "grid") -> DataFrame:
    """Adds the grid of each landed month page."""

    @F.pandas_udf(GRID)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([month_grid(h, year_now) for h in s], columns=["year_month", "days", "people"])

    return pages.withColumn(name, run(F.col(html)))
