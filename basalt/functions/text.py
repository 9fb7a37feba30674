"""String expressions: normalisation, keys, tokens, URLs, markers, citations and tagged answers.

All are Column -> Column and stay in the JVM. Missing text is the empty string unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and word lists that results depend on.
CJK_OR_LATIN_PHRASE = r"[가-힣A-Za-z]{2,20}"
TOPIC_TOKEN = r"[가-힣]{2,}|[a-z0-9]{3,}"
URL = r"https?://[^\s<>\"')\]]+"
FILE_MARKER = r"\[([^\[\]|]+\.[A-Za-z0-9]{2,5})\s*\|\s*([^\[\]]*)\]"


def literal_any(terms: list[str]) -> str:
    """A case-insensitive pattern that matches any of the terms literally."""
    return "(?i)" + "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_filled(*columns: Column) -> Column:
    """The first value that isn't blank; '' if all are."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def normalised(c: Column) -> Column:
    """CRLF to LF, runs of spaces and tabs to one space, three or more line feeds to two, ends trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def collapsed(c: Column) -> Column:
    """Every run of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def folded(c: Column) -> Column:
    """A key for comparing without case and spacing (lower case; ß and İ stay as they are)."""
    return F.lower(collapsed(c))


def same_folded(a: Column, b: Column) -> Column:
    """Both filled, and equal after trimming, without case."""
    return (strip(a) != "") & (F.lower(strip(a)) == F.lower(strip(b)))


def title_key(c: Column) -> Column:
    """Lower case without bracketed parts, separators and anything that isn't a word character."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), r"(?U)[^\w]+|_", ""))


def slug(c: Column, n: int = 90, default: str = "untitled") -> Column:
    made = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w]+", "_"), r"^_+|_+$", "")
    return F.when(made == "", F.lit(default)).otherwise(F.left(made, F.lit(n)))


def safe_segment(c: Column, n: int = 80) -> Column:
    """A path segment: reserved characters become spaces, runs of spaces one, cut to n."""
    return F.trim(F.left(collapsed(F.regexp_replace(c, r'[\\/:*?"<>|#%]', " ")), F.lit(n)))


def upload_path(category: Column, day: Column, user: Column, title: Column, extension: Column) -> Column:
    """category/day/user/title.ext with every segment percent-encoded (a space is %20)."""
    encode = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    return F.concat_ws("/", encode(safe_segment(category)), encode(day), encode(safe_segment(user, 40)), encode(F.concat(safe_segment(title), extension)))


def cell(c: Column) -> Column:
    """A value for a table cell: line feeds become spaces, pipes slashes."""
    return F.trim(F.translate(F.regexp_replace(c, r"\s*\r?\n\s*", " "), "|", "/"))


def base_name(c: Column) -> Column:
    """The file's name: text before a pipe, query dropped, last path segment."""
    c = F.regexp_replace(F.trim(F.element_at(F.split(c, r"\|"), 1)), r"[?#].*$", "")
    return F.element_at(F.split(c, r"[\\/]"), -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r"\.[^.]+$", 0))


FILE_CLASSES = {
    "document": [".pdf", ".doc", ".docx", ".hwp", ".ppt", ".pptx", ".xls", ".xlsx", ".csv", ".txt", ".md"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg"],
    "skip": [".zip", ".mp4", ".mov", ".avi", ".exe", ".7z", ".tar", ".gz"],
}


def file_class(name: Column) -> Column:
    """document, image, skip or other, by extension."""
    ext = extension(name)
    out = None
    for kind, values in FILE_CLASSES.items():
        out = F.when(ext.isin(values), kind) if out is None else out.when(ext.isin(values), kind)
    return out.otherwise("other")


def url_key(c: Column) -> Column:
    """http(s) URLs without fragment, path and query decoded and in lower case; '' for anything else."""
    bare = F.regexp_replace(F.trim(c), r"#.*$", "")
    return F.when(F.lower(bare).rlike(r"^https?://"), F.lower(F.coalesce(F.try_url_decode(bare), bare))).otherwise("")


def host(c: Column) -> Column:
    """The host in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^(?i)https?://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    x, y = host(a), host(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def phrases(c: Column, stop: list[str] | None = None, limit: int = 12) -> Column:
    """Distinct phrases of 2 to 20 letters in order, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({CJK_OR_LATIN_PHRASE})"), 1))
    return F.slice(F.filter(found, lambda w: ~F.lower(w).isin(stop or [""])), 1, limit)


def topic_tokens(c: Column, stop: list[str] | None = None) -> Column:
    """The distinct topic tokens of a text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({TOPIC_TOKEN})"), 1))
    return F.filter(found, lambda w: ~w.isin(stop or [""]))


def terms(c: Column) -> Column:
    """Search terms: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(folded(text), F.lower(w)))


def matched(text: Column, words: list[str]) -> Column:
    """The entries of a list that a text contains; entries that occur twice in the list count twice."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(folded(text), folded(w)))


def truncated(c: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def title_path(titles: Column, separator: str = " > ") -> Column:
    """Titles joined, consecutive repeats once."""
    kept = F.aggregate(titles, F.array().cast("array<string>"), lambda a, t: F.when((t == "") | (F.element_at(F.concat(F.array(F.lit("")), a), -1) == t), a).otherwise(F.concat(a, F.array(t))))
    return F.array_join(kept, separator)


def distinct_folded(values: Column) -> Column:
    """Values without blanks and without those equal to an earlier one but for case and spacing."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda a, v: F.when((strip(v) == "") | F.exists(a, lambda x: folded(x) == folded(v)), a).otherwise(F.concat(a, F.array(strip(v)))))


def joined_filled(separator: str, *columns: Column) -> Column:
    """The parts that aren't blank, joined."""
    return F.concat_ws(separator, F.filter(F.array(*columns), lambda x: strip(x) != ""))


def urls(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({URL})"), 1), lambda u: F.regexp_replace(u, r"[.,;:]+$", "")))


def file_markers(c: Column) -> Column:
    """Distinct lower-case file names of the markers ``[name.ext | description]``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(FILE_MARKER), 1), lambda n: F.lower(F.trim(n))))


def without_marks(c: Column, pattern: str) -> Column:
    """Text without every match of a pattern, spacing tidied."""
    return normalised(F.regexp_replace(c, pattern, ""))


def citations(answer: Column, n_docs: Column) -> Column:
    """Numbers in square brackets in order of first use, those between 1 and n_docs."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,4})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n_docs)))


def renumbered(used: Column) -> Column:
    """Used numbers mapped to 1, 2, ... in their order."""
    return F.map_from_arrays(used, F.transform(used, lambda x, i: i + 1))


def tag_bodies(c: Column, tag: str) -> Column:
    """What stands between each pair of tags, trimmed."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1), strip)


def answer_text(raw: Column) -> Column:
    """The answer bodies joined; the raw text without tags if there are none."""
    bodies = F.filter(tag_bodies(raw, "answer"), lambda x: x != "")
    return F.when(F.size(bodies) > 0, F.array_join(bodies, "\n\n")).otherwise(strip(F.regexp_replace(raw, r"(?s)<(sources_used|attachments_used|links_used)>.*?</\1>|</?answer>", "")))


def numbers_used(raw: Column, tag: str, n: Column) -> Column:
    """Distinct numbers of a tag's body between 1 and n, in order."""
    found = F.regexp_extract_all(F.array_join(tag_bodies(raw, tag), ","), F.lit(r"(\d+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: (x >= 1) & (x <= n)))


def links_used(raw: Column) -> Column:
    """``d:l,l;d:l`` of the tag links_used as a map from document to link numbers."""
    pairs = F.regexp_extract_all(F.array_join(tag_bodies(raw, "links_used"), ";"), F.lit(r"(\d+\s*:\s*\d+(?:\s*,\s*\d+)*)"), 1)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.transform(F.split(F.regexp_extract(p, r":\s*(.*)$", 1), r"\s*,\s*"), lambda x: x.cast("int")))))


def safe_prefix(c: Column) -> Column:
    """A streamed text without a tail that may be the start of a tag."""
    return F.regexp_replace(c, r"<[^>]*$", "")


def json_object(c: Column) -> Column:
    """The JSON object in a text: out of a fence, or from the first to the last brace; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def json_array(c: Column, *keys: str) -> Column:
    """The JSON array in a text: the array itself, one under a key of an object, or a single object as an array."""
    whole = F.nullif(F.regexp_extract(c, r"(?s)^[^\[{]*(\[.*\])[^\]}]*$", 1), F.lit(""))
    object_ = json_object(c)
    return F.coalesce(whole, *[F.get_json_object(object_, f"$.{k}") for k in keys], F.concat(F.lit("["), object_, F.lit("]")))


def conversation_key(*parts: Column) -> Column:
    """Parts joined by colons, '-' for what is missing."""
    return F.concat_ws(":", *[F.coalesce(blank_to_null(p), F.lit("-")) for p in parts])


def html_text(html: Column) -> Column:
    """Text of simple HTML: script and style dropped, tags become line feeds, common references decoded, lines trimmed,
    blank lines and lines equal to the one before dropped."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), lambda x: x != "")
    # The lines are bound once: an expression that each element looks at would be computed for each element.
    once = lambda ls: F.filter(ls, lambda x, i: (i == 0) | (x != F.get(ls, F.greatest(i - 1, F.lit(0)))))
    return F.array_join(F.get(F.transform(F.array(lines), once), F.lit(0)), "\n")


def links(html: Column) -> Column:
    """href values of a page in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?href=\"([^\"]*)\""), 1))


def uuid_like(c: Column) -> Column:
    return F.lower(c).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def pattern_of(*alternatives: str) -> str:
    """Alternatives of a regular expression, each taken literally."""
    return "|".join(map(re.escape, alternatives))
