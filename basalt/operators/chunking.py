"""Chunking and page assembly: splitters as Arrow-batched functions, ids, hierarchy, embedding text, tables.

The splitters are plain functions on one text (tested as such); the DataFrame functions run them in pandas UDFs, because
cutting at the last suitable edge before a limit is a loop that built-in expressions don't have.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Chunk sizes and overlaps.
SIZE, OVERLAP = 2500, 250
PARENT_POLICY = (1000, 1500, 150)
CHILD_POLICY = (450, 700, 0)
EMBED_CHARS = 6000
_TABLE = re.compile(r"(?m)^(?:\|.*\|[ \t]*(?:\n|\Z)){2,}")


def pack_paragraphs(text: str, size: int = SIZE, overlap: int = OVERLAP, separator: str = "\n\n") -> list[str]:
    """A short text is one chunk. Paragraphs are packed while they fit; one that is too long is cut every size - overlap."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    held = ""
    for paragraph in filter(None, (p.strip() for p in text.split(separator))):
        joined = f"{held}{separator}{paragraph}" if held else paragraph
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
            held = ""
        if len(paragraph) <= size:
            held = paragraph
        else:
            out += [paragraph[k : k + size] for k in range(0, len(paragraph), size - overlap)]
    return out + ([held] if held else [])


def fixed_pieces(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of ``size`` every size - overlap characters, as a built-in expression."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))))


def blocks(text: str) -> list[tuple[str, bool]]:
    """Runs of text, and tables (True), in order."""
    out, at = [], 0
    for m in _TABLE.finditer(text):
        out += [(text[at : m.start()], False), (m.group(), True)]
        at = m.end()
    return [(b, t) for b, t in [*out, (text[at:], False)] if b.strip()]


def edge(text: str, limit: int, least: int = 0) -> int:
    """Where to cut before a limit: after the last blank line, line feed or space, in this order, else at the limit."""
    for mark in ("\n\n", "\n", " "):
        k = text.rfind(mark, max(1, least), limit)
        if k > 0:
            return k + len(mark)
    return limit


def split_by_policy(text: str, target: int, hard: int, overlap: int = 0) -> list[str]:
    """Pieces of about ``target`` characters and at most ``hard``; tables stay whole."""
    out: list[str] = []
    for block, table in blocks(text):
        if table:
            out.append(block.strip())
            continue
        rest = block.strip()
        while len(rest) > hard:
            k = edge(rest, target, target // 2)
            out.append(rest[:k].strip())
            rest = rest[max(1, k - overlap) :].strip() if overlap and k > overlap else rest[k:].strip()
        if rest:
            out.append(rest)
    return [p for p in out if p]


def split_attachment(text: str, size: int = 2000, overlap: int = 200) -> list[str]:
    """Pieces with the tail of the one before put first, unless it is there already; tables stay whole."""
    pieces = split_by_policy(text, size, size)
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        tail = before[-overlap:]
        out.append(piece if piece.startswith(tail) else f"{tail}\n{piece}")
    return out


def budget_split(text: str, most: int = 15000) -> list[str]:
    """Parts of at most ``most`` characters, cut at paragraph, line or table edges."""
    out, held = [], ""
    for block, table in blocks(text):
        for part in [block] if table else re.split(r"(?<=\n\n)", block):
            while len(part) > most:
                k = edge(part, most)
                if held:
                    out.append(held)
                    held = ""
                out.append(part[:k])
                part = part[k:]
            if len(held) + len(part) > most:
                out.append(held)
                held = ""
            held += part
    return [p.strip() for p in [*out, held] if p.strip()]


def _udf(f, *args):
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: f(t or "", *args))

    return run


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, separator: str = "\n\n") -> DataFrame:
    """key, chunk_no, n_chunks, chunk, chunk_hash of every packed chunk."""
    parts = _udf(pack_paragraphs, size, overlap, separator)(F.col(text))
    rows = docs.select(key, parts.alias("parts")).withColumn("n_chunks", F.size("parts"))
    return rows.select(key, "n_chunks", F.posexplode("parts").alias("chunk_no", "chunk")).withColumn("chunk_hash", F.sha2("chunk", 256))


def hierarchy(docs: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """Parent and child rows of every document with deterministic ids; one running order over parents and their children."""
    parents = docs.select(key, title, F.posexplode(_udf(split_by_policy, *PARENT_POLICY)(F.col(text))).alias("parent_no", "parent_text"))
    children = parents.select(key, title, "parent_no", "parent_text", F.posexplode_outer(_udf(split_by_policy, *CHILD_POLICY)(F.col("parent_text"))).alias("child_no", "child_text"))
    section = F.format_string("s%05d", F.col("parent_no"))
    p = parents.select(F.col(key), "parent_no", F.lit(-1).alias("child_no"), F.lit("parent_section").alias("chunk_type"), F.col("parent_text").alias("text"), section.alias("section_id"))
    c = children.where("child_text is not null").select(F.col(key), "parent_no", "child_no", F.lit("child_evidence").alias("chunk_type"), F.col("child_text").alias("text"), section.alias("section_id"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("parent_no", "child_no")) - 1
    rows = p.unionByName(c).withColumn("order", order)
    return rows.withColumn("id", chunk_id(F.col(key).cast("string"), F.col("chunk_type"), F.col("section_id"), F.col("order"), F.col("text"))).drop("parent_no", "child_no")


def chunk_id(page: Column, kind: Column, section: Column, order: Column, text: Column) -> Column:
    """page:kind:section:order in five digits:first ten digits of the text's hash."""
    return F.format_string("%s:%s:%s:%05d:%s", page, kind, section, order, F.left(F.sha2(T.normalised(text), 256), F.lit(10)))


def embedding_text(title: Column, section: Column, boost: Column, text: Column, kind: Column, path: Column | None = None) -> Column:
    """The distinct parts of a chunk's text by lines, cut; '' for parents."""
    parts = T.distinct_folded(F.array(*[F.coalesce(c, F.lit("")) for c in (*([path] if path is not None else []), title, section, boost, text)]))
    return F.when(kind == "parent_section", F.lit("")).otherwise(F.left(F.array_join(parts, "\n"), F.lit(EMBED_CHARS)))


def page_document(*parts: Column) -> Column:
    """Filled parts joined by blank lines."""
    return T.joined_filled("\n\n", *[F.coalesce(p, F.lit("")) for p in parts])


def problems(kind: Column, key: Column, text: Column, expand: Column, parent: Column) -> Column:
    """What is wrong with a chunk row, as an array of names."""
    filled = lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""
    return F.array_compact(F.array(F.when(~filled(key), "missing_id"), F.when(kind.isin("child_evidence", "faq_evidence", "attachment_evidence") & ~filled(text), "empty_evidence"), F.when(expand & ~filled(parent), "expand_without_parent")))


def table_rows(markdown: Column) -> Column:
    """Rows of a markdown table as arrays of cells; separator rows dropped."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).rlike(r"^\|.*\|$") & ~F.trim(x).rlike(r"^\|[\s:|-]+\|$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def markdown_table(rows: DataFrame, columns: list[str], order: str, group: str) -> DataFrame:
    """One markdown table a group; line feeds in cells become spaces, pipes are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*\n\s*", " "), r"\|", r"\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    body = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    head = f"| {' | '.join(columns)} |\n| {' | '.join(['---'] * len(columns))} |"
    return rows.groupBy(group).agg(F.concat_ws("\n", F.lit(head), F.array_join(body, "\n")).alias("table"))


def injected(text: str, anchors: list[tuple[str, str]]) -> tuple[str, int]:
    """Puts each marker after the first occurrence of its anchor, the longest anchors first, unless it is there; and how many."""
    done = 0
    for anchor, marker in sorted(anchors, key=lambda a: (-len(a[0]), a[0])):
        if anchor and marker not in text and (k := text.find(anchor)) >= 0:
            k += len(anchor)
            text, done = f"{text[:k]} {marker}{text[k:]}", done + 1
    return text, done


def with_markers(text: Column, anchors: Column) -> Column:
    """struct(text, n) with markers put in; anchors: array<struct<anchor, marker>>."""

    @F.pandas_udf("text string, n int")
    def run(t: pd.Series, a: pd.Series) -> pd.DataFrame:
        rows = [injected(x or "", [(y["anchor"], y["marker"]) for y in (z if z is not None else [])]) for x, z in zip(t, a, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n"])

    return run(text, anchors)


def context(docs: DataFrame, group: str, rank: str, title: str, text: str, cuts: tuple[int, ...] = (4200, 2200, 1200, 900)) -> DataFrame:
    """One numbered context text a group; later documents are cut shorter."""
    limit = F.element_at(F.array(*map(F.lit, cuts)), F.least(F.col(rank), F.lit(len(cuts))))
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.left(F.col(text), limit))
    return docs.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
