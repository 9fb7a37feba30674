"""Sources: JSON lines and documents, metadata folders, question files, runs, encoded CSV, binary documents, trees, landed pages."""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "euc-kr", "utf-8-sig", "cp949")
PARSERS = {"pdf": ["pdf"], "slides": ["pptx", "ppt"], "sheet": ["xlsx", "xls", "csv"], "text": ["docx", "doc"], "hwp": ["hwp"]}
CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, bad: str = "drop") -> DataFrame:
    """One object a line; blank lines are skipped. Malformed lines are dropped, fatal ("fail"), or kept in ``_corrupt_record`` ("report")."""
    reader = spark.read.option("mode", {"drop": "DROPMALFORMED", "fail": "FAILFAST", "report": "PERMISSIVE"}[bad])
    if bad == "report":
        made = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*made.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches a path, in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType, missing: str = "fail") -> DataFrame:
    """Whole-file JSON documents with the file's path as ``file``; a missing path fails or gives no rows ("empty")."""
    if missing == "empty" and not exists(spark, path):
        made = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], T.StructType([*made.fields, T.StructField("file", T.StringType())]))
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))


def page_index(documents: DataFrame, page_id: Column, html: Column, titles: Column) -> DataFrame:
    """page_id -> titles and HTML (where it is HTML); the id falls back to the file name's first run of five digits; the last file wins."""
    key = F.coalesce(F.nullif(page_id, F.lit("")), F.nullif(F.regexp_extract("file", r"(\d{5,})", 1), F.lit("")))
    rows = documents.select(key.alias("page_id"), titles.alias("titles"), F.when(F.contains(html, F.lit("<")), html).alias("html"), "file").where("page_id is not null")
    return rows.groupBy("page_id").agg(F.max_by("titles", "file").alias("titles"), F.max_by("html", "file").alias("html"))


def excluded(title: Column, exact: list[str], patterns: list[str]) -> Column:
    """Titles that equal one of a set, or in which a pattern is found."""
    out = title.isin(exact or [""])
    for p in patterns:
        out = out | title.rlike(p)
    return out


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``question || type | intent | hint`` lines; comments and blank lines are skipped; a line without fields is of type Unknown."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    half = F.split("value", r"\|\|", 2)
    meta = F.split(F.get(half, F.lit(1)), r"\|")
    part = lambda k: F.coalesce(F.trim(F.get(meta, F.lit(k))), F.lit(""))
    kind = F.when(F.size(half) < 2, F.lit("Unknown")).otherwise(part(0))
    return lines.select(F.trim(F.get(half, F.lit(0))).alias("question"), kind.alias("question_type"), part(1).alias("expected_intent"), part(2).alias("pass_hint"))


def runs(rows: DataFrame, file: str = "file") -> DataFrame:
    """Adds run: the folder of the form YYYYMMDDThhmmssZ in a path."""
    return rows.withColumn("run", F.nullif(F.regexp_extract(file, r"/(\d{8}T\d{6}Z)(?:/|$)", 1), F.lit("")))


def newest_run(rows: DataFrame, session: str = "session_id") -> DataFrame:
    """Each session's rows of the newest run that has it."""
    best = rows.groupBy(session).agg(F.max("run").alias("_run"))
    return rows.join(best, session).where(F.col("run") == F.col("_run")).drop("_run")


def decoded_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """file, encoding, row_no, cells of CSV files, each in the first encoding that decodes it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                for name in encodings:
                    try:
                        text = bytes(content).decode(name)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    continue
                found = list(csv.reader(io.StringIO(text.lstrip("﻿"))))
                yield pd.DataFrame({"file": file, "encoding": name, "row_no": range(len(found)), "cells": found})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, encoding string, row_no int, cells array<string>")


def parser_of(name: Column) -> Column:
    """The parser of a file by its extension; null if there is none."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = None
    for parser, extensions in PARSERS.items():
        out = F.when(ext.isin(extensions), parser) if out is None else out.when(ext.isin(extensions), parser)
    return out


def ordered_blocks(blocks: Column) -> Column:
    """Text of positioned blocks, top to bottom and left to right (to a tenth), by lines."""
    order = F.sort_array(F.transform(blocks, lambda b: F.struct(F.round(b["y"], 1).alias("y"), F.round(b["x"], 1).alias("x"), b["text"].alias("text"))))
    return F.array_join(F.transform(order, lambda b: b["text"]), "\n")


def confidence(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) < 50, 0.3).otherwise(1.0)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row_no, cells of spreadsheets; needs a spreadsheet library, which is looked for when rows are read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                for sheet, table in pd.read_excel(io.BytesIO(bytes(content)), sheet_name=None, header=None, dtype=str).items():
                    cells = table.fillna("").to_numpy().tolist()
                    if cells:
                        yield pd.DataFrame({"file": file, "sheet": sheet, "row_no": range(len(cells)), "cells": cells})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, sheet string, row_no int, cells array<string>")


def tree(spark: SparkSession, nodes: DataFrame, root, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes below a root with their depth; a node is visited once, so cycles end. Every level is stored."""
    edges = nodes.select(F.col(node).alias("_id"), F.col(parent).alias("_parent"))
    found = level = stored(nodes.where(F.col(node) == root).select(F.col(node).alias("id"), F.lit(0).alias("depth")).limit(1), "root")
    for depth in itertools.count(1):
        below = edges.join(level.select(F.col("id").alias("_parent")), "_parent").select(F.col("_id").alias("id"), F.lit(depth).alias("depth")).distinct()
        level = stored(below.join(found.select("id"), "id", "left_anti"), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def descriptions(rows: DataFrame, items: str, keys: tuple[str, ...] = ("refined", "description", "summary", "text")) -> DataFrame:
    """name (lower case), url, text of description items that have a text, which is the first filled of several keys."""
    item = rows.select(F.explode(items).alias("i"))
    fields = [f.name for f in item.schema["i"].dataType.fields]
    text = F.coalesce(*[F.nullif(F.trim(F.col(f"i.{k}")), F.lit("")) for k in keys if k in fields])
    name = F.coalesce(*[F.nullif(F.trim(F.col(f"i.{k}")), F.lit("")) for k in ("name", "file_name") if k in fields])
    url = F.col("i.url") if "url" in fields else F.lit(None).cast("string")
    return item.select(F.lower(name).alias("name"), url.alias("url"), text.alias("text")).where("text is not null")


def has_rows(spark: SparkSession, table: str) -> bool:
    """Whether a table exists and holds anything."""
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()
