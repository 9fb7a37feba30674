"""The queries opN_* and the pipeline: thin digests over the operators of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import stored, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", *BASE)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed, sized

    return mixed(stored(sized(table(spark, sf_dir, "documents")), "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorpack import pack_examples

    return pack_examples(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ALL = (op1_token_output, op2_best_fit_packing, op3_token_counts, op4_main_text, op5_nearest, op6_warc_archives, op7_quality_rules, op8_jaccard_join, op9_mix_sources, op10_toxicity, op11_collocations, op12_vector_packing, op13_lexical_search)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}
ORACLES: dict[str, str] = {"op6_warc_archives": oracles.WARC, "op7_quality_rules": oracles.QUALITY, "op8_jaccard_join": oracles.JACCARD, "op11_collocations": oracles.COLLOCATIONS, "op13_lexical_search": oracles.LEXICAL}
