"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship_package
from tessera.llm.byte_bpe import Tokenizer
from tessera.llm.common import read_table
from tessera.llm.divergence import divergence
from tessera.llm.filter_audit import filter_interactions
from tessera.llm.html_extract import main_text
from tessera.llm.language import languages
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.lm_score import scores
from tessera.llm.mixing import mixed
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.oracles import ORACLES
from tessera.llm.packing import packed
from tessera.llm.pii import pseudonymised
from tessera.llm.quality import quality
from tessera.llm.topk import top_k

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The key of the registered query; a user passes a secret of their own.
EXAMPLE_KEY = b"key of the registered query"


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents")).select("doc_id", "piece", "first_word", F.col("size").alias("n_words"), "bin_id", "offset")


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("row")


@query
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read_table(spark, sf_dir, "documents"), EXAMPLE_KEY).select("doc_id", "text", "n_entities", "entities")


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = tokenizer.encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = tokenizer.decoded(ids.select("doc_id", "ids", F.col("ids").alias("coded")), "coded")
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]
