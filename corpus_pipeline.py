"""A training corpus from ``documents``: language, line dedup, near-duplicates, source mix, packing.

Each stage takes the documents that the stage before it kept and returns documents of the same columns; the last returns where
every document lies in the training sequences. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shipping import ship_package
from tessera.llm.common import Scratch, read_table, row_name
from tessera.llm.language import with_language
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mixed
from tessera.llm.near_dedup import BROADCAST_ROWS, near_duplicates
from tessera.llm.packing import packed

#: Documents are rejected if a smaller share of their words has a clear language, be it the document's own or another.
LEAST_CLEAR_SHARE = 0.4


def _aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the needed ones under names with a blank, which no operator uses; and those names."""
    names = {c: c if c in needed else f"own {i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select([F.col(f"`{new}`").alias(old) for old, new in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and those in no recognisable language; fills a null lang."""
    ship_package(spark)
    aside, names = _aside(docs, "doc_id", "text", "lang")
    told = with_language(aside, ("language told", "score told", "clear told"))
    told = told.filter((F.col("language told") != "und") & (F.col("clear told") >= LEAST_CLEAR_SHARE))
    return _back(told.withColumn("lang", F.coalesce("lang", "language told")), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that the corpus had before, and documents of which no line with a word is left."""
    aside, names = _aside(docs, "doc_id", "text")
    cut = dedup_lines(aside).filter("n_lines = 0 or n_dropped < n_lines")
    if "n_chars" in names:
        size = names["n_chars"]
        cut = cut.withColumn(size, F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col(f"`{size}`")))
    return _back(cut, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the document of smallest id, and of rows that repeat doc_id and text one."""
    ship_package(spark)
    scratch = Scratch(spark)
    judged = scratch.keep(near_duplicates(docs).select("row", "kept"))
    rows = docs.withColumn("row name", row_name("doc_id", "text"))
    gone = scratch.keep(judged.filter(~F.col("kept")).select(F.col("row").alias("row name")).distinct())
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "row name", "left_anti")
    if not judged.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        left = left.dropDuplicates(["row name"])
    return left.select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents that it does not take go."""
    aside, names = _aside(docs, "doc_id", "text", "source")
    keep = tuple(c for c in aside.columns if c not in ("doc_id", "source"))
    taken = mixed(aside, keep=keep).filter("repeats > 0")
    return _back(taken.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats")))), names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies in the training sequences."""
    ship_package(spark)
    return packed(docs).select("doc_id", "piece", "first_word", F.col("size").alias("n_words"), "bin_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [(f.__name__, f) for f in (language_id, line_dedup, near_dedup, source_mix, best_fit_packing)]

#: SQL cannot express the language stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other; a stage's table goes when the next is written."""
    scratch = Scratch(spark)
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
