"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session that names none (a test) gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside delete their shuffle files as soon as an action on them ends; only for what is checkpointed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Intermediate tables of one run as Parquet in the shared folder: a written table cuts the lineage as a checkpoint does, takes
    less room, and can be dropped as soon as nothing reads it. What is left goes when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count, self.paths = spark, 0, {}
        self.folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.fs = spark._jvm.org.apache.hadoop.fs
        self._fs(self.folder).deleteOnExit(self.fs.Path(self.folder))

    def _fs(self, path: str):
        return self.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` computed once and read back; its shuffle files go with the action."""
        path, self.count = f"{self.folder}/{self.count}", self.count + 1
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self.paths.pop(id(table))
            self._fs(path).delete(self.fs.Path(path), True)


def in_small_batches(texts: DataFrame, rows: int = 1000) -> DataFrame:
    """``texts``, in a session whose Arrow batches hold at most so many rows: of whole texts the default 10,000 take much memory."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return texts


def word_count(text: str | Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_key(*columns: str) -> Column:
    """A 64-bit name for a row: equal only for rows that agree in these columns, nulls included."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def row_name(*columns: str) -> Column:
    """A name of 32 hexadecimal digits (128 bits) for a row: two differently seeded hashes of these columns, nulls included."""
    parts = [F.struct(F.col(c).isNull(), F.col(c)) for c in columns]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)])


def crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def hash_sample(rows: DataFrame, count: int, keys: tuple[str, ...], most: int) -> DataFrame:
    """The ``most`` rows of smallest hash of their keys, out of about ``count`` rows.

    Where there are many more rows, only those of small hash are considered, so that the tasks together hand in a few times
    ``most`` rows and not that many each.
    """
    order = F.xxhash64(*keys)
    if count > 4 * most:
        rows = rows.filter(F.shiftrightunsigned(order, 32) < int(4 * most / count * (1 << 32)))
    return rows.orderBy(order, *keys).limit(most)
