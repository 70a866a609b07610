"""Audit of how filters interact: a packed bitmap index, read with AND-NOT and popcount for every prefix of every filter order.

Each row of the index is a row of the data, and each bitmap says which rows fail a filter or carry a label. A task lays out its
rows so that those of one part fill whole 64-bit words: the part's own bitmap is then a run of words, and one popcount of an
expression serves all parts at once. What a filter removes after others depends only on which filters came before, not on their
order, so ``2 ** n`` prefix subsets stand for all ``n!`` orders. Counts are summed over the tasks and joined to the orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, row_name, word_count

#: Rows of one bitmap index: 128 KB for each bitmap.
INDEX_ROWS = 1 << 20
#: Orders of more filters than this are too many rows for each part.
MOST_FILTERS = 7

PACKED = "part string, flags int"


class BitmapIndex:
    """Bitmaps of ``flags`` (bit k of a row: it is in bitmap k), with the rows of each of the distinct ``parts`` in words of their own."""

    def __init__(self, parts: pa.Array, flags: np.ndarray, bitmaps: int):
        coded = parts.dictionary_encode()
        self.parts = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        rows = np.bincount(code, minlength=len(self.parts))
        words = -(-rows // 64)
        self.first = np.cumsum(words) - words
        place = np.arange(len(code)) + np.repeat(64 * self.first - (np.cumsum(rows) - rows), rows)
        flags = flags[order]

        def packed(bits: np.ndarray) -> np.ndarray:
            wide = np.zeros(64 * int(words.sum()), bool)
            wide[place] = bits
            return np.packbits(wide, bitorder="little").view(np.uint64)

        self.rows = packed(np.ones(len(flags), bool))
        self.bitmaps = [packed(flags >> k & 1 != 0) for k in range(bitmaps)]

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.first)


def _counts(index: BitmapIndex, filters: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(prefix subset, filter not in it, counts of each part): kept, removed, redundant, unique_fails, and removed with each label."""
    fails, labels = index.bitmaps[:filters], index.bitmaps[filters:]
    for prefix in range(1 << filters):
        left = index.rows.copy()
        for k in range(filters):
            if prefix >> k & 1:
                left &= ~fails[k]
        for k in range(filters):
            if prefix >> k & 1:
                continue
            removed = left & fails[k]
            alone = fails[k].copy()
            for other in range(filters):
                if other != k:
                    alone &= ~fails[other]
            yield prefix, k, [index.count(x) for x in (left & ~fails[k], removed, fails[k] & ~left, alone, *(removed & x for x in labels))]


def _audit_task(batches: Iterator[pa.RecordBatch], filters: int, labels: int) -> Iterator[pa.RecordBatch]:
    names = ["part", "prefix", "filter", *(f"n{i}" for i in range(4 + labels))]

    def audited(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        index = BitmapIndex(table.column("part").combine_chunks(), table.column("flags").to_numpy(), filters + labels)
        for prefix, k, counts in _counts(index, filters):
            n = len(index.parts)
            yield pa.RecordBatch.from_arrays([index.parts, pa.array(np.full(n, prefix, np.int32)), pa.array(np.full(n, k, np.int32)), *map(pa.array, counts)], names=names)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held, rows = [*held, batch], rows + batch.num_rows
        if rows >= INDEX_ROWS:
            yield from audited(held)
            held, rows = [], 0
    if held:
        yield from audited(held)


def _steps(spark, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, prefix, filter) of every step of every order: a table whose size only the number of filters decides."""
    rows = [
        ("".join(names[k] for k in order), step + 1, sum(1 << k for k in order[:step]), k)
        for order in permutations(range(len(names)))
        for step, k in enumerate(order)
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, prefix int, filter int")


def audit(rows: DataFrame, filters: Mapping[str, str], labels: Mapping[str, str], part: str = "part") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, one column for each label, shapley) for every part.

    ``filters`` gives each filter's short name the boolean column of the rows that fail it, ``labels`` each result column the
    boolean column of the rows that it counts among those removed. Null is false; a null part is the empty string. ``shapley``
    is what the filter removes, summed over all orders: over prefix subsets, weighted by the orders that have them. Any
    other columns are left alone. No rows give no rows; parts may be as many as rows, each task emits only those it has.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    bits = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int") * (1 << k) for k, c in enumerate([*filters.values(), *labels.values()])]
    flags = sum(bits[1:], bits[0]).alias("flags")
    n, m = len(names), len(labels)
    schema = "part string, prefix int, filter int, " + ", ".join(f"n{i} long" for i in range(4 + m))
    counted = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), flags).mapInArrow(lambda b: _audit_task(b, n, m), schema)
    results = ["kept", "removed", "redundant", "unique_fails", *labels]
    sums = counted.groupBy("part", "prefix", "filter").agg(*[F.sum(f"n{i}").alias(name) for i, name in enumerate(results)])
    sums = Scratch(rows.sparkSession).keep(sums)
    before = F.bit_count("prefix")
    orders = F.element_at(F.array([F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (before + 1).cast("int"))
    shapley = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = F.broadcast(_steps(rows.sparkSession, names))
    return sums.join(shapley, ["part", "filter"]).join(steps, ["prefix", "filter"]).select("part", "filter_order", "step", *results, "shapley")


def copies(documents: DataFrame) -> DataFrame:
    """(doc_id, name, first) of every row: the name of its text (128 bits) and whether no smaller doc_id has the same text.

    Only ids and names are shuffled. The names that occur twice are a table of their own, joined back, so that a text that a
    third of the rows have can be split. Null texts are empty; a null doc_id is neither smaller nor larger than another.
    """
    scratch = Scratch(documents.sparkSession)
    names = scratch.keep(documents)
    repeated = names.groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("name", "least")
    repeated = scratch.keep(repeated)
    first = ~F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return names.join(repeated, "name", "left").withColumn("first", first).drop("least")


def _conditions(text: Column) -> dict[str, Column]:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return {
        "fails A": word_count(text) < 50,
        "fails B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "fails C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "fails D": text.rlike("[#$%&*|]"),
    }


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters on whole texts of ``documents``, audited for every source: see ``audit`` and ``copies``.

    A: under 50 words; B: of its words less than 65 % are distinct; C: of its code points more than 5 % are A-Z; D: it holds one
    of #$%&*|; E: a smaller doc_id has the same text. A null text is empty: it fails A, and E after the first. A label counts if
    any row of ``labels`` (doc_id, quality, toxic) for the id gives it; a row without an id has no labels. Repeated rows count
    each, and are no copies of a smaller id. Columns of other names, clashing ones too, are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    facts = facts.select("doc_id", "part", row_name("text").alias("name"), *[c.alias(k) for k, c in _conditions(F.col("text")).items()])
    told = copies(facts).withColumn("fails E", ~F.col("first"))
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is good"), F.max(F.col("toxic") == 1).alias("is toxic"))
    good = Scratch(labels.sparkSession).keep(good.filter("`is good` or `is toxic`"))
    rows = told.join(good, "doc_id", "left")
    return audit(rows, {k: f"fails {k}" for k in "ABCDE"}, {"good_lost": "is good", "toxic_lost": "is toxic"})
