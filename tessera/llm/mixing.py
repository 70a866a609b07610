"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash; a source takes the documents whose hash lies below its threshold, and its second budget takes those
below a second, smaller threshold once more. The thresholds come from histograms: word sums by source and hash bucket show the
bucket in which a budget runs out, and only that boundary bucket is split again, by the next bits of the hash, until a bucket
is a single hash. The documents themselves are never sorted; each step is a grouped sum of at most ``2 ** bits`` buckets for
each source and budget, and the last step is a filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, row_key, word_count

#: Up to this many sources, what is known of them (about 100 bytes each) is sent to every executor; else it is joined by shuffle.
BROADCAST_SOURCES = 100_000

HASH_BITS = 48


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    total_percent: int = 150
    most_repeats: int = 2
    bits: int = 12


def _water_level(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the budget by weight, held at the most and reshared.

    With the sources in the order of most / weight, let the first k be full and the others share what is left in proportion
    to their weights: the level at which they end up rises with k while the next source is overfull, and falls from then on,
    so the right level is the highest. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(mix.weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, mix.weights))), (place + 1).cast("int"))
    sized = sources.withColumn("weight", weight).withColumn("most", (F.lit(mix.most_repeats) * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    full, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * (mix.total_percent / 100) - F.coalesce(F.sum("most").over(full), F.lit(0.0))
    levels = sized.withColumn("level", F.greatest(F.lit(0.0), left) / F.sum("weight").over(rest))
    share = F.col("weight") * F.max("level").over(whole)
    return levels.select("source", "source_size", F.least(share, F.col("most")).alias("target"))


def _with(facts: DataFrame, table: DataFrame, few: bool, key: str = "source") -> DataFrame:
    """``facts`` with the columns of ``table`` (one row for each key, or some); null is a key."""
    table = table.withColumnRenamed(key, "_key")
    return facts.join(F.broadcast(table) if few else table, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def _thresholds(facts: DataFrame, budgets: DataFrame, few: bool, bits: int) -> DataFrame:
    """(source, fold, threshold): documents of the source with hash < threshold sum up to the budget, or a document less or more.

    ``budgets`` holds (source, fold, budget). Each step keeps, for each source and fold, the bucket ``[low, low + width)`` in
    which the sum passes the budget, and what the buckets before it have left of the budget.
    """
    state = budgets.withColumn("low", F.lit(0).cast("long"))
    for step in range(HASH_BITS // bits):
        width = 1 << (HASH_BITS - bits * (step + 1))
        inside = _with(facts, state, few)
        inside = inside.filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + (width << bits)))
        sums = inside.groupBy("source", "fold", "budget", "low", F.expr(f"hash div {width}").alias("bucket")).agg(F.sum("size").alias("sum"))
        running = F.sum("sum").over(Window.partitionBy("source", "fold").orderBy("bucket"))
        crossed = sums.withColumn("upto", running).filter(F.col("upto") > F.col("budget"))
        edge = crossed.groupBy("source", "fold").agg(F.min_by(F.struct("bucket", "sum", "upto"), "bucket").alias("edge"))
        edge = edge.select(F.col("source").alias("s"), F.col("fold").alias("f"), "edge")
        state = state.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("fold") == F.col("f")), "left")
        # A budget that no bucket passes takes everything: its bucket moves past the last.
        state = state.select(
            "source",
            "fold",
            F.when(F.col("edge").isNull(), F.col("budget")).otherwise(F.col("budget") - (F.col("edge.upto") - F.col("edge.sum"))).alias("budget"),
            F.when(F.col("edge").isNull(), F.lit(1 << HASH_BITS)).otherwise(F.col("edge.bucket") * width).alias("low"),
            F.col("edge.sum").alias("sum"),
        ).withColumn("budget", F.when(F.col("low") == 1 << HASH_BITS, F.lit(float("inf"))).otherwise(F.col("budget")))
        state = checkpointed(state)
        if step < HASH_BITS // bits - 1:
            state = state.drop("sum")
    # The single hash at the boundary is taken if more than half of it fits.
    take = F.col("low") + F.when(F.col("sum").isNotNull() & (2 * F.col("budget") > F.col("sum")), 1).otherwise(0)
    return state.select("source", "fold", take.alias("threshold"))


def mixed(documents: DataFrame, mix: Mix = Mix(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats) and the columns ``keep`` for every row of ``documents``.

    Sizes are words (null text: 0). Sources in code-point order, null last, have the weights in turn; together they share
    ``total_percent`` of all sizes, and none more than ``most_repeats`` times its size. ``taken`` is the size times the number
    of a document's repeats in the mix. The hash is of doc_id and text, so reruns agree; rows that repeat both go together.
    A source's taken words differ from its target by at most half the size of such a row group, for each repeat. Empty
    documents take part with size 0; an empty table gives no rows.
    """
    facts = documents.select("doc_id", "source", *keep, word_count("text").alias("size"), F.shiftrightunsigned(row_key("doc_id", "text"), 64 - HASH_BITS).alias("hash"))
    slim = checkpointed(facts.select("doc_id", "source", "size", "hash"))
    facts = facts if keep else slim
    sources = checkpointed(_water_level(slim.groupBy("source").agg(F.sum("size").alias("source_size")), mix))
    few = sources.count() <= BROADCAST_SOURCES
    folds = F.explode(F.sequence(F.lit(0), F.lit(mix.most_repeats - 1)))
    budget = F.least(F.greatest(F.col("target") - F.col("fold") * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double"))
    budgets = checkpointed(sources.select("source", "source_size", "target", folds.alias("fold")).select("source", "fold", budget.alias("budget")))
    limits = _thresholds(slim, budgets, few, mix.bits).groupBy("source").agg(F.collect_list("threshold").alias("thresholds"))
    known = checkpointed(_with(sources, limits, few))
    out = _with(facts, known, few)
    repeats: Column = F.size(F.filter("thresholds", lambda x: F.col("hash") < x))
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))
