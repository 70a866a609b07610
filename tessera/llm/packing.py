"""Conflict-constrained best-fit packing of documents into training sequences.

Bins of a fixed capacity take documents in order of falling size. Open bins are kept by what they have left; each carries one
bitmap of the sources and one of the duplicate clusters that it holds. A document goes to the tightest bin that is large
enough and holds neither its source nor its cluster: the search starts at the smallest sufficient residual and goes on to the
next one that is in use until a compatible bin is found, and only then opens a new bin.

Documents are dealt by hash to shards of about ``shard_rows``; each shard packs its own bins, so work and memory of a task are
bounded and no key can gather in one task. Only ids, sizes, sources and clusters are shuffled, never texts.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, row_key, word_count

#: Bits of the bitmaps. Sources or clusters that share a bit are kept apart as if they were one, which is always safe.
SOURCE_BITS = 256
CLUSTER_BITS = 1024


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    shard_rows: int = 4000


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; ``sources`` and ``clusters`` are bit numbers, the pieces are taken in the given order."""
    source_map: list[int] = []
    cluster_map: list[int] = []
    by_residual: dict[int, list[int]] = defaultdict(list)
    in_use: list[int] = []  # the residuals that some bin has, in order
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist())):
        s, c = 1 << source, 1 << cluster
        found = left = None
        for k in range(bisect.bisect_left(in_use, size), len(in_use)):
            for j, b in enumerate(by_residual[in_use[k]]):
                if not (source_map[b] & s or cluster_map[b] & c):
                    found, left = b, in_use[k]
                    break
            if found is not None:
                held = by_residual[left]
                held.pop(j)
                if not held:
                    in_use.pop(k)
                break
        if found is None:
            found, left = len(source_map), capacity
            source_map.append(0)
            cluster_map.append(0)
        bins[i], offsets[i] = found, capacity - left
        source_map[found] |= s
        cluster_map[found] |= c
        left -= size
        if left > 0:
            if not by_residual[left]:
                bisect.insort(in_use, left)
            by_residual[left].append(found)
    return bins, offsets


def _pack_shard(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("row", "ascending"), ("piece", "ascending"), ("number", "ascending")])
    bits = lambda name, n: (table.column(name).to_numpy() % n).astype(np.int64)
    bins, offsets = best_fit(table.column("size").to_numpy(), bits("source_hash", SOURCE_BITS), bits("cluster", CLUSTER_BITS), capacity)
    out = table.select(["shard", "doc_id", "row", "piece", "first_word", "size"])
    return out.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets))


PLACES = "doc_id long, row long, piece long, first_word long, size long, bin_id string, offset long"


def packed(documents: DataFrame, packing: Packing = Packing(), cluster: Column | None = None) -> DataFrame:
    """(doc_id, row, piece, first_word, size, bin_id, offset): where each piece of every document lies.

    Sizes are words. A document longer than the capacity is cut into pieces of the capacity and a rest, which are placed like
    documents; nothing is cut off. ``cluster`` is a long that duplicates share (by default a hash
    of the text, so exact copies conflict); a null source counts as a source. Documents without words (null or blank text)
    have nothing to place: one row with size 0 and a null bin. Repeated rows are placed each for itself and conflict with
    each other. ``row`` is a hash of doc_id and text, which tells rows of one doc_id apart. An empty table gives no rows.
    """
    words = documents.select(
        "doc_id",
        row_key("doc_id", "text").alias("row"),
        word_count("text").alias("words"),
        row_key("source").alias("source_hash"),
        F.monotonically_increasing_id().alias("number"),  # tells repeated rows apart; the checkpoint below fixes it
        (F.xxhash64("text") if cluster is None else cluster).alias("cluster"),
    )
    words = checkpointed(words)
    shards = max(1, -(-words.count() // packing.shard_rows))
    capacity = F.lit(packing.capacity)
    piece = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("words") / capacity) - 1))
    pieces = words.filter("words > 0").select("*", F.explode(piece).alias("piece"))
    pieces = pieces.withColumn("first_word", F.col("piece") * capacity).withColumn("size", F.least(capacity.cast("long"), F.col("words") - F.col("first_word")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("number", "piece"), F.lit(shards)))
    placed = (
        pieces.select("shard", "doc_id", "row", "number", "piece", "first_word", "size", "source_hash", "cluster")
        .groupBy("shard")
        .applyInArrow(lambda x: _pack_shard(x, packing.capacity), "shard long, doc_id long, row long, piece long, first_word long, size long, bin long, offset long")
        .select("doc_id", "row", "piece", "first_word", "size", F.concat_ws("-", "shard", "bin").alias("bin_id"), "offset")
    )
    nothing = words.filter("words = 0").select("doc_id", "row", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_word"), F.col("words").alias("size"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    return placed.union(nothing)
