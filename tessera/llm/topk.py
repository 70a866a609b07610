"""Exact top-k search by inner product with a pivot-distance index.

Vectors become integers, floor(scale · x). With M² the largest squared norm, adding the coordinate √(M² − |x|²) to every
indexed vector, and 0 to every query, puts all vectors on one sphere: then |q − x|² = |q|² + M² − 2·q·x, so the highest inner
products are the smallest distances, and the triangle inequality holds.

Every row is keyed by its nearest pivot and by its annulus, a range of distances from that pivot. A query q at distance d from
pivot p is at least max(0, d − high, low − d) from whatever lies in the annulus [low, high] of p, which bounds the inner
product from above. The search first reads, for each query, the annuli with the best bounds; the k-th score found there stops
the expansion: only annuli whose bound reaches it are read after that. Everything compared is exact integer arithmetic; only
bounds are floating point, with a margin on the safe side.

Pivots and the edges of the annuli come from a bounded sample; all rows are indexed. Annuli are packed into blocks of about
``block_rows`` rows, and queries into groups of about ``group_rows``, so that each task multiplies two bounded matrices; an
annulus that holds a third of all rows becomes many blocks. There are as many pivots, up to ``pivots``, as fill blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import checkpointed, hash_sample

#: Integers of less than this many bits are multiplied exactly as doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class PivotIndex:
    scale: int = 256
    pivots: int = 64
    annuli: int = 4
    sample_rows: int = 4096
    block_rows: int = 2048
    group_rows: int = 512
    rounds: int = 8
    seed: int = 3


@dataclass
class Layout:
    pivots: np.ndarray  # with the extra coordinate
    edges: np.ndarray  # pivot × (annuli − 1)
    bound: float  # M²

    def keyed(self, vectors: np.ndarray, lift: bool) -> np.ndarray:
        """Distance of each vector to each pivot; ``lift`` adds the coordinate of indexed vectors."""
        norms = (vectors**2).sum(1)
        extra = np.sqrt(np.maximum(self.bound - norms, 0)) if lift else np.zeros(len(vectors))
        lifted = np.concatenate((vectors, extra[:, None]), 1)
        squares = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, dimension)


def layout(sample: np.ndarray, bound: float, pivots_wanted: int, index: PivotIndex) -> Layout:
    """Pivots by a few rounds of means over the lifted sample, started at points far apart; annuli of equal counts."""
    random = np.random.default_rng(index.seed)
    lifted = np.concatenate((sample, np.sqrt(np.maximum(bound - (sample**2).sum(1), 0))[:, None]), 1)
    chosen = [int(random.integers(len(lifted)))]
    nearest = ((lifted - lifted[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots_wanted, len(lifted)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
    pivots = lifted[chosen].copy()
    for _ in range(index.rounds):
        squares = (lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * lifted @ pivots.T
        of = squares.argmin(1)
        for p in range(len(pivots)):
            if (of == p).any():
                pivots[p] = lifted[of == p].mean(0)
    out = Layout(pivots, np.zeros((len(pivots), index.annuli - 1)), bound)
    distance = out.keyed(sample, True)
    of = distance.argmin(1)
    for p in range(len(pivots)):
        own = distance[of == p, p]
        out.edges[p] = np.quantile(own if len(own) else distance[:, p], np.arange(1, index.annuli) / index.annuli)
    return out


INDEXED = "vec_id long, at long, cell int, distance double, v array<{}>"


def _index(batches: Iterator[pa.RecordBatch], held, index: PivotIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column("v"), held.value.pivots.shape[1] - 1)
        distance = held.value.keyed(vectors, True)
        pivot = distance.argmin(1)
        own = distance[np.arange(len(pivot)), pivot]
        annulus = (own[:, None] > held.value.edges[pivot]).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("at"), pa.array((pivot * index.annuli + annulus).astype(np.int32)), pa.array(own), batch.column("v")], names=["vec_id", "at", "cell", "distance", "v"])


def _bounds(queries: np.ndarray, cells: np.ndarray, held: Layout, index: PivotIndex) -> np.ndarray:
    """Upper bound of the inner product of each query with whatever lies in each of ``cells`` (cell, low, high)."""
    distance = held.keyed(queries, False)[:, cells[:, 0].astype(int) // index.annuli]
    gap = np.maximum(0, np.maximum(distance - cells[:, 2], cells[:, 1] - distance))
    gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)
    norms = (queries**2).sum(1)[:, None]
    return (norms + held.bound - gap**2) / 2 * (1 + 1e-9) + 1


def _pack(table: pa.Table) -> pa.Table:
    """One row for a group of vectors: their ids, which rows they are, and their components in one list."""
    table = table.sort_by([("vec_id", "ascending"), ("at", "ascending")])
    ids, at = table.column("vec_id").combine_chunks(), table.column("at").combine_chunks()
    vectors = table.column("v").combine_chunks()
    return pa.table(
        {
            "key": pa.array([table.column("key")[0].as_py()], pa.int64()),
            "ids": pa.ListArray.from_arrays([0, len(ids)], ids),
            "at": pa.ListArray.from_arrays([0, len(at)], at),
            "v": pa.ListArray.from_arrays([0, len(vectors.flatten())], vectors.flatten()),
        }
    )


PACKED = "key long, ids array<long>, at array<long>, v array<{}>"


def _route(batches: Iterator[pa.RecordBatch], cells, held, index: PivotIndex, dimension: int, k: int, first: bool) -> Iterator[pa.RecordBatch]:
    """(group, cell) to read: in the first round, each query's best annuli until they hold 4·k rows; then those that its bound leaves."""
    for batch in batches:
        for i in range(batch.num_rows):
            queries = _matrix(batch.column("v").slice(i, 1), dimension)
            upper = _bounds(queries, cells.value, held.value, index)
            if first:
                order = np.argsort(-upper, axis=1, kind="stable")
                ahead = np.cumsum(cells.value[:, 3][order], 1) - cells.value[:, 3][order]
                wanted = np.zeros(upper.shape, bool)
                np.put_along_axis(wanted, order, ahead < 4 * k, 1)
            else:
                wanted = upper >= np.asarray(batch.column("floors")[i].values)[:, None]
            used = np.flatnonzero(wanted.any(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), batch.column("key")[i].as_py())), pa.array(cells.value[used, 0].astype(np.int32)), pa.array(cells.value[used, 4].astype(np.int32))], names=["group", "cell", "salts"]
            )


def _multiply(batches: Iterator[pa.RecordBatch], dimension: int, k: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """The k best of each query of the group in the block; ties to the smaller id."""
    for batch in batches:
        for i in range(batch.num_rows):
            query_ids, block_ids, block_rows = (np.asarray(batch.column(c)[i].values) for c in ("query_ids", "ids", "at"))
            q, x = (_matrix(batch.column(c).slice(i, 1), dimension) for c in ("q", "v"))
            if exact:
                scores = (q @ x.T).astype(np.int64)
            else:
                scores = np.array([[sum(int(a) * int(b) for a, b in zip(u, w)) for w in x] for u in q], object)
                if len(scores) and max(abs(int(s)) for s in scores.ravel()) >> 63:
                    raise OverflowError("a score does not fit a long")
                scores = scores.astype(np.int64)
            same = query_ids[:, None] == block_ids[None]
            if len(block_ids) > 4 * k:
                others = np.where(same, np.iinfo(np.int64).min + 1, scores)
                edge = -np.partition(-others, k - 1, axis=1)[:, k - 1 : k]
                row, at = np.nonzero((scores >= edge) & ~same)
            else:
                row, at = np.nonzero(~same)
            order = np.lexsort((block_ids[at], -scores[row, at], row))
            row, at = row[order], at[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[best], at[best]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(block_ids[at]), pa.array(block_rows[at]), pa.array(scores[row, at])], names=["query_id", "vec_id", "at", "score"])


def top_k(embeddings: DataFrame, k: int = 5, query_modulus: int = 50, index: PivotIndex = PivotIndex()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product with each query, ties to the smaller id.

    Queries are rows whose vec_id is divisible by ``query_modulus``; candidates are all rows but those of the query's own id.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id. Vectors are
    compared with those of their own dimension only. Rows that share an id, or repeat id and vector, are candidates each; a
    query id of several rows is one query, which scores a candidate by the best of its vectors. A query with fewer than k candidates gets all of them; an empty table gives no rows.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * index.scale).cast("double"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter("vec_id is not null and size(embedding) > 0").filter(usable).select("vec_id", whole.alias("v"))
    rows = checkpointed(rows.withColumn("at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect()
    out = [_of_dimension(rows.filter(F.size("v") == r["n"]), r["n"], k, query_modulus, index) for r in sizes if r["rows"] > 1]
    if not out:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def _of_dimension(rows: DataFrame, dimension: int, k: int, modulus: int, index: PivotIndex) -> DataFrame:
    context = rows.sparkSession.sparkContext
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    about = rows.agg(F.max(square).alias("bound"), F.count("*").alias("n")).first()
    bound = about["bound"]
    # Components below 2^24 are exact as floats.
    kind = "float" if bound < 1 << 48 else "double"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    sample = np.array([r["v"] for r in hash_sample(rows, about["n"], ("vec_id", "v"), index.sample_rows).collect()], float)
    pivots = max(2, min(index.pivots, about["n"] // (index.annuli * index.block_rows)))
    held = context.broadcast(layout(sample, bound, pivots, index))
    exact = bound < EXACT
    keyed = checkpointed(rows.mapInArrow(lambda b: _index(b, held, index), INDEXED.format(kind)))
    # At most pivots × annuli rows.
    is_query = F.col("vec_id") % modulus == 0
    stats = keyed.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries")).orderBy("cell").collect()
    cells = context.broadcast(np.array([(r["cell"], r["low"], r["high"], r["n"], -(-r["n"] // index.block_rows)) for r in stats]))
    size = len(held.value.pivots) * index.annuli
    by_cell = lambda values: F.element_at(F.lit([int(x) for x in values]), F.col("cell") + 1).cast("long")
    place = cells.value[:, 0].astype(int)
    spread = F.xxhash64("at")
    salt = F.pmod(spread, by_cell(np.bincount(place, cells.value[:, 4], size)))
    blocks = keyed.select((F.col("cell").cast("long") * (1 << 32) + salt).alias("key"), "vec_id", "at", "v").groupBy("key").applyInArrow(_pack, PACKED.format(kind))
    blocks = checkpointed(blocks)
    # Queries of neighbouring cells share a group until it is full, so that they want the same annuli; a cell of more queries
    # than a group holds is dealt to several.
    asked = np.array([r["queries"] for r in stats])
    opens = (np.cumsum(asked) - asked) // index.group_rows
    groups = np.maximum(1, -(-asked // index.group_rows))
    key = by_cell(np.bincount(place, opens, size)) * (1 << 32) + F.pmod(spread, by_cell(np.maximum(1, np.bincount(place, groups, size))))
    queries = keyed.filter(is_query).dropDuplicates(["vec_id", "v"])
    packed = queries.select(key.alias("key"), "vec_id", "at", "v").groupBy("key").applyInArrow(_pack, PACKED.format(kind))
    packed = checkpointed(packed).select("key", F.col("ids").alias("query_ids"), "v")

    def read(route: DataFrame) -> DataFrame:
        wanted = route.select("group", (F.col("cell").cast("long") * (1 << 32)).alias("base"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        pairs = wanted.select("group", (F.col("base") + F.col("salt")).alias("key"))
        both = pairs.join(blocks, "key").join(packed.select(F.col("key").alias("group"), "query_ids", F.col("v").alias("q")), "group")
        return both.select("query_ids", "q", "ids", "at", "v").mapInArrow(lambda b: _multiply(b, dimension, k, exact), "query_id long, vec_id long, at long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "at")
        # A row that several vectors of one query id have met counts once.
        found = found.groupBy("query_id", "vec_id", "at").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    route = "group long, cell int, salts int"
    begun = checkpointed(packed.mapInArrow(lambda b: _route(b, cells, held, index, dimension, k, True), route))
    first = checkpointed(read(begun))
    # A query's floor: the k-th score so far; below every score while it has fewer.
    floors = best(first).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    each = packed.select("key", F.posexplode("query_ids").alias("place", "query_id")).join(floors, "query_id", "left")
    each = each.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))), lambda x: x["floor"]).alias("floors"))
    onward = packed.join(each, "key").mapInArrow(lambda b: _route(b, cells, held, index, dimension, k, False), route)
    rest = read(onward.join(begun.select("group", "cell"), ["group", "cell"], "left_anti"))
    return best(first.union(rest)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
