"""Order-dependent clean-up: lines in bounded groups, near features in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import DEG_TO_MTR_LAT, dist_m
from tessera.operators.network import checkpointed


def _simplified(x: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of all lines stay: ends do, and of each span the farthest point beyond the tolerance, again and again.

    A line is the places ``first`` to ``last``; the spans of all lines are looked at together.
    """
    keep = np.zeros(len(x), bool)
    keep[first] = keep[last] = True
    a, b = first, last
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            return keep
        inner = b - a - 1
        begin = np.cumsum(inner) - inner
        span = np.repeat(np.arange(len(a)), inner)
        at = np.arange(len(span)) - begin[span] + a[span] + 1
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = np.hypot(dx, dy)
        px, py = x[at] - x[a][span], y[at] - y[a][span]
        across = np.abs(dx[span] * py - dy[span] * px) / np.where(length == 0, 1, length)[span]
        far = np.where((length == 0)[span], np.hypot(px, py), across)
        most = np.maximum.reduceat(far, begin)
        # The first of the farthest ones.
        k = np.minimum.reduceat(np.where(far == most[span], at, len(x)), begin)
        split = most > tolerance
        a, b, k = a[split], b[split], k[split]
        keep[k] = True
        a, b = np.concatenate((a, k)), np.concatenate((k, b))


def _simplify(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """Lines in order, of which one may go on in the next batch."""
    held = None
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches([batch]) if batch is not None else None
        rows = pa.concat_tables([t for t in (held, rows) if t is not None]).combine_chunks() if held is not None or rows is not None else None
        if rows is None or not len(rows):
            continue
        ends = np.asarray(pc.run_end_encode(rows.column(0).chunk(0)).run_ends) - 1
        if batch is not None:
            n = int(ends[-2]) + 1 if len(ends) > 1 else 0
            held, rows, ends = rows.slice(n), rows.slice(0, n), ends[:-1]
        if len(rows):
            x, y = (rows.column(c).to_numpy().astype(float) for c in ("lon", "lat"))
            yield from rows.filter(pa.array(_simplified(x, y, np.append(0, ends[:-1] + 1), ends, tolerance))).to_batches()


def simplify_lines(points: DataFrame, chain: str, tolerance: float) -> DataFrame:
    """Points (chain, pos, lon, lat) that a polyline simplification keeps. Many lines go through one call, one line at least."""
    named = points.select(chain, "pos", "lon", "lat")
    return named.repartition(chain).sortWithinPartitions(chain, "pos").mapInArrow(lambda batches: _simplify(batches, tolerance), named.schema)


def remove_near_duplicates(features: DataFrame, distance_m: float) -> DataFrame:
    """Of two features (id, face_id, rank, lon, lat) of a face that are nearer than the distance, the one of lower rank goes.

    Greedy in the order of rank (high first), then id: a feature stays if no feature that stays is near. Any two features in one
    square of the grid are near, so at most one of a square stays, and pairs of features are never formed. Round by round the
    best that is left of each square stays if no square within reach has a better one left, and what is near it goes. A round
    holds the best feature of each square and of each place at most; the best of all stays in every round, and where ranks have
    nothing to do with places a few rounds do. Features without a face or place are near nothing.
    """
    degrees = distance_m / DEG_TO_MTR_LAT
    side = degrees / 2**0.5 * (1 - 1e-9)
    grid = lambda c: F.floor(c / side).cast("long")
    placed = F.col("face_id").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    # What is near one of the features of a place is near all of them, so the best stands for the others.
    order = F.struct(F.coalesce(-F.col("rank").cast("double"), F.lit(float("nan"))).alias("rank"), "id").alias("order")
    best = features.filter(placed).groupBy("face_id", "lon", "lat").agg(F.min(order).alias("order"))
    left = checkpointed(best.select("*", grid(F.col("lon")).alias("cx"), grid(F.col("lat")).alias("cy")))
    wide = degrees * 1.000001 / F.greatest(F.cos(F.radians(F.abs("lat") + degrees)), F.lit(1e-3))
    over = lambda c, reach: F.explode(F.sequence(grid(F.col(c) - reach), grid(F.col(c) + reach)))

    def looking(rows: DataFrame) -> DataFrame:
        """``rows`` in each square within their reach."""
        own = rows.select("face_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("order").alias("order1"), over("lon", wide).alias("cx"), "lat")
        return own.select("face_id", "lon1", "lat1", "order1", "cx", over("lat", F.lit(degrees * 1.000001)).alias("cy"))

    stays = []
    while not left.isEmpty():
        first = checkpointed(left.groupBy("face_id", "cx", "cy").agg(F.min_by(F.struct("lon", "lat", "order"), "order").alias("f")).select("face_id", "cx", "cy", "f.*"))
        beaten = looking(first).join(first.select("face_id", "cx", "cy", "order"), ["face_id", "cx", "cy"]).filter(F.col("order") < F.col("order1"))
        stay = checkpointed(first.join(beaten.select("face_id", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), ["face_id", "lon", "lat"], "left_anti"))
        near = dist_m(*map(F.col, ("lon1", "lat1", "lon", "lat"))) <= distance_m
        gone = left.join(looking(stay), ["face_id", "cx", "cy"]).filter(near).select("face_id", "lon", "lat")
        left = checkpointed(left.join(gone, ["face_id", "lon", "lat"], "left_anti"))
        stays.append(stay.select("face_id", "lon", "lat", F.col("order.id").alias("id")))
    if not stays:
        return features
    kept = features.filter(placed).join(reduce(DataFrame.union, stays), ["face_id", "lon", "lat", "id"], "left_semi").select(features.columns)
    return kept.union(features.filter(~placed))
