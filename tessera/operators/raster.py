"""Neighbourhood, resampling and overlay operators on cell tables (x, y, value), where null is a void cell.

Cells may carry further key columns, such as a layer or a tile; ``keys`` names them, and neighbours agree in them. Neighbour
operators send each cell to the places that it is a neighbour of, so one shuffle with partial aggregation serves any kernel;
those that need all values of a window at once send it to its square instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType

Keys = Sequence[str]
Offset = tuple[int, int]
EIGHT: list[Offset] = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
FOUR: list[Offset] = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def around(cells: DataFrame, offsets: Sequence[Offset], keys: Keys = (), **aggregates: Column) -> DataFrame:
    """For each cell, aggregates over the cells at ``offsets`` from it that exist.

    In the aggregates, ``value`` is the neighbour's value, ``dx``, ``dy`` where it lies and ``slot`` its place in ``offsets``;
    ``own`` of the result is the cell's own value.
    """
    places = [(0, 0, -1), *[(dx, dy, i) for i, (dx, dy) in enumerate(offsets)]]
    at = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(i).alias("slot")) for dx, dy, i in places]))
    sent = cells.select(*keys, "x", "y", "value", at.alias("at")).select(*keys, (F.col("x") - F.col("at.dx")).alias("x"), (F.col("y") - F.col("at.dy")).alias("y"), "value", "at.dx", "at.dy", "at.slot")
    # Plain maxima: of structs they would be sorted for, all places of a task at a time.
    own, here = F.max(F.when(F.col("slot") < 0, F.col("value"))), F.max(F.col("slot") < 0)
    near = F.col("slot") >= 0
    grouped = sent.groupBy(*keys, "x", "y").agg(own.alias("own"), here.alias("_here"), *[agg(near).alias(name) for name, agg in aggregates.items()])
    return grouped.filter("_here").drop("_here")


def box(radius: int) -> list[Offset]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


#: Least side of the squares that windows are worked out in, and neighbours that a task looks at in one step.
SIDE, STEP = 64, 1 << 20

#: Results of ``n`` windows, of (n, at, row, near): neighbour k lies in window at[k] (ascending) and is row row[k] of the square,
#: and near[k] is false for the cells of the window's own place.
Summary = Callable[[int, np.ndarray, np.ndarray, np.ndarray], pa.Array]


def in_windows(cells: DataFrame, radius: int, keys: Keys, summary: Callable[[pa.ChunkedArray], Summary], result: DataType) -> DataFrame:
    """(keys, x, y, value): for each cell, what ``summary`` of its square's values makes of the cells in its window, itself included.

    Each square is worked out with a halo of ``radius``, so a cell is shuffled about once, and no window's list is shuffled, sorted
    by Spark or kept for longer than a step. A square is at most (side + 2 radius)² cells, if no place has several; these all count.
    """
    side = max(SIDE, 8 * radius)
    width = side + 2 * radius
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))
    sent = cells.select(*keys, "x", "y", "value").withColumn("_sx", spread("x")).withColumn("_sy", spread("y"))
    kept = [*keys, "x", "y"]
    kind = pa.float64() if isinstance(result, DoubleType) else pa.int64()

    def told(key: tuple, group: pa.Table) -> pa.Table:
        i, j = (group.column(c).to_numpy().astype(np.int64) - key[k].as_py() * side + radius for c, k in (("x", -2), ("y", -1)))
        place = j * width + i
        order = np.argsort(place, kind="stable")
        rows, place = group.take(pa.array(order)), place[order]
        # The rows of place p are first[p] up to first[p + 1], so a window's row of places is one run.
        first = np.searchsorted(place, np.arange(width * width + 1))
        own = np.flatnonzero(np.diff(first))
        own = own[(own % width >= radius) & (own % width < radius + side) & (own // width >= radius) & (own // width < radius + side)]
        begin = own[:, None] + width * np.arange(-radius, radius + 1) - radius
        low = first[begin]
        count = first[begin + 2 * radius + 1] - low
        ends = np.cumsum(count.sum(axis=1))
        of_windows, values = summary(rows.column("value")), []
        cuts = [0, *(np.flatnonzero(np.diff(ends // STEP)) + 1), len(own)] if len(own) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            run = count[a:b].ravel()
            at = np.repeat(np.arange(b - a), count[a:b].sum(axis=1))
            row = np.arange(len(at)) + np.repeat(low[a:b].ravel() - np.cumsum(run) + run, run)
            values.append(of_windows(b - a, at, row, place[row] != own[a:b][at]))
        return rows.take(pa.array(first[own])).select(kept).append_column("value", pa.chunked_array(values, kind))

    schema = StructType([*[cells.schema[c] for c in kept], StructField("value", result)])
    return sent.groupBy(*keys, "_sx", "_sy").applyInArrow(told, schema)


def fill_scanline_gaps(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Void runs of a row become a line between their valid ends; runs at the row's ends copy the nearest."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    known = F.when(F.col("value").isNotNull(), F.struct("x", "value"))
    before = F.last(known, True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    # The same frame over the descending row: a frame that ends unbounded is built anew for each of its rows.
    behind = F.last(known, True).over(Window.partitionBy(*keys, "y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0))
    ends = cells.withColumn("_a", before).withColumn("_b", behind)
    share = (F.col("x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    between = F.col("_a.value") + share * (F.col("_b.value") - F.col("_a.value"))
    filled = F.coalesce("value", between, "_a.value", "_b.value")
    return ends.withColumn("value", filled).drop("_a", "_b")


def _nearest(axis: str, other: str, keys: Keys) -> Column:
    """Struct (far, value) of the nearest valid neighbour along an axis; the later one on a tie."""
    line, back_line = (Window.partitionBy(*keys, other).orderBy(order) for order in (F.col(axis), F.desc(axis)))
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(axis).alias("at"), F.col("value").alias("value")))
    low = F.last(known, True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    high = F.last(known, True).over(back_line.rowsBetween(Window.unboundedPreceding, -1))
    back, ahead = F.col(axis) - low["at"], high["at"] - F.col(axis)
    take_low = high.isNull() | (low.isNotNull() & (back < ahead))
    return F.when(take_low, F.struct((low["at"] - F.col(axis)).alias("far"), low["value"].alias("value"))).otherwise(F.struct((high["at"] - F.col(axis)).alias("far"), high["value"].alias("value")))


def surface_normals(cells: DataFrame, spacing: float, keys: Keys = ()) -> DataFrame:
    """Adds the unit normal (nx, ny, nz) of each valid cell from its nearest valid neighbours in row and column."""
    with_row = cells.withColumn("_h", _nearest("x", "y", keys))
    both = with_row.withColumn("_v", _nearest("y", "x", keys))
    rise = lambda c: F.coalesce((F.col(f"{c}.value") - F.col("value")) / (F.col(f"{c}.far") * spacing), F.lit(0.0))
    gx, gy = rise("_h"), rise("_v")
    length = F.sqrt(gx * gx + gy * gy + 1)
    valid = F.col("value").isNotNull()
    return both.select(*cells.columns, F.when(valid, -gx / length).alias("nx"), F.when(valid, -gy / length).alias("ny"), F.when(valid, 1 / length).alias("nz"))


def slope_aspect(cells: DataFrame, spacing: float, keys: Keys = ()) -> DataFrame:
    """Adds slope (1 − nz) and aspect (the northward share of the normal's level part; 0 on level ground)."""
    n = surface_normals(cells, spacing, keys)
    level = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    return n.select(*cells.columns, (1 - F.col("nz")).alias("slope"), F.when(F.col("nz").isNull(), None).when(level == 0, 0.0).otherwise(F.col("ny") / level).alias("aspect"))


def convolve(cells: DataFrame, kernel: dict[Offset, float], normalised: bool, keys: Keys = ()) -> DataFrame:
    """Weighted sum of the valid cells under the kernel, or their weighted mean; void if none is valid (0 for the sum)."""
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in kernel.values()]), F.col("slot") + 1)
    valued = lambda near: near & F.col("value").isNotNull()
    out = around(cells, list(kernel), keys, total=lambda near: F.sum(F.when(valued(near), F.col("value") * weights)), weight=lambda near: F.sum(F.when(valued(near), weights)))
    value = F.col("total") / F.col("weight") if normalised else F.coalesce("total", F.lit(0.0))
    return out.select(*keys, "x", "y", value.alias("value"))


def gaussian_blur(cells: DataFrame, sigma: float, keys: Keys = ()) -> DataFrame:
    """Separable blur of radius ⌈3σ⌉, renormalised over valid cells, columns first."""
    radius = math.ceil(3 * sigma)
    weight = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)}
    vertical = convolve(cells, {(0, d): w for d, w in weight.items()}, True, keys)
    return convolve(vertical, {(d, 0): w for d, w in weight.items()}, True, keys)


def _trimmed(value: pa.ChunkedArray) -> Summary:
    number, valid = value.to_numpy(), np.asarray(value.is_valid())

    def means(n: int, at: np.ndarray, row: np.ndarray, near: np.ndarray) -> pa.Array:
        known = valid[row]
        at, found = at[known], number[row[known]]
        found = found[np.lexsort((found, at))]
        size = np.bincount(at, minlength=n)
        low, high = size // 8, size // 3
        rank = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        inner = (rank >= low[at]) & (rank < (size - high)[at])
        total = np.bincount(at[inner], found[inner], n)
        return pa.array(total / np.maximum(size - low - high, 1), pa.float64(), mask=size == 0)

    return means


def trimmed_mean(cells: DataFrame, radius: int = 2, keys: Keys = ()) -> DataFrame:
    """Mean of the window's valid values without the lowest n/8 and the highest n/3 (integer quotients)."""
    return in_windows(cells.withColumn("value", F.col("value").cast("double")), radius, keys, _trimmed, DoubleType())


def max_neighbour_difference(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Largest absolute difference from the eight neighbours; 0 for a void cell or one without valid neighbours."""
    out = around(cells, EIGHT, keys, low=lambda near: F.min(F.when(near, F.col("value"))), high=lambda near: F.max(F.when(near, F.col("value"))))
    most = F.greatest(F.col("own") - F.col("low"), F.col("high") - F.col("own"))
    return out.select(*keys, "x", "y", F.coalesce(most, F.lit(0.0)).alias("value"))


def _disagreeing(value: pa.ChunkedArray, places: int) -> Summary:
    # Values by their rank, voids as -1: equal ranks are equal values.
    valid = np.asarray(value.is_valid())
    rank = np.full(len(value), -1)
    rank[valid] = np.unique(value.drop_null().to_numpy(), return_inverse=True)[1]

    def counts(n: int, at: np.ndarray, row: np.ndarray, near: np.ndarray) -> pa.Array:
        own = np.full(n, -1)
        np.maximum.at(own, at[~near], rank[row[~near]])
        at, row = at[near], row[near]
        same = np.bincount(at[rank[row] == own[at]], minlength=n)
        held = np.bincount(at, minlength=n)
        return pa.array(np.where(own < 0, held, places) - same, pa.int64())

    return counts


def neighbour_disagreement(cells: DataFrame, radius: int, keys: Keys = ()) -> DataFrame:
    """How many places of the window hold another value; places outside the raster count as void."""
    places = len(box(radius)) - 1
    return in_windows(cells, radius, keys, lambda value: _disagreeing(value, places), LongType())


def border_cells(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Valid cells beside a void cell of the raster (four neighbours)."""
    out = around(cells, FOUR, keys, voids=lambda near: F.sum(F.when(near & F.col("value").isNull(), 1)))
    return out.filter("own is not null and voids > 0").select(*keys, "x", "y", F.col("own").alias("value"))


def erode(cells: DataFrame, steps: int, keys: Keys = ()) -> DataFrame:
    """Each step voids the cells beside a void cell of the raster (eight neighbours)."""
    out = cells.select(*keys, "x", "y", "value")
    for _ in range(steps):
        out = around(out, EIGHT, keys, voids=lambda near: F.sum(F.when(near & F.col("value").isNull(), 1)))
        out = out.select(*keys, "x", "y", F.when(F.col("voids").isNull(), F.col("own")).alias("value"))
    return out


def spread_directional(cells: DataFrame, distance: int, keys: Keys = ()) -> DataFrame:
    """A void cell takes the first valid value at distance 1, 2, …, looking W, E, S, N, SE, NE, SW, NW at each."""
    directions = [(-1, 0), (1, 0), (0, -1), (0, 1), (1, -1), (1, 1), (-1, -1), (-1, 1)]
    offsets = [(dx * n, dy * n) for n in range(1, distance + 1) for dx, dy in directions]
    out = around(cells, offsets, keys, found=lambda near: F.min_by("value", F.when(near & F.col("value").isNotNull(), F.col("slot"))))
    return out.select(*keys, "x", "y", F.coalesce("own", "found").alias("value"))


def local_rise(cells: DataFrame, size: int, keys: Keys = ()) -> DataFrame:
    """Maximum minus minimum of each size × size window; void if either lies only on the window's edge."""
    bx, by = F.floor(F.col("x") / size).cast("long"), F.floor(F.col("y") / size).cast("long")
    inner = (F.col("x") % size).between(1, size - 2) & (F.col("y") % size).between(1, size - 2)
    inside = F.when(inner, F.col("value"))
    grouped = cells.groupBy(*keys, bx.alias("bx"), by.alias("by")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min(inside).alias("low_in"), F.max(inside).alias("high_in"))
    return grouped.select(*keys, "bx", "by", F.when((F.col("low") == F.col("low_in")) & (F.col("high") == F.col("high_in")), F.col("high") - F.col("low")).alias("value"))


def _block(size: int) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(c) for c in ("x", "y")]


def downsample_mean(cells: DataFrame, size: int, keys: Keys = ()) -> DataFrame:
    return cells.groupBy(*keys, *_block(size)).agg(F.avg("value").alias("value"))


def downsample_nearest(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Half the size: of each 2 × 2 block the first valid of its samples 2, 3, 4 (row by row), else sample 1."""
    sample = (F.col("x") % 2) + 2 * (F.col("y") % 2)
    rank = F.when(sample == 0, 4).otherwise(sample)
    return cells.groupBy(*keys, *_block(2)).agg(F.min_by("value", F.when(F.col("value").isNotNull(), rank)).alias("value"))


def block_min_max(cells: DataFrame, size: int, keys: Keys = ()) -> DataFrame:
    return cells.groupBy(*keys, *_block(size)).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def relative_elevation(cells: DataFrame, size: int = 8, keys: Keys = ()) -> DataFrame:
    """(x, y, value, range, relative): each cell against the minimum and maximum of its block; 0 on a level block."""
    blocks = block_min_max(cells, size, keys).withColumnsRenamed({"x": "bx", "y": "by"})
    placed = cells.withColumn("bx", F.floor(F.col("x") / size).cast("long")).withColumn("by", F.floor(F.col("y") / size).cast("long"))
    joined = placed.join(blocks, [*keys, "bx", "by"])
    span = F.col("high") - F.col("low")
    share = F.when(span == 0, F.when(F.col("value").isNotNull(), 0.0)).otherwise((F.col("value") - F.col("low")) / F.nullif(span, F.lit(0.0)))
    return joined.select(*keys, "x", "y", "value", span.alias("range"), share.alias("relative"))


def upsample(cells: DataFrame, times: int, keys: Keys = ()) -> DataFrame:
    """Each cell as times × times cells of its value."""
    step = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    wide = cells.select(*keys, "x", "y", "value", step.alias("i")).select("*", step.alias("j"))
    return wide.select(*keys, (F.col("x") * times + F.col("i")).alias("x"), (F.col("y") * times + F.col("j")).alias("y"), "value")


def sample_bilinear(points: DataFrame, cells: DataFrame, id_column: str, keys: Keys = ()) -> DataFrame:
    """(id, value): bilinear value at (px, py) in cell units; void corners weigh nothing, no valid corner gives null."""
    fx, fy = F.floor("px").cast("long"), F.floor("py").cast("long")
    ax, ay = F.col("px") - fx, F.col("py") - fy
    corners = F.array(*[F.struct((fx + i).alias("x"), (fy + j).alias("y"), ((ax if i else 1 - ax) * (ay if j else 1 - ay)).alias("w")) for j in (0, 1) for i in (0, 1)])
    wanted = points.select(id_column, *keys, F.explode(corners).alias("c")).select(id_column, *keys, "c.x", "c.y", "c.w")
    met = wanted.join(cells.select(*keys, "x", "y", "value"), [*keys, "x", "y"], "left")
    weight = F.when(F.col("value").isNotNull(), F.col("w"))
    return met.groupBy(id_column).agg((F.sum(F.col("value") * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("value"))


def sample_nearest(points: DataFrame, cells: DataFrame, id_column: str, keys: Keys = ()) -> DataFrame:
    """(id, value): the cell nearest to (px, py), a fraction over one half rounding up; null if void or outside."""
    near = lambda c: F.ceil(F.col(c) - 0.5).cast("long")
    wanted = points.select(id_column, *keys, near("px").alias("x"), near("py").alias("y"))
    return wanted.join(cells.select(*keys, "x", "y", "value"), [*keys, "x", "y"], "left").select(id_column, "value")


#: Corners of a place between four cells, as (right, up), in the order in which a valid one is taken; by (right half, upper half).
QUADRANTS = {
    (False, False): [(0, 0), (1, 0), (0, 1), (1, 1)],
    (True, False): [(1, 0), (1, 1), (0, 0), (0, 1)],
    (False, True): [(0, 1), (1, 1), (0, 0), (1, 0)],
    (True, True): [(1, 1), (0, 1), (1, 0), (0, 0)],
}


def sample_nearest_valid(points: DataFrame, cells: DataFrame, id_column: str, keys: Keys = ()) -> DataFrame:
    """(id, value): as ``sample_nearest``, but where that cell is void or missing the other three around (px, py) follow in the
    order of the place's quadrant; null if all four are."""
    fx, fy = F.floor("px").cast("long"), F.floor("py").cast("long")
    right, up = F.col("px") - fx > 0.5, F.col("py") - fy > 0.5
    corners = lambda order: F.array(*[F.struct((fx + i).alias("x"), (fy + j).alias("y"), F.lit(n).alias("n")) for n, (i, j) in enumerate(order)])
    by_quadrant = F.coalesce(*[F.when((right == r) & (up == u), corners(order)) for (r, u), order in QUADRANTS.items()])
    wanted = points.select(id_column, *keys, F.explode(by_quadrant).alias("c")).select(id_column, *keys, "c.x", "c.y", "c.n")
    met = wanted.join(cells.select(*keys, "x", "y", "value"), [*keys, "x", "y"], "left")
    return met.groupBy(id_column).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("n"))).alias("value"))


def histogram(cells: DataFrame) -> DataFrame:
    return cells.filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def percentile_from_histogram(counts: DataFrame, share: float) -> DataFrame:
    """First value whose cumulative share reaches ``share``; the window runs over distinct values only."""
    upto = F.sum("n").over(Window.orderBy("value"))
    total = F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select("value", upto.alias("upto"), total.alias("total")).filter(F.col("upto") >= F.col("total") * share).agg(F.min("value").alias("value"))


def overlay(base: DataFrame, top: DataFrame, keys: Keys = ()) -> DataFrame:
    """Valid values of ``top`` replace those of ``base``; cells of either are kept."""
    both = base.select(*keys, "x", "y", F.col("value").alias("_b")).join(top.select(*keys, "x", "y", F.col("value").alias("_t")), [*keys, "x", "y"], "full")
    return both.select(*keys, "x", "y", F.coalesce("_t", "_b").alias("value"))


def difference(top: DataFrame, base: DataFrame, keys: Keys = ()) -> DataFrame:
    """top − base where both are valid, else 0."""
    both = top.select(*keys, "x", "y", F.col("value").alias("_t")).join(base.select(*keys, "x", "y", F.col("value").alias("_b")), [*keys, "x", "y"])
    return both.select(*keys, "x", "y", F.coalesce(F.col("_t") - F.col("_b"), F.lit(0.0)).alias("value"))


def mask_overlay(base: DataFrame, top: DataFrame, mask: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mask 0 keeps base, 255 takes top, between they mix in proportion."""
    named = lambda df, name: df.select(*keys, "x", "y", F.col("value").alias(name))
    on = [*keys, "x", "y"]
    both = named(base, "_b").join(named(top, "_t"), on).join(named(mask, "_m"), on)
    share = F.col("_m") / 255
    value = F.when(F.col("_m") == 0, F.col("_b")).when(F.col("_m") == 255, F.col("_t")).otherwise(F.col("_b") * (1 - share) + F.col("_t") * share)
    return both.select(*on, value.alias("value"))
