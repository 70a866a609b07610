"""Operators that need several passes over a raster: pyramids, regions, flow, urban layers. Cells are (x, y, value), null is void."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.operators.network import checkpointed, components


def spread_nearest(cells: DataFrame, levels: int) -> DataFrame:
    """Void cells take the value of the half-size grid, that grid's voids those of its own half, and so on for ``levels``."""
    if levels == 0:
        return cells.select("x", "y", "value")
    coarse = spread_nearest(raster.downsample_nearest(cells), levels - 1)
    half = cells.withColumn("hx", F.floor(F.col("x") / 2)).withColumn("hy", F.floor(F.col("y") / 2))
    met = half.join(coarse.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("value").alias("_below")), ["hx", "hy"], "left")
    return met.select("x", "y", F.coalesce("value", "_below").alias("value"))


def frequency_split(cells: DataFrame, bands: int) -> DataFrame:
    """(band, x, y, value): band b is the mean over blocks of 2^b minus that over blocks of 2^(b+1); the last keeps the mean itself.

    Their null-aware sum gives the raster back.
    """
    # The widest blocks hold all others: cells are shuffled and sorted once, and all bands come from one pass.
    block = lambda b: {f"_{c}{b}": F.floor(F.col(c) / (2 << b)) for c in ("x", "y")}
    now, within, kept = cells.select("x", "y", "value"), [], F.col("value")
    for b in reversed(range(bands)):
        now = now.withColumns(block(b))
        now = now if within else now.repartition(*block(b))
        within += block(b)
    for b in range(bands):
        now = now.withColumn("_mean", F.avg("value").over(Window.partitionBy(*within[: 2 * (bands - b)])))
        now = now.withColumns({f"_band{b}": kept - F.col("_mean"), "value": F.when(kept.isNotNull(), F.col("_mean"))})
    values = [*[F.col(f"_band{b}") for b in range(bands)], kept]
    rows = now.select("x", "y", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in enumerate(values)])).alias("_r"))
    return rows.select("_r.band", "x", "y", "_r.value")


def line_integral(lines: DataFrame, cells: DataFrame, id_column: str, steps: int) -> DataFrame:
    """(id, value): mean of the nearest cells at ``steps`` + 1 even places of a segment (x1, y1, x2, y2), times its length."""
    spots = lines.select(id_column, "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    share = F.col("i") / steps
    spots = spots.select(F.struct(id_column, "i").alias("_spot"), (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("px"), (F.col("y1") + share * (F.col("y2") - F.col("y1"))).alias("py"))
    means = raster.sample_nearest(spots, cells, "_spot").groupBy(F.col(f"_spot.{id_column}").alias(id_column)).agg(F.avg("value").alias("mean"))
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    return lines.join(means, id_column).select(id_column, (F.col("mean") * length).alias("value"))


def regions(cells: DataFrame, width: int) -> DataFrame:
    """(x, y, value, region): 4-connected cells of one value; the region is its smallest cell number y · width + x.

    First runs of a row are found by a window, so that only runs, not cells, take part in the connected components.
    """
    row = Window.partitionBy("y").orderBy("x")
    starts = ~(F.lag("value").over(row).eqNullSafe(F.col("value")) & (F.lag("x").over(row) == F.col("x") - 1))
    number = F.col("y") * width + F.col("x")
    marked = cells.filter("value is not null").select("x", "y", "value", F.when(F.coalesce(starts, F.lit(True)), number).alias("_s"))
    runs = marked.withColumn("run", F.last("_s", True).over(row.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    above = runs.select("x", (F.col("y") + 1).alias("y"), F.col("value").alias("_v"), F.col("run").alias("src"))
    edges = runs.join(above, ["x", "y"]).filter("value = _v").select("src", F.col("run").alias("dst")).distinct()
    found = components(edges).select(F.col("node").alias("run"), "component")
    return runs.join(found, "run", "left").select("x", "y", "value", F.coalesce("component", "run").alias("region"))


def eliminate_small_regions(cells: DataFrame, value: float, least: int, width: int) -> DataFrame:
    """Regions of ``value`` with fewer than ``least`` cells become void."""
    placed = regions(cells, width).filter(F.col("value") == value)
    small = placed.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    gone = placed.join(small, "region").select("x", "y", F.lit(True).alias("_gone"))
    return cells.join(gone, ["x", "y"], "left").select("x", "y", F.when(F.col("_gone").isNull(), F.col("value")).alias("value"))


#: Directions of flow, in the order in which ties are decided.
FLOW = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def flow_direction(cells: DataFrame) -> DataFrame:
    """(x, y, direction): towards the largest drop (not gradient) among the eight neighbours; null without a positive drop."""
    out = raster.around(cells, FLOW, low=lambda near: F.min(F.when(near & F.col("value").isNotNull(), F.struct("value", "slot"))))
    drop = F.col("low.value") < F.col("own")
    return out.select("x", "y", F.when(drop, F.col("low.slot")).alias("direction"))


def raster_merge(base: DataFrame, over: DataFrame, radius: int) -> DataFrame:
    """``over`` laid on ``base`` with a soft edge: near voids of the overlay the base shines through.

    The weight of the base at a cell is the largest kernel weight (1 at a void, falling in proportion to the distance) that a
    void of the overlay reaches it with; an overlay without voids covers everything.
    """
    reach = [(dx, dy) for dx, dy in raster.box(radius) if dx * dx + dy * dy < radius * radius]
    near = raster.around(over, reach, far=lambda near: F.min(F.when(near & F.col("value").isNull(), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))))
    weight = F.coalesce(1 - F.col("far") / radius, F.lit(0.0))
    both = base.select("x", "y", F.col("value").alias("_b")).join(near.select("x", "y", F.col("own").alias("_o"), weight.alias("_w")), ["x", "y"])
    mixed = F.col("_b") * F.col("_w") + F.col("_o") * (1 - F.col("_w"))
    return both.select("x", "y", F.when(F.col("_o").isNull(), F.col("_b")).when(F.col("_w") == 0, F.col("_o")).otherwise(F.coalesce(mixed, F.col("_o"))).alias("value"))


def urban_density(landuse: DataFrame, weights: dict[int, float], size: int = 8) -> DataFrame:
    """(x, y, value): land-use weights, mean over blocks, then the mean of 3 × 3 blocks, held in 0 … 1."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weighed = landuse.select("x", "y", F.coalesce(F.try_element_at(table, F.col("value").cast("int")), F.lit(0.0)).alias("value"))
    smooth = raster.convolve(raster.downsample_mean(weighed, size), {o: 1.0 for o in raster.box(1)}, True)
    return smooth.select("x", "y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value")).alias("value"))


def fill_mode_flood(cells: DataFrame) -> DataFrame:
    """Void cells beside valid ones take the most frequent value of their eight neighbours, round by round.

    Neighbours count in the order SW, S, SE, W, E, NW, N, NE; of values that occur equally often the one that reaches that
    count first wins. All voids of a round look at the raster before it, so the result has one answer; it ends when a round
    fills nothing.
    """
    now = checkpointed(cells.select("x", "y", "value"))
    while True:
        order = F.row_number().over(Window.partitionBy("x", "y", "value").orderBy("slot"))
        at = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(i).alias("slot")) for i, (dx, dy) in enumerate(raster.EIGHT)]))
        valid = now.filter("value is not null").select("x", "y", "value", at.alias("at")).select((F.col("x") - F.col("at.dx")).alias("x"), (F.col("y") - F.col("at.dy")).alias("y"), "value", "at.slot")
        near = valid.join(now.filter("value is null").select("x", "y"), ["x", "y"], "left_semi").withColumn("k", order)
        best = near.groupBy("x", "y").agg(F.min_by("value", F.struct(-F.col("k"), F.col("slot"))).alias("_new"))
        filled = checkpointed(now.join(best, ["x", "y"], "left").select("x", "y", F.coalesce("value", "_new").alias("value"), F.col("_new").isNotNull().alias("_changed")))
        if filled.filter("_changed").isEmpty():
            return now
        now = filled.select("x", "y", "value")


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """(x, y, flow): how many cells drain through each cell (x, y, direction), itself included; directions as in ``FLOW``.

    Round k knows for each cell the cells less than 2^k steps upstream of it, and the cell 2^k steps downstream; both double in
    one grouped sum and one join, so the rounds follow the logarithm of the longest course. A direction off the raster ends a
    course. Cells on a circular course, which drops never make, get null.
    """
    table = lambda i: F.element_at(F.array(*[F.lit(step[i]) for step in FLOW]), (F.col("direction") + 1).cast("int"))
    cells = directions.select("x", "y", "direction")
    towards = F.when(F.col("direction").isNotNull(), F.struct((F.col("x") + table(0)).alias("x"), (F.col("y") + table(1)).alias("y")))
    there = cells.select(F.struct("x", "y").alias("to"), F.lit(True).alias("exists"))
    now = cells.select("x", "y", towards.alias("to")).join(there, "to", "left")
    now = checkpointed(now.select("x", "y", F.lit(1).cast("long").alias("flow"), F.when(F.col("exists"), F.col("to")).alias("to")))
    rounds = max(now.count(), 1).bit_length()
    for _ in range(rounds):
        if now.filter("to is not null").isEmpty():
            break
        arrives = now.filter("to is not null").groupBy("to").agg(F.sum("flow").alias("more")).select("to.x", "to.y", "more")
        next_ = now.select(F.struct("x", "y").alias("to"), F.col("to").alias("far"))
        jumped = now.join(next_, "to", "left").select("x", "y", "flow", F.col("far").alias("to"))
        now = checkpointed(jumped.join(arrives, ["x", "y"], "left").select("x", "y", (F.col("flow") + F.coalesce("more", F.lit(0))).alias("flow"), "to"))
    # After so many rounds only circles are left to jump in.
    circle = now.filter("to is not null").select("to.x", "to.y", F.lit(True).alias("circle")).distinct()
    return now.join(circle, ["x", "y"], "left").select("x", "y", F.when(F.col("circle").isNull(), F.col("flow")).alias("flow"))


#: Depth grows by 4 for each cell of distance beyond the first, from 1 to 50; what is farther does not matter.
DEEPEST, SHALLOWEST, PER_CELL = 50.0, 1.0, 4.0
FARTHEST = 1 + (DEEPEST - SHALLOWEST) / PER_CELL
#: Cells that a distance up to the farthest depends on: each step to a nearer neighbour takes off 1/√2 at least.
HALO = int(FARTHEST * 2**0.5) + 2


def shore_distance(land: np.ndarray, water: np.ndarray) -> np.ndarray:
    """Distance in cells from the land cells, by four sweeps from the four corners; other cells than land and water conduct nothing.

    A sweep visits the cells row by row, and a cell takes the upwind solution of its nearer neighbours in row and column if that is
    smaller. Cells of one diagonal do not touch, so a diagonal is done at once, in the same order otherwise.
    """
    height, width = land.shape
    far = np.full((height + 2, width + 2), np.inf)
    far[1:-1, 1:-1][land] = 0.0
    for rows, columns in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        view, wet = far[::rows, ::columns], water[::rows, ::columns]
        for k in range(height + width - 1):
            i = np.arange(max(0, k - width + 1), min(height, k + 1))
            j = k - i
            i, j = i[wet[i, j]] + 1, j[wet[i, j]] + 1
            a, b = np.minimum(view[i, j - 1], view[i, j + 1]), np.minimum(view[i - 1, j], view[i + 1, j])
            low = np.minimum(a, b)
            gap = np.maximum(a, b) - np.where(np.isinf(low), 0.0, low)
            near = gap < 1
            both = (a + b + np.sqrt(2 - np.where(near, gap, 0.0) ** 2)) / 2
            view[i, j] = np.minimum(view[i, j], np.where(near, both, low + 1))
    return far[1:-1, 1:-1]


def water_depth(cells: DataFrame, tile: int = 256) -> DataFrame:
    """(x, y, value): the bottom of the water: ``surface`` less 1, and 4 more for each cell of distance beyond the first, 50 at most.

    ``cells`` hold (x, y, elev, surface); those with an elevation are water, void ones are land, at distance 0, and stay void.
    Distances are those of ``shore_distance``. A depth depends on no cell farther than ``HALO`` away, so each tile is worked out
    with its halo, in one shuffle and without a seam; a tile is at most (tile + 2 HALO)² cells. Cells that are missing from the table are neither land nor water. Far from land all is 50 deep.
    """
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - HALO) / tile), F.floor((F.col(c) + HALO) / tile)))
    sent = cells.select("x", "y", "elev", "surface").withColumn("tx", spread("x")).withColumn("ty", spread("y"))

    def told(key: tuple, group: pa.Table) -> pa.Table:
        x, y = (group.column(c).to_numpy() for c in ("x", "y"))
        land = np.asarray(group.column("elev").is_null())
        i, j = y - y.min(), x - x.min()
        shore, water = np.zeros((i.max() + 1, j.max() + 1), bool), np.zeros((i.max() + 1, j.max() + 1), bool)
        shore[i, j], water[i, j] = land, ~land
        far = shore_distance(shore, water)[i, j]
        depth = np.minimum(DEEPEST, SHALLOWEST + PER_CELL * np.maximum(far - 1, 0))
        own = (x // tile == key[0].as_py()) & (y // tile == key[1].as_py())
        surface = group.column("surface").to_numpy()
        value = pa.array(np.where(land, np.nan, surface - depth)[own], pa.float64(), from_pandas=True)
        return pa.table({"x": x[own], "y": y[own], "value": value})

    return sent.groupBy("tx", "ty").applyInArrow(told, "x long, y long, value double")
