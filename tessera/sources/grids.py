"""Height grids in big-endian binary and in text, read into cells (x, y, value) and made of them; null is void."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a void sample is in the binary form.
VOID = -32768
#: Samples that leave a task in one batch.
SAMPLES = 1 << 20

HGT = "file string, tile_x int, tile_y int, dim int, x int, y int, value int"


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file", "tile_x", "tile_y"))
        for file, tile_x, tile_y, content in zip(*columns, batch.column("content"), strict=True):
            data = np.frombuffer(content.as_buffer(), ">i2", len(content.as_py()) // 2) if content.is_valid else np.empty(0, ">i2")
            dim = int(len(data) ** 0.5)
            rows = max(1, SAMPLES // max(dim, 1))
            for top in range(0, dim, rows):
                n = min(rows, dim - top)
                values = data[top * dim : (top + n) * dim].astype(np.int32)
                same = lambda v: pa.array(np.full(n * dim, v, np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * (n * dim), pa.string()),
                        same(tile_x),
                        same(tile_y),
                        same(dim),
                        pa.array(np.tile(np.arange(dim, dtype=np.int32), n)),
                        pa.array(np.repeat(dim - 1 - np.arange(top, top + n, dtype=np.int32), dim)),
                        pa.array(values, mask=values == VOID),
                    ],
                    names=[c.split()[0] for c in HGT.split(", ")],
                )


def hgt_cells(files: DataFrame) -> DataFrame:
    """(file, tile_x, tile_y, dim, x, y, value) of square grids of big-endian 16-bit samples (path, content), north row first.

    The south-west corner (tile_x, tile_y) is in the file's name, as in N34W072; files of other names are left out. Samples lie
    on the tile's edges, so neighbours repeat those of a shared edge: see ``without_shared_edges``. Void samples are null. Samples
    behind the last whole square are ignored, and an empty file has none.
    """
    name = F.regexp_extract("path", r"([^/\\:]*)$", 1)
    part = lambda i: F.regexp_extract(name, r"^([NSns+-])(\d+)([EWew+-])(\d+)", i)
    degrees = lambda sign, number: F.when(F.lower(part(sign)).isin("s", "w", "-"), -part(number).try_cast("int")).otherwise(part(number).try_cast("int"))
    named = files.select(F.col("path").alias("file"), degrees(3, 4).alias("tile_x"), degrees(1, 2).alias("tile_y"), "content")
    return named.filter("tile_x is not null and tile_y is not null").mapInArrow(_samples, HGT)


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """``hgt_cells`` of files."""
    return hgt_cells(spark.read.format("binaryFile").load(path).select("path", "content"))


def hgt_contents(posts: DataFrame) -> DataFrame:
    """(path, content): one binary grid for each tile (tile_x, tile_y) of posts (dim, x, y, value) with at least one valid sample.

    The inverse of ``hgt_cells``; posts that are missing are void. A tile is at most dim² samples.
    """
    place = (F.col("dim") - 1 - F.col("y")) * F.col("dim") + F.col("x")
    sample = F.lpad(F.hex(F.coalesce(F.col("value").cast("int"), F.lit(VOID)).bitwiseAND(0xFFFF)), 4, "0")
    tile = posts.groupBy("tile_x", "tile_y", "dim").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), sample.alias("v")))).alias("held"), F.count("value").alias("valid")).filter("valid > 0")
    digits = F.transform(F.sequence(F.lit(0), F.col("dim") * F.col("dim") - 1), lambda i: F.coalesce(F.try_element_at("held", i.cast("int")), F.lit("8000")))
    letter = lambda c, low, high: F.when(F.col(c) < 0, low).otherwise(high)
    name = F.format_string("%s%02d%s%03d.HGT", letter("tile_y", "S", "N"), F.abs("tile_y").cast("int"), letter("tile_x", "W", "E"), F.abs("tile_x").cast("int"))
    return tile.select(name.alias("path"), F.unhex(F.array_join(digits, "")).alias("content"))


def without_shared_edges(cells: DataFrame) -> DataFrame:
    """Cells of post grids with every sample once: of tiles that share one, the northernmost, then easternmost, keeps it.

    There are at most 360 × 180 tiles, which are sent to every executor; only cells on edges look into them.
    """
    last = F.col("dim") - 1
    edge = (F.col("x") == 0) | (F.col("x") == last) | (F.col("y") == 0) | (F.col("y") == last)
    tiles = cells.select(F.col("tile_x").alias("other_x"), F.col("tile_y").alias("other_y")).distinct()
    step = lambda c: F.when(F.col(c) == 0, F.array(F.lit(-1), F.lit(0))).when(F.col(c) == last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    on_edge = cells.filter(edge)
    sharing = on_edge.select("*", F.explode(step("x")).alias("dx")).select("*", F.explode(step("y")).alias("dy"))
    later = sharing.filter("dy > 0 or (dy = 0 and dx > 0)").select("tile_x", "tile_y", "x", "y", (F.col("tile_x") + F.col("dx")).alias("other_x"), (F.col("tile_y") + F.col("dy")).alias("other_y"))
    given = later.join(F.broadcast(tiles), ["other_x", "other_y"], "left_semi").select("tile_x", "tile_y", "x", "y").distinct()
    return cells.filter(~edge).union(on_edge.join(given, ["tile_x", "tile_y", "x", "y"], "left_anti").select(cells.columns))


def arc_cells(texts: DataFrame) -> DataFrame:
    """(file, x, y, value, west, south, east, north) of text grids (file, value): headed by ncols, nrows, xllcorner, yllcorner,
    cellsize and maybe NODATA_value (−9999 without), then the samples, north row first.

    Samples are posts in the middle of the cells that the corner means, so the bounds lie half a cell inside, rounded to half the
    spacing of the posts. A text without these words in this order is left out; numbers that can't be read are void.
    """
    part = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get("part", F.lit(i))
    words = texts.select("file", part.alias("part"))
    right = F.lit(True)
    for i, word in enumerate(("ncols", "nrows", "xllcorner", "yllcorner", "cellsize")):
        right = right & (F.lower(at(2 * i)) == word)
    void = F.lower(at(10)) == "nodata_value"
    number = lambda i: at(i).try_cast("double")
    head = words.filter(right).select("file", number(1).cast("int").alias("w"), number(3).cast("int").alias("h"), number(5).alias("x0"), number(7).alias("y0"), number(9).alias("size"), F.when(void, number(11)).otherwise(-9999.0).alias("none"), F.slice("part", F.when(void, 13).otherwise(11), F.size("part")).alias("samples"))
    bound = lambda c, n: _rounded(c, (F.col(n) - 1) * 2)
    half = F.col("size") / 2
    edges = {"west": bound(F.col("x0") + half, "w"), "south": bound(F.col("y0") + half, "h"), "east": bound(F.col("x0") + F.col("size") * F.col("w") - half, "w"), "north": bound(F.col("y0") + F.col("size") * F.col("h") - half, "h")}
    each = head.withColumns(edges).select("file", "w", "h", "none", *edges, F.posexplode("samples").alias("i", "sample")).filter("i < w * h")
    value = F.col("sample").try_cast("double")
    return each.select("file", (F.col("i") % F.col("w")).alias("x"), (F.col("h") - 1 - F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), F.when(value != F.col("none"), value).alias("value"), *edges)


def _rounded(c: Column, parts: Column) -> Column:
    return F.when(parts > 0, F.floor(c * parts + 0.5) / parts).otherwise(c)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """``arc_cells`` of files."""
    return arc_cells(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))
