"""Windows over rasters, generated as rows by sequences; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _starts(size: Column, step: int) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _grid(rasters: DataFrame, step_x: int, step_y: int) -> DataFrame:
    return rasters.withColumn("y_off", F.explode(_starts(F.col("height"), step_y))).withColumn("x_off", F.explode(_starts(F.col("width"), step_x)))


def step_of(size: int, ratio: float) -> int:
    """Tile size less its overlap, which is cut to a whole number."""
    step = size - int(ratio * size)
    if step < 1:
        raise ValueError("the overlap leaves no step")
    return step


def ragged(rasters: DataFrame, size: int = 640, ratio: float = 0.2) -> DataFrame:
    """x_off, y_off, w, h of overlapping tiles that shrink at the far edges; slivers already covered are tiles as well."""
    step = step_of(size, ratio)
    out = _grid(rasters, step, step)
    return out.withColumns({"w": F.least(F.lit(size), F.col("width") - F.col("x_off")), "h": F.least(F.lit(size), F.col("height") - F.col("y_off"))})


def clamped(rasters: DataFrame, size: int = 750, overlap: int = 150) -> DataFrame:
    """Tiles of full size; those at the far edges are moved back and may repeat, which weighs in means of overlaps.

    A raster smaller than a tile has none.
    """
    step = size - overlap
    fits = rasters.where((F.col("width") >= size) & (F.col("height") >= size))
    out = _grid(fits, step, step)
    return out.withColumns({"x_off": F.least(F.col("x_off"), F.col("width") - size), "y_off": F.least(F.col("y_off"), F.col("height") - size), "w": F.lit(size), "h": F.lit(size)})


def disjoint(rasters: DataFrame, w: int, h: int, full_only: bool = False) -> DataFrame:
    """Tiles side by side; full_only keeps those of full size."""
    out = _grid(rasters, w, h)
    out = out.withColumns({"w": F.least(F.lit(w), F.col("width") - F.col("x_off")), "h": F.least(F.lit(h), F.col("height") - F.col("y_off"))})
    return full_tiles(out, w, h) if full_only else out


def full_tiles(tiles: DataFrame, w: int, h: int) -> DataFrame:
    return tiles.where((F.col("w") == w) & (F.col("h") == h))


def centred(points: DataFrame, w: int, h: int) -> DataFrame:
    """A tile around each (row, col), cut to whole pixels towards zero; it may leave the raster."""
    return points.withColumns({"x_off": (F.col("col") - w / 2).cast("int"), "y_off": (F.col("row") - h / 2).cast("int"), "w": F.lit(w), "h": F.lit(h)})


def batches(tiles: DataFrame, size: int, group: str, order: list[str]) -> DataFrame:
    """Number consecutive tiles of each group in batches of size."""
    return tiles.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("int"))


def shuffled_limit(tiles: DataFrame, accept: Column, n: int, seed: int, key: str) -> DataFrame:
    """n tiles in a seeded order, that of a hash of seed and key, among those that are accepted; a top-k, so only n rows of each task are kept."""
    return tiles.where(accept).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), key).limit(n)


def halo_copies(cells: DataFrame, block: int, halo: int) -> DataFrame:
    """Each cell in every block whose halo holds it: block_row, block_col and core (the one block it belongs to)."""
    def blocks(v: Column) -> Column:
        return F.sequence(F.floor((v - halo) / block).cast("int"), F.floor((v + halo) / block).cast("int"))

    out = cells.withColumn("block_row", F.explode(blocks(F.col("row")))).withColumn("block_col", F.explode(blocks(F.col("col"))))
    core = (F.floor(F.col("row") / block) == F.col("block_row")) & (F.floor(F.col("col") / block) == F.col("block_col"))
    return out.withColumn("core", core)


def row_chunk(row: Column, height: Column, chunks: int) -> Column:
    """The strip of a row when a raster is cut into strips of equal height, the last may be lower."""
    return F.floor(row / F.greatest(F.ceil(height / chunks), F.lit(1))).cast("int")
