"""Probability maps and masks in the cell view: one row for each pixel, or for each set pixel.

Cells are known by row and col, and by raster_id before these where a table has it: rasters in one table are
never mixed. raster_id, row and col must not be null. Repeated cells count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rastrum.operators.graph import connected_components, least_reachable
from rastrum.operators.rank import ranked
from rastrum.operators.spatial import neighbours8, raster_of
from rastrum.session import by_shuffle, checkpoint

ID_SHIFT = 31  # a cell's id is row << ID_SHIFT | col


RASTER_SHIFT = 21  # with raster_id rows and columns are below 2 ** RASTER_SHIFT in a node's number


def cell_id() -> Column:
    return F.shiftleft(F.col("row").cast("long"), ID_SHIFT) + F.col("col").cast("long")


def place(df: DataFrame) -> list[str]:
    """The columns that tell a cell."""
    return [*raster_of(df), "row", "col"]


def overlap_mean(predictions: DataFrame) -> DataFrame:
    """Mean of the probabilities that overlapping tiles of a raster give a pixel, in doubles."""
    return predictions.groupBy(*place(predictions)).agg((F.sum("p") / F.greatest(F.count("p"), F.lit(1))).alias("p"))


def threshold(prob: DataFrame, t: float) -> DataFrame:
    """The set pixels: p above t, not equal."""
    return prob.where(F.col("p") > t).select(*place(prob))


def _frame(k: int) -> tuple[int, int]:
    """Offsets of a window of k; an even one reaches one further back than forth."""
    return -(k // 2), k - 1 - k // 2


def _pass(grid: DataFrame, col: str, k: int, f) -> DataFrame:
    lo, hi = _frame(k)
    for part, order in (("row", "col"), ("col", "row")):
        grid = grid.withColumn(col, f(col).over(Window.partitionBy(*raster_of(grid), part).orderBy(order).rangeBetween(lo, hi)))
    return grid


RUNNING_FROM = 8  # windows of so many cells or more are done by running extrema


def _running(grid: DataFrame, col: str, k: int, f, best) -> DataFrame:
    """The extremum over k x k at a cost that does not depend on k: running extrema in blocks of k cells, from both of their ends.

    A window of k cells touches two blocks at most: it is the end of one, whose extremum runs back from the block's end,
    and the beginning of the next, whose extremum runs forth. Lines of a dense grid have no holes; one is an error.
    """
    lo, hi = _frame(k)
    for part, order in (("row", "col"), ("col", "row")):
        line = [*raster_of(grid), part]
        whole = Window.partitionBy(*line).orderBy(order)
        blocks = grid.withColumn("_block", F.floor((F.col(order) - F.min(order).over(Window.partitionBy(*line))) / k))
        run = lambda o, line=line: f(col).over(Window.partitionBy(*line, "_block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0))
        runs = blocks.withColumns({"_forth": run(F.col(order)), "_back": run(F.col(order).desc())})
        known = lambda v: F.struct(F.col(order).alias("at"), F.col("_block").alias("block"), F.col(v).alias("v"))
        end = F.last(known("_forth")).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        held = runs.withColumns({"_a": F.lag(known("_back"), -lo).over(whole), "_b": F.lead(known("_forth"), hi).over(whole), "_end": end})
        hole = (F.col("_a.at") != F.col(order) + lo) | (F.col("_b.at") != F.col(order) + hi)
        last = F.coalesce("_b", "_end")
        both = F.when(F.col("_a").isNull(), last["v"]).when(F.col("_a.block") == last["block"], F.col("_a.v")).otherwise(best(F.col("_a.v"), last["v"]))
        checked = F.when(hole, F.raise_error(F.lit("the grid has holes"))).otherwise(both)
        grid = held.withColumn(col, checked.cast(grid.schema[col].dataType)).select(*grid.columns)
    return grid


def erode(grid: DataFrame, k: int, col: str = "v") -> DataFrame:
    """Minimum over k x k of a dense grid, by rows and then by columns; beyond the edge nothing counts."""
    return _pass(grid, col, k, F.min) if k < RUNNING_FROM else _running(grid, col, k, F.min, F.least)


def dilate(grid: DataFrame, k: int, col: str = "v") -> DataFrame:
    """Maximum over k x k of a dense grid, by rows and then by columns; beyond the edge nothing counts."""
    return _pass(grid, col, k, F.max) if k < RUNNING_FROM else _running(grid, col, k, F.max, F.greatest)


def opening(grid: DataFrame, k: int, col: str = "v") -> DataFrame:
    return dilate(erode(grid, k, col), k, col)


def closing(grid: DataFrame, iterations: int, col: str = "v") -> DataFrame:
    """A 3 x 3 closing of so many iterations: dilations then erosions, each one square of radius iterations."""
    k = 2 * iterations + 1
    return erode(dilate(grid, k, col), k, col)


def _moved(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    of = raster_of(mask)
    return mask.select(*of, F.explode(moves).alias("o"), "row", "col").select(*of, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))


def diamond(n: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-n, n + 1) for c in range(-n, n + 1) if abs(r) + abs(c) <= n]


def closing_cross(mask: DataFrame, iterations: int, height: Column, width: Column) -> DataFrame:
    """Closing by the cross of four neighbours, iterated, on a sparse mask: a diamond.

    Pixels outside the raster count as 0 all along, so the border is eroded.
    """
    offsets = diamond(iterations)
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    grown = _moved(mask, offsets).where(inside).distinct()
    return _moved(grown, offsets).where(inside).groupBy(*place(mask)).count().where(F.col("count") == len(offsets)).select(*place(mask))


def dilate_sparse(mask: DataFrame, k: int) -> DataFrame:
    lo, hi = _frame(k)
    return _moved(mask, [(-r, -c) for r in range(lo, hi + 1) for c in range(lo, hi + 1)]).distinct()


LABEL_BLOCK = 512  # side of the blocks whose components are found at once


def _labelled(of: list[str], connectivity: int):
    """In a block: each cell with the smallest node of its component there."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row, col, node = (table.column(c).to_numpy() for c in ("row", "col", "node"))
        at = np.full((LABEL_BLOCK + 1, LABEL_BLOCK + 2), -1)
        at[row % LABEL_BLOCK, col % LABEL_BLOCK + 1] = np.arange(len(row))
        here = at[:-1, 1:-1]
        sides = [at[:-1, 2:], at[1:, 1:-1]] + ([at[1:, :-2], at[1:, 2:]] if connectivity == 8 else [])
        u, v = (np.concatenate(x) for x in zip(*((here[m], s[m]) for s in sides for m in [(here >= 0) & (s >= 0)]), strict=True))
        own = at[row % LABEL_BLOCK, col % LABEL_BLOCK + 1]  # a repeated cell goes with the row that stands for it
        order = np.argsort(node, kind="stable")
        place_ = np.empty(len(node), np.int64)
        place_[order] = np.arange(len(node))
        root = np.arange(len(node))
        nodes, least = least_reachable(place_[u], place_[v])
        root[nodes] = least
        names = [*of, "row", "col", "root"]
        return pa.table([*(table.column(c) for c in names[:-1]), pa.array(node[order][root[place_[own]]])], names)

    return run


def label(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """(row, col, label): connected components over each whole mask; the label is the smallest cell id of the component.

    With raster_id the label tells components of one raster apart. Components are found inside blocks at once; only the
    links between cells on both sides of a border go on, so their number follows the borders and not the pixels.
    """
    of, at = raster_of(mask), place(mask)
    if of:  # rasters are numbered, so that a node's number holds the raster, the row and the column
        mask = mask.select(*at).join(ranked(mask.select(*of).distinct(), *of, name="_raster"), of)
        node = lambda r, c: F.shiftleft("_raster", 2 * RASTER_SHIFT) + F.shiftleft(F.col(r).cast("long"), RASTER_SHIFT) + F.col(c).cast("long")
    else:
        node = lambda r, c: F.shiftleft(F.col(r).cast("long"), ID_SHIFT) + F.col(c).cast("long")
    block = lambda v: F.floor(F.col(v) / LABEL_BLOCK).cast("int")
    blocks = mask.select(*at, node("row", "col").alias("node"), block("row").alias("block_row"), block("col").alias("block_col"))
    schema = "".join(f"{c} {mask.schema[c].dataType.simpleString()}, " for c in at) + "root long"
    local = checkpoint(blocks.groupBy(*of, "block_row", "block_col").applyInArrow(_labelled(of, connectivity), schema))
    edge = F.lit(False)
    for v in ("row", "col"):
        edge = edge | F.pmod(v, F.lit(LABEL_BLOCK)).isin(0, LABEL_BLOCK - 1)
    border = local.where(edge)
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (connectivity == 8 or not (r and c))])
    sent = border.withColumn("o", F.explode(steps)).select(*of, block("row").alias("r0"), block("col").alias("c0"), (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.col("root").alias("src"))
    sent = sent.where((block("row") != F.col("r0")) | (block("col") != F.col("c0")))
    links = sent.join(by_shuffle(border.select(*at, F.col("root").alias("dst"))), at).where("src < dst").select("src", "dst").distinct()
    roots = connected_components(links).withColumnRenamed("node", "root")
    cells = local.join(by_shuffle(roots), "root", "left").withColumn("label", F.coalesce("component", "root"))
    if of:
        low = (1 << RASTER_SHIFT) - 1
        cells = cells.withColumn("label", F.shiftleft(F.shiftright("label", RASTER_SHIFT).bitwiseAND(F.lit(low)), ID_SHIFT) + F.col("label").bitwiseAND(F.lit(low)))
    return cells.select(*at, "label")


def component_area(mask: DataFrame, min_size: int, connectivity: int = 8) -> DataFrame:
    """(row, col, label, area) of the components of min_size pixels or more; all of them if min_size is not above 0."""
    labelled, key = label(mask, connectivity), [*raster_of(mask), "label"]
    areas = labelled.groupBy(*key).agg(F.count("*").alias("area"))
    return labelled.join(by_shuffle(areas if min_size <= 0 else areas.where(F.col("area") >= min_size)), key).select(*place(mask), "label", "area")


def neighbour_count(mask: DataFrame) -> DataFrame:
    """(row, col, n): set neighbours of each set pixel."""
    at = place(mask)
    found = neighbours8(mask).groupBy(*at).agg(F.count("*").alias("n"))
    return mask.join(by_shuffle(found), at, "left").select(*at, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def without_junctions(mask: DataFrame) -> DataFrame:
    """The mask without pixels of more than two neighbours, counted before any is cleared."""
    return neighbour_count(mask).where("n <= 2").select(*place(mask))


def endpoints(mask: DataFrame) -> DataFrame:
    """Pixels with one neighbour or none once the junctions are cleared; lone pixels are among them."""
    return neighbour_count(without_junctions(mask)).where("n <= 1").select(*place(mask))


def endpoints_of_degree_one(mask: DataFrame, orthogonal_only: bool = False) -> DataFrame:
    """Pixels with exactly one neighbour, junctions left in. orthogonal_only misses those whose one link is diagonal."""
    links = neighbours8(mask)
    ends = links.groupBy(*place(mask)).agg(F.count("*").alias("n"), F.max(F.abs(F.col("row") - F.col("n_row")) + F.abs(F.col("col") - F.col("n_col"))).alias("d")).where("n = 1")
    return (ends.where("d = 1") if orthogonal_only else ends).select(*place(mask))


def union(*masks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, masks).distinct()


def crop_to_common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both cut to the smaller height and the smaller width of the two, raster by raster; there is one row of sizes for each."""
    of = raster_of(a)
    size = lambda d, s: d.groupBy(*of).agg(F.max("row").alias(f"r{s}"), F.max("col").alias(f"c{s}"))
    both = size(a, 1).join(size(b, 2), of) if of else size(a, 1).crossJoin(size(b, 2))
    common = both.select(*of, F.least("r1", "r2").alias("rmax"), F.least("c1", "c2").alias("cmax"))
    inside = (F.col("row") <= F.col("rmax")) & (F.col("col") <= F.col("cmax"))
    cut = lambda d: d.join(common, of).where(inside) if of else d.join(F.broadcast(common), inside)
    return tuple(cut(d).drop("rmax", "cmax") for d in (a, b))
