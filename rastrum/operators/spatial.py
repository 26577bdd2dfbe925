"""Spatial joins by grid cells: equi-joins with an exact residual condition, so Spark never falls back to nested loops."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rastrum.functions.geometry import in_ring, ios, iou, segments_touch
from rastrum.session import by_shuffle, checkpoint

BOX = ("x1", "y1", "x2", "y2")


DENSE = 20_000  # boxes of a cell from which it is cut into smaller ones
FINEST = 1 << 10  # parts of a cell's side at most


def _parts(boxes: DataFrame, group: str, cell: float) -> DataFrame:
    """boxes with their grid cells (cx, cy) and parts, the number of parts that the side of a dense cell is cut into; 1 elsewhere.

    Cells are counted first. A dense one is cut so far that its parts would hold DENSE boxes if these lay evenly, but
    no part gets smaller than the mean box in it, or boxes would have to be copied many times.
    """
    low = lambda v: F.floor(F.col(v) / cell).cast("long")
    cells = boxes.withColumn("cx", F.explode(F.sequence(low("x1"), low("x2")))).withColumn("cy", F.explode(F.sequence(low("y1"), low("y2"))))
    side = F.greatest(F.avg(F.least(F.col("x2") - F.col("x1"), F.lit(cell))), F.avg(F.least(F.col("y2") - F.col("y1"), F.lit(cell))))
    dense = cells.groupBy(group, "cx", "cy").agg(F.count("*").alias("n"), side.alias("side")).where(F.col("n") > DENSE)
    cut = F.least(F.ceil(F.sqrt(F.col("n") / F.lit(DENSE))), F.floor(F.lit(cell) / F.greatest("side", F.lit(cell / FINEST))))
    dense = dense.select(F.col(group).alias("g"), F.col("cx").alias("dx"), F.col("cy").alias("dy"), F.greatest(cut, F.lit(1)).cast("int").alias("parts")).where("parts > 1")
    if dense.isEmpty():
        return cells.withColumn("parts", F.lit(1))
    dense = checkpoint(dense)
    found = cells.join(dense, cells[group].eqNullSafe(dense["g"]) & (F.col("cx") == F.col("dx")) & (F.col("cy") == F.col("dy")), "left")
    return found.withColumn("parts", F.coalesce("parts", F.lit(1))).drop("g", "dx", "dy")


def overlap_pairs(boxes: DataFrame, group: str, key: str, metric: str = "ios", least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """(group, a, b, value) with a < b of the boxes of a group whose metric is least or more.

    A box is in each grid cell that it covers, and in a dense cell in each part of it that it covers; a pair that meets
    in several counts only in the one of the lower left corner of its intersection, so nothing has to be made
    distinct. Any cell size is exact. The cell is part of the join key, so a group that holds many boxes is spread by
    place, and one cell that holds many by its parts. Boxes with a null coordinate are in no pair; rows with the same
    key are no pair of each other.
    """
    of: Callable[[dict, dict], Column] = {"ios": ios, "iou": iou}[metric]
    cells = _parts(boxes.select(group, key, *BOX), group, cell)
    part = lambda v, n: F.floor(v * F.col(n) / cell).cast("long")

    def covered(lo: str, hi: str, at: str) -> Column:
        first, last = F.col(at) * F.col("parts"), (F.col(at) + 1) * F.col("parts") - 1
        return F.explode(F.sequence(F.greatest(part(F.col(lo), "parts"), first), F.least(part(F.col(hi), "parts"), last)))

    cells = cells.withColumn("px", covered("x1", "x2", "cx")).withColumn("py", covered("y1", "y2", "cy"))
    a, b = cells.alias("a"), cells.alias("b")
    side = lambda s: {c: F.col(f"{s}.{c}") for c in BOX}
    corner = lambda v: F.floor(F.greatest(F.col(f"a.{v}"), F.col(f"b.{v}")) * F.col("a.parts") / cell)
    owner = (corner("x1") == F.col("a.px")) & (corner("y1") == F.col("a.py"))
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.px") == F.col("b.px")) & (F.col("a.py") == F.col("b.py")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    value = of(side("a"), side("b"))
    return a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}")) & owner & (value >= least)).select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), value.alias("value"))


def radius_pairs(points: DataFrame, group: str, key: str, radius: float, strict: bool = False) -> DataFrame:
    """(group, a, b, distance) with a < b of points at most radius apart (less than radius if strict).

    Cells have the side of the radius. One side is copied to its cell and to four of the eight around it, so that each two
    points of neighbouring cells meet once. Cells are dealt by shuffle: a broadcast would leave all pairs to the few tasks
    that read the points.
    """
    cells = points.select(group, key, "x", "y", F.floor(F.col("x") / radius).cast("long").alias("cx"), F.floor(F.col("y") / radius).cast("long").alias("cy"))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    around = cells.withColumn("o", F.explode(half)).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "own": (F.col("o.i") == 0) & (F.col("o.j") == 0)}).drop("o")
    a, b = cells.alias("a"), by_shuffle(around).alias("b")
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    near = (d < radius) if strict else (d <= radius)
    u, v = F.col(f"a.{key}"), F.col(f"b.{key}")
    once = (u < v) | (~F.col("b.own") & (u > v))
    return a.join(b, same & once & near).select(F.col(f"a.{group}").alias(group), F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), d.alias("distance"))


def raster_of(df: DataFrame) -> list[str]:
    """The key of the raster in front of row and col: raster_id where df has it, else nothing (one raster). It is never null."""
    return ["raster_id"] if "raster_id" in df.columns else []


def neighbours8(cells: DataFrame) -> DataFrame:
    """(row, col, n_row, n_col) of each set cell and each set one of its eight neighbours; with raster_id, of the same raster.

    A cell is sent to its eight neighbours' places by an array of offsets and joined with the set cells there.
    """
    of = raster_of(cells)
    offsets = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    sent = cells.select(*of, "row", "col", F.explode(offsets).alias("o")).select(*of, "row", "col", (F.col("row") + F.col("o.dr")).alias("n_row"), (F.col("col") + F.col("o.dc")).alias("n_col"))
    return sent.join(by_shuffle(cells.select(*of, F.col("row").alias("n_row"), F.col("col").alias("n_col"))), [*of, "n_row", "n_col"]).select(*of, "row", "col", "n_row", "n_col")


def dissolve(aoi: DataFrame) -> DataFrame:
    """(ring, pts): the rings of all areas of interest as one table. "In any part" is enough for the predicates here; no polygon is unioned."""
    return checkpoint(aoi.select(F.explode("rings").alias("pts")).where(F.size("pts") > 0).withColumn("ring", F.monotonically_increasing_id())).select("ring", "pts")


MAX_RINGS = 1000  # rings that are sent to all tasks, some 100 bytes a point; more are joined by cells


def _rings(aoi: DataFrame) -> list | None:
    """The rings, or None if there are more than MAX_RINGS."""
    rings = [r[0] for r in aoi.select(F.explode("rings")).limit(MAX_RINGS + 1).collect()]
    return rings if len(rings) <= MAX_RINGS else None


def _sides(rings: DataFrame) -> DataFrame:
    """(ring, px, py, qx, qy) of the sides of (ring, pts), the last one back to the first point."""
    n = F.size("pts")
    side = F.transform("pts", lambda p, i: F.struct(p["x"].alias("px"), p["y"].alias("py"), F.get("pts", (i + 1) % n)["x"].alias("qx"), F.get("pts", (i + 1) % n)["y"].alias("qy")))
    return rings.select("ring", n.alias("n"), F.explode(side).alias("s")).select("ring", "n", "s.*")


def _in_cells(segments: DataFrame, cell: float) -> DataFrame:
    """Segments (px, py, qx, qy) in each grid cell that they pass (cx, cy), by bands of rows and the columns that they cross there."""
    at = lambda v: F.floor(v / cell).cast("long")
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    bands = segments.withColumn("cy", F.explode(F.sequence(at(F.least("py", "qy") - cell * 1e-6), at(F.greatest("py", "qy") + cell * 1e-6))))
    share = lambda y, level: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((y - F.col("py")) / F.nullif(dy, F.lit(0.0)), F.lit(level))))
    x = lambda y, level: F.col("px") + share(y, level) * dx
    ends = [x(F.col("cy") * cell - cell * 1e-6, 0.0), x((F.col("cy") + 1) * cell + cell * 1e-6, 1.0)]
    return bands.withColumn("cx", F.explode(F.sequence(at(F.least(*ends) - cell * 1e-6), at(F.greatest(*ends) + cell * 1e-6))))


def _cell_side(sides: DataFrame) -> float:
    """A cell of which there are about as many in the rings' extent as they have sides, and in all rings' boxes 16 times as many at most."""
    rings = sides.groupBy("ring").agg(*[f(c).alias(f"{n}{a}") for n, f in (("lo", lambda c: F.min(c)), ("hi", lambda c: F.max(c))) for a, c in (("x", F.least("px", "qx") if n == "lo" else F.greatest("px", "qx")), ("y", F.least("py", "qy") if n == "lo" else F.greatest("py", "qy")))], F.count("*").alias("n"))
    found = rings.agg(F.sum((F.col("hix") - F.col("lox")) * (F.col("hiy") - F.col("loy"))).alias("boxes"), F.sum("n").alias("n"), ((F.max("hix") - F.min("lox")) * (F.max("hiy") - F.min("loy"))).alias("extent"), F.max(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))).alias("widest")).first()
    n = max(1, found["n"] or 0)
    return max((found["extent"] or 0.0) / n, (found["boxes"] or 0.0) / (16 * n)) ** 0.5 or found["widest"] or 1.0


def _inside_by_cells(places: DataFrame, rings: DataFrame) -> DataFrame:
    """The distinct (x, y) of places that are strictly inside a ring of (ring, pts), by an index of cells.

    A place meets the rings whose boxes reach its cell, and of these the sides that reach its band of cells: only
    they can cross the ray from it or hold it, so counting them gives what counting all sides would.
    """
    sides = checkpoint(_sides(rings).where("n >= 3"))
    cell = _cell_side(sides)
    at = lambda v: F.floor(v / cell).cast("long")
    boxes = sides.groupBy("ring").agg(F.min(F.least("px", "qx")).alias("x1"), F.min(F.least("py", "qy")).alias("y1"), F.max(F.greatest("px", "qx")).alias("x2"), F.max(F.greatest("py", "qy")).alias("y2"))
    cells = boxes.withColumn("cy", F.explode(F.sequence(at(F.col("y1")), at(F.col("y2"))))).withColumn("cx", F.explode(F.sequence(at(F.col("x1")), at(F.col("x2"))))).select("ring", "cx", "cy")
    bands = sides.withColumn("cy", F.explode(F.sequence(at(F.least("py", "qy")), at(F.greatest("py", "qy"))))).select("ring", "cy", "px", "py", "qx", "qy")
    given = places.where("x is not null and y is not null").select("x", "y").distinct().select("x", "y", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy"))
    met = given.join(cells, ["cx", "cy"]).join(bands, ["ring", "cy"])
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    crosses = ((F.col("py") > F.col("y")) != (F.col("qy") > F.col("y"))) & (F.col("x") < F.col("px") + dx * (F.col("y") - F.col("py")) / F.nullif(dy, F.lit(0.0)))
    on = (dx * (F.col("y") - F.col("py")) - dy * (F.col("x") - F.col("px")) == 0) & F.col("x").between(F.least("px", "qx"), F.greatest("px", "qx")) & F.col("y").between(F.least("py", "qy"), F.greatest("py", "qy"))
    told = met.groupBy("x", "y", "ring").agg(F.count_if(crosses).alias("n"), F.max(on).alias("on"))
    return told.where((F.col("n") % 2 == 1) & ~F.col("on")).select("x", "y").distinct()


def points_within(points: DataFrame, aoi: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points strictly inside the areas of interest; an empty AOI keeps all. Points with a null coordinate are in none.

    Up to MAX_RINGS rings go to all tasks as literals; more, in any number, are joined by an index of cells.
    """
    rings = _rings(aoi)
    if rings is None:
        inside = _inside_by_cells(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), dissolve(aoi)).select(F.col("x").alias("_x"), F.col("y").alias("_y"))
        return points.join(inside, (F.col(x).cast("double") == inside["_x"]) & (F.col(y).cast("double") == inside["_y"]), "left_semi")
    if not rings:
        return points
    point = lambda p: F.struct(F.lit(float(p["x"])).alias("x"), F.lit(float(p["y"])).alias("y"))
    literal = F.array(*[F.array(*[point(p) for p in ring]) for ring in rings])
    return points.where(F.exists(literal, lambda r: in_ring(F.col(x), F.col(y), r)))


def _inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """in_ring for many points."""
    odd, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if len(ring) < 3:
        return odd
    for (px, py), (qx, qy) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if py != qy:
            odd ^= ((py > y) != (qy > y)) & (x < px + (qx - px) * (y - py) / (qy - py))
        on |= ((qx - px) * (y - py) - (qy - py) * (x - px) == 0) & (x >= min(px, qx)) & (x <= max(px, qx)) & (y >= min(py, qy)) & (y <= max(py, qy))
    return odd & ~on


def _cut(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """segments_touch for many segments pq and any side of a ring."""
    turn = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    within = lambda ax, ay, bx, by, cx, cy: (cx >= np.minimum(ax, bx)) & (cx <= np.maximum(ax, bx)) & (cy >= np.minimum(ay, by)) & (cy <= np.maximum(ay, by))
    found = np.zeros(len(px), bool)
    for r, s in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        d1, d2, d3, d4 = turn(*r, *s, px, py), turn(*r, *s, qx, qy), turn(px, py, qx, qy, *r), turn(px, py, qx, qy, *s)
        found |= ((d1 * d2 < 0) & (d3 * d4 < 0)) | ((d1 == 0) & within(*r, *s, px, py)) | ((d2 == 0) & within(*r, *s, qx, qy)) | ((d3 == 0) & within(px, py, qx, qy, *r)) | ((d4 == 0) & within(px, py, qx, qy, *s))
    return found


def _touching(rings: list[np.ndarray], points: str):
    def run(batches):
        for b in batches:
            lists = b.column(points)
            x, y = (v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in lists.flatten().flatten()[:2])
            line = np.repeat(np.arange(len(b)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            leg = np.flatnonzero(line[1:] == line[:-1])
            x1, x2, y1, y2 = (f(v[leg], v[leg + 1]) for v in (x, y) for f in (np.minimum, np.maximum))
            hit = np.zeros(len(b), bool)
            for ring in rings:
                (left, low), (right, high) = ring.min(axis=0), ring.max(axis=0)
                p = np.flatnonzero((x >= left) & (x <= right) & (y >= low) & (y <= high))
                hit[line[p[_inside(x[p], y[p], ring)]]] = True
                k = leg[(x2 >= left) & (x1 <= right) & (y2 >= low) & (y1 <= high)]
                hit[line[k[_cut(x[k], y[k], x[k + 1], y[k + 1], ring)]]] = True
            yield b.filter(pa.array(hit))

    return run


def _touching_by_cells(lines: DataFrame, rings: DataFrame, points: str) -> DataFrame:
    """The distinct lines (column points) that have a point in common with a ring of (ring, pts): legs meet sides in the cells that both pass."""
    sides = checkpoint(_sides(rings))
    cell = _cell_side(sides)
    own = lines.select(F.col(points).alias("line")).distinct()
    p = lambda i: F.get("line", i)
    legs = own.where(F.size("line") >= 2).withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(p(i - 1)["x"].alias("px"), p(i - 1)["y"].alias("py"), p(i)["x"].alias("qx"), p(i)["y"].alias("qy")))))
    legs = _in_cells(legs.select("line", "s.*"), cell)
    walls = _in_cells(sides.select("px", "py", "qx", "qy"), cell).select("cx", "cy", F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("r"), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y")).alias("t"))
    legs = legs.select("line", "cx", "cy", F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("p"), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y")).alias("q"))
    cut = legs.join(walls, ["cx", "cy"]).where(segments_touch(F.col("p"), F.col("q"), F.col("r"), F.col("t"))).select("line")
    vertices = own.select("line", F.explode("line").alias("p")).select("line", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    within = vertices.join(_inside_by_cells(vertices, rings), ["x", "y"]).select("line")
    return cut.union(within).distinct()


def lines_intersecting(lines: DataFrame, aoi: DataFrame, points: str = "pts") -> DataFrame:
    """Lines that have a point in common with the areas of interest, boundaries included; an empty AOI keeps none.

    Up to MAX_RINGS rings go to all tasks, where a kernel on batches of lines tests the points and legs that a ring's box
    reaches against its sides, with the arithmetic of line_touches_ring; more, in any number, are joined by cells.
    """
    found = _rings(aoi)
    if found is None:
        touched = _touching_by_cells(lines, dissolve(aoi), points)
        return lines.join(touched, F.col(points) == touched["line"], "left_semi")
    rings = [np.array([(p["x"], p["y"]) for p in ring], float) for ring in found if ring]
    return lines.mapInArrow(_touching(rings, points), lines.schema) if rings else lines.where(F.lit(False))
