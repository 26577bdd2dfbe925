"""Column functions for affine transforms, boxes, lines and map projections. All stay inside code generation or array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH = 6378137.0
FLATTENING = 1 / 298.257223563
ISO_EPSILON = 1e-7


def to_world(affine: Column, col: Column, row: Column) -> Column:
    """A pixel corner in world coordinates: X = a * col + b * row + c, Y = d * col + e * row + f."""
    return F.struct((affine["a"] * col + affine["b"] * row + affine["c"]).alias("x"), (affine["d"] * col + affine["e"] * row + affine["f"]).alias("y"))


def to_world_center(affine: Column, col: Column, row: Column) -> Column:
    """A pixel's centre in world coordinates."""
    return to_world(affine, col + 0.5, row + 0.5)


def to_pixel(affine: Column, x: Column, y: Column) -> Column:
    """The pixel (row, col) that holds a world point: inverse affine, then floor. Null for a singular affine."""
    det = F.nullif(affine["a"] * affine["e"] - affine["b"] * affine["d"], F.lit(0.0))
    dx, dy = x - affine["c"], y - affine["f"]
    col = (affine["e"] * dx - affine["b"] * dy) / det
    row = (affine["a"] * dy - affine["d"] * dx) / det
    return F.struct(F.floor(row).cast("long").alias("row"), F.floor(col).cast("long").alias("col"))


def affine(a, b, c, d, e, f) -> Column:
    """A struct of six doubles from numbers or columns."""
    as_col = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*[as_col(v).alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def box_polygon(affine: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The rectangle between two mapped corners; right for north-up affines only, as documented."""
    p, q = to_world(affine, x1, y1), to_world(affine, x2, y2)
    return F.struct(F.least(p["x"], q["x"]).alias("xmin"), F.least(p["y"], q["y"]).alias("ymin"), F.greatest(p["x"], q["x"]).alias("xmax"), F.greatest(p["y"], q["y"]).alias("ymax"))


def centroid(box: Column) -> Column:
    return F.struct(((box["xmin"] + box["xmax"]) / 2).alias("x"), ((box["ymin"] + box["ymax"]) / 2).alias("y"))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area of the intersection of two boxes x1, y1, x2, y2."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def ios(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller of two boxes."""
    return overlap(a, b) / (F.least(area(**a), area(**b)) + ISO_EPSILON)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes."""
    shared = overlap(a, b)
    return shared / ((area(**b) - shared) + area(**a) + ISO_EPSILON)


def line_length(points: Column) -> Column:
    """Planar length of an array of (x, y); 0 for fewer than two points, null for null."""
    steps = F.transform(points, lambda p, i: F.sqrt(F.pow(p["x"] - F.get(points, i - 1)["x"], 2) + F.pow(p["y"] - F.get(points, i - 1)["y"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is strictly inside a closed ring (array of points, the last not repeated); on the boundary is outside."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i)
    edge = lambda i: (at(i), at((i + 1) % n))

    def crosses(i):
        p, q = edge(i)
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)))

    def touches(i):
        p, q = edge(i)
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    edges = F.sequence(F.lit(0), n - 1)
    return F.when(n >= 3, (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)).otherwise(F.lit(False))


def segments_touch(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether the segments pq and rs have a point in common; touching counts."""

    def turn(a, b, c):
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def within(a, b, c):
        return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    d1, d2, d3, d4 = turn(r, s, p), turn(r, s, q), turn(p, q, r), turn(p, q, s)
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | ((d1 == 0) & within(r, s, p)) | ((d2 == 0) & within(r, s, q)) | ((d3 == 0) & within(p, q, r)) | ((d4 == 0) & within(p, q, s))


def line_touches_ring(points: Column, ring: Column) -> Column:
    """Whether a line and the area of a ring have a point in common, its boundary included."""
    n = F.size(ring)
    inside = F.exists(points, lambda p: in_ring(p["x"], p["y"], ring))
    legs = F.sequence(F.lit(1), F.size(points) - 1)
    edges = F.sequence(F.lit(0), n - 1)
    cut = F.exists(legs, lambda i: F.exists(edges, lambda j: segments_touch(F.get(points, i - 1), F.get(points, i), F.get(ring, j), F.get(ring, (j + 1) % n))))
    return inside | F.when(F.size(points) >= 2, cut).otherwise(F.lit(False))


def to_web_mercator(lon: Column, lat: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    return F.struct((F.radians(lon) * EARTH).alias("x"), (F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    """EPSG:3857 to EPSG:4326."""
    return F.struct(F.degrees(x / EARTH).alias("lon"), F.degrees(F.atan(F.exp(y / EARTH)) * 2 - math.pi / 2).alias("lat"))


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """EPSG:4326 to a UTM zone on WGS 84, by the transverse Mercator series of third order (about a millimetre within the zone)."""
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM zone {zone}")
    n = FLATTENING / (2 - FLATTENING)
    radius = EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    atanh = lambda v: F.ln((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + 0.9996 * radius * east).alias("x"), ((10000000.0 if south else 0.0) + 0.9996 * radius * north).alias("y"))
