"""Greedy merging and spatial joins against plain loops."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rastrum.operators import detect, spatial
from rastrum.plans import catalog, derived

DET = "grp long, id long, x1 double, y1 double, x2 double, y2 double, score double, category string"


def ios(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    area = lambda x: (x[4] - x[2]) * (x[5] - x[3])
    return max(w, 0) * max(h, 0) / (min(area(a), area(b)) + 1e-7)


def greedy(rows):
    left, out = sorted(rows, key=lambda r: (-r[6], r[1])), []
    while left:
        k, *rest = left
        own = [k] + [r for r in rest if r[0] == k[0] and ios(k, r) >= 0.5]
        left = [r for r in rest if r not in own]
        out.append((k[0], k[1], min(r[2] for r in own), min(r[3] for r in own), max(r[4] for r in own), max(r[5] for r in own), k[6], k[7], len(own)))
    return sorted(out)


def boxes(n, seed, groups=2):
    r = random.Random(seed)
    return [(i % groups, i, x := float(r.randint(0, 90)), y := float(r.randint(0, 90)), x + r.randint(5, 40), y + r.randint(5, 40), r.randint(1, 5) / 5, r.choice("abc")) for i in range(n)]


@pytest.mark.parametrize("rows", [[], boxes(1, 0), boxes(60, 1), boxes(60, 2, 1), [(0, i, 10.0 * i, 0.0, 10.0 * i + 20, 10.0, 1.0 - i / 10, "a") for i in range(6)], [(0, i, 0.0, 0.0, 10.0, 10.0, 0.5, "ab"[i % 2]) for i in range(5)]])
@pytest.mark.parametrize("one_task", [400_000, 0])
def test_greedy_nmm(spark, monkeypatch, rows, one_task):
    monkeypatch.setattr(detect, "ONE_TASK", one_task)
    got = detect.greedy_nmm(spark.createDataFrame(rows, DET), cell=16.0).collect()
    assert sorted(map(tuple, got)) == greedy(rows)


@pytest.mark.parametrize("cell", [7.0, 64.0])
def test_pairs_do_not_depend_on_the_cell(spark, cell):
    rows = boxes(50, 3)
    got = {(r.a, r.b) for r in spatial.overlap_pairs(spark.createDataFrame(rows, DET), "grp", "id", cell=cell).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and ios(a, b) >= 0.5}


def test_metric_of_exactly_the_threshold_matches(spark):
    rows = [(0, 0, 0.0, 0.0, 1e6, 1e6, 0.9, "a"), (0, 1, 5e5, 0.0, 15e5, 1e6, 0.8, "a")]
    assert [r.members for r in detect.greedy_nmm(spark.createDataFrame(rows, DET), least=0.5 - 1e-12, cell=1e6).collect()] == [2]


@pytest.mark.parametrize("one_task", [400_000, 0])
def test_buffer_suppress_and_match(spark, monkeypatch, one_task):
    monkeypatch.setattr(detect, "ONE_TASK", one_task)
    pts = spark.createDataFrame([(0, 1, 0.0, 9.0), (0, 2, 0.0, 6.0), (0, 3, 0.0, 3.0), (0, 4, 0.0, 0.0)], "grp long, id long, x double, y double")
    assert sorted(r.id for r in detect.buffer_suppress(pts, "grp", "id", 4.0).collect()) == [1, 3]
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (1, 4, 1.0)], "a long, b long, distance double")
    assert sorted((r.a, r.b) for r in detect.greedy_match(pairs).collect()) == [(1, 2), (3, 4)]
    assert detect.greedy_match(pairs, consume=False).count() == 4 and detect.greedy_match(pairs.limit(0)).count() == 0
    r = random.Random(5)
    many = [(r.randrange(30), 30 + r.randrange(30), r.randrange(1, 900) / 10) for _ in range(150)]
    many = [(a, b, d + k / 1e6) for k, (a, b, d) in enumerate(dict.fromkeys(many))]
    used, want = set(), []
    for a, b, _ in sorted(many, key=lambda x: x[2]):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b))
    got = detect.greedy_match(spark.createDataFrame(many, "a long, b long, distance double").repartition(3)).collect()
    assert sorted((x.a, x.b) for x in got) == sorted(want)


def test_aoi(spark):
    aoi = spark.createDataFrame([(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]])], "aoi_id long, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 2.0), (3, 4.0, 4.0), (4, 5.0, 2.0)], "id long, x double, y double")
    assert [r.id for r in spatial.points_within(pts, aoi).collect()] == [1]
    assert spatial.points_within(pts, aoi.limit(0)).count() == 4
    lines = spark.createDataFrame([(1, [(-1.0, 4.0), (0.0, 4.0)]), (2, [(-2.0, -2.0), (-1.0, 5.0)]), (3, [(-1.0, 2.0), (9.0, 2.0)]), (4, [(1.0, 1.0)])], "id long, pts array<struct<x:double,y:double>>")
    assert sorted(r.id for r in spatial.lines_intersecting(lines, aoi).collect()) == [1, 3, 4]
    assert spatial.lines_intersecting(lines, aoi.limit(0)).count() == 0


def test_filters(spark):
    d = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0, 0.25, "a"), (0, 2, 0.0, 0.0, 1.0, 1.0, 0.01, "zz"), (0, 3, 0.0, 0.0, 1.0, 1.0, 0.2, "a")], DET)
    assert [r.id for r in detect.conf_filter(d, 0.25).collect()] == [1]
    assert [r.id for r in detect.class_conf_filter(d, {"a": 0.25}).collect()] == [1, 2]
    assert detect.class_conf_filter(d, {}).count() == 3


def crossed(line, ring):
    """By exact fractions: a point inside by winding, or a leg that meets a side."""
    f = Fraction
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    line, ring = [(f(x), f(y)) for x, y in line], [(f(x), f(y)) for x, y in ring]
    sides = list(zip(ring, ring[1:] + ring[:1], strict=True))
    wind = lambda p: sum((a[1] <= p[1] < b[1] and turn(a, b, p) > 0) - (b[1] <= p[1] < a[1] and turn(a, b, p) < 0) for a, b in sides)
    cuts = lambda p, q, a, b: turn(a, b, p) * turn(a, b, q) < 0 and turn(p, q, a) * turn(p, q, b) < 0 or on(a, b, p) or on(a, b, q) or on(p, q, a) or on(p, q, b)
    return any(wind(p) and not any(on(a, b, p) for a, b in sides) for p in line) or any(cuts(p, q, a, b) for p, q in zip(line, line[1:], strict=False) for a, b in sides)


def test_lines_of_all_orders_are_tested(spark):
    d = "/root/testdata/sf0.001"
    rings = [[(p["x"], p["y"]) for p in ring] for a in derived.aoi(spark, d).collect() for ring in a.rings]
    lines = {r.line_id: [(p["x"], p["y"]) for p in r.pts] for r in derived.lines(spark, d).collect()}
    want = {i for i, pts in lines.items() if any(crossed(pts, ring) for ring in rings)}
    got = [r.line_id for r in catalog.QUERIES["aoi_intersects"](spark, d).collect()]
    assert sorted(got) == sorted(want) and any(i % 16 for i in got)


@pytest.mark.parametrize("kind", ["lattice", "random"])
def test_areas_by_cells_are_areas_by_literals(spark, monkeypatch, kind):
    """More rings than go to all tasks, against the literals: points on corners and sides, rings of all sizes, of two points, long legs, nulls."""
    r = random.Random(7)
    v = (lambda n: float(r.randrange(n))) if kind == "lattice" else (lambda n: r.random() * n)
    rings = []
    for k in range(60):
        x, y, w = v(200), v(200), 3 + v(150 if k % 15 == 0 else 20)
        rings.append([(x + v(int(w) + 1), y + v(int(w) + 1)) for _ in range(r.choice([2, 3, 4, 7]))])
    rings += [[(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)], [(5.0, 5.0)], []]
    aoi = spark.createDataFrame([(i, [ring, rings[-1 - i]]) for i, ring in enumerate(rings[:20])] + [(99, rings[20:])], "aoi_id long, rings array<array<struct<x:double,y:double>>>")
    corners = [p for ring in rings for p in ring]
    pts = [(i, *p, "k") for i, p in enumerate(corners + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(corners, corners[1:], strict=False)] + [(v(250), v(250)) for _ in range(600)])]
    pts += [pts[0], pts[70], (9000, None, 1.0, "k"), (9001, 2.0, None, "k")]
    points = spark.createDataFrame(pts, "id long, x double, y double, ring string").repartition(3)
    legs = [(i, [(v(260) - 5, v(260) - 5) for _ in range(r.choice([0, 1, 2, 2, 5]))]) for i in range(300)] + [(400 + i, [p, (p[0] - 30, p[1])]) for i, p in enumerate(corners)]
    legs += [(800, [(-500.0, 3.0), (900.0, 3.0)]), (801, [(7.0, -900.0), (7.0, 900.0)]), legs[5]]
    lines = spark.createDataFrame(legs, "line_id long, pts array<struct<x:double,y:double>>").repartition(3)
    want = sorted(x.id for x in spatial.points_within(points, aoi).collect()), sorted(x.line_id for x in spatial.lines_intersecting(lines, aoi).collect())
    monkeypatch.setattr(spatial, "MAX_RINGS", 5)
    assert sorted(x.id for x in spatial.points_within(points, aoi).collect()) == want[0] and 50 < len(want[0]) < len(pts) - 50
    got = spatial.lines_intersecting(lines, aoi)
    assert got.columns == lines.columns and sorted(x.line_id for x in got.collect()) == want[1]
    assert spatial.points_within(points.limit(0), aoi).count() == 0 == spatial.lines_intersecting(lines.limit(0), aoi).count()


def test_a_hundred_thousand_rings(spark):
    """Small squares on a lattice, joined by cells; nothing of them goes to the driver but their number and extent."""
    ids = spark.range(100_000).select((F.col("id") % 400 * 10).cast("double").alias("x"), F.floor(F.col("id") / 400).cast("double").alias("r"))
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("r") * 10 + dy).alias("y"))
    aoi = ids.select(F.array(F.array(p(0, 0), p(6, 0), p(6, 6), p(0, 6))).alias("rings"))
    points = spark.range(200_000).select("id", (F.col("id") % 4000).cast("double").alias("x"), (F.floor(F.col("id") / 4000) * 17 + 3).cast("double").alias("y"))
    inside = spatial.points_within(points, aoi)
    want = points.where("x % 10 > 0 and x % 10 < 6 and y % 10 > 0 and y % 10 < 6 and y < 2500")
    assert inside.count() == want.count() == inside.join(want, "id").count() > 0


def test_a_dense_cell_is_spread(spark, monkeypatch):
    """A cell with most boxes is cut into parts, of which none holds many; the pairs are those of all against all."""
    r = random.Random(12)
    boxes = [(1, i, x, y, x + r.random() * 3, y + r.random() * 3) for i in range(1500) for x, y in [(70 + r.random() * 50, 66 + r.random() * 55)]]
    boxes += [(g, 2000 + 400 * g + i, x, y, x + r.random() * 90, y + r.random() * 90) for g in (1, 2) for i in range(150) for x, y in [(r.random() * 300 - 50, r.random() * 300 - 50)]]
    boxes += [(1, 5000 + i, 80.0 + i % 3, 80.0, 84.0, 85.0) for i in range(30)] + [(1, 6000, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(*b, 1.0, "c") for b in boxes], DET).repartition(4)
    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])

    def ios(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return max(w, 0) * max(h, 0) / (min(area(a), area(b)) + 1e-7)

    real = [b for b in boxes if b[2] is not None]
    want = {(a[1], b[1]) for a in real for b in real if a[0] == b[0] and a[1] < b[1] and ios(a, b) >= 0.5}
    pairs = lambda: [(x.a, x.b) for x in spatial.overlap_pairs(df, "grp", "id").collect()]
    even = pairs()
    assert len(even) == len(set(even)) and set(even) == want and len(want) > 300
    monkeypatch.setattr(spatial, "DENSE", 20)
    held = spatial._parts(df.select("grp", "id", *spatial.BOX), "grp", 64.0)
    assert held.agg(F.max("parts")).first()[0] >= 8
    dense = pairs()
    assert len(dense) == len(set(dense)) and set(dense) == want


def crowd(n, seed, groups=2, side=60):
    """Points on whole numbers, so that places and distances repeat; some lie far away, some have no place."""
    r = random.Random(seed)
    rows = [(r.randrange(groups), i, float(r.randrange(side)), float(r.randrange(side))) for i in range(n)]
    return [*rows, (0, n, None, 1.0), (None, n + 1, 1.0, 1.0), (0, n + 2, float("nan"), 1.0), (0, n + 3, float("nan"), 1.0), (0, n + 4, -5000.0, 7.0), (0, n + 5, -5000.0, 3.0)]


def close(rows, radius, strict):
    """(distance, a, b) of all pairs, by loops."""
    d = lambda p, q: math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2)
    pairs = [(d(p, q), p[1], q[1]) for i, p in enumerate(rows) for q in rows[i + 1 :] if None not in (*p, *q) and p[0] == q[0]]
    return sorted(x for x in pairs if (x[0] < radius if strict else x[0] <= radius))


@pytest.mark.parametrize(("block", "per_cell", "radius"), [(32, 900, 7.0), (4, 900, 5.0), (4, 2, 9.0), (8, 1, 25.0)])
def test_suppression_makes_no_pairs(spark, monkeypatch, block, per_cell, radius):
    monkeypatch.setattr(detect, "BLOCK_CELLS", block)
    monkeypatch.setattr(detect, "PER_CELL", per_cell)
    monkeypatch.setattr(detect, "radius_pairs", None)
    rows = crowd(700, 3)
    by_id, near = {p[1]: p for p in rows}, {}
    for _, a, b in close(rows, radius, True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    gone, want = set(), []
    for i in sorted(by_id, key=lambda i: (-(by_id[i][3]), i)):
        if i not in gone:
            want.append(i)
            gone |= set(near.get(i, []))
    pts = spark.createDataFrame(rows, "grp long, id long, x double, y double").repartition(3)
    assert sorted(r.id for r in detect.buffer_suppress(pts, "grp", "id", radius).collect()) == sorted(want)


@pytest.mark.parametrize("radius", [3.0, 40.0])
def test_matching_of_a_crowd_makes_few_pairs(spark, monkeypatch, radius):
    rows, made, own = crowd(900, 8), [], detect.radius_pairs
    monkeypatch.setattr(detect, "radius_pairs", lambda *a: (made.append(own(*a).count()), own(*a))[1])
    used, want = set(), []
    for d, a, b in close(rows, radius, False):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, d))
    got = detect.greedy_match_points(spark.createDataFrame(rows, "grp long, id long, x double, y double").repartition(3), "grp", "id", radius).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == sorted(want)
    assert sum(made) < 15 * len(rows)


def test_radius_pairs_of_a_crowd(spark):
    rows = crowd(300, 5)
    df = spatial.radius_pairs(spark.createDataFrame(rows, "grp long, id long, x double, y double"), "grp", "id", 9.0)
    assert sorted((r.distance, r.a, r.b) for r in df.collect()) == close(rows, 9.0, False)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
