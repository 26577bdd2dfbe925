"""Masks, networks and metrics against numpy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.operators import mask as M, metrics as X, roads as R
from rastrum.operators.rank import ranked
from rastrum.plans import catalog, derived as D, networks


def cells(spark, a):
    r, c = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y)) for x, y in zip(r, c, strict=True)], "row int, col int")


def dense(spark, a):
    return spark.createDataFrame([(r, c, int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, v int")


def back(df, shape, v=None):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.row, r.col] = r[v] if v else 1
    return out


def windowed(a, k, f):
    lo, hi = k // 2, k - 1 - k // 2
    return np.array([[f(a[max(0, r - lo) : r + hi + 1, max(0, c - lo) : c + hi + 1]) for c in range(a.shape[1])] for r in range(a.shape[0])])


RNG = np.random.default_rng(3)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_morphology(spark, k):
    a = (RNG.random((17, 13)) > 0.4).astype(int)
    assert (back(M.erode(dense(spark, a), k), a.shape, "v") == windowed(a, k, np.min)).all()
    assert (back(M.dilate(dense(spark, a), k), a.shape, "v") == windowed(a, k, np.max)).all()
    assert (back(M.opening(dense(spark, a), k), a.shape, "v") == windowed(windowed(a, k, np.min), k, np.max)).all()


def flood(a, steps):
    seen, out = set(), []
    for p in zip(*np.nonzero(a), strict=True):
        if p in seen:
            continue
        stack, comp = [p], set()
        seen.add(p)
        while stack:
            q = stack.pop()
            comp.add(q)
            for s in steps:
                n = (q[0] + s[0], q[1] + s[1])
                if 0 <= n[0] < a.shape[0] and 0 <= n[1] < a.shape[1] and a[n] and n not in seen:
                    seen.add(n)
                    stack.append(n)
        out.append(frozenset((int(r), int(c)) for r, c in comp))
    return set(out)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, connectivity):
    a = (RNG.random((20, 20)) > 0.6).astype(int)
    a[5, :] = 1  # a long one
    steps = [s for s in R.STEPS if connectivity == 8 or 0 in s]
    groups = {}
    for r in M.label(cells(spark, a), connectivity).collect():
        groups.setdefault(r.label, set()).add((r.row, r.col))
    assert {frozenset(g) for g in groups.values()} == flood(a, steps)
    kept = {(r.row, r.col) for r in M.component_area(cells(spark, a), 4, connectivity).collect()}
    assert kept == {p for g in flood(a, steps) if len(g) >= 4 for p in g}
    assert M.component_area(cells(spark, a), 0).count() == a.sum()
    assert M.label(cells(spark, a).limit(0)).count() == 0


def test_neighbours_and_ends(spark):
    a = np.zeros((9, 9), int)
    a[4, 1:8] = 1
    a[1:8, 4] = 1
    a[0, 0] = 1
    n = {(r.row, r.col): r.n for r in M.neighbour_count(cells(spark, a)).collect()}
    assert n[(4, 4)] == 4 and n[(0, 0)] == 0 and n[(4, 1)] == 1
    ends = {(r.row, r.col) for r in M.endpoints(cells(spark, a)).collect()}
    assert {(4, 1), (4, 7), (1, 4), (7, 4), (0, 0)} <= ends
    assert (0, 0) not in {(r.row, r.col) for r in M.endpoints_of_degree_one(cells(spark, a)).collect()}


def test_closing_cross(spark):
    a = (RNG.random((12, 12)) > 0.6).astype(int)
    h, w = a.shape
    offs = M.diamond(2)
    inside = lambda r, c: 0 <= r < h and 0 <= c < w
    g = np.array([[any(inside(r + i, c + j) and a[r + i, c + j] for i, j in offs) for c in range(w)] for r in range(h)])
    want = np.array([[all(inside(r + i, c + j) and g[r + i, c + j] for i, j in offs) for c in range(w)] for r in range(h)])
    assert (back(M.closing_cross(cells(spark, a), 2, F.lit(h), F.lit(w)), a.shape) == want).all()


def test_skeleton_of_a_bar(spark):
    a = np.zeros((100, 100), int)
    a[45:51, 10:90] = 1
    thin = back(R.skeletonize(cells(spark, a), 64, 16), a.shape)
    assert (thin[:, 20:80].sum(axis=0) == 1).all() and ((thin == 0) | (a == 1)).all()
    lines = R.trace_paths(cells(spark, thin)).collect()
    assert len(lines) == 1 and len(lines[0].pts) > 50
    assert (thin == R.thin(a)).all()  # the seams of the blocks leave no trace here


def test_trace_and_branches(spark):
    a = np.zeros((30, 30), int)
    a[5, 2:25] = 1
    a[6:20, 12] = 1  # a T
    for r in range(21, 28):  # a ring
        for c in range(2, 9):
            a[r, c] = abs(r - 24) + abs(c - 5) == 3
    a[28, 28] = 1
    lines = R.trace_paths(cells(spark, a)).collect()
    assert len(lines) == 3 and all(len(r.pts) > 5 for r in lines)
    found = R.branches(cells(spark, a)).collect()
    assert len(found) == 4 and any(r.pts[0] == r.pts[-1] for r in found)


def test_least_cost_path(spark):
    cost = np.full((12, 12), 10.0)
    cost[6, :] = 1.0
    ends = spark.createDataFrame([(1, 6, 1), (2, 6, 9), (3, 0, 0)], "id long, row int, col int")
    pairs = R.gap_pairs(ends, 8.0)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2), (1, 3)]
    grid = spark.createDataFrame([(r, c, float(cost[r, c])) for r in range(12) for c in range(12)], "row int, col int, cost double")
    got = {(r.a, r.b): r for r in R.least_cost_paths(pairs, ends, grid, 2).collect()}
    assert got[(1, 2)].pixels == 9 and got[(1, 2)].mean_cost == 1.0
    assert [(r.a, r.b) for r in R.accept_paths(R.least_cost_paths(pairs, ends, grid, 2), 8.0, 0.1).collect()] == [(1, 2)]
    assert {r.pixels for r in R.least_cost_paths(pairs, ends, grid, 0).collect()} <= {0, None}


def test_metrics(spark):
    empty = spark.createDataFrame([], "row int, col int")
    assert X.raster_iou(empty, empty).first().iou == 1.0
    a, b = spark.createDataFrame([(0, 0), (0, 1)], "row int, col int"), spark.createDataFrame([(0, 1), (0, 2)], "row int, col int")
    assert X.raster_iou(a, b).first().iou == pytest.approx(1 / 3)
    s = spark.createDataFrame([(0, 0.9, 1), (0, 0.1, 1), (1, 0.9, 1)], "batch int, p double, y int")
    assert X.dice_mean(s).first().dice == pytest.approx((2 / 3 + 1) / 2, abs=1e-6)
    m = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (255, 1)], "y int, pred int")
    assert {r.label: r.iou for r in X.mean_iou(m).collect()} == {0: 0.5, 1: 0.5}
    p = X.parameters(spark, a=[1, 2], b=["x", "y"]).orderBy("ordinal").collect()
    assert [(r.a, r.b) for r in p] == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]


def test_vector_iou_takes_every_line(spark, tmp_path):
    """Against distances from all cell centres; no line of the fixture is of a 512th order, all directions occur."""
    orders = [(k, j, int(p), 0) for k in (3, 700, 999) for j, p in enumerate(RNG.integers(0, 300, 4))] + [(140, 1, 90, 0), (140, 1 + 13, 90, 0), (285, 1, 7, 0)]
    spark.createDataFrame(orders, "l_orderkey long, l_linenumber int, l_partkey long, other int").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = [[(p["x"], p["y"]) for p in r.pts] for r in D.lines(spark, str(tmp_path)).collect()]
    y, x = (np.mgrid[-5:510, -5:510] + 0.5) * 2

    def buffered(shift):
        near = np.zeros(x.shape, bool)
        for pts in lines:
            for (px, py), (qx, qy) in zip(pts, pts[1:], strict=False):
                px, qx = px + shift, qx + shift
                dx, dy = qx - px, qy - py
                t = np.clip(((x - px) * dx + (y - py) * dy) / ((dx * dx + dy * dy) or 1.0), 0, 1)
                near |= (x - (px + t * dx)) ** 2 + (y - (py + t * dy)) ** 2 <= 9
        return near

    a, b = buffered(0), buffered(1.0)
    assert a.sum() > 1000
    assert catalog.QUERIES["vector_iou"](spark, str(tmp_path)).first().iou == round((a & b).sum() / (a | b).sum(), 4)


def test_buffer_cells_of_any_direction(spark):
    legs = [((3.0, 4.0), (3.0, 4.0)), ((0.0, 5.0), (9.0, 5.0)), ((5.0, -3.0), (5.0, 8.0)), ((9.5, 8.0), (-2.0, 7.5)), ((0.0, 0.0), (4.0, -9.0))]
    y, x = np.mgrid[-40:40, -40:40] + 0.5
    for p, q in legs:
        dx, dy = q[0] - p[0], q[1] - p[1]
        t = np.clip(((x - p[0]) * dx + (y - p[1]) * dy) / ((dx * dx + dy * dy) or 1.0), 0, 1)
        r, c = np.nonzero((x - (p[0] + t * dx)) ** 2 + (y - (p[1] + t * dy)) ** 2 <= 2.5**2)
        got = X.buffer_cells(spark.createDataFrame([([p, q],)], "pts array<struct<x:double,y:double>>"), 2.5).collect()
        assert {(g.row, g.col) for g in got} == set(zip((r - 40).tolist(), (c - 40).tolist(), strict=True))


def test_paths_of_the_whole_map(spark, tmp_path):
    """All gaps of a map of 300 rows, which is more than one tile; the reference pads a box and cuts it by the map."""
    v = RNG.normal(0, 0.12, (300, 64)).astype(np.float32)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = np.full(v.shape, np.nan)
    for r in D.prob(spark, str(tmp_path)).collect():
        p[r.row, r.col] = r.p
    count = lambda a: sum(np.pad(a, 1)[1 + r : 1 + r + a.shape[0], 1 + c : 1 + c + a.shape[1]] for r, c in R.STEPS)
    m = (p > 0.8).astype(int)
    simple = m * (count(m) <= 2)
    ends = [tuple(map(int, e)) for e in np.argwhere(simple * (count(simple) <= 1))]
    grid = np.maximum((1 - p) * 15, 1e-6)
    want = {}
    for i, a in enumerate(ends):
        for b in ends[i + 1 :]:
            if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 16:
                top, left = max(0, a[0] - 20), max(0, min(a[1], b[1]) - 20)
                box = grid[top : b[0] + 20, left : max(a[1], b[1]) + 20]
                path = R.cheapest(box, (a[0] - top, a[1] - left), (b[0] - top, b[1] - left))
                want[a[0] * 64 + a[1], b[0] * 64 + b[1]] = len(path), pytest.approx(sum(box[q] for q in path) / len(path), abs=1e-5)
    got = {(r.a, r.b): (r.pixels, r.mean_cost) for r in catalog.QUERIES["least_cost_path"](spark, str(tmp_path)).collect()}
    assert got == want and max(a for a, _ in got) // 64 > 250
    accepted = {(r.a, r.b) for r in catalog.QUERIES["path_accept"](spark, str(tmp_path)).collect()}
    assert accepted == {k for k, (n, mean) in want.items() if 0 < n < 6 and mean.expected < 6.0}


def test_sorts_number_every_row(spark):
    points = sorted((r.asDict() for r in D.points(spark, "/root/testdata/sf0.01").select("id", "x", "y").collect()), key=lambda p: (-p["y"], p["id"]))
    got = catalog.QUERIES["sort_y_desc"](spark, "/root/testdata/sf0.01").collect()
    assert len(points) > 200 and sorted((r.r, r.id, r.x, r.y) for r in got) == [(i, p["id"], p["x"], p["y"]) for i, p in enumerate(points, 1)]
    ends = sorted((r.row, r.col) for r in M.endpoints(D.mask(spark, "/root/testdata/sf0.001")).collect())
    got = catalog.QUERIES["sort_rowmajor"](spark, "/root/testdata/sf0.001").collect()
    assert len(ends) > 500 and sorted((r.r, r.row, r.col) for r in got) == [(i, *e) for i, e in enumerate(ends, 1)]
    empty = spark.createDataFrame([], "a int")
    assert ranked(empty, "a").count() == 0


def test_road_pipeline_against_arrays(spark):
    """The whole road job against plain loops over one array: mean, threshold, opening, closing, components, thinning, tracing, lengths, area."""
    d = "/root/testdata/sf0.001"
    cells_ = networks.dense_bars(spark, d).toPandas()
    mean = cells_.groupby(["row", "col"])["p"].mean().reset_index()
    m = np.zeros((mean["row"].max() + 1, mean["col"].max() + 1), int)
    m[mean["row"], mean["col"]] = mean["p"] > 0.6919

    def square(a, k, f, beyond):
        lo, hi = k // 2, k - 1 - k // 2
        w = np.pad(a, ((lo, hi), (lo, hi)), constant_values=beyond)
        return f.reduce([w[i : i + a.shape[0], j : j + a.shape[1]] for i in range(k) for j in range(k)])

    m = square(square(m, 3, np.minimum, 1), 3, np.maximum, 0)
    m = square(square(m, 5, np.maximum, 0), 5, np.minimum, 1)
    seen = np.zeros(m.shape, bool)
    for start in zip(*np.nonzero(m), strict=True):
        part, todo = [], [start] * (not seen[start])
        seen[start] = True
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and not seen[q]:
                    seen[q] = True
                    todo.append(q)
        if part and len(part) < 35:
            m[tuple(zip(*part, strict=True))] = 0
    assert sorted((r.row, r.col) for r in R.road_mask(networks.dense_bars(spark, d), 0.6919, 3, 2, 35).collect()) == sorted(zip(*(v.tolist() for v in np.nonzero(m)), strict=True))
    thin = R.thin(m)

    def around(a):
        w = np.pad(a, 1)
        return sum(w[1 + i : 1 + i + a.shape[0], 1 + j : 1 + j + a.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)

    simple = thin * (around(thin) <= 2)
    visited, lengths = set(), []
    for start in zip(*(v.tolist() for v in np.nonzero((simple == 1) & (around(simple) <= 1))), strict=True):
        path, here = [], start
        while here is not None and here not in visited:
            visited.add(here)
            path.append(here)
            here = next((q for q in ((here[0] + i, here[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and simple[q] and q not in visited), None)
        length = sum(0.05 * np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:], strict=False))
        if len(path) > 5 and length > 0.5 and any((c + 0.5) * 0.05 < 10 and (r + 0.5) * 0.05 < 10 for r, c in path):
            lengths.append(round(length, 6))
    got = [r.length for r in catalog.QUERIES["road_pipeline"](spark, d).collect()]
    assert np.allclose(sorted(got), sorted(lengths), atol=1e-5) and len(got) > 20


def test_networks_of_two_rasters(spark):
    """Two rasters that use the same cells give what each gives alone."""
    a, b = np.zeros((40, 60), int), np.zeros((40, 60), int)
    a[10:13, 5:50] = 1
    b[5:35, 20:23] = 1
    b[20:23, 5:50] = 1
    of = lambda n, m: cells(spark, m).withColumn("raster_id", F.lit(n))
    both = of("a", a).unionByName(of("b", b))
    thin = R.skeletonize(both, 32, 8)
    for name, m in (("a", a), ("b", b)):
        alone = R.skeletonize(cells(spark, m), 32, 8)
        assert sorted((r.row, r.col) for r in thin.where(F.col("raster_id") == name).collect()) == sorted((r.row, r.col) for r in alone.collect())
        for f in (R.trace_paths, R.branches):
            got = [[tuple(p) for p in r.pts] for r in f(thin).where(F.col("raster_id") == name).collect()]
            assert sorted(got) == sorted([tuple(p) for p in r.pts] for r in f(alone).collect())


@pytest.mark.parametrize("k", [8, 9, 20, 101, 400])
def test_running_extrema(spark, k):
    """Large squares against loops, on lines shorter and longer than a window and origins that are not zero, two rasters."""
    a = RNG.integers(0, 50, (37, 211))
    lo, hi = k // 2, k - 1 - k // 2
    rows = [(n, r + 5, c + 3, int(v)) for n, m in (("a", a), ("b", 50 - a)) for (r, c), v in np.ndenumerate(m)]
    grid = spark.createDataFrame(rows, "raster_id string, row int, col int, v int").repartition(4)

    def around(m, f):
        m = np.array([[f(r[max(0, c - lo) : c + hi + 1]) for c in range(m.shape[1])] for r in m])
        return np.array([[f(m[max(0, r - lo) : r + hi + 1, c]) for c in range(m.shape[1])] for r in range(m.shape[0])])

    for made, f in ((M.erode, np.min), (M.dilate, np.max)):
        want = {(n, r + 5, c + 3): int(v) for n, m in (("a", a), ("b", 50 - a)) for (r, c), v in np.ndenumerate(around(m, f))}
        assert {(x.raster_id, x.row, x.col): x.v for x in made(grid, k).collect()} == want
    assert M.erode(grid.limit(0), k).count() == 0
    with pytest.raises(Exception, match="holes"):
        M.erode(grid.where("col <> 100"), k).collect()


def test_derived_cells_are_not_broadcast(spark):
    """Cells exploded from a few rows count as a few bytes for Spark; no join of them may collect them in the driver."""
    made = spark.range(5).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("col"))
    for df in (M.neighbour_count(made), M.component_area(made, 1), R.skeletonize(made, 16, 4), R.trace_paths(made), R.branches(made)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_only_borders_of_blocks_are_linked(spark, monkeypatch, connectivity):
    """A component over many blocks; what goes to the rounds of components follows the borders."""
    monkeypatch.setattr(M, "LABEL_BLOCK", 16)
    a = np.zeros((70, 70), int)
    a[3:67, 3:67] = 1
    a[15, 10:60], a[16, 69] = 0, 1
    seen, own = [], M.connected_components
    monkeypatch.setattr(M, "connected_components", lambda e: seen.append(e.count()) or own(e))
    got = {(r.row, r.col): r.label for r in M.label(cells(spark, a).unionByName(cells(spark, a[:20])), connectivity).collect()}
    want = (3 << M.ID_SHIFT) + 3
    assert len(got) == a.sum() and got.pop((16, 69)) == (16 << M.ID_SHIFT) + 69 and set(got.values()) == {want}
    assert seen[0] < 150


@pytest.mark.parametrize("cell", [1.0, 2.0, 0.25])
def test_buffers_as_runs_of_cells(spark, monkeypatch, cell):
    """Many segments against distances from all centres: whole and other coordinates, points, level and upright ones, long ones, in small portions; no cell is a row."""
    monkeypatch.setattr(X, "RUNS", 100)
    monkeypatch.setattr(X, "TILES", 3)
    rng = np.random.default_rng(2)
    whole = rng.integers(-20, 20, (60, 4)).astype(float)
    whole[:10, 2:] = whole[:10, :2]
    whole[10:20, 2], whole[20:30, 3] = whole[10:20, 0], whole[20:30, 1]
    legs = np.concatenate((whole, rng.normal(0, 15, (40, 4)), [[-40, -40, 40, 39.5], [0.5, -40, 0.5, 40]]))
    legs = legs[:: 3 if cell < 1 else 1]
    n = int(50 / cell)
    y, x = (np.mgrid[-n:n, -n:n] + 0.5) * cell
    near = np.zeros(x.shape, bool)
    for px, py, qx, qy in legs:
        dx, dy = qx - px, qy - py
        t = np.clip(((x - px) * dx + (y - py) * dy) / ((dx * dx + dy * dy) or 1.0), 0, 1)
        near |= (x - (px + t * dx)) ** 2 + (y - (py + t * dy)) ** 2 <= 2.5**2
    df = spark.createDataFrame([([(p[0], p[1]), (p[2], p[3])],) for p in legs.tolist()], "pts array<struct<x:double,y:double>>")
    got = X.buffer_cells(df, 2.5, cell).collect()
    r, c = np.nonzero(near)
    assert len(got) == near.sum() and {(g.row, g.col) for g in got} == set(zip((r - n).tolist(), (c - n).tolist(), strict=True))
    assert X.buffer_words(df, 2.5, cell).count() < len(got) / 8
