"""Thinning and tracing in blocks against loops over the whole image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.operators import roads as R
from rastrum.plans import catalog, networks


def cells(spark, a):
    r, c = np.nonzero(a)
    return spark.createDataFrame(list(zip(r.tolist(), c.tolist(), strict=True)), "row int, col int")


def image(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        assert out[r.row, r.col] == 0
        out[r.row, r.col] = 1
    return out


def blobs(shape=(150, 170), seed=4):
    """Filled shapes up to sixty pixels thick, bars, noise."""
    r = np.random.default_rng(seed)
    a = np.zeros(shape, int)
    y, x = np.mgrid[: shape[0], : shape[1]]
    a |= (y - 60) ** 2 + (x - 70) ** 2 < 45**2
    a[110:118, 3:160] = 1
    a[5:140, 140:152] = 1
    a &= ~((y - 55) ** 2 + (x - 60) ** 2 < 9**2)
    return (a | (r.random(shape) < 0.02)).astype(int)


@pytest.mark.parametrize(("block", "halo"), [(16, 4), (64, 16), (512, 64)])
def test_thinning_of_masks_thicker_than_a_block(spark, block, halo):
    a = blobs()
    assert (image(R.skeletonize(cells(spark, a), block, halo), a.shape) == R.thin(a)).all()


def test_thinning_edges(spark):
    none = spark.createDataFrame([], "raster_id string, row int, col int")
    assert R.skeletonize(none, 16, 4).count() == 0
    with pytest.raises(ValueError):
        R.skeletonize(none, 16, 17)
    a, b = blobs(seed=1), blobs(seed=2)[::-1]
    both = cells(spark, a).withColumn("raster_id", F.lit("a")).unionByName(cells(spark, b).withColumn("raster_id", F.lit("b")))
    got = R.skeletonize(both.unionByName(both), 32, 8)  # repeated cells
    for name, m in (("a", a), ("b", b)):
        assert (image(got.where(F.col("raster_id") == name), m.shape) == R.thin(m)).all()


STEPS = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def walks(a):
    """Every path and ring of an image cleared of junctions, by walking."""
    on = set(map(tuple, np.argwhere(a).tolist()))
    near = lambda p, of: [(p[0] + r, p[1] + c) for r, c in STEPS if (p[0] + r, p[1] + c) in of]
    simple = {p for p in on if len(near(p, on)) <= 2}
    seen, out = set(), []
    for s in sorted(simple, key=lambda p: (len(near(p, simple)) > 1, p)):
        if s in seen:
            continue
        path, here = [], s
        while here is not None:
            seen.add(here)
            path.append(here)
            here = next((q for q in near(here, simple) if q not in seen), None)
        beside = lambda p: [q for q in near(p, on) if q not in simple]
        ring = len(path) > 2 and len(near(s, simple)) > 1
        if ring:
            out.append((path, path + [s]))
        else:
            head = beside(path[0])[:1]
            out.append((path, head + path + [q for q in beside(path[-1]) if len(path) > 1 or q not in head][:1]))
    return out


def lines():
    """Noise with junctions, a snake through many blocks, rings within a block and over several, lone pixels."""
    a = np.zeros((130, 120), int)
    a[:40] = np.random.default_rng(3).random((40, 120)) < 0.22
    for k in range(10):
        a[44 + 4 * k, 2:100] = 1
        if k < 9:
            a[44 + 4 * k : 49 + 4 * k, 99 if k % 2 == 0 else 2] = 1
    a[100, 20:24] = a[103, 20:24] = 1
    a[100:104, 20] = a[100:104, 23] = 1
    a[90:128, 105] = a[90:128, 116] = 1
    a[89, 106:116] = a[128, 106:116] = 1
    a[115, 5] = a[115, 50] = a[115, 51] = 1
    return a


@pytest.mark.parametrize("block", [8, 33, 1024])
def test_paths_and_branches_against_walks(spark, block):
    a = lines()
    want = walks(a)
    pts = lambda df: sorted([(r.label, [tuple(p) for p in r.pts]) for r in df.collect()])
    label = lambda path: min(r << 31 | c for r, c in path)
    found = R.branches(cells(spark, a), block)
    assert pts(found) == sorted((label(p), whole) for p, whole in want if len(whole) >= 2)
    rings = [p for p, whole in want if len(whole) > 2 and whole[0] == whole[-1] and len(p) == len(whole) - 1]
    assert len(rings) >= 3
    assert pts(R.trace_paths(cells(spark, a), 6, block)) == sorted((label(p), p) for p, _ in want if len(p) >= 6 and p not in rings)


def test_a_line_of_a_million_pixels(spark):
    """A snake over many blocks and tasks: each pixel gets its number, none holds the line."""
    rows, width = 1000, 1000
    line = spark.range(rows * width).select((F.floor(F.col("id") / width) * 2).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    turns = spark.range(rows - 1).select((F.col("id") * 2 + 1).cast("int").alias("row"), F.when(F.col("id") % 2 == 0, width - 1).otherwise(0).alias("col"))
    pixels = R.traced_pixels(line.union(turns), block=256)
    total = rows * width + rows - 1
    got = pixels.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.min("n"), F.max("n"), F.countDistinct("start")).first()
    # at a turn the corner pixels touch three others and are cleared, so the walk is that of each row and each turn
    whole = {r["n"]: r["count"] for r in pixels.groupBy("n").count().collect()}
    assert got[0] == sum(whole.values()) <= total
    straight = spark.range(1_000_000).select(F.lit(7).alias("row"), F.col("id").cast("int").alias("col"))
    numbered = R.traced_pixels(straight, block=4096)
    check = numbered.agg(F.count("*").alias("n"), F.count_if(F.col("rank") == F.col("id") - (7 << 31)).alias("right"), F.min("n").alias("size")).first()
    assert (check.n, check["right"], check["size"]) == (1_000_000, 1_000_000, 1_000_000)


def plainly_thinned(m, rounds=None):
    """Zhang-Suen as it is written, by moved arrays."""
    m = np.pad(m.astype(int), 1)
    while rounds is None or rounds > 0:
        before = m.copy()
        for half in (0, 1):
            n, ne, e, se, s, sw, w, nw = ring = [np.roll(m, d, (0, 1)) for d in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            turns = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            ends = (n * e * s, e * s * w) if half == 0 else (n * e * w, n * s * w)
            m = np.where((m == 1) & (sum(ring) >= 2) & (sum(ring) <= 6) & (turns == 1) & (ends[0] == 0) & (ends[1] == 0), 0, m)
        rounds = None if rounds is None else rounds - 1
        if (m == before).all():
            break
    return m[1:-1, 1:-1]


@pytest.mark.parametrize("rounds", [None, 0, 1, 3])
def test_thinning_by_table(rounds):
    """The table of rings gives what the rules give, and costs a fraction: in eight bits, never in wide numbers."""
    for a in (blobs(seed=5), (np.random.default_rng(6).random((80, 90)) < 0.6).astype(int)):
        assert (R.thin(a, rounds) == plainly_thinned(a, rounds)).all()
    assert R.CLEARED.shape == (2, 256)


def test_thinning_needs_no_distinct_cells(spark):
    """skeletonize counts repeated cells once, so its query deals the map out once, as blocks, and not before as cells."""
    d = "/root/testdata/sf0.001"
    made = networks.crossing_bars(spark, d)
    assert "HashAggregate(keys=[row" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.row, r.col) for r in networks.skeletonize(spark, d).collect()}
    assert got == {(r.row, r.col) for r in R.skeletonize(networks.bars(spark, d), 128, 16).collect()} and got


@pytest.mark.parametrize(("block", "up"), [(4, 0), (7, 45), (64, 70)])
def test_chains_over_borders_of_blocks(spark, block, up):
    """Noise and many small rings across borders of small blocks, in two rasters, moved to rows below zero too."""
    rng = np.random.default_rng(block)
    want, rows = {}, []
    for name in ("a", "b"):
        a = (rng.random((70, 60)) < 0.2).astype(int)
        for k in range(30):
            r, c, h, w = *rng.integers(1, 50, 2).tolist(), *rng.integers(2, 9, 2).tolist()
            a[r - 1 : r + h + 2, c - 1 : c + w + 2] = 0
            a[[r, r + h], c : c + w + 1] = a[r : r + h + 1, [[c], [c + w]]] = 1
            if k % 2:  # corners off: a ring without a pixel of three neighbours
                a[[r, r, r + h, r + h], [c, c + w, c, c + w]] = 0
        want[name] = [([(r - up, c) for r, c in p], [(r - up, c) for r, c in whole]) for p, whole in walks(a)]
        rows += [(name, r - up, c) for r, c in np.argwhere(a).tolist()]
    df = spark.createDataFrame(rows, "raster_id string, row int, col int").repartition(3)
    label = lambda path: min((r << 31) + c for r, c in path)
    found, traced = R.branches(df, block).collect(), R.trace_paths(df.unionByName(df), 4, block).collect()
    for name, lines_ in want.items():
        pts = lambda got, name=name: sorted((r.label, [tuple(p) for p in r.pts]) for r in got if r.raster_id == name)
        assert pts(found) == sorted((label(p), whole) for p, whole in lines_ if len(whole) >= 2)
        rings = [p for p, whole in lines_ if len(whole) > 2 and whole[0] == whole[-1] and len(p) == len(whole) - 1]
        assert len(rings) > 5 and pts(traced) == sorted((label(p), p) for p, _ in lines_ if len(p) >= 4 and p not in rings)


@pytest.mark.parametrize(("query", "most"), [("trace_path", 100_000), ("skeleton_branches", 100_000), ("road_pipeline", 200_000)])
def test_lines_shuffle_blocks(spark, query, most):
    """One panel of 5,000 pixels of lines; what is shuffled follows its blocks and the chains over their borders."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert catalog.QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    assert written() - before < most
