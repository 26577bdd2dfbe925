"""Masks in packed blocks against loops over one array, and how much of them is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.operators import blocks as B, roads as R
from rastrum.plans import networks
from rastrum.session import by_shuffle


def shuffled(spark, run) -> tuple:
    """What run returns, and the bytes that its shuffles wrote."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    out = run()
    return out, written() - before


def plain_mask(rows, t, k, n, least):
    """The road mask from {(row, col): [p, ...]} by loops; pixels without a row are not there."""
    mean = {q: (sum(v for v in ps if v is not None) / max(1, sum(v is not None for v in ps)) if any(v is not None for v in ps) else None) for q, ps in rows.items()}
    v = {q: None if p is None else int(p > t or p != p) for q, p in mean.items()}

    def move(v, k, f):
        for axis in (1, 0):
            out = {}
            for q in v:
                near = [v.get((q[0] + o * (axis == 0), q[1] + o * (axis == 1))) for o in range(-(k // 2), k - k // 2)]
                out[q] = f([x for x in near if x is not None], default=None)
            v = out
        return v

    for size, f in ((k, min), (k, max), (2 * n + 1, max), (2 * n + 1, min)):
        v = move(v, size, f)
    on, out = {q for q in v if v[q] == 1}, set()
    while on:
        part, todo = set(), [on.pop()]
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & on
            on -= near
            todo += near
        out |= part if len(part) >= least else set()
    return out


def noisy(seed, holes):
    """Probabilities of a map of 50 x 61 with large and small blobs, repeated pixels, nulls, NaN, and holes."""
    rng = np.random.default_rng(seed)
    p = rng.random((50, 61)) * 0.6 + (rng.random((10, 13)).repeat(5, 0).repeat(5, 1)[:50, :61] > 0.6) * 0.5
    rows = {(r, c): [float(p[r, c])] for r in range(50) for c in range(61) if not holes or rng.random() > 0.1}
    for q in list(rows):
        if q[1] % 3 == 0:
            rows[q].append(float(rng.random()))
        if holes and rng.random() < 0.1:
            rows[q][0] = None
    rows[(20, 20)] = [float("nan")]
    return rows


@pytest.mark.parametrize(("block", "k", "n", "least"), [(8, 3, 2, 35), (16, 2, 1, 12), (16, 1, 0, 3), (64, 3, 5, 60), (8, 4, 6, 0), (512, 3, 2, 35)])
def test_road_mask_in_blocks_against_loops(spark, block, k, n, least):
    """Two rasters in one table, one with holes and nulls; components and windows reach over several blocks."""
    rasters = {"a": noisy(1, False), "b": noisy(2, True)}
    df = spark.createDataFrame([(name, r, c, p) for name, rows in rasters.items() for (r, c), ps in rows.items() for p in ps], "raster_id string, row int, col int, p double").repartition(5)
    got = R.road_mask(df, 0.5, k, n, least, block).collect()
    for name, rows in rasters.items():
        found = [(r.row, r.col) for r in got if r.raster_id == name]
        want = plain_mask(rows, 0.5, k, n, least)
        assert want and sorted(found) == sorted(want)
    alone = R.road_mask(df.where("raster_id = 'a'").drop("raster_id"), 0.5, k, n, least, block).collect()
    assert sorted((r.row, r.col) for r in alone) == sorted((r.row, r.col) for r in got if r.raster_id == "a")
    assert R.road_mask(df.limit(0), 0.5, k, n, least, block).count() == 0


@pytest.mark.parametrize("at_once", [7, 1 << 19])
def test_packing_and_back(spark, monkeypatch, at_once):
    """Cells of any order and number of repeats, far apart, in two rasters."""
    monkeypatch.setattr(B, "PACKED_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    rows = [(int(n), int(r), int(c)) for n, r, c in zip(rng.integers(5, 7, 400), rng.integers(0, 90, 400), rng.integers(0, 40, 400), strict=True)] + [(5, 2_000_000, 7), (5, 3, 2_000_000)]
    df = spark.createDataFrame(rows * 2, "raster_id long, row int, col int").repartition(3)
    got = [tuple(r) for r in B.unpack(B.pack(df, 16), 16).collect()]
    assert sorted(got) == sorted(set(rows))


def test_dense_bars_hold_what_the_bars_give(spark):
    """The map by its rule equals the map joined from its bars, and no pixel of it is shuffled."""
    d = "/root/testdata/sf0.001"
    bars = networks.bars(spark, d).withColumn("on", F.lit(1))
    rows, cols = bars.agg(F.max("row") + 1, F.max("col") + 1).first()
    cells = spark.range(rows).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    cells = cells.join(by_shuffle(bars), ["row", "col"], "left").select("row", "col", F.when(F.col("on") == 1, 0.9).otherwise(0.1).alias("p"))
    want = cells.unionByName(cells.where("col % 3 = 0").withColumn("p", F.when(F.col("p") > 0.5, 0.7).otherwise(0.2)))
    made = networks.dense_bars(spark, d)
    assert made.schema.simpleString() == want.schema.simpleString()
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()
    n, written = shuffled(spark, lambda: networks.dense_bars(spark, d).count())
    assert n > 200_000 and written < 50_000


def test_road_mask_shuffles_blocks(spark):
    """224,400 predictions make less than a byte each of all shuffles of the mask."""
    n, written = shuffled(spark, lambda: R.road_mask(networks.dense_bars(spark, "/root/testdata/sf0.001"), 0.6919, 3, 2, 35).count())
    assert n > 20_000 and written < 224_400
