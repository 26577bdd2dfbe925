"""GeoTIFF as a data source: windows read their strips only, files above 4 GB, one file from many tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from rastrum.sources import geotiff as G, tiffsource as T

AFFINE = (0.5, 0.0, 100.0, 0.0, -0.5, 200.0)


def noise(rows=700, cols=90, bands=1, dtype="u1", seed=1):
    return np.random.default_rng(seed).integers(0, 200, (bands, rows, cols)).astype(dtype)


def put(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def pixels(df, bands=1):
    out = {}
    for r in df.collect():
        out.setdefault(r.raster_id, {})[r.row, r.col] = tuple(r[f"b{i + 1}"] for i in range(bands))
    return out


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", [G.NONE, G.DEFLATE, G.LZW])
def test_bytes_round_trip(big, compression):
    for a in (noise(130, 37, 1), noise(64, 20, 3, "u2"), noise(5, 7, 1, "f4"), noise(1, 1, 4)):
        data = G.write(a, AFFINE, 32648, compression, -1.0, 16, big)
        m = G.read_meta(data)
        assert (m.width, m.height, m.count, m.crs, m.affine, m.nodata) == (a.shape[2], a.shape[1], len(a), "EPSG:32648", AFFINE, -1.0)
        assert (G.read_window(data) == a).all()
        assert (G.read_window(data, 2, 3, 4, 9) == a[:, 3:12, 2:6]).all()


def test_a_window_reads_its_strips_only(spark, tmp_path):
    a = noise(4000, 300)
    path = put(tmp_path / "large.tif", G.write(a, AFFINE, 32648, G.DEFLATE, None, 16))
    stored = os.path.getsize(path)

    def reader(*filters):
        r = T.PushedReader({"path": path, "partition_bytes": "50000"}, 1, "i4")
        assert list(r.pushFilters(list(filters))) == list(filters)
        return r

    whole = reader()
    assert len(whole.partitions()) > 10
    by_option = T.GeoTiffReader({"path": path, "partition_bytes": "50000", "rows": "2000:2031", "cols": "7:7"}, 1, "i4")
    for window in (reader(GreaterThanOrEqual(("row",), 2000), LessThan(("row",), 2032), EqualTo(("col",), 7)), by_option):
        rows = [b for p in window.partitions() for b in window.read(p)]
        assert sum(b.num_rows for b in rows) == 32 and window.taken <= 2 * G.FileBytes.BLOCK < stored / 8
    for r in (reader(EqualTo(("raster_id",), "other.tif")), reader(LessThan(("row",), 0))):
        assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 0
    want = {(r, c): (int(a[0, r, c]),) for r in range(1990, 2011) for c in range(5, 9)}
    condition = "row >= 1990 and row < 2011 and col between 5 and 8"
    pushed = T.read_raster(spark, path, 1, 50_000, pushdown=True).where(condition)
    assert pixels(pushed)["large.tif"] == want and pushed.rdd.getNumPartitions() == 1
    assert pixels(T.read_raster(spark, path, 1, 50_000, (1990, 2010), (5, 8)))["large.tif"] == want
    # a frame without pushdown may be used again and again, with other conditions
    df = T.read_raster(spark, path, 1, 50_000)
    assert df.rdd.getNumPartitions() == len(whole.partitions())
    assert pixels(df.where(condition))["large.tif"] == want
    assert df.where("col < 9").union(df.where("col >= 9")).agg(F.sum("b1")).first()[0] == int(a.astype(int).sum()) and df.count() == a.size


def test_folders_bands_floats_and_tiles(spark, tmp_path):
    one, three, wide = noise(40, 9), noise(33, 8, 3), noise(70, 300, 1, "f4")
    put(tmp_path / "a.tif", G.write(one, AFFINE))
    put(tmp_path / "b.tif", G.write(three, AFFINE))
    (tmp_path / "_hidden").write_bytes(b"no raster")
    got = pixels(T.read_raster(spark, str(tmp_path)), 3)
    assert got["a.tif"] == {(r, c): (int(one[0, r, c]),) * 3 for r in range(40) for c in range(9)}
    assert got["b.tif"] == {(r, c): tuple(map(int, three[:, r, c])) for r in range(33) for c in range(8)}
    assert sorted((r.raster_id, r.width, r.height, r.bands, r.dtype) for r in T.read_raster_meta(spark, f"file://{tmp_path}").collect()) == [("a.tif", 9, 40, 1, "uint8"), ("b.tif", 8, 33, 3, "uint8")]
    path = put(tmp_path / "_wide.tif", G.write(wide, AFFINE))
    df = T.read_raster(spark, path, 1)
    assert df.schema["b1"].dataType.typeName() == "double" and df.agg(F.sum("b1")).first()[0] == pytest.approx(float(wide.astype(float).sum()))
    with pytest.raises(Exception, match="not a TIFF"):
        T.read_raster(spark, str(tmp_path / "_hidden"), 1).count()
    (tmp_path / "none").mkdir()
    assert T.read_raster(spark, str(tmp_path / "none")).count() == 0 == T.read_raster_meta(spark, str(tmp_path / "none")).count()


def test_a_file_above_four_gigabytes(spark, tmp_path):
    """A sparse file with 64-bit offsets whose last strips lie beyond 4 GB."""
    width, strips, rows = 65536, 1100, 64
    counts = [width * rows] * strips
    base = len(G.head(width, strips * rows, 1, np.dtype("u1"), AFFINE, 32648, G.NONE, None, rows, [0] * strips, counts, True))
    offsets = [base + k * width * rows for k in range(strips)]
    path = tmp_path / "huge.tif"
    with open(path, "wb") as f:
        f.write(G.head(width, strips * rows, 1, np.dtype("u1"), AFFINE, 32648, G.NONE, None, rows, offsets, counts, True))
        f.seek(offsets[1090] + 5 * width + 77)
        f.write(b"\x2a")
        f.truncate(offsets[-1] + counts[-1])
    assert os.path.getsize(path) > 1 << 32
    assert T.read_raster_meta(spark, str(path)).first().height == strips * rows
    near = T.read_raster(spark, str(path), 1, rows=(69760, 69770), cols=(70, 80))
    assert [(r.row, r.col, r.b1) for r in near.where("b1 > 0").collect()] == [(1090 * 64 + 5, 77, 42)]
    assert near.count() == 11 * 11


def test_one_file_from_many_tasks(spark, tmp_path):
    a = noise(500, 60)
    cells = spark.createDataFrame([(r, c, int(a[0, r, c])) for r in range(500) for c in range(60) if a[0, r, c] > 150], "row int, col int, v int").repartition(7)
    path = str(tmp_path / "out" / "mask.tif")
    T.write_raster(cells, path, 60, 500, 16, affine=AFFINE, epsg=32648, nodata=0.0)
    data = open(path, "rb").read()
    assert (G.read_window(data)[0] == np.where(a[0] > 150, a[0], 0)).all()
    assert G.read_meta(data).affine == AFFINE and G.read_meta(data).crs == "EPSG:32648"
    assert os.listdir(tmp_path / "out") == ["mask.tif"]
    two = cells.selectExpr("row", "col", "v / 4.0 as x", "-v as y")
    T.write_raster(two, path, 60, 500, 64, dtype="float32", compression="none")
    got = G.read_window(open(path, "rb").read())
    assert got.dtype == np.float32 and (got[1] == -np.where(a[0] > 150, a[0], 0).astype("f4")).all()
    T.write_raster(cells.limit(0), path, 60, 500)
    assert not G.read_window(open(path, "rb").read()).any()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    cells = spark.range(2000).selectExpr("cast(id as int) as row", "0 as col", "if(id = 1500, raise_error('broken off'), 1) as v")
    with pytest.raises(Exception, match="broken off"):
        T.write_raster(cells, str(tmp_path / "x.tif"), 1, 2000, 16)
    assert os.listdir(tmp_path) == []
    good = cells.where("row < 100")
    T.write_raster(good, str(tmp_path / "x.tif"), 1, 2000, 16)
    before = (tmp_path / "x.tif").read_bytes()
    with pytest.raises(Exception, match="outside"):
        T.write_raster(good, str(tmp_path / "x.tif"), 1, 50, 16)
    with pytest.raises(Exception):  # noqa: B017
        T.write_raster(good, str(tmp_path / "x.tif"), 1, 2000, 16, mode="append")
    assert os.listdir(tmp_path) == ["x.tif"] and (tmp_path / "x.tif").read_bytes() == before


def test_attempts_may_run_again(tmp_path):
    """Two attempts of a task, one broken off half-way, leave the bytes of one."""
    import pyarrow as pa

    options = {"path": str(tmp_path / "a.tif"), "width": "8", "height": "40", "strip_rows": "10"}
    w = T.GeoTiffWriter(options, ["row", "col", "v", "strip"], True)
    rows = [(r, c, r + c) for r in range(40) for c in range(8)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int32()) for i in range(3)], ["row", "col", "v"])

    def broken():
        yield batch(rows[:200])
        raise OSError("lost")

    with pytest.raises(OSError):
        w.write(broken())
    messages = [w.write(iter([batch(rows[:160])])), w.write(iter([batch(rows[:160])])), w.write(iter([batch(rows[160:])]))]
    w.commit(messages[1:])
    assert (G.read_window((tmp_path / "a.tif").read_bytes())[0] == np.add.outer(np.arange(40), np.arange(8))).all()
