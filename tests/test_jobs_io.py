"""Sources, sinks, jobs and the protocol stream."""

import hashlib
import json
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rastrum import scoring
from rastrum.functions import geometry as G, scalar as S
from rastrum.operators import jobs as J, tiling as T
from rastrum.sources import geotiff, image, raster, vector
from rastrum.streaming import protocol as P

META = (0.05, 0.0, 500000.0, 0.0, -0.05, 100000.0)


@pytest.mark.parametrize("compression", [geotiff.NONE, geotiff.LZW, geotiff.DEFLATE])
@pytest.mark.parametrize("kind", ["u1", "i2", "f4"])
def test_geotiff(compression, kind):
    a = np.random.default_rng(1).integers(0, 100, (3, 90, 70)).astype(kind)
    data = geotiff.write(a, META, 32648, compression, 0)
    m = geotiff.read_meta(data)
    assert (m.width, m.height, m.count, m.crs, m.affine, m.nodata) == (70, 90, 3, "EPSG:32648", META, 0.0)
    assert (geotiff.read_window(data, 11, 40, 25, 60, 2) == a[:2, 40:90, 11:36]).all()
    with pytest.raises(ValueError):
        geotiff.read_meta(b"no tiff")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw(data):
    assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


def test_lzw_with_a_full_table():
    data = np.random.default_rng(2).integers(0, 4, 60_000, dtype=np.uint8).tobytes()
    assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


def test_rotated_affine():
    t = (1.0, 0.5, 3.0, 0.5, -1.0, 4.0)
    assert geotiff.read_meta(geotiff.write(np.zeros((2, 2), "u1"), t)).affine == t


def test_png_npy():
    a = np.random.default_rng(1).integers(0, 255, (3, 9, 11)).astype(np.uint8)
    assert (image.read_png(image.write_png(a)) == a).all()
    assert (image.read_npy(image.write_npy(a)) == a).all()


def test_shapefile_and_geojson():
    rings = [[[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]]
    assert vector.read_shp(vector.write_shp(vector.POLYGON, rings)[0]) == [(vector.POLYGON, rings[0])]
    names, rows = vector.read_dbf(vector.write_dbf([("score", "N", 9, 5), ("category", "C", 80, 0)], [(0.95, "Healthy"), (None, "")]))
    assert names == ["score", "category"] and rows == [(0.95, "Healthy"), (None, "")]
    assert vector.rings_of_geojson(json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]})) == [[(0, 0), (1, 0), (1, 1)]]


def test_scan_with_one_band(spark):
    data = geotiff.write(np.arange(12, dtype="u1").reshape(3, 4), META)
    files = spark.createDataFrame([("a", bytearray(data))], "raster_id string, content binary")
    tiles = spark.createDataFrame([("a", 1, 2, 1, 9, 9)], "raster_id string, tile_id long, x_off int, y_off int, w int, h int")
    got = sorted((r.row, r.col, r.b1, r.b3) for r in raster.scan_windows(files, tiles).collect())
    assert got == [(1, 2, 6, 6), (1, 3, 7, 7), (2, 2, 10, 10), (2, 3, 11, 11)]


def test_sinks(spark, tmp_path):
    none = spark.createDataFrame([], "id long, category string")
    raster.write_layers(none, none, str(tmp_path / "l"))
    assert spark.read.schema(none.schema).parquet(str(tmp_path / "l/boxes")).count() == 0
    assert raster.write_by_class(none, str(tmp_path / "c")) == [] and not (tmp_path / "c").exists()
    assert not raster.write_lines(none, str(tmp_path / "x"))


def test_world_corner(spark):
    w = G.to_world(G.affine(*META), F.lit(20), F.lit(20))
    r = spark.range(1).select(w["x"].alias("x"), w["y"].alias("y")).first()
    assert (r.x, r.y) == (500001.0, 99999.0)


def test_utm(spark):
    u = G.to_utm(F.lit(105.0), F.lit(0.0), 48)
    r = spark.range(1).select(u["x"].alias("x"), u["y"].alias("y")).first()
    assert r.x == pytest.approx(500000, abs=1e-3) and r.y == pytest.approx(0, abs=1e-3)
    v = G.to_utm(F.lit(9.0), F.lit(48.0), 32)
    assert spark.range(1).select(v["y"].alias("y")).first().y == pytest.approx(5316300, abs=300)
    with pytest.raises(ValueError):
        G.to_utm(F.lit(0.0), F.lit(0.0), 61)


def test_tilings(spark):
    r = spark.createDataFrame([("s", 100, 90), ("b", 800, 760), ("z", 0, 5)], "raster_id string, width int, height int")
    assert {(t.raster_id, t.w, t.h) for t in T.ragged(r).collect() if t.raster_id == "s"} == {("s", 100, 90)}
    assert sorted((t.x_off, t.y_off) for t in T.clamped(r).collect()) == [(0, 0), (0, 10), (50, 0), (50, 10)]
    same = T.clamped(spark.createDataFrame([("e", 750, 750)], "raster_id string, width int, height int")).collect()
    assert len(same) == 4 and {(t.x_off, t.y_off) for t in same} == {(0, 0)}  # repeated windows stay
    with pytest.raises(ValueError):
        T.step_of(10, 1.0)


def test_scorers(spark):
    px = bytearray(64)
    tiles = spark.createDataFrame([("r", 0, 0, 0, 1, 8, 8, px), ("r", 1, 0, 8, 1, 8, 8, bytearray([255] + [0] * 63))], "raster_id string, tile_id long, x_off int, y_off int, bands int, w int, h int, pixels binary")
    assert scoring.not_empty(tiles).count() == 1
    d = scoring.detect(tiles, scoring.BrightSpots()).collect()
    assert [(r.tile_id, r.x1, r.score) for r in d] == [(1, 0.0, 1.0)]
    flipped = scoring.augment(tiles, lambda i: (True, True)).where("tile_id = 1").first()
    assert flipped.pixels[-1] == 255
    assert scoring.seeded_flips(1)(5) == scoring.seeded_flips(1)(5)


def test_paths(spark):
    rows = [(1, 0, "/a b/✓/in.tif", False), (1, 1, "/a b/✓/aoi.shp", False), (1, 2, "/out/x.shp", True), (2, 0, "/a b/✓/y", True)]
    m = J.mount_paths(spark.createDataFrame(rows, "job_id long, ordinal long, path string, writable boolean"))
    got = {(r.job_id, r.ordinal): (r.container_path, r.mode) for r in m.collect()}
    assert got == {(1, 0): ("/mnt/0/in.tif", "ro"), (1, 1): ("/mnt/0/aoi.shp", "ro"), (1, 2): ("/mnt/1/x.shp", "rw"), (2, 0): ("/mnt/0/y", "rw")}
    back = J.host_paths(m.select("job_id", "container_path"), m)
    assert {r.host_path for r in back.collect()} == {r[2] for r in rows}


def test_integrity_and_fetch(spark, tmp_path):
    files = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", ""), ("d", "y"), ("e", None)], "name string, content string")
    reg = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0")], "name string, sha256 string")
    assert {r.name: r.ok for r in J.integrity(files, reg).collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False}
    p, calls = str(tmp_path / "w.bin"), []

    def fetch(to):
        calls.append(to)
        with open(to, "wb") as f:
            f.write(b"bad" if len(calls) == 1 else b"good")

    assert J.ensure_file(p, fetch, hashlib.sha256(b"good").hexdigest(), wait=0) == p and len(calls) == 2
    assert J.ensure_file(p, fetch, hashlib.sha256(b"good").hexdigest()) == p and len(calls) == 2
    with pytest.raises(OSError):
        J.ensure_file(str(tmp_path / "v.bin"), fetch, "0", tries=2, wait=0)
    assert [x.name for x in tmp_path.iterdir()] == ["w.bin"]


def test_dispatch_and_environment(spark):
    J.pipeline("nothing")(lambda s, p: p["v"])
    assert J.dispatch("nothing", spark, {"v": 3}) == 3
    with pytest.raises(ValueError):
        J.dispatch("unheard", spark, {})
    assert J.environment(("numpy", "no_such_module"))["no_such_module"] == "MISSING"
    assert S.resolve_device("gpu") == "cpu" and S.resolve_device("gpu", mps=True) == "mps"


LINES = [
    (1, 0, "starting"), (1, 1, '@@MSG@@ {"type": "describe", "text": "Läuft ✓"}'), (1, 2, '@@MSG@@ {"type": "progress", "value": 75}'), (1, 3, '@@MSG@@ {"type": "log", "message": "x", "level": "info"}'), (1, 4, '@@MSG@@ {"type": "result", "data": "120"}'),
    (2, 0, '@@MSG@@ {"type": "result", "data": "1"}'), (2, 1, '@@MSG@@ {"type": "error", "message": "boom"}'), (3, 0, '@@MSG@@ {"type": "canceled"}'), (3, 1, '@@MSG@@ {"type": "error", "message": "late"}'), (4, 0, "@@MSG@@ {oops"), (4, 1, " "), (4, 2, "bye"),
]


def test_protocol(spark):
    parsed = P.parse(spark.createDataFrame(LINES, P.LINE))
    got = {r.job_id: r for r in P.terminal(P.fold(parsed)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "result", 2: "error", 3: "canceled", 4: "no_result"}
    assert (got[1].progress, got[1].description, got[1].logs, got[1].result, got[2].error) == (75.0, "Läuft ✓", 1, "120", "boom")
    assert [r.line for r in P.tail(parsed).where("job_id = 4").collect()] == ["bye"]


def test_protocol_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in (0, 1):
        with open(tmp_path / f"in/{i}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("job_id", "seq", "line"), r, strict=True))) + "\n" for r in LINES[i::2])
    q = P.terminal(P.fold(P.parse(P.read_lines(spark, str(tmp_path / "in"), 1)))).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        time.sleep(0.1)
        assert {r.job_id: r.status for r in spark.table("folded").collect()} == {1: "result", 2: "error", 3: "canceled", 4: "no_result"}
    finally:
        q.stop()


def test_manifest(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "counting", None, {"raster_path": "/x/y.tif", "Out_DIR": "/o", "n": "/keep/me"}, "EPSG:1", 2, 3, 88, 3.4512, "t")], "job_id long, job_type string, device string, params map<string,string>, crs string, width int, height int, total_detections long, elapsed_seconds double, timestamp_utc string")
    layers = spark.createDataFrame([(1, "boxes", "bbox", "/o/b.shp", "abc"), (1, "gone", "point", "/o/c.shp", None)], "job_id long, name string, type string, path string, content string")
    m = J.manifests(jobs, layers).first()
    assert m.parameters == {"raster_path": "y.tif", "Out_DIR": "o", "n": "/keep/me"} and m.device == "cpu" and m.elapsed_seconds == 3.45
    assert [(o.filename, o.sha256 is None, o.size_bytes) for o in m.outputs] == [("b.shp", False, 3), ("c.shp", True, 0)] and m.summary.total_detections == 88
    with open(J.write_manifest(m, str(tmp_path))) as f:
        assert json.load(f)["summary"]["output_layers_count"] == 2


def test_augment_against_loops(spark):
    """Resize, turn, flips and normalisation of a tile, sample by sample."""
    import math

    import numpy as np

    r = np.random.default_rng(2)
    a = r.integers(0, 256, (3, 6, 9)).astype(np.uint8)
    tiles = spark.createDataFrame([("r", 7, 0, 0, 3, 9, 6, a.tobytes())], "raster_id string, tile_id long, x_off int, y_off int, bands int, w int, h int, pixels binary")
    got = scoring.augment(tiles, lambda i: (True, False), 12, lambda i: 20.0, True).first()
    big = np.zeros((3, 12, 12))
    for i in range(12):
        for j in range(12):
            y, x = min(max((i + 0.5) * 6 / 12 - 0.5, 0), 5), min(max((j + 0.5) * 9 / 12 - 0.5, 0), 8)
            y0, x0 = int(y), int(x)
            y1, x1 = min(y0 + 1, 5), min(x0 + 1, 8)
            big[:, i, j] = np.rint((a[:, y0, x0] * (1 - x + x0) + a[:, y0, x1] * (x - x0)) * (1 - y + y0) + (a[:, y1, x0] * (1 - x + x0) + a[:, y1, x1] * (x - x0)) * (y - y0))
    mirror = lambda k: abs(k) if abs(k) < 12 else 22 - abs(k)
    turned = np.zeros_like(big)
    for i in range(12):
        for j in range(12):
            y, x = i - 5.5, j - 5.5
            t = math.radians(20)
            sy, sx = math.sin(t) * x + math.cos(t) * y + 5.5, math.cos(t) * x - math.sin(t) * y + 5.5
            y0, x0 = math.floor(sy), math.floor(sx)
            v = sum(big[:, mirror(y0 + p), mirror(x0 + q)] * (1 - abs(sy - y0 - p)) * (1 - abs(sx - x0 - q)) for p in (0, 1) for q in (0, 1))
            turned[:, i, 11 - j] = np.rint(v)
    assert (got.w, got.h) == (12, 12)
    assert np.allclose(np.frombuffer(got.pixels, "<f4").reshape(3, 12, 12), turned / 255, atol=1.01 / 255) and np.mean(np.abs(np.frombuffer(got.pixels, "<f4").reshape(3, 12, 12) - turned / 255) > 1e-6) < 0.02
    assert abs(scoring.seeded_turns(3)(5)) <= 35 and scoring.seeded_turns(3)(5) == scoring.seeded_turns(3)(5)


def test_a_network_from_a_file():
    """A model of one node, written field by field, gives its input back."""
    import pickle

    import numpy as np

    def field(n, body):
        body = body.encode() if isinstance(body, str) else body
        return bytes([n << 3 | 2, len(body)]) + body

    number = lambda n, v: bytes([n << 3, v])
    dims = field(2, b"".join(field(1, field(2, c)) for c in "nbhw"))
    value = lambda name: field(1, name) + field(2, field(1, number(1, 1) + dims))
    graph = field(1, field(1, "x") + field(2, "y") + field(4, "Identity")) + field(2, "g") + field(11, value("x")) + field(12, value("y"))
    model = number(1, 8) + field(7, graph) + field(8, field(1, "") + number(2, 13))
    network = pickle.loads(pickle.dumps(scoring.OnnxNetwork(model)))
    x = np.random.default_rng(1).random((2, 1, 4, 4))
    assert np.allclose(network(x), x)
    assert np.allclose(scoring.UNetSegmenter(network).segment(x * 255), 1 / (1 + np.exp(-x[:, 0])))


def test_windows_of_a_file_read_only_their_strips(spark, tmp_path):
    """Of a raster by path the header and the strips of a window are read, in any slice the bytes of the file; files are written whole."""
    import numpy as np

    from rastrum.sources import geotiff, raster

    a = np.random.default_rng(1).integers(0, 255, (1500, 300)).astype("u1")
    data = geotiff.write(a, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 32648, geotiff.NONE, None)
    raster.write_files(spark.createDataFrame([("a.tif", data), ("b.tif", data[:100])], "name string, content binary"), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["a.tif", "b.tif"]
    files = raster.list_files(spark, str(tmp_path / "f"), "a*")
    tiles = spark.createDataFrame([("a.tif", 1, 10, 20, 7, 5), ("a.tif", 2, 290, 1490, 20, 20), ("none", 3, 0, 0, 2, 2)], "raster_id string, tile_id long, x_off int, y_off int, w int, h int")
    got = raster.scan_windows(files, tiles, 1).collect()
    assert {(r.row, r.col, r.b1) for r in got} == {(r, c, int(a[r, c])) for y, x, h, w in ((20, 10, 5, 7), (1490, 290, 10, 10)) for r in range(y, y + h) for c in range(x, x + w)}
    assert [(r.width, r.height) for r in raster.scan_meta(files).collect()] == [(300, 1500)]

    class Counted:
        def __init__(self, file):
            self.file, self.n = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            out = self.file.read(n)
            self.n += len(out)
            return out

    with open(tmp_path / "f" / "a.tif", "rb") as f:
        counted = Counted(f)
        geotiff.read_window(geotiff.FileBytes(counted), 0, 700, 10, 4)
        assert counted.n < len(data) / 2
        r, slices = np.random.default_rng(2), geotiff.FileBytes(f)
        for _ in range(300):
            s, n = int(r.integers(0, len(data))), int(r.choice([3, 50, 70_000]))
            assert slices[s : min(len(data), s + n)] == data[s : s + n]


def test_choices_for_tables_are_those_of_single_requests(spark):
    """The column forms against the functions of one request."""
    import itertools

    from pyspark.sql import functions as F

    from rastrum.functions import scalar as S
    from rastrum.operators import jobs as J

    def single(f, *given):
        try:
            return f(*given)
        except (J.UnavailableError, ValueError):
            return None

    cases = [(a, *b) for a in ("auto", "docker", "venv", "local", "other") for b in itertools.product((True, False), repeat=5)]
    df = spark.createDataFrame(cases, "asked string, a boolean, b boolean, c boolean, d boolean, e boolean")
    flags = [F.col(c) for c in "abcde"]
    got = df.select("*", J.backend(F.col("asked"), *flags[:3]).alias("backend"), J.image(*flags).alias("image")).collect()
    for r in got:
        assert r.backend == single(J.backend_of, r.asked, r.a, r.b, r.c) and r.image == single(J.image_source, r.a, r.b, r.c, r.d, r.e)
    names = ["cpu", " GPU ", "cuda:1", "", None, "MPS"]
    asked = spark.createDataFrame([(n,) for n in names], "n string")
    for given in ({}, {"cuda": True}, {"mps": True}):
        assert [r.d for r in asked.select(S.device(F.col("n"), **given).alias("d")).collect()] == [S.resolve_device(n, **given) for n in names]
    steps = spark.createDataFrame([(j, p) for j in ("detect", "road", "none") for p in (0, 5, 6, 94, 95, 100, 101)], "j string, p int")
    for r in steps.select("j", "p", J.step_under_way(F.col("j"), F.col("p")).alias("s")).collect():
        assert r.s == next((s for s, end in J.PROGRESS_BANDS.get(r.j, ()) if r.p <= end), None)
