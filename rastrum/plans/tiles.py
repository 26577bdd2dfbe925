"""Queries on tilings, projections and filters."""

from pyspark.sql import functions as F

from rastrum.functions import geometry as G, scalar as S
from rastrum.operators import tiling as T
from rastrum.plans import derived as D
from rastrum.plans.catalog import query

A, B_, C, D_, E, F_ = D.AFFINE


def _axis(size: str, step: int) -> str:
    return f"unnest(range(0, {size}, {step}))::int"


def _grid(step_x: int, step_y: int) -> str:
    return f"t as (select *, {_axis('width', step_x)} as x_off from (select *, {_axis('height', step_y)} as y_off from rasters))"


@query(f"with {D.RASTERS}, {_grid(512, 512)} select raster_id, x_off, y_off, least(640, width - x_off)::int as w, least(640, height - y_off)::int as h from t")
def tile_ragged(spark, d):
    return T.ragged(D.rasters(spark, d)).select("raster_id", "x_off", "y_off", "w", "h")


@query(f"with {D.RASTERS}, {_grid(600, 600)} select raster_id, least(x_off, width - 750)::int as x_off, least(y_off, height - 750)::int as y_off, 750 as w, 750 as h from t where width >= 750 and height >= 750")
def tile_clamped(spark, d):
    return T.clamped(D.rasters(spark, d)).select("raster_id", "x_off", "y_off", "w", "h")


@query(f"with {D.RASTERS}, {_grid(400, 300)} select raster_id, x_off, y_off, least(400, width - x_off)::int as w, least(300, height - y_off)::int as h from t")
def tile_disjoint(spark, d):
    return T.disjoint(D.rasters(spark, d), 400, 300).select("raster_id", "x_off", "y_off", "w", "h")


@query(f"with {D.RASTERS}, {_grid(400, 300)} select raster_id, x_off, y_off, 400 as w, 300 as h from t where width - x_off >= 400 and height - y_off >= 300")
def full_chip_filter(spark, d):
    return T.disjoint(D.rasters(spark, d), 400, 300, full_only=True).select("raster_id", "x_off", "y_off", "w", "h")


@query(f"with {D.POINTS} select id, trunc(x - 32.5)::int as x_off, trunc(y - 20)::int as y_off, 65 as w, 40 as h from points")
def tile_centered(spark, d):
    return T.centred(D.points(spark, d).withColumnsRenamed({"x": "col", "y": "row"}), 65, 40).select("id", "x_off", "y_off", "w", "h")


@query(f"with {D.RASTERS}, {_grid(600, 600)} select raster_id, x_off, y_off, ((row_number() over (partition by raster_id order by y_off, x_off) - 1) // 4)::int as batch from t")
def tile_batch(spark, d):
    return T.batches(T.disjoint(D.rasters(spark, d), 600, 600), 4, "raster_id", ["y_off", "x_off"]).select("raster_id", "x_off", "y_off", "batch")


@query(f"with {D.RASTERS}, {_grid(400, 300)} select raster_id, x_off, y_off from (select *, concat_ws('/', raster_id, y_off, x_off) as key from t) where width - x_off >= 400 order by md5('5:' || key), key limit 300")
def tile_shuffle_limit(spark, d):
    tiles = T.disjoint(D.rasters(spark, d), 400, 300).withColumn("key", F.concat_ws("/", "raster_id", "y_off", "x_off"))
    return T.shuffled_limit(tiles, F.col("w") == 400, 300, 5, "key").select("raster_id", "x_off", "y_off")


@query(f"with {D.RASTERS}, {_grid(400, 300)} select raster_id, x_off, y_off from t where width - x_off >= 400 and height - y_off >= 300 order by raster_id, y_off, x_off limit 300")
def limit_chips(spark, d):
    return T.disjoint(D.rasters(spark, d), 400, 300, full_only=True).orderBy("raster_id", "y_off", "x_off").limit(300).select("raster_id", "x_off", "y_off")


@query(f"""with {D.PROB}, c as (select *, unnest(range(floor((row - 2) / 32.0)::int, floor((row + 2) / 32.0)::int + 1))::int as block_row from prob),
b as (select *, unnest(range(floor((col - 2) / 32.0)::int, floor((col + 2) / 32.0)::int + 1))::int as block_col from c)
select block_row, block_col, count(*) as cells, count(*) filter (floor(row / 32.0) = block_row and floor(col / 32.0) = block_col) as core from b group by all""")
def halo_block(spark, d):
    return T.halo_copies(D.prob(spark, d), 32, 2).groupBy("block_row", "block_col").agg(F.count("*").alias("cells"), F.count_if("core").alias("core"))


@query(f"with {D.PROB} select (row // greatest(ceil((select max(row) + 1 from prob) / 100.0), 1)::bigint)::int as chunk, count(*) as cells, round(sum(p), 6) as total from prob group by all")
def row_chunk(spark, d):
    p = D.prob(spark, d)
    height = p.agg(F.max("row") + 1).first()[0] or 1
    return p.groupBy(T.row_chunk(F.col("row"), F.lit(height), 100).alias("chunk")).agg(F.count("*").alias("cells"), F.round(F.sum("p"), 6).alias("total"))


@query(f"with {D.DET} select id, x1 + id % 7 * 512 as x1, y1 + id % 5 * 512 as y1, x2 + id % 7 * 512 as x2, y2 + id % 5 * 512 as y2 from det")
def shift_to_global(spark, d):
    from rastrum.operators.detect import shift_to_global as shift

    return shift(D.det(spark, d).withColumns({"x_off": F.col("id") % 7 * 512, "y_off": F.col("id") % 5 * 512})).select("id", "x1", "y1", "x2", "y2")


@query(f"with {D.DET} select id, round({A} * x1 + {B_} * y1 + {C}, 6) as x, round({D_} * x1 + {E} * y1 + {F_}, 6) as y from det")
def pixel_to_world_corner(spark, d):
    w = G.to_world(D.affine_col(), F.col("x1"), F.col("y1"))
    return D.det(spark, d).select("id", F.round(w["x"], 6).alias("x"), F.round(w["y"], 6).alias("y"))


@query(f"with {D.PROB} select row, col, round({A}::double * (col + 0.5) + {B_} * (row + 0.5) + {C}, 6) as x, round({D_}::double * (col + 0.5) + {E} * (row + 0.5) + {F_}, 6) as y from prob")
def pixel_to_world_center(spark, d):
    w = G.to_world_center(D.affine_col(), F.col("col"), F.col("row"))
    return D.prob(spark, d).select("row", "col", F.round(w["x"], 6).alias("x"), F.round(w["y"], 6).alias("y"))


@query(f"with {D.POINTS} select id, floor((0.5 * (y - 3.25)) / -0.25)::bigint as row, floor((-0.5 * (x - 1.25)) / -0.25)::bigint as col from points")
def world_to_pixel(spark, d):
    at = G.to_pixel(G.affine(0.5, 0, 1.25, 0, -0.5, 3.25), F.col("x"), F.col("y"))
    return D.points(spark, d).select("id", at["row"].alias("row"), at["col"].alias("col"))


@query(f"with {D.DET} select id, round({A} * x1 + {C}, 6) as xmin, round({E} * y2 + {F_}, 6) as ymin, round({A} * x2 + {C}, 6) as xmax, round({E} * y1 + {F_}, 6) as ymax from det")
def box_polygon(spark, d):
    b = G.box_polygon(D.affine_col(), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return D.det(spark, d).select("id", *[F.round(b[c], 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"with {D.DET} select id, round({A} * (x1 + x2) / 2 + {C}, 5) as x, round({E} * (y1 + y2) / 2 + {F_}, 5) as y from det")
def centroid(spark, d):
    c = G.centroid(G.box_polygon(D.affine_col(), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    return D.det(spark, d).select("id", F.round(c["x"], 5).alias("x"), F.round(c["y"], 5).alias("y"))


@query("select vec_id from embeddings where len(list_filter(embedding, lambda v: v > 0.45)) > 0")
def tile_empty_skip(spark, d):
    dark = F.transform("embedding", lambda v: F.when(v > 0.45, 1).otherwise(0))
    return D.table(spark, d, "embeddings").where(F.exists(dark, lambda v: v != 0)).select("vec_id")


@query(f"with {D.PROB} select row, col, (p > 0.7)::int as v from prob")
def prob_threshold(spark, d):
    from rastrum.operators.mask import threshold

    p = D.prob(spark, d)
    return p.join(threshold(p, 0.7).withColumn("v", F.lit(1)), ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0)).alias("v"))


LENGTHS = f"{D.VERTICES}, l as (select line_id, count(*) as n, sum(coalesce(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)), 0)) as length from vertices group by line_id)"


def _lengths(spark, d):
    return D.lines(spark, d).withColumn("length", F.round(G.line_length(F.col("pts")), 6))


@query(f"with {LENGTHS} select line_id, round(length, 6) as length from l")
def line_length(spark, d):
    return _lengths(spark, d).select("line_id", "length")


@query(f"with {LENGTHS} select line_id from l where round(length, 6) > 1500")
def length_filter_gt(spark, d):
    return _lengths(spark, d).where(F.col("length") > 1500).select("line_id")


@query(f"with {LENGTHS} select line_id from l where round(length, 6) >= 1500")
def length_filter_ge(spark, d):
    return _lengths(spark, d).where(F.col("length") >= 1500).select("line_id")


@query(f"with {LENGTHS} select line_id, n from l where n > 5")
def min_vertices(spark, d):
    return D.lines(spark, d).where(F.size("pts") > 5).select("line_id", F.size("pts").cast("long").alias("n"))


@query(f"with {LENGTHS} select line_id from l where n > 0")
def nonempty_geom(spark, d):
    return D.lines(spark, d).where(F.size("pts") > 0).select("line_id")


@query("select vec_id, len(list_filter(embedding, lambda v: v < -0.2))::bigint as nans from embeddings where len(list_filter(embedding, lambda v: v < -0.2)) < 5")
def nan_count_filter(spark, d):
    chip = F.transform("embedding", lambda v: F.when(v < -0.2, F.lit(float("nan"))).otherwise(v.cast("double")))
    n = F.size(F.filter(chip, lambda v: F.isnan(v))).cast("long")
    return D.table(spark, d, "embeddings").select("vec_id", n.alias("nans")).where("nans < 5")


@query("select vec_id, case when label % 2 = 0 then 1 else label end as v from embeddings")
def mask_normalise(spark, d):
    raw = F.when(F.col("label") % 2 == 0, F.lit(255)).otherwise(F.col("label"))
    return D.table(spark, d, "embeddings").select("vec_id", S.normalise_mask(raw).alias("v"))


@query("select vec_id, (label > 0)::int as v from embeddings")
def gt_binarise(spark, d):
    return D.table(spark, d, "embeddings").select("vec_id", (F.col("label") > 0).cast("int").alias("v"))


@query("""with c as (select vec_id // 8 as chip, vec_id, unnest(range(0, 64))::int as band, unnest(embedding)::double as v from embeddings), m as (select *, min(v) over w as lo, max(v) over w as hi from c window w as (partition by chip, band))
select vec_id, band, coalesce(floor(round(255 * (v - lo) / nullif(hi - lo, 0), 6)), 0)::int as v from m""")
def minmax_scale(spark, d):
    from pyspark.sql import Window

    e = D.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("chip"), "vec_id", F.posexplode("embedding").alias("band", "v")).withColumn("v", F.col("v").cast("double"))
    w = Window.partitionBy("chip", "band")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return e.select("vec_id", "band", F.coalesce(F.floor(F.round(F.try_divide(255 * (F.col("v") - lo), hi - lo), 6)), F.lit(0)).cast("int").alias("v"))


@query("select p_partkey, round((p_partkey % 256) / 255.0, 6)::double as v, round(((p_partkey % 256) / 255.0 - 0.485) / 0.229, 6)::double as z from part")
def scale_255(spark, d):
    v = (F.col("p_partkey") % 256) / 255.0
    return D.table(spark, d, "part").select("p_partkey", F.round(v, 6).alias("v"), F.round((v - 0.485) / 0.229, 6).alias("z"))


@query("select vec_id, round(1 / (1 + exp(-embedding[1]::double)), 6) as p from embeddings")
def sigmoid(spark, d):
    return D.table(spark, d, "embeddings").select("vec_id", F.round(S.sigmoid(F.col("embedding")[0].cast("double")), 6).alias("p"))


@query("select vec_id, round(exp(embedding[2]::double) / (exp(embedding[1]::double) + exp(embedding[2]::double)), 6) as p from embeddings")
def softmax_road(spark, d):
    e = F.col("embedding")
    return D.table(spark, d, "embeddings").select("vec_id", F.round(S.softmax_second(e[0].cast("double"), e[1].cast("double")), 6).alias("p"))


@query("select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as k from embeddings")
def argmax_class(spark, d):
    return D.table(spark, d, "embeddings").select("vec_id", S.argmax_class(F.col("embedding")).alias("k"))


@query(f"with {D.PROB} select row, col, round(greatest((1 - p) * 15, 1e-6), 6) as cost from prob")
def cost_map(spark, d):
    return D.prob(spark, d).select("row", "col", F.round(S.cost(F.col("p")), 6).alias("cost"))


@query("""select c_custkey, round(radians(lon) * 6378137.0, 3) as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as y, lon, lat
from (select c_custkey, (c_custkey % 360 - 180)::double as lon, (c_custkey % 161 - 80)::double as lat from customer)""")
def crs_web_mercator(spark, d):
    c = D.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 161 - 80).cast("double").alias("lat"))
    m = G.to_web_mercator(F.col("lon"), F.col("lat"))
    back = G.from_web_mercator(m["x"], m["y"])
    return c.select("c_custkey", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y"), F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


@query(f"""with c as (select c_custkey, radians((c_custkey % 800) / 10.0) as phi, radians(102.0 + c_custkey % 60 / 10.0 - 105) as lam from customer),
k as (select n, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) as radius, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 as a1, 13 * n * n / 48 - 3 * n * n * n / 5 as a2, 61 * n * n * n / 240 as a3, 2 * sqrt(n) / (1 + n) as e
  from (select (1 / 298.257223563) / (2 - 1 / 298.257223563) as n)),
t as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as t from c, k),
x as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from t)
select c_custkey, round(500000 + 0.9996 * radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) as x,
  round(0.9996 * radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) as y from x""")
def crs_utm(spark, d):
    u = G.to_utm(F.lit(102.0) + F.col("c_custkey") % 60 / 10, (F.col("c_custkey") % 800) / 10, 48)
    return D.table(spark, d, "customer").select("c_custkey", F.round(u["x"], 3).alias("x"), F.round(u["y"], 3).alias("y"))
