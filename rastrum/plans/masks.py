"""Queries on probability maps, masks, their morphology, components and metrics."""

from pyspark.sql import functions as F

from rastrum.operators import mask as M, metrics as X
from rastrum.operators.rank import ranked
from rastrum.operators.spatial import neighbours8 as near8
from rastrum.plans import derived as D
from rastrum.plans.catalog import query

GRID = f"{D.PROB}, g as (select row, col, (p > 0.5)::int as v from prob)"


def _pass(src: str, dst: str, f: str, lo: int, hi: int) -> str:
    return f"""{dst}_rows as (select row, col, {f}(v) over (partition by row order by col range between {lo} preceding and {hi} following) as v from {src}),
{dst} as (select row, col, {f}(v) over (partition by col order by row range between {lo} preceding and {hi} following) as v from {dst}_rows)"""


N8 = "(values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc)"
PAIRS = f"pairs as (select a.row, a.col, b.row as n_row, b.col as n_col from mask a, {N8} join mask b on b.row = a.row + dr and b.col = a.col + dc)"
MASK = f"{D.PROB}, {D.mask_sql(0.7)}"
COUNTS = "counts as (select m.row, m.col, count(p.n_row) as n from mask m left join pairs p using (row, col) group by m.row, m.col)"
SIMPLE = f"""simple as (select row, col from counts where n <= 2),
pairs2 as (select a.row, a.col, b.row as n_row from simple a, {N8} join simple b on b.row = a.row + dr and b.col = a.col + dc),
counts2 as (select m.row, m.col, count(p.n_row) as n from simple m left join pairs2 p using (row, col) group by m.row, m.col)"""


@query(f"with {D.PROB} select row, col, round(avg(v), 6) as p from (select row, col, p as v from prob union all select row, col, 1 - p from prob where col >= 32) group by row, col")
def overlap_mean(spark, d):
    p = D.prob(spark, d)
    return M.overlap_mean(p.unionByName(p.where("col >= 32").withColumn("p", 1 - F.col("p")))).withColumn("p", F.round("p", 6))


@query(f"with {GRID}, {_pass('g', 'e', 'min', 1, 1)} select * from e")
def morph_erode(spark, d):
    return M.erode(D.grid(spark, d), 3)


@query(f"with {GRID}, {_pass('g', 'e', 'max', 2, 1)} select * from e")
def morph_dilate(spark, d):
    """An even kernel, which reaches one further back."""
    return M.dilate(D.grid(spark, d), 4)


@query(f"with {GRID}, {_pass('g', 'e', 'min', 1, 1)}, {_pass('e', 'o', 'max', 1, 1)} select * from o")
def morph_open(spark, d):
    return M.opening(D.grid(spark, d), 3)


@query(f"with {GRID}, {_pass('g', 'e', 'max', 2, 2)}, {_pass('e', 'o', 'min', 2, 2)} select * from o")
def morph_close_cv(spark, d):
    return M.closing(D.grid(spark, d), 2)


DIAMOND = ", ".join(f"({r},{c})" for r, c in M.diamond(2))


@query(f"""with {MASK}, size as (select max(row) + 1 as h, 64 as w from prob), o as (from (values {DIAMOND}) o(dr, dc)),
grown as (select distinct row + dr as row, col + dc as col from mask, o, size where row + dr between 0 and h - 1 and col + dc between 0 and w - 1)
select row, col from (select row + dr as row, col + dc as col, count(*) as n from grown, o, size where row + dr between 0 and h - 1 and col + dc between 0 and w - 1 group by 1, 2) where n = {len(M.diamond(2))}""")
def morph_close_cross(spark, d):
    p = D.prob(spark, d)
    height = (p.agg(F.max("row")).first()[0] or 0) + 1
    return M.closing_cross(p.where("p > 0.7").select("row", "col"), 2, F.lit(height), F.lit(64))


@query(f"with {MASK}, {PAIRS} select * from pairs")
def neighbor8(spark, d):
    return near8(D.mask(spark, d))


@query(f"with {MASK}, {PAIRS}, {COUNTS} select * from counts")
def neighbor_count(spark, d):
    return M.neighbour_count(D.mask(spark, d))


@query(f"with {MASK}, {PAIRS}, {COUNTS} select row, col from counts where n <= 2")
def junction_remove(spark, d):
    return M.without_junctions(D.mask(spark, d))


@query(f"with {MASK}, {PAIRS}, {COUNTS}, {SIMPLE} select row, col from counts2 where n <= 1")
def endpoint_detect(spark, d):
    return M.endpoints(D.mask(spark, d))


@query(f"with {MASK}, {PAIRS}, {COUNTS} select row, col from counts where n = 1")
def endpoint_degree1(spark, d):
    return M.endpoints_of_degree_one(D.mask(spark, d))


@query(f"with {MASK}, {PAIRS}, {COUNTS}, {SIMPLE} select row, col, row_number() over (order by row, col) as r from counts2 where n <= 1")
def sort_rowmajor(spark, d):
    return ranked(M.endpoints(D.mask(spark, d)), "row", "col")


@query(f"with {MASK} select row, col, row_number() over (partition by row order by col) as r from mask")
def sort_col(spark, d):
    from pyspark.sql import Window

    return D.mask(spark, d).select("row", "col", F.row_number().over(Window.partitionBy("row").orderBy("col")).cast("long").alias("r"))


def _components(n8: str) -> str:
    return f"""recursive {MASK}, nodes as (select row, col, row::bigint * 2147483648 + col as id from mask),
links as (select a.id as a, b.id as b from nodes a, {n8} join nodes b on b.row = a.row + dr and b.col = a.col + dc),
comp(id, label) using key (id) as (select id, id from nodes union
  select l.b, min(c.label) from comp c join links l on l.a = c.id join recurring.comp k on k.id = l.b where c.label < k.label group by l.b)"""


@query(f"with {_components(N8)} select row, col, label from comp join nodes using (id)")
def connected_components(spark, d):
    return M.label(D.mask(spark, d))


@query(f"with {_components(N8)} select row, col, label, area from (select row, col, label, count(*) over (partition by label) as area from comp join nodes using (id)) where area >= 4")
def component_area(spark, d):
    return M.component_area(D.mask(spark, d), 4)


@query(f"with {_components('(values (-1,0),(0,-1),(0,1),(1,0)) o(dr, dc)')} select row, col from (select row, col, count(*) over (partition by label) as area from comp join nodes using (id)) where area >= 3")
def remove_small_objects(spark, d):
    return M.component_area(D.mask(spark, d), 3, connectivity=4).select("row", "col")


#: The map as three rasters that use the same rows and columns.
SEVERAL = f"{D.PROB}, several as (select 'r' || row % 3 as raster_id, (row // 3)::int as row, col, p from prob)"


def _several(spark, d):
    return D.prob(spark, d).select(F.concat(F.lit("r"), (F.col("row") % 3).cast("string")).alias("raster_id"), F.floor(F.col("row") / 3).cast("int").alias("row"), "col", "p")


@query(f"with {SEVERAL} select raster_id, row, col, round(avg(v), 6) as p from (select raster_id, row, col, p as v from several union all select raster_id, row, col, 1 - p from several where col >= 32) group by raster_id, row, col")
def overlap_mean_of_rasters(spark, d):
    p = _several(spark, d)
    return M.overlap_mean(p.unionByName(p.where("col >= 32").withColumn("p", 1 - F.col("p")))).withColumn("p", F.round("p", 6))


def _raster_pass(src: str, dst: str, f: str) -> str:
    return f"""{dst}_rows as (select raster_id, row, col, {f}(v) over (partition by raster_id, row order by col range between 1 preceding and 1 following) as v from {src}),
{dst} as (select raster_id, row, col, {f}(v) over (partition by raster_id, col order by row range between 1 preceding and 1 following) as v from {dst}_rows)"""


@query(f"with {SEVERAL}, g as (select raster_id, row, col, (p > 0.5)::int as v from several), {_raster_pass('g', 'e', 'min')}, {_raster_pass('e', 'o', 'max')} select * from o")
def morph_open_of_rasters(spark, d):
    return M.opening(_several(spark, d).select("raster_id", "row", "col", (F.col("p") > 0.5).cast("int").alias("v")), 3)


RASTER_COMPONENTS = f"""recursive {SEVERAL}, nodes as (select raster_id, row, col, row::bigint * 2147483648 + col as cell, row_number() over (order by raster_id, row, col) as id from several where p > 0.7),
links as (select a.id as a, b.id as b from nodes a, {N8} join nodes b on b.raster_id = a.raster_id and b.row = a.row + dr and b.col = a.col + dc),
comp(id, label) using key (id) as (select id, id from nodes union
  select l.b, min(c.label) from comp c join links l on l.a = c.id join recurring.comp k on k.id = l.b where c.label < k.label group by l.b)"""


@query(f"with {RASTER_COMPONENTS} select n.raster_id, n.row, n.col, k.cell as label, count(*) over (partition by label) as area from comp join nodes n using (id) join nodes k on k.id = label qualify area >= 4")
def component_area_of_rasters(spark, d):
    return M.component_area(_several(spark, d).where("p > 0.7").drop("p"), 4)


TWO = f"{D.PROB}, {D.mask_sql(0.5, 'a')}, {D.mask_sql(0.6, 'b0')}, b as (select row, (col + 1) % 64 as col from b0)"


def _two(spark, d):
    p = D.prob(spark, d)
    return p.where("p > 0.5").select("row", "col"), p.where("p > 0.6").select("row", ((F.col("col") + 1) % 64).alias("col"))


@query(f"with {TWO} select row, col from a union select row, col from b")
def mask_union(spark, d):
    return M.union(*_two(spark, d))


@query(f"with {TWO} select 'and' as op, row, col from (from a intersect from b) union all select 'or', row, col from (from a union from b)")
def mask_intersect_union(spark, d):
    a, b = _two(spark, d)
    return a.intersect(b).select(F.lit("and").alias("op"), "row", "col").unionByName(M.union(a, b).select(F.lit("or").alias("op"), "row", "col"))


@query(f"with {TWO} select row, col, (a.one is not null)::int as p, (b.one is not null)::int as t from (select *, 1 as one from a) a full join (select *, 1 as one from b) b using (row, col)")
def mask_pair_join(spark, d):
    return X.mask_pairs(*_two(spark, d))


@query(f"with {TWO} select round((select count(*) from (from a intersect from b)) / (select count(*) from (from a union from b))::double, 6) as iou")
def raster_iou(spark, d):
    return X.raster_iou(*_two(spark, d)).withColumn("iou", F.round("iou", 6))


@query(f"with {D.PROB}, a as (select * from prob where row < 300), b as (select * from prob where col < 50), s as (select least((select max(row) from a), (select max(row) from b)) as r, least((select max(col) from a), (select max(col) from b)) as c) select 'a' as side, row, col from a, s where row <= r and col <= c union all select 'b', row, col from b, s where row <= r and col <= c")
def crop_to_common(spark, d):
    p = D.prob(spark, d)
    a, b = M.crop_to_common(p.where("row < 300"), p.where("col < 50"))
    return a.select(F.lit("a").alias("side"), "row", "col").unionByName(b.select(F.lit("b").alias("side"), "row", "col"))


@query()
def vector_iou(spark, d):
    """All lines against the same moved by one unit, on cells of two units. SQL over the cells of all lines is too slow; the tests have loops."""
    lines = D.lines(spark, d)
    moved = lines.withColumn("pts", F.transform("pts", lambda p: F.struct((p["x"] + 1.0).alias("x"), p["y"].alias("y"))))
    return X.vector_iou(lines, moved, 3.0, 2.0).withColumn("iou", F.round("iou", 4))


SCORED = f"{D.PROB}, scored as (select p.row // 8 as batch, p, (label + col) % 2 as y, (p > 0.5)::int as pred from prob p join embeddings e on e.vec_id = p.row)"


def _scored(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"), "label")
    s = D.prob(spark, d).join(e, "row")
    return s.select(F.floor(F.col("row") / 8).alias("batch"), "p", ((F.col("label") + F.col("col")) % 2).alias("y"), (F.col("p") > 0.5).cast("int").alias("pred"), "label", "col")


@query(f"with {SCORED} select round(avg((pred = y)::int), 6) as accuracy from scored")
def pixel_accuracy(spark, d):
    return X.pixel_accuracy(_scored(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {SCORED} select round(avg(dice), 6) as dice from (select batch, 2 * sum(pred * y) / (sum(pred + y) + 1e-8) as dice from scored group by batch)")
def dice_mean(spark, d):
    return X.dice_mean(_scored(spark, d)).withColumn("dice", F.round("dice", 6))


@query(f"""with {D.PROB}, s as (select case when (label + col) % 7 = 0 then 255 else (label + col) % 3 end as y, (p > 0.4)::int + (p > 0.6)::int as pred from prob p join embeddings e on e.vec_id = p.row),
c as (select y, pred, count(*) as n from s where y <> 255 group by all), k as (select y as label from c union select pred from c),
i as (select label, coalesce(sum(n) filter (y = label and pred = label), 0) / sum(n)::double as iou from k join c on y = label or pred = label group by label)
select label, round(iou, 6) as iou, round(avg(iou) over (), 6) as mean_iou from i""")
def mean_iou(spark, d):
    s = _scored(spark, d)
    k = F.col("label") + F.col("col")
    s = s.select(F.when(k % 7 == 0, F.lit(255)).otherwise(k % 3).cast("int").alias("y"), ((F.col("p") > 0.4).cast("int") + (F.col("p") > 0.6).cast("int")).alias("pred"))
    return X.mean_iou(s).select("label", F.round("iou", 6).alias("iou"), F.round("mean_iou", 6).alias("mean_iou"))


# The lists of the parameter search.
SEARCH = {"threshold": [0.4, 0.5, 0.6], "kernel": [3, 5, 7], "min_size": [250, 450, 750]}


@query(f"""with {D.PROB}, params as (select row_number() over (order by i, j, l) - 1 as ordinal, t::double as threshold, k::int as kernel, m::int as min_size from (values (0, 0.4), (1, 0.5), (2, 0.6)) a(i, t), (values (0, 3), (1, 5), (2, 7)) b(j, k), (values (0, 250), (1, 450), (2, 750)) c(l, m))
select ordinal, threshold, kernel, min_size, count(*) filter (p > threshold) as pixels from prob, params group by all""")
def param_cross(spark, d):
    """All combinations of the lists, each with the pixels of the map above its threshold."""
    both = D.prob(spark, d).crossJoin(F.broadcast(X.parameters(spark, **SEARCH)))  # a fixed list of parameters
    return both.groupBy("ordinal", "threshold", "kernel", "min_size").agg(F.count_if(F.col("p") > F.col("threshold")).alias("pixels"))


SCORES = f"""{D.PROB}, params as (select row_number() over (order by t, s) - 1 as ordinal, t, s from (values (0.4), (0.5), (0.6)) a(t), (values (0.45), (0.55)) b(s)),
scores as (select ordinal, t::double as threshold, s::double as truth, round(count(*) filter (p > t and p > s) / nullif(count(*) filter (p > t or p > s), 0)::double, 6) as score from prob, params group by all)"""


def _scores(spark, d):
    params = X.parameters(spark, threshold=[0.4, 0.5, 0.6], truth=[0.45, 0.55])
    both = D.prob(spark, d).crossJoin(F.broadcast(params))  # a fixed list of parameters
    hit, any_ = (F.col("p") > F.col("threshold")) & (F.col("p") > F.col("truth")), (F.col("p") > F.col("threshold")) | (F.col("p") > F.col("truth"))
    return both.groupBy("ordinal", "threshold", "truth").agg(F.round(F.count_if(hit) / F.nullif(F.count_if(any_), F.lit(0)), 6).alias("score"))


@query(f"with {SCORES} select * from scores order by score desc, ordinal limit 1")
def argmax_params(spark, d):
    return X.best_parameters(_scores(spark, d))


@query(f"with {SCORES} select * from scores qualify row_number() over (partition by truth order by score desc, ordinal) = 1")
def topk_best(spark, d):
    from pyspark.sql import Window

    return _scores(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("score"), "ordinal"))).where("r = 1").drop("r")
