"""Queries on detections: filters, joins, greedy merging, areas of interest."""

from pyspark.sql import functions as F

from rastrum.functions import geometry as G
from rastrum.operators import detect as O, spatial as P
from rastrum.operators.rank import ranked
from rastrum.plans import derived as D
from rastrum.plans.catalog import query

A, _, C, _, E, F_ = D.AFFINE
COLS = "grp, id, x1, y1, x2, y2, score, category"
GOOD = "good as (select * from det where score > 5)"
INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
AREA = lambda s: f"(({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1))"
IOS = f"{INTER} / (least({AREA('a')}, {AREA('b')}) + 1e-7)"
IOU = f"{INTER} / (({AREA('b')} - {INTER}) + {AREA('a')} + 1e-7)"


def _good(spark, d):
    return D.det(spark, d).where("score > 5")


@query(f"with {D.DET} select {COLS} from det where score >= 250")
def conf_filter(spark, d):
    return O.conf_filter(D.det(spark, d), 250)


@query(f"with {D.DET} select {COLS} from det where score >= case category when 'view' then 100 when 'signup' then 50 when 'purchase' then 20 when 'error' then 200 else 0.01 end")
def class_conf_filter(spark, d):
    return O.class_conf_filter(D.det(spark, d), D.CLASSES)


@query(f"with {D.DET}, {GOOD} select a.grp, a.id as a, b.id as b, round({IOS}, 6) as value from good a join good b on a.grp = b.grp and a.id < b.id and {IOS} >= 0.5")
def join_overlap_ios(spark, d):
    return P.overlap_pairs(_good(spark, d), "grp", "id").withColumn("value", F.round("value", 6))


@query(f"with {D.DET}, {GOOD} select a.grp, a.id as a, b.id as b, round({IOU}, 6) as value from good a join good b on a.grp = b.grp and a.id < b.id and {IOU} >= 0.3")
def join_overlap_iou(spark, d):
    return P.overlap_pairs(_good(spark, d), "grp", "id", "iou", 0.3).withColumn("value", F.round("value", 6))


FOLD = f"""ranked as (select *, row_number() over (partition by grp order by score desc, id) as r from good),
hits as (select lo.grp, lo.r as lo, list(hi.r) as his from (select *, x1 as ax1 from ranked) hi join ranked lo on hi.grp = lo.grp and hi.r < lo.r
  and {IOS.replace("a.", "hi.").replace("b.", "lo.")} >= 0.5 group by lo.grp, lo.r),
fold as (select grp, 1::bigint as r, [1::bigint] as kept from ranked where r = 1
  union all select f.grp, f.r + 1, case when len(list_intersect(f.kept, coalesce(h.his, []))) > 0 then f.kept else list_append(f.kept, f.r + 1) end
  from fold f join ranked n on n.grp = f.grp and n.r = f.r + 1 left join hits h on h.grp = f.grp and h.lo = f.r + 1),
last as (select grp, arg_max(kept, r) as kept from fold group by grp),
owned as (select k.*, case when list_contains(l.kept, k.r) then k.r else list_min(list_intersect(l.kept, h.his)) end as owner from ranked k join last l using (grp) left join hits h on h.grp = k.grp and h.lo = k.r)"""
MERGED = "merged as (select o.grp, any_value(k.id) as id, min(o.x1) as x1, min(o.y1) as y1, max(o.x2) as x2, max(o.y2) as y2, max(o.score) as score, any_value(k.category) as category, count(*) as members from owned o join ranked k on k.grp = o.grp and k.r = o.owner group by o.grp, o.owner)"


@query(f"with recursive {D.DET}, {GOOD}, {FOLD}, {MERGED} select * from merged")
def greedy_nmm(spark, d):
    return O.greedy_nmm(_good(spark, d))


@query(f"with recursive {D.DET}, {GOOD}, {FOLD} select o.grp, o.id, k.id as owner from owned o join ranked k on k.grp = o.grp and k.r = o.owner")
def nmm_merge(spark, d):
    return O.greedy_owners(_good(spark, d)).select("grp", "id", "owner")


@query(f"with recursive {D.DET}, good as (select grp, id, x1, y1, x2, y2, ceil(score / 200) as score, category from det where score > 5), {FOLD}, {MERGED} select grp, id, category, members from merged")
def nmm_category_tie(spark, d):
    return O.greedy_nmm(_good(spark, d).withColumn("score", F.ceil(F.col("score") / 200))).select("grp", "id", "category", "members")


@query(f"with {D.DET} select grp, id, row_number() over (partition by grp order by score desc, id) as r from det")
def sort_score(spark, d):
    return D.det(spark, d).select("grp", "id", O.score_rank("grp", "id").cast("long").alias("r"))


@query(f"with {D.POINTS} select id, x, y, row_number() over (order by y desc, id) as r from points")
def sort_y_desc(spark, d):
    return ranked(D.points(spark, d).select("id", "x", "y"), F.desc("y"), "id")


@query(f"with {D.POINTS} select a.grp, a.id as a, b.id as b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) as distance from points a join points b on a.grp = b.grp and a.id < b.id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60")
def radius_pairs(spark, d):
    return P.radius_pairs(D.points(spark, d), "grp", "id", 60.0).withColumn("distance", F.round("distance", 6))


SUPPRESS = f"""{D.POINTS}, ranked as (select *, row_number() over (partition by grp order by y desc, id) as r from points),
hits as (select lo.grp, lo.r as lo, list(hi.r) as his from ranked hi join ranked lo on hi.grp = lo.grp and hi.r < lo.r and sqrt(pow(hi.x - lo.x, 2) + pow(hi.y - lo.y, 2)) < 80 group by lo.grp, lo.r),
fold as (select grp, 1::bigint as r, [1::bigint] as kept from ranked where r = 1
  union all select f.grp, f.r + 1, case when len(list_intersect(f.kept, coalesce(h.his, []))) > 0 then f.kept else list_append(f.kept, f.r + 1) end
  from fold f join ranked n on n.grp = f.grp and n.r = f.r + 1 left join hits h on h.grp = f.grp and h.lo = f.r + 1),
last as (select grp, arg_max(kept, r) as kept from fold group by grp)"""


@query(f"with recursive {SUPPRESS} select k.grp, k.id from ranked k join last l using (grp) where list_contains(l.kept, k.r)")
def buffer_suppress(spark, d):
    return O.buffer_suppress(D.points(spark, d), "grp", "id", 80.0).select("grp", "id")


@query(f"with recursive {SUPPRESS} select k.grp, k.id from ranked k join last l using (grp) where not list_contains(l.kept, k.r)")
def invalid_set(spark, d):
    p = D.points(spark, d)
    return p.join(O.buffer_suppress(p, "grp", "id", 80.0).select("id"), "id", "left_anti").select("grp", "id")


MATCH = f"""{D.POINTS}, pairs as (select a.id as a, b.id as b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as distance from points a join points b on a.grp = b.grp and a.id < b.id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60),
numbered as (select *, row_number() over (order by distance, a, b) as r from pairs),
fold as (select 0::bigint as r, []::bigint[] as used, null::bigint as a, null::bigint as b union all
  select n.r, case when list_contains(f.used, n.a) or list_contains(f.used, n.b) then f.used else list_concat(f.used, [n.a, n.b]) end,
    case when list_contains(f.used, n.a) or list_contains(f.used, n.b) then null else n.a end, n.b from fold f join numbered n on n.r = f.r + 1)"""


@query(f"with recursive {MATCH} select a, b from fold where a is not null")
def greedy_match(spark, d):
    return O.greedy_match_points(D.points(spark, d), "grp", "id", 60.0).select("a", "b")


@query(f"with recursive {MATCH} select id from points where not list_contains((select arg_max(used, r) from fold), id)")
def available_set(spark, d):
    p = D.points(spark, d)
    used = O.greedy_match_points(p, "grp", "id", 60.0).select(F.explode(F.array("a", "b")).alias("id"))
    return p.select("id").join(used, "id", "left_anti")


@query(f"with {D.POINTS}, {D.AOI}, pts as (select id, x, y from points), {D.INSIDE} select id from inside")
def aoi_within(spark, d):
    return P.points_within(D.points(spark, d), D.aoi(spark, d)).select("id")


def _turn(a, b, c):
    return f"sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _on(a, b, c):
    return f"({_turn(a, b, c)} = 0 and {c}x between least({a}x, {b}x) and greatest({a}x, {b}x) and {c}y between least({a}y, {b}y) and greatest({a}y, {b}y))"


TOUCH = f"""{D.VERTICES}, {D.AOI}, pts as (select line_id * 10 + n as id, x, y from vertices), {D.INSIDE},
legs as (select line_id, x as px, y as py, x2 as qx, y2 as qy from vertices where x2 is not null), sides as (select ax as rx, ay as ry, bx as sx, by_ as sy from edges),
touch as (select distinct line_id from legs, sides where ({_turn('p', 'q', 'r')} * {_turn('p', 'q', 's')} < 0 and {_turn('r', 's', 'p')} * {_turn('r', 's', 'q')} < 0) or {_on('r', 's', 'p')} or {_on('r', 's', 'q')} or {_on('p', 'q', 'r')} or {_on('p', 'q', 's')}
  union select id // 10 from inside)"""


@query(f"with {TOUCH} select line_id from touch")
def aoi_intersects(spark, d):
    return P.lines_intersecting(D.lines(spark, d), D.aoi(spark, d)).select("line_id")


@query(f"with {D.AOI} select count(distinct ring) as rings, count(*) as points from edges")
def dissolve(spark, d):
    return P.dissolve(D.aoi(spark, d)).agg(F.count("*").alias("rings"), F.sum(F.size("pts")).alias("points"))


FLAGSHIP = f"""{D.DET}, conf as (select * from det where score >= 5), good as (select * from conf where score >= case category when 'view' then 100 when 'signup' then 50 when 'purchase' then 20 when 'error' then 200 else 0.01 end), {FOLD}, {MERGED},
pts as (select id, (x1 + x2) / 2 * 1.0 as x, (y1 + y2) / 2 * 1.0 as y from merged), {D.AOI}, {D.INSIDE}"""


def _merged_inside(spark, d):
    det = O.class_conf_filter(O.conf_filter(D.det(spark, d), 5), D.CLASSES)
    merged = O.greedy_nmm(det)
    return P.points_within(merged.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2}), D.aoi(spark, d))


@query(f"with recursive {FLAGSHIP} select category, count(*) as n, round(max(m.score), 6) as best from inside join merged m using (id) group by category")
def flagship_detections(spark, d):
    return _merged_inside(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query(f"with recursive {FLAGSHIP} select count(*) as total_detections from inside")
def count_detections(spark, d):
    return _merged_inside(spark, d).agg(F.count("*").alias("total_detections"))


@query(f"with {D.DET} select id % 4 as tile, count(*) as n from det group by 1")
def detections_append(spark, d):
    det = D.det(spark, d)
    parts = [det.where(F.col("id") % 4 == i).withColumn("tile", F.lit(i).cast("long")) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("tile").agg(F.count("*").alias("n"))


@query(f"with {D.DET} select id, case category when 'Healthy' then '#39FF14' when 'Yellowish' then '#FFFF00' when 'Dead' then '#000000' else 'red' end as colour from (select id, case category when 'view' then 'Healthy' when 'error' then 'Dead' else category end as category from det)")
def sink_layer_style(spark, d):
    from rastrum.functions.scalar import layer_colour

    c = F.when(F.col("category") == "view", "Healthy").when(F.col("category") == "error", "Dead").otherwise(F.col("category"))
    return D.det(spark, d).select("id", layer_colour(c).alias("colour"))


@query(f"with {D.DET} select id, round({A} * x1 + {C}, 4) as x, round(least(x2 - x1, y2 - y1), 6) as side, ceil(score)::bigint as up, trunc(score)::int as whole, round(score, 2) as r2, abs(x1 - y1) as gap from det")
def scalar_math(spark, d):
    x = G.to_world(D.affine_col(), F.col("x1"), F.col("y1"))["x"]
    return D.det(spark, d).select("id", F.round(x, 4).alias("x"), F.round(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("side"), F.ceil("score").alias("up"), F.col("score").cast("int").alias("whole"), F.round("score", 2).alias("r2"), F.abs(F.col("x1") - F.col("y1")).alias("gap"))
