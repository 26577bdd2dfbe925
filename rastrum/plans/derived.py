"""Deterministic rasters, detections, points and messages derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AFFINE = (0.05, 0.0, 500000.0, 0.0, -0.05, 100000.0)
CLASSES = {"view": 100.0, "signup": 50.0, "purchase": 20.0, "error": 200.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in groups: grp, id, x1, y1, x2, y2, score, category_id, category."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("grp"), i.alias("id"), (i * 37 % 400).cast("double").alias("x1"), (i * 91 % 400).cast("double").alias("y1"),
        (i * 37 % 400 + 20 + i * 7 % 61).cast("double").alias("x2"), (i * 91 % 400 + 20 + i * 11 % 61).cast("double").alias("y2"), F.col("value").alias("score"), F.col("event_type").alias("category"),
    )


DET = """det as (select user_id as grp, event_id as id, (event_id * 37 % 400)::double as x1, (event_id * 91 % 400)::double as y1, (event_id * 37 % 400 + 20 + event_id * 7 % 61)::double as x2,
  (event_id * 91 % 400 + 20 + event_id * 11 % 61)::double as y2, value as score, event_type as category from events)"""


def prob(spark: SparkSession, d: str) -> DataFrame:
    """A probability map: row, col, p."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select("row", "col", F.round(1 / (1 + F.exp(-8 * F.col("v").cast("double"))), 6).alias("p"))


PROB = """prob as (select row, col, round(1 / (1 + exp(-8 * v::double)), 6) as p from (select vec_id::int as row, (unnest(range(0, 64)))::int as col, unnest(embedding) as v from embeddings))"""


def mask(spark: SparkSession, d: str, t: float = 0.7) -> DataFrame:
    return prob(spark, d).where(F.col("p") > t).select("row", "col")


def mask_sql(t: float = 0.7, name: str = "mask") -> str:
    return f"{name} as (select row, col from prob where p > {t})"


def grid(spark: SparkSession, d: str, t: float = 0.5) -> DataFrame:
    """A dense mask: row, col, v."""
    return prob(spark, d).select("row", "col", (F.col("p") > t).cast("int").alias("v"))


def rasters(spark: SparkSession, d: str) -> DataFrame:
    """Raster sizes: raster_id, width, height."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("raster_id"), (F.col("p_partkey") * 37 % 3000).cast("int").alias("width"), (F.col("p_size") * 53 % 2500).cast("int").alias("height"))


RASTERS = "rasters as (select p_partkey as raster_id, (p_partkey * 37 % 3000)::int as width, (p_size * 53 % 2500)::int as height from part)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Points in groups: grp, id, x, y."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), k.alias("id"), (k * 83 % 997).cast("double").alias("x"), (k * 59 % 991).cast("double").alias("y"))


POINTS = "points as (select c_nationkey as grp, c_custkey as id, (c_custkey * 83 % 997)::double as x, (c_custkey * 59 % 991)::double as y from customer)"


def aoi(spark: SparkSession, d: str) -> DataFrame:
    """Areas of interest: a rectangle for each nation and one concave ring."""
    k = F.col("n_nationkey").cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.array(F.array(p(k * 40, k * 37), p(k * 40 + 30, k * 37), p(k * 40 + 30, k * 37 + 90), p(k * 40, k * 37 + 90)))
    concave = [(0.0, 600.0), (300.0, 600.0), (150.0, 700.0), (300.0, 900.0), (0.0, 900.0)]
    ring = F.array(F.array(*[p(F.lit(x), F.lit(y)) for x, y in concave]))
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("aoi_id"), box.alias("rings")).union(n.where("n_nationkey = 0").select(F.lit(-1).cast("long"), ring))


AOI = """rings as (select n_nationkey as ring, unnest([[n_nationkey * 40.0, n_nationkey * 37.0], [n_nationkey * 40.0 + 30, n_nationkey * 37.0], [n_nationkey * 40.0 + 30, n_nationkey * 37.0 + 90], [n_nationkey * 40.0, n_nationkey * 37.0 + 90]]) as a,
    unnest([[n_nationkey * 40.0 + 30, n_nationkey * 37.0], [n_nationkey * 40.0 + 30, n_nationkey * 37.0 + 90], [n_nationkey * 40.0, n_nationkey * 37.0 + 90], [n_nationkey * 40.0, n_nationkey * 37.0]]) as b from nation
  union all select -1, unnest([[0.0, 600], [300, 600], [150, 700], [300, 900], [0, 900]]), unnest([[300.0, 600], [150, 700], [300, 900], [0, 900], [0, 600]])),
edges as (select ring, a[1]::double as ax, a[2]::double as ay, b[1]::double as bx, b[2]::double as by_ from rings)"""

#: (id) of the rows of pts(id, x, y) that are strictly inside a ring.
INSIDE = """inside as (select distinct id from (select id, ring, count(*) filter ((ay > y) <> (by_ > y) and x < ax + (bx - ax) * (y - ay) / nullif(by_ - ay, 0)) % 2 = 1
    and not bool_or((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) = 0 and x between least(ax, bx) and greatest(ax, bx) and y between least(ay, by_) and greatest(ay, by_)) as ok
  from pts, edges group by id, ring) where ok)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines: line_id, pts (by line number)."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    p = F.struct(n.alias("n"), F.struct(((k * 7 + n * 13) % 1000).cast("double").alias("x"), ((F.col("l_partkey") * 3 + n * 17) % 1000).cast("double").alias("y")).alias("p"))
    return li.groupBy(k.alias("line_id")).agg(F.transform(F.array_sort(F.collect_list(p)), lambda q: q["p"]).alias("pts"))


VERTICES = """vertices as (select line_id, n, x, y, lead(x) over w as x2, lead(y) over w as y2 from (select l_orderkey as line_id, l_linenumber as n, ((l_orderkey * 7 + l_linenumber * 13) % 1000)::double as x,
  ((min(l_partkey) * 3 + l_linenumber * 17) % 1000)::double as y from lineitem group by l_orderkey, l_linenumber) window w as (partition by line_id order by n))"""


def affine_col() -> Column:
    from rastrum.functions.geometry import affine

    return affine(*AFFINE)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Protocol lines: job_id, seq, line."""
    t = F.col("event_type")
    n = F.col("event_id").cast("string")
    kind = F.when(t == "error", F.lit("error")).when(t == "purchase", "result").when(t == "signup", "describe").when(t == "view", "progress").otherwise("log")
    body = F.concat(F.lit('{"type": "'), kind, F.lit('", "value": '), (F.col("event_id") % 101).cast("string"), F.lit(', "text": "t'), n, F.lit('", "message": "m'), n, F.lit('", "data": "d'), n, F.lit('"}'))
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("chatter "), n)).when(F.col("event_id") % 13 == 0, F.lit("@@MSG@@ {broken")).when(F.col("event_id") % 97 == 0, F.lit('@@MSG@@ {"type": "canceled"}')).otherwise(F.concat(F.lit("@@MSG@@ "), body))
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line"))


MESSAGES = """messages as (select user_id as job_id, event_id as seq, case when event_id % 11 = 0 then 'tail' when event_id % 13 = 0 then 'bad' else 'message' end as kind,
  case when event_id % 11 = 0 or event_id % 13 = 0 then null when event_id % 97 = 0 then 'canceled' else case event_type when 'error' then 'error' when 'purchase' then 'result' when 'signup' then 'describe' when 'view' then 'progress' else 'log' end end as type,
  'chatter ' || event_id as chatter from events)"""
