"""Queries on jobs: paths, privacy, manifests, integrity, the worker protocol."""

from pyspark.sql import functions as F

from rastrum.functions import scalar as S
from rastrum.operators import jobs as J
from rastrum.plans import derived as D
from rastrum.plans.catalog import query
from rastrum.streaming import protocol as P


@query(f"with {D.MESSAGES} select kind, count(*) as n from messages group by kind")
def stream_parse(spark, d):
    return P.parse(D.messages(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


FOLD = f"""{D.MESSAGES}, folded as (select job_id, arg_max(seq % 101, seq) filter (type = 'progress')::double as progress, 't' || max(seq) filter (type = 'describe') as description, count(*) filter (type = 'log') as logs,
  'd' || max(seq) filter (type = 'result') as result, 'm' || max(seq) filter (type = 'error') as error, count(*) filter (type = 'error') > 0 as failed, count(*) filter (type = 'canceled') > 0 as canceled, count(*) filter (type = 'result') > 0 as done from messages where kind <> 'bad' group by job_id)"""


@query(f"with {FOLD} select * from folded")
def stream_fold(spark, d):
    return P.fold(P.parse(D.messages(spark, d)))


@query(f"with {FOLD} select job_id, case when canceled then 'canceled' when failed then 'error' when not done then 'no_result' else 'result' end as status from folded")
def stream_terminal(spark, d):
    return P.terminal(P.fold(P.parse(D.messages(spark, d)))).select("job_id", "status")


@query(f"with {D.MESSAGES} select job_id, seq, chatter as line from messages where kind = 'tail' qualify row_number() over (partition by job_id order by seq desc) <= 25")
def tail_lines(spark, d):
    return P.tail(P.parse(D.messages(spark, d)))


PULL = "(case when event_id % 3 = 0 then ': Download complete' when event_id % 3 = 1 then ': Pull complete' else ': Waiting' end)"


@query(f"""select job_id, greatest(1, least(99, trunc(d * 50 / 40.0 + p * 50 / 40.0)))::int as percent from (select user_id as job_id,
  count(distinct event_id % 50) filter (event_id % 3 = 0) as d, count(distinct event_id % 50) filter (event_id % 3 = 1) as p from events group by user_id)""")
def pull_progress(spark, d):
    i = F.col("event_id")
    status = F.when(i % 3 == 0, ": Download complete").when(i % 3 == 1, ": Pull complete").otherwise(": Waiting")
    lines = D.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.concat(F.lit("layer"), (i % 50).cast("string"), status).alias("line"))
    return P.pull_progress(lines, 40)


FILES = """files as (select page_id // 10 as job_id, page_id as ordinal, regexp_replace(url, '[?#].*$', '') as path, page_id % 4 = 0 as writable from pages), folders as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from files),
firsts as (select *, min(ordinal) over (partition by job_id, folder) as first, bool_or(writable) over (partition by job_id, folder) as rw from folders),
mounts as (select *, '/mnt/' || (dense_rank() over (partition by job_id order by first) - 1) as mount, regexp_extract(path, '([^/]*)$', 1) as base from firsts)"""


def _files(spark, d):
    p = D.table(spark, d, "pages")
    return p.select(F.floor(F.col("page_id") / 10).alias("job_id"), F.col("page_id").alias("ordinal"), F.regexp_replace("url", "[?#].*$", "").alias("path"), (F.col("page_id") % 4 == 0).alias("writable"))


@query(f"with {FILES} select job_id, ordinal, mount, mount || '/' || base as container_path from mounts")
def path_map(spark, d):
    return J.mount_paths(_files(spark, d)).select("job_id", "ordinal", "mount", "container_path")


@query(f"with {FILES} select distinct job_id, mount, case when rw then 'rw' else 'ro' end as mode from mounts")
def path_mode(spark, d):
    return J.mount_paths(_files(spark, d)).select("job_id", "mount", "mode").distinct()


@query(f"with {FILES} select job_id, ordinal, path as host_path from mounts union all select 0, -1, '/elsewhere/x.tif'")
def path_reverse(spark, d):
    m = J.mount_paths(_files(spark, d))
    asked = m.select("job_id", "ordinal", "container_path").union(spark.range(1).select(F.lit(0).cast("long"), F.lit(-1).cast("long"), F.lit("/elsewhere/x.tif")))
    return J.host_paths(asked, m).select("job_id", "ordinal", "host_path")


@query("select page_id, regexp_extract(url, '([^/\\\\]*)$', 1) as raster_path, regexp_extract(url, '([^/\\\\]*)$', 1) as out_dir, url as note from pages")
def privacy(spark, d):
    params = F.create_map(F.lit("raster_path"), F.col("url"), F.lit("out_Dir"), F.col("url"), F.lit("note"), F.col("url"))
    p = J.with_private_params(D.table(spark, d, "pages").select("page_id", params.alias("params")))
    return p.select("page_id", F.col("params")["raster_path"].alias("raster_path"), F.col("params")["out_Dir"].alias("out_dir"), F.col("params")["note"].alias("note"))


@query("select page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem, lower(trim(url)) as low, starts_with(url, 'https') as secure from pages")
def scalar_string(spark, d):
    p = D.table(spark, d, "pages")
    return p.select("page_id", S.stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"), F.lower(F.trim("url")).alias("low"), F.startswith(F.col("url"), F.lit("https")).alias("secure"))


@query("select doc_id::varchar as name, sha256(text) as sha256 from documents")
def file_sha256(spark, d):
    docs = D.table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("select doc_id::varchar as name, case when doc_id % 3 = 0 then doc_id % 2 = 0 else length(text) > 0 end as ok from documents")
def integrity_check(spark, d):
    """Every third file is listed, half of these with a wrong hash."""
    docs = D.table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    listed = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise("0").alias("sha256"))
    return J.integrity(files, listed).select("name", "ok")


def _jobs(spark, d):
    e = D.table(spark, d, "events")
    params = F.create_map(F.lit("raster_path"), F.concat(F.lit("/data/in/"), F.col("event_id").cast("string"), F.lit(".tif")), F.lit("tile_size"), F.lit("640"))
    jobs = e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), F.lit("cpu").alias("device"), params.alias("params"), F.lit("EPSG:32648").alias("crs"), F.lit(100).alias("width"), F.lit(80).alias("height"), (F.col("event_id") % 90).alias("total_detections"), F.col("value").alias("elapsed_seconds"), F.col("ts").cast("string").alias("timestamp_utc"))
    layers = e.where("event_id % 3 = 0").select(F.col("event_id").alias("job_id"), F.lit("boxes").alias("name"), F.lit("bbox").alias("type"), F.concat(F.lit("/data/out/"), F.col("event_id").cast("string"), F.lit(".shp")).alias("path"), F.col("props").alias("content"))
    return J.manifests(jobs, layers)


@query("""select event_id as job_id, event_type as job_type, round(value, 2) as elapsed, event_id || '.tif' as raster, case when event_id % 3 = 0 then event_id || '.shp' end as filename, case when event_id % 3 = 0 then sha256(props) end as sha256, event_id % 90 as total_detections, (event_id % 3 = 0)::int as layers from events""")
def manifest(spark, d):
    first = F.get("outputs", F.lit(0))
    return _jobs(spark, d).select("job_id", "job_type", F.col("elapsed_seconds").alias("elapsed"), F.col("parameters")["raster_path"].alias("raster"), first["filename"].alias("filename"), first["sha256"].alias("sha256"), F.col("summary.total_detections").alias("total_detections"), F.col("summary.output_layers_count").alias("layers"))


@query("select sum((event_id % 3 = 0)::int)::bigint as layers, sum(event_id % 90)::bigint as detections from events")
def feature_counts(spark, d):
    return _jobs(spark, d).agg(F.sum("summary.output_layers_count").alias("layers"), F.sum("summary.total_detections").alias("detections"))


@query("select event_id as job_id, '640' as tile_size, 'EPSG:32648' as crs from events")
def sink_manifest(spark, d):
    """Manifests as JSON texts, parsed again."""
    text = _jobs(spark, d).select("job_id", F.to_json(F.struct("job_type", "input_metadata", "parameters", "outputs", "summary")).alias("t"))
    back = F.from_json("t", "input_metadata struct<crs:string,width:int,height:int>, parameters map<string,string>")
    return text.select("job_id", back["parameters"]["tile_size"].alias("tile_size"), back["input_metadata"]["crs"].alias("crs"))


@query("""select event_id, case when event_id % 2 = 0 then case when k <= 5 then 'start' when k <= 82 then 'tiles' when k <= 94 then 'merge' when k <= 95 then 'save' when k <= 100 then 'done' end
  else case when k <= 5 then 'start' when k <= 55 then 'tiles' when k <= 92 then 'clean' when k <= 94 then 'skeleton' when k <= 99 then 'vectors' when k <= 100 then 'done' end end as step from (select event_id, event_id % 103 as k from events)""")
def progress_bands(spark, d):
    """The step of each of the table's jobs, half of them detections, from how far it has come."""
    i = F.col("event_id")
    return D.table(spark, d, "events").select("event_id", J.step_under_way(F.when(i % 2 == 0, "detect").otherwise("road"), i % 103).alias("step"))


ASKED = "case event_type when 'view' then ' GPU' when 'click' then 'cuda:1' when 'error' then '' when 'signup' then null else 'cpu' end"


@query(f"select event_id, case when a is null or trim(a) = '' then 'cpu' when lower(trim(a)) = 'gpu' then 'cuda:0' else lower(trim(a)) end as device from (select event_id, {ASKED} as a from events)")
def device_resolve(spark, d):
    return D.table(spark, d, "events").select("event_id", S.device(F.expr(ASKED), cuda=True).alias("device"))


@query("select event_id, coalesce(case event_type when 'view' then 1 when 'error' then 2 end, -1)::int as value from events")
def scalar_map(spark, d):
    m = F.create_map(F.lit("view"), F.lit(1), F.lit("error"), F.lit(2))
    return D.table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit(-1)).alias("value"))


@query("select vec_id, embedding[1] as first, len(embedding[1:3]) as n, list_sum(embedding[1:3])::double as s from embeddings")
def scalar_array(spark, d):
    e = F.slice("embedding", 1, 3)
    return D.table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("first"), F.size(e).cast("long").alias("n"), F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double")).alias("s"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def scalar_date(spark, d):
    return D.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def _flags(n: int):
    """Readiness of a request, by the bits of its number."""
    return [F.shiftright("event_id", k).bitwiseAND(F.lit(1)) == 1 for k in range(n)]


BITS = ", ".join(f"(event_id >> {k}) & 1 = 1 as b{k}" for k in range(5))


@query(f"""select event_id, case when asked in ('venv', 'local') then asked when asked = 'docker' and b0 then asked when asked = 'auto' then case when b0 then 'docker' when b1 then 'venv' when b2 then 'local' end end as backend
from (select event_id, case event_type when 'view' then 'auto' when 'click' then 'docker' when 'error' then 'venv' when 'signup' then 'local' else 'auto' end as asked, {BITS} from events)""")
def backend_choice(spark, d):
    """Where each request of the table runs, null where nothing is ready for it."""
    asked = F.expr("case event_type when 'view' then 'auto' when 'click' then 'docker' when 'error' then 'venv' when 'signup' then 'local' else 'auto' end")
    return D.table(spark, d, "events").select("event_id", J.backend(asked, *_flags(3)).alias("backend"))


@query(f"select event_id, case when b0 then 'current' when b1 then 'older' when b2 then 'current, pulled' when b3 then 'older, pulled' when b4 then 'current, built' end as image from (select event_id, {BITS} from events)")
def image_resolve(spark, d):
    return D.table(spark, d, "events").select("event_id", J.image(*_flags(5)).alias("image"))
