"""Queries on sources and sinks: rasters, images and layers are encoded from the tables and read back."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from rastrum import scoring, training
from rastrum.plans import derived as D
from rastrum.plans.catalog import query
from rastrum.session import checkpoint
from rastrum.sources import image, raster as R, tiffsource as T, vector


def scratch(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    checkpoint(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def blocks(spark, d):
    """Blocks of 64 x 64 cells of the map, as bytes from 0 to 255: block, row, col, v."""
    return D.prob(spark, d).select(F.floor(F.col("row") / 64).cast("int").alias("block"), "row", "col", F.floor(F.col("p") * 255).cast("int").alias("v"))


BLOCKS = f"{D.PROB}, blocks as (select row // 64 as block, row, col, floor(p * 255)::int as v from prob)"
HEIGHTS = "h as (select block, max(row) % 64 + 1 as h from blocks group by block)"


def _tiffs(spark, d):
    return R.encode(blocks(spark, d), "block", "v", R.as_geotiff(D.AFFINE, 32648), "u1").select(F.col("name").alias("raster_id"), "content")


def _stored(spark, d):
    """The files of the blocks in a shared folder."""
    folder = scratch(spark)
    R.write_files(_tiffs(spark, d).withColumnRenamed("raster_id", "name"), folder)
    return folder


@query(f"with {BLOCKS}, {HEIGHTS} select block::varchar as raster_id, 'EPSG:32648' as crs, 0.05::double as a, 500000.0::double as c, -0.05::double as e, 100000.0::double as f, 64 as width, h::int as height, 1 as bands, 'uint8' as dtype from h")
def scan_raster_meta(spark, d):
    return T.read_raster_meta(spark, _stored(spark, d)).drop("b", "d")


def _map_file(spark, d, cells, **options):
    """The whole map as one file that many tasks write."""
    path = f"{scratch(spark)}/map.tif"
    T.write_raster(cells, path, 64, D.prob(spark, d).agg(F.max("row")).first()[0] + 1, affine=D.AFFINE, epsg=32648, **options)
    return path


@query(f"with {BLOCKS} select block::varchar as raster_id, ((row % 64) // 16 * 16 * 64 + col // 32 * 32)::bigint as tile_id, (row % 64)::int as row, col, v from blocks")
def scan_raster_window(spark, d):
    """Two windows, side by side, of one file of the whole map."""
    path = _map_file(spark, d, blocks(spark, d).select("row", "col", "v"), strip_rows=16)
    block, row = F.floor(F.col("row") / 64).cast("string"), (F.col("row") % 64).cast("int")
    tile = (F.floor(row / 16) * 16 * 64 + F.floor(F.col("col") / 32) * 32).cast("long")
    halves = [T.read_raster(spark, path, 1, 1 << 16, cols=(x, x + 31)) for x in (0, 32)]
    return halves[0].union(halves[1]).select(block.alias("raster_id"), tile.alias("tile_id"), row.alias("row"), "col", F.col("b1").alias("v"))


@query(f"with {BLOCKS} select block::varchar as raster_id, (row % 64)::int as row, col, v as b1, v as b2, v as b3 from blocks")
def scan_raster_band_fallback(spark, d):
    return T.read_raster(spark, _stored(spark, d), 3)


@query(f"with {D.PROB} select (row // 64)::varchar as raster_id, (row % 64)::int as row, col, p from prob")
def scan_npy(spark, d):
    p = D.prob(spark, d).withColumn("block", F.floor(F.col("row") / 64).cast("int"))
    return R.scan_npy(R.encode(p, "block", "p", image.write_npy, "f8").withColumnRenamed("name", "raster_id"))


@query(f"with {D.PROB} select (row // 64)::varchar as name, count(*) as cells, round(sum(p), 4) as total from prob group by 1")
def sink_npy(spark, d):
    p = D.prob(spark, d).withColumn("block", F.floor(F.col("row") / 64).cast("int"))
    files = R.encode(p, "block", "p", image.write_npy, "f8").withColumnRenamed("name", "raster_id")
    return R.scan_npy(files).groupBy(F.col("raster_id").alias("name")).agg(F.count("*").alias("cells"), F.round(F.sum("p"), 4).alias("total"))


def _sink(spark, d, t: float):
    """The mask of the whole map written as one file by many tasks, and read back."""
    cells = blocks(spark, d).where(F.col("v") > t * 255).select("row", "col", F.lit(1).alias("v"))
    path = _map_file(spark, d, cells, nodata=0.0)
    return T.read_raster(spark, path, 1, 1 << 16).where("b1 = 1").select(F.floor(F.col("row") / 64).cast("string").alias("block"), (F.col("row") % 64).cast("int").alias("row"), "col")


@query(f"with {BLOCKS} select block::varchar as block, (row % 64)::int as row, col from blocks where v > 0.7 * 255")
def sink_mask_raster(spark, d):
    return _sink(spark, d, 0.7)


@query(f"with {BLOCKS} select block::varchar as block, (row % 64)::int as row, col from blocks where v > 0.5 * 255")
def sink_hybrid_mask(spark, d):
    return _sink(spark, d, 0.5)


def _png(frames):
    for pdf in frames:
        yield pd.DataFrame({"name": pdf["name"], "total": [int(image.read_png(bytes(c)).sum()) for c in pdf["content"]], "bands": [image.read_png(bytes(c)).shape[0] for c in pdf["content"]]})


@query(f"with {BLOCKS} select 'ortho_chip_' || (row // 16) || '_' || (col // 32) || '.png' as name, sum(v)::bigint as total, 1 as bands from blocks group by row // 16, col // 32")
def sink_chip_png(spark, d):
    chips = blocks(spark, d).withColumn("chip", R.chip_name(F.lit("ortho"), F.col("row"), F.col("col"), 16, 32))
    return R.encode(chips, "chip", "v", image.write_png, "u1").mapInPandas(_png, "name string, total long, bands int")


@query(f"with {BLOCKS} select 'clipped_point_' || block || '.png' as name, sum(v)::bigint as total, 1 as bands from blocks where row % 64 < 20 and col < 20 group by block")
def sink_point_chip(spark, d):
    chips = blocks(spark, d).where("row % 64 < 20 and col < 20").withColumn("chip", R.point_chip_name(F.col("block")))
    return R.encode(chips, "chip", "v", image.write_png, "u1").mapInPandas(_png, "name string, total long, bands int")


@query(f"with {D.DET} select 'boxes' as layer, count(*) as n, round(sum(score), 2) as total from det union all select 'points', count(*), round(sum(score), 2) from det")
def sink_boxes_points(spark, d):
    folder, det = scratch(spark), D.det(spark, d)
    R.write_layers(det.select("id", "x1", "y1", "x2", "y2", "score", "category"), det.select("id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), "score", "category"), folder)
    total = lambda n: spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total")).select(F.lit(n).alias("layer"), "n", "total")
    return total("boxes").union(total("points"))


@query(f"with {D.DET} select category, count(*) as n from det where score > 5 group by category")
def sink_by_class(spark, d):
    folder = scratch(spark)
    R.write_by_class(D.det(spark, d).where("score > 5").select("id", "score", "category"), folder)
    return spark.read.parquet(folder).groupBy("category").agg(F.count("*").alias("n"))


@query(f"with {D.VERTICES} select line_id, count(*) as n from vertices group by line_id having count(*) > 6")
def sink_lines(spark, d):
    folder = scratch(spark)
    found = D.lines(spark, d).where(F.size("pts") > 6)
    return spark.read.parquet(folder).select("line_id", F.size("pts").cast("long").alias("n")) if R.write_lines(found, folder) else found.select("line_id", F.size("pts").cast("long").alias("n"))


@query(f"with {D.POINTS} select id, x, y from points")
def scan_vector(spark, d):
    """Points written as shapefiles by group and scanned."""

    def encode(key, pdf):
        pdf = pdf.sort_values("id")
        shp, _ = vector.write_shp(vector.POINT, list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame({"shp": [shp], "dbf": [vector.write_dbf([("id", "N", 12, 0)], [(int(i),) for i in pdf["id"]])]})

    def decode(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                shapes, (_, rows) = vector.read_shp(bytes(r.shp)), vector.read_dbf(bytes(r.dbf))
                yield pd.DataFrame([(i, *p) for (i,), (_, p) in zip(rows, shapes, strict=True)], columns=["id", "x", "y"])

    return D.points(spark, d).groupBy("grp").applyInPandas(encode, "shp binary, dbf binary").mapInPandas(decode, "id long, x double, y double")


@query("select vec_id::varchar as name, (label % 2 * 255 = 255)::int as v from embeddings where vec_id % 3 > 0 and vec_id % 5 > 0")
def scan_image_pairs(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("raster_id"), "vec_id", F.when(F.col("label") % 2 == 1, 255).otherwise(0).cast("string").cast("binary").alias("content"))
    pairs = R.image_pairs(e.where("vec_id % 3 > 0"), e.where("vec_id % 5 > 0"))
    return pairs.select("name", F.when(F.col("mask").cast("string") == "255", 1).otherwise(0).alias("v"))


@query("select vec_id::varchar as name, count(*) as n from embeddings where vec_id % 3 > 0 and vec_id % 5 > 0 group by 1")
def image_mask_join(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("raster_id"), "vec_id", F.lit(b"").alias("content"))
    return R.image_pairs(e.where("vec_id % 3 > 0"), e.where("vec_id % 5 > 0")).groupBy("name").agg(F.count("*").alias("n"))


def _tile_rows(spark, d):
    """Tiles of 8 x 8 pixels for the scorers."""
    px = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 600).cast("int"))))
    as_bytes = F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    e = D.table(spark, d, "embeddings")
    return e.select(F.lit("r").alias("raster_id"), F.col("vec_id").alias("tile_id"), F.lit(0).alias("x_off"), (F.col("vec_id") * 8).cast("int").alias("y_off"), F.lit(1).alias("bands"), F.lit(8).alias("w"), F.lit(8).alias("h"), as_bytes.alias("pixels"))


PIX = "pix as (select vec_id as tile_id, unnest(range(0, 64))::int as i, greatest(0, least(255, floor(unnest(embedding)::double * 600)::int)) as v from embeddings)"


@query(f"with {PIX} select tile_id, (i % 8)::double as x1, (i // 8)::double as y1, round(v / 255.0, 6)::double as score, (v % 3)::int as category_id from pix where v > 200")
def detect_tile(spark, d):
    found = scoring.detect(scoring.not_empty(_tile_rows(spark, d)), scoring.BrightSpots())
    return found.select("tile_id", "x1", "y1", F.round("score", 6).alias("score"), "category_id")


@query(f"with {PIX} select (tile_id * 8 + i // 8)::int as row, (i % 8)::int as col, round(v / 255.0, 6)::double as p from pix")
def segment_tile(spark, d):
    return scoring.segment(_tile_rows(spark, d), scoring.BrightSpots()).select("row", "col", F.round("p", 6).alias("p"))


def _with_scorer(spark, d, name, scorer):
    return scoring.segment(_tile_rows(spark, d), scorer).groupBy("tile_id").agg(F.round(F.avg("p"), 6).alias("p")).select(F.lit(name).alias("model"), "tile_id", "p")


for _name in ("segment_unet", "segment_unet_pre"):
    query(f"with {PIX} select '{_name}' as model, tile_id, round(avg(1 / (1 + exp(-8 * (v / 255.0 - 0.5)))), 6)::double as p from pix group by tile_id", _name)(lambda s, d, n=_name: _with_scorer(s, d, n, scoring.UNetSegmenter(scoring.bright)))


@query(f"""with {PIX}, m as (select tile_id, i // 32 as y, i % 8 // 4 as x, avg((v / 255.0 - 0.485) / 0.229) as m from pix group by all),
near as (select r, c, greatest(0, least(1, floor((r + 0.5) / 4 - 0.5) + dy))::int as y, greatest(0, least(1, floor((c + 0.5) / 4 - 0.5) + dx))::int as x,
    abs(1 - dy - ((r + 0.5) / 4 - 0.5 - floor((r + 0.5) / 4 - 0.5))) * abs(1 - dx - ((c + 0.5) / 4 - 0.5 - floor((c + 0.5) / 4 - 0.5))) as f
  from (select unnest(range(0, 8)) as r), (select unnest(range(0, 8)) as c), (select unnest([0, 1]) as dy), (select unnest([0, 1]) as dx)),
up as (select tile_id, r, c, sum(f * m) as z from near join m using (y, x) group by all)
select 'segment_segformer' as model, tile_id, round(avg(1 / (1 + exp(-2 * z))), 6)::double as p from up group by tile_id""")
def segment_segformer(spark, d):
    """Normalised bands, coarse logits, bilinear upsampling; the network is a stand-in."""
    return _with_scorer(spark, d, "segment_segformer", scoring.SegFormerSegmenter(scoring.bright_blocks))


@query(f"with {PIX} select tile_id, sum(v * (case when tile_id % 2 = 1 then 7 - i % 8 else i % 8 end))::bigint as moment from pix group by tile_id")
def augment(spark, d):
    """Seeded flips of tiles; here by parity, so that the result can be checked."""
    flipped = scoring.augment(_tile_rows(spark, d), lambda tile_id: (tile_id % 2 == 1, False))
    cells = scoring.segment(flipped, scoring.BrightSpots())
    return cells.groupBy("tile_id").agg(F.sum(F.round(F.col("p") * 255).cast("long") * F.col("col")).alias("moment"))


@query()
def augment_training(spark, d):
    """All steps of training: resized, turned, flipped and normalised, by tile the mean of the pixels."""
    tiles = scoring.augment(_tile_rows(spark, d), scoring.seeded_flips(1), 16, scoring.seeded_turns(1), True)
    return tiles.select("tile_id", "w", "h", (F.octet_length("pixels") / 4).cast("long").alias("values"))


def _training_tiles(spark, d):
    """The tiles with masks of their bright pixels."""
    bright = F.transform("embedding", lambda v: F.when(F.floor(v.cast("double") * 600) > 60, "FF").otherwise("00"))
    masks = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("tile_id"), F.unhex(F.array_join(bright, "")).alias("mask"))
    return _tile_rows(spark, d).join(masks, "tile_id")


@query()
def train(spark, d):
    """The loss of each epoch over all tiles."""
    _, history = training.train(_training_tiles(spark, d), 20, rate=0.2)
    return spark.createDataFrame(history, "epoch int, pixels long, loss double").withColumn("loss", F.round("loss", 6))


@query()
def segment_trained(spark, d):
    """All tiles by the network that they train: pixels and those on which it agrees with the mask."""
    tiles = _training_tiles(spark, d)
    network, _ = training.train(tiles, 20, rate=0.2)
    found = scoring.segment(tiles.drop("mask"), scoring.UNetSegmenter(network))
    bright = tiles.select("tile_id", F.hex("mask").alias("m"))
    place = (F.col("row") % 8) * 8 + F.col("col")
    agree = (F.col("p") > 0.5) == (F.substring("m", 2 * place + 1, F.lit(2)) == "FF")
    return found.join(bright, "tile_id").groupBy("tile_id").agg(F.count("*").alias("pixels"), F.count_if(agree).alias("right"))


@query("select event_id as job_id, json_extract_string(props, '$.k')::int as k from events")
def scan_job_json(spark, d):
    return D.table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.from_json("props", "k int")["k"].alias("k"))

