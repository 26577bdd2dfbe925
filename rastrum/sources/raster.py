"""Rasters as rows: scans of GeoTIFF, NPY and image files, and sinks that encode blocks of cells.

Small files are read whole by Spark's binaryFile source, so any store that Spark reads will do. Of large
rasters only paths are dealt out: executors open them through Arrow's file systems and seek the header and the
strips that a window touches, so no file is shipped and none has to fit in memory. Sinks give (name, content)
rows; write_files puts each as a file where its executor runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from rastrum.sources import geotiff, image

META = "raster_id string, crs string, a double, b double, c double, d double, e double, f double, width int, height int, bands int, dtype string"
BANDS = 3


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(raster_id, content): the base name of each file and its bytes."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("raster_id"), "content")


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(raster_id, path): the base name and the path of each file; nothing of the files is read."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("raster_id"), "path")


def open_at(path: str):
    """The Arrow file system of a path or URI and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def _each(pdf: pd.DataFrame):
    """The rows of a batch with their file's bytes: whole (content), or as slices of the file at path, opened once for its rows in a row."""
    if "content" in pdf:
        for r in pdf.itertuples(index=False):
            yield r, bytes(r.content)
        return
    for path, rows in pdf.groupby("path", sort=False):
        store, at = open_at(path)
        with store.open_input_file(at) as file:
            data = geotiff.FileBytes(file)
            for r in rows.itertuples(index=False):
                yield r, data


def _source(files: DataFrame) -> str:
    return "content" if "content" in files.columns else "path"


def scan_meta(files: DataFrame) -> DataFrame:
    """The header of each GeoTIFF of (raster_id, content) or (raster_id, path); of a path only the header is read."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r, data in _each(pdf):
                m = geotiff.read_meta(data)
                rows.append((r.raster_id, m.crs, *m.affine, m.width, m.height, m.count, m.dtype))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in META.split(", ")])

    return files.select("raster_id", _source(files)).mapInPandas(run, META)


def scan_windows(files: DataFrame, tiles: DataFrame, bands: int = BANDS) -> DataFrame:
    """Pixels of tiles (raster_id, tile_id, x_off, y_off, w, h): raster_id, tile_id, row, col, b1, b2, b3.

    files is (raster_id, path), of which the windows' strips are read, or, for small files, (raster_id,
    content). The first three bands are kept; where there are fewer, the first stands for the missing ones.
    Rows and columns are the raster's. A tile without a file gives nothing.
    """
    schema = "raster_id string, tile_id long, row int, col int, " + ", ".join(f"b{i + 1} int" for i in range(bands))

    def run(frames):
        for pdf in frames:
            for r, data in _each(pdf):
                a = geotiff.read_window(data, r.x_off, r.y_off, r.w, r.h, bands)
                if len(a) < bands:
                    a = np.stack([a[0]] * bands)
                _, h, w = a.shape
                rr, cc = np.mgrid[max(0, r.y_off) : max(0, r.y_off) + h, max(0, r.x_off) : max(0, r.x_off) + w]
                yield pd.DataFrame({"raster_id": r.raster_id, "tile_id": r.tile_id, "row": rr.ravel(), "col": cc.ravel()} | {f"b{i + 1}": a[i].ravel().astype(np.int32) for i in range(bands)})

    return tiles.join(files.select("raster_id", _source(files)), "raster_id").mapInPandas(run, schema)


def scan_npy(files: DataFrame) -> DataFrame:
    """(raster_id, row, col, p) of two-dimensional NPY files."""

    def run(frames):
        for pdf in frames:
            for name, data in zip(pdf["raster_id"], pdf["content"], strict=True):
                a = image.read_npy(bytes(data))
                r, c = np.indices(a.shape)
                yield pd.DataFrame({"raster_id": name, "row": r.ravel(), "col": c.ravel(), "p": a.ravel().astype(float)})

    return files.select("raster_id", "content").mapInPandas(run, "raster_id string, row int, col int, p double")


def image_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(name, image, mask) of the files of both sides with the same base name."""
    return images.select(F.col("raster_id").alias("name"), F.col("content").alias("image")).join(masks.select(F.col("raster_id").alias("name"), F.col("content").alias("mask")), "name")


def encode(cells: DataFrame, group: str, value: str, to_bytes: Callable[[np.ndarray], bytes], dtype: str) -> DataFrame:
    """(name, content): one encoded image for each group of cells (row, col, value), from its smallest row and column on.

    Cells that are missing are 0. A group is a block or chip of bounded size; cut larger rasters first.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"] - pdf["row"].min(), pdf["col"] - pdf["col"].min()
        a = np.zeros((int(r.max()) + 1, int(c.max()) + 1), dtype)
        a[r, c] = pdf[value]
        return pd.DataFrame({"name": [str(key[0])], "content": [to_bytes(a)]})

    return cells.select(group, "row", "col", value).groupBy(group).applyInPandas(run, "name string, content binary")


def as_geotiff(affine: tuple, epsg: int | None = None, nodata: float | None = 0.0) -> Callable[[np.ndarray], bytes]:
    return lambda a: geotiff.write(a, affine, epsg, geotiff.DEFLATE, nodata)


def chip_name(stem, row, col, h: int, w: int) -> F.Column:
    return F.concat(stem, F.lit("_chip_"), F.floor(row / h).cast("string"), F.lit("_"), F.floor(col / w).cast("string"), F.lit(".png"))


def point_chip_name(key) -> F.Column:
    return F.concat(F.lit("clipped_point_"), key.cast("string"), F.lit(".png"))


def write_files(encoded: DataFrame, folder: str) -> None:
    """Each (name, content) row as a file of that name in a folder that all executors share, written by the task that has the row.

    A file appears under its name only when it is whole, so a task that runs again does no harm.
    """

    def run(frames):
        store, at = open_at(folder)
        store.create_dir(at, recursive=True)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                part = f"{at}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(bytes(r.content))
                store.move(part, f"{at}/{r.name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    encoded.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_layers(boxes: DataFrame, points: DataFrame, folder: str) -> None:
    """Both layers of a detection job; they exist even without rows."""
    boxes.write.mode("overwrite").parquet(f"{folder}/boxes")
    points.write.mode("overwrite").parquet(f"{folder}/points")


def write_by_class(features: DataFrame, folder: str, by: str = "category") -> list[str]:
    """One folder for each class that occurs; none without rows. Returns the classes."""
    found = sorted(r[0] for r in features.select(by).distinct().collect())
    if found:
        features.write.mode("overwrite").partitionBy(by).parquet(folder)
    return found


def write_lines(lines: DataFrame, folder: str) -> bool:
    """The line layer, only if there is a line."""
    if lines.isEmpty():
        return False
    lines.write.mode("overwrite").parquet(folder)
    return True
