"""GeoTIFF as a Spark data source: strips are read by the tasks that need them, and written by many tasks into one file.

Reading, partitions() gives ranges of strips (rows of tiles), so one large file is read by many tasks; small files
share a task. Of a window, given as ranges of rows and columns, strips outside are neither dealt out nor read.
Only the headers of files larger than a partition are read by the driver. Conditions of a query reach the reader
with the option pushdown alone: Spark 4.1 keeps what is pushed into a Python source for all later uses of the same
DataFrame, so a frame read with pushdown must be used with one set of conditions.

Writing, each task packs whole strips and puts them into slots of one new file, at places that follow from the
strip's number alone, so an attempt that runs again writes the same bytes to the same place. The commit writes the
directory of offsets and gives the file its name; until then, and after a failure, there is none of that name. The
slots are as large as a strip can get, the space between is never written (the file is sparse). The folder must be a
file system that the driver and all executors share and that can write at any place.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rastrum.session import partitions_of
from rastrum.sources import geotiff
from rastrum.sources.raster import META, open_at

PARTITION_BYTES = 64 << 20  # stored bytes of the strips of a partition
ROWS_AT_ONCE = 1 << 18  # pixels of a batch
FAR = (1 << 31) - 1
BIG_FROM = 1 << 32


def listed(path: str) -> list[tuple[str, str, int]]:
    """(name, path, size) of a file or of the files in a folder; names that begin with . or _ are not files of the folder."""
    store, at = open_at(path)
    found = store.get_file_info(at)
    if found.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else [f for f in store.get_file_info(arrow_fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._"]
    scheme = path[: path.index("://")] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((f.base_name, scheme + f.path, f.size) for f in files)


@dataclass
class Strips(InputPartition):
    """Files with the range of their strips to read; None for all of a file."""

    files: list[tuple[str, str, tuple[int, int] | None]]


class GeoTiffReader(DataSourceReader):
    def __init__(self, options, bands: int, dtype: str):
        self.path, self.bands, self.dtype = options["path"], bands, dtype
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        ranges = {c: [int(v) if v else None for v in options.get(f"{c}s", ":").split(":")] for c in ("row", "col")}
        self.low, self.high = ({c: d if r[k] is None else r[k] for c, r in ranges.items()} for k, d in ((0, 0), (1, FAR)))  # closed ranges of what is asked for
        self.names: set[str] | None = None
        self.taken = 0  # bytes read, for tests

    def window(self, m: geotiff.Layout) -> tuple[int, int, int, int]:
        """First and last row, first and last column that are asked for, cut by the raster."""
        return max(0, self.low["row"]), min(m.height - 1, self.high["row"]), max(0, self.low["col"]), min(m.width - 1, self.high["col"])

    def partitions(self) -> Sequence[InputPartition]:
        found, held, size = [], [], 0
        for name, path, stored in listed(self.path):
            if self.names is not None and name not in self.names:
                continue
            if stored > self.size:
                store, at = open_at(path)
                with store.open_input_file(at) as file:
                    m = geotiff.read_layout(geotiff.FileBytes(file))
                top, bottom, _, _ = self.window(m)
                sizes, begin, total = m.sizes(), top // m.tile_height, 0
                end = bottom // m.tile_height + 1 if top <= bottom else begin
                for k in range(begin, end):
                    total += int(sizes[k])
                    if total >= self.size or k == end - 1:
                        found.append(Strips([(name, path, (begin, k + 1))]))
                        begin, total = k + 1, 0
                continue
            held.append((name, path, None))
            size += stored
            if size >= self.size:
                found.append(Strips(held))
                held, size = [], 0
        return found + ([Strips(held)] if held else []) or [Strips([])]

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        for name, path, strips in partition.files:
            store, at = open_at(path)
            with store.open_input_file(at) as file:
                data = geotiff.FileBytes(file)
                m = geotiff.read_layout(data)
                top, bottom, left, right = self.window(m)
                first, last = strips or (0, m.down)
                for k in range(max(first, top // m.tile_height), min(last, bottom // m.tile_height + 1)) if top <= bottom and left <= right else ():
                    yield from self.batches(name, data, m, max(top, k * m.tile_height), min(bottom + 1, (k + 1) * m.tile_height), left, right + 1)
                self.taken += data.taken

    def batches(self, name: str, data, m: geotiff.Layout, top: int, end: int, left: int, right: int) -> Iterator[pa.RecordBatch]:
        w = right - left
        a = geotiff.read_window(data, left, top, w, end - top, self.bands, m)
        if len(a) < self.bands:
            a = np.stack([a[0]] * self.bands)
        step = max(1, ROWS_AT_ONCE // w)
        for r in range(0, end - top, step):
            part = a[:, r : r + step].reshape(self.bands, -1)
            n = part.shape[1]
            columns = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [name]).cast(pa.string())]
            columns += [pa.array(np.repeat(np.arange(top + r, top + r + n // w, dtype=np.int32), w)), pa.array(np.tile(np.arange(left, right, dtype=np.int32), n // w))]
            columns += [pa.array(b.astype(self.dtype)) for b in part]
            yield pa.RecordBatch.from_arrays(columns, ["raster_id", "row", "col", *[f"b{i + 1}" for i in range(self.bands)]])


class PushedReader(GeoTiffReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions narrow the window; Spark checks them once more on the rows."""
        for f in filters:
            c = getattr(f, "attribute", ("",))[0]
            if c in self.low:
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low[c] = max(self.low[c], int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high[c] = min(self.high[c], int(f.value) - isinstance(f, LessThan))
                if isinstance(f, In):
                    self.low[c], self.high[c] = max(self.low[c], min(f.value)), min(self.high[c], max(f.value))
            elif c == "raster_id" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            yield f


@dataclass
class Written(WriterCommitMessage):
    strips: list[tuple[int, int, int]]


class GeoTiffWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        target = options["path"]
        target = "/" + target.removeprefix("file:").lstrip("/") if target.startswith("file:/") else target
        if "://" in target:
            raise ValueError("a raster of many tasks needs a file system that can write at any place")
        if os.path.exists(target) and not overwrite:
            raise FileExistsError(target)
        self.target, self.part = target, os.path.join(os.path.dirname(target) or ".", f".{os.path.basename(target)}.{uuid.uuid4().hex}")
        self.width, self.height = int(options["width"]), int(options["height"])
        self.columns = [c for c in columns if c not in ("row", "col", "strip")]
        self.dtype = np.dtype(options.get("dtype", "uint8"))
        self.strip_rows = int(options.get("strip_rows", 64))
        self.affine = tuple(map(float, options.get("affine", "1,0,0,0,-1,0").split(",")))
        self.epsg = int(options["epsg"]) if options.get("epsg") else None
        self.nodata = float(options["nodata"]) if options.get("nodata") else None
        self.compression = {"none": geotiff.NONE, "deflate": geotiff.DEFLATE, "lzw": geotiff.LZW}[options.get("compression", "deflate")]
        self.strips = -(-self.height // self.strip_rows)
        raw = self.width * self.strip_rows * len(self.columns) * self.dtype.itemsize
        self.slot = raw + raw // 2 * (self.compression == geotiff.LZW) + (raw >> 10) + 64  # no strip gets larger
        self.big = self.strips * (self.slot + 16) + (1 << 16) >= BIG_FROM
        self.base = len(self.head({}))
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        with open(self.part, "xb"):
            pass

    def head(self, strips: dict[int, tuple[int, int]]) -> bytes:
        places = [strips.get(k, (0, 0)) for k in range(self.strips)]
        return geotiff.head(self.width, self.height, len(self.columns), self.dtype, self.affine, self.epsg, self.compression, self.nodata, self.strip_rows, [p for p, _ in places], [n for _, n in places], self.big)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        now, held = None, None
        with open(self.part, "r+b") as file:

            def put():
                stored = geotiff.packed(held, self.compression)
                file.seek(self.base + now * self.slot)
                file.write(stored)
                done.append((now, self.base + now * self.slot, len(stored)))

            for batch in iterator:
                row, col = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("row", "col"))
                if len(row) and not (row.min() >= 0 and row.max() < self.height and col.min() >= 0 and col.max() < self.width):
                    raise ValueError("a pixel lies outside the raster")
                strip = row // self.strip_rows
                starts = np.flatnonzero(np.concatenate(([True], strip[1:] != strip[:-1]))) if len(row) else []
                for s, e in zip(starts, [*starts[1:], len(row)], strict=True):
                    k = int(strip[s])
                    if k != now:
                        if now is not None:
                            put()
                        if k in seen:
                            raise ValueError("the rows of a strip must follow each other; deal and sort them by strip")
                        seen.add(k)
                        now, held = k, np.zeros((len(self.columns), min(self.strip_rows, self.height - k * self.strip_rows), self.width), self.dtype)
                    for b, c in enumerate(self.columns):
                        held[b, row[s:e] - k * self.strip_rows, col[s:e]] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[s:e]
            if now is not None:
                put()
            file.flush()
            os.fsync(file.fileno())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        strips: dict[int, tuple[int, int]] = {}
        for m in messages:
            for k, place, n in m.strips if m else ():
                if k in strips:
                    raise ValueError("two tasks wrote the same strip; deal rows by strip")
                strips[k] = (place, n)
        with open(self.part, "r+b") as file:
            file.write(self.head(strips))
            file.flush()
            os.fsync(file.fileno())
        os.replace(self.part, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class GeoTiffSource(DataSource):
    """Format geotiff: (raster_id, row, col, b1, ...) of a file or of all files in a folder.

    Reading, the option bands gives the number of bands (3); where a file has fewer, its first stands for the missing
    ones. Bands are int, or double where the first file holds floats. partition_bytes bounds the strips of a partition;
    rows and cols are closed ranges such as 100:199, either end of which may be left out; pushdown=true also takes
    the conditions of the query (once, see above).
    Writing, rows (row, col, one column for each band) become one file at the path; width and height are needed, dtype,
    affine (six numbers), epsg, nodata, compression (deflate, lzw, none) and strip_rows may be given. Pixels
    without a row are 0. write_raster deals rows as the writer needs them.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _floats(self) -> bool:
        files = listed(self.options["path"])
        if not files:
            return False
        store, at = open_at(files[0][1])
        with store.open_input_file(at) as file:
            return geotiff.read_layout(geotiff.FileBytes(file)).kind.kind == "f"

    def schema(self) -> str:
        kind = "double" if self._floats() else "int"
        return "raster_id string, row int, col int, " + ", ".join(f"b{i + 1} {kind}" for i in range(int(self.options.get("bands", 3))))

    def reader(self, schema) -> GeoTiffReader:
        kind = PushedReader if self.options.get("pushdown") == "true" else GeoTiffReader
        return kind(self.options, len(schema) - 3, "f8" if schema[3].dataType.typeName() == "double" else "i4")

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options, schema.names, overwrite)


class GeoTiffMetaReader(DataSourceReader):
    FILES = 500  # of a partition

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        files = [(name, path, None) for name, path, _ in listed(self.path)]
        return [Strips(files[k : k + self.FILES]) for k in range(0, len(files), self.FILES)] or [Strips([])]

    def read(self, partition: Strips) -> Iterator[tuple]:
        for name, path, _ in partition.files:
            store, at = open_at(path)
            with store.open_input_file(at) as file:
                m = geotiff.read_meta(geotiff.FileBytes(file))
            yield (name, m.crs, *m.affine, m.width, m.height, m.count, m.dtype)


class GeoTiffMetaSource(DataSource):
    """Format geotiff_meta: a row for each file of a folder, of which only the header is read."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_meta"

    def schema(self) -> str:
        return META

    def reader(self, schema) -> GeoTiffMetaReader:
        return GeoTiffMetaReader(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    for source in (GeoTiffSource, GeoTiffMetaSource):
        spark.dataSource.register(source)
    return spark


def read_raster(spark: SparkSession, path: str, bands: int = 3, partition_bytes: int = PARTITION_BYTES, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, pushdown: bool = False) -> DataFrame:
    """The pixels of a file or of the files of a folder, of a window if rows or cols (first and last) are given.

    With pushdown, conditions on raster_id, row and col reach the strips too; such a frame is for one set of conditions.
    """
    reader = _registered(spark).read.format("geotiff").option("bands", bands).option("partition_bytes", partition_bytes)
    for name, ends in (("rows", rows), ("cols", cols)):
        reader = reader.option(name, f"{ends[0]}:{ends[1]}") if ends else reader
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("pushdown", "true")
    return reader.load(path)


def read_raster_meta(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format("geotiff_meta").load(path)


def write_raster(cells: DataFrame, path: str, width: int, height: int, strip_rows: int = 64, mode: str = "overwrite", **options) -> None:
    """Cells (row, col, one column for each band) as one GeoTIFF, strips of which are written by as many tasks as there are partitions.

    Pixels without a row are 0; of rows for the same pixel one counts; a null band is an error; an empty table gives a
    raster of zeros. options are those of the format.
    """
    strip = F.floor(F.col("row") / strip_rows).cast("int").alias("strip")
    parts = max(1, min(partitions_of(cells.sparkSession), -(-height // strip_rows)))
    dealt = cells.select("*", strip).repartitionByRange(parts, "strip").sortWithinPartitions("strip")
    writer = dealt.write.format(_registered(cells.sparkSession) and "geotiff").mode(mode).option("width", width).option("height", height).option("strip_rows", strip_rows)
    for name, value in options.items():
        writer = writer.option(name, ",".join(map(str, value)) if isinstance(value, tuple) else value)
    writer.save(path)
