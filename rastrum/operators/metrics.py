"""Segmentation metrics and parameter searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rastrum.operators.spatial import raster_of
from rastrum.session import by_shuffle


def mask_pairs(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(row, col, p, t): both masks aligned by pixel, 0 where one has none."""
    at = [*raster_of(pred), "row", "col"]
    a, b = pred.select(*at, F.lit(1).alias("p")), truth.select(*at, F.lit(1).alias("t"))
    return a.join(b, at, "full").select(*at, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("t", F.lit(0)).alias("t"))


def iou_of_pairs(pairs: DataFrame) -> DataFrame:
    """Intersection over union of aligned masks; 1 if both are empty."""
    both, any_ = F.count_if((F.col("p") == 1) & (F.col("t") == 1)), F.count_if((F.col("p") == 1) | (F.col("t") == 1))
    return pairs.agg(F.coalesce(both / F.nullif(any_, F.lit(0)), F.lit(1.0)).cast("double").alias("iou"))


def raster_iou(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return iou_of_pairs(mask_pairs(pred, truth))


RUNS = 1 << 18  # runs of cells that are held at once
TILES = 512  # tiles of 64 x 64 cells that are filled at once


def _runs(pu, pv, qu, qv, radius: float, cell: float):
    """Runs (line, first, last) of the cells along u that are covered on each line of cells across v, of segments pq.

    The ends follow from the two discs and the strip between them; where an end is close to a cell's centre, the
    distance of that centre tells, computed as in a loop over all cells.
    """
    first = np.floor((np.minimum(pv, qv) - radius) / cell - 0.5).astype(np.int64)
    n = np.ceil((np.maximum(pv, qv) + radius) / cell - 0.5).astype(np.int64) - first + 1
    ends = np.cumsum(n)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, RUNS):
        i = np.arange(begin, min(begin + RUNS, int(ends[-1])))
        s = np.searchsorted(ends, i, "right")
        k = first[s] + i - (ends[s] - n[s])
        au, av, bu, bv, c = pu[s], pv[s], qu[s], qv[s], (k + 0.5) * cell
        du, dv = bu - au, bv - av
        square = du * du + dv * dv
        lo, hi = np.full(len(k), np.inf), np.full(len(k), -np.inf)
        for eu, ev in ((au, av), (bu, bv)):
            h = radius * radius - (c - ev) ** 2
            w, met = np.sqrt(np.maximum(h, 0)), h >= -1e-6 * radius * radius
            lo, hi = np.where(met, np.minimum(lo, eu - w), lo), np.where(met, np.maximum(hi, eu + w), hi)
        with np.errstate(all="ignore"):
            across = np.where(np.abs(c - av) <= radius, np.inf, -np.inf)
            middle, half = np.where(dv != 0, au + (c - av) * du / dv, au), np.where(dv != 0, radius * np.sqrt(square) / np.abs(dv), across)
            x, y = au - (c - av) * dv / du, au + (square - (c - av) * dv) / du
            beside = ((c - av) * dv >= 0) & ((c - av) * dv <= square)
            left, right = np.where(du != 0, np.minimum(x, y), np.where(beside, -np.inf, np.inf)), np.where(du != 0, np.maximum(x, y), np.where(beside, np.inf, -np.inf))
            left, right = np.maximum(left, middle - half), np.minimum(right, middle + half)
        met = (left <= right) & (square > 0)
        lo, hi = np.where(met, np.minimum(lo, left), lo) / cell - 0.5, np.where(met, np.maximum(hi, right), hi) / cell - 0.5
        some = lo <= hi
        k, au, av, du, dv, square, c, lo, hi = (v[some] for v in (k, au, av, du, dv, square, c, lo, hi))
        at = [np.ceil(lo - 1e-3).astype(np.int64), np.floor(hi + 1e-3).astype(np.int64)]
        for end, exact, step in ((0, lo, 1), (1, hi, -1)):
            todo = np.flatnonzero(np.abs(exact - np.round(exact)) < 2e-3)
            while len(todo := todo[at[0][todo] <= at[1][todo]]):
                u, v = (at[end][todo] + 0.5) * cell, c[todo]
                t = ((u - au[todo]) * du[todo] + (v - av[todo]) * dv[todo]) / np.where(square[todo] == 0, 1.0, square[todo])
                t = np.clip(t, 0.0, 1.0)
                todo = todo[(u - (au[todo] + t * du[todo])) ** 2 + (v - (av[todo] + t * dv[todo])) ** 2 > radius * radius]
                at[end][todo] += step
        some = at[0] <= at[1]
        yield k[some], at[0][some], at[1][some]


def _words(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, upright: bool):
    """(row, word, bits) of runs of cells from lo to hi in rows k, or columns if upright: 64 cells of a row in a word."""
    n = (hi >> 6) - (lo >> 6) + 1
    run = np.repeat(np.arange(len(k)), n)
    along = (lo >> 6)[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    begin, end = np.maximum(lo[run] - along * 64, 0), np.minimum(hi[run] - along * 64, 63) + 1
    line, tile = k[run] & 63, ((k[run] >> 6) << 32) + (along + (1 << 31))
    tiles, of = np.unique(tile, return_inverse=True)
    order = np.argsort(of, kind="stable")
    line, begin, end, of = (v[order] for v in (line, begin, end, of))
    for t in range(0, len(tiles), TILES):
        m = min(TILES, len(tiles) - t)
        part = slice(*np.searchsorted(of, (t, t + m)))
        base = ((of[part] - t) * 64 + line[part]) * 65
        depth = np.bincount(base + begin[part], minlength=m * 64 * 65) - np.bincount(base + end[part], minlength=m * 64 * 65)
        set_ = np.cumsum(depth.reshape(m, 64, 65), axis=2)[:, :, :64] > 0
        bits = np.packbits(set_.transpose(0, 2, 1) if upright else set_, axis=2, bitorder="little").view("<i8")[:, :, 0]
        x, y = tiles[t : t + m] >> 32, (tiles[t : t + m] & 0xFFFFFFFF) - (1 << 31)
        row, col = (y, x) if upright else (x, y)
        i, r = np.nonzero(bits)
        yield row[i] * 64 + r, col[i], bits[i, r]


def buffer_words(lines: DataFrame, radius: float, cell: float = 1.0) -> DataFrame:
    """(row, word, bits): the cells whose centre is radius or less from a line of two points or more, 64 columns in a word.

    A segment is taken by rows or by columns, whichever it spans fewer of, and gives one run of cells for each; tasks
    merge the runs of a batch as bits, so what goes on follows the area covered and not the lines.
    """
    ends = F.transform(F.sequence(F.lit(0), F.size("pts") - 2), lambda i: F.struct(*[F.get("pts", i + k)[v].cast("double").alias(f"{n}{v}") for k, n in ((0, "p"), (1, "q")) for v in "xy"]))
    segments = lines.where(F.size("pts") >= 2).select(F.explode(ends).alias("s")).select("s.*")

    def run(batches):
        for b in batches:
            p = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("px", "py", "qx", "qy")]
            known = np.isfinite(p).all(axis=0)
            px, py, qx, qy = (v[known] for v in p)
            upright = np.abs(qx - px) < np.abs(qy - py)
            for of, ends_ in ((~upright, (px, py, qx, qy)), (upright, (py, px, qy, qx))):
                for runs in _runs(*(v[of] for v in ends_), radius, cell):
                    for row, word, bits in _words(*runs, of is upright):
                        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(word, pa.int32()), pa.array(bits, pa.int64())], ["row", "word", "bits"])

    return segments.mapInArrow(run, "row int, word int, bits long").groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))


def buffer_cells(lines: DataFrame, radius: float, cell: float = 1.0) -> DataFrame:
    """(row, col) of the cells whose centre is radius or less from a line: the rasterised buffer, without a geometry library."""
    each = buffer_words(lines, radius, cell).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return each.where(F.expr("bit_get(bits, i) = 1")).select("row", (F.col("word") * 64 + F.col("i")).alias("col"))


def vector_iou(pred: DataFrame, truth: DataFrame, radius: float = 3.0, cell: float = 1.0) -> DataFrame:
    """IoU of two line layers buffered by radius, on cells of the given side. Lines need two points."""
    a, b = (buffer_words(d, radius, cell).withColumnRenamed("bits", n) for d, n in ((pred, "p"), (truth, "t")))
    both = a.join(by_shuffle(b), ["row", "word"], "full").select(F.coalesce("p", F.lit(0).cast("long")).alias("p"), F.coalesce("t", F.lit(0).cast("long")).alias("t"))
    counts = both.agg(F.sum(F.bit_count(F.col("p").bitwiseAND(F.col("t")))).alias("both"), F.sum(F.bit_count(F.col("p").bitwiseOR(F.col("t")))).alias("any"))
    return counts.select(F.coalesce(F.col("both") / F.nullif(F.col("any"), F.lit(0)), F.lit(1.0)).cast("double").alias("iou"))


def pixel_accuracy(scored: DataFrame) -> DataFrame:
    """Share of pixels whose p above 0.5 agrees with y."""
    return scored.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy"))


def dice_mean(scored: DataFrame) -> DataFrame:
    """Mean over batches of 2 * sum(p * y) / (sum(p + y) + 1e-8), p being 0 or 1; not the Dice of all pixels together."""
    hit = (F.col("p") > 0.5).cast("int")
    each = scored.groupBy("batch").agg((2 * F.sum(hit * F.col("y")) / (F.sum(hit + F.col("y")) + 1e-8)).alias("dice"))
    return each.agg(F.avg("dice").alias("dice"))


def mean_iou(scored: DataFrame, ignore: int = 255) -> DataFrame:
    """(label, iou, mean_iou): IoU by class and its mean over the classes that occur; labels of ignore count nowhere."""
    cells = scored.where(F.col("y") != ignore).groupBy("y", "pred").agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("label"), (F.col("y") == F.col("pred")).cast("int").alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("hit")))).alias("s"), "n", "y", "pred")
    per = sides.groupBy("s.label").agg(F.sum(F.col("s.hit") * F.col("n")).alias("both"), F.sum("n").alias("all"))
    per = per.select("label", (F.col("both") / (F.col("all") - F.col("both"))).alias("iou"))
    return per.withColumn("mean_iou", F.avg("iou").over(Window.partitionBy()))


def parameters(spark: SparkSession, **lists) -> DataFrame:
    """(ordinal, each parameter): all combinations, the last parameter varying fastest."""
    frame = None
    for name, values in lists.items():
        own = spark.range(len(values)).select(F.col("id").alias(f"_{name}"), F.get(F.array(*map(F.lit, values)), F.col("id").cast("int")).alias(name))
        frame = own if frame is None else frame.crossJoin(own)
    order = F.lit(0).cast("long")
    for name, values in lists.items():
        order = order * len(values) + F.col(f"_{name}")
    return frame.select(order.alias("ordinal"), *lists)


def best_parameters(scored: DataFrame, score: str = "score") -> DataFrame:
    """The first combination with the highest score."""
    return scored.orderBy(F.desc(score), "ordinal").limit(1)

