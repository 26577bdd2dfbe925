"""Masks as packed blocks: a row for each block of pixels (block_row, block_col, bits), made where the cells are.

A task packs its cells before they are dealt, so that what is shuffled follows the lines of a mask and not its pixels.
Kernels see one block with a border of its neighbours. With raster_id, which leads the columns, rasters are never mixed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rastrum.operators.graph import connected_components, least_reachable
from rastrum.operators.mask import ID_SHIFT, RASTER_SHIFT
from rastrum.operators.rank import ranked
from rastrum.operators.spatial import raster_of
from rastrum.session import by_shuffle, checkpoint, partitions_of

PACKED_AT_ONCE = 1 << 19  # cells that a task packs at once, some 50 MB


def with_raster(df: DataFrame, schema: str) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in raster_of(df)) + schema


def place_of(df: DataFrame) -> list[str]:
    """The columns that tell a block."""
    return [*raster_of(df), "block_row", "block_col"]


def dealt(df: DataFrame) -> DataFrame:
    """Blocks dealt by their place to as many tasks as the session asks for; being small in bytes, they would go to a few."""
    return df.repartition(partitions_of(df.sparkSession), *place_of(df))


def squeezed(m: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(m.astype(bool)).tobytes(), 1)


def opened(raw: bytes, block: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), count=block * block).reshape(block, block)


def _numbers(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, kind).tobytes(), 1)


def _values(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _from_zero(x: np.ndarray) -> np.ndarray:
    """Numbers in the same order, below twice PACKED_AT_ONCE."""
    low = int(x.min())
    return x.astype(np.int64) - low if int(x.max()) - low < 2 * PACKED_AT_ONCE else np.unique(x, return_inverse=True)[1].astype(np.int64)


def _packing(of: list[str], block: int, weighted: bool):
    """Cells of a task, so many at a time, as rows of a block and the places of its cells; weighted: with sums and counts of p."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        row, col = (t.column(c).to_numpy() for c in ("row", "col"))
        code = t.column(of[0]).combine_chunks().dictionary_encode().indices.to_numpy() if of else np.zeros(len(row), np.int64)
        home = _from_zero((code.astype(np.int64) << 42) + (_from_zero(row // block) << 21) + _from_zero(col // block))
        cell = home * (block * block) + (row % block).astype(np.int64) * block + col % block
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))  # of each different cell
        cut = np.flatnonzero(np.diff(home[order][first], prepend=-1))  # of each block among these
        at = order[first[cut]]
        spot = (cell[first] % (block * block)).astype(np.int64)
        ends = [*cut[1:].tolist(), len(first)]
        names, columns = [*of, "block_row", "block_col", "cells"], [t.column(c).combine_chunks().take(pa.array(at)) for c in of]
        columns += [pa.array((v[at] // block).astype(np.int32)) for v in (row, col)]
        parts = lambda v, kind: pa.array([_numbers(v[a:b], kind) for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary())
        columns.append(pa.array([_numbers(np.diff(spot[a:b], prepend=0), "<u4") for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary()))
        if weighted:
            p = t.column("p").combine_chunks()
            there = p.is_valid().to_numpy(zero_copy_only=False)
            p = np.where(there, p.fill_null(0.0).to_numpy(), 0.0)[order]
            columns += [parts(np.add.reduceat(there[order].astype(np.int64), first), "<u4"), parts(np.add.reduceat(p, first), "<f8")]
            names += ["counts", "sums"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for s in range(0, b.num_rows, PACKED_AT_ONCE):
                held.append(b.slice(s, PACKED_AT_ONCE))
                n += held[-1].num_rows
                if n >= PACKED_AT_ONCE:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _row(key: tuple, names: list[str], **made) -> pa.Table:
    """One row of a block: its place and what was made of it."""
    return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *made.values()], [*names, *made])


def _bits(m: np.ndarray) -> pa.Array:
    return pa.array([squeezed(m)], pa.binary())


def pack(cells: DataFrame, block: int) -> DataFrame:
    """(block_row, block_col, bits) of a mask; repeated cells count once, rows and columns are not null."""
    of, at = raster_of(cells), place_of(cells)
    named = cells.select(*of, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        m = np.zeros(block * block, np.uint8)
        for raw in table.column("cells").to_pylist():
            m[np.cumsum(_values(raw, "<u4"), dtype=np.int64)] = 1
        return _row(key, at, bits=_bits(m))

    parts = named.mapInArrow(_packing(of, block, False), with_raster(cells, "block_row int, block_col int, cells binary"))
    return dealt(parts).groupBy(*at).applyInArrow(merged, with_raster(cells, "block_row int, block_col int, bits binary"))


def unpack(blocks: DataFrame, block: int) -> DataFrame:
    """(row, col) of the set pixels of packed blocks."""
    of = raster_of(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (row, col, bits) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block_row", "block_col", "bits")), strict=True)):
                r, c = np.nonzero(opened(bits, block))
                where = [pa.array([b.column(o)[i].as_py()] * len(r), b.column(o).type) for o in of]
                yield pa.RecordBatch.from_arrays([*where, pa.array((r + row * block).astype(np.int32)), pa.array((c + col * block).astype(np.int32))], [*of, "row", "col"])

    return blocks.select(*of, "block_row", "block_col", "bits").mapInArrow(run, with_raster(blocks, "row int, col int"))


def sent_around(blocks: DataFrame, names: list[str], reach: int = 1) -> DataFrame:
    """Each block at its own place and at those up to reach blocks away, where it stands at (dr, dc)."""
    of, near = raster_of(blocks), range(-reach, reach + 1)
    around = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in near for c in near]))
    return blocks.withColumn("o", around).select(*of, (F.col("block_row") - F.col("o.dr")).alias("block_row"), (F.col("block_col") - F.col("o.dc")).alias("block_col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), *names)


def framed(table: pa.Table, names: list[str], block: int, halo: int) -> list[np.ndarray] | None:
    """Arrays of a block with a border of halo pixels, one for each column of bits; None where the block itself has no row."""
    whole = [np.zeros((block + 2 * halo,) * 2, np.uint8) for _ in names]
    own = False
    span = lambda d: (a := max(0, -halo - d * block), min(block, block + halo - d * block), halo + d * block + a)
    for dr, dc, *raw in zip(*(table.column(c).to_pylist() for c in ("dr", "dc", *names)), strict=True):
        own = own or dr == dc == 0
        (a, b, x), (c, d, y) = span(dr), span(dc)
        if b > a and d > c:
            for m, bits in zip(whole, raw, strict=True):
                m[x : x + b - a, y : y + d - c] = opened(bits, block)[a:b, c:d]
    return whole if own else None


def _window(m: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Whether any pixel is set among those from k // 2 before to k - 1 - k // 2 behind."""
    lo, hi = k // 2, k - 1 - k // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (lo + 1, hi)
    total = np.cumsum(np.pad(m, pad), axis=axis, dtype=np.int32)
    n = m.shape[axis]
    pick = (lambda s: total[s : s + n]) if axis == 0 else (lambda s: total[:, s : s + n])
    return pick(k) > pick(0)


def _extremum(v: np.ndarray, known: np.ndarray, present: np.ndarray, k: int, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Erosion or dilation by rows and then by columns of the pixels that are present; a null counts for nothing and gets its window's value."""
    whole = bool((known == present).all())
    for axis in (1, 0):
        hit = _window(known & (v if largest else ~v), k, axis)
        v = hit if largest else ~hit
        known = present if whole else present & _window(known, k, axis)
    return v, known


def _runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end, root) of the runs of set pixels of a block's rows; root is the first run of the component over eight neighbours."""
    d = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(d == 1)
    end = np.nonzero(d == -1)[1]
    wide = m.shape[1] + 2
    low = np.searchsorted(row * wide + end, (row + 1) * wide + begin)
    n = np.maximum(np.searchsorted(row * wide + begin, (row + 1) * wide + end, "right") - low, 0)
    u = np.repeat(np.arange(len(row)), n)
    v = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    if len(u):
        nodes, least = least_reachable(u, v)
        root[nodes] = least
    return row, begin, end, root


def _painted(shape: tuple[int, int], row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.zeros((shape[0], shape[1] + 1), np.int8)
    step[row, begin] += 1
    step[row, end] -= 1
    return np.cumsum(step, axis=1, dtype=np.int8)[:, :-1]


EDGES = "array<struct<id:bigint,root:bigint,n:bigint>>"
EDGE = pa.list_(pa.struct([("id", pa.int64()), ("root", pa.int64()), ("n", pa.int64())]))


def _edges(m: np.ndarray, top: int, left: int, min_size: int) -> tuple[np.ndarray, list]:
    """The block without components below min_size that touch no border of it; and of each set border pixel id, its component and that one's pixels."""
    row, begin, end, root = _runs(m)
    size = np.bincount(root, end - begin, len(row)).astype(np.int64)
    side = m.shape[0]
    outer = np.zeros(len(row), bool)
    outer[root[(row == 0) | (row == side - 1) | (begin == 0) | (end == side)]] = True
    kept = (outer | (size >= min_size))[root]
    out = _painted(m.shape, row[kept], begin[kept], end[kept]) if not kept.all() else m
    ring = np.zeros(m.shape, bool)
    ring[0] = ring[-1] = ring[:, 0] = ring[:, -1] = True
    r, c = np.nonzero(ring & (m > 0))
    of = root[np.searchsorted(row * (side + 2) + begin, r * (side + 2) + c, "right") - 1]
    ids = lambda y, x: (y.astype(np.int64) + top << ID_SHIFT) + x + left
    return out, [{"id": i, "root": q, "n": n} for i, q, n in zip(ids(r, c).tolist(), ids(row[of], begin[of]).tolist(), size[of].tolist(), strict=True)]


def cleaned(predictions: DataFrame, threshold: float, open_size: int, close_iterations: int, min_size: int, block: int) -> DataFrame:
    """Packed blocks of the mean of the predictions above the threshold, opened, closed, without components below min_size."""
    if open_size < 1 or close_iterations < 0:
        raise ValueError("an opening is of one pixel or more, a closing of no fewer than no iterations")
    of, at = raster_of(predictions), place_of(predictions)
    halo = 2 * (open_size // 2) + 2 * close_iterations
    layers = ["bits", "known", "present"]

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        total, count, present = np.zeros(block * block), np.zeros(block * block, np.int64), np.zeros(block * block, bool)
        for cells, counts, sums in zip(*(table.column(c).to_pylist() for c in ("cells", "counts", "sums")), strict=True):
            spot = np.cumsum(_values(cells, "<u4"), dtype=np.int64)
            present[spot] = True
            count[spot] += _values(counts, "<u4")
            total[spot] += _values(sums, "<f8")
        p = total / np.maximum(count, 1)
        known = count > 0
        return _row(key, at, bits=_bits(known & ((p > threshold) | np.isnan(p))), known=_bits(known), present=_bits(present))  # as in SQL, NaN is above all

    def morphed(key: tuple, table: pa.Table) -> pa.Table:
        whole = framed(table, layers, block, halo)
        if whole is None:
            return pa.table([pa.array([], k.type) for k in key] + [pa.array([], pa.binary()), pa.array([], EDGE)], [*at, "bits", "edges"])
        v, known, present = (m.astype(bool) for m in whole)
        for k, largest in ((open_size, False), (open_size, True), (2 * close_iterations + 1, True), (2 * close_iterations + 1, False)):
            v, known = _extremum(v, known, present, k, largest)
        m = (v & known)[halo : halo + block, halo : halo + block].astype(np.uint8)
        edges = []
        if min_size > 0:
            m, edges = _edges(m, key[-2].as_py() * block, key[-1].as_py() * block, min_size)
        return _row(key, at, bits=_bits(m), edges=pa.array([edges], EDGE))

    named = predictions.select(*of, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("p").cast("double").alias("p"))
    parts = named.mapInArrow(_packing(of, block, True), with_raster(predictions, "block_row int, block_col int, cells binary, counts binary, sums binary"))
    means = dealt(parts).groupBy(*at).applyInArrow(mean, with_raster(predictions, "block_row int, block_col int, bits binary, known binary, present binary"))
    sent = dealt(sent_around(means, layers, -(-halo // block)))
    blocks = checkpoint(sent.groupBy(*at).applyInArrow(morphed, with_raster(predictions, f"block_row int, block_col int, bits binary, edges {EDGES}")))
    return blocks.drop("edges") if min_size <= 0 else _without_small(blocks, min_size, block)


def _without_small(blocks: DataFrame, min_size: int, block: int) -> DataFrame:
    """Blocks without the components below min_size that cross borders.

    A component that is large inside one block stays, so that only the smaller ones at borders ask what lies beyond.
    """
    of, at = raster_of(blocks), place_of(blocks)
    low = (1 << ID_SHIFT) - 1
    row, col = (lambda c: F.shiftright(c, ID_SHIFT)), (lambda c: F.col(c).bitwiseAND(F.lit(low)))
    held = blocks
    if of:  # rasters are numbered, as in label()
        held = blocks.join(by_shuffle(ranked(blocks.select(*of).distinct(), *of, name="_raster")), of)
        node: Column = F.shiftleft("_raster", 2 * RASTER_SHIFT) + F.shiftleft(row("root"), RASTER_SHIFT) + col("root")
    else:
        node = F.col("root")
    edge = held.select(*at, *(["_raster"] if of else []), F.inline("edges")).withColumn("node", node)
    edge = checkpoint(edge.select(*at, "id", "root", "n", "node"))
    small = edge.where(F.col("n") < min_size)
    if small.isEmpty():
        return blocks.drop("edges")
    steps = F.explode(F.array(*[F.lit((r << ID_SHIFT) + c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]))
    sent = small.select(*of, F.col("block_row").alias("r0"), F.col("block_col").alias("c0"), "id", steps.alias("step"), F.col("node").alias("src")).withColumn("id", F.col("id") + F.col("step"))
    sent = sent.where((F.floor(row("id") / block) != F.col("r0")) | (F.floor(col("id") / block) != F.col("c0")))
    links = checkpoint(sent.join(by_shuffle(edge.select(*of, "id", F.col("node").alias("dst"), "n")), [*of, "id"]).select("src", "dst", "n").distinct())
    joined = checkpoint(connected_components(links))
    pieces = small.select(*at, "root", "n", "node").distinct()
    sizes = pieces.select("node", "n").union(links.select(F.col("dst").alias("node"), "n")).distinct()
    total = sizes.join(by_shuffle(joined), "node").groupBy("component").agg(F.sum("n").alias("total"))
    known = joined.join(by_shuffle(total), "component").select("node", "total")
    gone = pieces.join(by_shuffle(known), "node", "left").where(F.coalesce("total", "n") < min_size).groupBy(*at).agg(F.collect_list("root").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b.column("bits").to_pylist()
            for i, (top, left, out) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block_row", "block_col", "gone")), strict=True)):
                if out:
                    r, begin, end, root = _runs(opened(bits[i], block))
                    kept = ~np.isin((r[root].astype(np.int64) + top * block << ID_SHIFT) + begin[root] + left * block, out)
                    bits[i] = squeezed(_painted((block, block), r[kept], begin[kept], end[kept]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in at), pa.array(bits, pa.binary())], [*at, "bits"])

    return blocks.select(*at, "bits").join(by_shuffle(gone), at, "left").mapInArrow(run, with_raster(blocks, "block_row int, block_col int, bits binary"))
