"""Line networks from masks: thinning, tracing, gap repair. Kernels see one block or pair at a time.

Tables with raster_id hold several rasters, which are never mixed; raster_id leads the columns of the results.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rastrum.functions.geometry import line_length, to_world_center
from rastrum.functions.scalar import COST_SCALE
from rastrum.operators.blocks import cleaned, dealt, framed, pack, place_of, sent_around, squeezed, unpack, with_raster
from rastrum.operators.mask import ID_SHIFT
from rastrum.operators.spatial import lines_intersecting, radius_pairs, raster_of
from rastrum.operators.tiling import halo_copies
from rastrum.session import by_shuffle, checkpoint

STEPS = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c)


def in_blocks(cells: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], block: int, halo: int) -> DataFrame:
    """Apply a kernel from a mask array to a mask array in blocks with a halo; only the core of a block is kept."""

    of = raster_of(cells)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[-2]) * block - halo, int(key[-1]) * block - halo
        m = np.zeros((block + 2 * halo, block + 2 * halo), np.uint8)
        m[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = 1
        r, c = np.nonzero(kernel(m)[halo : halo + block, halo : halo + block])
        return pd.DataFrame({o: key[0] for o in of} | {"row": r + top + halo, "col": c + left + halo}, columns=[*of, "row", "col"])

    copies = halo_copies(cells.select(*of, "row", "col"), block, halo).select(*of, "row", "col", "block_row", "block_col")
    return copies.groupBy(*of, "block_row", "block_col").applyInPandas(run, with_raster(cells, "row int, col int"))


RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))  # clockwise from the north


def _cleared() -> np.ndarray:
    """For both halves of a round: whether a pixel goes, by the bits of its ring."""
    ring = [np.arange(256) >> i & 1 for i in range(8)]
    n, _, e, _, s, _, w, _ = ring
    count = sum(ring)
    turns = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    edge = (count >= 2) & (count <= 6) & (turns == 1)
    return np.array([edge & (n & e & s == 0) & (e & s & w == 0), edge & (n & e & w == 0) & (n & s & w == 0)])


CLEARED = _cleared()


def thin(m: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Zhang-Suen thinning to lines of one pixel, or so many rounds of it."""
    rows, cols = m.shape
    m = np.pad(m.astype(np.uint8), 1)
    own = m[1:-1, 1:-1]
    while rounds is None or rounds > 0:
        changed = False
        for cleared in CLEARED:
            code = np.zeros(own.shape, np.uint8)
            for i, (r, c) in enumerate(RING):
                code |= m[1 + r : 1 + r + rows, 1 + c : 1 + c + cols] << i
            gone = cleared[code] & (own == 1)
            own[gone] = 0
            changed = changed or bool(gone.any())
        rounds = None if rounds is None else rounds - 1
        if not changed:
            break
    return own


def skeletonize(mask: DataFrame, block: int = 512, halo: int = 64) -> DataFrame:
    """The mask thinned to one pixel, equal to thinning each raster as one image, whatever its thickness.

    The mask is a table of packed blocks. In a pass each block gets a border of halo pixels from its eight neighbours and
    goes through as many rounds of thinning as the border allows (a round looks two pixels far), so all blocks
    have gone through the same rounds of the whole image. Only blocks that changed in the last pass, and their
    neighbours, take part in the next; the passes end when no pixel changes. Repeated cells count once; rows and columns
    are not null and not negative.
    """
    if halo < 2 or halo > block:
        raise ValueError("the halo is from 2 pixels to a block")
    of, rounds = raster_of(mask), halo // 2
    at = [*of, "block_row", "block_col"]

    def thinned(key: tuple, table: pa.Table) -> pa.Table:
        whole = framed(table, ["bits"], block, halo)
        rows = []
        if whole is not None:
            own = whole[0][halo : halo + block, halo : halo + block].copy()
            out = thin(whole[0], rounds)[halo : halo + block, halo : halo + block]
            rows = [(squeezed(out), bool((out != own).any()))]
        columns = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.table([*columns, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.bool_())], [*at, "bits", "changed"])

    blocks = checkpoint(pack(mask, block).withColumn("changed", F.lit(True)))
    while not (open_ := blocks.where("changed")).isEmpty():
        asked = sent_around(open_, []).select(*at).distinct()
        sent = sent_around(blocks, ["bits"]).join(by_shuffle(asked), at, "left_semi")
        done = dealt(sent).groupBy(*at).applyInArrow(thinned, with_raster(mask, "block_row int, block_col int, bits binary, changed boolean"))
        rest = blocks.join(by_shuffle(asked), at, "left_anti").withColumn("changed", F.lit(False))
        blocks = checkpoint(done.unionByName(rest))
    return unpack(blocks, block)


ARC_BLOCK = 1024  # side of the blocks in which chains are followed at once
NO_CELL = np.iinfo(np.int64).min


def _chains(block: int, names: list[str]):
    """In a block with a border of two: the chains of pixels that are no junctions, each from its smaller end.

    An end is open (out0 at the first cell, out1 at the last) where the chain goes on in another block, at that cell; near0 and
    near1 are the junctions beside ends that are not. Rings that lie inside the block start at their smallest cell and have no end.
    """

    def walked(m: np.ndarray, top: int, left: int) -> list[pa.Array] | None:
        wide = m.shape[1]
        inner = m[1:-1, 1:-1]
        count = sum(m[1 + r : m.shape[0] - 1 + r, 1 + c : wide - 1 + c] for r, c in STEPS)
        simple = np.zeros(m.shape, bool)
        simple[1:-1, 1:-1] = (inner > 0) & (count <= 2)
        own = np.zeros(m.shape, bool)
        own[2:-2, 2:-2] = simple[2:-2, 2:-2]
        flat = np.flatnonzero(own)
        n = len(flat)
        if not n:
            return None
        name = lambda q: (q // wide + top - 2 << ID_SHIFT) + q % wide + left - 2
        index = np.full(m.size, -1)
        index[flat] = np.arange(n)
        link, out = np.full((n, 2), -1), np.full((n, 2), NO_CELL)  # neighbours here, cells of other blocks
        links, outs, on = np.zeros(n, np.int64), np.zeros(n, np.int64), simple.ravel()
        for r, c in STEPS:
            q = flat + r * wide + c
            here, there = np.flatnonzero(index[q] >= 0), np.flatnonzero(on[q] & (index[q] < 0))
            link[here, links[here]], out[there, outs[there]] = index[q[here]], name(q[there])
            links[here] += 1
            outs[there] += 1
        # the arc 2 * i + s goes from i by its link s; it doubles its reach until it comes to an end
        i = np.repeat(np.arange(n), 2)
        to = link.ravel()
        last = to < 0
        to = np.where(last, np.arange(2 * n), 2 * to + (link[to, 0] == i))
        steps = (~last).astype(np.int64)
        for _ in range(n.bit_length() + 1):
            then = to[to]
            if (then == to).all():
                break
            steps, to = steps + steps[to], then
        (e0, e1), (d0, d1) = (to // 2).reshape(n, 2).T, steps.reshape(n, 2).T
        head, rank, ring = np.minimum(e0, e1), np.where(e0 <= e1, d0, d1), ~last[to[::2]]
        seen = ~ring
        for start in np.flatnonzero(ring).tolist():
            before, here, k = -1, start, 0
            while not seen[here]:
                seen[here], head[here], rank[here] = True, start, k
                a, b = link[here]
                before, here, k = here, int(min(a, b) if before < 0 else b if a == before else a), k + 1
        order = np.lexsort((rank, head))
        cut = np.flatnonzero(np.diff(head[order], prepend=-1))
        ends = np.append(cut[1:], n)
        ids = name(flat)
        a, b = order[cut], order[ends - 1]
        alone = a == b
        ring = ring[a]
        out0, out1 = out[a, 0], np.where(alone, out[a, 1], out[b, 0])

        def junctions(at: np.ndarray, closed: np.ndarray) -> pa.Array:
            q = flat[at][:, None] + np.array([r * wide + c for r, c in STEPS])
            there = (m.ravel()[q] > 0) & ~on[q] & closed[:, None]
            return pa.ListArray.from_arrays(np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32), name(q[there]))

        columns = [ids[a], ids[b], np.minimum.reduceat(ids[order], cut), ends - cut, out0, out1, ring]
        lists = [junctions(a, ~ring & (out0 == NO_CELL)), junctions(b, ~ring & (out1 == NO_CELL)), pa.ListArray.from_arrays(np.append(cut, n).astype(np.int32), ids[order])]
        return [*(pa.array(c, mask=c == NO_CELL) for c in columns), *lists]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = framed(table, ["bits"], block, 2)
        found = None if whole is None else walked(whole[0], key[-2].as_py() * block, key[-1].as_py() * block)
        columns = [pa.array([], t) for t in CHAIN_TYPES] if found is None else found
        return pa.table([*(pa.array([k.as_py()] * len(columns[0]), k.type) for k in key[:-2]), *columns], names)

    return run


CHAINS = "first long, last long, least long, n long, out0 long, out1 long, ring boolean, near0 array<bigint>, near1 array<bigint>, cells array<bigint>"
CHAIN_TYPES = [pa.int64()] * 6 + [pa.bool_()] + [pa.list_(pa.int64())] * 3


def _numbered(chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains that are open at an end as (start, at, total) of their paths, turned that way; and (first, start) of those on rings.

    List ranking: entering a chain at an open end leads on to its other end. These arcs double their reach in each round,
    which takes as many rounds as the logarithm of the chains on the longest path. What never ends is a ring.
    """
    of = raster_of(chains)
    key = [*of, "u", "v"]
    way = lambda a, x, b, y: chains.where(F.col(x).isNotNull()).select(*of, F.col(x).alias("u"), F.col(a).alias("v"), F.col("n").alias("steps"), F.when(F.col(y).isNotNull(), F.col(b)).alias("next_u"), F.col(y).alias("next_v"), F.when(F.col(y).isNull(), F.col(b)).alias("end"), "least")
    reach = checkpoint(way("first", "out0", "last", "out1").unionByName(way("last", "out1", "first", "out0")))
    on = lambda df: df.select(*of, F.col("u").alias("next_u"), F.col("v").alias("next_v"), F.col("steps").alias("more"), F.col("next_u").alias("then_u"), F.col("next_v").alias("then_v"), F.col("end").alias("then_end"), F.col("least").alias("then_least"))
    step = lambda a, b: a.join(by_shuffle(on(b)), [*of, "next_u", "next_v"]).select(*key, (F.col("steps") + F.col("more")).alias("steps"), F.col("then_u").alias("next_u"), F.col("then_v").alias("next_v"), F.col("then_end").alias("end"), F.least("least", "then_least").alias("least"))
    for _ in range(max(1, reach.count()).bit_length() + 1):
        open_ = reach.where("next_u is not null")
        if open_.isEmpty():
            break
        reach = checkpoint(reach.where("next_u is null").unionByName(step(open_, reach)))
    slot = lambda s, a, x: chains.select(*of, "first", F.lit(s).alias("slot"), F.col(a).alias("u"), F.col(x).alias("v"))
    slots = slot(0, "first", "out0").unionByName(slot(1, "last", "out1"))
    beyond = slots.where("v is not null").join(by_shuffle(reach.where("next_u is null").select(*key, "steps", "end")), key).select(*of, "first", "slot", "steps", "end")
    beyond = beyond.unionByName(slots.where("v is null").select(*of, "first", "slot", F.lit(0).cast("long").alias("steps"), F.col("u").alias("end")))
    at = lambda c, s: F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{c}{s}")
    sides = beyond.groupBy(*of, "first").agg(at("steps", 0), at("steps", 1), at("end", 0), at("end", 1)).where("end0 is not null and end1 is not null")
    on_way = F.col("end0") < F.col("end1")
    turn = lambda a, b: F.when(on_way, a).otherwise(b)
    found = chains.join(by_shuffle(sides), [*of, "first"])
    found = found.select(*of, F.least("end0", "end1").alias("start"), turn(F.col("steps0"), F.col("steps1")).alias("at"), (F.col("steps0") + F.col("steps1") + F.col("n")).alias("total"), "ring", turn(F.col("near0"), F.col("near1")).alias("before"), turn(F.col("near1"), F.col("near0")).alias("behind"), "least", turn(F.col("cells"), F.reverse("cells")).alias("cells"))
    round_ = slots.where("slot = 0 and v is not null").select(*of, "first", F.col("v").alias("u"), F.col("u").alias("v")).join(by_shuffle(reach.where("next_u is not null").select(*key, F.col("least").alias("start"))), key).select(*of, "first", "start")
    return found, round_


def _cut(chains: DataFrame, starts: DataFrame) -> DataFrame:
    """Chains of rings as those of paths: each ring is cut between its smallest cell and the larger of that one's neighbours."""
    of = raster_of(chains)
    ringed = checkpoint(chains.join(by_shuffle(starts), [*of, "first"]))
    i = F.array_position("cells", F.col("start")).cast("int")
    beside = ringed.where(i > 0).select(*of, "start", F.greatest(F.when(i > 1, F.get("cells", i - 2)).otherwise(F.col("out0")), F.when(i < F.col("n"), F.get("cells", i)).otherwise(F.col("out1"))).alias("other"))
    held = ringed.join(by_shuffle(beside), [*of, "start"]).withColumns({"i": i, "j": F.array_position("cells", F.col("other")).cast("int")})
    none = F.lit(None).cast("long")
    shut = lambda end, out: F.when(((F.col(end) == F.col("start")) & (F.col(out) == F.col("other"))) | ((F.col(end) == F.col("other")) & (F.col(out) == F.col("start"))), none).otherwise(F.col(out))
    p, n = F.least("i", "j"), F.col("n").cast("int")
    part = lambda cells, out0, out1: F.struct(cells.alias("cells"), out0.alias("out0"), out1.alias("out1"))
    parts = F.when((F.col("i") > 0) & (F.col("j") > 0), F.array(part(F.slice("cells", F.lit(1), p), F.col("out0"), none), part(F.slice("cells", p + 1, n - p), none, F.col("out1"))))
    parts = parts.otherwise(F.array(part(F.col("cells"), shut("first", "out0"), shut("last", "out1"))))
    cells = held.select(*of, "near0", "near1", F.inline(parts))
    first, last = F.element_at("cells", 1), F.element_at("cells", -1)
    return cells.select(*of, first.alias("first"), last.alias("last"), F.array_min("cells").alias("least"), F.size("cells").cast("long").alias("n"), "out0", "out1", F.lit(True).alias("ring"), "near0", "near1", "cells")


def _pieces(skeleton: DataFrame, rings: bool, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Whole paths, and pieces of paths that span blocks: (start, at, total, ring, before, behind, least, cells).

    cells are the ids of a piece in the order of its path, the first of them at place at of total; before and behind are
    the junctions beside the path's ends.
    """
    of = raster_of(skeleton)
    blocks = dealt(sent_around(pack(skeleton, block), ["bits"]))
    names = [*of, *(c.split()[0] for c in CHAINS.split(", "))]
    chains = checkpoint(blocks.groupBy(*place_of(blocks)).applyInArrow(_chains(block, names), with_raster(skeleton, CHAINS)))
    crosses = F.col("out0").isNotNull() | F.col("out1").isNotNull()
    whole = chains.where(~crosses if rings else ~crosses & ~F.col("ring"))
    whole = whole.select(*of, F.col("first").alias("start"), F.lit(0).cast("long").alias("at"), F.col("n").alias("total"), "ring", F.col("near0").alias("before"), F.col("near1").alias("behind"), "least", "cells")
    open_ = chains.where(crosses)
    if open_.isEmpty():
        return whole, None
    pieces, starts = _numbered(open_)
    if rings and not (starts := checkpoint(starts)).isEmpty():
        pieces = pieces.unionByName(_numbered(checkpoint(_cut(open_, starts)))[0])
    return whole, pieces


def traced_pixels(skeleton: DataFrame, rings: bool = False, block: int = ARC_BLOCK) -> DataFrame:
    """(start, rank, id, n): the cells of each path of a skeleton whose junctions are cleared, numbered from its start.

    Cleared of junctions, a skeleton falls into paths and rings. A path starts at the smaller of its ends (by rows, then
    columns); n is its number of cells. With rings, a ring starts at its smallest cell and goes on with the smaller of that
    one's neighbours; without, rings are lost. Chains are followed inside packed blocks, and only those that cross borders are
    linked, so a line of any length is numbered by as many tasks as it spans blocks. Repeated cells count once.
    """
    of = raster_of(skeleton)
    whole, pieces = _pieces(skeleton, rings, block)
    all_ = whole if pieces is None else whole.unionByName(pieces)
    cells = all_.select(*of, "start", "at", "total", "ring", F.posexplode("cells").alias("k", "id"))
    return cells.select(*of, "start", (F.col("at") + F.col("k")).alias("rank"), "id", F.col("total").alias("n"), *(["ring"] if rings else []))


def _lines(skeleton: DataFrame, rings: bool, min_pixels: int, block: int) -> DataFrame:
    """(start, total, ring, before, behind, least, cells) of whole paths of min_pixels or more; only the pieces of those that span blocks are gathered."""
    of = raster_of(skeleton)
    whole, pieces = _pieces(skeleton, rings, block)
    whole = whole.where(F.col("total") >= min_pixels).drop("at")
    if pieces is None:
        return whole
    lines = pieces.where(F.col("total") >= min_pixels).groupBy(*of, "start", "total", "ring").agg(
        F.max(F.when(F.col("at") == 0, F.col("before"))).alias("before"), F.max(F.when(F.col("at") + F.size("cells") == F.col("total"), F.col("behind"))).alias("behind"),
        F.min("least").alias("least"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda c: c["cells"])).alias("cells"),
    )
    return whole.unionByName(lines)


def _points(ids: Column) -> Column:
    """Ids of cells as (row, col)."""
    return F.transform(ids, lambda c: F.struct(F.shiftright(c, ID_SHIFT).cast("int").alias("row"), c.bitwiseAND(F.lit((1 << ID_SHIFT) - 1)).cast("int").alias("col")))


def trace_paths(skeleton: DataFrame, min_pixels: int = 6, block: int = ARC_BLOCK) -> DataFrame:
    """(label, line, pts): paths from end to end of a skeleton whose junctions are cleared, of min_pixels or more.

    label is the smallest cell id of the path; line is 0, as a cleared path has one walk. Paths start at the smaller end, by
    rows; rings without an end are lost. Only the row of a path holds it whole.
    """
    return _lines(skeleton, False, min_pixels, block).select(*raster_of(skeleton), F.col("least").alias("label"), F.lit(0).alias("line"), _points(F.col("cells")).alias("pts"))


def branches(skeleton: DataFrame, block: int = ARC_BLOCK) -> DataFrame:
    """(label, line, pts): every branch between junctions or ends, rings included, of two pixels or more.

    A branch takes the junction pixel next to each of its ends along, so branches meet there; a ring ends where it
    starts. label is the smallest cell id of the branch without these; line is 0.
    """
    head = F.slice("before", 1, 1)
    tail = F.slice(F.filter("behind", lambda q: (F.col("total") > 1) | ~F.array_contains(head, q)), 1, 1)
    cells = F.when(F.col("ring"), F.concat("cells", F.array("start"))).otherwise(F.concat(head, "cells", tail))
    lines = _lines(skeleton, True, 1, block).withColumn("ids", cells).where(F.size("ids") >= 2)
    return lines.select(*raster_of(skeleton), F.col("least").alias("label"), F.lit(0).alias("line"), _points(F.col("ids")).alias("pts"))


def gap_pairs(ends: DataFrame, max_gap: float) -> DataFrame:
    """(a, b, distance) of endpoints (id, row, col) of one raster at most max_gap apart; ids are unique over all rasters."""
    points = ends.select((F.col("raster_id") if raster_of(ends) else F.lit(0)).alias("g"), "id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return radius_pairs(points, "g", "id", max_gap).select("a", "b", "distance")


def cheapest(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """The path of least cost over eight neighbours; a step costs the mean of its two pixels times its length. Ties go to the smaller pixel."""
    best = {start: 0.0}
    came: dict = {}
    heap = [(0.0, start)]
    while heap:
        d, p = heapq.heappop(heap)
        if p == end:
            break
        if d > best[p]:
            continue
        for r, c in STEPS:
            q = (p[0] + r, p[1] + c)
            if 0 <= q[0] < cost.shape[0] and 0 <= q[1] < cost.shape[1]:
                n = d + (cost[p] + cost[q]) / 2 * (2**0.5 if r and c else 1.0)
                if n < best.get(q, np.inf):
                    best[q], came[q] = n, p
                    heapq.heappush(heap, (n, q))
    if end not in best:
        return []
    path = [end]
    while path[-1] != start:
        path.append(came[path[-1]])
    return path[::-1]


PATHS = "a long, b long, distance double, pts array<struct<row:int,col:int>>, pixels int, mean_cost double"


def least_cost_paths(pairs: DataFrame, ends: DataFrame, cost: DataFrame, padding: int = 20, tile: int = 128) -> DataFrame:
    """(a, b, distance, pts, pixels, mean_cost): the cheapest path of each pair inside its padded bounding box.

    The box is from the smaller ends less padding to the larger ends plus padding, the last row and column
    excluded, and cut by the raster; a box so small that an end is left out has no path. Pixels of the box
    that have no cost are barriers. A pair belongs to the tile of its box's first corner, which also gets the
    costs of as many tiles below and to the right as the largest box reaches, so a task holds a bounded map.
    """
    rasters = raster_of(ends)
    of = lambda s: ends.select(*(rasters if s == "a" else []), F.col("id").alias(s), F.col("row").alias(f"row_{s}"), F.col("col").alias(f"col_{s}"))
    low = lambda v: F.greatest(F.least(f"{v}_a", f"{v}_b") - padding, F.lit(0))
    high = lambda v: F.greatest(F.greatest(f"{v}_a", f"{v}_b") + padding - 1, F.lit(0))
    home = lambda v: F.floor(F.col(v) / tile).cast("int")
    boxes = checkpoint(pairs.join(of("a"), "a").join(of("b"), "b").withColumns({"top": F.least(low("row"), high("row")), "left": F.least(low("col"), high("col")), "bottom": F.greatest(low("row"), high("row")), "right": F.greatest(low("col"), high("col"))}))
    boxes = boxes.withColumns({"tile_row": home("top"), "tile_col": home("left")})
    reach = boxes.agg(*[F.max(F.floor(F.col(end) / tile) - home(begin)).cast("int") for begin, end in (("top", "bottom"), ("left", "right"))]).first()
    tiles = lambda v, n: F.explode(F.sequence(home(v) - (n or 0), home(v)))
    tile_key = [*rasters, "tile_row", "tile_col"]
    wanted = boxes.select(*tile_key).distinct()
    costs = cost.select(*rasters, "row", "col", "cost").withColumn("tile_row", tiles("row", reach[0])).withColumn("tile_col", tiles("col", reach[1])).join(wanted, tile_key, "left_semi")

    def run(key, held: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        origin = int(key[-2]) * tile, int(key[-1]) * tile
        if not len(held) or not len(cells):
            return pd.DataFrame({c.split()[0]: [] for c in ("a", "b", "distance", "pts", "pixels", "mean_cost")})
        grid = np.full((int(max(cells["row"].max(), held["bottom"].max())) - origin[0] + 1, int(max(cells["col"].max(), held["right"].max())) - origin[1] + 1), np.inf)
        known = np.zeros(grid.shape, bool)
        at = cells["row"].to_numpy() - origin[0], cells["col"].to_numpy() - origin[1]
        grid[at], known[at] = cells["cost"], True
        out = []
        for one in held.itertuples(index=False):
            top, left = one.top - origin[0], one.left - origin[1]
            there = known[top : one.bottom - origin[0] + 1, left : one.right - origin[1] + 1]
            if not there.any():
                continue
            # the raster ends where its costs do
            rows, cols = np.flatnonzero(there.any(axis=1)), np.flatnonzero(there.any(axis=0))
            top, left = top + int(rows[0]), left + int(cols[0])
            box = grid[top : top + int(rows[-1] - rows[0]) + 1, left : left + int(cols[-1] - cols[0]) + 1]
            top, left = top + origin[0], left + origin[1]
            start, end = (one.row_a - top, one.col_a - left), (one.row_b - top, one.col_b - left)
            inside = all(0 <= p[0] < box.shape[0] and 0 <= p[1] < box.shape[1] for p in (start, end))
            path = cheapest(box, start, end) if inside else []
            total = float(sum(box[p] for p in path))
            out.append((one.a, one.b, one.distance, [{"row": r + top, "col": c + left} for r, c in path], len(path), total / len(path) if path else None))
        return pd.DataFrame(out, columns=["a", "b", "distance", "pts", "pixels", "mean_cost"])

    return boxes.groupBy(*tile_key).cogroup(costs.groupBy(*tile_key)).applyInPandas(run, PATHS)


def accept_paths(paths: DataFrame, max_gap: float, max_avg_cost: float) -> DataFrame:
    """Paths of some but less than 1.5 * max_gap pixels whose plain mean cost is below max_avg_cost of the scale."""
    return paths.where((F.col("pixels") > 0) & (F.col("pixels") < 1.5 * max_gap) & (F.col("mean_cost") < max_avg_cost * COST_SCALE))


def road_mask(predictions: DataFrame, threshold: float, open_size: int, close_iterations: int, min_size: int, block: int = 512) -> DataFrame:
    """The set pixels of the road mask from the probabilities that overlapping tiles give each pixel of the rasters (dense): mean, threshold, opening, closing, then components of min_size pixels or more.

    All of it goes on in packed blocks, with a border as wide as opening and closing reach. Pixels without a row are beyond the edge.
    """
    return unpack(cleaned(predictions, threshold, open_size, close_iterations, min_size, block), block)


def road_lines(
    predictions: DataFrame, affine: Column, threshold: float, open_size: int = 3, close_iterations: int = 50, min_size: int = 0, min_length: float = 15.0, aoi: DataFrame | None = None, block: int = 4096, halo: int = 100
) -> DataFrame:
    """The road job after its model: (label, line, pts, length) of the centre lines in world coordinates.

    The cleaned mask is thinned and traced; lines of more than five pixels, longer than min_length and, with
    areas of interest, that intersect them stay. An AOI without rings keeps none. No predictions give no lines.
    """
    skeleton = skeletonize(road_mask(predictions, threshold, open_size, close_iterations, min_size), block, halo)
    lines = trace_paths(skeleton).withColumn("pts", F.transform("pts", lambda p: to_world_center(affine, p["col"], p["row"])))
    lines = lines.withColumn("length", line_length(F.col("pts"))).where(F.col("length") > min_length)
    return lines if aoi is None else lines_intersecting(lines, aoi)
