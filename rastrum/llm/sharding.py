"""Shards along a Hilbert curve over several metadata dimensions.

Source, language and length are quantised, the cell's index on the Hilbert curve is the sort key, and
equal runs of the order are the shards, so that a shard spans a compact region and its files can be
skipped by the minima and maxima of any of the dimensions. The order inside a cell is a hash of the
document, so a cell that holds a third of all rows is spread over many sort ranges like any other.

A text dimension is quantised by the ranks of its distinct values in code point order, which are sorted in
ranges; only the values at the level's bounds come to the driver. Besides those only numbers are shuffled.
Ranges are cut at quantiles of the key; counts by range come to the driver (RANGES at most), rows are
numbered within their range.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rastrum.session import checkpoint

BITS = 5  # levels of a dimension: 2 ** BITS
RANGES = 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of integer coordinates below 2 ** bits.

    The coordinates are turned into the transposed form of the index (Skilling 2004) by undoing the
    rotations from the highest bit down and Gray-coding the rest; their bits are then interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        p = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def text_bounds(df: DataFrame, col: str) -> list[str | None]:
    """The distinct value at which each level from 1 on begins; null comes first, levels differ by one value in size at most.

    The distinct values are sorted in ranges; a value's rank is its place in its range after the sizes of
    the ranges before it.
    """
    values = checkpoint(df.select(F.col(col).alias("v")).distinct().sort(F.col("v").asc_nulls_first())).withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(values.groupBy(part.alias("part")).count().collect())
    n, wanted = sum(sizes.values()), []
    firsts = [-(-level * n >> BITS) for level in range(1, 1 << BITS)] if n else []
    before = 0
    for p in sorted(sizes):
        wanted += [(rank, (p << 33) + rank - before) for rank in sorted(set(firsts)) if before <= rank < before + sizes[p]]
        before += sizes[p]
    found = dict(values.where(F.col("at").isin([at for _, at in wanted])).select("at", "v").collect()) if wanted else {}
    at_rank = {rank: found[at] for rank, at in wanted}
    return [at_rank[rank] for rank in firsts if rank < n]  # the others begin after the last value


def text_level(bounds: list[str | None], value: str | None) -> int:
    """The number of bounds that are not above the value."""
    key = lambda v: (v is not None, v or "")
    return bisect_right(bounds, key(value), key=key)


def _keys(levels: list, bounds: np.ndarray):
    def of_text(col: pa.Array, level: list) -> np.ndarray:
        coded = col.dictionary_encode(null_encoding="encode")
        of = [text_level(level, v) for v in coded.dictionary.to_pylist()]
        return np.array(of, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(col) else np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            length = np.searchsorted(bounds, b.column("length").fill_null(-1).to_numpy(zero_copy_only=False), "right")
            cells = np.stack([of_text(b.column("source"), levels[0]), of_text(b.column("lang"), levels[1]), length], axis=1)
            low = b.column("h").to_numpy(zero_copy_only=False) & ((1 << 40) - 1)
            key = (hilbert_index(cells, BITS) << 40) | low
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(key)], ["doc_id", "size", "text_crc32", "key"])

    return run


def curve_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32 and key: the curve index, then 40 bits of a hash of id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(length_col).cast("long").alias("length"),
    )
    rows = checkpoint(rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")))
    share = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = rows.agg(F.percentile_approx("length", share, 10_000)).first()[0] or []
    levels = [text_bounds(rows, "source"), text_bounds(rows, "lang")]
    return rows.mapInArrow(_keys(levels, np.array(cuts, np.int64)), "doc_id long, size long, text_crc32 long, key long")


def _ranges(bounds: np.ndarray):
    def run(batches):
        for b in batches:
            at = np.searchsorted(bounds, b.column("key").to_numpy(zero_copy_only=False), "right")
            yield b.append_column("range", pa.array(at.astype(np.int32)))

    return run


def shard(docs: DataFrame, shards: int = 40, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; law is "rows": counts differ by one at most.

    Slots are gapless from 0 in each shard and follow the curve. Null ids, texts and metadata are values
    of their own (null text: no bytes; null metadata: the lowest level); rows that are equal in id and
    text stand side by side in any order. With fewer rows than shards some shards are empty. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = checkpoint(curve_keys(docs, **columns))
    total = rows.count()
    ranges = max(1, min(RANGES, total // 500))
    bounds = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10 * RANGES)).first()[0] or []
    bounds = np.unique(np.array(bounds if ranges > 1 else [], np.int64))
    rows = rows.mapInArrow(_ranges(bounds), "doc_id long, size long, text_crc32 long, key long, range int")
    counts = dict(rows.groupBy("range").count().collect())
    starts, at = [], 0
    for r in range(len(bounds) + 1):
        starts.append(at)
        at += counts.get(r, 0)
    here = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32")) - 1
    rank = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("range")) + here
    placed = rows.withColumn("rank", rank).withColumn("shard", F.expr(f"cast(rank * {shards} div {max(1, total)} as int)"))
    # the first rank of a shard
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_sharded(docs: DataFrame, path: str, shards: int = 40, **columns: str) -> None:
    """Write docs as one sorted file for each run of the curve; rows with equal id and text go together."""
    names = {"id_col": "doc_id", "text_col": "text"} | columns
    text = F.coalesce(F.col(names["text_col"]), F.lit(""))
    keys = curve_keys(docs, **columns).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col("key").alias("_key")).distinct()
    on = docs[names["id_col"]].cast("long").eqNullSafe(keys["_id"]) & (F.crc32(text.cast("binary")) == keys["_crc"]) & ((F.octet_length(text) + 16) == keys["_size"])
    held = docs.join(keys, on).drop("_id", "_crc", "_size")
    held.repartitionByRange(shards, "_key").sortWithinPartitions("_key").drop("_key").write.mode("overwrite").parquet(path)
