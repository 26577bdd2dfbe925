"""Vector code compression: product codebooks fitted by Yinyang Lloyd rounds in whole numbers.

Components become whole numbers, vectors are cut into PARTS, and each part has a codebook of up to ENTRIES
entries. The entries of a codebook are clustered into GROUPS once. Each vector keeps, for each part, the
entry it is assigned to and one lower bound per group: no entry of the group but the assigned one is
nearer than that. After a round, bounds fall by the largest drift of an entry of their group. Only groups
whose bound no longer exceeds the distance to the assigned entry are scanned, and distances are compared
as whole numbers there, so ties go to the lower index exactly and the result is that of a full scan.

Vectors and bounds are rows of a table, written once a round; bounds are the upper halves of 32-bit floats,
cut towards zero, so they only ever fall. What a round sends to the driver is a sum for each entry, a size
that the codebook fixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rastrum.session import checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 16
BLOCK = 4096  # vectors whose distances are held at once
SLACK = 1e-9  # relative; distances and bounds within it are settled in whole numbers


def valid(vector: F.Column) -> F.Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry; exact, as both have a type that holds them."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]


def grouped(book: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """The entries of each group, ascending: a few Lloyd rounds over the entries themselves, from evenly spaced ones."""
    points = book.astype(np.float64)
    centers = points[:: max(1, -(-len(points) // groups))]
    for _ in range(5):
        at = distances(points, centers).argmin(axis=1)
        centers = np.array([points[at == g].mean(axis=0) if (at == g).any() else centers[g] for g in range(len(centers))])
    return [np.flatnonzero(at == g) for g in range(len(centers))]


def shrunk(bounds: np.ndarray) -> np.ndarray:
    """Lower bounds in 16 bits, never larger than they were."""
    return ((np.maximum(bounds, 0) * (1 - 1e-6)).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def widened(bounds: np.ndarray) -> np.ndarray:
    return (bounds.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def nearest(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], own: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, a lower bound per group) of each row of x, ties to the lower entry.

    own and lower are the entries assigned so far and bounds that hold for book; without them all groups are
    scanned.
    """
    n = len(x)
    if own is None:
        best, dist = np.full(n, len(book)), np.full(n, np.iinfo(np.int64).max, x.dtype)
        lower, scan = np.full((n, len(groups)), np.inf), np.ones((n, len(groups)), bool)
    else:
        best, dist = own.astype(np.int64), ((x - book[own]) ** 2).sum(axis=1)
        reach = np.sqrt(dist.astype(np.float64))
        scan = lower <= (reach * (1 + SLACK))[:, None]
        lower = lower.copy()
    was, seen = best.copy(), []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(members) or not len(rows):
            continue
        d = distances(x[rows], book[members])
        j = d.argmin(axis=1)
        low, entry = d[np.arange(len(rows)), j], members[j]
        second = np.partition(d, 1, axis=1)[:, 1].astype(np.float64) if len(members) > 1 else np.full(len(rows), np.inf)
        seen.append((g, rows, low, entry, second))
        better = (low < dist[rows]) | ((low == dist[rows]) & (entry < best[rows]))
        best[rows[better]], dist[rows[better]] = entry[better], low[better]
    if own is not None:  # the entry left behind is one of its group's others now
        of = np.empty(len(book), np.int64)
        for g, members in enumerate(groups):
            of[members] = g
        left = np.flatnonzero(best != was)
        g = of[was[left]]
        lower[left, g] = np.minimum(lower[left, g], reach[left] * (1 - SLACK))
    for g, rows, low, entry, second in seen:
        lower[rows, g] = np.sqrt(np.where(best[rows] == entry, second, low.astype(np.float64)))
    return best, dist, lower


class Books:
    """The codebooks of all parts, their groups, and the drift of each group in the last round."""

    def __init__(self, entries: np.ndarray, limit: int):
        self.entries = entries  # parts x entries x positions, whole numbers
        self.kind = np.float64 if 4 * max(1, entries.shape[2]) * limit * limit < 1 << 53 else np.int64
        self.groups = [grouped(b) for b in entries]
        self.drift: list[np.ndarray] | None = None

    def moved(self, entries: np.ndarray) -> None:
        away = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLACK)
        self.drift = [np.array([a[m].max() if len(m) else 0.0 for m in groups]) for a, groups in zip(away, self.groups, strict=True)]
        self.entries = entries

    def digest(self) -> str:
        """SHA-256 of all components as decimals by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column whose values all have width values of dtype."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of the vectors of a list column, each filled up with zeros to width."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(flat * SCALE)
    return out.astype(np.int64)


def _quantised(width: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole_numbers(batch.column("v"), width).astype(dtype)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("carried"), _binary(v)], ["vec_id", "carried", "v"])

    return run


def _assigned(books: Books, width: int, dtype: str, last: bool):
    """Each vector with its entries and bounds under books; in the last pass its code and error instead."""
    step = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.entries.astype(books.kind)
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(s, BLOCK)
                x = _matrix(batch.column("v"), dtype, width).astype(books.kind)
                began = books.drift is None
                cuts = np.cumsum([0] + [len(g) for g in books.groups])
                if not began:
                    old = _matrix(batch.column("own"), np.uint8, PARTS)
                    lower = widened(_matrix(batch.column("bounds"), np.uint16, int(cuts[-1])))
                found = [
                    nearest(x[:, p * step : (p + 1) * step], entries[p], books.groups[p], *(() if began else (old[:, p], lower[:, cuts[p] : cuts[p + 1]] - books.drift[p])))
                    for p in range(PARTS)
                ]
                own = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                if last:
                    code = pa.array([r.tobytes().hex() for r in own], pa.string())
                    error = pa.array(sum(f[1] for f in found).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("carried"), code, error], ["vec_id", "carried", "code", "error"])
                else:
                    bounds = shrunk(np.concatenate([f[2] for f in found], axis=1))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("carried"), batch.column("v"), _binary(own), _binary(bounds)], ["vec_id", "carried", "v", "own", "bounds"])

    return run


def _sums(entries: int, width: int, dtype: str):
    """For each entry that has vectors in the task, their number and the sums of their components."""
    step = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, step), np.int64)
        for batch in batches:
            x, own = _matrix(batch.column("v"), dtype, width), _matrix(batch.column("own"), np.uint8, PARTS)
            for p in range(PARTS):
                order = np.argsort(own[:, p], kind="stable")
                at = own[order, p]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
                n[p] += np.bincount(at, minlength=entries)
                if len(first) and step:
                    total[p, at[first]] += np.add.reduceat(x[order, p * step : (p + 1) * step], first, axis=0, dtype=np.int64)
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e])] + [pa.array(total[p, e, k]) for k in range(step)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *[f"s{k}" for k in range(step)]])

    return run


def _updated(state: DataFrame, entries: np.ndarray, width: int, dtype: str) -> np.ndarray:
    """The entries after a round: floored means of what is assigned to them; unused ones stay."""
    step = width // PARTS
    names = ["n", *[f"s{k}" for k in range(step)]]
    sums = state.select("v", "own").mapInArrow(_sums(entries.shape[1], width, dtype), "part int, entry int, " + ", ".join(f"{c} long" for c in names))
    out = entries.copy()
    for row in sums.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect():
        out[row.part, row.entry] = [int(row[c]) // int(row.n) for c in names[1:]]
    return out


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: str | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, str]:
    """(codes, codebooks, digest of the codebooks): codes has vec_id, carried, code and error of each vector that is kept.

    Kept are vectors that are there and have only finite components. Each component x becomes floor(1024 * x).
    All vectors have the width of the longest, rounded up to a multiple of four; shorter ones go on with zeros.
    A codebook starts with the parts of the ENTRIES smallest ids (null ids last, ties by the vector; all, if there
    are fewer). code has two hexadecimal digits for each part, error is the squared distance summed over the
    parts. Repeated rows and ids are rows of their own. Other columns are ignored but the one named in carry. An
    empty table gives no codes and no codebooks. Errors are longs, so components whose squared
    distances could exceed them (beyond some 100,000 at 64 dimensions) are an error.
    """
    carried = (F.col(carry) if carry else F.lit(None).cast("int")).alias("carried")
    rows = vectors.where(valid(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), carried, F.col(vector_col).alias("v"))
    top = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))).cast("double")
    size = rows.agg(F.max(F.size("v")).alias("width"), F.max(top).alias("top")).first()
    kind = rows.schema["carried"].dataType.simpleString()
    if size["width"] is None:
        return rows.select("vec_id", "carried", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64), hashlib.sha256(b"").hexdigest()
    width, limit = -(-size["width"] // PARTS) * PARTS, int((size["top"] or 0) * SCALE) + 2
    if 4 * width * limit * limit >= 1 << 63:
        raise ValueError("squared distances of these vectors don't fit into a long")
    dtype = "<i2" if limit < 1 << 15 else "<i4"
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow().column("v").combine_chunks()
    books = Books(np.ascontiguousarray(whole_numbers(seeds, width).reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2)), limit)
    state = rows.mapInArrow(_quantised(width, dtype), f"vec_id long, carried {kind}, v binary")
    for _ in range(rounds):
        state = checkpoint(state.mapInArrow(_assigned(books, width, dtype, False), f"vec_id long, carried {kind}, v binary, own binary, bounds binary"))
        books.moved(_updated(state, books.entries, width, dtype))
    codes = state.mapInArrow(_assigned(books, width, dtype, True), f"vec_id long, carried {kind}, code string, error long")
    return codes, books.entries, books.digest()


def decode(codes: DataFrame, codebooks: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with a column vector: the entries that a code names, part after part, divided by SCALE. A null code has a null vector."""
    books = F.array(*[F.array(*[F.array(*[F.lit(int(v) / SCALE) for v in e]).cast("array<double>") for e in book]) for book in codebooks])
    entry = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(F.get(books, F.lit(p)), entry(p)) for p in range(PARTS)]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the error summed over equal labels, nulls together) and codebooks_sha256 of each vector kept, as in encode."""
    codes, _, digest = encode(vectors, id_col, vector_col, label_col, rounds)
    codes = checkpoint(codes)
    labels = codes.groupBy(F.col("carried").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(labels, codes["carried"].eqNullSafe(labels["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
