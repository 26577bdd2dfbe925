"""Codebooks and codes against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from rastrum.llm import yinyang
from rastrum.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
ODD = "vec_id long, embedding array<float>, label int, v int, carried string, code int"


def plain(rows, rounds=4):
    """{vec_id: (code, error)}, digest: a full scan in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in e], y) for i, e, y in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max(len(e) for _, e, _ in kept) // 4) * 4
    kept = [(i, e + [0] * (width - len(e)), y) for i, e, y in kept]
    step = width // 4
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [np.array([e[p * step : (p + 1) * step] for _, e, _ in seeds], object) for p in range(4)]
    parts = [np.array([e[p * step : (p + 1) * step] for _, e, _ in kept], object) for p in range(4)]

    def assign():
        return [np.array([((b - x) ** 2).sum(axis=1).argmin() for x in part]) for part, b in zip(parts, books, strict=True)]

    for _ in range(rounds):
        for part, b, at in zip(parts, books, assign(), strict=True):
            for e in range(len(b)):
                own = part[at == e]
                if len(own):
                    b[e] = [sum(c) // len(own) for c in own.T]
    own = assign()
    out = []
    for k, (i, _, y) in enumerate(kept):
        out.append((i, "".join(f"{o[k]:02x}" for o in own), sum(int(((books[p][own[p][k]] - parts[p][k]) ** 2).sum()) for p in range(4)), y))
    return out, hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def check(df, rows):
    want, digest = plain(rows)
    total = {}
    for _, _, error, y in want:
        total[y] = total.get(y, 0) + error
    got = yinyang.compress(df).collect()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(((i, c, e, total[y]) for i, c, e, y in want), key=repr)


def test_whole_table(spark):
    df = table(spark, SF, "embeddings")
    check(df, [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


@pytest.mark.parametrize("scale", [0.01, 1.0, 20_000.0])
def test_ties_odd_rows_and_wide_numbers(spark, scale):
    """Few distinct values, so that distances tie; nulls, copies, short vectors, a hot label; numbers that need more than 53 bits."""
    r = random.Random(3)
    f = lambda x: float(np.float32(x * scale))
    rows = [(r.randrange(500), [f(r.choice([-1, 0, 0.5, 1, 2])) for _ in range(8)], r.choice([1, 1, 1, 2, None])) for _ in range(700)]
    rows += [(None, [f(1)] * 8, 3), (7, None, 1), (8, [f(1), None], 1), (9, [f(1), float("nan")], 1), (10, [float("-inf")] * 8, 1), (11, [], 4), (12, [f(1)] * 5, 4), rows[0], rows[1]]
    df = spark.createDataFrame([x + (1, "c", 2) for x in rows], ODD).repartition(5)
    check(df, rows)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [float(i % 3), 0.25, -0.5, 1.0], None) for i in range(5)]
    check(spark.createDataFrame([x + (1, "c", 2) for x in rows], ODD), rows)
    none = spark.createDataFrame([(1, None, 1, 1, "c", 2)], ODD)
    assert yinyang.compress(none).count() == 0 == yinyang.compress(none.limit(0)).count()
    with pytest.raises(ValueError):
        yinyang.compress(spark.createDataFrame([(1, [1e9] * 4, 1, 1, "c", 2)], ODD))


def test_bounds_skip_groups_and_hold():
    """Most groups are not scanned in a later round, and each bound is no more than the distance to its group's others."""
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(2000, 16)) * 40 + 400 * r.integers(0, 2, (2000, 16))).astype(np.float64)
    books = yinyang.Books(x[:256].reshape(1, 256, 16).astype(np.int64), 2000)
    own, _, lower = yinyang.nearest(x, books.entries[0].astype(float), books.groups[0])
    moved = books.entries + r.integers(-3, 4, books.entries.shape)
    books.moved(moved)
    held = yinyang.widened(yinyang.shrunk(lower)) - books.drift[0]
    d = yinyang.distances(x, moved[0].astype(float))
    for g, members in enumerate(books.groups[0]):
        others = np.where(members[None, :] == own[:, None], np.inf, d[:, members])
        assert (held[:, g] <= np.sqrt(others.min(axis=1))).all()
    reach = np.sqrt(d[np.arange(len(x)), own])
    assert (held > reach[:, None]).mean() > 0.5
    again, dist, _ = yinyang.nearest(x, moved[0].astype(float), books.groups[0], own, held)
    assert (again == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_codes_name_the_entries(spark):
    df = table(spark, SF, "embeddings")
    codes, books, _ = yinyang.encode(df)
    rows = {r.vec_id: r for r in yinyang.decode(codes, books).join(df.select("vec_id", "embedding"), "vec_id").collect()}
    for r in rows.values():
        error = sum((math.floor(1024 * x) - round(1024 * v)) ** 2 for x, v in zip(r.embedding, r.vector, strict=True))
        assert error == r.error
    assert QUERIES["op13_yinyang"](spark, SF).count() == len(rows) == df.count()
