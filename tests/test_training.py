"""Distributed training against one loop over all tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum import training
from rastrum.plans import catalog
from rastrum.scoring import UNetSegmenter

TILE = "tile_id long, bands int, h int, w int, pixels binary, mask binary, extra string"


def tiles(bands=2, n=40, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, w = (6, 9) if i % 3 else (5, 4)
        a = r.integers(0, 256, (bands, h, w)).astype(np.uint8)
        m = np.where(a[0].astype(int) + np.roll(a[bands - 1], 1, 1) > 250, 255, r.choice([0, 7], (h, w))).astype(np.uint8)
        out.append((i, bands, h, w, a.tobytes(), m.tobytes(), "x"))
    return out


def loop(rows, bands, hidden, epochs, rate, seed):
    """The same fit by one loop; the gradient by differences of the loss is tested apart."""
    net = training.PixelNetwork.seeded(bands, hidden, seed)
    mean = spread = 0
    losses = []
    for epoch in range(1, epochs + 1):
        total, loss, n = 0, 0.0, 0
        for i, b, h, w, pixels, mask, _ in rows:
            x, y = training.augmented(np.frombuffer(pixels, np.uint8).reshape(b, h, w), np.frombuffer(mask, np.uint8).reshape(h, w), i, seed, epoch)
            g, own = net.gradient(x[None], y[None])
            total, loss, n = total + g, loss + own, n + y.size
        g = total / n
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g**2
        net = training.PixelNetwork(bands, hidden, net.parameters - rate * mean / (1 - 0.9**epoch) / (np.sqrt(spread / (1 - 0.999**epoch)) + 1e-8))
        losses.append(loss / n)
    return net, losses


def test_the_same_weights_as_one_loop(spark):
    rows = tiles()
    odd = [(None, *rows[0][1:]), (90, 2, 6, 9, None, rows[1][5], "x"), (91, 2, 6, 9, rows[1][4], b"short", "x"), (92, 2, 0, 0, b"", b"", "x")]
    net, history = training.train(spark.createDataFrame(rows + odd, TILE).repartition(5), 6, 3, 0.05, 2)
    want, losses = loop(rows, 2, 3, 6, 0.05, 2)
    assert np.allclose(net.parameters, want.parameters, rtol=1e-9, atol=1e-12)
    assert np.allclose([h[2] for h in history], losses) and {h[1] for h in history} == {sum(r[2] * r[3] for r in rows)} and losses[-1] < losses[0]


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    net = training.PixelNetwork.seeded(2, 3, 5)
    net.parameters += r.normal(0, 0.1, len(net.parameters))
    x, y = r.random((2, 2, 5, 6)), r.integers(0, 2, (2, 5, 6)).astype(float)
    g, _ = net.gradient(x, y)
    for k in range(len(g)):
        e = np.zeros(len(g))
        e[k] = 1e-6
        up, down = (training.PixelNetwork(2, 3, net.parameters + s * e).gradient(x, y)[1] for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_no_tiles_and_mixed_bands(spark):
    none = spark.createDataFrame([], TILE)
    net, history = training.train(none, 3)
    assert history == [] and (net.parameters == training.PixelNetwork.seeded(1, 4, 1).parameters).all()
    with pytest.raises(ValueError):
        training.train(spark.createDataFrame(tiles(1, 2) + tiles(2, 2), TILE), 1)


def test_a_trained_network_segments(spark):
    d = "/root/testdata/sf0.001"
    history = catalog.QUERIES["train"](spark, d).orderBy("epoch").collect()
    assert history[-1].loss < history[0].loss and history[0].pixels == 64 * spark.read.parquet(f"{d}/embeddings.parquet").count()
    got = catalog.QUERIES["segment_trained"](spark, d).agg(F.sum("right").alias("r"), F.sum("pixels").alias("n")).first()
    assert got.r / got.n > 0.8
    assert UNetSegmenter(training.PixelNetwork.seeded(1, 2, 1)).segment(np.zeros((2, 1, 4, 4))).shape == (2, 4, 4)
