"""Training of a small convolutional pixel classifier: binary cross entropy over all pixels, gradients summed by Spark.

An epoch is one pass over all tiles. Each task adds up the gradients of its tiles, Spark adds up the tasks' sums by
parameter with partial aggregation, and the driver, which only ever holds the parameters, takes an Adam step. Tiles are
flipped together with their masks as a seed, the epoch and the tile's id say, so a pass that runs again gives the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rastrum.scoring import seeded_flips, sigmoid
from rastrum.session import checkpoint

SIDE = 3  # of the kernels


def patches(x: np.ndarray) -> np.ndarray:
    """(n, h, w, bands * 9): the neighbourhood of each pixel, zeros beyond the edge."""
    n, bands, h, w = x.shape
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    return np.stack([p[:, b, i : i + h, j : j + w] for b in range(bands) for i in range(SIDE) for j in range(SIDE)], axis=-1)


@dataclass
class PixelNetwork:
    """A 3 x 3 convolution to some hidden channels, a rectifier, and a 1 x 1 convolution to one logit; its parameters are one vector."""

    bands: int
    hidden: int
    parameters: np.ndarray

    @classmethod
    def seeded(cls, bands: int, hidden: int, seed: int) -> PixelNetwork:
        r = np.random.default_rng(seed)
        width = bands * SIDE * SIDE
        return cls(bands, hidden, np.concatenate([r.normal(0, (2 / width) ** 0.5, width * hidden), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), [0.0]]))

    def parts(self, vector: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Kernels, their offsets, the weights of the hidden channels and the last offset, as views of the vector."""
        v, width = self.parameters if vector is None else vector, self.bands * SIDE * SIDE
        cut = np.cumsum([width * self.hidden, self.hidden, self.hidden])
        return v[: cut[0]].reshape(width, self.hidden), v[cut[0] : cut[1]], v[cut[1] : cut[2]], v[cut[2] :]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Logits (n, 1, h, w) of shares (n, bands, h, w)."""
        kernels, offsets, weights, last = self.parts()
        return (np.maximum(patches(x) @ kernels + offsets, 0) @ weights + last[0])[:, None]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """The sums over all pixels of the gradient and of the cross entropy of logits against masks (n, h, w)."""
        kernels, offsets, weights, last = self.parts()
        near = patches(x)
        before = near @ kernels + offsets
        hidden = np.maximum(before, 0)
        z = hidden @ weights + last[0]
        off = sigmoid(z) - y
        back = off[..., None] * weights * (before > 0)
        out = np.concatenate([np.tensordot(near, back, ((0, 1, 2), (0, 1, 2))).ravel(), back.sum((0, 1, 2)), np.tensordot(hidden, off, ((0, 1, 2), (0, 1, 2))), [off.sum()]])
        return out, float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())


def augmented(pixels: np.ndarray, mask: np.ndarray, tile_id: int, seed: int, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """A tile (bands, h, w) as shares and its mask (h, w) as 0 and 1, both flipped as seed, epoch and id say."""
    across, down = seeded_flips(seed * 1000 + epoch)(tile_id)
    turn = (slice(None, None, -1 if down else 1), slice(None, None, -1 if across else 1))
    return pixels[(slice(None), *turn)] / 255, (mask[turn] == 255).astype(float)


def _sums(network: PixelNetwork, seed: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(len(network.parameters)), 0.0, 0
        for batch in batches:
            for tile_id, h, w, pixels, mask in zip(*(batch.column(c).to_pylist() for c in ("tile_id", "h", "w", "pixels", "mask")), strict=True):
                x, y = augmented(np.frombuffer(pixels, np.uint8).reshape(network.bands, h, w), np.frombuffer(mask, np.uint8).reshape(h, w), tile_id, seed, epoch)
                g, own = network.gradient(x[None], y[None])
                total, loss, n = total + g, loss + own, n + y.size
        if n:
            values = np.concatenate([total, [loss, n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["k", "v"])

    return run


def train(tiles: DataFrame, epochs: int = 25, hidden: int = 4, rate: float = 0.05, seed: int = 1) -> tuple[PixelNetwork, list[tuple[int, int, float]]]:
    """A network fitted to tiles (tile_id, bands, h, w, pixels, mask), and (epoch, pixels, mean loss) of each epoch.

    pixels and mask are bytes, 255 in a mask is 1 and anything else 0. Tiles with a null or of a wrong length are passed
    over; all tiles need the same number of bands, of any size. Without tiles the network is the seeded one and there
    are no epochs. Adam with the usual decays of 0.9 and 0.999.
    """
    size = F.col("h").cast("long") * F.col("w")
    good = (F.octet_length("pixels") == size * F.col("bands")) & (F.octet_length("mask") == size) & F.col("tile_id").isNotNull() & (size > 0)
    held = checkpoint(tiles.where(good).select(F.col("tile_id").cast("long").alias("tile_id"), "bands", "h", "w", "pixels", "mask"))
    bands = [r[0] for r in held.select("bands").distinct().limit(2).collect()]
    if len(bands) > 1:
        raise ValueError("tiles of one training have the same number of bands")
    network = PixelNetwork.seeded(bands[0] if bands else 1, hidden, seed)
    mean, spread, history = np.zeros(len(network.parameters)), np.zeros(len(network.parameters)), []
    for epoch in range(1, epochs + 1 if bands else 1):
        found = held.mapInArrow(_sums(network, seed, epoch), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row for each parameter
        values = np.array([r.v for r in sorted(found, key=lambda r: r.k)])
        n = values[-1]
        g = values[:-2] / n
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        step = rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(spread / (1 - 0.999**epoch)) + 1e-8)
        network = PixelNetwork(network.bands, hidden, network.parameters - step)
        history.append((epoch, int(n), float(values[-2] / n)))
    return network, history
