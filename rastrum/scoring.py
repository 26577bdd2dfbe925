"""Models that score tiles: an interface, Arrow batching, the steps before and after a network, and deterministic stand-ins for tests.

A network is any callable from an array (n, bands, h, w) to logits; OnnxNetwork runs a user's weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DETECTION = "raster_id string, tile_id long, x1 double, y1 double, x2 double, y2 double, score double, category_id int, category string"


class TileScorer(Protocol):
    """What a model must offer. load() runs once in each Python worker, before the first batch."""

    def load(self) -> None: ...

    def detect(self, tiles: np.ndarray) -> Iterable[list[tuple[float, float, float, float, float, int, str]]]: ...

    def segment(self, tiles: np.ndarray) -> np.ndarray: ...


class BrightSpots:
    """A stand-in: pixels above a level are boxes of one pixel, and the mean of the bands is the probability."""

    def __init__(self, level: int = 200):
        self.level = level

    def load(self) -> None:
        pass

    def detect(self, tiles):
        for t in tiles:
            top = t.max(axis=0)
            yield [(float(c), float(r), float(c + 1), float(r + 1), int(top[r, c]) / 255, int(top[r, c]) % 3, ("Healthy", "Yellowish", "Dead")[int(top[r, c]) % 3]) for r, c in zip(*np.nonzero(top > self.level), strict=True)]

    def segment(self, tiles):
        return tiles.mean(axis=1) / 255


# Means and deviations of the bands that transformer networks were trained with.
BAND_MEAN, BAND_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def axis_weights(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two neighbours and the second one's weight when n samples become size; pixel centres are kept in place, the edge goes on."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    low = np.floor(at)
    return np.clip(low, 0, n - 1).astype(int), np.clip(low + 1, 0, n - 1).astype(int), at - low


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear over the last two axes."""
    for axis, size in ((-2, h), (-1, w)):
        lo, hi, f = axis_weights(a.shape[axis], size)
        f = f[:, None] if axis == -2 else f
        a = np.take(a, lo, axis) * (1 - f) + np.take(a, hi, axis) * f
    return a


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Bilinear turn of (bands, h, w) about its centre, counter-clockwise as seen; beyond the edge the image is mirrored at its outermost pixels."""
    h, w = a.shape[1:]
    t = np.deg2rad(degrees)
    r, c = np.mgrid[:h, :w]
    y, x = r - (h - 1) / 2, c - (w - 1) / 2
    sy, sx = np.sin(t) * x + np.cos(t) * y + (h - 1) / 2, np.cos(t) * x - np.sin(t) * y + (w - 1) / 2

    def mirrored(i: np.ndarray, n: int) -> np.ndarray:
        i = np.abs(i) % max(1, 2 * (n - 1))
        return np.where(i >= n, 2 * (n - 1) - i, i).astype(int)

    y0, x0 = np.floor(sy), np.floor(sx)
    fy, fx = sy - y0, sx - x0
    take = lambda i, j: a[:, mirrored(i, h), mirrored(j, w)]
    return (take(y0, x0) * (1 - fx) + take(y0, x0 + 1) * fx) * (1 - fy) + (take(y0 + 1, x0) * (1 - fx) + take(y0 + 1, x0 + 1) * fx) * fy


class OnnxNetwork:
    """A network from an ONNX file, given by its bytes so that executors need no path; the session is made on the first call of a worker."""

    def __init__(self, model: bytes):
        self.model = model
        self.session = None

    def __getstate__(self):
        return {"model": self.model, "session": None}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.session is None:
            import onnxruntime

            self.session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        return self.session.run(None, {self.session.get_inputs()[0].name: x.astype(np.float32)})[0]


class UNetSegmenter:
    """Pixels as shares of 255, one channel of logits, sigmoid."""

    def __init__(self, network: Callable[[np.ndarray], np.ndarray]):
        self.network = network

    def load(self) -> None:
        pass

    def segment(self, tiles):
        z = np.asarray(self.network(tiles / 255))
        return sigmoid(z.reshape(len(tiles), *z.shape[-2:]))


class SegFormerSegmenter:
    """Pixels normalised by the bands' means and deviations, two channels of coarse logits, upsampled bilinearly, softmax of the second."""

    def __init__(self, network: Callable[[np.ndarray], np.ndarray]):
        self.network = network

    def load(self) -> None:
        pass

    def segment(self, tiles):
        mean, deviation = (np.array(v)[: tiles.shape[1], None, None] for v in (BAND_MEAN, BAND_DEVIATION))
        z = resize(np.asarray(self.network((tiles / 255 - mean) / deviation), float), *tiles.shape[-2:])
        return sigmoid(z[:, 1] - z[:, 0])


def bright(x: np.ndarray) -> np.ndarray:
    """A stand-in network of one channel: how bright a pixel is."""
    return 8 * (x.mean(axis=1, keepdims=True) - 0.5)


def bright_blocks(x: np.ndarray) -> np.ndarray:
    """A stand-in network of two channels at a quarter of the size: how bright a block is, against and for."""
    n, _, h, w = x.shape
    m = x.mean(axis=1).reshape(n, h // 4, 4, w // 4, 4).mean(axis=(2, 4))
    return np.stack([-m, m], axis=1)


def _arrays(pdf: pd.DataFrame) -> np.ndarray:
    """The tiles (bands, h, w, pixels as bytes) of a batch in which all have one shape."""
    first = pdf.iloc[0]
    return np.stack([np.frombuffer(p, np.uint8).reshape(first["bands"], first["h"], first["w"]) for p in pdf["pixels"]])


def _batches(frames, size: int):
    for pdf in frames:
        for _, same in pdf.groupby(["bands", "h", "w"], sort=False):
            for s in range(0, len(same), size):
                yield same.iloc[s : s + size]


def not_empty(tiles: DataFrame) -> DataFrame:
    """Tiles with a pixel that is not 0, before the model sees them."""
    return tiles.where(F.regexp_replace(F.hex("pixels"), "0", "") != "")


def detect(tiles: DataFrame, scorer: TileScorer, batch: int = 4) -> DataFrame:
    """Detections in tile coordinates of tiles (raster_id, tile_id, bands, w, h, pixels)."""

    def run(frames):
        scorer.load()
        for pdf in _batches(frames, batch):
            rows = [(r.raster_id, r.tile_id, *d) for r, found in zip(pdf.itertuples(), scorer.detect(_arrays(pdf)), strict=True) for d in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTION.split(", ")])

    return tiles.mapInPandas(run, DETECTION)


def segment(tiles: DataFrame, scorer: TileScorer, batch: int = 4) -> DataFrame:
    """Probabilities by pixel in raster coordinates: raster_id, tile_id, row, col, p."""

    def run(frames):
        scorer.load()
        for pdf in _batches(frames, batch):
            for r, p in zip(pdf.itertuples(), scorer.segment(_arrays(pdf)), strict=True):
                rr, cc = np.mgrid[r.y_off : r.y_off + r.h, r.x_off : r.x_off + r.w]
                yield pd.DataFrame({"raster_id": r.raster_id, "tile_id": r.tile_id, "row": rr.ravel(), "col": cc.ravel(), "p": p.ravel().astype(float)})

    return tiles.mapInPandas(run, "raster_id string, tile_id long, row int, col int, p double")


def seeded_flips(seed: int, across: float = 0.5, down: float = 0.1) -> Callable[[int], tuple[bool, bool]]:
    """For each tile id whether it is flipped across and down, the same in every run."""

    def flips(tile_id: int) -> tuple[bool, bool]:
        r = np.random.default_rng((seed, tile_id & 0xFFFFFFFF)).random(2)
        return bool(r[0] < across), bool(r[1] < down)

    return flips


def seeded_turns(seed: int, limit: float = 35.0) -> Callable[[int], float]:
    """For each tile id an angle between -limit and limit degrees, the same in every run."""
    return lambda tile_id: float(np.random.default_rng((seed, 1, tile_id & 0xFFFFFFFF)).uniform(-limit, limit))


def augment(tiles: DataFrame, flips: Callable[[int], tuple[bool, bool]], size: int | None = None, turns: Callable[[int], float] | None = None, normalise: bool = False) -> DataFrame:
    """Tiles resized to size x size, turned by turns(tile_id) degrees, flipped as flips(tile_id) says and, with normalise, given as shares of 255.

    Steps that are not asked for are left out. Pixels are bytes, normalised ones four-byte floats. Training
    takes size 750, seeded_turns and seeded_flips.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.pixels, np.uint8).reshape(r.bands, r.h, r.w)
                if size:
                    a = np.rint(resize(a.astype(float), size, size))
                if turns:
                    a = np.rint(rotate(a.astype(float), turns(r.tile_id)))
                x, y = flips(r.tile_id)
                a = np.ascontiguousarray(a[:, :: -1 if y else 1, :: -1 if x else 1])
                out.append((a / 255).astype("<f4").tobytes() if normalise else a.astype(np.uint8).tobytes())
            made = pdf.assign(pixels=out)
            yield made.assign(w=np.int32(size), h=np.int32(size)) if size else made

    return tiles.mapInPandas(run, tiles.schema)
