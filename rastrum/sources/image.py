"""PNG and NPY bytes."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def write_png(a: np.ndarray) -> bytes:
    """A PNG of rows and columns (grey) or bands, rows and columns (1 grey, 2 grey and alpha, 3 colours, 4 with alpha), 8 or 16 bits."""
    a = a[None] if a.ndim == 2 else a
    bands, height, width = a.shape
    if a.dtype not in (np.uint8, np.uint16) or not 1 <= bands <= 4:
        raise ValueError("PNG holds one to four bands of 8 or 16 bits")
    rows = np.ascontiguousarray(a.transpose(1, 2, 0)).astype(a.dtype.newbyteorder(">")).reshape(height, -1).view(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8 * a.dtype.itemsize, (0, 4, 2, 6)[bands - 1], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Bands, rows and columns of a PNG that is not interlaced."""
    at, idat = 8, b""
    width = height = depth = colour = 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">2I5B", body)
            if interlaced or depth < 8:
                raise ValueError("interlaced or packed PNG")
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    bands = {0: 1, 4: 2, 2: 3, 6: 4}[colour]
    step = bands * depth // 8
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, -1)
    out = np.zeros((height, raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int32)
    for r in range(height):
        mode, line = raw[r, 0], raw[r, 1:].astype(np.int32)
        if mode == 2:
            line = line + above
        elif mode:
            for i in range(len(line)):
                left = line[i - step] if i >= step else 0
                corner = above[i - step] if i >= step else 0
                if mode == 1:
                    line[i] += left
                elif mode == 3:
                    line[i] += (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    near = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))
                    line[i] += near[2]
                line[i] &= 0xFF
        out[r] = line & 0xFF
        above = out[r].astype(np.int32)
    kind = np.dtype(">u2") if depth == 16 else np.dtype(np.uint8)
    return out.reshape(-1).view(kind).reshape(height, width, bands).transpose(2, 0, 1).astype(kind.newbyteorder("="))


def write_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)
