"""GeoTIFF bytes to arrays and back: strips or tiles, uncompressed, LZW or deflate, with affine and CRS, classic or with 64-bit offsets.

The codec works on bytes that Spark has read, so a file may be in any store that Spark can read, or on anything
that gives bytes for a slice, such as FileBytes, of which only the header and the strips of a window are read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Tag numbers, field types and codes of TIFF 6.0 and GeoTIFF 1.0.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPE_SIZE = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 18: ("Q", 8)}
CLASSIC, BIG = 42, 43
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
PROJECTED, GEOGRAPHIC, MODEL_TYPE, RASTER_TYPE = 3072, 2048, 1024, 1025


@dataclass
class Meta:
    width: int
    height: int
    count: int
    dtype: str
    crs: str | None
    affine: tuple[float, float, float, float, float, float]
    nodata: float | None = None
    compression: int = NONE


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes from 9 to 12 bits, the highest bit first, one code earlier wider than needed."""
    bits, held, out, width = 0, 0, bytearray(), 9
    table = {bytes([i]): i for i in range(256)}

    def put(code):
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        word = data[i : i + 1]
        size = len(table) + 2
        if size == 4094:
            put(table[word])
            put(256)
            table, width, word = {bytes([j]): j for j in range(256)}, 9, b""
        elif size > (1 << width) - 1 and width < 12:
            width += 1
    if word:
        put(table[word])
        if len(table) + 3 > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    bits, held, at, width, out, last = 0, 0, 0, 9, bytearray(), None
    table: list[bytes] = []
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        if len(table) + 1 > (1 << width) - 1 and width < 12:
            width += 1


class FileBytes:
    """Slices of an open file with seek and read; small reads are served from the last block of BLOCK bytes."""

    BLOCK = 1 << 16

    def __init__(self, file):
        self.file, self.at, self.held, self.taken = file, 0, b"", 0

    def __getitem__(self, part: slice) -> bytes:
        start, stop = part.start or 0, part.stop
        if self.at <= start and stop <= self.at + len(self.held):
            return self.held[start - self.at : stop - self.at]
        self.file.seek(start)
        if stop - start >= self.BLOCK:
            self.taken += stop - start
            return bytes(self.file.read(stop - start))
        self.at, self.held = start, bytes(self.file.read(self.BLOCK))
        self.taken += len(self.held)
        return self.held[: stop - start]


def _unpack_at(form: str, data, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def _entries(data) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[0:2])
    version = _unpack_at(order + "H", data, 2)[0] if order else 0
    if version not in (CLASSIC, BIG):
        raise ValueError("not a TIFF file")
    # where the directory's offset is, the forms of its length, of an entry's and of an offset, and an entry's size
    first, many, each, offset, size = (4, "H", "HHI", "I", 12) if version == CLASSIC else (8, "Q", "HHQ", "Q", 20)
    at = _unpack_at(order + offset, data, first)[0]
    found = {}
    begin, inline = at + struct.calcsize("<" + many), struct.calcsize("<" + offset)
    for i in range(_unpack_at(order + many, data, at)[0]):
        tag, kind, n = _unpack_at(order + each, data, begin + size * i)
        code, width = TYPE_SIZE.get(kind, ("B", 1))
        place = begin + size * (i + 1) - inline
        if n * width > inline:
            place = _unpack_at(order + offset, data, place)[0]
        found[tag] = (data[place : place + n].rstrip(b"\0").decode("latin-1"),) if kind == 2 else _unpack_at(f"{order}{n * len(code)}{code[0]}", data, place)
    return order, found


def _kind(tags: dict) -> str:
    return {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]] + str(tags.get(BITS, (8,))[0] // 8)


def _crs(tags: dict) -> str | None:
    keys = tags.get(GEO_KEYS, ())
    for i in range(4, len(keys), 4):
        if keys[i] in (PROJECTED, GEOGRAPHIC) and keys[i + 1] == 0:
            return f"EPSG:{keys[i + 3]}"
    return None


def _affine(tags: dict) -> tuple:
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        return (m[0], m[1], m[3], m[4], m[5], m[7])
    if PIXEL_SCALE in tags:
        (sx, sy, *_), t = tags[PIXEL_SCALE], tags.get(TIEPOINT, (0.0,) * 6)
        return (sx, 0.0, t[3] - t[0] * sx, 0.0, -sy, t[4] + t[1] * sy)
    return (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def read_meta(data: bytes) -> Meta:
    """The header only."""
    _, tags = _entries(data)
    nodata = tags.get(NODATA, (None,))[0]
    return Meta(tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0], np.dtype(_kind(tags)).name, _crs(tags), tuple(map(float, _affine(tags))), float(nodata) if nodata else None, tags.get(COMPRESSION, (1,))[0])


def _unpack(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression == LZW:
        return lzw_decode(raw)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    raise ValueError(f"TIFF compression {compression} is not supported")


@dataclass
class Layout:
    """Where the pixels of a file are: bands of rows that are one strip, or one row of tiles, high."""

    width: int
    height: int
    count: int
    kind: np.dtype
    planar: bool
    tiled: bool
    tile_width: int
    tile_height: int
    offsets: tuple
    counts: tuple
    compression: int
    predictor: int

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def sizes(self) -> np.ndarray:
        """Stored bytes of each band of rows."""
        return np.array(self.counts, np.int64).reshape(-1, self.down, self.across).sum(axis=(0, 2))


def read_layout(data) -> Layout:
    order, tags = _entries(data)
    width, height, tiled = tags[WIDTH][0], tags[HEIGHT][0], TILE_OFFSETS in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, (height,))[0], height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    return Layout(width, height, tags.get(SAMPLES, (1,))[0], np.dtype(order + _kind(tags)), tags.get(PLANAR, (1,))[0] == 2, tiled, tw, th, offsets, counts, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0])


def read_window(data: bytes, x: int = 0, y: int = 0, w: int | None = None, h: int | None = None, bands: int | None = None, layout: Layout | None = None) -> np.ndarray:
    """Bands, rows and columns of a window, cut by the raster; only the strips or tiles that it touches are unpacked.

    A strip or tile of no bytes holds zeros.
    """
    m = layout or read_layout(data)
    x1, y1 = min(m.width, x + (m.width if w is None else w)), min(m.height, y + (m.height if h is None else h))
    x, y = max(0, x), max(0, y)
    want = m.count if bands is None else min(m.count, bands)
    native = m.kind.newbyteorder("=")
    out = np.zeros((want, max(0, y1 - y), max(0, x1 - x)), native)
    tw, th = m.tile_width, m.tile_height
    for plane in range(want if m.planar else 1):
        for ty in range(y // th, -(-y1 // th)):
            for tx in range(x // tw, -(-x1 // tw)):
                i = plane * m.across * m.down + ty * m.across + tx
                if not m.counts[i]:
                    continue
                rows = th if m.tiled else min(th, m.height - ty * th)
                deep = 1 if m.planar else m.count
                block = np.frombuffer(_unpack(data[m.offsets[i] : m.offsets[i] + m.counts[i]], m.compression), m.kind, rows * tw * deep).reshape(rows, tw, deep)
                if m.predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=native)
                a, b, c, d = max(y, ty * th), min(y1, ty * th + rows), max(x, tx * tw), min(x1, (tx + 1) * tw)
                part = block[a - ty * th : b - ty * th, c - tx * tw : d - tx * tw].transpose(2, 0, 1)
                out[plane : plane + 1 if m.planar else want, a - y : b - y, c - x : d - x] = part[:want] if not m.planar else part
    return out


def packed(rows: np.ndarray, compression: int) -> bytes:
    """A strip of bands, rows and columns as it is stored."""
    raw = np.ascontiguousarray(rows.transpose(1, 2, 0)).astype(rows.dtype.newbyteorder("<")).tobytes()
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[compression](raw)


def head(width: int, height: int, count: int, dtype: np.dtype, affine: tuple, epsg: int | None, compression: int, nodata: float | None, strip_rows: int, offsets: list[int], counts: list[int], big: bool = False) -> bytes:
    """What stands before the strips of a little-endian file: header, directory, and the values that do not fit into it.

    Its length follows from the number of strips and the other values, not from the offsets.
    """
    ax, bx, cx, dy, ey, fy = affine
    keys = [1, 1, 0, 3 if epsg else 2, MODEL_TYPE, 0, 1, 1 if not epsg or not 4000 <= epsg < 5000 else 2, RASTER_TYPE, 0, 1, 1]
    if epsg:
        keys += [GEOGRAPHIC if 4000 <= epsg < 5000 else PROJECTED, 0, 1, epsg]
    tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [dtype.itemsize * 8] * count), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if count >= 3 else 1]), SAMPLES: (3, [count]), ROWS_PER_STRIP: (4, [strip_rows]), PLANAR: (3, [1]), SAMPLE_FORMAT: (3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * count), GEO_KEYS: (3, keys)}
    if bx or dy or ey > 0:
        tags[TRANSFORM] = (12, [ax, bx, 0.0, cx, dy, ey, 0.0, fy, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
    else:
        tags |= {PIXEL_SCALE: (12, [ax, -ey, 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, cx, fy, 0.0])}
    if nodata is not None:
        tags[NODATA] = (2, f"{nodata:g}\0".encode())
    tags |= {STRIP_COUNTS: (16 if big else 4, counts), STRIP_OFFSETS: (16 if big else 4, offsets)}
    form, inline, start = ("<HHQ", 8, 16) if big else ("<HHI", 4, 8)
    many, offset = ("<Q", "<Q") if big else ("<H", "<I")
    at = start + struct.calcsize(many) + (struct.calcsize(form) + inline) * len(tags) + inline
    directory, body = bytearray(struct.pack(many, len(tags))), bytearray()
    for t in sorted(tags):
        kind, values = tags[t]
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{TYPE_SIZE[kind][0]}", *values)
        directory += struct.pack(form, t, kind, len(values))
        if len(raw) <= inline:
            directory += raw.ljust(inline, b"\0")
        else:
            directory += struct.pack(offset, at + len(body))
            body += raw + b"\0" * (-len(raw) % 8)
    first = b"II" + (struct.pack("<HHHQ", BIG, 8, 0, start) if big else struct.pack("<HI", CLASSIC, start))
    return bytes(first + directory + bytes(inline) + body)


def write(a: np.ndarray, affine: tuple = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), epsg: int | None = None, compression: int = DEFLATE, nodata: float | None = None, strip_rows: int = 64, big: bool = False) -> bytes:
    """A little-endian GeoTIFF in strips of an array of bands, rows and columns (or rows and columns)."""
    a = a[None] if a.ndim == 2 else a
    count, height, width = a.shape
    strips = [packed(a[:, r : r + strip_rows], compression) for r in range(0, height, strip_rows)]
    counts = [len(s) for s in strips]
    made = lambda offsets: head(width, height, count, a.dtype, affine, epsg, compression, nodata, strip_rows, offsets, counts, big)
    base = len(made([0] * len(strips)))
    return made([base + sum(counts[:i]) for i in range(len(strips))]) + b"".join(strips)
