"""Shapefiles and GeoJSON: points, lines and polygons with attributes, as bytes and as rows."""

from __future__ import annotations

import json
import struct

# Shape types of the shapefile format.
POINT, LINE, POLYGON = 1, 3, 5


def write_shp(kind: int, shapes: list) -> tuple[bytes, bytes]:
    """.shp and .shx of points (x, y) or, for lines and polygons, lists of parts (lists of points)."""
    records, index, at = bytearray(), bytearray(), 50
    flat = [[s] if kind == POINT else [p for part in s for p in part] for s in shapes]
    for i, (s, pts) in enumerate(zip(shapes, flat, strict=True), 1):
        if kind == POINT:
            body = struct.pack("<i2d", POINT, *s)
        else:
            starts = [sum(len(p) for p in s[:j]) for j in range(len(s))]
            box = (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
            body = struct.pack(f"<i4d2i{len(s)}i", kind, *box, len(s), len(pts), *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        records += struct.pack(">2i", i, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    every = [p for pts in flat for p in pts] or [(0.0, 0.0)]
    box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
    return head(50 + len(records) // 2) + bytes(records), head(50 + len(index) // 2) + bytes(index)


def read_shp(data: bytes) -> list:
    """(kind, shape) of each record; null shapes are None."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind == POINT:
            out.append((kind, struct.unpack_from("<2d", data, at + 12)))
        elif kind in (LINE, POLYGON):
            parts, n = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), n]
            raw = struct.unpack_from(f"<{2 * n}d", data, at + 52 + 4 * parts)
            pts = list(zip(raw[::2], raw[1::2], strict=True))
            out.append((kind, [pts[a:b] for a, b in zip(starts, starts[1:], strict=False)]))
        else:
            out.append((kind, None))
        at += 8 + size
    return out


def write_dbf(fields: list[tuple[str, str, int, int]], rows: list[tuple]) -> bytes:
    """fields (name, C or N, width, decimals)."""
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), width)
    head += b"".join(struct.pack("<11sc4x2B14x", n.encode()[:10], k.encode(), w, d) for n, k, w, d in fields) + b"\r"
    cell = lambda v, k, w, d: (("" if v is None else f"{v:.{d}f}" if k == "N" else str(v)).encode()[:w]).rjust(w) if k == "N" else ("" if v is None else str(v)).encode()[:w].ljust(w)
    return head + b"".join(b" " + b"".join(cell(v, k, w, d) for v, (_, k, w, d) in zip(r, fields, strict=True)) for r in rows) + b"\x1a"


def read_dbf(data: bytes) -> tuple[list[str], list[tuple]]:
    rows, first, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 13:
        name, kind, w, d = struct.unpack_from("<11sc4x2B", data, at)
        fields.append((name.split(b"\0")[0].decode(), kind, w, d))
        at += 32
    out = []
    for i in range(rows):
        at, row = first + i * size + 1, []
        for _, kind, w, d in fields:
            text = data[at : at + w].decode("utf-8", "replace").strip()
            row.append((None if not text else float(text) if d else int(text)) if kind == b"N" else text)
            at += w
        out.append(tuple(row))
    return [f[0] for f in fields], out


def rings_of_geojson(text: str) -> list[list[tuple[float, float]]]:
    """All outer and inner rings of the polygons of a GeoJSON text; the closing point is dropped."""
    doc = json.loads(text)
    found = [f["geometry"] for f in doc["features"]] if doc.get("type") == "FeatureCollection" else [doc.get("geometry", doc)]
    polygons = [p for g in found if g for p in ([g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else [])]
    return [[tuple(q[:2]) for q in (ring[:-1] if ring[0] == ring[-1] else ring)] for p in polygons for ring in p]
