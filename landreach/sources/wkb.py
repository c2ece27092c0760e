"""Well-known binary and GeoPackage geometry: points, lines and polygons to nested arrays of x and y, and back."""

from __future__ import annotations

import struct

#: Geometry type codes.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON = 1, 2, 3, 4, 5, 6
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTI_POINT: "MultiPoint", MULTI_LINE: "MultiLineString", MULTI_POLYGON: "MultiPolygon"}
CODES = {v: k for k, v in NAMES.items()}


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def points(self, order: str, n: int, dims: int) -> list[tuple[float, float]]:
        flat = self.take(f"{order}{n * dims}d")
        return [(flat[i], flat[i + 1]) for i in range(0, n * dims, dims)]

    def geometry(self) -> tuple[int, list]:
        """Type code and parts; a part is a list of rings or lines, each a list of (x, y)."""
        order = "<" if self.take("B")[0] else ">"
        code = self.take(order + "I")[0]
        extra = code & 0xE0000000  # flags of the extended form
        if extra & 0x20000000:
            self.take(order + "I")
        code &= 0x1FFFFFFF
        dims = 2 + ({0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)) + bool(extra & 0x80000000) + bool(extra & 0x40000000)
        code %= 1000
        if code == POINT:
            return code, [[self.points(order, 1, dims)]]
        if code == LINE:
            return code, [[self.points(order, self.take(order + "I")[0], dims)]]
        if code == POLYGON:
            return code, [[self.points(order, self.take(order + "I")[0], dims) for _ in range(self.take(order + "I")[0])]]
        if code in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON):
            return code, [part for _ in range(self.take(order + "I")[0]) for part in self.geometry()[1]]
        raise ValueError(f"geometry type {code} isn't supported")


def from_wkb(data: bytes) -> tuple[str, list]:
    code, parts = _Reader(data).geometry()
    return NAMES[code], parts


def to_wkb(kind: str, parts: list) -> bytes:
    code = CODES[kind]

    def body(c: int, part: list) -> bytes:
        head = struct.pack("<BI", 1, c)
        if c == POINT:
            return head + struct.pack("<2d", *part[0][0])
        lines = [struct.pack("<I", len(ring)) + struct.pack(f"<{2 * len(ring)}d", *[v for p in ring for v in p]) for ring in part]
        return head + (lines[0] if c == LINE else struct.pack("<I", len(lines)) + b"".join(lines))

    if code <= POLYGON:
        return body(code, parts[0])
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(body(code - 3, p) for p in parts)


#: Bytes of a GeoPackage header's envelope by its indicator.
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def from_gpkg(blob: bytes) -> tuple[str, list] | None:
    """A GeoPackage blob; None for an empty geometry."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    if flags & 0x10:
        return None
    return from_wkb(blob[8 + _ENVELOPE[(flags >> 1) & 7] :])


def to_gpkg(kind: str, parts: list, srid: int) -> bytes:
    return b"GP\x00\x01" + struct.pack("<i", srid) + to_wkb(kind, parts)
