"""Data sources for GeoPackage, shapefiles and GeoTIFF, and readers for the plain formats.

Geometry comes as ``geometry_type`` and ``parts``: an array of parts, each an
array of rings or lines, each an array of (x, y). Register with ``register``.
"""

from __future__ import annotations

import glob
import math
import os
import re
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from landreach.functions.crs import utm_forward
from landreach.sources import wkb

PARTS = "array<array<array<struct<x:double,y:double>>>>"
SHAPE = f"geometry_type string, parts {PARTS}"


def local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


def _dicts(parts: list | None) -> list | None:
    return None if parts is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


def _pairs(parts: list | None) -> list:
    return [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in parts or []]


def _spans(n: int, most: int) -> list[tuple[int, int]]:
    step = max(1, math.ceil(n / max(1, most)))
    return [(i, min(n, i + step)) for i in range(0, n, step)] or [(0, 0)]


class _Span(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _batches(rows: Iterator[tuple], schema: T.StructType, size: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


# --- GeoPackage


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{local(path)}?mode=ro", uri=True)


def layers(path: str) -> list[str]:
    with _open(path) as con:
        return [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid")]


_SQLITE = {"INT": "bigint", "INTEGER": "bigint", "MEDIUMINT": "int", "SMALLINT": "int", "TINYINT": "int", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "BLOB": "binary"}


class GeoPackage(DataSource):
    """``spark.read.format("gpkg").option("layer", ...)``: the first layer unless one is named. Rows are read by spans of row ids."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _layer(self) -> str:
        found = layers(self.options["path"])
        name = self.options.get("layer") or (found[0] if found else None)
        if name not in found:
            raise ValueError(f"no layer {name!r} in {self.options['path']}")
        return name

    def _columns(self) -> tuple[str, str, list[tuple[str, str]]]:
        layer = self._layer()
        with _open(self.options["path"]) as con:
            geom = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
            info = con.execute(f'PRAGMA table_info("{layer}")').fetchall()
        return layer, geom, [(r[1], _SQLITE.get(r[2].upper().split("(")[0], "string")) for r in info if r[1] != geom and not r[5]]

    def schema(self) -> str:
        return ", ".join([*(f"`{n}` {k}" for n, k in self._columns()[2]), SHAPE])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        layer, geom, _ = self._columns()
        return _GeoPackageReader(self.options, schema, layer, geom)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _GeoPackageWriter(self.options, schema, overwrite)


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options, schema, layer, geom):
        self.path, self.layer, self.geom, self.kept = options["path"], layer, geom, schema
        self.most = int(options.get("partitions", 64))

    def partitions(self):
        with _open(self.path) as con:
            n = con.execute(f'SELECT coalesce(max(rowid), 0) FROM "{self.layer}"').fetchone()[0]
        return [_Span(lo, hi) for lo, hi in _spans(n, min(self.most, max(1, n // 50_000)))]

    def read(self, partition):
        names = [f.name for f in self.kept.fields if f.name not in ("geometry_type", "parts")]
        wanted = "".join(f', "{n}"' for n in names)
        flags = [isinstance(self.kept[n].dataType, T.BooleanType) for n in names]

        def rows():
            with _open(self.path) as con:
                for blob, *rest in con.execute(f'SELECT "{self.geom}"{wanted} FROM "{self.layer}" WHERE rowid > ? AND rowid <= ? ORDER BY rowid', (partition.lo, partition.hi)):
                    shape = wkb.from_gpkg(blob) if blob is not None else None
                    values = dict(zip(names, (bool(v) if b and v is not None else v for v, b in zip(rest, flags))))
                    values |= {"geometry_type": shape and shape[0], "parts": _dicts(shape[1]) if shape else None}
                    yield tuple(values[f.name] for f in self.kept.fields)

        return _batches(rows(), self.kept)


class _Wrote(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _GeoPackageWriter(DataSourceWriter):
    """Tasks write their rows beside the target, in a folder that all executors share; the commit puts them into one file."""

    def __init__(self, options, schema, overwrite):
        self.path, self.layer, self.srid = local(options["path"]), options.get("layer", "layer"), int(options.get("srid", 32736))
        self.fields, self.overwrite = schema.fields, overwrite
        self.stage = f"{self.path}.{os.urandom(6).hex()}.parts"

    def _sql_type(self, kind: T.DataType) -> str:
        return {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}.get(kind.simpleString(), "TEXT")

    def write(self, rows):
        os.makedirs(self.stage, exist_ok=True)
        part = f"{self.stage}/{os.urandom(8).hex()}.sqlite"
        names = [f.name for f in self.fields if f.name not in ("geometry_type", "parts")]
        with sqlite3.connect(part) as con:
            con.execute("CREATE TABLE t (geom BLOB" + "".join(f', "{n}"' for n in names) + ")")
            for row in rows:
                d = row.asDict()
                shape = wkb.to_gpkg(d["geometry_type"], _pairs(row["parts"]), self.srid) if d.get("geometry_type") else None
                con.execute(f"INSERT INTO t VALUES (?{', ?' * len(names)})", [shape, *(d[n] for n in names)])
        return _Wrote(part)

    def commit(self, messages):
        names = [f.name for f in self.fields if f.name not in ("geometry_type", "parts")]
        with sqlite3.connect(self.path) as con:
            con.executescript(
                "PRAGMA application_id = 1196444487;"
                "CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, srs_id INTEGER);"
                "CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);"
                "CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);"
            )
            con.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, '')", (f"EPSG:{self.srid}", self.srid, self.srid))
            if self.overwrite:
                con.execute(f'DROP TABLE IF EXISTS "{self.layer}"')
            columns = "".join(f', "{f.name}" {self._sql_type(f.dataType)}' for f in self.fields if f.name in names)
            con.execute(f'CREATE TABLE IF NOT EXISTS "{self.layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{columns})')
            con.execute("INSERT OR REPLACE INTO gpkg_contents VALUES (?, 'features', ?, ?)", (self.layer, self.layer, self.srid))
            con.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (self.layer, self.srid))
            listed = "".join(f', "{n}"' for n in names)
            for m in messages:
                con.commit()
                con.execute("ATTACH ? AS part", (m.path,))
                con.execute(f'INSERT INTO "{self.layer}" (geom{listed}) SELECT geom{listed} FROM part.t ORDER BY rowid')
                con.commit()
                con.execute("DETACH part")
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        for f in glob.glob(f"{self.stage}/*"):
            os.remove(f)
        if os.path.isdir(self.stage):
            os.rmdir(self.stage)


# --- shapefiles


def _dbf(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, bytes before them, bytes of each, and the fields (name, kind, length, decimals)."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, start, size = struct.unpack("<IHH", head[4:12])
        fields = []
        while (raw := f.read(32))[:1] not in (b"\r", b""):
            fields.append((raw[:11].split(b"\0")[0].decode("latin-1"), chr(raw[11]), raw[16], raw[17]))
    return n, start, size, fields


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load("x.shp")`` with x.shx and x.dbf beside it; records are read by spans."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = _dbf(local(self.options["path"])[:-4] + ".dbf")[3]
        kind = lambda k, dec: "double" if k == "F" or (k == "N" and dec) else "bigint" if k == "N" else "boolean" if k == "L" else "string"
        return ", ".join([*(f"`{n}` {kind(k, dec)}" for n, k, _, dec in fields), SHAPE])

    def reader(self, schema):
        return _ShapefileReader(self.options, schema)


class _ShapefileReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.kept = local(options["path"])[:-4], schema

    def partitions(self):
        n = (os.path.getsize(self.path + ".shx") - 100) // 8
        return [_Span(lo, hi) for lo, hi in _spans(n, max(1, n // 20_000))]

    @staticmethod
    def _shape(content: bytes) -> tuple[str | None, list | None]:
        code = struct.unpack_from("<i", content)[0] % 10
        if code == 0:
            return None, None
        if code == 1:
            return "Point", [[[struct.unpack_from("<2d", content, 4)]]]
        if code == 8:
            n = struct.unpack_from("<i", content, 36)[0]
            flat = struct.unpack_from(f"<{2 * n}d", content, 40)
            return "MultiPoint", [[[(flat[i], flat[i + 1])]] for i in range(0, 2 * n, 2)]
        k, n = struct.unpack_from("<2i", content, 36)
        starts = [*struct.unpack_from(f"<{k}i", content, 44), n]
        flat = struct.unpack_from(f"<{2 * n}d", content, 44 + 4 * k)
        pts = [(flat[i], flat[i + 1]) for i in range(0, 2 * n, 2)]
        lines = [pts[a:b] for a, b in zip(starts, starts[1:])]
        if code == 5:  # rings of all parts together; the even-odd rule tells the holes
            return "Polygon", [lines]
        return ("LineString" if k == 1 else "MultiLineString"), [[line] for line in lines]

    def read(self, partition):
        n, start, size, fields = _dbf(self.path + ".dbf")

        def value(raw: bytes, kind: str, dec: int):
            text = raw.decode("utf-8", "replace").strip()
            if not text or set(text) == {"*"}:
                return None
            if kind == "F" or (kind == "N" and dec):
                return float(text)
            return int(float(text)) if kind == "N" else text in "YyTt" if kind == "L" else text

        def rows():
            with open(self.path + ".shx", "rb") as x, open(self.path + ".shp", "rb") as s, open(self.path + ".dbf", "rb") as t:
                x.seek(100 + 8 * partition.lo)
                t.seek(start + size * partition.lo)
                for _ in range(partition.lo, partition.hi):
                    at, length = struct.unpack(">2i", x.read(8))
                    s.seek(2 * at + 8)
                    kind, parts = self._shape(s.read(2 * length))
                    record, place, values = t.read(size), 1, {}
                    for name, k, width, dec in fields:
                        values[name] = value(record[place : place + width], k, dec)
                        place += width
                    values |= {"geometry_type": kind, "parts": _dicts(parts)}
                    if record[:1] != b"*":
                        yield tuple(values[f.name] for f in self.kept.fields)

        return _batches(rows(), self.kept)


# --- GeoTIFF


#: Cells of a raster that one task reads, or writes, about.
PART_CELLS = 4_000_000
#: TIFF field types (code: struct letter) and the tags that are read.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "rows", 279: "counts", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "sample", 33550: "scale", 33922: "tie", 34735: "keys", 42113: "nodata"}


def tiff_info(path: str) -> dict:
    """The tags of a file's first image: size, layout, scale, tie point and nodata."""
    with open(local(path), "rb") as f:
        order = {b"II": "<", b"MM": ">"}[f.read(2)]
        kind = struct.unpack(order + "H", f.read(2))[0]
        if kind not in (42, 43):
            raise ValueError(f"{path} isn't a TIFF")
        big = kind == 43
        word = "Q" if big else "I"  # of offsets and counts
        room = struct.calcsize(word)
        if big:
            f.seek(8)
        f.seek(struct.unpack(order + word, f.read(room))[0])
        out: dict = {"order": order, "compression": 1, "bands": 1, "predictor": 1, "sample": 1}
        for _ in range(struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]):
            tag, kind, n, raw = struct.unpack(f"{order}HH{word}{room}s", f.read(4 + 2 * room))
            if tag not in _TAGS:
                continue
            form = _TYPES[kind]
            size = n * struct.calcsize(order + form)
            if size > room:
                back = f.tell()
                f.seek(struct.unpack(order + word, raw)[0])
                raw = f.read(size)
                f.seek(back)
            values = raw[:n].rstrip(b"\0").decode() if kind == 2 else struct.unpack(order + form * n, raw[:size])
            out[_TAGS[tag]] = values if kind == 2 or n > 1 or tag in (273, 279, 324, 325) else values[0]
    out["nodata"] = float(out["nodata"]) if out.get("nodata") else None
    if "tile_width" not in out:
        out |= {"tile_width": out["width"], "tile_height": min(out.get("rows", out["height"]), out["height"]), "tile_offsets": out["offsets"], "tile_counts": out["counts"], "strips": True}
    if isinstance(out["bits"], tuple):
        out["bits"] = out["bits"][0]
    if isinstance(out["sample"], tuple):
        out["sample"] = out["sample"][0]
    return out


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends; a width ends one code early."""
    out, table, width, last = bytearray(), [], 9, b""
    bits = have = 0
    for byte in raw:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out)


def _packbits(raw: bytes) -> bytes:
    """Runs: a count up to 127 is followed by that many bytes and one more, one from 129 on by a byte that is repeated."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpacked(raw: bytes, compression: int) -> bytes:
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return {1: bytes, 5: _lzw, 32773: _packbits}[compression](raw)


class GeoTiff(DataSource):
    """``spark.read.format("geotiff")``: row, col, value of band 1, a partition for each run of strips or tiles.

    Classic and big files: plain, LZW, PackBits, deflated or zstd, with or without a predictor. Cells of the nodata
    value are left out unless the option ``all`` is true.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema):
        return _GeoTiffReader(self.options, schema)


class _GeoTiffReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.info, self.kept = local(options["path"]), tiff_info(options["path"]), schema
        self.every = str(options.get("all", "false")).lower() == "true"
        if self.info["compression"] not in (1, 5, 8, 32773, 32946, 50000):
            raise ValueError(f"compression {self.info['compression']} isn't read")

    def partitions(self):
        n = len(self.info["tile_offsets"])
        cells = self.info["tile_width"] * self.info["tile_height"]
        return [_Span(lo, hi) for lo, hi in _spans(n, max(1, n * cells // PART_CELLS))]

    def read(self, partition):
        i = self.info
        kind = np.dtype(i["order"] + {1: "u", 2: "i", 3: "f"}[i["sample"]] + str(i["bits"] // 8))
        across = -(-i["width"] // i["tile_width"])
        with open(self.path, "rb") as f:
            for k in range(partition.lo, partition.hi):
                f.seek(i["tile_offsets"][k])
                raw = f.read(i["tile_counts"][k])
                raw = _unpacked(raw, i["compression"])
                row, col = k // across * i["tile_height"], k % across * i["tile_width"]
                high = min(i["tile_height"], i["height"] - row) if i.get("strips") else i["tile_height"]
                raw = raw[: high * i["tile_width"] * i["bands"] * kind.itemsize]  # what is packed may be padded
                if i["predictor"] == 3:
                    planes = np.frombuffer(raw, "u1").reshape(high, -1)
                    planes = np.cumsum(planes, axis=1, dtype="u1").reshape(high, i["bits"] // 8, i["tile_width"])
                    tile = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(high, i["tile_width"])
                else:
                    tile = np.frombuffer(raw, kind).reshape(high, i["tile_width"], i["bands"])[:, :, 0]
                    if i["predictor"] == 2:
                        tile = np.cumsum(tile, axis=1, dtype=kind.newbyteorder("="))
                tile = tile[: i["height"] - row, : i["width"] - col].astype("f8")
                keep = np.ones(tile.shape, bool) if self.every or i["nodata"] is None else ~((tile == i["nodata"]) | (np.isnan(tile) & np.isnan(i["nodata"])))
                r, c = np.nonzero(keep)
                columns = {"row": pa.array((r + row).astype("i4")), "col": pa.array((c + col).astype("i4")), "value": pa.array(tile[r, c])}
                yield pa.RecordBatch.from_arrays([columns[n] for n in self.kept.names], names=self.kept.names)


def tiff_grid(path: str):
    """The grid of a GeoTIFF, from its scale and tie point."""
    from landreach.operators.raster import Grid

    i = tiff_info(path)
    sx, sy = i["scale"][:2]
    tx, ty, _, gx, gy, _ = i["tie"][:6]
    return Grid(gx - tx * sx, gy + ty * sy, sx, -sy, i["width"], i["height"])


def write_tiff(cells: DataFrame, grid, path: str, nodata: float = 0.0, srid: int = 4326) -> None:
    """One uncompressed 32-bit band, in strips of about PART_CELLS cells at most.

    The head is written first; then tasks write a strip each into their own
    place of the file, which must be in a folder that all executors share.
    """
    w, h = grid.width, grid.height
    band = max(1, min(256, h, PART_CELLS // max(1, w)))
    strips = -(-h // band)
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32]), (259, 3, [1]), (262, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 4, [band]), (279, 4, [4 * w * min(band, h - k * band) for k in range(strips)]), (339, 3, [3]), (33550, 12, [grid.dx, -grid.dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0]), (34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, srid]), (42113, 2, f"{nodata:g}")]
    start = 8 + 2 + 12 * len(entries) + 4
    forms = {3: "H", 4: "I", 12: "d"}
    size = lambda kind, v: len(v) + 1 if kind == 2 else struct.calcsize("<" + forms[kind]) * len(v)
    extra = sum(size(k, v if v is not None else [0] * strips) for _, k, v in entries)
    first = start + extra + 64
    offsets = [first + 4 * w * band * k for k in range(strips)]
    body, tail = b"", b""
    for tag, kind, v in entries:
        v = offsets if v is None else v
        raw = v.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(v)}{forms[kind]}", *v)
        body += struct.pack("<HHI", tag, kind, len(raw) if kind == 2 else len(v))
        if len(raw) <= 4:
            body += raw.ljust(4, b"\0")
        else:
            body += struct.pack("<I", start + len(tail))
            tail += raw
    with open(local(path), "wb") as f:
        f.write((struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + body + b"\0\0\0\0" + tail).ljust(first, b"\0"))
    target = local(path)

    def write(rows: pa.Table) -> pa.Table:
        k = rows.column("strip")[0].as_py()
        block = np.full((min(band, h - k * band), w), nodata, "<f4")
        some = rows.filter(rows.column("row").is_valid())
        block[some.column("row").to_numpy() - k * band, some.column("col").to_numpy()] = some.column("value").to_numpy()
        with open(target, "r+b") as f:
            f.seek(offsets[k])
            f.write(block.tobytes())
        return pa.table({"strip": pa.array([k], pa.int32())})

    rows = cells.filter((F.col("row") >= 0) & (F.col("row") < h)).select(F.floor(F.col("row") / band).cast("int").alias("strip"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    every = cells.sparkSession.range(strips).select(F.col("id").cast("int").alias("strip"), *[F.lit(None).cast(t).alias(n) for n, t in (("row", "int"), ("col", "int"), ("value", "double"))])
    if strips:
        rows.unionByName(every).groupBy("strip").applyInArrow(write, "strip int").agg(F.count("*")).first()


# --- frames


def srid_of(path: str, layer: str | None = None) -> int | None:
    """The EPSG number of the frame that a GeoPackage's layer, a shapefile's .prj or a GeoTIFF declares; None if it declares none.

    A .prj is known if it is WGS 84 in degrees or in UTM; another raises.
    """
    low = path.lower()
    if low.endswith(".gpkg"):
        with _open(path) as con:
            row = con.execute("SELECT srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer or (layers(path) or [""])[0],)).fetchone()
        return row[0] if row and row[0] > 0 else None
    if low.endswith((".tif", ".tiff")):
        keys = tiff_info(path).get("keys") or ()
        held = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
        return held.get(3072) or held.get(2048)
    if not os.path.exists(local(path)[:-4] + ".prj"):
        return None
    with open(local(path)[:-4] + ".prj", encoding="utf-8") as f:
        text = re.sub(r"[ _]", "", f.read().upper())
    if "WGS1984" not in text and "WGS84" not in text:
        raise ValueError(f"unknown frame of {path}")
    if text.startswith("GEOGCS"):
        return 4326
    zone = re.search(r"UTMZONE(\d+)([NS])", text)
    if not zone:
        raise ValueError(f"unknown frame of {path}")
    return (32600 if zone[2] == "N" else 32700) + int(zone[1])


def in_metres(df: DataFrame, srid: int | None) -> DataFrame:
    """The shapes of a table in metres of EPSG:32736: degrees (or no declared frame) are projected, metres stay, any other frame is refused."""
    if srid == 32736:
        return df
    if srid not in (None, 4326):
        raise ValueError(f"EPSG:{srid} isn't read: degrees of EPSG:4326 or metres of EPSG:32736 are")

    def metres(p):
        x, y = utm_forward(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return df.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, metres))))


def metres_of(spark: SparkSession, path: str) -> DataFrame:
    return in_metres(spark.read.format("gpkg").load(path), srid_of(path))


# --- plain formats


def register(spark: SparkSession) -> None:
    for source in (GeoPackage, Shapefile, GeoTiff):
        spark.dataSource.register(source)


def read_geojson(spark: SparkSession, path: str, name: str = "shapeName") -> DataFrame:
    """``ord, name, rings`` of a collection of polygons and multipolygons; all rings of a feature in one array."""
    point = "array<array<array<double>>>"
    raw = spark.read.schema("features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>").json(path, multiLine=True)
    f = raw.select(F.posexplode("features").alias("ord", "f")).select("ord", F.try_element_at("f.properties", F.lit(name)).alias(name), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = F.when(F.col("kind") == "Polygon", F.from_json("c", point)).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", f"array<{point}>")))
    return f.select("ord", name, F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """A table with a header; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """The raw list without its tag row (no ID1, and a Province that begins with #) and without rows that have no name."""
    df = read_csv(spark, path)
    return df.filter((F.col("ID1").isNotNull() | ~F.coalesce("Province", F.lit("nan")).startswith("#")) & F.col("NAMEOFFACI").isNotNull())


def read_parts(spark: SparkSession, pattern: str, fallback: str, read=None) -> DataFrame:
    """All files of a pattern, in the order of their names, or else the one file given instead; read as GeoPackages unless told otherwise."""
    read = read or (lambda spark, f: spark.read.format("gpkg").load(f))
    files = sorted(glob.glob(local(pattern))) or [fallback]
    out = None
    for f in files:
        part = read(spark, f)
        out = part if out is None else out.unionByName(part)
    return out


def read_layers(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Layers of a GeoPackage under their labels; one that is missing is passed over, and said so."""
    found = set(layers(path))
    out = None
    for layer, label in wanted.items():
        if layer not in found:
            print(f"{path}: no layer {layer}")
            continue
        part = spark.read.format("gpkg").option("layer", layer).load(path).select(F.lit(label).alias("source"), "geometry_type", "parts")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"none of the layers is in {path}")
    return out


def write_layers(frames: dict[str, DataFrame], path: str, srid: int = 32736) -> None:
    for layer, df in frames.items():
        df.coalesce(1).write.format("gpkg").option("layer", layer).option("srid", srid).mode("overwrite").save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
