import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from landreach.operators.raster import Grid
from landreach.sources import formats, wkb

SQUARE = [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]]]


@pytest.mark.parametrize(
    ("kind", "parts"),
    [("Point", [[[(1.5, -2.0)]]]), ("LineString", [[[(0.0, 0.0), (1.0, 2.0)]]]), ("Polygon", SQUARE), ("MultiLineString", [[[(0.0, 0.0), (1.0, 1.0)]], [[(5.0, 5.0), (6.0, 6.0)]]]), ("MultiPolygon", SQUARE * 2)],
)
def test_wkb_round_trip(kind, parts):
    assert wkb.from_wkb(wkb.to_wkb(kind, parts)) == (kind, parts)
    assert wkb.from_gpkg(wkb.to_gpkg(kind, parts, 4326)) == (kind, parts)


def test_wkb_drops_z_and_reads_big_endian():
    assert wkb.from_wkb(struct.pack(">BI3d", 0, 1001, 1, 2, 9)) == ("Point", [[[(1.0, 2.0)]]])
    assert wkb.from_wkb(struct.pack("<BI3d", 1, 0x80000001, 1, 2, 9)) == ("Point", [[[(1.0, 2.0)]]])


def _frame(spark):
    line = [[[Row(x=0.0, y=0.0), Row(x=3.0, y=4.0)]]]
    return spark.createDataFrame([("a", 1, 2.5, True, "LineString", line), (None, None, None, False, None, None)], "name string, n bigint, v double, ok boolean, " + formats.SHAPE)


def test_gpkg_layers(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "x.gpkg")
    formats.write_layers({"one": _frame(spark), "two": _frame(spark).limit(1)}, path)
    assert formats.layers(path) == ["one", "two"]
    got = spark.read.format("gpkg").load(path)
    assert sorted(got.collect(), key=str) == sorted(_frame(spark).select(got.columns).collect(), key=str)
    assert spark.read.format("gpkg").option("layer", "two").load(path).count() == 1
    assert formats.read_layers(spark, path, {"two": "osm_trunk", "missing": "x"}).select("source").collect() == [Row(source="osm_trunk")]
    with pytest.raises(Exception, match="no layer"):
        spark.read.format("gpkg").option("layer", "three").load(path)
    formats.write_layers({"two": _frame(spark)}, path)  # overwritten, not appended
    assert spark.read.format("gpkg").option("layer", "two").load(path).count() == 2


def test_parts_by_pattern_or_fallback(spark, tmp_path):
    formats.register(spark)
    for k in "ab":
        formats.write_layers({"roads": _frame(spark)}, str(tmp_path / f"roads_{k}.gpkg"))
    assert formats.read_parts(spark, str(tmp_path / "roads_*.gpkg"), "none").count() == 4
    assert formats.read_parts(spark, str(tmp_path / "no_*.gpkg"), str(tmp_path / "roads_a.gpkg")).count() == 2


def test_geotiff_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "PART_CELLS", 14)  # two rows a strip
    formats.register(spark)
    path, grid = str(tmp_path / "x.tif"), Grid(30.0, -15.0, 0.5, -0.25, 7, 5)
    cells = spark.createDataFrame([(0, 0, 1.5), (4, 6, 2.0), (2, 3, 7.25)], "row int, col int, value double")
    formats.write_tiff(cells, grid, path)
    got = spark.read.format("geotiff").load(path)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.5), (2, 3, 7.25), (4, 6, 2.0)]
    assert spark.read.format("geotiff").option("all", True).load(path).count() == 35
    assert formats.tiff_grid(path) == grid


@pytest.mark.parametrize("predictor", [1, 3])
def test_deflated_tiles(spark, tmp_path, predictor):
    formats.register(spark)
    a = np.arange(20 * 20, dtype="<f4").reshape(20, 20)
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            t = np.zeros((16, 16), "<f4")
            part = a[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            if predictor == 3:
                planes = t.astype(">f4").view("u1").reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
                raw = np.diff(planes.astype("i2"), axis=1, prepend=0).astype("u1").tobytes()
            else:
                raw = t.tobytes()
            tiles.append(zlib.compress(raw))
    tags = [(256, 3, 20), (257, 3, 20), (258, 3, 32), (259, 3, 8), (277, 3, 1), (317, 3, predictor), (322, 3, 16), (323, 3, 16), (324, 4, None), (325, 4, None), (339, 3, 3)]
    base = 8 + 2 + 12 * len(tags) + 4
    at, offsets = base + 32, []
    for t in tiles:
        offsets.append(at)
        at += len(t)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for tag, kind, v in tags:
        out += struct.pack("<HHII", tag, kind, 4, base + (16 if tag == 325 else 0)) if v is None else struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", v)
    out += b"\0\0\0\0" + struct.pack("<4I", *offsets) + struct.pack("<4I", *map(len, tiles)) + b"".join(tiles)
    (tmp_path / "t.tif").write_bytes(out)
    got = spark.read.format("geotiff").load(str(tmp_path / "t.tif")).toPandas()
    assert len(got) == 400 and (got["value"] == got["row"] * 20 + got["col"]).all()


def test_shapefile(spark, tmp_path):
    formats.register(spark)
    shapes = [struct.pack("<i4d2i2i", 3, 0, 0, 0, 0, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3), struct.pack("<i", 0), struct.pack("<i2d", 1, 5, 6)]
    shp, shx = b"\0" * 100, b"\0" * 100
    for s in shapes:
        shx += struct.pack(">2i", len(shp) // 2, len(s) // 2)
        shp += struct.pack(">2i", 1, len(s) // 2) + s
    fields = [("F_CODE_DES", "C", 8, 0), ("N", "N", 4, 0), ("V", "N", 6, 2)]
    head = struct.pack("<4B", 3, 0, 0, 0) + struct.pack("<IHH", 3, 32 + 32 * 3 + 1, 19) + b"\0" * 20
    head += b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields) + b"\r"
    rows = b" Road       1  2.50" + b" Trail          " + b"   " + b"*Gone       3  1.00"
    for name, raw in (("shp", shp), ("shx", shx), ("dbf", head + rows)):
        (tmp_path / f"r.{name}").write_bytes(raw)
    got = spark.read.format("shapefile").load(str(tmp_path / "r.shp")).collect()
    assert [(r["F_CODE_DES"], r["N"], r["V"], r["geometry_type"]) for r in got] == [("Road", 1, 2.5, "MultiLineString"), ("Trail", None, None, None)]
    assert [[(p.x, p.y) for p in part[0]] for part in got[0]["parts"]] == [[(0, 0), (1, 1)], [(2, 2), (3, 3)]]


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    made = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"shapeName": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"shapeName": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
    ]}
    (tmp_path / "d.json").write_text(json.dumps(made))
    got = formats.read_geojson(spark, str(tmp_path / "d.json")).orderBy("ord").collect()
    assert [(r["shapeName"], len(r["rings"])) for r in got] == [("A", 1), (None, 3)]
    assert got[0]["rings"][0][1] == Row(x=1.0, y=0.0)


def test_facility_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('ID1,Province,NAMEOFFACI\n,#adm1,#loc\n#id,#adm1,kept\n1,P,"two\nlines, ""quoted"""\n2,P,\n')
    got = formats.read_facilities(spark, str(tmp_path / "f.csv")).collect()
    assert [r["NAMEOFFACI"] for r in got] == ["kept", 'two\nlines, "quoted"']
    formats.write_csv(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "out"))
    assert formats.read_csv(spark, str(tmp_path / "out"), "n int, s string").collect() == [Row(n=1, s="a")]


def _lzw(data: bytes) -> bytes:
    """By the format's description: codes are written high bits first, and widen one code early."""
    bits, width, table = "", 9, {bytes([i]): i for i in range(256)}
    bits, free, held = f"{256:09b}", 258, b""
    for byte in data:
        if held + bytes([byte]) in table:
            held += bytes([byte])
            continue
        bits += f"{table[held]:0{width}b}"
        table[held + bytes([byte])] = free
        free, held = free + 1, bytes([byte])
        width = 9 + (free > 511) + (free > 1023) + (free > 2047)
        if free == 4095:
            bits += f"{256:0{width}b}"
            width, table, free = 9, {bytes([i]): i for i in range(256)}, 258
    bits += (f"{table[held]:0{width}b}" if held else "") + f"{257:0{width}b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


def _packbits(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + bytes([257 - 3]) + b"zzz"


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", [1, 5, 32773, 50000])
def test_compressions_and_big_files(spark, tmp_path, compression, big):
    import struct

    import numpy as np
    import zstandard

    values = np.random.default_rng(2).integers(0, 30, (60, 70)).astype("<u2")
    raw = values.tobytes()
    packed = {1: bytes, 5: _lzw, 32773: _packbits, 50000: zstandard.ZstdCompressor().compress}[compression](raw)
    head = 16 if big else 8
    word, n = ("Q", 16) if big else ("I", 4)
    at = 400
    tags = [(256, 3, 70), (257, 3, 60), (258, 3, 16), (259, 3, compression), (273, n, at), (277, 3, 1), (278, 3, 60), (279, n, len(packed)), (339, 3, 1)]
    body = struct.pack("<Q" if big else "<H", len(tags)) + b"".join(struct.pack(f"<HH{word}", t, k, 1) + struct.pack("<H" if k == 3 else f"<{word}", v).ljust(8 if big else 4, b"\0") for t, k, v in tags)
    first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    assert len(first) == head
    (tmp_path / "t.tif").write_bytes((first + body + bytes(8)).ljust(at, b"\0") + packed)
    formats.register(spark)
    got = spark.read.format("geotiff").load(str(tmp_path / "t.tif")).toPandas().sort_values(["row", "col"])
    assert np.array_equal(got["value"].to_numpy().reshape(60, 70), values)


def test_frames_are_read(spark, tmp_path):
    formats.register(spark)
    shape = [[[Row(x=500_000.0, y=8_000_000.0), Row(x=500_100.0, y=8_000_000.0)]]]
    kind = f"source string, {formats.SHAPE}"
    metres = spark.createDataFrame([("a", "LineString", shape)], kind)
    formats.write_layers({"roads": metres}, str(tmp_path / "m.gpkg"), 32736)
    assert formats.srid_of(str(tmp_path / "m.gpkg")) == 32736
    assert formats.metres_of(spark, str(tmp_path / "m.gpkg")).first().parts == shape
    degrees = spark.createDataFrame([("a", "LineString", [[[Row(x=33.0, y=-18.0)]]])], kind)
    formats.write_layers({"roads": degrees}, str(tmp_path / "d.gpkg"), 4326)
    p = formats.metres_of(spark, str(tmp_path / "d.gpkg")).first().parts[0][0][0]
    assert formats.srid_of(str(tmp_path / "d.gpkg")) == 4326 and p.x == pytest.approx(500_000, abs=1e-3) and 8_000_000 < p.y < 8_020_000
    with pytest.raises(ValueError, match="3857"):
        formats.in_metres(degrees, 3857)
    for text, want in (('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]', 4326), ('PROJCS["WGS_1984_UTM_Zone_36S",GEOGCS["GCS_WGS_1984"]]', 32736)):
        (tmp_path / "s.prj").write_text(text)
        assert formats.srid_of(str(tmp_path / "s.shp")) == want
    (tmp_path / "s.prj").write_text('PROJCS["Lambert"]')
    with pytest.raises(ValueError, match="frame"):
        formats.srid_of(str(tmp_path / "s.shp"))
    assert formats.srid_of(str(tmp_path / "none.shp")) is None
