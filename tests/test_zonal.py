"""Empty cells count, and empty districts keep a row."""

import json

from landreach.plans import steps


def test_empty_cells_and_empty_districts(spark, tmp_path):
    box = lambda x0, x1, y0, y1: [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]
    shapes = {"Kariba": box(32.0, 33.0, -19.5, -17.5), "Binga": box(34.0, 35.0, -19.5, -18.5), "Chipinge": box(40.0, 41.0, -19.5, -17.5), "Harare": box(34.0, 35.0, -19.4, -18.6), "Unlisted": box(33.0, 34.0, -19.5, -17.5)}
    features = [{"type": "Feature", "properties": {"shapeName": n}, "geometry": {"type": "Polygon", "coordinates": c}} for n, c in shapes.items()]
    (tmp_path / "districts.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "census.csv").write_text("province,district,total\nP,Kariba,300\nP,Binga,100\nP,Chipinge,7\nP,Harare,9\n")
    (tmp_path / "pop.csv").write_text("X,Y,Z\n32.5,-18.0,10\n33.5,-18.0,20\n33.5,-19.0,5\n34.5,-18.0,4\n")  # nobody at 32.5, -19 and 34.5, -19
    d = lambda n: str(tmp_path / n)
    summary = steps.prepare_population(spark, d("pop.csv"), d("districts.json"), d("census.csv"), d("cal.tif"), d("summary"), cell_size_deg=1.0)
    got = {x.district: (x.worldpop_2020_modeled, x.census_2022, x.calibration_factor, x.n_worldpop_cells) for x in summary.collect()}
    assert got == {"Kariba": (10.0, 300.0, 30.0, 2), "Binga": (0.0, 100.0, 0.0, 1), "Chipinge": (0.0, 7.0, 0.0, 0)}
